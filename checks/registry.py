"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import Inputs, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Scalars both engines hash alike: text timestamps, doubles, longs, joined arrays."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            value = value.cast("long")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value, "; ")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn(inputs)`` under ``name``, with its SQL where there is one."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(Inputs(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle, ctes)
        return fn

    return register
