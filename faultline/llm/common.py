"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL where there is one."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Id and text alone, a null text as the empty one; no other column can clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def tokenizer_file(name: str) -> str:
    """The place of a tokenizer file: a path as it is, a bare name from the installed collection."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
