"""Row numbers and previous values that do not funnel a hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import stage

_PART = "_part"


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` cut into ranges of keys *and* order, with the number of each row's range.

    A key that holds a third of the table spreads over a third of the ranges. The
    range number is written with the rows; a re-run of a lost task cannot change it.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return stage(ranged.withColumn(_PART, F.spark_partition_id()), "ranged")


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """1-based row number per ``keys`` in ``order``, with hot keys split.

    ``order`` must be total within a key. Without keys the whole table is numbered:
    ranges follow the values there are, so sparse ones are as good as dense ones, and
    only one count per range goes through the window that turns counts into offsets.
    """
    rows = _ranged(df, keys, order)
    counts = rows.groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, _PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, _PART).orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, _PART])
    return numbered.withColumn(out, (F.col("_rn") + F.col("_offset")).cast("long")).drop(_PART, "_rn", "_offset")


def previous_within(df: DataFrame, keys: Sequence[str], order_column: str, value: str, out: str) -> DataFrame:
    """The ``value`` of the preceding row per ``keys``, null on the first row.

    Windows run per key and range; the first row of a range takes its value from
    the last row of the key's range before it, found on one row per range.
    """
    rows = _ranged(df, keys, [F.col(order_column)])
    inside = Window.partitionBy(*keys, _PART).orderBy(order_column)
    rows = rows.withColumn("_prev", F.lag(F.struct(value)).over(inside))
    ends = rows.groupBy(*keys, _PART).agg(F.max_by(F.struct(value), order_column).alias("_last"))
    ends = ends.select(
        *keys, _PART, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_PART)).alias("_carried")
    )
    joined = rows.join(ends, [*keys, _PART])
    return joined.withColumn(out, F.coalesce("_prev", "_carried")[value]).drop(_PART, "_prev", "_carried")
