"""Connected components of a link table, in alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's least neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def component_roots(links: DataFrame) -> DataFrame:
    """``links`` (u, v) to (u, root): the least node each linked node can reach, itself left out.

    Each round is written to the shared folder. A component of diameter d takes about
    log d rounds; rounds end when the table no longer changes. Self links are dropped.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    links = stage(ordered.distinct(), "links")
    before = None
    while True:
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before or not now[0]:
            return links.select("u", F.col("v").alias("root"))
        before = now
        links = stage(_small_star(_large_star(links).distinct()).distinct(), "links")
