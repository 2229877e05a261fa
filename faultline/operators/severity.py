"""Severity of assessment rows and summaries per change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.classify import HARD_BREAK, SILENT_CORRUPTION, UNAFFECTED, affected
from faultline.operators.ordering import number_within

# The severity weights.
WEIGHT_HARD_BREAK, WEIGHT_SILENT, WEIGHT_SAFE = 10.0, 6.0, 0.0
DASHBOARD_FACTOR, BUSINESS_FACTOR = 2.0, 2.0
USAGE_DIVISOR = 10.0


def severity_score(mode: Column, usage: Column, exposed: Column, business: Column) -> Column:
    weight = F.when(mode == HARD_BREAK, WEIGHT_HARD_BREAK).when(mode == SILENT_CORRUPTION, WEIGHT_SILENT)
    return F.round(
        weight.otherwise(WEIGHT_SAFE)
        * (F.lit(1.0) + usage / USAGE_DIVISOR)
        * F.when(exposed, DASHBOARD_FACTOR).otherwise(1.0)
        * F.when(business, BUSINESS_FACTOR).otherwise(1.0),
        2,
    )


def severity_rank(assessment: DataFrame) -> DataFrame:
    """Assets of each change by falling severity, names breaking ties."""
    return number_within(
        assessment, ["change_id"], [F.desc("severity_score"), F.asc("node")], "severity_rank"
    )


def severity_topk(assessment: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most severe assets of each change.

    The bound is pushed below the shuffle: each map task keeps ``k`` rows per change.
    """
    order = Window.partitionBy("change_id").orderBy(F.desc("severity_score"), "node")
    ranked = assessment.withColumn("severity_rank", F.row_number().over(order))
    return ranked.filter(F.col("severity_rank") <= k)


def impact_summary(changes: DataFrame, assessment: DataFrame) -> DataFrame:
    """Counts per change; changes that reach nothing have zeros."""
    mode = F.col("break_mode")
    hit = mode != UNAFFECTED
    counts = assessment.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(hit).alias("affected"),
        F.count_if(mode == HARD_BREAK).alias("hard_breaks"),
        F.count_if(mode == SILENT_CORRUPTION).alias("silent_risks"),
        F.count_if(mode == UNAFFECTED).alias("safe"),
        F.count_if(F.col("in_column_scope")).alias("n_column_scope"),
        F.max("hop").alias("deepest_hop"),
        F.max(F.when(hit, F.col("hop"))).alias("affected_deepest_hop"),
        F.count_if(hit & F.col("is_dashboard_exposed")).alias("exposed_affected"),
    )
    # Made distinct per (change, owner) first: a hot change is reduced map-side.
    owners = affected(assessment).select("change_id", F.explode("owners").alias("owner")).distinct()
    owner_counts = owners.groupBy("change_id").agg(F.count(F.lit(1)).alias("distinct_owners"))
    joined = changes.join(counts, "change_id", "left").join(owner_counts, "change_id", "left")
    return joined.fillna(
        0,
        ["scanned", "affected", "hard_breaks", "silent_risks", "safe", "n_column_scope", "deepest_hop",
         "affected_deepest_hop", "exposed_affected", "distinct_owners"],
    )
