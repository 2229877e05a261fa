"""Analytics over call traces and repair attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL_BUDGET = 30


def calls_by_tool(calls: DataFrame, budget: int = CALL_BUDGET) -> DataFrame:
    """Calls per run and tool, with the run's total against the call budget."""
    per_tool = calls.groupBy("run_id", "tool").agg(F.count(F.lit(1)).alias("calls"))
    per_run = per_tool.groupBy("run_id").agg(F.sum("calls").alias("run_calls"))
    return per_tool.join(per_run, "run_id").withColumn("over_budget", F.col("run_calls") > budget)


def leading_count(summary: Column) -> Column:
    """The number a result summary starts with, null if it starts with none."""
    digits = F.nullif(F.regexp_extract(summary, r"^\s*0*([0-9]+)", 1), F.lit(""))
    # No result is as large as the largest long; a number beyond it counts as that.
    return F.when(digits.isNotNull(), F.coalesce(digits.try_cast("long"), F.lit((1 << 63) - 1)))


def result_counts(calls: DataFrame) -> DataFrame:
    return calls.withColumn("result_count", leading_count(F.col("result_summary")))


def verification_failures(attempts: DataFrame) -> DataFrame:
    """Outcomes and failures per check level, and how often it was the first to fail."""
    outcomes = attempts.select(
        F.explode("outcomes").alias("o"), F.get(F.filter("outcomes", lambda x: ~x["passed"]), F.lit(0))["level"].alias("first")
    )
    counts = outcomes.groupBy(F.col("o.level").alias("level")).agg(
        F.count(F.lit(1)).alias("outcomes"),
        F.count_if(~F.col("o.passed")).alias("failures"),
        F.count_if(~F.col("o.passed") & (F.col("first") == F.col("o.level"))).alias("first_failures"),
    )
    return counts.withColumn("failure_rate", F.col("failures") / F.col("outcomes"))
