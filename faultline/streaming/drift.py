"""Schema drift on a stream of snapshots, kept as logs that are only ever added to.

Every micro-batch adds its snapshots to a history, laid out by batch and by a bucket of the
table's name, and reads back the buckets of its own tables alone. The changes of those
tables are found with and without the new snapshots; what differs goes to a log of changes
as corrections: a change that now holds is asserted (+1), one that no longer holds, because a
late snapshot came between, is retracted (-1). Reading a log settles it: what is asserted
more often than retracted holds, so the changes are those of the whole history in whatever
order files came, and a run writes in proportion to what it changes.

Below the log's path are ``history/batch=<id>/bucket=<b>``, ``changes/batch=<id>`` and, where
asked for, ``outcomes/version=<id>``. A batch replaces its own folders only and reads none
of its own or later ones, so a repeated one changes nothing. One batch at a time writes a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import drift
from faultline.operators.ordering import previous_within
from faultline.plans.watch import log_entries
from faultline.session import stage
from faultline.sources import files, schemas

# Buckets of tables; a batch lists those it touches, so this also bounds that list.
BUCKETS = 256

_COLUMNS = "array<struct<name:string,type:string>>"
_SNAPSHOT = f"platform string, schema_name string, table_name string, captured_at timestamp, columns {_COLUMNS}"
_HISTORY = f"{_SNAPSHOT}, late boolean, batch bigint, bucket int"
_CHANGES = (
    "platform string, schema_name string, table_name string, captured_at timestamp, seq int, change_type string,"
    " old_column string, new_column string, evidence string, brought_by bigint, op bigint, batch bigint"
)
_AT = [*drift.KEY, "captured_at"]
_CHANGE = [*_AT, "seq", "change_type", "old_column", "new_column", "evidence", "brought_by"]


def snapshot_stream(
    spark: SparkSession, path: str, bytes_per_batch: int = 1 << 30, files_per_batch: int | None = None
) -> DataFrame:
    """Usable snapshots as they arrive; a micro-batch is bounded by bytes, or by files where told."""
    reader = spark.readStream.schema(schemas.SNAPSHOT)
    if files_per_batch is None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).dropna(subset=[*_AT, "columns"])


def _one_per_time(snapshots: DataFrame, keys: list[str], *aggregates) -> DataFrame:
    """Snapshots of one table and time are one, with the columns of all of them."""
    together = F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("columns")
    return snapshots.groupBy(*keys).agg(together, *aggregates)


def _corrections(held: DataFrame, rows: DataFrame) -> DataFrame:
    """Changes that ``rows`` make hold (op 1) or no longer hold (op -1) beside those of ``held``.

    Both histories are paired in one pass, told apart by ``_side``.
    """
    before, after = held.withColumn("_side", F.lit(-1)), held.unionByName(rows).withColumn("_side", F.lit(1))
    both = _one_per_time(before.unionByName(after), [*_AT, "_side"], F.min("batch").alias("brought_by"))
    pairs = previous_within(both, [*drift.KEY, "_side"], "captured_at", "columns", "previous_columns")
    changes = drift.explode_changes(pairs, "brought_by", "_side")
    return changes.groupBy(*_CHANGE).agg(F.sum("_side").alias("op")).filter("op <> 0")


def _add_batch(path: str, outcomes: bool = False):
    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*drift.KEY), F.lit(BUCKETS)).cast("int")
        rows = stage(_one_per_time(batch, _AT).withColumn("bucket", bucket), "snapshots")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        if batch_id:
            history = spark.read.schema(_HISTORY).parquet(f"{path}/history").filter(F.col("batch") < batch_id)
        else:
            history = spark.createDataFrame([], _HISTORY)
        held = history.filter(F.col("bucket").isin(touched)).join(
            rows.select(*drift.KEY).distinct(), list(drift.KEY), "left_semi"
        ).select(*_AT, "columns", "batch")
        newest = held.groupBy(*drift.KEY).agg(F.max("captured_at").alias("held_at"))
        late = F.coalesce(F.col("captured_at") <= F.col("held_at"), F.lit(False)).alias("late")
        rows.join(newest, list(drift.KEY), "left").select(*_AT, "columns", late, "bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{path}/history/batch={batch_id}")

        new = rows.select(*_AT, "columns", F.lit(batch_id).cast("long").alias("batch"))
        found = stage(_corrections(held, new), "corrections")
        if outcomes:
            entries = log_entries(found.withColumnRenamed("brought_by", "batch"))
            files.write_json(entries, f"{path}/outcomes/version={batch_id}", mode="overwrite")
        found.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    return add


def drift_stream(snapshots: DataFrame, path: str, checkpoint: str, outcomes: bool = False) -> None:
    """Add everything that is available to the logs at ``path``, then stop."""
    query = (
        snapshots.writeStream.foreachBatch(_add_batch(path, outcomes))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _settled(log: DataFrame, columns: list[str]) -> DataFrame:
    """What a log of corrections comes to: rows asserted more often than retracted."""
    return log.groupBy(*columns).agg(F.sum("op").alias("_n")).filter("_n > 0").drop("_n")


def read_changes(spark: SparkSession, path: str, *carried: str) -> DataFrame:
    """The changes of all snapshots in the log, those the batch comparison of them gives.

    ``carried`` may name ``batch``, the first that brought the snapshot.
    """
    log = spark.read.schema(_CHANGES).parquet(f"{path}/changes")
    found = _settled(log, _CHANGE).withColumnRenamed("brought_by", "batch")
    return found.select(*_AT, *carried, "seq", "change_type", "old_column", "new_column", "evidence")


def late_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots that came when one of their table as new or newer was already held."""
    return spark.read.schema(_HISTORY).parquet(f"{path}/history").filter("late").select(*_AT, "batch")


def outcome_stream(snapshots: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what is available; log every detected change with whether it triggers an assessment.

    Each batch adds entries for what it changed and nothing else: a late snapshot retracts
    the entries that no longer hold and asserts those that do.
    """
    drift_stream(snapshots, path, checkpoint, outcomes=True)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcome log of a stream, settled, in the order of batches; empty if nothing was logged."""
    log = files.read_outcomes(spark, f"{path}/outcomes", schemas.WATCH_CORRECTION)
    entries = log.drop("version").columns
    return _settled(log, [c for c in entries if c != "op"]).orderBy("batch", "seq")
