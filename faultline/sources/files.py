"""Readers and writers for the files around the engine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources import schemas

_CORRUPT = "_corrupt"
# How files with a row per (change, asset) are packed: their texts repeat from row to row.
# Readers know the codec by the file's suffix.
PACKED = "lz4"


def full_refresh(spark: SparkSession, csv_path: str, table_path: str, schema: str) -> int:
    """Replace the table at ``table_path`` by a typed CSV with header; the row count."""
    rows = spark.read.schema(schema).options(header=True, mode="FAILFAST", escape='"').csv(csv_path)
    rows.write.mode("overwrite").parquet(table_path)
    return spark.read.schema(schema).parquet(table_path).count()


def model_texts(spark: SparkSession, directory: str, column: str) -> DataFrame:
    """Every ``.sql`` file below a directory, one row each, keyed by relative path."""
    root = directory.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql")
    rows = files.text(root, wholetext=True)
    below = F.concat(F.lit(r"^.*\Q"), F.lit(f"{root}/"), F.lit(r"\E"))
    relative = F.regexp_replace(F.col("_metadata.file_path"), below, F.lit(""))
    return rows.select(relative.alias("path"), F.col("value").alias(column))


def model_corpus(sources: DataFrame, compiled: DataFrame) -> DataFrame:
    """Source and compiled text per model path; either may be missing."""
    return sources.select("path", "source_text").join(compiled.select("path", "compiled_text"), "path", "full_outer")


def lineage_hits(payloads: DataFrame, direction: str = "downstreams") -> DataFrame:
    """Nested lineage responses as one row per (change, entity, degree)."""
    hits = payloads.select("change_id", F.explode(F.col(direction)["searchResults"]).alias("hit"))
    return hits.select("change_id", F.col("hit.entity").alias("entity"), F.col("hit.degree").alias("degree"))


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LINEAGE).json(path)


def lineage_datasets(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("entity.type") == "DATASET")


def lineage_dashboards(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("entity.type") == "DASHBOARD")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CALL).json(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ATTEMPT).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """One JSON object per row, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path, compression=compression)


def write_lineage(responses: DataFrame, path: str) -> None:
    """Lineage responses as JSON rows; :func:`read_lineage` reads them."""
    write_json(responses, path, compression=PACKED)


def snapshot_key(platform: Column, schema_name: Column, table_name: Column) -> Column:
    """Identity of a table's snapshots; a table name alone is never one."""
    return F.concat_ws("-", platform, schema_name, table_name)


def save_snapshots(snapshots: DataFrame, path: str) -> None:
    write_json(snapshots.select("platform", "schema_name", "table_name", "columns", "captured_at"), path)


def _is_missing(error: AnalysisException) -> bool:
    """Whether nothing was ever written there; any other error is one."""
    return error.getCondition() == "PATH_NOT_FOUND"


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Usable snapshots below ``path``; missing files, corrupt rows and rows without a
    required field yield no baseline rather than an error."""
    schema = f"{schemas.SNAPSHOT}, {_CORRUPT} STRING"
    try:
        rows = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT).json(path)
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return spark.createDataFrame([], schemas.SNAPSHOT)
    complete = F.col(_CORRUPT).isNull()
    for name in ("platform", "schema_name", "table_name", "columns", "captured_at"):
        complete = complete & F.col(name).isNotNull()
    return rows.filter(complete).drop(_CORRUPT)


def append_outcomes(outcomes: DataFrame, path: str) -> None:
    """Append to the outcome log; ``batch`` and ``seq`` carry the order files do not have."""
    write_json(outcomes, path, mode="append")


def read_outcomes(spark: SparkSession, path: str, schema: str = schemas.WATCH_OUTCOME) -> DataFrame:
    """The log in the order it was appended; empty if nothing was ever logged."""
    try:
        rows = spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return spark.createDataFrame([], schema)
    return rows.orderBy("batch", "seq")


def write_golden(records: DataFrame, path: str) -> None:
    """One JSON file per golden table, under its name."""
    records.repartition("table_name").write.mode("overwrite").partitionBy("table_name").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    schema = "row_count BIGINT, columns ARRAY<STRING>, checksum STRING, table_name STRING"
    return spark.read.schema(schema).json(path).select("table_name", "row_count", "columns", "checksum")


def export_assessment(summary: DataFrame, assessment: DataFrame, path: str) -> None:
    """Headers and assets as JSON rows, ordered by change inside each file.

    A change can touch any number of assets, so an export is one header object per
    change plus one object per asset that names its change, not one object that
    has to hold them all.
    """
    write_json(summary, f"{path}/changes", mode="overwrite")
    rows = assessment.repartitionByRange("change_id", "node").sortWithinPartitions("change_id", "node")
    write_json(rows, f"{path}/assets", mode="overwrite", compression=PACKED)


def export_narratives(narratives: DataFrame, safe: DataFrame, path: str) -> None:
    rows = narratives.repartitionByRange("change_id", "node").sortWithinPartitions("change_id", "node")
    write_json(rows, f"{path}/narratives", mode="overwrite", compression=PACKED)
    write_json(safe, f"{path}/safe", mode="overwrite", compression=PACKED)
