"""Session settings and the shared folder that intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions and splits skewed join partitions; the
# session zone is pinned so that timestamps mean the same on every executor.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parquet unpacks to several times its file size; broadcasts are judged by that.
    "spark.sql.sources.fileCompressionFactor": "5.0",
    # A join whose partitions turn out small at run time hashes them instead of sorting.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Bucketed writes keep a few files open rather than sort their rows by bucket first.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites of every column expression cost more driver time than small plans do.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. A local session without that
    setting gets a fresh temporary folder; on a cluster the missing setting is an
    error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="faultline-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root


# One folder for everything this process stages, so that it can be removed as a whole.
_RUN = f"run-{uuid.uuid4().hex}"


def run_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{_RUN}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove what this process has staged. Results still to be read must be written elsewhere first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{_RUN}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, cluster_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with data that outlives executors, and the read side
    knows its true size, so Catalyst broadcasts it only when it is under
    ``spark.sql.autoBroadcastJoinThreshold``. With ``cluster_by`` the table is
    bucketed and later equi-joins on those columns read it without a shuffle.
    ``compression`` names a codec for files of long texts.
    """
    spark = df.sparkSession
    path = run_path(spark, name)
    if not cluster_by:
        df.write.parquet(path, compression=compression)
        return spark.read.schema(df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *cluster_by)
        .write.bucketBy(buckets, *cluster_by)
        .sortBy(*cluster_by)
        .option("path", path)
        .saveAsTable(table)
    )
    return spark.table(table)


def stage_in_buckets(df: DataFrame, name: str, key: str, buckets: int, compression: str) -> DataFrame:
    """Like :func:`stage`, bucketed by ``key`` by the tasks that have the rows: none moves.

    Each task writes a file per bucket, so ``buckets`` is best kept small.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).option("path", run_path(df.sparkSession, name))
    writer.option("compression", compression).saveAsTable(table)
    return df.sparkSession.table(table)


def stage_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage independent tables at the same time, so one's last tasks overlap the next."""
    with ThreadPoolExecutor(len(frames)) as pool:
        running = {name: pool.submit(stage, df, name) for name, df in frames.items()}
        return {name: job.result() for name, job in running.items()}
