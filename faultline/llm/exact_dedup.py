"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a run: its texts' digests, equal ones merged. In each
round ``fan_in`` neighbouring runs exchange and merge theirs: one row per digest
and merged run, with the identifier that stays and the number of texts so far. The
aggregates carry a struct, so both sides of each exchange are sorted runs merged
by Spark's sort aggregation. After log(runs) rounds one run is left, dealt over
all tasks by digest. The answers go down the tree the same way. However many
copies a text has, no merge sees more than ``fan_in`` rows of it above the first
level, and no join key more rows than ``fan_in`` partitions hold.

A digest only counts as equal if text length and a second, unrelated hash agree
too, at every level.

Defined results: null text is the empty text; a null doc_id ranks below all
others and may stay only if all are null; of rows that repeat id and text one
stays; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import fresh, query, table, texts
from faultline.session import stage

FAN_IN = 16
_KEY = ["digest", "n_bytes", "check"]
_RUN_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _digest_columns(text: Column) -> list[Column]:
    return [
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    ]


def digest_runs(docs: DataFrame) -> DataFrame:
    """One small row per document, written once; the texts are not read again."""
    rows = texts(docs).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), *_digest_columns(F.col("text"))
    )
    return stage(rows, "digest_runs").withColumn("run", F.shiftright("row", _RUN_BITS))


def _merge_up(runs: DataFrame, fan_in: int, keep: str) -> list[DataFrame]:
    """The levels of the tree, the last with one row per distinct text."""
    pick = F.max if keep == "largest" else F.min
    # Nulls sort first in both directions of a struct; the flag puts them last for "smallest".
    best = F.struct(F.col("doc_id").isNull().alias("none") if keep == "smallest" else F.col("doc_id").isNotNull().alias("some"),
                    "doc_id", "row")
    level = runs.select("run", *_KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))
    width = (runs.agg(F.max("run")).first()[0] or 0) + 1
    levels = []
    while width > 1 or not levels:
        width = -(-width // fan_in)
        merged = level.withColumn("run", F.expr(f"run div {fan_in}")).groupBy("run", *_KEY)
        level = stage(merged.agg(pick("best").alias("best"), F.sum("n").alias("n")), "merged_runs")
        levels.append(level)
    return levels


def exact_groups(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: keep_id, group_size, kept and the digest of its text."""
    runs = digest_runs(docs)
    levels = _merge_up(runs, fan_in, keep)
    answer = levels[-1]
    up = F.expr(f"run div {fan_in}")
    for level in [*levels[-2::-1], runs]:
        parent = answer.select(F.col("run").alias("up"), *_KEY, "best", "n")
        keyed = level.select(*([c for c in level.columns if c not in ("best", "n")]), up.alias("up"))
        answer = keyed.join(parent, ["up", *_KEY])
    return answer.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with one row of every distinct text, all columns as they were.

    Rows are found again by id and text together; of rows that repeat both, and
    differ at most in other columns, one is taken.
    """
    key, staying = fresh(docs, "_key"), fresh(docs, "_staying")

    def named(doc_id: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)

    top = _merge_up(digest_runs(docs), fan_in, keep)[-1]
    kept = top.select(named(F.col("best.doc_id"), F.lower(F.hex("digest"))).alias(staying))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(key, named(F.col("doc_id"), F.sha2(text, 256)))
    found = keyed.join(kept, F.col(key) == F.col(staying), "left_semi")
    return found.dropDuplicates([key]).drop(key)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op2_exact_dedup", ORACLE)
def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
