"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words, and a weight schedule over training
progress 0 to 1. The integral of the schedule says how many of the source's words
have been asked for at any progress; inverting it gives the progress at which a
document's first word falls due. Documents are range-sorted by that position.

Inside a source documents follow a fixed pseudo-random order. The mix reads that
order from its start, again and again, until the target is met: whole passes, then
a part of one, whose last document is cut.

Running sums are taken per (source, range of the order), with offsets from one row
per range, so a source that holds a third of the rows is spread over all tasks.

Defined results: null text has size 0; a null source is a source of its own, last
in order; null ids share one place in the order; a document of size 0, and any of
a source without words, is taken 0 words; repeated rows count as rows of their
own; an empty table gives an empty one. Other columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import query, table, word_count
from faultline.session import stage

MAX_EPOCHS = 3
# Weights and (start, end) of the linear schedules, dealt to sources in order.
WEIGHTS = (1, 2, 3)
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
# Hex digits of the order key that make a range: 4,096 ranges of each source.
RANGE_DIGITS = 3

_SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def _pick(index: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        word_count(F.coalesce("text", F.lit(""))).alias("size"),
        F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 256), 1, 16).alias("place"),
        F.struct("*").alias("doc"),
    ).withColumn("range", F.substring("place", 1, RANGE_DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target; one row per source.

    Sources fill up in the order of the level at which they reach their cap. The
    first that need not be capped fixes the level of all after it. Sums are exact.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("index", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", _pick(F.col("index"), weights))
    scale = 1
    for w in weights:
        scale *= w
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = ranked.withColumn("level", F.expr(f"(cast(source_size as decimal(38,0)) * {max_epochs * scale}) div weight"))
    filling = Window.orderBy("level", "index")
    below, here_on = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("left", F.sum("source_size").over(everything)
                          - F.coalesce(F.sum(F.col("source_size") * max_epochs).over(below), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(here_on))
        .withColumn("step", F.row_number().over(filling))
    )
    fits = wide("left") * wide("weight") <= wide("source_size") * max_epochs * wide("sharing")
    first = F.min(F.when(fits, F.struct("step", "left", "sharing"))).over(everything)
    ranked = ranked.withColumn("fixed", first)
    return ranked.select(
        "source", "source_size", "index",
        F.when(F.col("step") < F.col("fixed.step"), (F.col("source_size") * max_epochs).cast("double"))
        .otherwise((F.col("fixed.left") * F.col("weight")).cast("double") / F.col("fixed.sharing"))
        .alias("target"),
    )


def assign(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Words taken of every row, and where in its source's demand they start.

    ``rows`` has source, size, place, range, doc_id; ``sizes`` the same without
    payload, for the sums.
    """
    per_range = sizes.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    per_range = stage(per_range, "range_sizes")
    targets = source_targets(per_range.groupBy("source").agg(F.sum("in_range").alias("source_size")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.withColumn("offset", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    offsets = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select(
        F.col("o.source").alias("o_source"), F.col("range").alias("o_range"), "offset", "source_size", "index", "target",
        F.floor(F.col("target") + 0.5).cast("long").alias("words"),
    )
    offsets = offsets.select(
        "*", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).alias("epochs")
    )
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size")
    running = rows.withColumn(
        "inside", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = running.join(offsets, F.expr("source <=> o_source and range = o_range")).drop("o_source", "o_range")
    start = F.col("offset") + F.col("inside")
    part = F.col("words") - F.col("epochs") * F.col("source_size")
    return (
        joined.withColumn("start", start)
        .withColumn("part", F.least("size", F.greatest(F.lit(0), part - F.col("start"))))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    )


def position(demand: Column, words: Column, index: Column, schedules=SCHEDULES) -> Column:
    """Progress at which a source has been asked for ``demand`` of its ``words``.

    For a schedule from a to b the share asked for by progress x is the integral
    (a x + (b - a) x^2 / 2) / ((a + b) / 2), solved here for x in the form that
    stays exact when a = b.
    """
    a, b = _pick(index, tuple(s[0] for s in schedules)), _pick(index, tuple(s[1] for s in schedules))
    share = demand.cast("double") / words.cast("double")
    return (a + b) * share / (a + F.sqrt(a * a + (b * b - a * a) * share))


def training_order(docs: DataFrame) -> DataFrame:
    """Every copy the mix takes of every document, in order of training position.

    Returns ``doc`` (the row as it was), ``copy``, ``words`` it takes and
    ``position``. All copies but a source's last are whole.
    """
    sizes = _rows(docs).drop("doc", "doc_id", "place")
    rows = assign(_rows(docs), sizes).filter(F.col("taken") > 0)
    last = F.col("epochs") - F.when(F.col("part") > 0, 0).otherwise(1)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    copies = copies.select(
        "doc", "copy",
        F.when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(F.col("part")).alias("words"),
        position(F.col("copy") * F.col("source_size") + F.col("start"), F.col("words"), F.col("index")).alias("position"),
    )
    return copies.repartitionByRange("position", "doc.doc_id", "copy").sortWithinPartitions("position", "doc.doc_id", "copy")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents in training order, with the columns of ``docs``; a cut copy keeps its first words."""
    size = word_count(F.col("doc.text"))
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(_SPACED_WORD), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < size, first).otherwise(F.col("doc.text"))
    copies = training_order(docs)
    return copies.select(*[
        (text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns
    ])


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: words taken and first position, in training order."""
    rows = stage(_rows(docs).drop("doc"), "mix_sizes")
    taken = assign(rows, rows)
    first = F.when(F.col("taken") > 0, position(F.col("start"), F.col("words"), F.col("index")))
    report = taken.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return report.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, 'null'))[:16] AS place FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, 1 + i % 3 AS weight FROM s),
r AS (
  SELECT *, row_number() OVER f AS step,
         sum(n) OVER () - coalesce(sum(3 * n) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM w WINDOW f AS (ORDER BY n * 18 // weight, i)),
fixed AS (
  SELECT step, left_over, sharing FROM r WHERE left_over * weight <= 3 * n * sharing ORDER BY step LIMIT 1),
t AS (
  SELECT r.source, r.n, r.i, CASE WHEN r.step < f.step THEN (3 * r.n)::DOUBLE
         ELSE (f.left_over * r.weight)::DOUBLE / f.sharing::DOUBLE END AS target
  FROM r, fixed f),
g AS (
  SELECT d.*, t.n, t.i, t.target, floor(t.target + 0.5)::BIGINT AS words,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN n > 0 THEN words // n ELSE 0 END AS epochs FROM g),
k AS (
  SELECT *, (epochs * size + least(size, greatest(0, words - epochs * n - start)))::BIGINT AS taken,
         start::DOUBLE / words::DOUBLE AS share,
         CASE i % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 1.5::DOUBLE END AS a,
         CASE i % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS b
  FROM e)
SELECT doc_id, size, n::BIGINT AS source_size, target, taken,
       CASE WHEN taken > 0 THEN (a + b) * share / (a + sqrt(a * a + (b * b - a * a) * share)) END AS position
FROM k
"""


@query("op3_curriculum_mix", ORACLE)
def op3_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
