"""Document fingerprints from closed syncmers.

A text is read as short tokens: runs of up to ``TOKEN_CHARS`` characters between
white space, counted from the start of each word, so an edit shifts no token beyond
its word. Of the k-mers of tokens those are chosen whose minimal inner s-mer (by
hash) is the first or the last: closed syncmers. The choice looks at nothing outside
the k-mer, so an unchanged passage gives the same anchors wherever it stands, and at
least one in every k - s consecutive k-mers.

``anchors`` has all of them with their positions. The fingerprint is the sketch of the
distinct anchors: the ``SKETCH`` smallest of their 32-bit hashes, which estimates the
shared part of two anchor sets of any size; smaller sets are held whole.

Defined results: null text is the empty text; a text too short for an anchor, or
without one, has its whole token sequence as anchor, so equal texts always have equal
fingerprints; documents are ordered by doc_id, null first, then by a hash of the
text, and repeated rows follow each other; one document is its own next; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import query, table, texts
from faultline.session import stage

TOKEN_CHARS = 4
K, S = 5, 2
SKETCH = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S, token_chars: int = TOKEN_CHARS) -> Column:
    """array<struct<at, hash>>: position (in tokens) and hash of every closed syncmer."""
    tokens = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{token_chars}}}"), F.lit(0))

    def chosen(h: Column, g: Column) -> Column:
        places = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k)).otherwise(F.array().cast("array<int>"))

        def at_edge(i: Column) -> Column:
            inner = [F.get(g, i + j) for j in range(1, k - s)]
            edge = F.least(F.get(g, i), F.get(g, i + (k - s)))
            return edge <= (F.least(*inner) if len(inner) > 1 else inner[0]) if inner else F.lit(True)

        return F.transform(
            F.filter(places, at_edge),
            lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")),
        )

    def inner_hashes(h: Column) -> Column:
        places = F.when(F.size(h) >= s, F.sequence(F.lit(0), F.size(h) - s)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))

    def whole(h: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))

    return _let(
        F.transform(tokens, lambda t: F.xxhash64(t)),
        lambda h: _let(
            _let(inner_hashes(h), lambda g: chosen(h, g)),
            lambda found: F.when(F.size(found) > 0, found).otherwise(whole(h)),
        ),
    )


def sketch(text: Column, size: int = SKETCH) -> Column:
    """The smallest distinct 32-bit anchor hashes, ascending."""
    low = F.transform(anchors(text), lambda a: a["hash"].bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.slice(F.array_sort(F.array_distinct(low)), 1, size)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Shared part of the two anchor sets: of the smallest hashes of either, those that both have."""
    smallest = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return _let(smallest, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def _id_ranges(rows: DataFrame) -> Column:
    """The number of a row's range of ids; ranges hold about as many rows each.

    Their bounds are quantiles over all ids, looked up in two steps. There are four
    ranges for each shuffle partition.
    """
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, 10 * n).alias("cuts")).first()["cuts"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def longs(values: list) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    def reached(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col("doc_id")))

    coarse = F.greatest(reached(longs([g[0] for g in groups])), F.lit(1))
    fine = reached(F.element_at(F.array(*[longs(g) for g in groups]), coarse))
    return F.coalesce((coarse - 1) * step + fine, F.lit(0))


def with_next(rows: DataFrame, own: Column) -> DataFrame:
    """``rows`` (doc_id, check, text) with ``own``, and ``next_text`` and ``next_own`` of the following document.

    Documents are numbered within ranges of ids. The first document of a range is
    also put at the end of the range before it, so that no range needs another.
    """
    rows = rows.withColumn("range", _id_ranges(rows)).withColumn("beyond", F.lit(0))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("check").cast("string"))
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "check")).alias("first"))
    firsts = stage(firsts.select("range", "first.*"), "range_firsts")  # one row per range
    by_range = Window.orderBy("range")
    around = firsts.select(
        F.col("range").alias("home"), key.alias("first_key"),
        F.coalesce(
            F.lag("range").over(by_range), F.max("range").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ).alias("goes_to"),
    )
    heads = rows.join(F.broadcast(around), (F.col("range") == F.col("home")) & (key == F.col("first_key")))
    heads = heads.withColumn("range", F.col("goes_to")).withColumn("beyond", F.lit(1)).select(rows.columns)
    order = Window.partitionBy("range").orderBy("beyond", "doc_id", "check")
    ahead = rows.union(heads).withColumn("own", own)
    for c in ("text", "own"):
        ahead = ahead.withColumn(f"next_{c}", F.lead(c).over(order))
    return ahead.filter(F.col("beyond") == 0).drop("range", "beyond")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of it and its edited text, and their likenesses."""
    rows = texts(docs).withColumn("check", F.xxhash64("text"))
    rows = with_next(rows, sketch(F.col("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    edits = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    done = edits.withColumn("edited_own", sketch(F.col("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


@query("op5_closed_syncmers")
def op5_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
