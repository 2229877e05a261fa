"""Sharding by vector bin packing.

Documents with equal texts are a group, a vector of bytes, tokens and rows. Groups
are placed largest first; each goes to the shard where the dot product of its vector
with the shard's residual capacity is highest.

Placing is sequential, so it runs on a bounded number of items: groups that hold more
than one part in ``CELLS`` of any total are items of their own, at most three times
``CELLS`` of them; all others are gathered by hash into ``CELLS`` cells. A group
that is more than one shard's capacity of anything cannot be placed whole: it is cut
into pieces of at most half of one, by a hash of the row. Items carry exact sums,
aggregated before they are shuffled, and every row is placed by looking its item up.

Law: ``bytes``. Defined results: null text is the empty text (16 bytes of overhead);
null ids are sharded like others; repeated rows are rows of their own; slots number
a shard's rows from 0 in the order of a hash of the row number; an empty table gives an
empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import query, table, texts, word_count
from faultline.session import stage

SHARDS = 40
ROW_BYTES = 16
CELLS = 8192
# Ranges of slots per shard; each is numbered on its own.
SLOT_RANGES = 256

_KINDS = ["size", "tokens", "rows"]


def place_items(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every item, by largest dot product with the residual capacity.

    ``vectors`` holds shares of the totals. Capacity is one shard's even share of
    each, counted as 1; residuals may go below zero, so everything is placed. Bytes lead the
    order and, between shards that are equally good, the least filled takes the item.
    """
    load = vectors * shards
    residual = np.ones((shards, load.shape[1]))
    placed = np.zeros(len(load), np.int32)
    for i in np.lexsort((np.arange(len(load)), -load.sum(axis=1), -load[:, 0])):
        shard = int(np.argmax(residual @ load[i]))
        placed[i] = shard
        residual[shard] -= load[i]
    return placed


def _documents(docs: DataFrame) -> DataFrame:
    rows = texts(docs).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"),
        word_count(F.col("text")).alias("tokens"),
        F.crc32("text").alias("text_crc32"),
    )
    return stage(rows, "shard_rows")


def pack(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """One row per document with its shard; not yet numbered."""
    rows = _documents(docs)
    spark = rows.sparkSession
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = stage(rows.groupBy("digest").agg(*sums), "shard_groups")
    total = groups.agg(*[F.sum(c).alias(c) for c in _KINDS]).first()
    total = {c: max(1, total[c] or 0) for c in _KINDS}

    share = F.greatest(*[F.col(c) / total[c] for c in _KINDS])
    pieces = F.when(share * shards > 1, F.ceil(share * shards * 2)).otherwise(1).cast("int")
    # More than one part in ``cells`` of a total: there cannot be more than 3 * cells of these.
    own = groups.filter(share > 1 / cells).select("digest", pieces.alias("pieces"))
    own = stage(own, "shard_own")
    cell = F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int")
    piece = F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1))).cast("int")
    known = rows.join(F.broadcast(own), "digest", "left")
    known = known.withColumn("cell", F.when(F.col("pieces").isNull(), cell).otherwise(-1))
    known = known.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(piece))
    known = known.withColumn("group", F.when(F.col("pieces").isNotNull(), F.col("digest")))
    items = known.groupBy("cell", "group", "piece").agg(*sums).orderBy("cell", "group", "piece")

    found = items.toPandas()  # at most cells, plus 3 * cells groups and 6 * shards pieces
    vectors = np.column_stack([found[c].to_numpy(float) / total[c] for c in _KINDS]) if len(found) else np.zeros((0, 3))
    found["shard"] = place_items(vectors, shards)
    placed = spark.createDataFrame(
        [(int(c), None if g is None else bytes(g), int(p), int(s))
         for c, g, p, s in found[["cell", "group", "piece", "shard"]].itertuples(index=False)],
        "cell int, group binary, piece int, shard int",
    )
    by_cell = placed.filter("cell >= 0").select("cell", F.col("shard").alias("cell_shard"))
    by_group = placed.filter("cell < 0").select("group", "piece", F.col("shard").alias("group_shard"))
    put = known.join(F.broadcast(by_cell), "cell", "left").join(F.broadcast(by_group), ["group", "piece"], "left")
    return put.select("doc_id", "row", "size", "text_crc32", F.coalesce("cell_shard", "group_shard").alias("shard"))


def number_slots(put: DataFrame, ranges: int = SLOT_RANGES) -> DataFrame:
    """``slot``: a gapless number from 0 within each shard, by ranges of a hash of the row."""
    put = put.withColumn("place", F.xxhash64("row")).withColumn("part", F.pmod(F.shiftright("place", 32), F.lit(ranges)).cast("int"))
    put = stage(put, "placed_rows")
    counts = put.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("place", "row")
    numbered = put.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["shard", "part"])
    return numbered.withColumn("slot", (F.col("offset") + F.col("inside")).cast("long")).drop("place", "part", "inside", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    return number_slots(pack(docs, shards, cells)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_vector_packing")
def op7_vector_packing(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
