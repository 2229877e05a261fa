"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are cut into blocks, more than the distance allowed, so that two
linked ones agree on all but ``max_bits`` of the blocks. For each choice of agreeing blocks
a view of the fingerprints puts these in front. The trie of a view is joined with
itself: node pairs are traversed together from the node of the agreeing blocks
down, a bit at a time; a pair adds the bit if its sides differ there, and is
dropped once it has more than the distance allowed.

The node pairs of a view are dealt over the tasks. A node with more than
``NODE_LIMIT`` fingerprints is first split into the pairs of its children, eight
bits down, that are within the distance, again and again; so a task holds bounded
nodes at a time, and no pair is lost. Only distinct fingerprints are joined, however
many documents share one. Of the links in a node pair a task returns a spanning
forest of at most one link per fingerprint, never all pairs.

Defined results: null text is the empty text; a text without words has
fingerprint zero, which is linked like any other; a null doc_id is larger than all others;
repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import fresh, query, table, texts
from faultline.llm.components import component_roots
from faultline.session import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
NODE_LIMIT = 20_000
SPLIT_BITS = 8
_ROWS_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 20
# A view is cut finer than four blocks when its nodes would hold more than this on average.
_NODE_AIM = 4_000


def simhash(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a whole text, unsigned."""
    import xxhash

    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = shingle_words
    shingles = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        block = hashes[at : at + _ROWS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and check, a hash of the text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_py(), shingle_words) for t in batch.column(1)]
            signed = pa.array(np.array(fps, np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, batch.column(2)], ["doc_id", "fp", "check"])

    rows = texts(docs).withColumn("check", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(hashed, f"doc_id {id_type}, fp long, check long"), "fingerprints")


def _views(n: int, max_bits: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Per view: the blocks as (low bit, width), the agreeing ones first, and the bits these have."""
    blocks = max_bits + 1
    while blocks < 2 * max_bits and n >> (64 * (blocks - max_bits) // blocks) > _NODE_AIM:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    out = []
    for same in combinations(range(blocks), blocks - max_bits):
        order = [parts[i] for i in same] + [parts[i] for i in range(blocks) if i not in same]
        out.append((order, sum(parts[i][1] for i in same)))
    return out


def _permuted(fp: Column, order: list[tuple[int, int]]) -> Column:
    out, high = F.lit(0).cast("long"), 64
    for low, width in order:
        high -= width
        bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bits, high))
    return out


def _root_pairs(fps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Node pairs as rows: view, node pair (a, b), the side a fingerprint is on, depth and bits used."""
    views = _views(n, max_bits)
    per_view = F.array(*[
        F.struct(
            F.lit(k).alias("view"), _permuted(F.col("fp"), order).alias("bits"), F.lit(same).alias("depth"),
        )
        for k, (order, same) in enumerate(views)
    ])
    rows = fps.select("fp", F.explode(per_view).alias("v")).select("fp", "v.*")
    node = F.expr("shiftrightunsigned(bits, 64 - depth)")
    return rows.select(
        "view", node.alias("a"), node.alias("b"), F.lit(0).alias("side"), "depth", F.lit(0).alias("used"), "bits", "fp")


_PAIR = ["view", "depth", "a", "b", "used"]


def _split(rows: DataFrame, max_bits: int) -> DataFrame:
    """Large node pairs as the pairs of their children within the distance.

    A member of child c joins the pairs with every other child at most the remaining
    distance away; of a node's pair with itself only the half with c <= c'.
    """
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= max_bits]
    child = F.expr(f"shiftrightunsigned(bits, 64 - depth - {SPLIT_BITS})")
    grown = rows.withColumn("own", child).withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    grown = grown.withColumn("used", F.col("used") + F.bit_count("mask").cast("int")).filter(F.col("used") <= max_bits)
    # The other child is below the other node of the pair: a node's side 0 meets children of b.
    base = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    other = F.shiftleft(base, SPLIT_BITS).bitwiseOR(
        F.col("own").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1).cast("long")).bitwiseXOR(F.col("mask").cast("long")))
    grown = grown.withColumn("other", other)
    alone = F.col("a") == F.col("b")
    first = F.when(alone, F.col("own") <= F.col("other")).otherwise(F.col("side") == 0)
    return grown.select(
        "view",
        F.when(first, F.col("own")).otherwise(F.col("other")).alias("a"),
        F.when(first, F.col("other")).otherwise(F.col("own")).alias("b"),
        F.when(first, 0).otherwise(1).alias("side"),
        (F.col("depth") + SPLIT_BITS).alias("depth"), "used", "bits", "fp",
    )


def _bounded_pairs(rows: DataFrame, max_bits: int, node_limit: int) -> list[DataFrame]:
    """Tables of node pairs of at most ``node_limit`` fingerprints, or without bits left to split at."""
    done = []
    while True:
        sizes = rows.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n"))
        large = stage(
            sizes.filter((F.col("n") > node_limit) & (F.col("depth") <= 64 - SPLIT_BITS)).select(*_PAIR), "large_nodes")
        if large.isEmpty():
            return [*done, rows]
        done.append(rows.join(large, _PAIR, "left_anti"))
        rows = stage(_split(rows.join(large, _PAIR, "left_semi"), max_bits), "split_nodes")


def trie_join(bits: np.ndarray, roots: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of fingerprints within the distance, by traversing node pairs.

    ``bits`` is sorted inside each node. A row of ``roots`` is a node pair: start and
    end of the one node, of the other (the same for a node with itself), depth, bits used.
    """
    ones: dict[int, np.ndarray] = {}
    stack = []
    for depth in np.unique(roots[:, 4]):
        ready = roots[roots[:, 4] == depth][:, [0, 1, 2, 3, 5]]
        stack.append((int(depth), ready))
    while stack:
        depth, pairs = stack.pop()
        if not len(pairs):
            continue
        if len(pairs) > _PAIRS_AT_ONCE:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        if depth == 64:
            # Leaves: every fingerprint is there once, so a leaf pair is one link or a node with itself.
            links = pairs[pairs[:, 0] != pairs[:, 2]]
            if len(links):
                yield links[:, 0], links[:, 2]
            continue
        count = ones.get(depth)
        if count is None:
            set_bits = (bits >> np.uint64(63 - depth)) & np.uint64(1)
            count = ones[depth] = np.concatenate([[0], np.cumsum(set_bits, dtype=np.int64)])
        a0, a1, b0, b1, used = pairs.T
        a_mid, b_mid = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0
        below = [
            np.column_stack([a0, a_mid, b0, b_mid, used]),
            np.column_stack([a_mid, a1, b_mid, b1, used]),
            np.column_stack([a0, a_mid, b_mid, b1, used + 1]),
            np.column_stack([a_mid, a1, b0, b_mid, used + 1])[~same],
        ]
        children = np.concatenate(below)
        a0, a1, b0, b1, used = children.T
        alive = (a1 > a0) & (b1 > b0) & (used <= max_bits)
        # A node with itself needs a second fingerprint.
        alive &= (a0 != b0) | (a1 - a0 > 1)
        stack.append((depth + 1, children[alive]))


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position each of ``n`` positions is linked to, directly or not."""
    root = np.arange(n)
    for i, j in links:
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                break
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root = above
    return root


def _links_in(batch: pa.Table, max_bits: int) -> pa.RecordBatch:
    """Spanning links of whole node pairs, given sorted by pair, side and bits."""
    columns = {c: batch.column(c).to_numpy() for c in [*_PAIR, "side", "fp"]}
    bits = batch.column("bits").to_numpy().view(np.uint64)
    n = len(bits)
    new = np.zeros(n, bool)
    new[0] = True
    for c in _PAIR:
        new[1:] |= columns[c][1:] != columns[c][:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    ones = np.concatenate([[0], np.cumsum(columns["side"])])
    middles = ends - (ones[ends] - ones[starts])
    alone = columns["a"][starts] == columns["b"][starts]
    # Spark sorts longs signed; a node's bits must be in unsigned order for its range to split.
    roots = np.column_stack([
        starts, np.where(alone, ends, middles), np.where(alone, starts, middles), ends,
        columns["depth"][starts], columns["used"][starts],
    ]).astype(np.int64)
    roots = roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2]) & (~alone | (ends - starts > 1))]
    root = _forest(n, trie_join(bits, roots, max_bits))
    at = np.flatnonzero(root != np.arange(n))
    fp = columns["fp"]
    return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], ["u", "v"])


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` as all links within the distance do."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole node pairs at a time; the last of a batch may go on in the next.
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _ROWS_AT_ONCE:
                whole = pa.Table.from_batches(held).combine_chunks()
                last = pa.compute.equal(whole.column("a"), whole.column("a")[-1])
                for c in _PAIR:
                    last = pa.compute.and_(last, pa.compute.equal(whole.column(c), whole.column(c)[-1]))
                cut = rows - pa.compute.sum(last).as_py()
                if cut:
                    yield _links_in(whole.slice(0, cut).combine_chunks(), max_bits)
                held = whole.slice(cut).combine_chunks().to_batches()
                rows -= cut
        if rows:
            yield _links_in(pa.Table.from_batches(held).combine_chunks(), max_bits)

    n = fps.count()
    found = None
    for pairs in _bounded_pairs(_root_pairs(fps, n, max_bits), max_bits, node_limit):
        # Nodes of the agreeing blocks are cut from the front, so unsigned order inside one is signed order.
        order = [*_PAIR, "side", F.col("bits").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))]
        dealt = pairs.repartition(*_PAIR).sortWithinPartitions(*order)
        part = dealt.mapInArrow(joined, "u long, v long")
        found = part if found is None else found.union(part)
    return found


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                node_limit: int = NODE_LIMIT) -> DataFrame:
    """One row per document: doc_id, fp, check, and ``rep``: the (none, doc_id, check) that stands for its group."""
    rows = fingerprints(docs, shingle_words)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "check")
    distinct = stage(rows.groupBy("fp").agg(F.min(own).alias("least")), "distinct_fingerprints")
    roots = component_roots(near_links(distinct.select("fp"), max_bits, node_limit))
    placed = distinct.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, "placed")
    rep = placed.groupBy("root").agg(F.min("least").alias("rep"))
    known = placed.join(rep, "root").select("fp", "rep")
    return rows.join(known, "fp")


def keep_one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the document of the smallest id of each group, all columns as they were."""
    key, staying = fresh(docs, "_key"), fresh(docs, "_staying")

    def named(doc_id: Column, check: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), check.cast("string"))

    reps = near_groups(docs, shingle_words, max_bits).select("rep").distinct()
    kept = reps.select(named(F.col("rep.doc_id"), F.col("rep.check")).alias(staying))
    keyed = docs.withColumn(key, named(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return keyed.join(kept, F.col(key) == F.col(staying), "left_semi").dropDuplicates([key]).drop(key)


@query("op6_simhash_trie")
def op6_simhash_trie(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("rep.doc_id").alias("component_id"))
