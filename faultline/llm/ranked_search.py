"""Ranked lexical search by a dual-tree traversal.

Items (queries) and documents are each a hierarchy. A document is a vector of what each
term would add to a score; a node of documents holds the largest coordinate of its members,
a node of items the largest term count. Their product bounds the score of every pair below,
so a pair of nodes is left as soon as its bound is under the weakest of the k-th scores its
items have so far: whole batches are skipped, and no row of the result is. What remains is
scored in integers.

Items are taken in blocks of bounded size (``MAX_ITEMS``, ``MAX_TERMS``), each against all
documents. Document trees are built over batches of a bounded number of cells, so a task
holds a batch, the block and ``k`` rows per item. Corpus counts cover all documents. A part
of the documents is searched first; its k-th scores are true lower bounds for the rest.

Defined results: null text has no terms and such rows are in no result; an item without
terms, or whose terms no document holds, has no rows; equal scores go by ascending
``doc_id``, null last; repeated documents are documents of their own, repeated items are
answered once each, texts are read whole. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import query, table
from faultline.session import stage

TOP = 20
# Bounds of one block of items; a single item may hold more terms.
MAX_ITEMS, MAX_TERMS = 512, 8192
# Cells of a document batch, as rows times terms, and the members of nodes from leaf to root.
CELLS = 1 << 22
DOC_FANOUT, ITEM_FANOUT = (8, 8), (4, 8)
# One document in so many is searched first.
SEED_PART = 64

# Bytes that separate terms; only A-Z are lower-cased.
_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


@dataclass(frozen=True)
class Block:
    """Items searched together: their rows, the term numbers, and per item its term counts."""

    ids: list
    terms: dict[bytes, int]
    counts: list[dict[int, int]]


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents: how many have terms, all their terms, each block term's weight."""

    n_documents: int
    n_terms: int
    weights: np.ndarray


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks; only one block at a time is on the driver."""
    ids: list = []
    counts: list[dict[int, int]] = []
    terms: dict[bytes, int] = {}
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        found = Counter(terms_of(None if row.text is None else bytes(row.text)))
        if not found:
            continue
        fresh = sum(t not in terms for t in found)
        if ids and (len(ids) >= MAX_ITEMS or len(terms) + fresh > MAX_TERMS):
            yield Block(ids, terms, counts)
            ids, counts, terms = [], [], {}
        ids.append(row.item_id)
        counts.append({terms.setdefault(t, len(terms)): n for t, n in found.items()})
    if ids:
        yield Block(ids, terms, counts)


def document_vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Per document its id, its number of terms, and the block's terms in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            n, places, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = terms_of(text)
                n.append(len(found))
                tally = Counter(found)
                mine = [(wanted[t], tally[t]) for t in tally.keys() & wanted.keys()]
                mine.sort()
                places.append([p for p, _ in mine])
                counts.append([c for _, c in mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "places", "counts"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(counted, f"doc_id {id_type}, n long, places array<int>, counts array<long>")


def weight(n_documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * frequency + 1)))


def corpus_counts(vectors: DataFrame, n_block_terms: int) -> Corpus:
    """Counts over all documents; the driver gets one row per term of the block."""
    n, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = vectors.select(F.explode("places").alias("place")).groupBy("place").count().collect()
    weights = np.full(n_block_terms, weight(n, 0), np.int64)
    for place, documents in frequency:
        weights[place] = weight(n, documents)
    return Corpus(n, total, weights)


def gains(places: list[np.ndarray], counts: list[np.ndarray], n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What each term of the block adds to the score of each document, once per occurrence in an item."""
    dense = np.zeros((len(n), len(corpus.weights)))
    length = np.array([len(p) for p in places])
    row = np.repeat(np.arange(len(n)), length)
    place = np.concatenate(places) if len(places) else np.zeros(0, int)
    tf = np.concatenate(counts) if len(counts) else np.zeros(0, np.int64)
    # In Python integers, as the product of all documents and all terms may pass 64 bits.
    m = (75 + (25 * n.astype(object) * corpus.n_documents) // max(1, corpus.n_terms)).astype(np.int64)
    dense[row, place] = corpus.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    return dense


def maxima(rows: np.ndarray, size: int) -> np.ndarray:
    """Largest coordinate of each run of ``size`` rows."""
    return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0) if len(rows) else rows


def levels(rows: np.ndarray, fanout: tuple[int, ...]) -> list[np.ndarray]:
    """Coordinate maxima of the nodes of each level, the root first, the members last."""
    out = [rows]
    for size in fanout:
        out.append(maxima(out[-1], size))
    out.append(maxima(out[-1], max(1, len(out[-1]))))
    return out[::-1]


def sizes(fanout: tuple[int, ...], n: int) -> list[int]:
    """How many members a whole node of each level stands for, the root first."""
    out = [1]
    for size in fanout:
        out.append(out[-1] * size)
    return [max(n, 1), *out[::-1]]


class Search:
    """The best ``k`` documents of each item of a block, over the batches it is given."""

    def __init__(self, block: Block, corpus: Corpus, k: int, floors: np.ndarray | None = None):
        self.k, self.corpus = k, corpus
        self.floors = np.zeros(len(block.ids)) if floors is None else floors.astype(float)
        self.best: list[list[tuple]] = [[] for _ in block.ids]
        # Neighbours in the tree share their weightiest term.
        rows = np.zeros((len(block.ids), len(corpus.weights)))
        for k_item, counts in enumerate(block.counts):
            rows[k_item, list(counts)] = list(counts.values())
        self.order = np.argsort(np.argmax((rows > 0) * corpus.weights, axis=1), kind="stable")
        heaviest = int(rows.sum(axis=1).max(initial=0)) * int(corpus.weights.max(initial=0)) * 1_000_000
        # Doubles add whole numbers exactly up to 2**53; beyond, integers do.
        self.kind = np.float64 if heaviest < 1 << 53 else np.int64
        self.levels = levels(rows[self.order].astype(self.kind), ITEM_FANOUT)
        self.sizes = sizes(ITEM_FANOUT, len(rows))
        self.pairs_scored = 0

    def kth(self) -> np.ndarray:
        """Each item's k-th score so far in tree order, at least 1: a score of 0 is no result."""
        own = [b[-1][0] if len(b) == self.k else 0 for b in self.best]
        return np.maximum(np.maximum(own, self.floors), 1)[self.order]

    def add(self, doc_ids: list, dense: np.ndarray) -> None:
        """Take a batch of documents into account."""
        if not len(doc_ids):
            return
        order = np.argsort(np.argmax((dense > 0) * self.corpus.weights, axis=1), kind="stable")
        docs = levels(dense[order].astype(self.kind), DOC_FANOUT)
        doc_sizes = sizes(DOC_FANOUT, len(order))
        kth = self.kth()
        weakest = [np.minimum.reduceat(kth, np.arange(0, len(kth), size)) for size in self.sizes]
        roots = [(0, np.arange(1), np.arange(1))]
        while roots:
            # Items below one node against the documents that its bounds leave.
            level, item_nodes, doc_nodes = roots.pop()
            bound = self.levels[level][item_nodes] @ docs[level][doc_nodes].T
            passed = bound >= weakest[level][item_nodes, None]
            last = level == len(docs) - 1
            self.pairs_scored += passed.size if last else 0
            for at in np.flatnonzero(passed.any(axis=1)):
                left = doc_nodes[passed[at]]
                if last:
                    # Nodes are items and documents here, and the bounds are their scores.
                    item = self.order[item_nodes[at]]
                    found = [(int(s), doc_ids[order[d]]) for s, d in zip(bound[at, passed[at]], left)]
                    self.best[item] = sorted(self.best[item] + found, key=_rank)[: self.k]
                else:
                    below_item = _below(self.sizes, level, np.array([item_nodes[at]]), len(self.levels[level + 1]))
                    roots.append((level + 1, below_item, _below(doc_sizes, level, left, len(docs[level + 1]))))


def _below(node_sizes: list[int], level: int, nodes: np.ndarray, n_below: int) -> np.ndarray:
    """The nodes of the next level that stand under ``nodes``."""
    fan = -(-node_sizes[level] // node_sizes[level + 1])
    found = (nodes[:, None] * fan + np.arange(fan)).ravel()
    return found[found < n_below]


def _rank(hit: tuple) -> tuple:
    score, doc_id = hit
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


def _candidates(vectors: DataFrame, block: Block, corpus: Corpus, k: int, floors: np.ndarray | None) -> DataFrame:
    """(item, doc_id, score): the ``k`` best of each item in every task."""
    shared = vectors.sparkSession.sparkContext.broadcast((block, corpus, floors))
    n_rows = max(16, CELLS // max(1, len(block.terms)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, counts, least = shared.value
        search = Search(mine, counts, k, least)
        for whole in batches:
            for start in range(0, whole.num_rows, n_rows):
                batch = whole.slice(start, n_rows)
                places = [np.asarray(p.values, np.int64) for p in batch.column(2)]
                tf = [np.asarray(c.values, np.int64) for c in batch.column(3)]
                n = batch.column(1).to_numpy(zero_copy_only=False)
                search.add(batch.column(0).to_pylist(), gains(places, tf, n, counts))
        rows = [(item, *hit) for item, hits in enumerate(search.best) for hit in hits]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], id_arrow), pa.array([r[1] for r in rows], pa.int64())],
            ["item", "doc_id", "score"],
        )

    id_type = vectors.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    return vectors.mapInArrow(searched, f"item int, doc_id {id_type.simpleString()}, score long")


def best_of(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each item, with their rank; tasks keep ``k`` before the shuffle too."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    columns = f"item_id {id_type}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    found = []
    for block in item_blocks(items):
        vectors = stage(document_vectors(docs, block.terms), "vectors")
        corpus = corpus_counts(vectors, len(block.terms))
        seeds = vectors.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_PART)) == 0)
        first = best_of(_candidates(seeds, block, corpus, k, None), k).filter(F.col("rank") == k)
        floors = np.zeros(len(block.ids), np.int64)
        for row in first.select("item", "score").collect():
            floors[row.item] = row.score
        ranked = best_of(_candidates(vectors, block, corpus, k, floors), k)
        names = spark.createDataFrame(
            [Row(item=number, item_id=item_id) for number, item_id in enumerate(block.ids)], f"item int, item_id {id_type}"
        )
        rows = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found.append(stage(rows, "ranked"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], columns)


def _oracle() -> str:
    terms = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH wanted AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL
), listed AS (
  SELECT doc_id, row_number() OVER () AS doc, {terms} AS terms FROM documents
), corpus AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM listed
), held AS (
  SELECT doc, doc_id, len(terms) AS n, term, count(*) AS tf
  FROM (SELECT doc, doc_id, terms, unnest(terms) AS term FROM listed)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, corpus GROUP BY term
), scored AS (
  SELECT item_id, doc, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN wanted USING (term), corpus GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""


@query("op12_dual_tree_search", _oracle())
def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
