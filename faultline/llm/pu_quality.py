"""Text quality by positive-unlabelled learning.

Trusted positives are the rows labelled 1; all documents are the unlabelled text, a
mixture of which an estimated part, the class prior, is good. A scorer f is fitted by
minimising the non-negative unbiased risk

    prior * E_pos[loss(f)]  +  max(0, E_all[loss(-f)] - prior * E_pos[loss(-f)])

with the logistic loss: the second part is the risk on bad text, worked out without a
single bad example; where it falls below zero the step goes the other way. Rows labelled 0
serve only to estimate the prior. A score is the logistic function of f.

Features are shares and ratios of the whole text; label, language, source and id are
none of them. Every text is read once for its features; the fit runs on the driver
over feature rows of at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED``
documents, the first by a hash; all documents are scored.

Defined results: null text is the empty text and gets a score like others; ids that
are null or labelled more than once with different labels teach nothing; without
positives every score is the prior; repeated rows give repeated rows; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import fresh, query, table, texts
from faultline.session import stage

THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
MAX_POSITIVE = 10_000
MAX_UNLABELLED = 20_000
STEPS, RATE, RIDGE = 500, 0.05, 1e-4
# The prior assumed where no label tells, and its bounds.
DEFAULT_PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.5, 0.05, 0.98

_MARKS = b"!?.,;:|#$%&*<>{}[]()=_-/\\'\"@+~^`"


def _byte_groups() -> np.ndarray:
    """One row per counted group of bytes."""
    groups = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" ", b"\n", b"\t\r\x0b\x0c", range(0x80, 0x100), _MARKS]
    groups += [bytes([b]) for b in _MARKS]
    out = np.zeros((len(groups), 256))
    for row, group in zip(out, groups, strict=True):
        row[list(group)] = 1
    return out


def text_features(text: str, groups: np.ndarray) -> np.ndarray:
    raw = text.encode()
    counts = groups @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    letters = max(1.0, counts[0] + counts[1])
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    lower = [w.lower() for w in words]
    kinds = len(set(lower))
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    extra = [
        np.log1p(n) / 10, counts[0] / letters, sum(map(len, words)) / n_words / 10,
        1 - kinds / n_words, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        1 - len(set(lines)) / n_lines, n_lines / n_words, len(words) == 0,
        sum(w.isalpha() for w in words) / n_words, sum(w[-1:] in (b".", b"!", b"?") for w in words) / n_words,
    ]
    # Square roots spread the small shares.
    return np.concatenate([np.sqrt(counts / n), extra])


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, check (a hash of the text) and features, written once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _byte_groups()
        for batch in batches:
            rows = [text_features(t.as_py(), groups).astype(np.float32) for t in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32))
            width = len(rows[0]) if rows else 1
            features = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), features], ["doc_id", "check", "features"])

    rows = texts(docs).withColumn("check", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(made, f"doc_id {id_type}, check long, features array<float>"), "features")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label of the ids that may teach, one row each."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return one.filter("label = most").select("doc_id", "label")


def estimate_prior(labels: DataFrame) -> float:
    """The share of good text, estimated by that among labelled training rows."""
    good, n = labels.agg(F.sum("label"), F.count("label")).first()
    return min(MOST_PRIOR, max(LEAST_PRIOR, (good + 1) / (n + 2))) if n else DEFAULT_PRIOR


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last one constant) of the scorer with least risk."""
    mean = unlabelled.mean(axis=0)
    scale = np.maximum(unlabelled.std(axis=0), 1e-3)

    def design(x: np.ndarray) -> np.ndarray:
        return expand((x - mean) / scale)

    p, u = design(positive), design(unlabelled)
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        fp, fu = p @ w, u @ w
        good_p, good_u = _logistic(fp), _logistic(fu)
        bad_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        bad_step = u.T @ good_u / len(u) - prior * (p.T @ good_p) / len(p)
        if bad_risk >= 0:
            grad = prior * (p.T @ (good_p - 1)) / len(p) + bad_step
        else:
            grad = -bad_step
        grad = grad + RIDGE * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return mean, scale, w


def expand(z: np.ndarray) -> np.ndarray:
    """Bounded features, their squares and a constant."""
    z = np.clip(z, -4, 4)
    return np.column_stack([z, z * z / 4, np.ones(len(z))])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """Features of about the ``n`` rows first by a hash of id and text, the same in every run.

    A bound on the hash lets about 1.5 times ``n`` rows through before they are sorted.
    """
    place = F.xxhash64("doc_id", "check")
    part = min(1.0, 1.5 * n / max(1, rows.count()))
    near = rows.filter(F.pmod(place, F.lit(1 << 20)) < part * (1 << 20))
    found = near.orderBy(place, "doc_id", "check").limit(n).select("features").toArrow().column(0).combine_chunks()
    return np.asarray(found.flatten(), float).reshape(len(found), -1) if len(found) else np.zeros((0, 1))


def score_rows(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """One row per document: doc_id, check, held_out, score and predicted."""
    rows = feature_rows(docs)
    known = stage(training_labels(labels), "training_labels")
    if prior is None:
        prior = estimate_prior(known)
    positive = _sample(rows.join(known.filter("label = 1"), "doc_id"), MAX_POSITIVE)
    if len(positive):
        mean, scale, weights = fit(positive, _sample(rows, MAX_UNLABELLED), prior)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(positive_found) and batch.num_rows:
                features = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                score = _logistic(expand((features - model[0]) / model[1]) @ model[2])
            else:
                score = np.full(batch.num_rows, prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "check", "score"])

    positive_found = positive[:1]
    model = (mean, scale, weights) if len(positive) else None
    id_type = rows.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(scored, f"doc_id {id_type}, check long, score double")
    return done.select(
        "doc_id", "check", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents the classifier rejects, all columns as they were."""
    key, rejected = fresh(docs, "_key"), fresh(docs, "_rejected")

    def named(doc_id: Column, check: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), check.cast("string"))

    bad = score_rows(docs, labels).filter("predicted = 0").select(named(F.col("doc_id"), F.col("check")).alias(rejected)).distinct()
    keyed = docs.withColumn(key, named(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    return keyed.join(bad, F.col(key) == F.col(rejected), "left_anti").drop(key)


@query("op1_pu_quality")
def op1_pu_quality(spark, sf_dir: str) -> DataFrame:
    scored = score_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
