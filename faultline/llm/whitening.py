"""Embedding whitening by spectrum slicing.

Entries become whole numbers, so sums and products are exact however the rows lie. The
covariance's eigenvalues are found one by one from the largest: the pivots of an LDLᵀ
factorisation of the covariance, shifted, count the eigenvalues above the shift (Sylvester's
law of inertia); halving shifts isolate the wanted one, Rayleigh quotient iteration then
converges cubically, and two more counts certify that it is the one its number says.
Eigenvalues too close to be told apart by counts are taken together: any orthonormal basis of
their space is as good as another, and one is found by inverse iteration. Only the sums of
products, one row per dimension, reach the driver; the rows are projected where they lie.

Defined results: a vector that is null, empty or holds null, NaN or infinite entries has no
row; neither do vectors whose length is not the commonest (of equals the larger). Entries
beyond ±2**40 once scaled count as that bound, so that products stay exact; a deviation
of 2**63 or more is null. A direction without variance cannot be whitened; components are
numbered over the others only.
Repeated rows count and give repeated rows, an empty table gives an empty one. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import query, table

COMPONENTS = 32
# Fixed values of the contract: entries are scaled, rounded down and lifted.
SCALE, LIFT = 64, 1_000_000
LARGEST = 1 << 40
# Eigenvalues nearer than this share of the largest are not told apart; smaller ones are zero.
RESOLUTION = 1e-11
# Arrow batches are cut to so many rows before they are multiplied.
ROWS = 4096


@dataclass(frozen=True)
class Moments:
    """Exact over the fit list: how many vectors, sums, and the covariance times n squared."""

    n: int
    sums: list[int]
    scatter: list[list[int]]

    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        rows = [[entry / square for entry in row] for row in self.scatter]
        return np.array(rows, float).reshape(len(rows), len(rows))


def whole_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and those as rows of whole numbers without the lift."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == width)
    flat = vectors.take(pa.array(right)).flatten()
    whole = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(right), width)
    finite = np.isfinite(whole).all(axis=1)
    scaled = np.floor(SCALE * whole[finite])
    return right[finite], np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def commonest_length(rows: DataFrame) -> int:
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    lengths = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad)
    found = lengths.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found.width if found else 0


def _exact_product(x: np.ndarray) -> np.ndarray:
    """``x`` transposed times ``x`` in whole numbers, in doubles where those are exact."""
    largest = int(np.abs(x).max(initial=0))
    if largest * largest * max(1, len(x)) < 1 << 53:
        x = x.astype(float)
        return (x.T @ x).astype(np.int64)
    if largest * largest * max(1, len(x)) < 1 << 63:
        return x.T @ x
    x = x.astype(object)
    return x.T @ x


def moments(rows: DataFrame, width: int) -> Moments:
    """Two passes: sums, then products of what is left after a whole centre is taken off.

    The centre is the rounded mean, the rest of the mean is taken off exactly at the end.
    Each task adds up its own batches and gives one row per dimension.
    """
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            kept, x = whole_rows(batch.column(0), width)
            n += len(kept)
            total += x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([str(t) for t in total], pa.string())],
            ["at", "n", "total"],
        )

    embedded = rows.select("embedding")
    exact = F.col("total").cast("decimal(38,0)")
    sums = embedded.mapInArrow(summed, "at int, n long, total string").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(exact).alias("total")
    ).orderBy("at").collect()
    n = sums[0].n if sums else 0
    if not n:
        return Moments(0, [0] * width, [[0] * width for _ in range(width)])
    lifted = [int(row.total) for row in sums]
    centre = np.array([round(total / n) for total in lifted], np.int64)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                _, x = whole_rows(batch.column(0).slice(start, ROWS), width)
                total += _exact_product(x - centre)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([[str(v) for v in row] for row in total], pa.list_(pa.string()))], ["at", "products"]
        )

    products = embedded.mapInArrow(multiplied, "at int, products array<string>").select(
        "at", *[F.col("products")[k].cast("decimal(38,0)").alias(f"p{k}") for k in range(width)]
    ).groupBy("at").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(width)]).orderBy("at").collect()
    rest = [total - n * int(c) for total, c in zip(lifted, centre)]
    scatter = [[n * int(products[i][k + 1]) - rest[i] * rest[k] for k in range(width)] for i in range(width)]
    return Moments(n, [total + n * LIFT for total in lifted], scatter)


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: the positive pivots of LDLᵀ of the shifted matrix.

    Pivots are single or two by two (a positive and a negative one where the diagonal is
    weak), chosen from the largest entry of the leading column, so none is lost to rounding.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        if len(a) == 1:
            return positive + int(a[0, 0] > 0)
        below = np.abs(a[1:, 0])
        r = int(np.argmax(below)) + 1
        widest = below[r - 1]
        single = 0
        if widest > 0 and abs(a[0, 0]) < alpha * widest:
            row = np.abs(a[r])
            row[r] = 0
            other = row.max()
            if abs(a[0, 0]) * other < alpha * widest * widest:
                single = r if abs(a[r, r]) >= alpha * other else -1
        if single >= 0:
            order = [single, *[k for k in range(len(a)) if k != single]]
            a = a[np.ix_(order, order)]
            pivot = a[0, 0]
            positive += int(pivot > 0)
            if pivot:
                a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0]) / pivot
            else:
                a = a[1:, 1:]
        else:
            order = [0, r, *[k for k in range(1, len(a)) if k != r]]
            a = a[np.ix_(order, order)]
            block, side = a[:2, :2], a[2:, :2]
            positive += int((np.linalg.det(block) < 0) or 2 * (block[0, 0] > 0))
            a = a[2:, 2:] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


def _isolate(matrix: np.ndarray, number: int, known: dict[float, int], width: float) -> tuple[float, float]:
    """An interval that holds the ``number``-th eigenvalue alone, or is no wider than ``width``.

    ``known`` has the counts above all shifts tried, for earlier eigenvalues too.
    """
    low = max(shift for shift, above in known.items() if above >= number)
    high = min(shift for shift, above in known.items() if above < number)
    while known[low] - known[high] > 1 and high - low > width:
        middle = (low + high) / 2
        known[middle] = count_above(matrix, middle)
        if known[middle] >= number:
            low = middle
        else:
            high = middle
    return low, high


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        return np.linalg.solve(shifted, x)
    except np.linalg.LinAlgError:
        return np.linalg.solve(shifted + np.spacing(np.abs(matrix).max()) * np.eye(len(matrix)), x)


def _polish(matrix: np.ndarray, low: float, high: float, x: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration, or None where it leaves the interval."""
    value = (low + high) / 2
    for _ in range(60):
        y = _solve(matrix, value, x)
        x = y / np.linalg.norm(y)
        before, value = value, float(x @ matrix @ x)
        if not low <= value <= high:
            return None
        if abs(value - before) <= 4 * np.spacing(np.abs(matrix).max()):
            y = _solve(matrix, value, x)
            return value, y / np.linalg.norm(y)
    return None


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues with variance, falling, and their unit vectors as columns."""
    size = len(matrix)
    reach = float(np.abs(matrix).sum(axis=1).max(initial=0))
    if reach == 0:
        return np.zeros(0), np.zeros((size, 0))
    width = RESOLUTION * reach
    values: list[float] = []
    vectors: list[np.ndarray] = []
    known = {-reach: size, reach * (1 + 1e-9): 0}
    start = np.random.default_rng(0).standard_normal((size, size))
    wanted = min(wanted, count_above(matrix, 4 * width))
    while len(values) < wanted:
        number = len(values) + 1
        low, high = _isolate(matrix, number, known, width)
        many = known[low] - known[high]
        found = None
        while many == 1 and found is None:
            x = start[:, 0] - sum(((v @ start[:, 0]) * v for v in vectors), np.zeros(size))
            # Inverse iteration about the middle first, as the quotient of a far vector may lead elsewhere.
            for _ in range(3):
                x = _solve(matrix, (low + high) / 2, x)
                x /= np.linalg.norm(x)
            found = _polish(matrix, low, high, x)
            if found is None:
                if high - low <= width:
                    break
                middle = (low + high) / 2
                low, high = (middle, high) if count_above(matrix, middle) >= number else (low, middle)
        if found is not None:
            value, vector = found
            if not (count_above(matrix, value - width) >= number > count_above(matrix, value + width)):
                raise ArithmeticError(f"eigenvalue {number} could not be certified")
            values.append(value)
            vectors.append(vector)
            continue
        # Eigenvalues the counts cannot part: one basis of their common space.
        space = start[:, :many]
        for _ in range(4):
            space = _solve(matrix, (low + high) / 2, space)
            for v in vectors:
                space = space - np.outer(v, v @ space)
            space = np.linalg.qr(space)[0]
        inner = space.T @ matrix @ space
        for k in range(many):
            values.append(float(inner[k, k]))
            vectors.append(space[:, k])
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order], np.array(vectors).T[:, order] if len(order) else np.zeros((size, 0))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    width = commonest_length(rows)
    fit = moments(rows, width)
    covariance = fit.covariance()
    values, vectors = leading_components(covariance, components)
    n, sums = fit.n, fit.sums
    centre = np.array([round(s / n) for s in sums] if n else [0] * width, np.int64)
    # The mean from the whole centre on, so that no digits are lost to the lift.
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre)] if n else [0.0] * width)
    scale = vectors / np.sqrt(values) if len(values) else vectors

    def projected(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept, x = whole_rows(batch.column(column), width)
        away = x + LIFT - centre
        return kept, away, (away - rest) @ scale

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(values) + 1, len(values) + 1))
        for batch in batches:
            _, _, z = projected(batch, 0)
            z = np.column_stack([z, np.ones(len(z))])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["at", "products"]
        )

    error = 0.0
    if len(values):
        parts = rows.select("embedding").mapInArrow(spread, "at int, products array<double>")
        sides = range(len(values) + 1)
        added = parts.groupBy("at").agg(*[F.sum(F.col("products")[k]).alias(f"p{k}") for k in sides]).orderBy("at").collect()
        whole = np.array([row[1:] for row in added]) / n
        mean = whole[-1, :-1]
        error = float(np.abs(whole[:-1, :-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    share = (values / np.trace(covariance)).tolist() if len(values) else []

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, away, z = projected(batch, 1)
            bound = int(np.abs(away).max(initial=0)) * n + n
            kind = object if bound * bound * max(1, width) >= 1 << 63 else np.int64
            off = away.astype(kind) * n - np.array([s - n * int(c) for s, c in zip(sums, centre)], kind)
            deviation = [int(d) if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array(deviation, pa.int64()), pa.array(z.tolist(), pa.list_(pa.float64()))],
                ["vec_id", "deviation", "whitened"],
            )

    flat = rows.mapInArrow(whitened, f"vec_id {id_type}, deviation long, whitened array<double>")
    explained = F.lit(share) if share else F.array().cast("array<double>")
    return flat.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query("op13_spectrum_slicing")
def op13_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
