"""Whitening of embeddings by spectrum slicing.

Vectors become whole numbers (``floor(64 c) + 1000000``), so counts, sums and the sums of centred products
are exact and do not depend on how the rows are dealt: tasks add up centred products of their batches, Spark
adds up the tasks' matrices, and the driver sees one matrix of the dimension (at most ``MAX_DIMENSION``).

The leading eigenvalues of the covariance V are isolated by inertia: the factorisation V - sI = L D L'
has as many negative pivots as V has eigenvalues below s, so a bisection over s finds an interval that
holds the k-th eigenvalue and no other. From there Rayleigh quotient iteration converges cubically, and
counts just below and above the result certify that it is the k-th. Eigenvalues that no interval can
part at double precision are certified together, and their vectors are kept orthogonal.

Defined results: vectors that are null or empty, or hold null or non-finite entries, take no part, nor do
those whose length is not the most frequent one (of equally frequent ones the largest); entries count as at most 2^34 in
size; rows without an id or that repeat one are rows like others; a deviation that does not fit a long is null;
components stop where the covariance has no variance left (then there are fewer than ``components``; one
distinct vector or none has no rows); an empty table has no rows; other columns take no part.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.shared import cut, lean, small_batches

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_DIMENSION = 4096
#: Largest scaled size of an entry.
_MOST = float(1 << 40)
_EXACT = pa.decimal128(38, 0)


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: the vectors that take part, as whole numbers."""
    c = F.col("embedding")
    own = vectors.select("vec_id", "embedding").where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return own.select("vec_id", F.transform(c, lambda e: F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(_MOST)), F.lit(-_MOST))) + OFFSET).alias("x"))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def exact_products(a: np.ndarray) -> np.ndarray:
    """``a.T @ a`` of whole numbers, exactly: halves of 20 bits where a double could not hold the sums."""
    most = int(np.abs(a).max(initial=0))
    if most * most * len(a) < 1 << 53:
        return (a.T.astype(float) @ a.astype(float)).astype(np.int64)
    total = np.zeros((a.shape[1], a.shape[1]), object)
    for i in range(0, len(a), 512):
        high, low = ((a[i : i + 512] >> 20).astype(float), (a[i : i + 512] & ((1 << 20) - 1)).astype(float))
        cross = (high.T @ low).astype(np.int64).astype(object)
        total = total + ((high.T @ high).astype(np.int64).astype(object) << 40) + ((cross + cross.T) << 20) + (low.T @ low).astype(np.int64).astype(object)
    return total


class _Sum:
    """Whole-number matrices added up without overflow."""

    def __init__(self) -> None:
        self.big, self.small, self.room = 0, 0, 0

    def add(self, m: np.ndarray) -> None:
        most = int(np.abs(m).max(initial=0))
        if self.room + most >= 1 << 62 or m.dtype == object:
            self.big, self.small, self.room = self.big + np.asarray(self.small).astype(object), 0, 0
        if m.dtype == object:
            self.big = self.big + m
        else:
            self.small, self.room = self.small + m, self.room + most

    def total(self) -> np.ndarray:
        return np.asarray(self.big + np.asarray(self.small).astype(object))


def _entries(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in v], _EXACT)], ["i", "j", "v"])


def _collected(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The sum of the tasks' matrices: one row for each entry."""
    return {(r.i, r.j): int(r.v) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list, and the sum of each dimension."""

    def run(batches):
        n, total = 0, _Sum()
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                total.add(_matrix(b.column("x")).sum(0))
        if n:
            yield _entries(np.arange(-1, d), np.zeros(d + 1), np.append(total.total(), n)[np.r_[d, 0:d]])

    told = _collected(fit.select("x").mapInArrow(lean(run), "i int, j int, v decimal(38,0)"))
    return told.get((-1, 0), 0), [told.get((k, 0), 0) for k in range(d)]


def covariance(fit: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """Covariance of the fit list, each entry the double nearest to its exact value.

    Rows are centred at the whole numbers nearest to the means; what is left of the means is taken off in exact arithmetic.
    """
    d = len(s)
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    i, j = np.triu_indices(d)

    def run(batches):
        total, seen = _Sum(), False
        for b in batches:
            if b.num_rows:
                total.add(exact_products(_matrix(b.column("x")) - centre))
                seen = True
        if seen:
            yield _entries(i, j, total.total()[i, j])

    told = _collected(fit.select("x").mapInArrow(lean(run), "i int, j int, v decimal(38,0)"))
    rest = [v - n * int(c) for v, c in zip(s, centre)]
    v = np.zeros((d, d))
    for (a, b), g in told.items():
        v[a, b] = v[b, a] = (n * g - rest[a] * rest[b]) / (n * n)
    return v


def below(v: np.ndarray, at: float) -> int:
    """How many eigenvalues of ``v`` are less than ``at``: negative pivots of L D L' = v - at I.

    Pivots are the largest diagonal entry, or the largest off-diagonal one as a block of two, so that factors stay bounded.
    """
    a = v - at * np.eye(len(v))
    found, alpha = 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(a.diagonal())
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        p, q = divmod(int(off.argmax()), len(a))
        if not off[p, q] and not diagonal[k]:
            return found  # what is left is zero: eigenvalues at ``at`` itself
        pick = [k] if diagonal[k] >= alpha * off[p, q] else [p, q]
        rest = np.setdiff1d(np.arange(len(a)), pick)
        pivot, side = a[np.ix_(pick, pick)], a[np.ix_(rest, pick)]
        if len(pick) == 1:
            found += int(pivot[0, 0] < 0)
            a = a[np.ix_(rest, rest)] - side @ (side.T / pivot[0, 0])
        else:
            found += 1  # an indefinite block
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
    return found


class NotCertified(ValueError):
    """The inertia counts do not confirm the number of an eigenvalue."""


def leading(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; only those with variance above rounding.

    ``v`` is positive semidefinite.
    """
    d = len(v)
    top = float(np.abs(v).sum(1).max(initial=0.0))
    if not top:
        return np.zeros(0), np.zeros((d, 0))
    near = 64 * d * np.finfo(float).eps * top
    counts = {-near: d, top + near: 0}

    def above(at: float) -> int:
        if at not in counts:
            counts[at] = d - below(v, at)
        return counts[at]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(7)

    def solve(shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, near / d, near):
            try:
                y = np.linalg.solve(v - (shift + nudge) * np.eye(d), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and y.any():
                return y / np.linalg.norm(y)
        return x

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in vectors:
                x = x - u * (u @ x)
        return x / np.linalg.norm(x)

    while len(values) < min(components, d):
        k = len(values) + 1
        low, high = max(a for a in counts if counts[a] >= k), min(a for a in counts if counts[a] < k)
        found = None
        while found is None:
            if above(low) == k and above(high) == k - 1:  # isolated: iterate on the Rayleigh quotient
                shift, x = (low + high) / 2, apart(rng.standard_normal(d))
                for step in range(12):
                    x = apart(solve(shift, x))
                    # The second solve from the middle settles the vector; from then on the quotient is the shift.
                    shift, before = (float(x @ v @ x) if step else shift), shift
                    if step > 1 and abs(shift - before) <= near / 64:
                        break
                if low - near <= shift <= high + near and np.linalg.norm(v @ x - shift * x) <= near:
                    found = shift
                    break
            middle = (low + high) / 2
            if high - low <= near or middle in (low, high):  # not to be parted at this precision
                x = apart(rng.standard_normal(d))
                for _ in range(4):
                    x = apart(solve(middle, x))
                found = float(x @ v @ x)
                break
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        if not above(found - 2 * near) >= k > above(found + 2 * near):
            raise NotCertified(f"eigenvalue {k} at {found}: {above(found - 2 * near)} at or above, {above(found + 2 * near)} beyond")
        if found <= near:
            break
        values.append(found)
        vectors.append(x * np.sign(x[np.abs(x).argmax()]))
    return np.array(values), np.array(vectors).T.reshape(d, -1)


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once; equal ones meet before the shuffle first."""
    return cut(rows.select("x").distinct(), "whitening-fit")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> a row for each vector that takes part and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    small_batches(spark)
    rows = scaled(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} dimensions: their covariance would have {d * d} entries, more than {MAX_DIMENSION} squared")
    rows = rows.where(F.size("x") == d)
    fit = fit_list(rows)
    n, s = sums(fit, d)
    v = covariance(fit, n, s)
    values, axes = leading(v, components)
    m = len(values)
    if not m:
        return spark.createDataFrame([], schema)
    centre = np.array([(2 * t + n) // (2 * n) for t in s], np.int64)
    rest = [t - n * int(c) for t, c in zip(s, centre)]  # S - n centre
    part = np.array([r / n for r in rest])
    axes = axes / np.sqrt(values)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - part) @ axes

    def spread(batches):
        first, second, seen = np.zeros(m), np.zeros((m, m)), False
        for b in batches:
            if b.num_rows:
                w = project(_matrix(b.column("x")))
                first, second, seen = first + w.sum(0), second + w.T @ w, True
        if seen:
            i, j = np.indices((m, m + 1)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.hstack([second, first[:, None]]).ravel())], ["i", "j", "v"])

    held = np.zeros((m, m + 1))
    for r in fit.mapInArrow(lean(spread), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        held[r.i, r.j] = r.v / n
    error = float(np.abs(held[:, :m] - np.outer(held[:, m], held[:, m]) - np.eye(m)).max())
    explained = values / np.trace(v)
    gap = np.array(rest, object)

    def deviations(x: np.ndarray) -> list[int | None]:
        a = x - centre
        if (n * (int(np.abs(a).max()) + 1)) ** 2 * d < 1 << 63:
            return ((n * a - gap.astype(np.int64)) ** 2).sum(1).tolist()
        return [t if t < 1 << 63 else None for t in ((n * a.astype(object) - gap) ** 2).sum(1)]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                k = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(k), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))), pa.array(project(x).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error)),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return rows.mapInArrow(lean(run), schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
