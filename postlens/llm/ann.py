"""Nearest neighbours by inner product over balanced posting lists.

Centroids come from a balanced k-means over a bounded sample; every vector joins the posting list
of its nearest centroid and, near a boundary, of further ones (while they are almost as near and not
on the far side of one already taken). Centroids are found through an in-memory neighbour graph,
which is broadcast (at most ``max_centroids``). A query probes the lists whose centroid is within a
ratio of its nearest centroid's distance; the ratio is calibrated on the sample for the recall asked
for, and goes on to further lists until they hold more than ``k`` vectors. Lists and their queries meet in blocks of bounded size, are compared in double precision, and
each block hands on its best rows for each query.

Inner products become distances by one more coordinate that lifts every vector to the largest norm.
Equal vectors are one entry with its smallest ids (no more of them can be in a result), so a vector
that a third of the rows share fills no list.

Defined results: rows without an id, null or zero vectors, and vectors with a null or non-finite
component or another dimension than the valid one of the smallest id take no part; ties go to the
smaller id; with fewer candidates than ``k``, all; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.shared import cut, grouped, lean


#: Vectors that walk the graph together; each takes about 150 kB meanwhile.
BLOCK_ROWS = 256


@dataclass(frozen=True)
class Config:
    k: int = 20
    #: Vectors that the index is fitted on at most, the smallest by a hash of their id.
    max_sample: int = 20_000
    max_centroids: int = 16_384
    iterations: int = 8
    #: Copies of a boundary vector, and how much farther their centroid may be than the nearest.
    replicas: int = 4
    boundary: float = 1.10
    #: Recall the probing ratio is calibrated for on the sample.
    recall: float = 0.975
    neighbours: int = 24
    #: Vectors, and queries, of one list that meet in one block.
    block: int = 4096


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Add the coordinate that gives every vector the norm ``norm``: nearest then means largest inner product."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0.0))
    return np.hstack([x, rest[:, None]])


def _dist2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means in which a full list costs more than an empty one; empty lists restart in the fullest."""
    rng = np.random.Generator(np.random.PCG64(5))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        new, size, spread = np.zeros_like(c), np.zeros(k), 0.0
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            d = _dist2(part, c) + load
            near = d.argmin(1)
            np.add.at(new, near, part)
            size += np.bincount(near, minlength=k)
            spread += d[np.arange(len(part)), near].sum()
        full = size > 0
        c[full] = new[full] / size[full, None]
        if not full.all():
            c[~full] = c[np.argsort(-size)[: int((~full).sum())]] * (1 + 1e-3)
        load = 0.05 * spread / len(x) * (size * k / len(x) - 1.0)
    return c


@dataclass
class Graph:
    """Centroids and each one's nearest neighbours; ``search`` walks it for many queries at once."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(c: np.ndarray, m: int) -> Graph:
        k = len(c)
        m = min(m, k - 1)
        links = np.zeros((k, m), np.int64)
        for i in range(0, k, 1024):
            d = _dist2(c[i : i + 1024], c)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links[i : i + 1024] = np.argsort(d, 1)[:, :m]
        if m:  # a ring beside the nearest links keeps the graph connected
            links[:, -1] = (np.arange(k) + 1) % k
        return Graph(c, links, np.unique(np.linspace(0, k - 1, min(k, 32)).astype(np.int64)))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found nearest to each query, and their distances; ``width`` of them, best first."""
        k, c = len(self.centroids), self.centroids
        width = min(width, k)
        if width * 2 >= k:
            d = np.sqrt(_dist2(q, c))
            at = np.argsort(d, 1, kind="stable")[:, :width]
            return at, np.take_along_axis(d, at, 1)
        n = len(q)
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        best = np.tile(self.entries, (n, 1))
        dist = _dist2(q, c[self.entries])
        done = np.zeros(best.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            order = np.argsort(dist, 1, kind="stable")[:, :width]
            best, dist, done = (np.take_along_axis(a, order, 1) for a in (best, dist, done))
            score = np.where(done, np.inf, dist)
            take = np.argsort(score, 1, kind="stable")[:, :4]
            if not np.isfinite(np.take_along_axis(score, take, 1)).any():
                return best, np.sqrt(dist)
            live = np.isfinite(np.take_along_axis(score, take, 1))
            np.put_along_axis(done, take, True, 1)
            near = self.links[np.take_along_axis(best, take, 1)]
            near = near.reshape(n, -1)
            fresh = np.repeat(live, self.links.shape[1], 1) & ~seen[rows, near]
            d = np.where(fresh, ((c[near] - q[:, None, :]) ** 2).sum(2), np.inf)
            # the same neighbour can come through several links: keep its first
            order = np.argsort(near, 1, kind="stable")
            s = np.take_along_axis(near, order, 1)
            again = np.zeros(near.shape, bool)
            np.put_along_axis(again, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
            d[again] = np.inf
            seen[rows, near] = True
            best, dist, done = np.hstack([best, near]), np.hstack([dist, d]), np.hstack([done, ~np.isfinite(d)])


@dataclass
class Index:
    graph: Graph
    norm: float
    ratio: float
    config: Config
    floor: float = 0.0

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list of each vector and the boundary ones."""
        parts = [self._assign(x[i : i + BLOCK_ROWS]) for i in range(0, len(x), BLOCK_ROWS)]
        rows = [r + i * BLOCK_ROWS for i, (r, _) in enumerate(parts)]
        return np.concatenate(rows), np.concatenate([p[1] for p in parts])

    def _assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.config
        at, d = self.graph.search(lift(x, self.norm), 2 * c.replicas)
        rows, lists = [np.arange(len(x))], [at[:, 0]]
        taken = [at[:, 0]]
        for j in range(1, at.shape[1]):
            ok = d[:, j] <= c.boundary * d[:, 0]
            for t in taken:  # relative neighbourhood rule: not if a list already taken is nearer to this one than the vector is
                gap = np.sqrt(((self.graph.centroids[at[:, j]] - self.graph.centroids[t]) ** 2).sum(1))
                ok &= (gap >= d[:, j]) | (t == at[:, j])
            if j >= c.replicas:
                break
            rows.append(np.flatnonzero(ok))
            lists.append(at[ok, j])
            taken.append(np.where(ok, at[:, j], at[:, 0]))
        return np.concatenate(rows), np.concatenate(lists)

    def probe(self, q: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of the lists that each query looks into; ``held`` is how many vectors have each list as their nearest."""
        enough = 2 * (self.config.k + 1)
        x = np.hstack([q, np.zeros((len(q), 1))])
        width = 64
        while True:
            at, d = self.graph.search(x, width)
            # A query that (almost) is a centroid still looks as far around as others do.
            near = d <= self.ratio * np.maximum(d[:, :1], self.floor)
            # Every vector is counted in one list only, so these hold so many different ones.
            before = np.cumsum(held[at], 1) - held[at]
            near |= before < enough
            if width >= len(self.graph.centroids) or not near[:, -1].any():
                row, j = np.nonzero(near)
                return row, at[row, j]
            width *= 4


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(entries: DataFrame, n: int, norm: float, c: Config) -> Index:
    rows = entries.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(c.max_sample).toArrow()
    x = _matrix(rows.column("embedding"))
    k = int(np.clip(np.sqrt(n) / 2, 1, min(c.max_centroids, len(x))))
    lifted = lift(x, norm)
    index = Index(Graph.build(balanced_centroids(lifted, k, c.iterations), c.neighbours), norm, np.inf, c)
    # Calibration: how far, against its nearest, a query must probe to meet its true neighbours' lists.
    rng = np.random.Generator(np.random.PCG64(6))
    some = rng.choice(len(x), min(300, len(x)), replace=False)
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    top = np.argsort(-score, 1)[:, : max(1, min(c.k, len(x) - 1))]
    row, lists = index.assign(x)
    d = np.sqrt(_dist2(np.hstack([x[some], np.zeros((len(some), 1))]), index.graph.centroids))
    index.floor = float(np.median(d.min(1)))
    d /= np.maximum(d.min(1, keepdims=True), max(index.floor, 1e-12))
    order = np.argsort(row, kind="stable")
    row, lists = row[order], lists[order]
    edge = np.searchsorted(row, np.arange(len(x) + 1))
    need = [min(d[i, lists[edge[v] : edge[v + 1]]]) for i, t in enumerate(top) for v in t]
    index.ratio = float(np.quantile(need, c.recall)) * (1 + 1e-9) if need else np.inf
    return index


def search(vectors: DataFrame, queries: DataFrame, c: Config = Config()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of ``vectors(vec_id, embedding)`` to each row of ``queries``, its own id left out."""
    spark = vectors.sparkSession
    valid = _valid(vectors)
    size = valid.select("vec_id", F.size("embedding").alias("n")).agg(F.min(F.struct("vec_id", "n")).alias("first")).first()["first"]
    same = F.size("embedding") == (size["n"] if size else 0)
    valid = valid.where(same)
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = cut(
        valid.withColumn("r", rank).where(F.col("r") <= c.k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.element_at("ids", 1)),
        "vectors",
    )
    n, norm = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    index = spark.sparkContext.broadcast(fit(entries, n, norm, c))  # bounded by max_centroids

    def place(kind: int):
        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(i, BLOCK_ROWS)
                    x = _matrix(part.column("embedding"))
                    row, lists = index.value.assign(x) if kind == 0 else index.value.probe(x, held.value)
                    own = part.take(pa.array(row))
                    nearest = pa.array(np.arange(len(row)) < len(x))  # assign gives each vector's nearest list first
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), nearest, *own.columns], ["list", "nearest", *own.schema.names])

        return run

    fields = "vec_id long, ids array<long>, embedding array<double>"
    posted = cut(entries.select("vec_id", "ids", "embedding").mapInArrow(lean(place(0)), f"list long, nearest boolean, {fields}"), "postings")
    counts = posted.where("nearest").groupBy("list").count().toArrow()  # bounded by max_centroids
    inside = np.zeros(len(index.value.graph.centroids), np.int64)
    inside[counts.column("list").to_numpy()] = counts.column("count").to_numpy()
    held = spark.sparkContext.broadcast(inside)
    asked = _valid(queries).where(same).select("vec_id", F.array("vec_id").alias("ids"), "embedding").mapInArrow(lean(place(1)), f"list long, nearest boolean, {fields}")
    asked = cut(asked, "probes")

    def blocks(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy("list").agg(F.ceil(F.count("*") / c.block).cast("int").alias(name))

    sizes = blocks(posted, "np").join(blocks(asked, "nq"), "list")

    def dealt(of: DataFrame, side: int, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        a, b = ("own", "met") if side == 0 else ("met", "own")
        return of.join(sizes, "list").select("*", own.alias("own"), met.alias("met")).select(F.xxhash64("list", a, b).alias("task"), F.lit(side).alias("side"), "vec_id", "ids", "embedding")

    both = dealt(posted, 0, "np", "nq").unionByName(dealt(asked, 1, "nq", "np")).repartition("task").sortWithinPartitions("task", "side")
    keep = c.k + 1

    def compare(batches):
        for _, t in grouped(batches, "task"):
            m = int((t.column("side").to_numpy() == 0).sum())
            if not 0 < m < t.num_rows:
                continue
            v, q = t.slice(0, m), t.slice(m)
            x, ids, lists = _matrix(v.column("embedding")), v.column("vec_id").to_numpy(), v.column("ids").combine_chunks()
            order = np.argsort(ids, kind="stable")
            x, lists = x[order], lists.take(pa.array(order)).to_pylist()
            y, qid = _matrix(q.column("embedding")), q.column("vec_id").to_numpy()
            out_q, out_s, out_v = [], [], []
            for i in range(0, len(y), 256):
                s = y[i : i + 256] @ x.T
                top = np.argsort(-s, 1, kind="stable")[:, :keep]
                for r, at in enumerate(top):
                    got = [(float(s[r, j]), w) for j in at for w in lists[j]]
                    out_q.append(int(qid[i + r]))
                    out_s.append([g[0] for g in got])
                    out_v.append([g[1] for g in got])
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_s, pa.list_(pa.float64())), pa.array(out_v, pa.list_(pa.int64()))], ["query_id", "scores", "found"])

    def merge(batches):
        for q, t in grouped(batches, "query_id"):
            s, v = t.column("scores").combine_chunks().flatten().to_numpy(), t.column("found").combine_chunks().flatten().to_numpy()
            v, first = np.unique(v, return_index=True)
            s = s[first]
            v, s = v[v != q], s[v != q]
            at = np.lexsort((v, -s))[: c.k]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(np.arange(1, len(at) + 1, dtype=np.int32)), pa.array(v[at]), pa.array(s[at])], ["query_id", "rank", "vec_id", "score"])

    best = both.mapInArrow(lean(compare), "query_id long, scores array<double>, found array<long>")
    return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lean(merge), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
