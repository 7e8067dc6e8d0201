"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles becomes a signature of ``symbols`` b-bit minima. Two signatures
are near when they differ in at most ``distance`` symbols. The signature is split into chunks so
that, by the pigeonhole principle, near signatures differ in at most one symbol of some chunk;
every chunk is indexed once for each symbol that may be wrong (that symbol left out), so an equality
join finds every pair within the distance.

1. Documents with equal sets are one class (a 128-bit sum of the set and its size); only its
   smallest id goes on, so thousands of copies cost one row each.
2. Each key's classes meet a few hubs (the smallest by hashed orders, found by partial
   aggregation), never each other. Pairs within the distance are confirmed on the full sets; links
   give components.
3. Only keys whose classes still lie in several components are looked at again: their full sets go
   in blocks to tasks that count all intersections across components and hand on a spanning forest
   of the links. No link between components is lost, a large group that is one component already
   costs nothing more, and no task emits more rows than it has classes.

Defined results: null, empty and blank texts have an empty set and stand alone; fewer words than a
shingle make one shingle of the whole sequence; repeated rows are linked; ties go to the smaller id;
rows without an id link nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm import textkit as tk
from postlens.llm.components import components
from postlens.llm.shared import cut, grouped, lean, small_batches


#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Config:
    shingle: int = 5
    similarity: float = 0.8
    symbols: int = 48
    bits: int = 16
    chunks: int = 9
    #: Pairs that share a key are confirmed up to this much beyond the guaranteed distance.
    slack: int = 6
    #: Hashed orders by which a key's hub is chosen.
    hubs: int = 4
    #: Classes of one key, and shingles of their sets, in a block; one or two blocks meet in a task.
    block: int = 1000
    block_shingles: int = 750_000

    @property
    def distance(self) -> int:
        """Largest guaranteed distance: one wrong symbol for each chunk, less than one more in all."""
        return 2 * self.chunks - 1

    @property
    def per_mille(self) -> int:
        return round(self.similarity * 1000)


def shingle_sets(s: tk.Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, shingle hash) of a slice, and each row's first."""
    w = tk.words(s, tk.NON_SPACE)
    n = np.diff(w.offs)
    row = w.rows()
    sums = tk.prefix_sums(w.hash)
    at = np.flatnonzero(tk.within(n, size))
    rows, keys = [row[at]], [tk.span_hash(sums, at, at + size)]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        rows.append(short)
        keys.append(tk.span_hash(sums, w.offs[short], w.offs[short + 1]) + n[short].astype(np.uint64))
    r, k = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((k, r))
    r, k = r[order], k[order]
    if len(r):
        new = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))
        r, k = r[new], k[new]
    return r, k, np.searchsorted(r, np.arange(len(s) + 1))


def _signatures(k: np.ndarray, first: np.ndarray, c: Config) -> np.ndarray:
    """A row of minima for each non-empty set."""
    rng = np.random.Generator(np.random.PCG64(99))
    mult = rng.integers(1, 1 << 32, c.symbols, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, c.symbols, dtype=np.uint64)
    high = k >> np.uint64(32)
    out = np.empty((len(first), c.symbols), np.uint16)
    for i in range(c.symbols):
        least = np.minimum.reduceat((high * mult[i] + (k ^ add[i])).astype(np.uint32), first)
        x = least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = (x >> np.uint64(64 - c.bits)).astype(np.uint16)
    return out


def _profile(c: Config):
    def run(batches):
        for b in batches:
            size = np.zeros(b.num_rows, np.int64)
            sums = np.zeros((2, b.num_rows), np.int64)
            sig: list[bytes | None] = [None] * b.num_rows
            for s in tk.slices(b.column("text")):
                r, k, offs = shingle_sets(s, c.shingle)
                n = np.diff(offs)
                size[s.first : s.first + len(s)] = n
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                first = offs[:-1][some]
                sums[0, s.first + some] = np.add.reduceat(k, first).view(np.int64)
                sums[1, s.first + some] = np.add.reduceat(tk.mix(k ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)
                for i, row in zip(some, _signatures(k, first, c)):
                    sig[s.first + i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "s1", "s2", "sig"],
            )

    return run


def _keys(c: Config):
    """(key, rep) for every chunk and every symbol of it that may be wrong."""
    cuts = np.linspace(0, c.symbols, c.chunks + 1).round().astype(int)
    left = [[j for j in range(a, z) if j != e] for a, z in zip(cuts[:-1], cuts[1:]) for e in range(a, z)]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, c.symbols).astype(np.uint64)
            rep = b.column("rep").to_numpy()
            for i in range(0, b.num_rows, 2000):
                part = sig[i : i + 2000]
                keys = np.empty((len(left), len(part)), np.uint64)
                for j, at in enumerate(left):
                    keys[j] = np.uint64(j + 1)
                    for a in at:
                        keys[j] = tk.mix(keys[j] * np.uint64(0x9E3779B97F4A7C15) + part[:, a] + np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(rep[i : i + 2000], len(left)))], ["key", "rep"]
                )

    return run


def _near(pairs: DataFrame, classes: DataFrame, c: Config) -> DataFrame:
    """Pairs (a, b) whose signatures are within the distance and whose sizes allow the similarity."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") * 1000 >= F.greatest("na", "nb") * c.per_mille)

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint16).reshape(t.num_rows, -1) for k in ("sa", "sb"))
                yield t.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= c.distance + c.slack))

    return both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _sets(nodes: DataFrame, docs: DataFrame, c: Config) -> DataFrame:
    """Full sets ``(doc_id, grams)`` of the documents ``nodes(doc_id)``."""
    nodes = cut(nodes.distinct(), "nodes")
    if nodes.count() <= BROADCAST_IDS:  # else their texts are shuffled
        nodes = F.broadcast(nodes)

    def run(batches):
        for b in batches:
            sets: list = []
            for s in tk.slices(b.column("text")):
                _, k, offs = shingle_sets(s, c.shingle)
                sets += [k[x:y].view(np.int64) for x, y in zip(offs[:-1], offs[1:])]
            at = np.cumsum([0] + [len(x) for x in sets])
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "grams"])

    return cut(docs.select("doc_id", "text").join(nodes, "doc_id").mapInArrow(lean(run), "doc_id long, grams array<long>"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, c: Config) -> DataFrame:
    """Links (u, v) among the pairs, by the full sets."""
    sets = _sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, c)
    both = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared * 1000 >= (F.size("ga") + F.size("gb") - shared) * c.per_mille).select(F.col("b").alias("u"), F.col("a").alias("v"))


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    todo = np.ones(len(linked), bool)
    us, vs = [], []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(linked[u] & todo)
            todo[new] = False
            queue += new.tolist()
            us += [u] * len(new)
            vs += new.tolist()
    return np.array(us, np.int64), np.array(vs, np.int64)


def _cross(shared: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, c: Config) -> DataFrame:
    """Links (u, v) between classes of different components, from the keys that hold several.

    The classes of such a key meet in blocks with their full sets; a task counts all its intersections
    at once and hands on a spanning forest of the links it finds, at most one row for each class.
    """
    label = F.coalesce("component", "rep").alias("label")
    rows = shared.where("n > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", label)
    rows = rows.join(classes.select("rep", "n_shingles"), "rep")
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("total")).where("lo < hi")
    # Large keys go in blocks: a class meets every block of its key once, the rows and sets of a task stay bounded.
    blocks = F.greatest(F.ceil(F.col("n") / c.block), F.ceil(F.col("total") / c.block_shingles)).cast("int")
    rows = cut(rows.join(mixed.select("key", blocks.alias("blocks")), "key").select("key", "rep", "label", "blocks"), "mixed")
    sets = _sets(rows.select(F.col("rep").alias("doc_id")), docs, c).toDF("rep", "grams")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "own", "other", "rep", "label")
        .join(sets, "rep")
    )

    def run(batches):
        for _, t in grouped(batches, "task"):
            rep, label, own, other = (t.column(k).to_numpy() for k in ("rep", "label", "own", "other"))
            if label.min() == label.max():
                continue
            grams = t.column("grams").combine_chunks()
            size = np.diff(grams.offsets.to_numpy())
            row = np.repeat(np.arange(len(rep)), size)
            key, column, count = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
            some = count[column] > 1  # what one class alone has is in no intersection
            row, column = row[some], np.searchsorted(np.flatnonzero(count > 1), column[some])
            both = np.zeros((len(rep), len(rep)), np.float32)
            width = max(256, 2_000_000 // len(rep))
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            for a in range(0, int((count > 1).sum()), width):
                x, y = np.searchsorted(column, [a, a + width])
                part = np.zeros((len(rep), width), np.float32)
                part[row[x:y], column[x:y] - a] = 1
                both += part @ part.T
            linked = both * 1000 >= (size[:, None] + size[None, :] - both) * c.per_mille
            linked &= label[:, None] != label[None, :]
            linked &= (own == other)[:, None] | (own[:, None] != own[None, :])
            u, v = _forest(linked | linked.T)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[u], rep[v])), pa.array(np.minimum(rep[u], rep[v]))], ["u", "v"])

    return met.repartition("task").sortWithinPartitions("task").mapInArrow(lean(run), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, c: Config = Config()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)
    profile = cut(docs.select("doc_id", "text").mapInArrow(lean(_profile(c)), "doc_id long, n_shingles long, s1 long, s2 long, sig binary"), "profile")
    full = profile.where("n_shingles > 0")
    # Equal sets have equal signatures, so any of the group's will do.
    classes = cut(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")).where("rep is not null"), "classes")
    keyed = classes.select("rep", "sig").mapInArrow(lean(_keys(c)), "key long, rep long")
    order = F.xxhash64("rep", F.pmod("key", F.lit(c.hubs)))
    hubs = keyed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", F.col("h.rep").alias("hub"), "n")
    # Only the keys of several classes are kept; most have one.
    shared = cut(keyed.join(hubs, "key"), "shared")
    pairs = shared.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = cut(_confirmed(cut(_near(pairs, classes, c), "pairs"), docs, c), "links")
    first = components(links)
    more = cut(_cross(shared, first, classes, docs, c), "links")
    final = first
    if not more.isEmpty():
        final = components(links.unionByName(more))
    label = final.select(F.col("node").alias("rep"), "component")
    of_class = classes.select("s1", "s2", "n_shingles", "rep").join(label, "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = profile.select("doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, c: Config = Config()) -> DataFrame:
    """One row of each group of near-duplicates stays, the one of the smallest id (of rows that repeat it, the first text and one row); rows without an id stay too."""
    found = cut(near_duplicates(docs.where("doc_id is not null"), c), "found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least")).where("n > 1 and least = doc_id").select("doc_id")
    gone, twice = cut(gone, "gone"), cut(twice, "twice")
    small = gone.count() <= BROADCAST_IDS  # else the texts are shuffled
    names = docs.columns
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*names)
    if twice.isEmpty():
        return kept
    few = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    again = kept.join(few, "doc_id", "left_semi").select(*names)
    first = again.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("_place = 1").select(*names)
    return kept.join(few, "doc_id", "left_anti").select(*names).unionByName(first)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, Config(shingle=3, similarity=0.85))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP10_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') as w from documents),
sh as (
  select distinct doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
edge as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
link as (select a, b from edge union select b, a from edge),
reach as (
  with recursive r(node, seen) as (
    select doc_id, doc_id from w union select r.node, link.b from r join link on r.seen = link.a)
  select node, min(seen) as component_id from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n on n.doc_id = w.doc_id join reach on reach.node = w.doc_id
"""
