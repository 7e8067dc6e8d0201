"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed features: words, stems of longer words, pairs of
neighbouring words and pairs that skip one word. A bounded training sample runs FTRL-proximal (a
learning rate for each coordinate, L1 and L2 terms) in one task. L1 leaves few non-zero weights, so the model that goes to the tasks holds at most ``Config.buckets``
numbers whatever the size of the corpus. Scoring is a map over whole texts, without a shuffle.

Defined results: null or empty text has no features and gets the score of the bias alone;
repeated rows get equal scores; without labelled rows nothing is learnt and every score lies
just under 0.5, so nothing is rejected. Labels without an id or a mark are left out, repeated
labels of a document count once (the largest). Other columns pass through under their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import textkit as tk
from postlens.llm.shared import lean, small_batches


#: Longer words also count by their first bytes, so that inflected forms share a feature.
STEMS = (5, 6)


@dataclass(frozen=True)
class Config:
    #: Documents that training reads at most; they are the smallest by a hash of their id.
    max_train_docs: int = 16_000
    epochs: int = 3
    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0

    @property
    def buckets(self) -> int:
        return 1 << self.bits


def _features(s: tk.Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each feature occurrence."""
    w = tk.words(s)
    row, h = w.rows(), w.hash
    rows, keys = [row], [h]
    if len(h):
        sums = tk.byte_sums(tk.lower(s.buf))
        for size in STEMS:
            long = np.flatnonzero(w.end - w.start > size)
            rows.append(row[long])
            keys.append(tk.span_hash(sums, w.start[long], w.start[long] + size) * np.uint64(2 * size + 1))
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            keys.append(tk.mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same] * np.uint64(gap * 2 + 1)))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


def _ftrl(examples: list[tuple[np.ndarray, float]], c: Config) -> tuple[np.ndarray, float]:
    z, n = np.zeros(c.buckets + 1), np.zeros(c.buckets + 1)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * c.l1) / ((c.beta + np.sqrt(n[at])) / c.alpha + c.l2)
        w[np.abs(zi) <= c.l1] = 0.0
        return w

    rng = np.random.Generator(np.random.PCG64(7))
    bias = np.array([c.buckets], np.int32)
    for _ in range(c.epochs):
        for k in rng.permutation(len(examples)):
            at, y = examples[k]
            at = np.concatenate([at, bias])
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / c.alpha * w
    w = weights(np.arange(c.buckets + 1))
    return w[:-1], float(w[-1])


def _train_partition(c: Config):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, examples = [], []
        for b in batches:
            y, doc = b.column("toxic").to_pylist(), b.column("doc_id").to_pylist()
            for s in tk.slices(b.column("text")):
                row, key = _features(s, c.bits)
                pair = np.unique(row * np.int64(c.buckets) + key)
                row, key = pair >> c.bits, (pair & (c.buckets - 1)).astype(np.int32)
                for i, at in enumerate(np.split(key, np.searchsorted(row, np.arange(1, len(s))))):
                    examples.append((at, float(y[s.first + i])))
                    ids.append(doc[s.first + i])
        if not examples:
            return
        w, bias = _ftrl([examples[i] for i in np.argsort(ids, kind="stable")], c)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"key": np.append(at, -1), "weight": np.append(w[at], bias)})

    return run


@dataclass(frozen=True)
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def train(docs: DataFrame, labels: DataFrame, c: Config = Config()) -> Model:
    """Learn from the labelled documents of ``docs`` (``labels``: doc_id, toxic), at most ``max_train_docs`` of them."""
    small_batches(docs.sparkSession)
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(c.max_train_docs)
    )
    chosen = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .repartition(1)  # at most ``max_train_docs`` texts
        .mapInArrow(lean(_train_partition(c)), "key long, weight double")
    )
    learnt = dict(chosen.collect())  # at most 2**bits weights
    bias = learnt.pop(-1, -1e-6)
    keys = np.array(sorted(learnt), np.int64)
    return Model(keys, np.array([learnt[k] for k in keys.tolist()], np.float64), bias, c.bits)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """Add the score (0 to 1) as ``name`` to the columns ``keep`` (all but one of that name by default) of ``docs``."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most 2**bits weights
    keep = [k for k in docs.columns if k != name] if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep))]
    fields = [docs.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.zeros(1 << m.bits, np.float32)
        table[m.keys] = m.weights
        for b in batches:
            total = np.full(b.num_rows, m.bias)
            for s in tk.slices(b.column(text)):
                row, key = _features(s, m.bits)
                live = table[key] != 0
                pair = np.unique(row[live] * np.int64(1 << m.bits) + key[live])
                row, key = pair >> m.bits, pair & ((1 << m.bits) - 1)
                total[s.first : s.first + len(s)] += np.bincount(row, table[key].astype(np.float64), len(s))
            out = [b.column(k) for k in names] + [pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))]
            yield pa.RecordBatch.from_arrays(out, [*names, "_score"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)) + ", _score double"
    text = names[keep.index("text")] if "text" in keep else "_text"
    hidden = [] if "text" in keep else [F.col("text").alias(text)]
    out = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names)], *hidden)
    out = out.mapInArrow(lean(run), schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], F.col("_score").alias(name))


def held_out(mod: int = 5):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(held_out() != 0)
    scored = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", (held_out() == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
