"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order: how often a byte followed each context of
up to ``order`` bytes. A byte that a context has not seen costs that context's escape (escape
method C: as many escapes as distinct followers) and is coded in the next shorter context, at last
uniformly over 256 bytes. The statistics are counted by Spark over a bounded sample of labelled
documents for each language, then frozen; a text's language is the one whose tree gives the
shortest exact code length over the whole text, and the score is its share of the likelihoods.

The trees of all languages are merged before scoring: for each gram seen in any of them the table
holds its resolved cost in every language, so a byte takes one look-up, or one more for each escape.
The tables are bounded by the sample and broadcast; scoring is a map without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
smaller language name; without labelled rows everything is ``und``; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm import textkit as tk
from postlens.llm.shared import lean, small_batches

UNDETERMINED = "und"


@dataclass(frozen=True)
class Config:
    #: Bytes of the longest context.
    order: int = 3
    #: Labelled documents for each language that training reads at most, the smallest by a hash of their id.
    max_docs_per_language: int = 1000


def _grams(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``n`` bytes that end at each byte, and which of them lie within their row."""
    key = np.zeros(len(buf), np.uint64)
    for back in range(n - 1, -1, -1):
        key[back:] = (key[back:] << np.uint64(8)) | buf[: len(buf) - back]
    depth = np.arange(len(buf)) - np.repeat(offs[:-1], np.diff(offs))
    return key, depth >= n - 1


class Index:
    """Open-addressing table from 64-bit keys to row numbers, with vectorised look-ups."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):
            free = self.rows[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.rows[slot], self.keys[slot] = todo[mine], keys[todo[mine]]
            rest = np.ones(len(todo), bool)
            rest[mine] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            got = self.rows[at]
            out[wrong] = got
            more = (got >= 0) & (self.keys[at] != keys[wrong])
            wrong, at = wrong[more], at[more]
        return out


@dataclass
class Model:
    """For each order: sorted gram keys with their costs in bits, and context keys with their escapes, in every language."""

    languages: list[str]
    order: int
    grams: list[np.ndarray] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    def code_lengths(self, s: tk.Slice, index: list[tuple[Index, Index]] | None = None) -> np.ndarray:
        """Bits of each row of the slice in each language."""
        index = index or self.index()
        total = np.zeros((len(s), len(self.languages)))
        if not len(s.buf):
            return total
        low = tk.lower(s.buf)
        open_at = np.arange(len(low))  # bytes that are not coded yet

        def add(at: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
            if len(at):
                edge = np.searchsorted(at, s.offs)
                some = np.flatnonzero(np.diff(edge))
                total[some] += np.add.reduceat(table[rows], edge[some], axis=0, dtype=np.float64)

        for n in range(self.order + 1, 0, -1):
            key, inside = _grams(low, s.offs, n)
            mine = inside[open_at]
            at = open_at[mine]
            rows = index[n - 1][0].find(key[at])
            hit = rows >= 0
            add(at[hit], self.costs[n - 1], rows[hit])
            miss = at[~hit]
            context = index[n - 1][1].find(key[miss] >> np.uint64(8))
            known = context >= 0
            add(miss[known], self.escapes[n - 1], context[known])
            open_at = np.sort(np.concatenate([open_at[~mine], miss])) if len(miss) else open_at[~mine]
        add(open_at, np.full((1, len(self.languages)), 8.0), np.zeros(len(open_at), np.int64))
        return total

    def index(self) -> list[tuple[Index, Index]]:
        return [(Index(g), Index(c)) for g, c in zip(self.grams, self.contexts)]


def freeze(counts: list[dict[str, tuple[np.ndarray, np.ndarray]]], languages: list[str], order: int) -> Model:
    """``counts[n-1][language]``: sorted keys of n bytes and how often they occur."""
    m = Model(languages, order)
    for n in range(1, order + 2):
        per = counts[n - 1]
        grams = np.unique(np.concatenate([per[k][0] for k in languages]))
        contexts = np.unique(grams >> np.uint64(8))
        cost, escape = np.zeros((len(grams), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        for j, lang in enumerate(languages):
            keys, c = per[lang]
            if not len(keys):
                total = distinct = np.zeros(len(contexts))
            else:
                at = np.searchsorted(contexts, keys >> np.uint64(8))
                total, distinct = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
            seen = total > 0
            escape[seen, j] = -np.log2(distinct[seen] / (total + distinct)[seen])
            of = np.searchsorted(contexts, grams >> np.uint64(8))
            count = np.zeros(len(grams))
            count[np.searchsorted(grams, keys)] = c
            own = count > 0
            cost[own, j] = -np.log2(count[own] / (total + distinct)[of[own]])
            if n == 1:
                shorter = np.full(len(grams), 8.0)
            else:
                shorter = m.costs[n - 2][np.searchsorted(m.grams[n - 2], grams & np.uint64((1 << (8 * (n - 1))) - 1)), j]
            cost[~own, j] = escape[of[~own], j] + shorter[~own]
        m.grams.append(grams)
        m.costs.append(cost)
        m.contexts.append(contexts)
        m.escapes.append(escape)
    return m


def _count(order: int):
    def run(batches):
        for b in batches:
            lang = np.array(b.column("lang").to_pylist())
            for s in tk.slices(b.column("text")):
                low = tk.lower(s.buf)
                of = lang[s.first : s.first + len(s)]
                for name in np.unique(of):
                    mine = np.repeat(of == name, np.diff(s.offs))
                    for n in range(1, order + 2):
                        key, inside = _grams(low, s.offs, n)
                        k, c = np.unique(key[inside & mine], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "n", "gram", "c"])

    return run


def train(docs: DataFrame, c: Config = Config()) -> Model:
    """Learn from ``docs(doc_id, text, lang)``, at most ``max_docs_per_language`` rows of each language."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = docs.where("lang is not null and text is not null").select("doc_id", "lang").withColumn("r", rank).where(F.col("r") <= c.max_docs_per_language)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "lang")), "doc_id").select("text", "lang")
    small_batches(docs.sparkSession)
    counted = sample.mapInArrow(lean(_count(c.order)), "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    t = counted.toArrow().to_pandas()  # bounded by the sample
    t["gram"] = t["gram"].astype("int64").to_numpy().view(np.uint64)
    languages = sorted(t["lang"].unique())
    if not languages:
        return Model([], c.order)
    counts = []
    for n in range(1, c.order + 2):
        own = t[t["n"] == n].sort_values("gram")
        counts.append({k: (g["gram"].to_numpy(np.uint64), g["c"].to_numpy()) for k in languages for g in [own[own["lang"] == k]]})
    return freeze(counts, languages, c.order)


_LETTER = tk.byte_class((65, 90), (97, 122))


def has_letter(s: tk.Slice) -> np.ndarray:
    """Rows with a letter of any script."""
    edges = np.minimum(s.offs, max(len(s.buf) - 1, 0))
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[s.offs])
    out = count(_LETTER[s.buf]) > 0 if len(edges) else np.zeros(0, bool)
    for i in np.flatnonzero(~out & (count(s.buf >= 128) > 0)):
        out[i] = any(ch.isalpha() for ch in s.raw(i).decode())
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        index = m.index()
        for b in batches:
            pred, score = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
            for s in tk.slices(b.column("text")) if m.languages else ():
                bits = m.code_lengths(s, index)
                best = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                for i in np.flatnonzero(has_letter(s)):
                    pred[s.first + i] = m.languages[best[i]]
                    score[s.first + i] = 1.0 / odds[i]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold() != 1).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
