"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words of the items (A-Z folded, runs of letters, digits and non-ASCII characters) go into one
automaton. Document words stream through it while the longest matching length is tracked; where
it reaches the window (10 words, or a whole shorter item) the words under the window are hits,
and the automaton's state names the items. Before the walk a table of item word pairs passes over
stretches that cannot hold a window, so most words never reach Python-level code.

The items are cut into blocks of about ``BLOCK_WORDS`` words at most, each with an automaton of its
own. One block (the usual case) is one map over the documents; of several, each is a pass of its own,
whose output is written to the shared folder before the next block is broadcast, so a task holds one
automaton at a time however large the benchmark is. Documents are never shuffled.

Defined results: null or empty texts have no words and no hits; items without words have no
window; repeated items share windows and are all named; an empty item table leaves every
document clean. Repeated documents get equal results. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import textkit as tk
from postlens.llm.shared import cut, lean, small_batches

WINDOW = 10
BLOCK_WORDS = 100_000
_BLOOM_BITS = 20
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Automaton:
    """Generalised suffix automaton over word ids, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        lines = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for name, ws in items if ws]
        ends: list[list[int]] = []
        for _, ids in lines:
            last, path = 0, []
            for w in ids:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        self.shortest = min([min(window, len(ids)) for _, ids in lines], default=window)
        #: state -> items of which the state's suffix of ``width`` words is a window; and how many words that is.
        self.items: dict[int, dict[int, set[str]]] = {}
        for (name, ids), path in zip(lines, ends):
            width = min(window, len(ids))
            for at in range(width - 1, len(ids)):
                self.items.setdefault(self._suffix_state(path[at], width), {}).setdefault(width, set()).add(name)
        #: the nearest state at or above with windows.
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.up = [-1] * len(order)
        for v in order:
            self.up[v] = v if v in self.items else (self.up[self.link[v]] if v else -1)

    def _suffix_state(self, v: int, width: int) -> int:
        while self.length[self.link[v]] >= width:
            v = self.link[v]
        return v

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, w)
        v = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[v] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return v

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans under windows, and the items that have them."""
        spans, found = [], set()
        v = size = 0
        for i, w in enumerate(words):
            wid = self.vocab.get(w)
            if wid is None:
                v = size = 0
                continue
            while v and wid not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if wid in self.next[v]:
                v = self.next[v][wid]
                size += 1
            u = self.up[v]
            while u > 0:
                for width, names in self.items[u].items():
                    if width <= size:
                        spans.append((i + 1 - width, i + 1))
                        found |= names
                u = self.up[self.link[u]]
        return spans, found


def _pairs(h: np.ndarray) -> np.ndarray:
    return tk.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])


def _blocks(items: DataFrame, window: int, id_column: str) -> tuple[int, Callable[[int], tuple[Automaton, np.ndarray]]]:
    """The number of blocks of items, and a function that makes a block's automaton and table of word pairs."""
    sized = items.select(F.col(id_column).cast("string").alias("id"), "text").where("text is not null and id is not null")
    total = sized.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(_WORD)).cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // BLOCK_WORDS))

    def make(k: int) -> tuple[Automaton, np.ndarray]:
        rows = sized.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).orderBy("id", "text").collect()  # bounded by the block
        lines, bloom = [], np.zeros(1 << _BLOOM_BITS, bool)
        for r in rows:
            s = next(tk.slices(pa.array([r.text])))
            w = tk.words(s)
            low = tk.lower(s.buf).tobytes()
            lines.append((r.id, [low[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]))
            if len(w.hash):
                bloom[(_pairs(w.hash) >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)] = True
        return Automaton(lines, window), bloom

    return n, make


def _stretches(h: np.ndarray, row: np.ndarray, bloom: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 word of the stretches that may hold a window, each within a row."""
    if shortest < 2:
        edges = np.flatnonzero(np.diff(row)) + 1
        return np.append(0, edges), np.append(edges, len(row))
    if len(h) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = bloom[(_pairs(h) >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)] & (row[1:] == row[:-1])
    change = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
    first, last = change[::2], change[1::2]
    long = last - first >= shortest - 1
    return first[long], last[long] + 1


_ADDED = {"_n": "n_words", "_hw": "hit_words", "_hb": "hit_bytes", "_items": "hit_items"}


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "item_id") -> DataFrame:
    """Add ``n_words``, ``hit_words`` (array of first and last+1 word of each hit stretch, flat),
    ``hit_bytes`` (the same in bytes) and ``hit_items`` (sorted array of item ids) to ``docs``; they replace columns of these names."""
    out = _scanned(docs, items, window, id_column)
    kept = [F.col(f"_c{i}").alias(k) for i, k in enumerate(docs.columns) if k not in _ADDED.values()]
    return out.select(*kept, *[F.col(k).alias(v) for k, v in _ADDED.items()])


def _scanned(docs: DataFrame, items: DataFrame, window: int, id_column: str = "item_id", max_coverage: float | None = None) -> DataFrame:
    """The columns of ``docs`` as ``_c0 ...`` and the results under the names in ``_ADDED``.

    With ``max_coverage`` the last pass also cuts the hit spans out, and gives the columns of ``docs`` alone.
    """
    extra = "_n int, _hw array<int>, _hb array<int>, _items array<string>"
    names = [f"_c{i}" for i in range(len(docs.columns))]
    base = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    text = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    spark = docs.sparkSession
    small_batches(spark)
    n, make = _blocks(items, window, id_column)
    out = docs.toDF(*names)
    for k in range(n):
        shared = spark.sparkContext.broadcast(make(k))  # bounded by BLOCK_WORDS
        first, last = k == 0, k == n - 1

        def run(batches, shared=shared, first=first, last=last):
            auto, table = shared.value
            for b in batches:
                cols = [b.column(i) for i in range(len(names))]
                none = [[]] * b.num_rows
                old = [none, none, none] if first else [b.column(c).to_pylist() for c in ("_hw", "_hb", "_items")]
                count, hw, hb, hit = _hits(cols[text], auto, table, *old)
                if last and max_coverage is not None:
                    yield pa.RecordBatch.from_arrays(_cut(cols, text, size, count, hw, hb, max_coverage), names)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(count), pa.array(hw, pa.list_(pa.int32())), pa.array(hb, pa.list_(pa.int32())), pa.array(hit, pa.list_(pa.string()))],
                    [*names, "_n", "_hw", "_hb", "_items"],
                )

        out = out.mapInArrow(lean(run), base if last and max_coverage is not None else f"{base}, {extra}")
        if not last:
            out = cut(out, "items")
            shared.unpersist()
    return out


def _hits(texts: pa.Array, auto: Automaton, table: np.ndarray, old_w: list, old_b: list, old_i: list) -> tuple[np.ndarray, list, list, list]:
    """Words of each text, and hit words, hit bytes and items after this block."""
    count, hw, hb, items = np.zeros(len(texts), np.int32), list(old_w), list(old_b), list(old_i)
    for s in tk.slices(texts):
        w = tk.words(s)
        count[s.first : s.first + len(s)] = np.diff(w.offs)
        if not len(w.hash):
            continue
        row = w.rows()
        low = None
        hits: dict[int, list[tuple[int, int]]] = {}
        for a, z in zip(*_stretches(w.hash, row, table, auto.shortest)):
            low = tk.lower(s.buf).tobytes() if low is None else low
            spans, found = auto.scan([low[x:y] for x, y in zip(w.start[a:z].tolist(), w.end[a:z].tolist())])
            if spans:
                r = int(row[a])
                hits.setdefault(r, []).extend((int(a + x - w.offs[r]), int(a + y - w.offs[r])) for x, y in spans)
                items[s.first + r] = sorted({*items[s.first + r], *found})
        for r, spans in hits.items():
            spans += zip(hw[s.first + r][::2], hw[s.first + r][1::2])
            merged: list[list[int]] = []
            for x, y in sorted(spans):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(y, merged[-1][1])
                else:
                    merged.append([x, y])
            hw[s.first + r] = [v for m in merged for v in m]
            hb[s.first + r] = [int(v - s.offs[r]) for x, y in merged for v in (w.start[w.offs[r] + x], w.end[w.offs[r] + y - 1])]
    return count, hw, hb, items


def _cut(cols: list[pa.Array], text: int, size: int | None, count: np.ndarray, hw: list, hb: list, max_coverage: float) -> list[pa.Array]:
    """The columns of the rows of which at most ``max_coverage`` is hit, without their hit spans."""
    covered = np.array([sum(flat[1::2]) - sum(flat[::2]) for flat in hw], np.int64)
    keep = np.flatnonzero(covered <= count * max_coverage)
    cols = [c.take(pa.array(keep)) for c in cols]
    todo = [(i, hb[k]) for i, k in enumerate(keep.tolist()) if hb[k]]
    if todo:
        texts = cols[text].to_pylist()
        sizes = cols[size].to_pylist() if size is not None else None
        for i, flat in todo:
            raw, out, last = texts[i].encode(), [], 0
            for x, y in zip(flat[::2], flat[1::2]):
                out.append(raw[last:x])
                last = y
            texts[i] = (b"".join(out) + raw[last:]).decode()
            if sizes is not None:
                sizes[i] = len(texts[i])
        cols[text] = pa.array(texts, cols[text].type)
        if sizes is not None:
            cols[size] = pa.array(sizes, cols[size].type)
    return cols


def cut_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``; documents of which more than ``max_coverage`` is hit go.

    ``n_chars``, where there is one, follows the new text. Clean rows are unchanged.
    """
    if "text" not in docs.columns:
        raise ValueError("docs needs a text column")
    return _scanned(docs, items, window, max_coverage=max_coverage).toDF(*docs.columns)


def _covered(column: str):
    return F.aggregate(column, F.lit(0), lambda acc, v: v - acc)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = mark(docs, items)
    n_hit = _covered("hit_words").cast("long")
    return marked.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP3_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents),
bw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from benchmark),
bwin as (
  select distinct item, least(len(w), 10) as k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') as win
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as s from bw where len(w) > 0)),
widths as (select distinct k from bwin),
dwin as (
  select doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') as win
  from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as s from dw, widths where len(w) >= k)),
occ as (select d.doc_id, d.s, d.k, b.item from dwin d join bwin b on d.win = b.win and d.k = b.k),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + k - 1)) as p from (select distinct doc_id, s, k from occ)) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from occ) group by 1)
select dw.doc_id, cast(len(dw.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit on dw.doc_id = hit.doc_id left join its on dw.doc_id = its.doc_id
"""
