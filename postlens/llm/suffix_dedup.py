"""Exact byte-substring dedup with a logarithmic family of suffix arrays.

A suffix counts by its first ``length`` bytes. The corpus is dealt so that equal suffixes meet: each
window of ``length`` bytes goes to the bucket of its minimizer (the least hash among its short grams),
and neighbouring windows that share it travel as one stretch of text, about three bytes for each byte
of corpus. A bucket takes its stretches in batches, by ascending document. Each batch gets a suffix
array (its suffixes in the order of their bytes), which is merge-scanned against the levels of the
family: a suffix that a level or an earlier document of the batch has, byte for byte, is a match. The
suffixes that are new make a level, and levels of about equal size merge, so that a suffix is merged a
logarithmic number of times. Runs of matches become byte ranges.

Stretches that are equal in a slice or bucket are settled as a whole (those of larger documents are
matches throughout), so copies cost no suffixes and a common passage sends one stretch for each slice.
Suffixes that share neither half of their window with another document (by hash) are left out of the
arrays: they cannot match. Both use hashes to choose, and bytes to decide.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` keep all; repeats
within one document stay; of equal documents all but the smallest id lose every byte (from ``length``
bytes on); rows without an id match nothing and keep all; rows that repeat an id get
equal results for equal texts, and different texts under one id are judged each for itself, against smaller ids only; columns but doc_id and text are not read; a text is held whole by
one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from postlens.llm import spans
from postlens.llm import textkit as tk
from postlens.llm.shared import pack, unpack

LENGTH = 50
GRAM = 12
#: Text whose windows one bucket holds.
RECORD_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
#: Bytes that are hashed or compared at a time, and suffixes of a batch that enters the family.
BATCH_BYTES = 2 << 20
BATCH_SUFFIXES = 1 << 19
_POS_BITS = 32


def stretches(s: tk.Slice, sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of maximal runs of windows with one minimizer, the minimizer's place and its hash."""
    n = len(s.buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = tk.window_hash(sums, gram)
    low = np.uint64((1 << _POS_BITS) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:  # least value of each window, by doubling
        step = min(have, width - have)
        v = np.minimum(v[: len(v) - step], v[step:])
        have += step
    size = np.diff(s.offs)
    at = tk.ragged(s.offs[:-1], np.maximum(size - length + 1, 0))
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    m = (v[at] & low).astype(np.int64)
    new = np.append(True, (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + length, m[first], h[m[first]]


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of spans (starts ``a`` and ``b``) hold equal bytes."""
    out = np.zeros(len(a), bool)
    cuts = np.append(0, np.flatnonzero(np.diff(np.cumsum(size) // BATCH_BYTES)) + 1)
    for i, j in zip(cuts, np.append(cuts[1:], len(a))):
        if i < j:
            differs = buf[tk.ragged(a[i:j], size[i:j])] != buf[tk.ragged(b[i:j], size[i:j])]
            out[i:j] = ~np.logical_or.reduceat(differs, np.cumsum(size[i:j]) - size[i:j])
    return out


def _beaten(key: np.ndarray, doc: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans hold the bytes of a span of a smaller document (one of equal ``key`` and size)."""
    order = np.lexsort((doc, size, key))
    k, z, d = key[order], size[order], doc[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (z[1:] != z[:-1]))) if len(k) else np.zeros(0, np.int64)
    lead = np.repeat(first, np.diff(np.append(first, len(k))))
    ask = np.flatnonzero(d > d[lead])
    mine, least = order[ask], order[lead[ask]]
    out = np.zeros(len(k), bool)
    out[mine] = _same(buf, start[mine], start[least], size[mine])
    return out


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Members of groups of equal non-zero ``key`` that span several documents."""
    order = np.argsort(key)
    k, d = key[order], doc[order]
    if not len(k):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
    out = np.zeros(len(k), bool)
    out[order] = np.repeat(several, np.diff(np.append(first, len(k)))) & (k != 0)
    return out


class IndexFamily:
    """Levels of suffix arrays over ``buf``: places in the order of their next ``length`` bytes, each with the smallest document that has them."""

    #: Suffixes whose bytes are laid out at a time.
    STEP = 1 << 18

    def __init__(self, buf: np.ndarray, length: int) -> None:
        self.windows = np.lib.stride_tricks.sliding_window_view(buf, length)
        self.kind = f"S{length}"
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _bytes(self, at: np.ndarray) -> np.ndarray:
        return self.windows[at].view(self.kind).ravel()

    def add(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Enter the suffixes ``at`` of documents that ascend, none smaller than those entered before; which of them a smaller document has."""
        out = np.zeros(len(at), bool)
        if not len(at):
            return out
        key = self._bytes(at)
        order = np.argsort(key, kind="stable")  # the batch's suffix array; equal suffixes by document
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        heads = key[first]
        del key
        least = doc[order[first]]
        known = np.zeros(len(first), bool)
        for places, docs in self.levels:
            for i in range(0, len(places), self.STEP):  # a merge-scan: both sides are in order
                theirs = self._bytes(places[i : i + self.STEP])
                low, high = np.searchsorted(heads, theirs[0]), np.searchsorted(heads, theirs[-1], "right")
                j = np.searchsorted(theirs, heads[low:high])
                hit = low + np.flatnonzero(theirs[np.minimum(j, len(theirs) - 1)] == heads[low:high])
                known[hit] = True
                least[hit] = np.minimum(least[hit], docs[i + j[hit - low]])
        out[order] = doc[order] > np.repeat(least, np.diff(np.append(first, len(order))))
        fresh = order[first[~known]]
        self._enter(at[fresh].astype(np.int32), doc[fresh])
        return out

    def _enter(self, places: np.ndarray, docs: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(places):
            old, old_docs = self.levels.pop()
            # Merge: where each new suffix goes among the old ones (none is equal).
            into = np.concatenate([np.zeros(0, np.int64)] + [self._among(old, places[i : i + self.STEP]) for i in range(0, len(places), self.STEP)])
            spot = into + np.arange(len(places))
            both, both_docs = np.empty(len(old) + len(places), np.int32), np.empty(len(old) + len(places), np.int64)
            rest = np.ones(len(both), bool)
            rest[spot] = False
            both[spot], both_docs[spot] = places, docs
            both[rest], both_docs[rest] = old, old_docs
            places, docs = both, both_docs
        if len(places):
            self.levels.append((places, docs))

    def _among(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        key = self._bytes(new)
        out = np.zeros(len(new), np.int64)
        for i in range(0, len(old), self.STEP):
            theirs = self._bytes(old[i : i + self.STEP])
            out = np.where(out == i, i + np.searchsorted(theirs, key), out)
        return out


def remove_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` after every byte under a string of ``length`` bytes that a smaller document has is removed."""

    half = (length + gram) // 2
    docs, bits, names = spans.told_apart(docs)

    def send(s, ids, layout):
        sums = tk.byte_sums(s.buf)
        start, end, place, mini = stretches(s, sums, length, gram)
        if not len(start):
            return
        row = np.searchsorted(s.offs, start, "right") - 1
        doc, pos = ids[row].astype(np.int64), start - s.offs[row]
        beaten = _beaten(tk.span_hash(sums, start, end), doc >> bits, s.buf, start, end - start)
        if beaten.any():
            yield from spans.answers(doc[beaten], pos[beaten], (pos + end - start)[beaten], layout, 1)
        go = np.flatnonzero(~beaten)
        bucket = (tk.mix(mini[go] ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(layout.records)).astype(np.int32)
        for b, at in spans.split(bucket, layout.records):
            at = go[at]
            size = end[at] - start[at]
            head = pack(np.diff(doc[at], prepend=0), np.diff(pos[at].astype(np.int32), prepend=np.int32(0)), size.astype(np.int32), (place[at] - start[at]).astype(np.uint8))
            text = zstandard.ZstdCompressor(level=3).compress(s.buf[tk.ragged(start[at], size)].tobytes())
            yield b, 0, np.array([len(head)], np.int64).tobytes() + head + text

    def find(blobs):
        none = np.zeros(0, np.int64)
        if not blobs:
            return none, none, none
        docs_, poss, sizes, places, texts = [], [], [], [], []
        for raw in blobs:
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            d, p, z, m = unpack(raw[8 : 8 + n])
            docs_.append(np.cumsum(d))
            poss.append(np.cumsum(p, dtype=np.int32))
            sizes.append(z)
            places.append(m)
            texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 + n :]), np.uint8))
        doc, pos, size, buf = np.concatenate(docs_), np.concatenate(poss).astype(np.int64), np.concatenate(sizes).astype(np.int64), np.concatenate(texts)
        del docs_, poss, sizes, texts, blobs
        end = np.cumsum(size)
        start = end - size
        place = start + np.concatenate(places)
        whole, left, right = (np.zeros(len(size), np.uint64) for _ in range(3))
        cuts = np.append(0, np.flatnonzero(np.diff(end // BATCH_BYTES)) + 1)
        for a, z in zip(cuts, np.append(cuts[1:], len(size))):
            low = start[a]
            sums = tk.byte_sums(buf[low : end[z - 1]])
            whole[a:z] = tk.span_hash(sums, start[a:z] - low, end[a:z] - low)
            for side, x, y in ((right, place, place + half), (left, place + gram - half, place + gram)):
                i = a + np.flatnonzero((x[a:z] >= start[a:z]) & (y[a:z] <= end[a:z]))
                side[i] = tk.span_hash(sums, x[i] - low, y[i] - low)
        owner = doc >> bits
        beaten = _beaten(whole, owner, buf, start, size)
        out = [(doc[beaten], pos[beaten], (pos + size)[beaten])]
        # A window holds the half to the left of its minimizer or the one to the right, so it can
        # only match where another document shares that half; most windows end here.
        right, left = (~beaten & _shared(side, owner) for side in (right, left))
        turn = place + gram - half
        low = np.where(left, start, np.maximum(start, turn))
        high = np.where(right, end - length, np.minimum(end - length, turn - 1))
        n = np.where(left | right, np.maximum(high - low + 1, 0), 0)
        family = IndexFamily(buf, length)
        some = np.flatnonzero(n)
        some = some[np.argsort(doc[some], kind="stable")]
        cuts = np.append(0, np.flatnonzero(np.diff(np.cumsum(n[some]) // BATCH_SUFFIXES)) + 1)
        for a, z in zip(cuts, np.append(cuts[1:], len(some))):
            i = some[a:z]
            at, of = tk.ragged(low[i], n[i]), np.repeat(i, n[i])
            hit = family.add(at, owner[of])
            at, of = at[hit], of[hit]
            if len(at):
                new = np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                shift = pos[of[first]] - start[of[first]]
                out.append((doc[of[first]], at[first] + shift, at[last] + shift + length))
        return tuple(np.concatenate(x) for x in zip(*out))

    def finish(s, row, start, end):
        gone = spans.covered(len(s.buf), s.offs[row] + start, s.offs[row] + end)
        sums = np.append(0, np.cumsum(gone))
        removed = np.diff(sums[s.offs])
        _, _, first = tk.runs(gone, s.offs)
        digests = []
        for i in range(len(s)):
            a, z = s.offs[i], s.offs[i + 1]
            kept = s.buf[a:z][~gone[a:z]] if removed[i] else s.buf[a:z]
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
        return [pa.array(np.diff(s.offs)), pa.array(removed.astype(np.int64)), pa.array(np.diff(first).astype(np.int64)), pa.array(digests)]

    found = spans.remove_repeats(docs, send, find, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", RECORD_BYTES, SLICE_BYTES)
    return spans.named(found, names)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
win as (select doc_id, i, b[i + 1 : i + 50] as s from (select doc_id, b, unnest(generate_series(0, octet_length(b) - 50)) as i from d where octet_length(b) >= 50)),
least_of as (select s, min(doc_id) as least from win group by s),
hit as (select doc_id, i from win join least_of using (s) where doc_id > least),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hit)),
span as (select doc_id, min(i) as a, max(i) + 50 as z from runs group by doc_id, run),
piece as (
  select doc_id, from_at, to_at from (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as from_at, a as to_at from span)
  union all select doc_id, max(z), null from span group by doc_id),
kept as (select p.doc_id, string_agg(hex(b[from_at + 1 : coalesce(to_at, octet_length(b))]), '' order by from_at) as h from piece p join d using (doc_id) group by p.doc_id),
gone as (select doc_id, sum(z - a) as removed, count(*) as spans from span group by doc_id)
select d.doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(coalesce(unhex(h), b)) as kept_sha256
from d left join gone on gone.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
"""
