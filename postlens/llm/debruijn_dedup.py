"""Substring dedup over a de Bruijn graph of token k-mers.

Every window of ``k`` words is an edge between the nodes of its first and last ``k - 1`` words.

1. Edges go, as hashes with their source coordinates, to buckets that find the repeated ones. Each distinct
   repeated edge is owned by its first place; every other place learns the owner's coordinates (a slice of
   text sends equal edges once and points its own copies at the first of them).
2. Where a document meets what it was told, runs of edges that point at one stretch of a source become
   spans, and owned edges become segments with the hashes of their nodes. Nodes met by several segments
   tell the in- and out-degrees: segments are cut at branching nodes, and pieces that meet at a node with
   one edge in and one out are joined, by joins on the node and connected components over the joins, into
   nonbranching paths.
3. Spans are placed on the paths by their source coordinates, and the words there are compared (by SHA-256)
   with the document's own: only what is verified is removed. An owner is verified against a second place.

Lines of text travel in blocks of ``BLOCK`` words, so neither a long document nor a passage that a third of
all documents share makes a large row; hot sources meet their spans in joins that Spark may split.

Defined results: null, empty and short texts have no windows and keep their words; windows that repeat
within one document count; all of equal documents' windows repeat; an empty table gives no rows; rows
without an id match nothing and come out with all their words; rows that repeat an id
and its text count once, and different texts under one id are documents of their own; columns but doc_id and text are not read; a text is held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm import spans
from postlens.llm import textkit as tk
from postlens.llm.components import components
from postlens.llm.shared import cut, grouped, lean, pack, small_batches, text_bytes, unpack

WINDOW = 35
#: Words of a block of source text.
BLOCK = 256
#: Text whose windows one bucket holds.
RECORD_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
# Marks of what a place is told: it owns the edge, it is the owner's second place, it was settled in its slice, nothing is known but that.
_OWN, _SECOND, _LOCAL, _ALONE = 1, 2, 4, 8
# Kinds of traced rows.
_OWNED, _COPY, _COPY_IN_SLICE, _LABEL, _NODE = range(5)


def _second_hash(h: np.ndarray) -> np.ndarray:
    return tk.mix(h ^ np.uint64(0x2545F4914F6CDD1D))


def edges(s: tk.Slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: hash, second hash, row, first word in the row."""
    w = tk.words(s, tk.NON_SPACE, fold=False)
    at = np.flatnonzero(tk.within(np.diff(w.offs), k))
    one, two = tk.prefix_sums(w.hash), tk.prefix_sums(_second_hash(w.hash))
    row = np.searchsorted(w.offs, at, "right") - 1
    return tk.span_hash(one, at, at + k), tk.span_hash(two, at, at + k), row, at - w.offs[row]


class Told:
    """What places are told: edge (doc, start) points at (tdoc, tstart), with marks."""

    def __init__(self, doc, start, tdoc, tstart, mark) -> None:
        self.doc, self.start, self.tdoc, self.tstart, self.mark = doc, start, tdoc, tstart, mark

    def blobs(self, layout: spans.Layout) -> Iterator[tuple[int, bytes]]:
        for b, at in spans.split(spans.doc_bucket(self.doc, layout.documents), layout.documents):
            at = at[np.lexsort((self.start[at], self.doc[at]))]
            d, s = self.doc[at], self.start[at]
            follows = np.append(False, (d[1:] == d[:-1]) & (s[1:] == s[:-1] + 1) & (self.tdoc[at][1:] == self.tdoc[at][:-1]) & (np.diff(self.tstart[at]) == 1) & (self.mark[at][1:] == self.mark[at][:-1]))
            first = np.flatnonzero(~follows)
            n = np.diff(np.append(first, len(at))).astype(np.int32)
            at = at[first]
            d, s = self.doc[at], self.start[at].astype(np.int32)
            yield b, pack(np.diff(d, prepend=0), np.diff(s, prepend=np.int32(0)), n, self.tdoc[at] - d, (self.tstart[at] - s).astype(np.int32), self.mark[at].astype(np.int8))

    @staticmethod
    def of(blobs: list[bytes]) -> Told:
        parts = [unpack(b) for b in blobs]
        if not parts:
            none = np.zeros(0, np.int64)
            return Told(none, none, none, none, none.astype(np.int8))
        doc = np.concatenate([np.cumsum(p[0]) for p in parts])
        start = np.concatenate([np.cumsum(p[1], dtype=np.int32) for p in parts]).astype(np.int64)
        n, by, shift, mark = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4, 5))
        n = n.astype(np.int64)
        at = np.repeat(np.arange(len(n)), n)
        place = tk.ragged(start, n)
        return Told(doc[at], place, (doc + by)[at], place + shift[at], mark[at])

    def settled(self) -> tuple[np.ndarray, ...]:
        """One line for each place, in order: doc, start, tdoc, tstart, all marks, and whether the slice alone knows its copy."""
        rank = np.where(self.mark & _ALONE, 2, np.where(self.mark & _LOCAL, 1, 0))
        order = np.lexsort((rank, self.start, self.doc))
        d, s = self.doc[order], self.start[order]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))) if len(d) else np.zeros(0, np.int64)
        marks = np.bitwise_or.reduceat(self.mark[order], first) if len(first) else np.zeros(0, np.int8)
        at = order[first]
        return self.doc[at], self.start[at], self.tdoc[at], self.tstart[at], marks, (rank[at] == 1) & (marks & _OWN == 0)


def _send(s: tk.Slice, ids: np.ndarray, layout: spans.Layout, k: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, 0, edges) for the edges of a slice, and (bucket of documents, 1, told) for its own repeats."""
    h, h2, row, start = edges(s, k)
    if not len(h):
        return
    doc = ids[row].astype(np.int64)
    order = np.argsort(h, kind="stable")
    x, y = h[order], h2[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    several = size > 1
    if several.any():
        lead = np.repeat(first, size)
        inner = np.flatnonzero(~new)
        a, b = order[inner], order[lead[inner]]
        yield from ((i, 1, z) for i, z in Told(doc[a], start[a], doc[b], start[b], np.where(inner == lead[inner] + 1, _LOCAL | _SECOND, _LOCAL).astype(np.int8)).blobs(layout))
        a, b = order[first[several]], order[first[several] + 1]
        yield from ((i, 1, z) for i, z in Told(doc[a], start[a], doc[b], start[b], np.full(len(a), _LOCAL, np.int8)).blobs(layout))
    bucket = (y[first] % np.uint64(layout.records)).astype(np.int32)
    for b, at in spans.split(bucket, layout.records):
        at = at[np.argsort(order[first[at]])]
        src = order[first[at]]
        head = pack(np.diff(doc[src], prepend=0), np.diff(start[src].astype(np.int32), prepend=np.int32(0)), several[at].astype(np.int8))
        yield b, 0, np.array([len(head)], np.int64).tobytes() + head + h[src].tobytes()  # hashes do not compress


def _find(blobs: list[bytes]) -> Told:
    """Owners, second places and copies among the edges of a bucket."""
    keys, docs, starts, againsts = [], [], [], []
    for raw in blobs:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        d, s, again = unpack(raw[8 : 8 + n])
        docs.append(np.cumsum(d))
        starts.append(np.cumsum(s, dtype=np.int32))
        againsts.append(again)
        keys.append(np.frombuffer(raw, np.uint64, len(d), 8 + n))
    key, doc, start, again = np.concatenate(keys), np.concatenate(docs), np.concatenate(starts).astype(np.int64), np.concatenate(againsts) > 0
    order = np.argsort(key)
    x = key[order]
    same = x[1:] == x[:-1]
    repeated = np.append(same, False) | np.append(False, same) | again[order]
    at = order[repeated]
    at = at[np.lexsort((start[at], doc[at], key[at]))]
    x, doc, start = key[at], doc[at], start[at]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(x)))
    target = np.repeat(first, size)
    mark = np.zeros(len(x), np.int8)
    mark[first] = np.where(size > 1, _OWN, _OWN | _ALONE)
    target[first[size > 1]] += 1
    mark[first[size > 1] + 1] |= _SECOND
    return Told(doc, start, doc[target], start[target], mark)


def _trace(s: tk.Slice, ids: np.ndarray, told: tuple[np.ndarray, ...], k: int) -> list[pa.Array]:
    """Spans, source blocks and nodes of the documents of a slice (``told`` has no others)."""
    doc, start, tdoc, tstart, mark, local = told
    kind = np.where(mark & _OWN, _OWNED, np.where(local, _COPY_IN_SLICE, _COPY))
    follows = np.append(False, (doc[1:] == doc[:-1]) & (np.diff(start) == 1) & (tdoc[1:] == tdoc[:-1]) & (np.diff(tstart) == 1) & (kind[1:] == kind[:-1]))
    follows &= (start % BLOCK != 0) & (tstart % BLOCK != 0)
    first = np.flatnonzero(~follows)
    n = np.diff(np.append(first, len(doc)))
    zeros = np.zeros(len(first), np.int64)
    out = [[kind[first], doc[first], start[first], n, tdoc[first], tstart[first], zeros, [None] * len(first)]]
    order = np.argsort(ids, kind="stable")
    row_of = lambda d: order[np.searchsorted(ids[order], d)]
    w = tk.words(s, tk.NON_SPACE, fold=False)
    shown = np.flatnonzero(mark & (_OWN | _SECOND))
    if len(shown):
        block = start[shown] // BLOCK
        new = np.append(True, (np.diff(doc[shown]) != 0) | (np.diff(block) != 0))
        d, g = doc[shown][new], block[new]
        row = row_of(d)
        a = w.offs[row] + g * BLOCK
        z = np.minimum(a + BLOCK + k - 1, w.offs[row + 1])
        raw = s.buf.tobytes()
        labels = [b" ".join([raw[x:y] for x, y in zip(w.start[i:j].tolist(), w.end[i:j].tolist())]).decode() for i, j in zip(a.tolist(), z.tolist())]
        zeros = np.zeros(len(d), np.int64)
        out.append([np.full(len(d), _LABEL), d, g, zeros, zeros, zeros, zeros, labels])
    own = np.flatnonzero(mark & _OWN)
    if len(own):
        begins = np.append(True, (np.diff(doc[own]) != 0) | (np.diff(start[own]) != 1))
        head = np.flatnonzero(begins)
        size = np.diff(np.append(head, len(own)))
        d, seg = np.repeat(doc[own[head]], size + 1), np.repeat(start[own[head]], size + 1)
        place = tk.ragged(start[own[head]], size + 1)
        at = w.offs[row_of(d)] + place
        node = tk.span_hash(tk.prefix_sums(w.hash), at, at + k - 1).view(np.int64)
        sides = (place > seg) * 1 + (place < seg + np.repeat(size, size + 1)) * 2  # an edge comes in, one goes out
        out.append([np.full(len(d), _NODE), d, place, seg, np.zeros(len(d), np.int64), sides, node, [None] * len(d)])
    columns = [np.concatenate(x) for x in list(zip(*out))[:7]]
    return [pa.array(c.astype(t)) for c, t in zip(columns, (np.int8, np.int64, np.int32, np.int32, np.int64, np.int32, np.int64))] + [pa.array([x for o in out for x in o[7]], pa.string())]


_TRACED = "kind tinyint, doc long, start int, n int, tdoc long, tstart int, node long, label string"


def traced(docs: DataFrame, k: int = WINDOW) -> tuple[DataFrame, spans.Layout]:
    """Steps 1 and 2: the traced rows (see ``_TRACED``), written to the shared folder."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n, size = text_bytes(docs)
    layout = spans.Layout(max(4, -(-size // RECORD_BYTES)), max(4, -(-size // spans.GROUP_BYTES), -(-n // spans.GROUP_DOCS)))
    schema = "bucket int, side int, blob binary"

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "side", "blob"])

    def sender(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for s in tk.slices(b.column("text"), SLICE_BYTES):
                rows = list(_send(s, ids[s.first : s.first + len(s)], layout, k))
                if rows:
                    yield batch(rows)

    def finder(batches):
        for bucket, t in grouped(batches, "route"):
            if bucket < 0:  # settled in a slice: handed on
                yield batch([(-1 - bucket, 1, x) for x in t.column("blob").to_pylist()])
                continue
            rows = [(b, 1, x) for b, x in _find(t.column("blob").to_pylist()).blobs(layout)]
            if rows:
                yield batch(rows)

    sent = docs.where("doc_id is not null").mapInArrow(lean(sender), schema)
    route = F.when(F.col("side") == 0, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    dealt = sent.select(route.alias("route"), "blob").repartition(spans.tasks(layout.records), "route").sortWithinPartitions("route")
    told = cut(dealt.mapInArrow(lean(finder), schema).select("bucket", "blob"), "told")

    def tracer(batches):
        for _, t in grouped(batches, "bucket"):
            some = t.column("blob").is_valid().to_numpy()
            texts = t.filter(pa.array(~some))
            found = Told.of(t.column("blob").filter(pa.array(some)).to_pylist()).settled()
            ids = texts.column("doc_id").to_numpy(zero_copy_only=False)
            for s in tk.slices(texts.column("text"), SLICE_BYTES):
                own = ids[s.first : s.first + len(s)]
                mine = np.isin(found[0], own)
                if mine.any():
                    # Rows that repeat an id in a later slice find nothing left: one of them is traced.
                    yield pa.RecordBatch.from_arrays(_trace(s, own, tuple(x[mine] for x in found), k), [c.split()[0] for c in _TRACED.split(", ")])
                    found = tuple(x[~mine] for x in found)

    keyed = docs.where("doc_id is not null").mapInArrow(lean(spans.key_documents(layout)), "bucket int, doc_id long, text string")
    met = told.select("bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob").unionByName(keyed.withColumn("blob", F.lit(None).cast("binary")))
    met = met.repartition(spans.tasks(layout.documents), "bucket").sortWithinPartitions("bucket")
    return cut(met.mapInArrow(lean(tracer), _TRACED), "traced"), layout


def compacted(rows: DataFrame) -> DataFrame:
    """``path, doc, start, stop``: pieces of owned edges (from ``start``, before ``stop``), and the nonbranching path that each belongs to."""
    nodes = rows.where(F.col("kind") == _NODE).select("node", "doc", F.col("n").alias("seg"), F.col("start").alias("pos"), (F.col("tstart") % 2).alias("goes_in"), F.floor(F.col("tstart") / 2).cast("int").alias("goes_out"))
    w = Window.partitionBy("node")
    met = nodes.withColumns({"many": F.count("*").over(w), "ins": F.sum("goes_in").over(w), "outs": F.sum("goes_out").over(w)}).where("many > 1")
    met = cut(met, "junctions")
    ends = nodes.where("goes_in = 0 or goes_out = 0").select("doc", "seg", "pos")
    branches = met.where("ins > 1 or outs > 1").select("doc", "seg", "pos")
    along = Window.partitionBy("doc", "seg").orderBy("pos")  # within one document
    pieces = ends.union(branches).distinct().withColumn("stop", F.lead("pos").over(along)).where("stop is not null")
    pieces = cut(pieces.select(F.xxhash64("doc", "pos").alias("piece"), "doc", F.col("pos").alias("start"), "stop"), "pieces")
    plain = met.where("ins = 1 and outs = 1")
    before = plain.where("goes_in = 1").select("node", "doc", F.col("pos").alias("stop")).join(pieces, ["doc", "stop"]).select("node", F.col("piece").alias("u"))
    after = plain.where("goes_out = 1").select("node", "doc", F.col("pos").alias("start")).join(pieces, ["doc", "start"]).select("node", F.col("piece").alias("v"))
    path = components(before.join(after, "node").select("u", "v"))
    return pieces.join(path.withColumnRenamed("node", "piece"), "piece", "left").select(F.coalesce("component", "piece").alias("path"), "doc", "start", "stop")


def _composed(left: DataFrame, right: DataFrame, keep: list[str], give: dict[str, str]) -> DataFrame:
    """Where spans of ``left`` point into stretches (doc, start, stop) of ``right``: the common parts.

    ``left`` has doc, start, n, tdoc, tstart and must not point across a border of blocks, ``right`` must not lie across one.
    """
    r = right.select(F.col("doc").alias("rdoc"), F.floor(F.col("start") / BLOCK).cast("int").alias("rblock"), F.col("start").alias("rstart"), F.col("stop").alias("rstop"), *[F.expr(v).alias(f"r_{k}") for k, v in give.items()])
    both = left.withColumn("block", F.floor(F.col("tstart") / BLOCK).cast("int")).join(r, (F.col("tdoc") == F.col("rdoc")) & (F.col("block") == F.col("rblock")))
    low, high = F.greatest("tstart", "rstart"), F.least(F.col("tstart") + F.col("n"), F.col("rstop"))
    both = both.withColumns({"_low": low, "_high": high}).where("_low < _high")
    return both.select("doc", (F.col("start") + F.col("_low") - F.col("tstart")).alias("start"), (F.col("_high") - F.col("_low")).alias("n"), "tdoc", F.col("_low").alias("tstart"), (F.col("_low") - F.col("rstart")).alias("into"), *keep, *[F.col(f"r_{k}").alias(k) for k in give])


def placed(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``path, doc, start, n, sdoc, sstart``: every span of repeated edges on its path, and where its words are to be compared."""
    span = rows.where(F.col("kind") <= _COPY_IN_SLICE).select("kind", "doc", "start", "n", "tdoc", "tstart")
    owned, copies = span.where(F.col("kind") == _OWNED), span.where(F.col("kind") == _COPY).drop("kind")
    # A copy that only its slice knows points at the first of the slice; where that points, it points.
    home = copies.unionByName(owned.select("doc", "start", "n", F.col("doc").alias("tdoc"), F.col("start").alias("tstart")))
    near = _composed(span.where(F.col("kind") == _COPY_IN_SLICE), home.withColumn("stop", F.col("start") + F.col("n")), [], {"hdoc": "tdoc", "hstart": "tstart"})
    near = near.select("doc", "start", "n", F.col("hdoc").alias("tdoc"), (F.col("hstart") + F.col("into")).alias("tstart"))
    block = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK)))
    path = paths.withColumn("block", block).select("path", "doc", F.greatest("start", F.col("block") * BLOCK).cast("int").alias("start"), F.least("stop", (F.col("block") + 1) * BLOCK).cast("int").alias("stop"))
    others = _composed(copies.unionByName(near), path, [], {"path": "path"}).select("path", "doc", "start", "n", F.col("tdoc").alias("sdoc"), F.col("tstart").alias("sstart"))
    own = owned.select("doc", "start", "n", F.col("doc").alias("tdoc"), F.col("start").alias("tstart"), F.col("tdoc").alias("wdoc"), (F.col("tstart") - F.col("start")).alias("shift"))
    own = _composed(own, path, ["wdoc", "shift"], {"path": "path"}).select("path", "doc", "start", "n", F.col("wdoc").alias("sdoc"), (F.col("start") + F.col("shift")).alias("sstart"))
    return others.unionByName(own)


def paths(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """``path, n_words, n_places, doc_id, start``: each nonbranching path of repeated windows: its words, the documents' spans on it, and its first source."""
    docs, _, names = spans.told_apart(docs)
    rows, _ = traced(docs, k)
    pieces = cut(compacted(rows), "paths")
    size = pieces.groupBy("path").agg((F.sum(F.col("stop") - F.col("start")) + k - 1).cast("long").alias("n_words"), F.min(F.struct("doc", "start")).alias("source"))
    places = placed(rows, pieces).groupBy("path").agg(F.count("*").alias("n_places"))
    return spans.named(size.join(places, "path").select("path", "n_words", "n_places", F.col("source.doc").alias("doc_id"), F.col("source.start").alias("start")), names)


def remove_repeated(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` after every word under a window that occurs more than once is removed."""
    docs, _, names = spans.told_apart(docs)
    rows, layout = traced(docs, k)
    found = placed(rows, cut(compacted(rows), "paths"))
    labels = rows.where(F.col("kind") == _LABEL).select(F.col("doc").alias("sdoc"), F.col("start").alias("block"), "label")  # one of each block
    asked = found.withColumn("block", F.floor(F.col("sstart") / BLOCK).cast("int")).join(labels, ["sdoc", "block"])
    words = F.slice(F.split("label", " "), F.col("sstart") % BLOCK + 1, F.col("n") + (k - 1))
    checks = cut(asked.select("doc", "start", "n", F.unhex(F.sha2(F.array_join(words, " ").cast("binary"), 256)).alias("digest")).mapInArrow(lean(_to_buckets(layout)), "bucket int, doc long, start int, n int, digest binary"), "checks")

    def finisher(batches):
        for _, t in grouped(batches, "bucket"):
            some = t.column("digest").is_valid().to_numpy()
            asked, texts = t.filter(pa.array(some)), t.filter(pa.array(~some))
            if not texts.num_rows:
                continue
            doc, start, n = (asked.column(c).to_numpy() for c in ("doc_id", "start", "n"))
            digest = asked.column("digest").to_pylist()
            by = np.argsort(doc, kind="stable")
            doc, start, n = doc[by], start[by].tolist(), n[by].tolist()
            ids = texts.column("doc_id").to_pylist()
            for s in tk.slices(texts.column("text"), SLICE_BYTES):
                own = ids[s.first : s.first + len(s)]
                sizes, removed, digests = [], [], []
                for i, d in enumerate(own):
                    words = s.raw(i).split()
                    a, z = (0, 0) if d is None else np.searchsorted(doc, [d, d + 1])
                    gone = np.zeros(len(words) + 1, np.int64)
                    for j in range(a, z):
                        p, q = start[j], start[j] + n[j] + k - 1
                        if hashlib.sha256(b" ".join(words[p:q])).digest() == digest[by[j]]:
                            gone[p] += 1
                            gone[q] -= 1
                    mask = np.cumsum(gone)[:-1] > 0
                    kept = [w for w, g in zip(words, mask.tolist()) if not g] if z > a else words
                    sizes.append(len(words))
                    removed.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    keyed = docs.select("doc_id", "text").mapInArrow(lean(spans.key_documents(layout)), "bucket int, doc_id long, text string")
    none = {"start": F.lit(None).cast("int"), "n": F.lit(None).cast("int"), "digest": F.lit(None).cast("binary")}
    met = checks.withColumnRenamed("doc", "doc_id").withColumn("text", F.lit(None).cast("string")).unionByName(keyed.withColumns(none))
    met = met.repartition(spans.tasks(layout.documents), "bucket").sortWithinPartitions("bucket")
    return spans.named(met.mapInArrow(lean(finisher), "doc_id long, n_words long, n_removed long, kept_sha256 string"), names)


def _to_buckets(layout: spans.Layout):
    def run(batches):
        for b in batches:
            key = spans.doc_bucket(b.column("doc").to_numpy(), layout.documents)
            yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], ["bucket", "doc", "start", "n", "digest"])

    return run


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as w from documents),
win as (select doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) as h from (select doc_id, w, unnest(generate_series(1, len(w) - 34)) as i from w where len(w) >= 35)),
rep as (select doc_id, i from win where h in (select h from win group by h having count(*) > 1)),
gone as (select distinct doc_id, unnest(generate_series(i, i + 34)) as p from rep),
flat as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as p from w),
kept as (select f.doc_id, string_agg(word, ' ' order by f.p) as t from flat f left join gone g on f.doc_id = g.doc_id and f.p = g.p where g.p is null group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id left join n on n.doc_id = w.doc_id
"""
