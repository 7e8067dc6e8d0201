"""Shared frame of the exact repeat removers.

A remover sends packed records to hashed buckets; each bucket finds repeats among its records and
answers with word or byte ranges, packed by bucket of documents; the answers and the documents meet
in one shuffle, where the ranges are merged. Records and answers are compressed blobs of numpy
columns, so a shuffle costs bytes, not rows; buckets are sized by the text, so a task's memory stays
bounded; and each slice of text sends equal records once, so a passage in a third of all documents
costs a record for each slice, not for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import textkit as tk
from postlens.llm.shared import cut, grouped, lean, pack, ranked, small_batches, text_bytes, unpack

#: Text for each bucket of documents.
GROUP_BYTES = 2 << 20
GROUP_DOCS = 2000
_RECORDS, _ANSWERS = 0, 1


@dataclass(frozen=True)
class Layout:
    #: Buckets of records, and of documents.
    records: int
    documents: int


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(ids.astype(np.int64).view(np.uint64).copy()) % np.uint64(n)).astype(np.int32)


def split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each non-empty bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def answers(doc: np.ndarray, start: np.ndarray, end: np.ndarray, layout: Layout, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Ranges of documents, packed by bucket of documents."""
    for b, at in split(doc_bucket(doc, layout.documents), layout.documents):
        at = at[np.lexsort((start[at], doc[at]))]
        d, s = doc[at].astype(np.int64), start[at].astype(np.int32)
        yield b, kind, pack(np.diff(d, prepend=0), np.diff(s, prepend=np.int32(0)), (end[at] - start[at]).astype(np.int32))


def _ranges(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [unpack(x) for x in blobs]
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none
    doc = np.concatenate([np.cumsum(p[0]) for p in parts])
    start = np.concatenate([np.cumsum(p[1], dtype=np.int32) for p in parts]).astype(np.int64)
    return doc, start, start + np.concatenate([p[2] for p in parts])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["bucket", "kind", "blob"],
    )


def told_apart(docs: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """``docs(doc_id, text)`` with one text for each id, the bits that tell the texts of one id apart, and the ids' names.

    Nothing changes (0, None) while no id has several texts, by a 64-bit hash. Else each pair of id and text gets a number of its own, which
    ascends with the id; numbers of one id are equal without their lowest ``bits``.
    """
    own = docs.select("doc_id", "text")
    hashed = own.select("doc_id", F.xxhash64("text").alias("_h")).where("doc_id is not null")
    if not hashed.groupBy("doc_id").agg(F.min("_h").alias("a"), F.max("_h").alias("z")).where("a < z").limit(1).count():
        return own, 0, None
    places = ranked(cut(hashed.distinct().withColumn("_all", F.lit(0)), "texts"), ["_all"], ["doc_id", "_h"])
    first = places.groupBy("doc_id").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    bits = int(first.agg(F.max("_n")).first()[0]).bit_length()
    key = F.shiftleft("_first", bits) + F.col("_rank") - F.col("_first")
    names = cut(places.join(first, "doc_id").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_text"), key.alias("_key")), "names")
    met = own.withColumn("_h", F.xxhash64("text")).join(names, (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_text")), "left")
    return met.select(F.col("_key").alias("doc_id"), "text"), bits, names.select("_id", "_key")


def named(found: DataFrame, names: DataFrame | None) -> DataFrame:
    """``found`` with the ids that ``told_apart`` replaced."""
    if names is None:
        return found
    return found.join(names, F.col("doc_id") == F.col("_key"), "left").withColumn("doc_id", F.col("_id")).select(*found.columns)


def remove_repeats(
    docs: DataFrame,
    send: Callable[[tk.Slice, np.ndarray, Layout], Iterator[tuple[int, int, bytes]]],
    find: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]],
    finish: Callable[[tk.Slice, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]],
    columns: str,
    record_bytes: int,
    slice_bytes: int,
) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id`` and ``columns``, for every row.

    An id must name one text (see ``told_apart``); rows that repeat it get the same result. Rows without an id have no ranges.
    A range never reaches beyond its row.

    ``send(slice, ids, layout)`` gives (bucket, 0, blob) records and, through ``answers``, ranges that
    the slice settles itself; ``find(blobs)`` gives the ranges of a bucket (doc, start, end);
    ``finish(slice, row, start, end)`` gets the merged ranges of a slice's rows and makes the columns.
    """
    small_batches(docs.sparkSession)
    n, size = text_bytes(docs)
    layout = Layout(max(4, -(-size // record_bytes)), max(4, -(-size // GROUP_BYTES), -(-n // GROUP_DOCS)))

    def sender(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for s in tk.slices(b.column("text"), slice_bytes):
                rows = list(send(s, ids[s.first : s.first + len(s)], layout))
                if rows:
                    yield _batch(rows)

    def finder(batches):
        for _, t in grouped(batches, "bucket"):
            kinds = t.column("kind").to_numpy()
            blobs = t.column("blob").to_pylist()
            doc, start, end = find([x for x, k in zip(blobs, kinds) if k == _RECORDS])
            rows = list(answers(doc, start, end, layout, _ANSWERS))
            if rows:
                yield _batch(rows)

    sent = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean(sender), "bucket int, kind int, blob binary")
    # What a slice settled itself goes round the buckets with the records and is handed through.
    route = F.when(F.col("kind") == _RECORDS, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    dealt = sent.select(route.alias("bucket"), "kind", "blob").repartition(tasks(layout.records), "bucket").sortWithinPartitions("bucket")

    def found(batches):
        for b in batches:
            own = b.column("bucket").to_numpy()
            through = own < 0
            if through.any():
                t = b.filter(pa.array(through))
                yield pa.RecordBatch.from_arrays([pa.array((-1 - t.column("bucket").to_numpy()).astype(np.int32)), t.column("kind"), t.column("blob")], ["bucket", "kind", "blob"])
            rest = b.filter(pa.array(~through))
            if rest.num_rows:
                yield rest

    def finder_all(batches):
        held: list[pa.RecordBatch] = []

        def records():
            for b in found(batches):
                if b.column("kind")[0].as_py() == _RECORDS:
                    yield b
                else:
                    held.append(b)

        for out in finder(records()):
            yield from held
            held.clear()
            yield out
        yield from held

    told = cut(dealt.mapInArrow(lean(finder_all), "bucket int, kind int, blob binary").select("bucket", "blob"), "ranges")

    keyed = docs.select("doc_id", "text").mapInArrow(lean(key_documents(layout)), "bucket int, doc_id long, text string")
    met = (
        told.select("bucket", F.lit(0).alias("side"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob")
        .unionByName(keyed.select("bucket", F.lit(1).alias("side"), "doc_id", "text", F.lit(None).cast("binary").alias("blob")))
        .repartition(tasks(layout.documents), "bucket").sortWithinPartitions("bucket", "side")
    )

    def finisher(batches):
        for _, t in grouped(batches, "bucket"):
            side = t.column("side").to_numpy()
            k = int((side == 0).sum())
            doc, start, end = _ranges(t.column("blob").slice(0, k).to_pylist())
            own = t.slice(k)
            if not own.num_rows:
                continue
            given = own.column("doc_id").combine_chunks()
            named = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            ids = given.fill_null(0).to_numpy(zero_copy_only=False)
            order = named[np.argsort(ids[named], kind="stable")]
            low, high = (np.searchsorted(ids[order], doc, side) for side in ("left", "right"))
            row = order[tk.ragged(low, high - low)]
            start, end = (np.repeat(x, high - low) for x in (start, end))
            by = np.argsort(row, kind="stable")
            row, start, end = row[by], start[by], end[by]
            for s in tk.slices(own.column("text"), slice_bytes):
                a, z = np.searchsorted(row, [s.first, s.first + len(s)])
                mine = row[a:z] - s.first
                if (end[a:z] > np.diff(s.offs)[mine]).any():
                    raise ValueError("a range reaches beyond its text")
                made = finish(s, mine, start[a:z], end[a:z])
                yield pa.RecordBatch.from_arrays([given.slice(s.first, len(s)), *made], ["doc_id", *[c.split()[0] for c in columns.split(", ")]])

    return met.mapInArrow(lean(finisher), f"doc_id long, {columns}")


def tasks(buckets: int) -> int:
    """Partitions for so many buckets, whatever the session's default is."""
    return max(4, -(-buckets // 2))


def key_documents(layout: Layout):
    """Documents with their bucket; those without an id go anywhere."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            key = doc_bucket(ids.fill_null(0).to_numpy(zero_copy_only=False), layout.documents)
            lost = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            key[lost] = (lost * 7919) % layout.documents
            yield pa.RecordBatch.from_arrays([pa.array(key), ids.cast(pa.int64()), b.column("text").cast(pa.string())], ["bucket", "doc_id", "text"])

    return run


def covered(total: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``total`` places lie in one of the ranges."""
    start, end = np.minimum(start, total), np.minimum(end, total)
    step = np.bincount(start, minlength=total + 1) - np.bincount(end, minlength=total + 1)
    return np.cumsum(step)[:total] > 0
