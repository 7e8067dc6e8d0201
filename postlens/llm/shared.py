"""Shared-storage helpers: cutting lineage, packed binary rows, and streaming over groups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode (tests) one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-postlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs survive the loss of an executor without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postlens/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the table is whole then: its shuffle files can go
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a range partition.
RANGE_ROWS = 200_000


def ranked(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``_rank`` (from 0) of each row among those of equal keys, and their number ``_total``."""
    parts = max(1, -(-nodes.count() // RANGE_ROWS))
    by = [*keys, *order, "_row"]
    dealt = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_row")
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return placed.join(runs, same).select(*nodes.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_rank"), "_total")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound Arrow batches by rows and by bytes (a batch of whole texts may be large), so that Python workers stay small."""
    arrow = "spark.sql.execution.arrow."
    if not 0 < int(spark.conf.get(f"{arrow}maxRecordsPerBatch")) <= rows:
        spark.conf.set(f"{arrow}maxRecordsPerBatch", rows)
    spark.conf.set(f"{arrow}maxBytesPerBatch", size)


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives unused memory back to the system when its task ends: Spark keeps the worker for later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = _trim()
        if trim:
            trim(0)

    return whole


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()
    return n, size


def pack(*columns: np.ndarray) -> bytes:
    """Equal-length numeric columns as one compressed blob."""
    head = np.array([len(columns), len(columns[0]) if columns else 0], np.int64).tobytes()
    kinds = b"".join(c.dtype.str.encode().ljust(4) for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(raw, np.int64, 2).tolist()
    out, at = [], 16 + 4 * k
    for i in range(k):
        kind = np.dtype(raw[16 + 4 * i : 20 + 4 * i].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Consecutive rows of equal ``key``, across batches (the partition must be sorted by it)."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(k[1:] != k[:-1]) + 1
        for i, j in zip(np.append(0, edges), np.append(edges, len(k))):
            if held and k[i] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = k[i].item()
            held.append(b.slice(i, j - i))
    if held:
        yield current, pa.Table.from_batches(held)
