"""Structured Streaming forms of the incremental posting work."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlens.sources.files import work_dir


def source(spark: SparkSession, df: DataFrame, files: int = 4, order: str = "ts") -> DataFrame:
    """``df`` as a stream of files in ranges of ``order``, one file a trigger, in order."""
    cuts = df.agg(F.percentile_approx(order, [k / files for k in range(1, files)])).first()[0] or []
    part = sum(((F.col(order) > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return in_order(spark, df.withColumn("_file", part), "_file", df.columns)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote.

    Every batch goes to a folder of its own number, overwritten if the batch is repeated, so a restart
    neither loses nor doubles rows. In complete mode the last folder is the result.
    """
    spark = stream.sparkSession
    path = f"{work_dir(spark)}/sink-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    out = spark.read.parquet(path)
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


def once_per_id(stream: DataFrame, key: str, ts: str, delay: str = "40 days") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str, width: str, by: list[str], slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("start"), *by, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    return stream.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("string").alias("start"), "n")


def upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """Hand each batch once to ``apply(batch, number)``; with the ``checkpoint`` of an earlier run it goes on where that ended."""
    checkpoint = checkpoint or f"{work_dir(stream.sparkSession)}/upsert-{uuid.uuid4().hex}"
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


#: Buckets of an upsert store: a batch rewrites those that its keys fall into.
BUCKETS = 64


def keep_newest(path: str, key: str, order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the newest row (by ``order``) of each key in ``path``.

    The store is dealt to buckets by a hash of the key. A batch reads and writes only the buckets it touches, as
    ``data/version=<batch>/bucket=<b>``, and commits by a manifest of all buckets' versions, ``manifest/batch=<batch>``, which is
    written last: a reader sees a batch whole or not at all. The store before a batch is the newest manifest of a smaller number, found
    on disk: a restart goes on from it, and a batch that is repeated overwrites its own version. See ``vacuum`` for what is replaced.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
        versions = _versions(spark, path, number) if number else {}
        known = dealt.select(*columns, "bucket")
        held = [f"{path}/data/version={versions[b]}/bucket={b}" for b in touched if b in versions]
        if held:
            old = spark.read.schema(batch.schema).option("basePath", f"{path}/data").parquet(*held).select(*columns)
            known = known.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        rest = [c for c in columns if c != key and c not in order]
        # Files come in any order: the newest row by event time wins, whichever batch brings it.
        one = known.groupBy("bucket", key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(*[F.col(c) if c == key else F.col(f"x.{c}") for c in columns], "bucket")
        if touched:
            one.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
        now = sorted((versions | dict.fromkeys(touched, number)).items())
        spark.createDataFrame(now, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
        dealt.unpersist()

    return apply


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> version of the newest manifest (of a batch before ``before``)."""
    every = spark.read.schema("bucket int, version long, batch long").parquet(f"{path}/manifest")
    every = every if before is None else every.where(F.col("batch") < before)
    newest = every.agg(F.max("batch")).first()[0]
    return {} if newest is None else {r.bucket: r.version for r in every.where(F.col("batch") == newest).collect()}


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What ``keep_newest`` has in ``path`` now."""
    held = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(_versions(spark, path).items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*held).drop("version", "bucket")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete what none of the newest ``keep`` manifests refers to, and older manifests; how many folders went. No batch may run meanwhile."""
    every = spark.read.schema("bucket int, version long, batch long").parquet(f"{path}/manifest")
    numbers = [r[0] for r in every.select("batch").distinct().orderBy(F.desc("batch")).collect()]
    live = {(r.version, r.bucket) for r in every.where(F.col("batch").isin(numbers[:keep])).collect()}
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f"{path}/manifest/batch={n}" for n in numbers[keep:]]
    for version in fs.listStatus(jvm(f"{path}/data")):
        n = int(version.getPath().getName().split("=")[1])
        names = [x.getPath().getName() for x in fs.listStatus(version.getPath())]
        gone += [f"{path}/data/version={n}/{b}" for b in names if b.startswith("bucket=") and n <= max(numbers) and (n, int(b.split("=")[1])) not in live]
    for folder in gone:
        fs.delete(jvm(folder), True)
    return len(gone)


class Progress(StreamingQueryListener):
    """Totals of each run of a stream: rows read, and rows that stateful operators dropped as too late."""

    def __init__(self) -> None:
        self.read: dict[str, int] = {}
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        run, told = str(event.progress.runId), event.progress
        self.read[run] = self.read.get(run, 0) + told.numInputRows
        self.dropped[run] = self.dropped.get(run, 0) + sum(o.numRowsDroppedByWatermark for o in told.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def late(counts: DataFrame, keys: list[str], n: str = "n") -> dict[str, int]:
    """Totals of a windowed count over what is there: ``read`` rows, ``counted`` and ``late`` ones, and ``dropped`` by the watermark as the
    state operator tells it, which sees partial counts: a number of (batch, partition, group), not of rows.

    The stream runs in update mode, so open windows count too: a group's last count is its largest.
    """
    spark, listener = counts.sparkSession, Progress()
    path = f"{work_dir(spark)}/late-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.streams.addListener(listener)
    try:
        query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(put).start()
        run = str(query.runId)
        query.awaitTermination()
        listener.ended.setdefault(run, threading.Event()).wait(60)  # the listener hears of the last batch after the query ends
    finally:
        spark.streams.removeListener(listener)
    counted = spark.read.parquet(path).groupBy(*keys).agg(F.max(n).alias("n")).agg(F.sum("n")).first()[0] or 0
    read = listener.read.get(run, 0)
    return {"read": read, "counted": counted, "late": read - counted, "dropped": listener.dropped.get(run, 0)}


def in_order(spark: SparkSession, df: DataFrame, by: str, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` as a stream of one file for each value of ``by``, written and read in that order."""
    path = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = df.select(*(columns or df.columns))
    for value in [r[0] for r in df.select(by).distinct().orderBy(by).collect()]:  # a few files
        df.where(F.col(by) == value).select(*out.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(out.schema).option("maxFilesPerTrigger", 1).parquet(path)


def expiry(stream: DataFrame, key: str, ts: str, after_ms: int) -> DataFrame:
    """A row ``(key, last_ms)`` whenever a key was not seen again within ``after_ms`` of event time.

    Gaps inside a batch count as well as those that the watermark ends; a key's state is one time.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_ms": [last]})
            return
        seen = sorted(t.value // 1_000_000 for f in frames for t in f[ts])  # whole milliseconds
        times = ([state.get[0]] if state.exists else []) + seen
        gone = [a for a, b in zip(times, times[1:]) if b - a > after_ms]
        last = max(times)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + after_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(gone), "last_ms": gone})

    return stream.withWatermark(ts, "1 hour").groupBy(key).applyInPandasWithState(run, f"{key} long, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
