"""Streams over the status events, and their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.sources.files import work_dir
from postlens.sources.fixtures import posting_events
from postlens.streaming import jobs

QUERIES: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = (run, sql)


def _stream(s, d, *columns):
    return jobs.source(s, posting_events(s, d).select(*columns))


_add("t1_stream_ingest", lambda s, d: jobs.drain(_stream(s, d, "event_id", "ts", "status").select("event_id", F.lower("status").alias("status"))), "select event_id, lower(status) as status from posting_events")


def _t2(s, d):
    e = posting_events(s, d).select("event_id", "ts")
    return jobs.drain(jobs.once_per_id(jobs.source(s, e.unionByName(e.where("event_id % 3 = 0"))), "event_id", "ts").select("event_id"))


_add("t2_once_per_id", _t2, "select event_id from posting_events")


def _t3(s, d):
    path = f"{work_dir(s)}/store-{uuid.uuid4().hex}"
    e = posting_events(s, d).select("job_id", "ts", "event_id", "status")
    jobs.upserts(jobs.source(s, e), jobs.keep_newest(path, "job_id", ["ts", "event_id"], 16)).awaitTermination()
    return jobs.stored(s, path).select("job_id", "status")


_add("t3_upsert_sink", _t3, "select job_id, arg_max(status, (ts, event_id)) as status from posting_events group by 1")
_add("t4_tumbling", lambda s, d: jobs.drain(jobs.tumbling(_stream(s, d, "ts", "event_type"), "ts", "1 day", ["event_type"]), "complete"), "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from posting_events group by 1, 2")
_add("t5_sliding", lambda s, d: jobs.drain(jobs.tumbling(_stream(s, d, "ts", "status"), "ts", "7 days", ["status"], "1 day"), "complete"), "select strftime(date_trunc('day', ts) - to_days(k::int), '%Y-%m-%d %H:%M:%S') as start, status, count(*) as n from posting_events, generate_series(0, 6) g(k) group by 1, 2")
_add("t6_weekly_counts", lambda s, d: jobs.drain(_stream(s, d, "ts", "status").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "status").agg(F.count("*").alias("n")), "complete"), "select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, status, count(*) as n from posting_events group by 1, 2")
_add("t7_stale_batch", lambda s, d: (lambda e: e.groupBy("job_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("end")))).select("job_id", (F.col("last") < F.col("end") - F.expr("interval 5 days")).alias("removed")))(posting_events(s, d)), "select job_id, max(ts) < (select max(ts) - interval 5 days from posting_events) as removed from posting_events group by 1")
# A gap of more than eight hours, or nothing for eight hours before the watermark (an hour behind the newest event).
_add("t7_stale_stream", lambda s, d: jobs.drain(jobs.expiry(_stream(s, d, "job_id", "ts"), "job_id", "ts", 8 * 3_600_000)), """select job_id, ms as last_ms from (select job_id, ms, lead(ms) over (partition by job_id order by ms) as next from (select job_id, epoch_us(ts) // 1000 as ms from posting_events)) where next - ms > 28800000
union all select job_id, max(epoch_us(ts) // 1000) from posting_events group by 1 having max(epoch_us(ts) // 1000) + 28800000 < (select max(epoch_us(ts) // 1000) - 3600000 from posting_events)""")
_add("t8_status_changes", lambda s, d: (lambda e: e.withColumn("before", F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))).where("before is null or before <> status").select("event_id", "job_id", "status"))(posting_events(s, d)), "select event_id, job_id, status from (select *, lag(status) over (partition by job_id order by ts, event_id) as before from posting_events) where before is null or before <> status")
_add("t9_first_seen", lambda s, d: jobs.drain(_stream(s, d, "job_id", "ts").groupBy("job_id").agg(F.min("ts").cast("string").alias("first")), "complete").select("job_id", F.substring("first", 1, 19).alias("first")), "select job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first from posting_events group by 1")
_add("t10_sessions", lambda s, d: jobs.drain(jobs.sessions(_stream(s, d, "job_id", "ts"), "ts", "job_id"), "complete").select("job_id", F.substring("start", 1, 19).alias("start"), "n"), "select job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (select *, sum(new) over (partition by job_id order by ts, event_id) as k from (select *, case when lag(ts) over (partition by job_id order by ts, event_id) > ts - interval 30 minutes then 0 else 1 end as new from posting_events)) group by job_id, k")


def _overlapping(s, d):
    """Daily counts of four files that each cover all days: rows more than two days behind what was seen two files before are dropped."""
    e = posting_events(s, d).select("ts", "event_type", (F.col("event_id") % 4).alias("file"))
    days = jobs.in_order(s, e, "file").withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.col("w.start").cast("string").alias("start"), "event_type", "n")


# A batch drops by the watermark that the batch before it ended days with, so dropping begins with the third file.
_DAYS = """(select date_trunc('day', ts) as day, event_type, event_id % 4 as file, (select max(ts) - interval 2 days from posting_events where event_id % 4 = 0) as w1,
    (select max(ts) - interval 2 days from posting_events where event_id % 4 < 2) as w2, (select max(ts) - interval 2 days from posting_events) as w4 from posting_events)"""
_IN_TIME = "(file < 2 or file = 2 and day + interval 1 day > w1 or file = 3 and day + interval 1 day > w2)"
_add("t11_late_rows", lambda s, d: jobs.drain(_overlapping(s, d)), f"select strftime(day, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from {_DAYS} where day + interval 1 day <= w4 and {_IN_TIME} group by 1, 2")
# Each file is a batch of one partition, so what the state operator drops are its groups.
_add("t11_dropped", lambda s, d: s.createDataFrame(sorted(jobs.late(_overlapping(s, d), ["start", "event_type"]).items()), "metric string, value long"), f"""select unnest(['read', 'counted', 'late', 'dropped']) as metric, unnest([count(*), count(*) filter (where {_IN_TIME}), count(*) filter (where not {_IN_TIME}),
  count(distinct (file, day, event_type)) filter (where not {_IN_TIME})]) as value from {_DAYS}""")
