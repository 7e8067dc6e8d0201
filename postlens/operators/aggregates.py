"""Market aggregates over posting frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.sources.files import save


def _order(spec: str) -> Column:
    name, *rest = spec.split()
    return F.col(name).desc() if rest == ["desc"] else F.col(name).asc()


def top_per_group(df: DataFrame, groups: list[str], order: list[str], k: int) -> DataFrame:
    """First ``k`` rows of each group with their ``rank``. The limit reaches the map side (window group limit)."""
    w = Window.partitionBy(*groups).orderBy(*map(_order, order))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """``column, value, n, rank``: the ``k`` commonest values of each column, counted in one pass."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_v")).select("_v.*").where("value is not null")
    return top_per_group(each.groupBy("column", "value").agg(F.count("*").alias("n")), ["column"], ["n desc", "value"], k)


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, value, n``: the rows of each value, written once in order of ``by`` and value, with the number of the part that holds them."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return save(n.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "counted")


def quantiles(values: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``by`` and the exact quantiles ``at`` (name -> share, between neighbours in proportion) of ``counted`` rows; nulls do not count.

    Only parts' totals are brought together: a group's values stay in their parts, so no task holds a group.
    """
    values = values.where(F.col(value).isNotNull())
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])
    part = values.groupBy(*by, "_part").agg(F.sum("n").alias("_in"))
    group = Window.partitionBy(*by)
    part = part.withColumns({"_all": F.sum("_in").over(group), "_before": F.sum("_in").over(group.orderBy("_part")) - F.col("_in")})
    # Parts that hold the ranks on both sides of a quantile.
    ranks = {k: (F.floor((F.col("_all") - 1) * q), F.ceil((F.col("_all") - 1) * q), (F.col("_all") - 1) * F.lit(q)) for k, q in at.items()}
    held = lambda r, first, n: (first <= r) & (r < first + n)
    some = part.where(reduce(lambda a, b: a | b, [held(r, F.col("_before"), F.col("_in")) for low, high, _ in ranks.values() for r in (low, high)]))
    near = values.alias("v").join(F.broadcast(some).alias("p"), same("v", "p") & (F.col("v._part") == F.col("p._part"))).select("v.*", "p._all", "p._before")
    placed = near.withColumn("_first", F.col("_before") + F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(value)) - F.col("n"))
    ends = [F.max(F.when(held(r, F.col("_first"), F.col("n")), F.col(value))).alias(f"{k}_{i}") for k, two in ranks.items() for i, r in enumerate(two[:2])]
    both = placed.groupBy(*by).agg(F.max("_all").alias("_all"), *ends)
    between = lambda k: F.when(F.col(f"{k}_0") == F.col(f"{k}_1"), F.col(f"{k}_0")).otherwise((ranks[k][1] - ranks[k][2]) * F.col(f"{k}_0") + (ranks[k][2] - ranks[k][0]) * F.col(f"{k}_1"))
    return both.select(*by, *[between(k).alias(k) for k in at])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, mean, stddev, least, q1, median, q3, most`` of numbers; the quarters come from counted values in parts (``quantiles``)."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_v")).select("_v.*").where("value is not null")
    plain = each.groupBy("column").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("stddev"), F.min("value").alias("least"), F.max("value").alias("most"))
    quarters = quantiles(counted(each, ["column"], "value"), ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rounded = quarters.select("column", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])
    return plain.join(rounded, "column").select("column", "n", "mean", "stddev", "least", "q1", "median", "q3", "most")


def skill_by_region(skills: DataFrame, jobs: DataFrame) -> DataFrame:
    return skills.select("job_id", "skill").distinct().join(jobs.select("job_id", "country"), "job_id").groupBy("country", "skill").agg(F.count("*").alias("n"))


def with_usd(jobs: DataFrame) -> DataFrame:
    low, high = T.to_usd(F.col("salary_min"), F.col("currency")), T.to_usd(F.col("salary_max"), F.col("currency"))
    return jobs.withColumns({"usd_min": low, "usd_max": high, "usd_mid": F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(low, high))})


def salary_columns() -> list[Column]:
    paid = F.when(F.col("usd_mid") > 0, F.col("usd_mid"))
    quantile = lambda q: F.round(F.percentile(paid, F.lit(q)), 1)
    return [
        F.count("*").alias("total"), F.count(paid).alias("with_salary"), F.round(F.min(paid), 1).alias("salary_min"), F.round(F.max(paid), 1).alias("salary_max"),
        F.round(F.avg(paid), 1).alias("salary_mean"), quantile(0.5).alias("salary_median"), quantile(0.25).alias("q25"), quantile(0.75).alias("q75"),
    ]


def salaries(rows: DataFrame, by: list[str]) -> DataFrame:
    """What ``salary_columns`` tells of ``rows`` (``by``, ``usd_mid``), from counted values in parts: for groups of any size."""
    values = counted(rows.select(*by, F.when(F.col("usd_mid") > 0, F.col("usd_mid")).alias("_paid")), by, "_paid")
    n, paid = F.col("n"), F.col("_paid")
    plain = values.groupBy(*by).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(paid.isNotNull(), n)), F.lit(0)).alias("with_salary"), F.round(F.min(paid), 1).alias("salary_min"), F.round(F.max(paid), 1).alias("salary_max"),
        F.round(F.sum(paid * n) / F.sum(F.when(paid.isNotNull(), n)), 1).alias("salary_mean"),
    )
    at = quantiles(values, by, "_paid", {"salary_median": 0.5, "q25": 0.25, "q75": 0.75})
    same = reduce(lambda x, y: x & y, [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by])
    return plain.alias("s").join(at.alias("q"), same, "left").select("s.*", *[F.round(c, 1).alias(c) for c in ("salary_median", "q25", "q75")])


def segments(df: DataFrame, names: list[str], columns: list[Column]) -> DataFrame:
    """The same aggregates overall and by each of ``names``, in one pass of grouping sets."""
    grouped = df.groupingSets([[], *[[n] for n in names]], *names).agg(F.grouping_id().alias("_g"), *columns)
    k = len(names)
    kind, value = F.lit("overall"), F.lit("ALL")
    for i, n in enumerate(names):
        mine = F.col("_g") == (1 << k) - 1 - (1 << (k - 1 - i))
        kind, value = F.when(mine, F.lit(n)).otherwise(kind), F.when(mine, F.col(n)).otherwise(value)
    rest = [c for c in grouped.columns if c not in {*names, "_g"}]
    return grouped.select(kind.alias("segment_type"), value.alias("segment"), *rest)


def remote_columns() -> list[Column]:
    mode = F.lower(F.coalesce(F.col("work_mode"), F.lit("")))
    n = lambda m: F.count(F.when(mode == m, 1))
    return [
        n("remote").alias("remote"), n("hybrid").alias("hybrid"), F.count(F.when(mode.isin("onsite", "on-site"), 1)).alias("on_site"),
        F.count(F.when(~mode.isin("remote", "hybrid", "onsite", "on-site"), 1)).alias("not_specified"), F.count("*").alias("total"),
        F.round(n("remote") * 100.0 / F.count("*"), 2).alias("remote_pct"),
    ]


def share(df: DataFrame, by: str, digits: int = 1) -> DataFrame:
    """Rows and percent of the total of each value; the total is one row that meets the groups again."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("_all")))).select(by, "n", F.round(F.col("n") * 100.0 / F.col("_all"), digits).alias("pct"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and percent of each column, from one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]))
    return one.select(pairs.alias("p"), "_n").select("p.column", "p.nulls", F.round(F.col("p.nulls") * 100.0 / F.col("_n"), 2).alias("null_pct"))


def monthly(df: DataFrame, date: str, groups: list[str]) -> DataFrame:
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("month"), *groups).agg(F.count("*").alias("n"))


def decompose(daily: DataFrame, horizon: int = 14) -> DataFrame:
    """Classical additive decomposition of a gap-filled daily series ``(day, n)`` with a weekly season, and a seasonal-naive forecast.

    The series has one row for each day, so the unpartitioned frame below holds days, not events.
    """
    around = Window.orderBy("day").rowsBetween(-3, 3)
    trend = F.when(F.count("n").over(around) == 7, F.avg("n").over(around))
    t = daily.withColumn("trend", trend).withColumn("weekday", F.weekday("day") + 1)
    season = t.where("trend is not null").groupBy("weekday").agg(F.avg(F.col("n") - F.col("trend")).alias("seasonal"))
    fitted = t.join(F.broadcast(season), "weekday")
    last = t.where("trend is not null").agg(F.max_by("trend", "day").alias("level")).crossJoin(t.agg(F.max("day").alias("end")))
    ahead = last.select("level", F.explode(F.expr(f"sequence(date_add(end, 1), date_add(end, {horizon}))")).alias("day")).withColumn("weekday", F.weekday("day") + 1).join(F.broadcast(season), "weekday")
    r = lambda c: F.round(c, 4)
    past = fitted.select("day", F.lit("observed").alias("kind"), r(F.col("n").cast("double")).alias("value"), r("trend").alias("trend"), r("seasonal").alias("seasonal"), r(F.col("n") - F.col("trend") - F.col("seasonal")).alias("residual"))
    future = ahead.select("day", F.lit("forecast").alias("kind"), r(F.col("level") + F.col("seasonal")).alias("value"), r("level").alias("trend"), r("seasonal").alias("seasonal"), F.lit(None).cast("double").alias("residual"))
    return past.unionByName(future)
