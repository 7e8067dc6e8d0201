"""Market aggregates, windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import aggregates as A
from postlens.sources.fixtures import posting_events, posting_skills, posting_text, postings, table

QUERIES: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = (run, sql)


_RATE = "case currency when 'EUR' then 1.10::double when 'KES' then 0.0078::double else 1.0::double end"
_USD = f"(select *, (salary_min * {_RATE} + salary_max * {_RATE}) / 2 as mid from postings)"
_STATS = "count(*) as total, count(mid) as with_salary, round(min(mid), 1) as salary_min, round(max(mid), 1) as salary_max, round(avg(mid), 1) as salary_mean, round(quantile_cont(mid, 0.5), 1) as salary_median, round(quantile_cont(mid, 0.25), 1) as q25, round(quantile_cont(mid, 0.75), 1) as q75"
_REMOTE = "count(*) filter (where work_mode = 'remote') as remote, count(*) filter (where work_mode = 'hybrid') as hybrid, count(*) filter (where work_mode = 'onsite') as on_site, 0::bigint as not_specified, count(*) as total, round(count(*) filter (where work_mode = 'remote') * 100.0::double / count(*), 2) as remote_pct"


def _sets(columns: str, source: str) -> str:
    return f"select 'overall' as segment_type, 'ALL' as segment, {columns} from {source} union all select 'country', country, {columns} from {source} group by country union all select 'seniority', seniority, {columns} from {source} group by seniority"


_PAIRS = "(select distinct job_id, skill from posting_skills)"
_add("a1_skill_region", lambda s, d: A.skill_by_region(posting_skills(s, d), postings(s, d)), f"select country, skill, count(*) as n from {_PAIRS} join postings using (job_id) group by 1, 2")
_add("a1_w4_top_skills", lambda s, d: A.top_per_group(A.skill_by_region(posting_skills(s, d), postings(s, d)), ["country"], ["n desc", "skill"], 10), f"select * from (select country, skill, count(*) as n, cast(row_number() over (partition by country order by count(*) desc, skill) as int) as rank from {_PAIRS} join postings using (job_id) group by 1, 2) where rank <= 10")
_BUCKET = "case when years_experience = 0 then 'Not specified' when years_experience < 3 then '1-3 years' when years_experience < 5 then '3-5 years' when years_experience < 10 then '5-10 years' else '10+ years' end"
_CATEGORIES = "(select distinct job_id, category from posting_skills)"


def _by_category(s, d, jobs):
    """Postings once for each skill category that they ask for."""
    return jobs.join(posting_skills(s, d, True).select("job_id", "category").distinct(), "job_id")


def _segments(s, d, jobs, columns):
    """Overall, by country, by seniority (one pass) and by skill category."""
    per = _by_category(s, d, jobs).groupBy(F.col("category").alias("segment")).agg(*columns).select(F.lit("skill_category").alias("segment_type"), "*")
    return A.segments(jobs, ["country", "seniority"], columns).unionByName(per)


def _sets_and_category(columns, source):
    return f"{_sets(columns, source)} union all select 'skill_category', category, {columns} from {source} join {_CATEGORIES} using (job_id) group by category"




def _a2(s, d):
    """A posting counts overall, for its country and level, and for each skill category that it asks for."""
    jobs = A.with_usd(postings(s, d))
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("segment_type"), v.alias("segment")) for k, v in (("overall", F.lit("ALL")), ("country", F.col("country")), ("seniority", F.col("seniority")))])).alias("_s")
    per = _by_category(s, d, jobs.select("job_id", "usd_mid")).select(F.lit("skill_category").alias("segment_type"), F.col("category").alias("segment"), "usd_mid")
    return A.salaries(jobs.select(own, "usd_mid").select("_s.*", "usd_mid").unionByName(per), ["segment_type", "segment"])


_add("a2_salary_distribution", _a2, _sets_and_category(_STATS, _USD))
# One posting in seven tells in its text that it is open to the continent.


def _told():
    return F.when(F.col("job_id") % 7 == 0, "pan-African team")


_OPEN = "round(count(*) filter (where work_mode = 'remote' or job_id % 7 = 0) * 100.0::double / count(*), 2) as pan_african_pct"
_pan = lambda: F.round(F.count(F.when(T.is_pan_african(F.col("work_mode"), _told()), 1)) * 100.0 / F.count("*"), 2).alias("pan_african_pct")
_add("a3_remote_trends", lambda s, d: _segments(s, d, postings(s, d), [*A.remote_columns(), _pan()]), _sets_and_category(f"{_REMOTE}, {_OPEN}", "postings"))


def _a4(s, d):
    """Each level that occurs with its first ten categories, salaries and years of experience."""
    p, k = A.with_usd(postings(s, d)), posting_skills(s, d).select("job_id", "category").distinct()
    counted = k.join(p.select("job_id", "seniority"), "job_id").groupBy("seniority", "category").agg(F.count("*").alias("rows"))
    years = p.groupBy("seniority", T.experience_bucket(F.col("years_experience")).alias("bucket")).agg(F.count("*").alias("n"))
    years = years.groupBy("seniority").agg(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit("="), F.col("n").cast("string")))), "; ").alias("experience"))
    level = p.groupBy("seniority").agg(*A.salary_columns()).withColumnRenamed("total", "level_count").join(years, "seniority")
    return A.top_per_group(counted, ["seniority"], ["rows desc", "category"], 10).join(F.broadcast(level), "seniority")  # a row for each level


_add("a4_career_pathways", _a4, f"""select r.seniority, category, rows, rank, experience, l.* exclude (seniority) from (select seniority, category, count(*) as rows, cast(row_number() over (partition by seniority order by count(*) desc, category) as int) as rank from {_CATEGORIES} join postings using (job_id) group by 1, 2) r
join (select seniority, {_STATS.replace("as total", "as level_count")} from {_USD} group by 1) l on l.seniority = r.seniority
join (select seniority, string_agg(bucket || '=' || n, '; ' order by bucket || '=' || n) as experience from (select seniority, {_BUCKET} as bucket, count(*) as n from postings group by 1, 2) group by 1) e on e.seniority = r.seniority where rank <= 10""")
_add("a5_skills_by_seniority", lambda s, d: posting_skills(s, d).join(postings(s, d).select("job_id", "seniority"), "job_id").groupBy("seniority", "category").agg(F.count("*").alias("n")), "select seniority, category, count(*) as n from posting_skills join postings using (job_id) group by 1, 2")
_CATS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_add("a6_category_by_country", lambda s, d: (lambda p: p.withColumn("total", sum((F.col(c) for c in _CATS), F.lit(0)).cast("bigint")))(postings(s, d).groupBy("country").pivot("tech_category", _CATS).count().na.fill(0)), "select country, " + ", ".join(f"count(*) filter (where tech_category = '{c}') as {c}" for c in _CATS) + ", count(*) filter (where tech_category in (" + ", ".join(f"'{c}'" for c in _CATS) + ")) as total from postings group by 1")
_add("a7_mode_by_category", lambda s, d: (lambda p: p.select("tech_category", "work_mode", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("tech_category")), 1).alias("pct"), "n"))(postings(s, d).groupBy("tech_category", "work_mode").agg(F.count("*").alias("n"))), "select tech_category, work_mode, round(count(*) * 100.0::double / sum(count(*)) over (partition by tech_category), 1) as pct, count(*) as n from postings group by 1, 2")
_add("a8_market_share", lambda s, d: A.share(postings(s, d), "country"), "select country, count(*) as n, round(count(*) * 100.0::double / (select count(*) from postings), 1) as pct from postings group by 1")
_FIELDS = ["company", "country", "work_mode", "seniority", "years_experience", "currency", "salary_min", "salary_max", "date_posted", "tech_category"]
_add("a9_completeness", lambda s, d: postings(s, d).rollup("source").agg(*[F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 1).alias(c) for c in _FIELDS]).withColumn("source", F.coalesce("source", F.lit("ALL"))), "select coalesce(source, 'ALL') as source, " + ", ".join(f"round(avg(({c} is not null)::int) * 100, 1) as {c}" for c in _FIELDS) + " from postings group by rollup (source)")


def _a10(s, d):
    n = F.count("job_id").over(Window.partitionBy("source", "date_posted"))
    p = postings(s, d).select("job_id", "source", "date_posted").withColumn("n", n)
    ok = F.count(F.when(F.col("n") < 5, 1))
    return p.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("date_posted").alias("dates"), F.round(F.count("*") / F.count_distinct("date_posted"), 2).alias("rows_per_date"), ok.alias("trusted"), F.round(ok * 100.0 / F.count("*"), 1).alias("trusted_pct"))


_add("a10_date_reliability", _a10, "select source, count(*) as rows, count(distinct date_posted) as dates, round(count(*)::double / count(distinct date_posted), 2) as rows_per_date, count(*) filter (where n < 5) as trusted, round(count(*) filter (where n < 5) * 100.0::double / count(*), 1) as trusted_pct from (select *, count(job_id) over (partition by source, date_posted) as n from postings) group by 1")
_add("a11_freshness_median", lambda s, d: (lambda p: p.crossJoin(F.broadcast(p.agg(F.date_add(F.max("date_posted"), 1).alias("end")))).groupBy("country").agg(F.percentile(F.datediff("end", "date_posted"), F.lit(0.5)).alias("median_age"), F.count("*").alias("n")).where("n >= 10"))(postings(s, d)), "select country, quantile_cont((select max(date_posted) + 1 from postings) - date_posted, 0.5) as median_age, count(*) as n from postings group by 1 having count(*) >= 10")


def _a11b(s, d):
    from postlens.operators.timeseries import bootstrap_median

    p = postings(s, d)
    aged = p.crossJoin(F.broadcast(p.agg(F.date_add(F.max("date_posted"), 1).alias("end")))).select("job_id", "country", F.datediff("end", "date_posted").alias("age"))
    return bootstrap_median(aged, "country", "age", 2000)


_add("a11_freshness_interval", _a11b)
def _a12(s, d):
    """Of each country: added and removed (30 days after posting) in the last 7 days, available, remote share, first ten skills."""
    p = postings(s, d)
    day = p.agg(F.max("date_posted")).first()[0]
    gone = F.date_add("date_posted", 30)
    one = p.groupBy("country").agg(
        F.count_if(F.col("date_posted") > F.date_sub(F.lit(day), 7)).alias("added"), F.count_if((gone > F.date_sub(F.lit(day), 7)) & (gone <= F.lit(day))).alias("removed"),
        F.count_if(gone > F.lit(day)).alias("available"), F.round(F.avg((F.col("work_mode") == "remote").cast("int")) * 100, 1).alias("remote_pct"))
    top = A.top_per_group(A.skill_by_region(posting_skills(s, d), p), ["country"], ["n desc", "skill"], 10)
    named = top.groupBy("country").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda x: x["skill"]), ",").alias("top_skills"))
    return one.join(named, "country", "left")


_LAST = "(select max(date_posted) from postings)"
_add("a12_market_snapshot", _a12, f"""select country, count(*) filter (where date_posted > {_LAST} - 7) as added, count(*) filter (where date_posted + 30 > {_LAST} - 7 and date_posted + 30 <= {_LAST}) as removed,
  count(*) filter (where date_posted + 30 > {_LAST}) as available, round(avg((work_mode = 'remote')::int) * 100, 1) as remote_pct, any_value(top_skills) as top_skills
from postings left join (select country, string_agg(skill, ',' order by rank) as top_skills from (select country, skill, row_number() over (partition by country order by count(*) desc, skill) as rank from {_PAIRS} join postings using (job_id) group by 1, 2) where rank <= 10 group by 1) using (country) group by country""")
_add("a12_top_countries", lambda s, d: postings(s, d).groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(10), "select country, count(*) as n from postings group by 1 order by 2 desc, 1 limit 10")


def _a13(s, d):
    k = posting_skills(s, d)
    total = k.agg(F.count_distinct("job_id").alias("total"))
    pct = F.floor(F.col("jobs") * 100 / F.col("total")).cast("int")
    return k.groupBy("skill").agg(F.count_distinct("job_id").alias("jobs")).crossJoin(F.broadcast(total)).select("skill", "jobs", pct.alias("demand"), F.when(pct >= 10, "Growing").otherwise("Stable").alias("trend"))


_add("a13_skill_demand", _a13, "select skill, count(distinct job_id) as jobs, cast(floor(count(distinct job_id) * 100 / t) as int) as demand, case when floor(count(distinct job_id) * 100 / t) >= 10 then 'Growing' else 'Stable' end as trend from posting_skills, (select count(distinct job_id)::double as t from posting_skills) group by skill, t")
_add("a14_demand_of_all_jobs", lambda s, d: posting_skills(s, d).groupBy("skill").agg(F.count_distinct("job_id").alias("jobs")).crossJoin(F.broadcast(postings(s, d).agg(F.count("*").alias("t")))).select("skill", "jobs", F.round(F.col("jobs") * 100.0 / F.col("t"), 1).alias("pct")).orderBy(F.desc("jobs"), "skill").limit(20), "select skill, count(distinct job_id) as jobs, round(count(distinct job_id) * 100.0::double / (select count(*) from postings), 1) as pct from posting_skills group by 1 order by 2 desc, 1 limit 20")


def _role():
    return F.concat_ws(" ", "seniority", "source")


_add("a14_role_demand", lambda s, d: A.share(postings(s, d).withColumn("role", _role()), "role").orderBy(F.desc("n"), "role").limit(20), "select seniority || ' ' || source as role, count(*) as n, round(count(*) * 100.0::double / (select count(*) from postings), 1) as pct from postings group by 1 order by 2 desc, 1 limit 20")


def _a15(s, d):
    j = posting_skills(s, d).select("job_id", "skill").distinct().join(postings(s, d).select("job_id", "date_posted"), "job_id")
    m = A.monthly(j, "date_posted", ["skill"])
    before = F.lag("n").over(Window.partitionBy("skill").orderBy("month"))
    return m.withColumn("growth_pct", F.round((F.col("n") - before) * 100.0 / before, 1))


_add("a15_skill_trend", _a15, f"select month, skill, n, round((n - lag(n) over w) * 100.0::double / lag(n) over w, 1) as growth_pct from (select strftime(date_posted, '%Y-%m') as month, skill, count(*) as n from {_PAIRS} join postings using (job_id) group by 1, 2) window w as (partition by skill order by month)")
_add("a16_monthly_by_source", lambda s, d: A.monthly(postings(s, d), "date_posted", []).join(postings(s, d).groupBy(F.date_format("date_posted", "yyyy-MM").alias("month")).pivot("source", _CATS).count().na.fill(0), "month"), "select strftime(date_posted, '%Y-%m') as month, count(*) as n, " + ", ".join(f"count(*) filter (where source = '{c}') as {c}" for c in _CATS) + " from postings group by 1")
_add("a17_null_profile", lambda s, d: A.null_profile(A.with_usd(postings(s, d)), ["salary_min", "country"]), "select 'salary_min' as \"column\", count(*) filter (where salary_min is null) as nulls, round(count(*) filter (where salary_min is null) * 100.0::double / count(*), 2) as null_pct from postings union all select 'country', 0, 0.0::double")
_add("a18_distinct_counts", lambda s, d: postings(s, d).agg(F.count_distinct("company").alias("companies"), F.count_distinct("country").alias("countries"), F.count_distinct("source").alias("sources"), F.round(F.avg("years_experience"), 3).alias("years")), "select count(distinct company) as companies, count(distinct country) as countries, count(distinct source) as sources, round(avg(years_experience), 3) as years from postings")
_COUNTED = ["company", "country", "source", "work_mode", "seniority"]
_DESCRIBED = ["years_experience", "salary_min", "salary_max"]
_add("a18_top_values", lambda s, d: A.top_values(postings(s, d), _COUNTED, 10), "select \"column\", value, n, cast(r as int) as rank from (select *, row_number() over (partition by \"column\" order by n desc, value) as r from (" + " union all ".join(f"select '{c}' as \"column\", {c} as value, count(*) as n from postings where {c} is not null group by 2" for c in _COUNTED) + ")) where r <= 10")
_add("a18_describe", lambda s, d: A.describe(postings(s, d), _DESCRIBED), " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as stddev, min({c})::double as least, round(quantile_cont({c}, 0.25), 4)::double as q1, round(quantile_cont({c}, 0.5), 4)::double as median, round(quantile_cont({c}, 0.75), 4)::double as q3, max({c})::double as most from postings" for c in _DESCRIBED))


def _a19(s, d):
    p = postings(s, d)
    top = p.groupBy("country").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "country").limit(10).select("country")
    return A.top_per_group(A.skill_by_region(posting_skills(s, d), p.join(F.broadcast(top), "country", "left_semi")), ["country"], ["n desc", "skill"], 10)


_add("a19_nested_top", _a19, f"select * from (select country, skill, count(*) as n, cast(row_number() over (partition by country order by count(*) desc, skill) as int) as rank from {_PAIRS} join postings using (job_id) where country in (select country from postings group by 1 order by count(*) desc, country limit 10) group by 1, 2) where rank <= 10")


def _heat(s, d):
    """The ten largest countries by the ten most asked skills, 0 where none."""
    p, k = postings(s, d), posting_skills(s, d).select("job_id", "skill").distinct()
    first = lambda df, c: df.groupBy(c).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), c).limit(10).select(c)
    cells = first(p, "country").crossJoin(F.broadcast(first(k, "skill")))  # ten by ten
    return cells.join(A.skill_by_region(k, p), ["country", "skill"], "left").na.fill(0, ["n"])


_TOP_SKILLS = f"(select skill from {_PAIRS} group by 1 order by count(*) desc, skill limit 10)"
_add("a19_heat_map", _heat, f"select c.country, k.skill, coalesce(n, 0) as n from (select country from postings group by 1 order by count(*) desc, country limit 10) c cross join {_TOP_SKILLS} k left join (select country, skill, count(*) as n from {_PAIRS} join postings using (job_id) group by 1, 2) x on x.country = c.country and x.skill = k.skill")


def _levels(s, d):
    p = postings(s, d)
    top = p.groupBy("country").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "country").limit(5).select("country")
    return p.join(F.broadcast(top), "country", "left_semi").groupBy("seniority", "country").agg(F.count("*").alias("n"))  # five names


_add("a19_seniority_by_country", _levels, "select seniority, country, count(*) as n from postings where country in (select country from postings group by 1 order by count(*) desc, country limit 5) group by 1, 2")
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PC = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]
_add("a20_correlations", lambda s, d: table(s, d, "lineitem").agg(*[F.round(F.corr(a, b), 6).alias(f"{a}__{b}") for a, b in _PC]), "select " + ", ".join(f"round(corr({a}, {b}), 6) as {a}__{b}" for a, b in _PC) + " from lineitem")
_add("a21_description_coverage", lambda s, d: posting_text(s, d).groupBy("source").agg(F.round(F.avg(T.is_real_description(F.col("description")).cast("int")) * 100, 2).alias("pct"), F.count("*").alias("n")), "select source, round(avg((length(trim(description)) >= 40)::int) * 100, 2) as pct, count(*) as n from posting_text group by 1")
_add("a22_top_per_category", lambda s, d: A.top_per_group(posting_skills(s, d).groupBy("category", "skill").agg(F.count("*").alias("n")), ["category"], ["n desc", "skill"], 5), "select * from (select category, skill, count(*) as n, cast(row_number() over (partition by category order by count(*) desc, skill) as int) as rank from posting_skills group by 1, 2) where rank <= 5")
def _a23(s, d):
    high = F.coalesce((F.col("usd_min") > 100000) | (F.col("usd_max") > 100000), F.lit(False))
    pct = lambda c: F.round(F.avg(c.cast("int")) * 100, 2)
    stats = [c for c in A.salary_columns()]
    return A.with_usd(postings(s, d)).agg(
        *stats, F.count_if(F.col("work_mode") == "remote").alias("remote"), pct(F.col("work_mode") == "remote").alias("remote_pct"), F.count_if(high).alias("high_salary"), pct(high).alias("high_salary_pct"),
        F.round(F.avg("years_experience"), 3).alias("years_mean"), F.count_distinct("country").alias("countries"), F.count_distinct("tech_category").alias("categories"),
        F.round(F.avg(T.seniority_rank(F.col("seniority"))), 3).alias("level_mean"))


_HIGH = f"coalesce(salary_min * {_RATE} > 100000 or salary_max * {_RATE} > 100000, false)"
_add("a23_feature_report", _a23, f"""select {_STATS}, count(*) filter (where work_mode = 'remote') as remote, round(avg((work_mode = 'remote')::int) * 100, 2) as remote_pct, count(*) filter (where {_HIGH}) as high_salary, round(avg({_HIGH}::int) * 100, 2) as high_salary_pct,
  round(avg(years_experience), 3) as years_mean, count(distinct country) as countries, count(distinct tech_category) as categories, round(avg(case seniority when 'Entry Level' then 1 when 'Mid-Level' then 2 when 'Senior' then 3 when 'Lead' then 4 when 'Executive' then 5 else 2 end), 3) as level_mean from {_USD}""")
_DISTRIBUTED = ["seniority", "work_mode", "tech_category"]
_add(
    "a23_distributions", lambda s, d: postings(s, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in _DISTRIBUTED])).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n")),
    " union all ".join(f"select '{c}' as \"column\", {c} as value, count(*) as n from postings group by 2" for c in _DISTRIBUTED),
)
_add("a24_seniority_share", lambda s, d: A.share(postings(s, d), "seniority"), "select seniority, count(*) as n, round(count(*) * 100.0::double / (select count(*) from postings), 1) as pct from postings group by 1")
_add("a24_remote_top", lambda s, d: postings(s, d).groupBy("country").agg(*A.remote_columns()).orderBy(F.desc("remote_pct"), "country").limit(6).select("country", "remote", "total", "remote_pct"), "select country, count(*) filter (where work_mode = 'remote') as remote, count(*) as total, round(count(*) filter (where work_mode = 'remote') * 100.0::double / count(*), 2) as remote_pct from postings group by 1 order by 4 desc, 1 limit 6")
_add("a24_dominant_bucket", lambda s, d: postings(s, d).groupBy("seniority", T.experience_bucket(F.col("years_experience")).alias("bucket")).agg(F.count("*").alias("n")).groupBy("seniority").agg(F.max_by("bucket", F.struct("n", "bucket")).alias("bucket"), F.sum("n").alias("total")), f"select seniority, arg_max(bucket, (n, bucket)) as bucket, sum(n)::bigint as total from (select seniority, {_BUCKET} as bucket, count(*) as n from postings group by 1, 2) group by 1")
_add("a25_skill_stats", lambda s, d: posting_skills(s, d).join(postings(s, d).select("job_id", "country"), "job_id").groupBy("skill").agg(F.count_distinct("job_id").alias("jobs"), F.count_distinct("country").alias("countries")), "select skill, count(distinct job_id) as jobs, count(distinct country) as countries from posting_skills join postings using (job_id) group by 1")
_add("a26_rows_and_sums", lambda s, d: posting_skills(s, d).join(postings(s, d).select("job_id", "seniority"), "job_id").groupBy("seniority").agg(F.count_distinct("job_id").alias("rows"), F.count("*").alias("total")), "select seniority, count(distinct job_id) as rows, count(*) as total from posting_skills join postings using (job_id) group by 1")

_add("w3_row_number", lambda s, d: postings(s, d).withColumn("r", F.row_number().over(Window.partitionBy("company").orderBy("date_posted", "job_id"))).where("r = 1").select("company", "job_id"), "select company, arg_min(job_id, (date_posted, job_id)) as job_id from postings group by 1")
_add("w5_growth", lambda s, d: (lambda m: m.withColumn("before", F.coalesce(F.lag("n").over(Window.partitionBy("source").orderBy("month")), F.lit(0))))(A.monthly(postings(s, d), "date_posted", ["source"])), "select month, source, n, coalesce(lag(n) over (partition by source order by month), 0) as before from (select strftime(date_posted, '%Y-%m') as month, source, count(*) as n from postings group by 1, 2)")


def _daily(s, d):
    e = posting_events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = e.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))
    return days.join(e, "day", "left").na.fill(0, ["n"])


_add(
    "w8_decompose", lambda s, d: A.decompose(_daily(s, d)).withColumn("day", F.col("day").cast("string")),
    """with dd as (select cast(ts as date) as day, count(*) as n from events group by 1),
all_days as (select cast(unnest(generate_series((select min(day) from dd), (select max(day) from dd), interval 1 day)) as date) as day),
g as (select day, coalesce(n, 0) as n, isodow(day) as wd from all_days left join dd using (day)),
t as (select *, case when count(n) over w = 7 then avg(n) over w end as trend from g window w as (order by day rows between 3 preceding and 3 following)),
s as (select wd, avg(n - trend) as seasonal from t where trend is not null group by 1),
last as (select arg_max(trend, day) as level from t where trend is not null),
ahead as (select cast(unnest(generate_series((select max(day) + 1 from g), (select max(day) + 14 from g), interval 1 day)) as date) as day)
select cast(day as varchar) as day, 'observed' as kind, round(n::double, 4) as value, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(n - trend - seasonal, 4) as residual from t join s using (wd)
union all select cast(day as varchar), 'forecast', round(level + seasonal, 4), round(level, 4), round(seasonal, 4), null from ahead, last join s on true where isodow(ahead.day) = s.wd""",
)
_add("w9_first_seen_weeks", lambda s, d: posting_events(s, d).groupBy("job_id").agg(F.min("ts").alias("first")).groupBy(F.date_format(F.date_trunc("week", "first"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n")), "select strftime(date_trunc('week', first), '%Y-%m-%d') as week, count(*) as n from (select job_id, min(ts) as first from posting_events group by 1) group by 1")
_add("o1_sorted", lambda s, d: postings(s, d).select("job_id", "salary_min").orderBy(F.desc_nulls_last("salary_min"), "job_id"), "select job_id, salary_min from postings order by salary_min desc nulls last, job_id")
_add("o2_page", lambda s, d: postings(s, d).select("job_id", "company").orderBy("company", "job_id").offset(40).limit(20), "select job_id, company from postings order by company, job_id limit 20 offset 40")
_add("o3_top_k", lambda s, d: postings(s, d).select("job_id", "salary_min").orderBy(F.desc_nulls_last("salary_min"), "job_id").limit(25), "select job_id, salary_min from postings order by salary_min desc nulls last, job_id limit 25")
_add("o4_min_score_fallback", lambda s, d: (lambda p: p.withColumn("any", F.max((F.col("salary_min") > 450000).cast("int")).over(Window.partitionBy("country"))).where("any = 0 or salary_min > 450000").withColumn("r", F.row_number().over(Window.partitionBy("country").orderBy(F.desc_nulls_last("salary_min"), "job_id"))).where("r <= 3").select("country", "job_id", "r"))(postings(s, d)), "select country, job_id, cast(r as int) as r from (select *, row_number() over (partition by country order by salary_min desc nulls last, job_id) as r from (select *, coalesce(max((salary_min > 450000)::int) over (partition by country), 0) as a from postings) where a = 0 or salary_min > 450000) where r <= 3")
_MODES = {"match": "k is null, k, date_posted desc", "recent": "k is null, date_posted desc", "fewest_gaps": "k is null, k - m, date_posted desc"}


def _modes(s, d):
    """A posting's place in its source's list by each sort mode; postings without skills come last."""
    k = posting_skills(s, d).groupBy("job_id").agg(F.count("*").alias("k"), F.count_if(F.col("is_preferred")).alias("m"))
    p = postings(s, d).join(k, "job_id", "left")
    place = lambda *by: F.row_number().over(Window.partitionBy("source").orderBy(F.col("k").isNull(), *by, "job_id"))
    return p.select("job_id", "source", place(F.asc("k"), F.desc("date_posted")).alias("match"), place(F.desc("date_posted")).alias("recent"), place(F.col("k") - F.col("m"), F.desc("date_posted")).alias("fewest_gaps"))


_add("o6_sort_modes", _modes, "select p.job_id, source, " + ", ".join(f"cast(row_number() over (partition by source order by {by}, p.job_id) as int) as {m}" for m, by in _MODES.items()) + " from postings p left join (select job_id, count(*) as k, count(*) filter (where is_preferred) as m from posting_skills group by 1) s on s.job_id = p.job_id")
