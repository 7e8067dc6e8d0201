"""Pipelines: compositions of the operators above."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import aggregates as A
from postlens.operators import dedup
from postlens.operators import recommend as R
from postlens.operators import retrieval as V
from postlens.plans import q_aggregates, q_matching, q_retrieval, q_skills, q_tables, q_text
from postlens.sources import files
from postlens.sources.fixtures import posting_text, postings

QUERIES: dict = {}


def _add(name, run, sql=None):
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = (run, sql)


def ingest(df):
    """Stage 1: conform, fill descriptions, keep what is near or remote."""
    full = dedup.conform(df, {"job_id": "long", "source": "string", "country": "string", "description": "string"}).withColumn("description", T.fill_description(F.col("description")))
    return full.where(F.col("country").isin("fr", "de") | T.any_contained(F.col("description"), ["remote", "hybrid", "wfh"]))


def clean(df):
    """Stage 2: normalise the country, keep the first of each posting by its key."""
    key = T.dedup_key(F.col("description"), F.col("country"))
    return dedup.keep_first(df.withColumn("country", F.upper(F.trim("country"))).withColumn("key", key), ["key"], ["job_id"])


_IN = "(select * from posting_text where country in ('fr', 'de') or contains(lower(description), 'remote') or contains(lower(description), 'hybrid') or contains(lower(description), 'wfh'))"
_add("q1_ingest", lambda s, d: ingest(posting_text(s, d)).groupBy("source", "country").agg(F.count("*").alias("n")), f"select source, country, count(*) as n from {_IN} group by 1, 2")
_CLEAN = f"(select min(job_id) as job_id from {_IN} group by lower(trim(description)), country)"
_add("q2_clean", lambda s, d: clean(ingest(posting_text(s, d))).select("job_id", "country"), f"select job_id, upper(country) as country from posting_text where job_id in (select job_id from {_CLEAN})")
_add("q1_report", lambda s, d: files.schema_report(ingest(posting_text(s, d)), ["job_id", "source", "country", "description", "salary"]), f"""select c as "column", state, n as nulls, round(n * 100.0::double / t, 2) as null_pct from (
  select unnest(['job_id', 'source', 'country', 'description', 'salary']) as c, unnest(['present', 'present', 'present', 'present', 'missing']) as state, unnest([0, 0, 0, 0, count(*)]) as n, count(*) as t from {_IN})""")
_add("q1_summary", lambda s, d: files.summary(ingest(posting_text(s, d)), "country", "source", 10), f"""select 'rows' as metric, 'all' as key, count(*) as value from {_IN} union all select 'columns', 'all', 4
union all select * from (select 'country', country, count(*) as n from {_IN} group by 2 order by n desc, country limit 10) union all select 'source', source, count(*) from {_IN} group by 2""")
_add("q3_enrich", lambda s, d: q_skills.enrich(clean(ingest(posting_text(s, d)))).groupBy("seniority", "mode").agg(F.count("*").alias("n"), F.max("years").alias("years"), F.sum("skill_count").alias("skills")), f"select seniority, mode, count(*) as n, max(years) as years, sum(skill_count)::bigint as skills from ({q_skills.ENRICH_SQL}) where job_id in (select job_id from {_CLEAN}) group by 1, 2")


def _q3_summary(s, d):
    """The enrichment's summary over the cleaned postings."""
    cleaned = clean(ingest(posting_text(s, d)))
    return q_skills.summary(q_skills.read(cleaned)).where("metric in ('unique_skills', 'top_skill', 'seniority')")


_add("q3_summary", _q3_summary, f"""with found as materialized (select job_id, skill from {q_skills._ALL_SKILLS} where job_id in (select job_id from {_CLEAN}))
select 'unique_skills' as metric, 'all' as key, count(distinct skill)::double as value from found union all select 'top_skill', skill, n from (select skill, count(*)::double as n from found group by 1 order by 2 desc, 1 limit 15)
union all select 'seniority', value, count(*)::double from ({q_text.QUERIES['p31_seniority'][1]}) where job_id in (select job_id from {_CLEAN}) group by 2""".replace("with found as materialized (", "select * from (with found as materialized (", 1) + ")")
_add("q4_features", lambda s, d: A.with_usd(postings(s, d)).withColumn("bucket", T.experience_bucket(F.col("years_experience"))).groupBy("country", "bucket").agg(*A.salary_columns(), *A.remote_columns()[:3], F.round(F.avg(T.seniority_rank(F.col("seniority"))), 3).alias("level_mean")), "select country, bucket, " + q_aggregates._STATS + f", count(*) filter (where work_mode = 'remote') as remote, count(*) filter (where work_mode = 'hybrid') as hybrid, count(*) filter (where work_mode = 'onsite') as on_site, round(avg(case seniority when 'Entry Level' then 1 when 'Mid-Level' then 2 when 'Senior' then 3 when 'Lead' then 4 when 'Executive' then 5 else 2 end), 3) as level_mean from (select *, {q_aggregates._BUCKET} as bucket from {q_aggregates._USD}) group by 1, 2")


def _long(df, metric, keys, columns):
    """(metric, key, column, value) rows of a result."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    return df.select(F.lit(metric).alias("metric"), F.concat_ws(" / ", *keys).alias("key"), cells).select("metric", "key", "x.*")


def _long_sql(query, metric, keys, columns):
    sql = q_aggregates.QUERIES[query][1]
    return " union all ".join(f"select '{metric}' as metric, concat_ws(' / ', {', '.join(keys)}) as key, '{c}' as \"column\", {c}::double as value from ({sql})" for c in columns)


def _part(s, d, query, metric, keys, columns):
    return _long(q_aggregates.QUERIES[query][0](s, d), metric, keys, columns)


_COMPOSITION = [("a6_category_by_country", "category by country", ["country"], [*q_aggregates._CATS, "total"]), ("a7_mode_by_category", "mode by category", ["tech_category", "work_mode"], ["pct", "n"]), ("a8_market_share", "share", ["country"], ["n", "pct"])]
_RELIABILITY = [("a9_completeness", "completeness", ["source"], q_aggregates._FIELDS), ("a10_date_reliability", "dates", ["source"], ["rows", "dates", "rows_per_date", "trusted", "trusted_pct"]), ("a11_freshness_median", "age", ["country"], ["median_age", "n"])]


def _parts(s, d, parts):
    return reduce(lambda a, b: a.unionByName(b), [_part(s, d, *p) for p in parts])


def _trusted(s, d):
    """Postings with a date in the trusted range that fewer than five of their source share."""
    p = postings(s, d).withColumn("_same", F.count("job_id").over(Window.partitionBy("source", "date_posted"))).where("_same < 5").drop("_same")
    return p.crossJoin(F.broadcast(p.agg(F.date_sub(F.max("date_posted"), 30).alias("_last")))).where("date_posted >= date '1995-01-01' and date_posted <= _last").drop("_last")


_RELY = "(select * exclude (same) from (select *, count(job_id) over (partition by source, date_posted) as same from postings) where same < 5)"
_TRUSTED = f"(select * from {_RELY} where date_posted >= date '1995-01-01' and date_posted <= (select max(date_posted) - 30 from {_RELY}))"


def _aged(s, d):
    p = _trusted(s, d)
    return p.crossJoin(F.broadcast(p.agg(F.date_add(F.max("date_posted"), 1).alias("_end")))).withColumn("age", F.datediff("_end", "date_posted")).where("age >= 0")


def _q7(s, d):
    """Median age of trusted postings by source and level, and the daily series with its forecast."""
    aged = _aged(s, d)
    age = [aged.groupBy(g).agg(F.percentile("age", F.lit(0.5)).alias("median"), F.count("*").alias("n")).where("n >= 10") for g in ("source", "seniority")]
    trend = q_aggregates.QUERIES["w8_decompose"][0](s, d)
    frames = [_long(age[0], "age by source", ["source"], ["median", "n"]), _long(age[1], "age by level", ["seniority"], ["median", "n"]), _long(trend, "daily", ["kind", "day"], ["value", "trend", "seasonal", "residual"])]
    return reduce(lambda a, b: a.unionByName(b), frames)


_AGED = f"(select *, (select max(date_posted) + 1 from {_TRUSTED}) - date_posted as age from {_TRUSTED})"
_add("q5_composition", lambda s, d: _parts(s, d, _COMPOSITION), " union all ".join(_long_sql(*p) for p in _COMPOSITION))
_add("q6_reliability", lambda s, d: _parts(s, d, _RELIABILITY).unionByName(_long(_trusted(s, d).groupBy("source").agg(F.count("*").alias("n")), "trusted", ["source"], ["n"])), " union all ".join(_long_sql(*p) for p in _RELIABILITY) + f" union all select 'trusted', source, 'n', count(*)::double from {_TRUSTED} group by source")
_add("q7_freshness_and_trend", _q7, " union all ".join(f"select 'age by {name}' as metric, {g} as key, '{c}' as \"column\", {v}::double as value from {_AGED} group by {g} having count(*) >= 10" for name, g in (("source", "source"), ("level", "seniority")) for c, v in (("median", "quantile_cont(age, 0.5)"), ("n", "count(*)"))) + " union all " + _long_sql("w8_decompose", "daily", ["kind", "day"], ["value", "trend", "seasonal", "residual"]))


def _master(s, d):
    """Sources united, companies cleaned, one row for each id and then for each company and country, newest first."""
    once = dedup.keep_first(q_tables._dup(s, d), ["job_id"], ["src_priority"])
    named = once.withColumn("company", T.clean_text(F.col("company"))).where(F.length("company") > 2)
    first = dedup.keep_first(named, ["company", "country"], ["src_priority", "job_id"])
    return first.join(postings(s, d).select("job_id", "date_posted"), "job_id").orderBy(F.desc_nulls_last("date_posted"), "source", "job_id")


_MASTER = "(select arg_min(job_id, job_id) as job_id, company, country, arg_min(source, job_id) as source, arg_min(date_posted, job_id) as date_posted from postings group by company, country)"
_add("q8_build_master", lambda s, d: _master(s, d).select("job_id", "source", "company", "country", F.col("date_posted").cast("string").alias("date_posted")), f"select job_id, source, company, country, cast(date_posted as varchar) as date_posted from {_MASTER} order by date_posted desc, source, job_id")
_add("q8_summary", lambda s, d: files.summary(_master(s, d), "country", "source", 10), f"""select 'rows' as metric, 'all' as key, count(*) as value from {_MASTER} union all select 'columns', 'all', 6
union all select * from (select 'country', country, count(*) as n from {_MASTER} group by 2 order by n desc, country limit 10) union all select 'source', source, count(*) from {_MASTER} group by 2""")


def _q10(s, d):
    """The plan of every candidate: ranked postings, courses for the gaps that they share, what to practise, and a label for the best score."""
    who = q_matching._newcomers(s, d)
    full = files.save(q_matching._full(s, d, who=who), "plan")
    part = lambda df, name, item, value: df.select("candidate_id", F.lit(name).alias("part"), F.col("rank").cast("int").alias("rank"), item.cast("string").alias("item"), value.alias("value"))
    courses = R.with_courses(R.gaps(full), q_matching._courses(s, d))
    practised = R.practice(who, full, q_matching._kinds(s, d)).withColumnRenamed("place", "rank")
    best = full.groupBy("candidate_id").agg(F.max("score").alias("best"), F.lit(1).alias("rank"))
    frames = [
        part(full, "posting", F.col("job_id"), F.col("score")), part(courses, "course", F.concat_ws(": ", "skill", "title"), F.col("priority")),
        part(practised, "practice", F.concat_ws(": ", "skill", "kind"), F.lit(None).cast("double")), part(best, "priority", R.label(F.col("best")), F.col("best")),
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


_PLAN = q_matching._T.replace(q_matching._WHO, q_matching._FEW)
_PRACTISED = f"""(select candidate_id, skill, cast(row_number() over (partition by candidate_id order by skill) as int) as rank from (
  select candidate_id, unnest(skills) as skill from {q_matching._FEW} union select candidate_id, unnest(list_intersect(required, skills)) from {_PLAN} where urgent) qualify rank <= 5)"""
_add("q10_plan", _q10, f"""select candidate_id, 'posting' as part, rank, job_id::varchar as item, score as value from {_PLAN}
union all select candidate_id, 'course', rank, skill || ': ' || coalesce(title, 'Learn ' || skill), priority from {q_matching._G.replace(q_matching._WHO, q_matching._FEW)} left join {q_matching._COURSES} using (skill)
union all select candidate_id, 'practice', rank, skill || ': ' || case when design then 'system design' else coalesce(kind, 'behavioural') end, null from {_PRACTISED} left join {q_matching._KINDS} using (skill)
union all select candidate_id, 'priority', 1, case when max(score) >= 0.6 then 'HIGH' when max(score) >= 0.3 then 'MEDIUM' else 'LOW' end, max(score) from {_PLAN} group by 1""")


def _q9(s, d):
    """Full refresh: union, ingest, clean (saved), enrich (saved), then features and the size of the search index; the stages share what is saved."""
    old, new = posting_text(s, d).where("job_id % 2 = 0"), posting_text(s, d).where("job_id % 3 = 0")
    master = old.unionByName(new.join(old.select("job_id"), "job_id", "left_anti"))
    cleaned = files.save(clean(ingest(master)), "refresh-clean")
    enriched = files.save(q_skills.enrich(cleaned), "refresh-enriched")
    index, _ = V.index(enriched, "job_id", "document")
    terms = index.join(enriched.select("job_id", "country", "seniority"), "job_id").groupBy("country", "seniority").agg(F.count_distinct("term").alias("terms"))
    one = enriched.groupBy("country", "seniority").agg(F.count("*").alias("n"), F.round(F.avg("years"), 3).alias("years"), F.sum("skill_count").alias("skills"), F.count("salary_low").alias("paid"))
    return one.join(terms, ["country", "seniority"], "left").na.fill(0, ["terms"])


_REFRESH = "(select min(job_id) as job_id from (select * from posting_text where (job_id % 2 = 0 or job_id % 3 = 0) and (country in ('fr', 'de') or contains(lower(description), 'remote') or contains(lower(description), 'hybrid') or contains(lower(description), 'wfh'))) group by lower(trim(description)), country)"
# Stage 2 writes the country in capitals before stage 3 reads it.
_REFRESHED = f"(select e.* replace (upper(e.country) as country, replace(replace(e.document, 'Location: ' || e.country || chr(10), 'Location: ' || upper(e.country) || chr(10)), 'Country: ' || e.country || chr(10), 'Country: ' || upper(e.country) || chr(10)) as document) from ({q_skills.ENRICH_SQL}) e where job_id in (select job_id from {_REFRESH}))"
_add("q9_full_refresh", _q9, f"""select * from (with e as materialized (select * from {_REFRESHED}), tf as (select job_id, unnest(regexp_extract_all(lower(document), '[a-z]{{3,}}')) as term from e),
voc as (select term from (select term, count(distinct job_id) as df, count(*) as cf from tf group by 1) where df >= 2 and df <= 0.95 * (select count(*) from e) order by cf desc, term limit 3000),
terms as (select country, seniority, count(distinct term) as terms from tf join voc using (term) join e using (job_id) group by 1, 2)
select country, seniority, count(*) as n, round(avg(years), 3) as years, sum(skill_count)::bigint as skills, count(salary_low) as paid, coalesce(any_value(terms.terms), 0) as terms from e left join terms using (country, seniority) group by 1, 2)""")


def _q11(s, d):
    """Evaluation suite: the metric frames in one long table."""
    extraction = q_retrieval._scored_runs(s, d).where("run = 'whole'")
    frames = [
        _long(extraction, "skills", ["category"], ["precision", "recall", "f1"]), _long(q_retrieval.QUERIES["e2_accuracy"][0](s, d).withColumn("key", F.lit("all")), "seniority", ["key"], ["n", "accuracy"]),
        _long(q_retrieval.QUERIES["e4_ranking_metrics"][0](s, d).agg(*[F.round(F.avg(c), 4).alias(c) for c in _RANKED]).withColumn("key", F.lit("all")), "retrieval", ["key"], _RANKED),
        _long(q_matching.QUERIES["e3_recommender_metrics"][0](s, d).withColumn("key", F.lit("all")), "recommender", ["key"], _RECOMMENDED),
        _long(q_retrieval.QUERIES["e5_alias_cases"][0](s, d).agg(F.round(F.sum(F.col("accuracy") * F.col("n")) / F.sum("n"), 4).alias("accuracy")).withColumn("key", F.lit("all")), "aliases", ["key"], ["accuracy"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


_RANKED, _RECOMMENDED = ["p_at_3", "p_at_5", "r_at_5", "mrr"], ["candidates", "top1_accuracy", "mean_rank", "coverage_top3"]
_add("q11_evaluation", _q11, " union all ".join(
    [f"select 'skills' as metric, category as key, '{c}' as \"column\", {c}::double as value from {q_retrieval._RUNS} where run = 'whole'" for c in ("precision", "recall", "f1")]
    + [f"select 'seniority', 'all', '{c}', {c}::double from ({q_retrieval.QUERIES['e2_accuracy'][1]})" for c in ("n", "accuracy")]
    + [f"select 'retrieval', 'all', '{c}', round(avg({c}), 4) from ({q_retrieval.QUERIES['e4_ranking_metrics'][1]})" for c in _RANKED]
    + [f"select 'recommender', 'all', '{c}', {c}::double from ({q_matching.QUERIES['e3_recommender_metrics'][1]})" for c in _RECOMMENDED]
    + [f"select 'aliases', 'all', 'accuracy', 1.0::double from (select count(*) from part)"]))
