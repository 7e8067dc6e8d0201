"""Sources and sinks, filters, joins, deduplication and upsert over the posting tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.functions import terms
from postlens.functions import text as T
from postlens.operators import dedup
from postlens.plans import q_text
from postlens.sources import files
from postlens.sources.fixtures import candidates, posting_events, posting_skills, posting_text, postings, table

QUERIES: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = (run, sql)


_BASIC = ["job_id", "source", "company", "country", "work_mode"]
_TEXT = {c: "string" for c in _BASIC}


def _written(s: SparkSession, df: DataFrame, kind: str, **options) -> str:
    path = f"{files.work_dir(s)}/{kind}-{uuid.uuid4().hex}"
    w = df.write.options(**options)
    (w.partitionBy("country") if kind == "partitioned" else w).format("parquet" if kind == "partitioned" else kind).save(path)
    return path


def _strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in _BASIC])


def _s1(s, d):
    path = _written(s, _strings(postings(s, d)), "csv", header=True)
    return files.read_postings_csv(s, path, _TEXT)


def _s3(s, d):
    path = _written(s, _strings(postings(s, d)), "partitioned")
    return s.read.parquet(path).where("country = 'NATION_7'").select(*_BASIC)


def _s4(s, d):
    """A nested feed written from postings: markup in two of three records, tags, untitled records and a malformed line."""
    p, k = postings(s, d), F.col("job_id")
    org = F.struct(
        F.when(k % 2 == 0, F.struct(F.concat(F.lit("Org "), k).alias("name"))).alias("hiringOrganization"),
        F.struct(F.struct(F.when(k % 4 != 0, F.lit("Town")).alias("addressLocality"), F.lit("").alias("addressRegion"), F.col("country").alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.lit("FULL_TIME").alias("employmentType"), F.col("currency").alias("salaryCurrency"), F.date_format("date_posted", "yyyy-MM-dd").alias("datePosted"), F.lit("2024-12-31").alias("validThrough"), F.col("source").alias("industry"),
        F.lit("BSc").alias("educationRequirements"), F.lit("5 years").alias("qualifications"), F.col("tech_category").alias("relevantOccupation"))
    feed = p.select(
        F.when(k % 7 != 0, F.lit("feed")).alias("source"), F.lit("portal").alias("portal"), k.cast("string").alias("idInSource"), F.when(k % 5 != 0, F.concat(F.lit(" Role "), k)).alias("name"), F.concat(F.lit("Text "), k).alias("text"),
        F.concat(F.lit("https://example.org/"), k).alias("url"), F.struct(F.col("company").alias("name")).alias("company"), F.struct(F.lit("Somewhere").alias("name"), F.lit(None).cast("string").alias("country")).alias("location"),
        F.struct(F.when(k % 2 == 1, F.lit("as agreed")).alias("text")).alias("salary"), F.struct(F.when(k % 3 != 0, org).alias("schemaOrg")).alias("json"),
        F.struct(F.array(F.upper("work_mode")).alias("WORK_TYPES"), F.array("seniority").alias("JOBNAMES")).alias("inferredTags"))
    path = _written(s, feed, "json")
    s.createDataFrame([('{"name": "broken',)], "value string").coalesce(1).write.mode("append").text(path)
    return files.read_feed(s, path)


_add("s1_csv_round_trip", _s1, f"select {', '.join(f'cast({c} as varchar) as {c}' for c in _BASIC)} from postings")
_add("s3_partitioned_read", _s3, f"select {', '.join(f'cast({c} as varchar) as {c}' for c in _BASIC)} from postings where country = 'NATION_7'")
_add(
    "s4_nested_feed", _s4,
    """select substr(sha256(src || '|' || job_id), 1, 16) as job_id, src as source, cast(job_id as varchar) as source_job_id, 'Role ' || job_id as job_title, case when m and job_id % 2 = 0 then 'Org ' || job_id else company end as company, 'Text ' || job_id as job_description,
  case when m then case when job_id % 4 <> 0 then 'Town, ' || country else country end else 'Somewhere' end as location, case when m then country end as country, work_mode, null::varchar as remote_scope, case when m then tech_category end as job_field,
  case when m then source end as industry, case when m then 'FULL_TIME' end as employment_type, case when m then '5 years' end as experience_required, case when m then 'BSc' end as education_required, case when job_id % 2 = 1 then 'as agreed' end as salary,
  case when m then currency end as currency, case when m then strftime(date_posted, '%Y-%m-%d') end as date_posted, case when m then '2024-12-31' end as application_deadline, seniority as tech_category, 'https://example.org/' || job_id as vacancy_url, null::varchar as scraped_at
from (select *, case when job_id % 7 <> 0 then 'feed' else 'portal' end as src, job_id % 3 <> 0 as m from postings where job_id % 5 <> 0)""",
)
_add(
    "s5_location_parts", lambda s, d: postings(s, d).select("job_id", F.coalesce(T.clean_text(F.concat_ws(", ", F.when(F.col("job_id") % 2 == 0, F.col("source")), F.when(F.col("job_id") % 3 == 0, F.col("country")))), F.col("country")).alias("location")),
    "select job_id, coalesce(nullif(concat_ws(', ', case when job_id % 2 = 0 then source end, case when job_id % 3 = 0 then country end), ''), country) as location from postings",
)
_add(
    "s6_conform", lambda s, d: dedup.conform(postings(s, d).drop("company"), {"job_id": "string", "company": "string", "country": "string"}),
    "select cast(job_id as varchar) as job_id, cast(null as varchar) as company, country from postings",
)


_WANTED = ["job_id", "company", "country", "salary_min", "vacancy_url", "industry"]


def _s7(s, d):
    """Columns that are missing or not asked for, and nulls of those that are there."""
    return files.schema_report(postings(s, d), _WANTED)


_HAVE = ["job_id", "source", "company", "country", "work_mode", "seniority", "years_experience", "currency", "salary_min", "salary_max", "date_posted", "tech_category"]
_add("s7_schema_report", _s7, " union all ".join(
    f"select '{c}' as \"column\", '{'present' if c in _WANTED else 'extra'}' as state, count(*) filter (where {c} is null) as nulls, round(count(*) filter (where {c} is null) * 100.0::double / count(*), 2) as null_pct from postings" for c in _HAVE)
    + "".join(f" union all select '{c}', 'missing', count(*), 100.0::double from postings" for c in _WANTED if c not in _HAVE))


def _s8(s, d):
    """Rows, columns, the ten largest countries and every source."""
    return files.summary(postings(s, d), "country", "source", 10)


_add("s8_top_countries", lambda s, d: postings(s, d).groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(10), "select country, count(*) as n from postings group by 1 order by 2 desc, 1 limit 10")
_add("s8_summary", _s8, f"""select 'rows' as metric, 'all' as key, count(*) as value from postings union all select 'columns', 'all', {len(_HAVE)}
union all select * from (select 'country', country, count(*) as n from postings group by 2 order by n desc, country limit 10) union all select 'source', source, count(*) from postings group by 2""")
#: Twelve targets and the words of column names that tell them, in order.
_TARGETS = {
    "job_id": ["orderkey"], "company": ["c_name", "company"], "country": ["n_name", "country"], "date_posted": ["date"], "salary": ["price", "salary"], "job_title": ["title", "priority"], "work_mode": ["mode", "status"], "tech_category": ["segment"],
    "source": ["custkey"], "location": ["city", "regionkey"], "experience_required": ["acctbal"], "vacancy_url": ["url"],
}


def _s9(s, d):
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    wide = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    found = files.guess_columns(wide.columns, _TARGETS)
    return wide.select(*[F.col(x).alias(t) for t, x in found.items()]).withColumn("date_posted", F.date_format("date_posted", "yyyy-MM-dd"))


_add("s9_column_mapping", _s9, "select o_orderkey as job_id, c_name as company, n_name as country, strftime(o_orderdate, '%Y-%m-%d') as date_posted, o_totalprice as salary, o_orderpriority as job_title, o_orderstatus as work_mode, c_mktsegment as tech_category, o_custkey as source, n_regionkey as location, c_acctbal as experience_required from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
_add("s10_column_profile", lambda s, d: postings(s, d).groupBy(F.col("country").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(15).withColumn("recognised", F.col("value").rlike("_[0-9]$")), "select country as value, count(*) as n, regexp_matches(country, '_[0-9]$') as recognised from postings group by 1 order by 2 desc, 1 limit 15")


def _s12(s, d):
    path = f"{files.work_dir(s)}/runs-{uuid.uuid4().hex}"
    p = postings(s, d).select("job_id", "country")
    for run in ("20260101", "20260201"):
        p.where(F.col("job_id") % 2 == (0 if run == "20260101" else 1)).withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(path)
    return files.newest_run(s.read.parquet(path))


_add("s12_newest_run", _s12, "select job_id, country, 20260201 as run_id from postings where job_id % 2 = 1")


def _s13(s, d):
    """Open jobs with their skills as JSON, by source and id; a row without its identity is an error."""
    skills = posting_skills(s, d).groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_set("skill"))).alias("skills"))
    jobs = postings(s, d).where("work_mode = 'remote'").join(skills, "job_id").withColumn("source_job_id", F.col("job_id").cast("string"))
    known = F.coalesce(F.trim("source"), F.lit("")) != ""
    sure = F.when(known & (F.coalesce(F.trim("source_job_id"), F.lit("")) != ""), F.col("source_job_id")).otherwise(F.raise_error(F.lit("a posting has no source or id")))
    return jobs.select("source", "job_id", "skills", sure.alias("source_job_id")).orderBy("source", "source_job_id")


_add("s13_snapshot_export", _s13, "select source, job_id, '[' || string_agg('\"' || skill || '\"', ',' order by skill) || ']' as skills, cast(job_id as varchar) as source_job_id from (select distinct job_id, skill from posting_skills) join (select source, job_id from postings where work_mode = 'remote') using (job_id) group by 1, 2")


def _s11_csv(s, d):
    """The long table of skills by country as CSV, read back."""
    from postlens.operators.aggregates import skill_by_region

    path = f"{files.work_dir(s)}/csv-{uuid.uuid4().hex}"
    skill_by_region(posting_skills(s, d), postings(s, d)).select("skill", F.col("country").alias("region"), F.col("n").alias("count")).write.option("header", True).csv(path)
    return s.read.schema("skill string, region string, count long").option("header", True).csv(path)


_add("s11_csv_export", _s11_csv, "select skill, country as region, count(*) as \"count\" from (select distinct job_id, skill from posting_skills) join postings using (job_id) group by 1, 2")

_SET = [f"NATION_{i}" for i in (1, 5, 9)]
_add("f1_geo_filter", lambda s, d: postings(s, d).where(F.lower("country").isin([c.lower() for c in _SET]) | F.col("work_mode").rlike("remote|hybrid|wfh|unknown")).select("job_id", "country", "work_mode"), "select job_id, country, work_mode from postings where country in ('NATION_1', 'NATION_5', 'NATION_9') or work_mode in ('remote', 'hybrid')")
_add("f2_title_filter", lambda s, d: table(s, d, "part").where(F.length("p_name") > 9).select("p_partkey", "p_name"), "select p_partkey, p_name from part where length(p_name) > 9")
_add("f3_country_aware_filter", lambda s, d: files.filter_by_country(table(s, d, "nation"), "NATION_1"), "select * from nation where upper(n_name) = 'NATION_1'")


def _f4(s, d):
    p = postings(s, d)
    return p.crossJoin(F.broadcast(p.agg(F.date_sub(F.max("date_posted"), 30).alias("last")))).where("date_posted >= date '1995-01-01' and date_posted <= last").select("job_id", "date_posted")


_add("f4_trust_filter", lambda s, d: _f4(s, d).select("job_id"), "select job_id from postings where date_posted >= date '1995-01-01' and date_posted <= (select max(date_posted) - 30 from postings)")
_add("f5_non_negative_age", lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("age", F.datediff("l_shipdate", "o_orderdate")).where("age >= 0").groupBy("age").agg(F.count("*").alias("n")), "select cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as int) as age, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_shipdate::date >= o_orderdate::date group by 1")


def _messy(s, d):
    """Rows with spaces, placeholders, a date column as text, an empty column and copies."""
    k = F.col("job_id")
    rows = posting_text(s, d).select(
        F.when(k % 5 != 0, F.concat(F.lit("  "), "source", F.lit("\t x "))).alias("source"), F.when(k % 5 != 0, F.element_at(F.array(F.lit(" N/A "), F.lit("-"), F.lit("null"), F.col("country")), (k % 4 + 1).cast("int"))).alias("country"),
        F.when(k % 5 != 0, F.when(k % 3 == 0, "2024-01-05").when(k % 3 == 1, "no day")).alias("seen_date"), F.lit(None).cast("string").alias("empty"))
    return rows.unionByName(rows)


_add("f6_clean_data", lambda s, d: dedup.clean(_messy(s, d)).withColumn("seen_date", F.col("seen_date").cast("string")), """select distinct case when job_id % 5 <> 0 then source || ' x' end as source, case when job_id % 5 <> 0 and job_id % 4 = 3 then country end as country, case when job_id % 5 <> 0 and job_id % 3 = 0 then '2024-01-05 00:00:00' end as seen_date
from posting_text where job_id % 5 <> 0""")


def _f7(s, d):
    """Words in title or company, country, city and type whatever the case, remote, open at the day of the newest posting, any of some skills."""
    p = postings(s, d).withColumns({"title": F.concat_ws(" ", "seniority", "source"), "city": F.concat(F.lit("City "), (F.col("job_id") % 3).cast("string")), "type": F.when(F.col("job_id") % 2 == 0, "Full-Time").otherwise("Contract")})
    return dedup.search(p, posting_skills(s, d), words="senior", country="NATION_3", city="city 1", type="full-time", remote=False, open_since=F.lit("1995-01-01").cast("date"), skills=["brand#1", "brand#2", "brand#3"]).select("job_id", "title", "company")


_add("f7_search", _f7, """select job_id, seniority || ' ' || source as title, company from postings where (contains(lower(seniority || ' ' || source), 'senior') or contains(lower(company), 'senior')) and country = 'NATION_3' and job_id % 3 = 1 and job_id % 2 = 0
  and work_mode <> 'remote' and date_posted >= date '1995-01-01' and job_id in (select job_id from posting_skills where skill in ('brand#1', 'brand#2', 'brand#3'))""")
_add("f8_min_class_size", lambda s, d: (lambda t: t.join(t.groupBy("source", "country").agg(F.count("*").alias("n")).where("n >= 8"), ["source", "country"], "left_semi").select("job_id", "source"))(posting_text(s, d)), "select job_id, source from posting_text where (source, country) in (select (source, country) from posting_text group by source, country having count(*) >= 8)")
_add("f9_groups_over", lambda s, d: postings(s, d).groupBy("country", "seniority").agg(F.count("*").alias("n")).where("n > 100"), "select country, seniority, count(*) as n from postings group by 1, 2 having count(*) > 100")
_COUNTRY_NAMES = [n for n, _, _ in terms.COUNTRIES]
_PLACES = ["", "Nairobi, Kenya", "Anywhere", "Paris", "Lagos, Nigeria", "Berlin", None]


def _f10(s, d):
    """Postings that name an African country or are open to all (a marker or no place); their scope and country follow from that."""
    place = F.coalesce(F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("job_id") % len(_PLACES) + 1).cast("int")), F.lit(""))
    t = posting_text(s, d).select("job_id", place.alias("place"), "description")
    hay = F.concat_ws(" ", "place", "description")
    africa, open_ = T.any_contained(hay, [n.lower() for n in _COUNTRY_NAMES]), T.any_contained(hay, terms.OPEN_TO_ALL_MARKERS) | (F.trim("place") == "")
    named = F.coalesce(T.first_contained(F.col("place"), _COUNTRY_NAMES), T.first_contained(F.col("description"), _COUNTRY_NAMES))
    told = t.select("job_id", africa.alias("africa"), open_.alias("open_to_all"), F.coalesce(named, F.when(open_, "Any (Global Remote)")).alias("country"))
    return told.where("africa or open_to_all").select("job_id", F.when(F.col("open_to_all"), "Global").otherwise("Regional").alias("scope"), "country")


_F10 = f"""(select job_id, place, description, place || ' ' || description as hay from (select job_id, coalesce(list_extract([{', '.join('null' if x is None else q_text._q(x) for x in _PLACES)}], cast(job_id % {len(_PLACES)} + 1 as int)), '') as place, description from posting_text))"""
_NAMED_IN = lambda c: q_text._chain([(q_text._has([n.lower()], c), n) for n in _COUNTRY_NAMES])
_add("f10_source_relevance", _f10, f"""select job_id, case when open_ then 'Global' else 'Regional' end as scope, coalesce(in_place, in_text, case when open_ then 'Any (Global Remote)' end) as country from (
  select job_id, {q_text._has(terms.OPEN_TO_ALL_MARKERS, 'hay')} or trim(place) = '' as open_, {q_text._has([n.lower() for n in _COUNTRY_NAMES], 'hay')} as africa, {_NAMED_IN('place')} as in_place, {_NAMED_IN('description')} as in_text from {_F10}) where open_ or africa""")

_add("j1_three_way", lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 1).alias("q")), "select p_brand, o_orderstatus, count(*) as n, round(sum(l_quantity), 1) as q from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2")
_add(
    "j2_skills_per_job", lambda s, d: postings(s, d).select("job_id").join(posting_skills(s, d).groupBy("job_id").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_preferred") == b, F.col("skill")))), ",").alias(n) for n, b in (("preferred", True), ("required", False))]), "job_id", "left"),
    "select p.job_id, preferred, required from postings p left join (select job_id, coalesce(string_agg(distinct skill, ',' order by skill) filter (where is_preferred), '') as preferred, coalesce(string_agg(distinct skill, ',' order by skill) filter (where not is_preferred), '') as required from posting_skills group by 1) s on s.job_id = p.job_id",
)
_add("j3_semi", lambda s, d: postings(s, d).join(posting_skills(s, d).where("skill = 'brand#7'"), "job_id", "left_semi").select("job_id"), "select job_id from postings where job_id in (select job_id from posting_skills where skill = 'brand#7')")


def _j4(s, d):
    market = posting_skills(s, d).groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(10)
    have = candidates(s, d)
    return have.select("candidate_id").distinct().crossJoin(F.broadcast(market.select("skill"))).join(have, ["candidate_id", "skill"], "left_anti")


_add("j4_anti_missing", _j4, "select c.candidate_id, m.skill from (select distinct candidate_id from candidates) c, (select skill from (select skill, count(*) as n from posting_skills group by 1 order by 2 desc, 1 limit 10)) m where not exists (select 1 from candidates x where x.candidate_id = c.candidate_id and x.skill = m.skill)")
_add("j5_dimension_default", lambda s, d: postings(s, d).join(F.broadcast(s.createDataFrame([("USD", "dollar"), ("EUR", "euro")], "currency string, label string")), "currency", "left").groupBy(F.coalesce("label", F.lit("other")).alias("label")).agg(F.count("*").alias("n")), "select case currency when 'USD' then 'dollar' when 'EUR' then 'euro' else 'other' end as label, count(*) as n from postings group by 1")


def _halves(s, d):
    p = postings(s, d).select("job_id", "source", "company", "country")
    old = p.where("job_id % 2 = 0 or job_id % 5 = 0").withColumn("company", F.concat("company", F.lit(" Limited")))
    new = p.where("job_id % 2 = 1 or job_id % 5 = 0")
    return old, new.withColumn("country", F.when(F.col("job_id") % 7 != 0, F.col("country")).otherwise(""))


_add(
    "j6_snapshot_enrich", lambda s, d: dedup.enrich(*_halves(s, d), "job_id", ["country"], ["company"]),
    "select job_id, case when job_id % 7 <> 0 then country when job_id % 5 = 0 or job_id % 2 = 0 then country end as country, case when job_id % 5 = 0 then company || ' Limited' else company end as company, job_id % 5 = 0 as matched from postings where job_id % 2 = 1 or job_id % 5 = 0",
)
_add(
    "j10_skill_countries", lambda s, d: candidates(s, d).select("candidate_id", "skill").join(posting_skills(s, d).join(postings(s, d).select("job_id", "country"), "job_id").select("skill", "country").distinct(), "skill").groupBy("candidate_id").agg(F.count_distinct("country").alias("n")),
    "select candidate_id, count(distinct p.country) as n from candidates join (select distinct skill, p.country from posting_skills join postings p using (job_id)) p using (skill) group by 1",
)
# All texts of a language, whatever their length or first letters; SQL would need the product of a language's texts, so brute force on small tables checks it.
_add("j11_similar_pairs", lambda s, d: dedup.whole_pairs(table(s, d, "documents"), "doc_id", "text", [F.col("lang")], 0.85)[0])
_add(
    "j12_as_of_status", lambda s, d: posting_events(s, d).where("ts <= timestamp '2024-01-15 00:00:00'").groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status")),
    "select job_id, status from (select job_id, status, row_number() over (partition by job_id order by ts desc, event_id desc) as r from posting_events where ts <= timestamp '2024-01-15 00:00:00') where r = 1",
)


def _dup(s, d):
    p = postings(s, d).select("job_id", "source", "company", "country")
    return dedup.union_sources(p, p.where("job_id % 10 = 0").withColumn("source", F.lit("AGAIN")))


_DUP = "(select job_id, source, company, country, 0 as src_priority from postings union all select job_id, 'AGAIN', company, country, 1 from postings where job_id % 10 = 0)"
_add("u1_union", lambda s, d: _dup(s, d).groupBy("src_priority").agg(F.count("*").alias("n")), f"select src_priority, count(*) as n from {_DUP} group by 1")
_add("u2_keep_first", lambda s, d: dedup.keep_first(_dup(s, d), ["job_id"], ["src_priority"]).select("job_id", "source"), "select job_id, source from postings")
_add("u3_composite_key", lambda s, d: dedup.keep_first(_dup(s, d).withColumn("key", T.dedup_key(F.col("company"), F.col("country"))), ["key"], ["src_priority", "job_id"]).select("key", "job_id"), f"select md5(lower(company) || '|' || lower(country)) as key, arg_min(job_id, (src_priority, job_id)) as job_id from {_DUP} group by 1")


def _u4(s, d):
    """By the address first (without query, fragment and closing slash), then by the fingerprint of what is left."""
    url = F.concat(F.lit("https://example.org/jobs/"), F.floor(F.col("job_id") / 2).cast("string"), F.when(F.col("src_priority") == 1, "/?from=again").otherwise("/"))
    one = dedup.keep_first(_dup(s, d).withColumn("url", T.normalize_url(url)), ["url"], ["src_priority", "job_id"])
    two = one.withColumn("print", T.fingerprint(F.lit("Job"), F.col("company"), F.col("country")))
    return dedup.keep_first(two, ["print"], ["src_priority", "job_id"]).select("job_id", "company", "url")


_add("u4_two_step", _u4, "select min(job_id) as job_id, company, 'https://example.org/jobs/' || (min(job_id) // 2) as url from (select min(job_id) as job_id, arg_min(company, job_id) as company, arg_min(country, job_id) as country from postings group by job_id // 2) group by company, country")
_add("u5_accumulate", lambda s, d: (lambda old, new: old.unionByName(new.join(old, "job_id", "left_anti")).groupBy(F.col("company").endswith("Limited").alias("old")).agg(F.count("*").alias("n")))(*_halves(s, d)), "select job_id % 2 = 0 or job_id % 5 = 0 as old, count(*) as n from postings group by 1")


def _u6(s, d):
    """A foreign dataset: ids hashed anew, mode and source spellings mapped, country, category and currency told by the text where the columns are empty; the first of each id."""
    t = posting_text(s, d)
    mode = F.element_at(F.array(F.lit("On Site"), F.lit("REMOTE"), F.lit("")), (F.col("job_id") % 3 + 1).cast("int"))
    c = F.col("description")
    rows = t.select(
        T.stable_id(F.lower(F.regexp_replace("source", " ", "_")), F.floor(F.col("job_id") / 2).cast("string")).alias("new_id"), "job_id", T.normalize_work_mode(mode, c).alias("work_mode"),
        F.coalesce(F.when(F.col("job_id") % 2 == 0, F.col("country")), T.first_contained(c, ["that", "pour", "und", "para"])).alias("country"), T.tech_category(c).alias("category"), T.guess_currency(c).alias("currency"))
    return dedup.keep_first(rows, ["new_id"], ["job_id"])


def _u6_sql():
    from postlens.plans import q_text

    part = lambda q: f"({q_text.QUERIES[q][1]})"
    return f"""select new_id, job_id, case job_id % 3 when 0 then 'onsite' when 1 then 'remote' else g.value end as work_mode, case when job_id % 2 = 0 then country else c.value end as country, k.value as category, m.value as currency
from (select substr(sha256(lower(source) || '|' || (job_id // 2)), 1, 16) as new_id, min(job_id) as job_id from posting_text group by 1) x join posting_text using (job_id)
join {part('p15_guess_work_mode')} g using (job_id) join {part('p9_guess_country')} c using (job_id) join {part('p20_tech_category')} k using (job_id) join {part('p21_guess_currency')} m using (job_id)"""


_add("u6_rekey", _u6, _u6_sql())
_add("u7_upsert", lambda s, d: dedup.upsert(*_halves(s, d), "job_id", ["company", "country"]), "select job_id, case when job_id % 2 = 0 and job_id % 5 <> 0 then company || ' Limited' else company end as company, case when job_id % 2 = 1 and job_id % 5 <> 0 and job_id % 7 = 0 then null else country end as country, case when job_id % 5 = 0 then 'updated' when job_id % 2 = 0 then 'kept' else 'created' end as action from postings")


def _store(s, d):
    """A store of every second posting, as it was seen before."""
    k = F.col("job_id")
    return postings(s, d).where("job_id % 2 = 0").select(
        "source", k.cast("string").alias("source_job_id"), F.concat(F.lit("Old "), "seniority").alias("title"), "company", F.concat(F.lit("Old text of "), "company", F.repeat(F.lit("!"), (k % 40).cast("int"))).alias("description"),
        "country", F.lit("Town").alias("city"), "work_mode", F.lit("Full-Time").alias("employment_type"), F.lit("https://old.example.org").alias("source_url"), (F.col("work_mode") == "remote").alias("remote"),
        F.col("date_posted").alias("posted_at"), F.lit(None).cast("date").alias("expires_at"), F.lit("2024-01-01").cast("date").alias("created_at"))


def _incoming(s, d):
    """A batch of a third of the postings: blanks, long texts, rows without an id and rows that come twice."""
    k = F.col("job_id")
    rows = postings(s, d).where("job_id % 3 = 0").select(
        F.when(k % 21 == 0, "").otherwise(F.col("source")).alias("source"), F.when(k % 33 == 0, " ").otherwise(k.cast("string")).alias("source_job_id"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("New "), F.repeat("seniority", 40))).alias("title"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "company", F.lit(" "))).alias("company"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("New text of "), "company")).alias("description"),
        F.when(k % 4 == 0, "").otherwise(F.col("country")).alias("country"), F.lit("").alias("city"), F.when(k % 6 == 0, "Unknown").otherwise(F.upper("work_mode")).alias("work_mode"), F.when(k % 13 == 0, "Global").alias("remote_scope"),
        F.when(k % 17 == 0, "Yes").alias("remote_eligible"), F.lit("Contract").alias("employment_type"), F.lit("https://new.example.org").alias("source_url"), F.when(k % 8 != 0, F.col("date_posted")).alias("posted_at"), F.lit(None).cast("date").alias("expires_at"),
        F.lit(1).alias("place"))
    again = rows.where("source_job_id like '%3'").withColumns({"title": F.lit("Second"), "place": F.lit(2)})
    return rows.unionByName(again)


_UP_COLUMNS = "source, source_job_id, title, company, description, country, city, work_mode, employment_type, source_url, remote, posted_at, expires_at, created_at"
_STORE = """(select source, cast(job_id as varchar) as source_job_id, 'Old ' || seniority as title, company, 'Old text of ' || company || repeat('!', job_id % 40) as description, country, 'Town' as city, work_mode,
  'Full-Time' as employment_type, 'https://old.example.org' as source_url, work_mode = 'remote' as remote, date_posted as posted_at, null::date as expires_at, date '2024-01-01' as created_at from postings where job_id % 2 = 0)"""
_BATCH = """(select case when job_id % 21 = 0 then 'import' else source end as source, cast(job_id as varchar) as source_job_id, case when job_id % 10 = 3 then 'Second' when job_id % 9 = 0 then '' else 'New ' || repeat(seniority, 40) end as title,
  case when job_id % 7 = 0 then '' else company end as company, case when job_id % 5 = 0 then '' else 'New text of ' || company end as description, case when job_id % 4 = 0 then '' else country end as country,
  case when job_id % 6 = 0 then 'unknown' else work_mode end as mode, job_id % 13 = 0 as scoped, job_id % 17 = 0 as eligible, case when job_id % 8 <> 0 then date_posted end as posted_at
  from postings where job_id % 3 = 0 and job_id % 33 <> 0)"""


def _ingested(preserve):
    old = lambda c: f"case when o.source is not null then {c} end" if preserve else "null"
    text = lambda c, n: f"coalesce(nullif(substr(b.{c}, 1, {n}), ''), {old('o.' + c)})"
    known = "(o.source is not null)"
    longest = "case when length(coalesce(o.description, '')) >= length(b.description) then o.description else b.description end" if preserve else "b.description"
    mode = f"case when {known} and b.mode = 'unknown' then coalesce(nullif(o.work_mode, ''), 'unknown') else b.mode end" if preserve else "b.mode"
    signal = "(b.mode <> 'unknown' or scoped or eligible)"
    remote = "(b.mode in ('remote', 'hybrid') or scoped or eligible)"
    kept = f"case when {known} and not {signal} then o.remote else {remote} end" if preserve else remote
    return f"""select coalesce(b.source, o.source) as source, coalesce(b.source_job_id, o.source_job_id) as source_job_id,
  case when b.source is null then o.title else coalesce(nullif(substr(b.title, 1, 255), ''), o.title, '') end as title, case when b.source is null then o.company else {text('company', 255)} end as company,
  case when b.source is null then o.description else nullif(substr({longest}, 1, 65535), '') end as description, case when b.source is null then o.country else {text('country', 100)} end as country,
  case when b.source is null then o.city else {old('o.city')} end as city, case when b.source is null then o.work_mode else {mode} end as work_mode, case when b.source is null then o.employment_type else 'Contract' end as employment_type,
  case when b.source is null then o.source_url else 'https://new.example.org' end as source_url, case when b.source is null then o.remote else {kept} end as remote,
  case when b.source is null then o.posted_at else coalesce(b.posted_at, {old('o.posted_at') if preserve else 'null::date'}) end as posted_at, null::date as expires_at, coalesce(o.created_at, date '2024-02-01') as created_at,
  case when b.source is null then 'kept' when o.source is null then 'created' else 'updated' end as action from {_STORE} o full join {_BATCH} b on o.source = b.source and o.source_job_id = b.source_job_id"""


def _ingest(s, d, preserve):
    return dedup.ingest(_store(s, d), _incoming(s, d), "place", preserve, "2024-02-01", "import")


_add("u7_ingest", lambda s, d: _ingest(s, d, False), _ingested(False))
_add("u7_ingest_preserving", lambda s, d: _ingest(s, d, True), _ingested(True))
_add("u7_ingest_counts", lambda s, d: dedup.ingest_counts(_ingest(s, d, True), _incoming(s, d)), f"select count(*) filter (where action = 'created') as created, count(*) filter (where action = 'updated') as updated, (select count(*) from postings where job_id % 33 = 0) as skipped, count(*) filter (where action <> 'kept') as total_processed from ({_ingested(True)})")


def _u8(s, d):
    """New links of a batch: skills of the text, of the serialized list and of the title's words and role, without those that are linked."""
    from postlens.operators import skills as K
    from postlens.plans.q_skills import _ROLES, TAXONOMY

    t = posting_text(s, d).withColumn("_title", F.concat_ws(" ", "source", F.when(F.col("job_id") % 3 == 0, "python ring")))
    text = K.extract(t, "job_id", "description", TAXONOMY).select("job_id", "skill").union(K.extract(t, "job_id", "_title", TAXONOMY).select("job_id", "skill")).union(K.from_titles(t, "job_id", "_title", _ROLES))
    listed = t.select("job_id", F.explode(F.from_json(F.when(F.col("job_id") % 4 == 0, '["kubernetes", " xgboost ", ""]'), "array<string>")).alias("skill"))
    linked = t.where("job_id % 2 = 0").select("job_id", F.lit("the").alias("skill"))
    return dedup.new_links(linked, text, listed)




def _u8_sql():
    from postlens.plans.q_skills import _EXTRACT, TAXONOMY, _found

    titled = "(select job_id, concat_ws(' ', source, case when job_id % 3 = 0 then 'python ring' end) as title from posting_text)"
    return f"""select job_id, skill from (select job_id, skill from {_EXTRACT} union select job_id, skill from {_found('title', titled)} union select job_id, unnest(['metal', 'design']) from posting_text where job_id % 3 = 0
  union select job_id, unnest(['kubernetes', 'xgboost']) from posting_text where job_id % 4 = 0) except select job_id, 'the' from posting_text where job_id % 2 = 0"""
_add(
    "u9_set_operations",
    lambda s, d: (lambda k: k.groupBy("job_id").agg(F.collect_set(F.when(F.col("is_preferred"), F.col("category"))).alias("p"), F.collect_set(F.when(~F.col("is_preferred"), F.col("category"))).alias("r")).select("job_id", F.size(F.array_intersect("p", "r")).alias("both"), F.size(F.array_except("p", "r")).alias("only_p"), F.size(F.array_union("p", "r")).alias("all")))(posting_skills(s, d)),
    "select job_id, cast(count(*) filter (where p and r) as int) as \"both\", cast(count(*) filter (where p and not r) as int) as only_p, cast(count(*) as int) as \"all\" from (select job_id, category, bool_or(is_preferred) as p, bool_or(not is_preferred) as r from posting_skills group by 1, 2) group by 1",
)
_W = Window
_add("w1_batch_flag", lambda s, d: postings(s, d).withColumn("n", F.count("job_id").over(_W.partitionBy("source", "date_posted"))).select("job_id", (F.col("n") >= 5).alias("suspect")), "select job_id, count(job_id) over (partition by source, date_posted) >= 5 as suspect from postings")
_add("w2_age_days", lambda s, d: (lambda p: p.crossJoin(F.broadcast(p.agg(F.date_add(F.max("date_posted"), 1).alias("scraped")))).select("job_id", F.datediff("scraped", "date_posted").alias("age")))(postings(s, d)), "select job_id, cast((select max(date_posted) + 1 from postings) - date_posted as int) as age from postings")
_add("w7_latest_per_job", lambda s, d: posting_events(s, d).groupBy("job_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")), "select job_id, arg_max(event_id, (ts, event_id)) as event_id from posting_events group by 1")


def _u10(s, d):
    df = table(s, d, "documents")
    pairs, copies = dedup.whole_pairs(df, "doc_id", "text", [F.col("lang")], 0.85)
    return dedup.clusters(files.save(pairs.select("a", "b").unionByName(copies)), df.select("doc_id"), "doc_id", files.save)


_add("u10_clusters", _u10)
_add("s2_parquet_snapshot", lambda s, d: files.save(postings(s, d).select("job_id", "source", "salary_min")), "select job_id, source, salary_min from postings")


def _s11(s, d):
    path = f"{files.work_dir(s)}/json-{uuid.uuid4().hex}"
    files.write_json(postings(s, d).groupBy("country").agg(F.count("*").alias("n")), path)
    return s.read.schema("country string, n long").json(path)


_add("s11_json_sink", _s11, "select country, count(*) as n from postings group by 1")
_add("u8_link_upsert", _u8, _u8_sql())
