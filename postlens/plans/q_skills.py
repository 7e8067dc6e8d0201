"""Skill extraction and enrichment over posting text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from postlens.functions import terms
from postlens.functions import text as T
from postlens.operators import aggregates as A
from postlens.operators import skills as K
from postlens.plans import q_text
from postlens.sources import files
from postlens.sources.fixtures import posting_skills, posting_text, postings, table

QUERIES: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = (run, sql)


#: The default dictionary and some words that occur in the test tables.
TAXONOMY = terms.SKILLS | {
    "data engineer": "role", "full-time": "terms", "on-site": "terms", "the": "filler", "pour": "filler", "und": "filler", "senior": "level", "phd": "education",
    "remote": "mode", "10+": "years", "$4000": "money",
}
CONTEXT = terms.CONTEXT_PATTERNS | {"kubernetes": [r"aws certified.*contract"], "python": [r"data engineer"]}
PHRASES = terms.FALSE_POSITIVES | {"remote": ["worldwide remote"]}


def _hit(term, c="description"):
    return f"regexp_matches(lower({c}), {q_text._q(K.boundary(term))})"


def _found(c="description", frm="posting_text", taxonomy=TAXONOMY):
    return "(" + " union all ".join(f"select job_id, {q_text._q(t)} as skill, {q_text._q(k)} as category from {frm} where {_hit(t, c)}" for t, k in taxonomy.items()) + ")"


_EXTRACT = _found()
_RESCUED = "(" + " union all ".join(f"select job_id, {q_text._q(t)} as skill, {q_text._q(TAXONOMY[t])} as category from posting_text where " + " or ".join(f"regexp_matches(lower(description), {q_text._q(p)})" for p in ps) for t, ps in CONTEXT.items()) + ")"
_MISTAKEN = "(" + " union all ".join(f"select job_id, {q_text._q(t)} as skill from posting_text where {q_text._has(ps)}" for t, ps in PHRASES.items()) + ")"
_ALL_SKILLS = f"(select * from (select * from {_EXTRACT} union select * from {_RESCUED}) where (job_id, skill) not in (select (job_id, skill) from {_MISTAKEN}))"


def _extract(s, d):
    return K.extract(posting_text(s, d), "job_id", "description", TAXONOMY)


def _k2(s, d):
    only = lambda words, low: F.array_except(K.rescued(words, low, TAXONOMY, CONTEXT), K.known(words, low, TAXONOMY))
    return posting_text(s, d).select("job_id", F.explode(K.per_text(F.col("description"), only)).alias("skill"))


_add("k1_extract", _extract, f"select * from {_EXTRACT}")
_add("k2_context_rescue", _k2, f"select job_id, skill from {_RESCUED} except select job_id, skill from {_EXTRACT}")
_add("k3_false_positives", lambda s, d: K.extract(posting_text(s, d), "job_id", "description", TAXONOMY, CONTEXT, PHRASES), f"select * from {_ALL_SKILLS}")
_SYMBOLS = ["10+", "$4000", "c++", ".net", "ci/cd", "on-site", "r", "data engineer"]
_add("k4_symbol_boundaries", lambda s, d: K.extract(posting_text(s, d), "job_id", "description", {t: "x" for t in _SYMBOLS}).select("job_id", "skill"), f"select job_id, skill from {_found(taxonomy={t: 'x' for t in _SYMBOLS})}")
#: A dictionary of any size is a table: here the benchmark's words of four letters or more, and its pairs of words.
_BENCH_WORDS = "select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) as k from benchmark"


def _dictionary(s, d):
    words = table(s, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i < F.size("w")), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    one = words.where("size(w) > 0").select(F.explode(F.concat(F.filter("w", lambda x: F.length(x) > 3), pairs)).alias("term")).distinct()
    return one.select("term", F.when(F.contains("term", F.lit(" ")), "pair").otherwise("word").alias("category"))


_add("k1_large_dictionary", lambda s, d: K.extract_from(posting_text(s, d), "job_id", "description", _dictionary(s, d)), f"""select * from (with b as ({_BENCH_WORDS}), p as (select job_id, string_split(regexp_replace(lower(description), '[^a-z0-9 ]', chr(1), 'g'), ' ') as x from posting_text),
  pieces as (select job_id, unnest(x) as piece, generate_subscripts(x, 1) as k from p)
select distinct job_id, w as skill, 'word' as category from (select job_id, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) as w from posting_text) where w in (select w from b where length(w) > 3)
union all select distinct job_id, term, 'pair' from (select a.job_id, regexp_extract(a.piece, '[a-z0-9]+$') as x, regexp_extract(c.piece, '^[a-z0-9]+') as y, x || ' ' || y as term from pieces a join pieces c on a.job_id = c.job_id and c.k = a.k + 1)
  join (select distinct a.w || ' ' || c.w as term from b a join b c on a.item_id = c.item_id and c.k = a.k + 1) using (term) where x <> '' and y <> '')""")
_ROLES = {"ring": ["metal", "design"], "box": ["paper"], "small": ["detail"]}
_add("k5_title_skills", lambda s, d: K.from_titles(table(s, d, "part"), "p_partkey", "p_name", _ROLES), "select distinct p_partkey, skill from part join (values ('ring', 'metal'), ('ring', 'design'), ('box', 'paper'), ('small', 'detail')) r(word, skill) on contains(lower(p_name), word)")
_add("k6_union_of_sources", lambda s, d: _extract(s, d).select("job_id", "skill").union(posting_text(s, d).where("source = 'src0'").select("job_id", F.lit("python").alias("skill"))).distinct().groupBy("skill").agg(F.count("*").alias("n")), f"select skill, count(*) as n from (select job_id, skill from {_EXTRACT} union select job_id, 'python' from posting_text where source = 'src0') group by 1")
_CL = "(select job_id, unnest(regexp_split_to_array(description, '[.\\n]')) as clause from posting_text)"
_add("k7_preferred", lambda s, d: K.preferred(posting_text(s, d), "job_id", "description", {"python": "x", "sql": "x", "kubernetes": "x"}), "select job_id, skill, bool_and(wish) as is_preferred from (" + " union all ".join(f"select job_id, '{t}' as skill, regexp_matches(lower(clause), '{'|'.join(terms.PREFERRED_WORDS)}') as wish from {_CL} where {_hit(t, 'clause')}" for t in ("python", "sql", "kubernetes")) + ") group by 1, 2")
_add("k8_category_counts", lambda s, d: posting_skills(s, d).groupBy("job_id", "category").agg(F.count("*").alias("n")).groupBy("job_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))).alias("summary")), "select job_id, '{' || string_agg('\"' || category || '\":' || n, ',' order by category) || '}' as summary from (select job_id, category, count(*) as n from posting_skills group by 1, 2) group by 1")


def enrich(df, **more):
    """The record enrichment: every column that others read is worked out once for each text. ``more`` are further columns of ``df``."""
    c, title = F.col("description"), F.col("_title")
    both = K.once(
        df.withColumn("_title", q_text._title()),
        _skills=F.array_sort(F.array_union(K.skills_in(c, TAXONOMY, CONTEXT, PHRASES), K.skills_in(title, TAXONOMY, CONTEXT, PHRASES))),
        _money=T.salary(c), _level=T.seniority(title, c),
    )
    skills, money, nothing = F.col("_skills"), F.col("_money"), F.lit(None).cast("string")
    return both.select(
        "job_id", "source", "country", F.array_join(skills, ";").alias("skills"), F.size(skills).alias("skill_count"), F.array_join(K.categories_of(skills, TAXONOMY), ";").alias("categories"),
        T.years_experience(c).alias("years"), F.col("_level").alias("seniority"), T.extract_work_mode(c).alias("mode"), T.by_keyword(c, terms.EMPLOYMENT_KEYWORDS).alias("employment"),
        F.array_join(T.matching_labels(c, terms.EDUCATION), ";").alias("education"), F.array_join(T.labels(c, terms.CERTIFICATIONS), ";").alias("certifications"),
        T.any_contained(c, terms.REMOTE_KEYWORDS).alias("remote_ok"), money["low"].alias("salary_low"), money["high"].alias("salary_high"), money["currency"].alias("salary_currency"),
        retrieval_document(title, nothing, nothing, F.col("country"), nothing, F.col("_level"), nothing, skills, c).alias("document"),
        *[column.alias(k) for k, column in more.items()],
    )


def retrieval_document(title, company, location, country, mode, seniority, employment, skills, description, most=1200):
    """Nine labelled lines, what is known best first."""
    def line(label, value, default="Unknown"):
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(value, F.lit("")), F.lit(default)))

    return F.concat_ws(
        "\n", line("Job Title", title), line("Company", company), line("Location", F.coalesce(F.nullif(location, F.lit("")), country)), line("Country", country), line("Work Mode", mode),
        line("Seniority", seniority), line("Employment Type", employment), line("Skills", F.array_join(skills, ", "), "None listed"), line("Description", F.substring(description, 1, most), "Not available"),
    )


_PART = {
    "years": "p28_years_experience", "seniority": "p31_seniority", "mode": "p16_extract_work_mode", "employment": "p34_employment_type",
    "education": "p29_education", "certifications": "p30_certifications", "remote_ok": "p36_remote_eligible",
}
_TITLED = f"(select job_id, {q_text._TITLE_SQL} as title from posting_text)"
_WITH_TITLE = f"(select job_id, skill, category from {_ALL_SKILLS} union select job_id, skill, category from {_found('title', _TITLED)})"
ENRICH_SQL = (
    "select t.job_id, t.source, t.country, coalesce(k.skills, '') as skills, cast(coalesce(k.n, 0) as int) as skill_count, coalesce(k.categories, '') as categories, " + ", ".join(f"{k}.value as {k}" for k in _PART)
    + ", money.low as salary_low, money.high as salary_high, money.currency as salary_currency, "
    + f"'Job Title: ' || {q_text._TITLE_SQL.replace('job_id', 't.job_id')} || chr(10) || 'Company: Unknown' || chr(10) || 'Location: ' || t.country || chr(10) || 'Country: ' || t.country || chr(10) || 'Work Mode: Unknown' || chr(10) || 'Seniority: ' || seniority.value"
    + " || chr(10) || 'Employment Type: Unknown' || chr(10) || 'Skills: ' || coalesce(replace(k.skills, ';', ', '), 'None listed') || chr(10) || 'Description: ' || substr(description, 1, 1200) as document from posting_text t "
    + f"left join (select job_id, string_agg(skill, ';' order by skill) as skills, count(*) as n, string_agg(distinct category, ';' order by category) as categories from {_WITH_TITLE} group by 1) k on k.job_id = t.job_id "
    + " ".join(f"join ({q_text.QUERIES[q][1]}) {k} on {k}.job_id = t.job_id" for k, q in _PART.items())
    + f" join ({q_text.QUERIES['p22_salary_as_written'][1]}) money on money.job_id = t.job_id"
)
_add("k9_enrich", lambda s, d: enrich(posting_text(s, d)), ENRICH_SQL)
_add("p38_retrieval_document", lambda s, d: enrich(posting_text(s, d)).select("job_id", "document"), f"select job_id, document from ({ENRICH_SQL})")


def read(df):
    """What the summary counts of each text: country, years, seniority, mode, employment and skills, worked out in one pass and written, as its metrics read them several times."""
    c = F.col("description")
    return files.save(df.select(
        "job_id", "country", T.years_experience(c).alias("years"), T.seniority(q_text._title(), c).alias("seniority"), T.extract_work_mode(c).alias("mode"),
        T.by_keyword(c, terms.EMPLOYMENT_KEYWORDS).alias("employment"), K.skills_in(c, TAXONOMY, CONTEXT, PHRASES).alias("skills"),
    ), "read")


def summary(enriched):
    """The run's summary of what was ``read`` as rows of (metric, key, value): distinct skills, the first 15 overall and 10 of each category, counts of levels, modes, types and country by category, years above 0."""
    skills = K.categorised(enriched.select("job_id", F.explode("skills").alias("skill")), TAXONOMY)
    one = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric") if isinstance(metric, str) else metric.alias("metric"), key.alias("key"), value.cast("double").alias("value"))
    n = skills.groupBy("skill", "category").agg(F.count("*").alias("n"))
    overall = A.top_per_group(n.withColumn("all", F.lit(1)), ["all"], ["n desc", "skill"], 15)
    per = A.top_per_group(n, ["category"], ["n desc", "skill"], 10)
    counts = [one(enriched.groupBy(c).agg(F.count("*").alias("n")), c, F.coalesce(c, F.lit("none")), F.col("n")) for c in ("seniority", "mode", "employment")]
    years = enriched.where("years > 0").agg(F.min("years").alias("least"), F.max("years").alias("most"), F.round(F.avg("years"), 4).alias("mean"))
    years = years.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in ("least", "most", "mean")])).alias("x")).select("x.*")
    place = skills.join(enriched.select("job_id", "country"), "job_id").groupBy("country", "category").agg(F.count("*").alias("n"))
    frames = [
        one(n.agg(F.count_distinct("skill").alias("n")), "unique_skills", F.lit("all"), F.col("n")), one(overall, "top_skill", F.col("skill"), F.col("n")),
        one(per, F.concat(F.lit("top of "), F.col("category")), F.col("skill"), F.col("n")), *counts, one(years, "years", F.col("key"), F.col("value")),
        one(place, F.concat(F.lit("categories of "), F.col("country")), F.col("category"), F.col("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _k10(s, d):
    return summary(read(posting_text(s, d)))


_COUNTED = f"(select skill, category, count(*) as n from {_ALL_SKILLS} group by 1, 2)"
_add("k10_summary", _k10, f"""select 'unique_skills' as metric, 'all' as key, count(distinct skill)::double as value from {_COUNTED}
union all select 'top_skill', skill, n::double from (select * from {_COUNTED} order by n desc, skill limit 15)
union all select 'top of ' || category, skill, n::double from (select *, row_number() over (partition by category order by n desc, skill) as r from {_COUNTED}) where r <= 10
""" + "".join(f"union all select '{k}', coalesce(value, 'none'), count(*)::double from ({q_text.QUERIES[_PART[k]][1]}) group by 2 " for k in ("seniority", "mode", "employment")) + f"""
union all select 'years', unnest(['least', 'most', 'mean']), unnest([min(value)::double, max(value)::double, round(avg(value), 4)]) from ({q_text.QUERIES['p28_years_experience'][1]}) where value > 0
union all select 'categories of ' || country, category, count(*)::double from {_ALL_SKILLS} join (select job_id, country from posting_text) using (job_id) group by 1, 2""")
