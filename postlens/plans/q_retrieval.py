"""Retrieval, question routing, model jobs and evaluation."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from postlens.functions import terms
from postlens.functions import text as T
from postlens.operators import evaluate as E
from postlens.operators import ml
from postlens.operators import retrieval as V
from postlens.operators import aggregates as A
from postlens.operators import skills as K
from postlens.plans import q_aggregates, q_skills, q_text
from postlens.plans.q_skills import _EXTRACT, CONTEXT, PHRASES, TAXONOMY
from postlens.sources import files
from postlens.sources.fixtures import ASKED, posting_skills, posting_text, postings, questions, table

QUERIES: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = (run, sql)


_IDX = """tok as (select job_id, unnest(regexp_extract_all(lower(description), '[a-z]{3,}')) as term from posting_text),
tf as (select job_id, term, count(*) as tf from tok group by 1, 2), nn as (select count(*) as n from posting_text),
voc as (select term, ln((1 + n)::double / (1 + df)) + 1 as idf from (select term, count(*) as df, sum(tf) as cf from tf group by 1), nn where df >= 2 and df <= 0.95 * n order by cf desc, term limit 3000),
w as (select job_id, term, (1 + ln(tf)) * idf as w from tf join voc using (term)),
idx as (select job_id, term, w / sqrt(sum(w * w) over (partition by job_id)) as weight from w),
qtok as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as term from benchmark),
qw as (select item_id, term, (1 + ln(count(*))) * idf as w from qtok join voc using (term) group by item_id, term, idf),
q as (select item_id, term, w / sqrt(sum(w * w) over (partition by item_id)) as q from qw),
sc as (select item_id, job_id, round(sum(q * weight), 6) as score from q join idx using (term) group by 1, 2),
hit as (select * from (select item_id, job_id, score, cast(row_number() over (partition by item_id order by score desc, job_id) as int) as rank from (select *, max((score >= 0.1)::int) over (partition by item_id) as p from sc) where p = 0 or score >= 0.1) where rank <= 5)"""


def _sql(body: str) -> str:
    """The index's CTEs stand in a subquery, so that the projections' CTEs can come before."""
    return f"select * from (with {_IDX} {body})"


def _index(s, d):
    return V.index(posting_text(s, d), "job_id", "description")


def _hits(s, d):
    """The best five postings for each benchmark text as a whole."""
    idx, voc = V.packed_index(posting_text(s, d), "job_id", "description")
    return V.search(idx, "job_id", V.project(table(s, d, "benchmark").select("item_id", "text"), "item_id", "text", voc), "item_id")


_add("v1_index", lambda s, d: _index(s, d)[0].groupBy("job_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total")), _sql("select job_id, count(*) as terms, round(sum(weight), 4) as total from idx group by 1"))
_add("v2_search", _hits, _sql("select item_id, job_id, score, rank from hit"))
_add("v3_dense", lambda s, d: V.dense_top(table(s, d, "embeddings").select("vec_id", "embedding"), table(s, d, "embeddings").where("vec_id % 50 = 0")), "select * from (select q.vec_id as query_id, v.vec_id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) as score, cast(row_number() over (partition by q.vec_id order by round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) desc, v.vec_id) as int) as rank from embeddings v, embeddings q where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id) where rank <= 5")
_strong = lambda hits: hits.groupBy("item_id").agg(((F.max("score") >= 0.2) & (F.avg(F.when(F.col("rank") <= 3, F.col("score"))) >= 0.16)).alias("strong"))
_add("v4_strong_match", lambda s, d: _strong(_hits(s, d)), _sql("select item_id, max(score) >= 0.2 and avg(score) filter (where rank <= 3) >= 0.16 as strong from hit group by 1"))


def _v5(s, d):
    """Blocks of the ranked postings: a head line and the beginning of the text."""
    told = _hits(s, d).join(posting_text(s, d).select("job_id", "source", "country", F.substring("description", 1, 300).alias("text")), "job_id")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("job_id").cast("string"), F.lit(" | "), "source", F.lit(" | "), "country", F.lit("\n"), "text")
    return told.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b), "\n---\n").alias("context"))


_add("v5_context", _v5, _sql("select item_id, string_agg('[' || rank || '] ' || job_id || ' | ' || source || ' | ' || country || chr(10) || substr(description, 1, 300), chr(10) || '---' || chr(10) order by rank) as context from hit join posting_text using (job_id) group by 1"))
def _v6(s, d):
    return questions(s, d).select("conv_id", "turn", V.question_type(F.col("text"), terms.QUESTION_PATTERNS).alias("kind"))


def _words_sql(p):
    """The pattern for an engine whose words are of a-z only."""
    edge = r"[^\p{L}\p{N}_]"
    p = re.sub(r"^\\b", lambda _: f"(?:^|{edge})", p)
    return q_text._q(re.sub(r"\\b$", lambda _: f"(?:$|{edge})", p).replace(r"\w", r"[\p{L}\p{N}_]"))


def _kind_sql(c):
    hits = {k: "(" + " + ".join(f"regexp_matches(lower({c}), {_words_sql(p)})::int" for p in ps) + ")" for k, ps in terms.QUESTION_PATTERNS.items()}
    best = f"greatest({', '.join(hits.values())})"
    return f"case when {best} = 0 then 'general' " + " ".join(f"when {h} = {best} then '{k}'" for k, h in hits.items()) + " end"


_any_sql = lambda c, patterns: "(" + " or ".join(f"regexp_matches(lower({c}), {_words_sql(p)})" for p in patterns) + ")"
_country_sql = lambda c: "case " + " ".join(f"when regexp_matches(lower({c}), {_words_sql(p)}) then '{k}'" for k, p in terms.COUNTRY_PATTERNS.items()) + " end"
_add("v6_question_type", _v6, f"select conv_id, turn, {_kind_sql('text')} as kind from questions")


def _v7(s, d):
    """The country that a question names, whether it asks about the market and about roles, and the skills it mentions."""
    q = questions(s, d).select("*", V.any_pattern(F.col("text"), terms.MARKET_PATTERNS).alias("market"), V.any_pattern(F.col("text"), [terms.ROLE_PATTERN]).alias("role"), V.first_pattern(F.col("text"), terms.COUNTRY_PATTERNS).alias("country"))
    found = K.with_skills(q, "text", TAXONOMY, CONTEXT, PHRASES)
    return found.select("conv_id", "turn", "country", "market", "role", F.array_join("skills", ",").alias("skills"))


_SAID = "(select conv_id * 1000 + turn as job_id, text as description from questions)"
_V7_SKILLS = f"(select job_id, string_agg(skill, ',' order by skill) as skills from (select * from (select job_id, skill from {q_skills._found('description', _SAID)} union select job_id, skill from {q_skills._RESCUED.replace('posting_text', _SAID)}) where (job_id, skill) not in (select (job_id, skill) from {q_skills._MISTAKEN.replace('posting_text', _SAID)})) group by 1)"
_add("v7_question_filters", _v7, f"select conv_id, turn, {_country_sql('text')} as country, {_any_sql('text', terms.MARKET_PATTERNS)} as market, regexp_matches(lower(text), {_words_sql(terms.ROLE_PATTERN)}) as role, coalesce(skills, '') as skills from questions left join {_V7_SKILLS} k on k.job_id = conv_id * 1000 + turn")


def _asked(s, d):
    """Each benchmark text as a question: what it is about, and where."""
    said = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("item_id") % len(ASKED) + 1).cast("int"))
    q = table(s, d, "benchmark").select("item_id", F.concat("text", said).alias("text"))
    market, role = V.any_pattern(F.col("text"), terms.MARKET_PATTERNS), V.any_pattern(F.col("text"), [terms.ROLE_PATTERN])
    route = F.when(market & role, "market roles").when(market, "market skills").otherwise("postings")
    return q.select("item_id", "text", V.question_type(F.col("text"), terms.QUESTION_PATTERNS).alias("kind"), route.alias("route"), F.upper(V.first_pattern(F.col("text"), terms.COUNTRY_PATTERNS)).alias("place"))


def _market(s, d):
    """``place, route, told``: the three most asked skills and the three most posted roles of each country and of all (place ALL)."""
    jobs = postings(s, d).select("job_id", F.explode(F.array(F.lit("ALL"), "country")).alias("place"), F.col("tech_category").alias("name"))
    skills = posting_skills(s, d).select("job_id", F.col("skill").alias("name")).distinct().join(jobs.select("job_id", "place"), "job_id")
    total = jobs.groupBy("place").agg(F.count("*").alias("total"))
    n = skills.groupBy("place", "name").agg(F.count("*").alias("n")).withColumn("route", F.lit("market skills")).unionByName(jobs.groupBy("place", "name").agg(F.count("*").alias("n")).withColumn("route", F.lit("market roles")))
    top = A.top_per_group(n, ["place", "route"], ["n desc", "name"], 3).join(total, "place")
    part = F.struct("rank", F.concat("name", F.lit(" ("), F.format_number(F.round(F.col("n") * 100.0 / F.col("total"), 1), 1), F.lit(" %)")).alias("t"))
    head = F.when(F.col("route") == "market skills", "Most asked skills: ").otherwise("Most posted roles: ")
    return top.groupBy("place", "route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.t), ", ").alias("told")).select("place", "route", F.concat(head, "told", F.lit(".")).alias("told"))


def _v8(s, d):
    """An answer for each benchmark text as a question: the market's skills or roles (of the country named, if it has postings), or what the best postings say, with a confidence and the sources."""
    questions_, market = _asked(s, d), _market(s, d)
    known = market.select("place").distinct().withColumn("known", F.lit(True))
    questions_ = questions_.join(known, "place", "left").withColumn("place", F.when(F.col("known"), F.col("place")).otherwise("ALL")).drop("known")
    hits = _hits(s, d).join(posting_text(s, d), "job_id")
    hits = K.with_skills(hits.withColumn("level", T.seniority(F.lit(None).cast("string"), F.col("description"))), "description", TAXONOMY, CONTEXT, PHRASES)
    skills = hits.select("item_id", F.explode("skills").alias("skill")).groupBy("item_id", "skill").agg(F.count("*").alias("n"))
    named = A.top_per_group(skills, ["item_id"], ["n desc", "skill"], 3).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda x: x.skill), ", ").alias("skills"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    strong = (F.max("score") >= 0.2) & (F.avg(F.when(F.col("rank") <= 3, F.col("score"))) >= 0.16)
    each = hits.groupBy("item_id").agg(
        F.count("*").alias("found"), listed("country").alias("countries"), listed("level").alias("levels"), F.when(strong, "high").when(F.max("score") >= 0.1, "medium").otherwise("low").alias("confidence"),
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_id"))), lambda x: x.job_id)).alias("sources"))
    text = F.concat(F.col("found").cast("string"), F.lit(" postings match. Skills: "), F.coalesce("skills", F.lit("none")), F.lit(". Countries: "), "countries", F.lit(". Levels: "), "levels", F.lit("."))
    told = questions_.drop("text").join(each.join(named, "item_id", "left").withColumn("text", text), "item_id", "left").join(market, ["place", "route"], "left")
    by_market = F.col("route") != "postings"
    answer = F.when(by_market, F.col("told")).otherwise(F.coalesce("text", F.lit("No posting matches.")))
    return told.select("item_id", "kind", "route", answer.alias("answer"), F.when(by_market, "high").otherwise(F.coalesce("confidence", F.lit("low"))).alias("confidence"), F.when(~by_market, F.coalesce("sources", F.lit("[]"))).alias("sources"))


_LEVEL = f"(select job_id, {q_text._chain([(q_text._has([k]), v) for k, v in terms.SENIORITY_KEYWORDS.items()], 'Mid-Level')} as level from posting_text)"
_ASKED_SQL = f"""(select item_id, {_kind_sql('said')} as kind, case when {_any_sql('said', terms.MARKET_PATTERNS)} then case when regexp_matches(lower(said), {_words_sql(terms.ROLE_PATTERN)}) then 'market roles' else 'market skills' end else 'postings' end as route,
  coalesce((select any_value(country) from postings where country = upper({_country_sql('said')})), 'ALL') as place
  from (select item_id, text || list_extract([{", ".join(map(q_text._q, ASKED))}], cast(item_id % {len(ASKED)} + 1 as int)) as said from benchmark))"""
_MARKET_SQL = """(select place, route, case when route = 'market skills' then 'Most asked skills: ' else 'Most posted roles: ' end || string_agg(name || ' (' || printf('%.1f', round(n * 100.0::double / total, 1)) || ' %)', ', ' order by r) || '.' as told
  from (select *, row_number() over (partition by place, route order by n desc, name) as r from (
    select place, 'market skills' as route, skill as name, count(*) as n from (select distinct job_id, skill from posting_skills) join (select job_id, unnest(['ALL', country]) as place from postings) using (job_id) group by 1, 3
    union all select place, 'market roles', tech_category, count(*) from (select tech_category, unnest(['ALL', country]) as place from postings) group by 1, 3))
  join (select place, count(*) as total from (select unnest(['ALL', country]) as place from postings) group by 1) using (place) where r <= 3 group by 1, 2)"""
_V8 = _sql(f"""select b.item_id, b.kind, b.route, case when b.route <> 'postings' then told else coalesce(f.text, 'No posting matches.') end as answer,
  case when b.route <> 'postings' then 'high' else coalesce(confidence, 'low') end as confidence, case when b.route = 'postings' then coalesce(sources, '[]') end as sources
from {_ASKED_SQL} b left join {_MARKET_SQL} m on m.place = b.place and m.route = b.route
left join (select item_id, count(*) || ' postings match. Skills: ' || coalesce(any_value(k.skills), 'none') || '. Countries: ' || string_agg(distinct country, ', ' order by country) || '. Levels: ' || string_agg(distinct level, ', ' order by level) || '.' as text,
    case when max(score) >= 0.2 and avg(score) filter (where rank <= 3) >= 0.16 then 'high' when max(score) >= 0.1 then 'medium' else 'low' end as confidence, '[' || string_agg(job_id, ',' order by rank) || ']' as sources
  from hit join posting_text using (job_id) join {_LEVEL} using (job_id)
  left join (select item_id, string_agg(skill, ', ' order by n desc, skill) as skills from (select item_id, skill, count(*) as n, row_number() over (partition by item_id order by count(*) desc, skill) as r from hit join {q_skills._ALL_SKILLS} using (job_id) group by 1, 2) where r <= 3 group by 1) k using (item_id)
  group by item_id) f on f.item_id = b.item_id""")
_add("v8_answers", _v8, _V8)
_add("v9_embeddings", lambda s, d: ml.hashing_embeddings(posting_text(s, d), "job_id", "description", 32).select("job_id", F.posexplode("embedding").alias("place", "value")).where("value <> 0").withColumn("value", F.round("value", 6)), r"""select job_id, place, round(n / sqrt(sum(n * n) over (partition by job_id)), 6) as value from (
  select job_id, cast(('0x' || substr(md5(w), 1, 8))::bigint % 32 as int) as place, count(*)::double as n from (select job_id, unnest(regexp_extract_all(lower(description), '[^ \t-\r]+')) as w from posting_text) group by 1, 2)""")

# Model jobs.
_SPELT_LABELS = {"src0": "src1"}  # two spellings of a class


def _training(s, d):
    """Rows to learn from: one spelling of each class, title and real description as the text, classes of 8 rows or more, the test share marked."""
    t = posting_text(s, d).select(F.col("job_id").alias("doc_id"), F.col("source").alias("label"), q_text._title().alias("title"), "description")
    return ml.training_rows(t, "doc_id", "label", "title", "description", _SPELT_LABELS, 8, 0.25)


_M1 = f"""(select doc_id, label, length(text) as size, row_number() over (partition by label order by md5(cast(doc_id as varchar)), doc_id) <= 0.25 * count(*) over (partition by label) as test from (
  select job_id as doc_id, case source when 'src0' then 'src1' else source end as label, concat_ws(' ', {q_text._TITLE_SQL}, case when length(trim(description)) >= 40 then description end) as text from posting_text) qualify count(*) over (partition by label) >= 8)"""
_add("m1_training_split", lambda s, d: _training(s, d).select("doc_id", "label", F.length("text").cast("bigint").alias("size"), "test"), f"select * from {_M1}")


def _labelled(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))


def _held_out(s, d):
    """Labelled documents, learnt from three quarters of each class and tried on the rest."""
    rows = files.save(ml.stratified_split(_labelled(s, d), "doc_id", "label", 0.25), "held-out")  # every fit reads it several times
    return rows.where("not test").drop("test"), rows.where("test").drop("test")


def _predicted(s, d):
    train, test = _held_out(s, d)
    return ml.text_classifier(train).transform(test)


_add("m2_m4_classifier", lambda s, d: ml.top_classes(_predicted(s, d), "doc_id"))
_add("m7_classifier_report", lambda s, d: E.with_f1(E.class_report(_predicted(s, d).select("label", "prediction"), "label", "prediction")))
_add("m6_topics", lambda s, d: ml.topics(table(s, d, "documents").select("doc_id", "text"), 6, 10))


def _m6(s, d):
    """Six topics of the 1,500 commonest terms by non-negative factorisation."""
    index, _ = V.packed_index(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", features=1500)
    h, names, errors = ml.factors(index, "doc_id")
    told = [(k, i, t, round(w, 6), round(errors[-1], 4)) for k, i, t, w in ml.topic_words(h, names, 10)]
    return s.createDataFrame(told, "topic int, place int, term string, weight double, error double")


_add("m6_factors", _m6)


def _m7(s, d):
    """The baseline that a classifier has to beat, on the same held-out rows: the commoner class of the document's source."""
    train, test = _held_out(s, d)
    source = table(s, d, "documents").select("doc_id", "source")
    common = train.join(source, "doc_id").groupBy("source").agg((F.avg("label") >= 0.5).cast("double").alias("guess"))
    guessed = test.join(source, "doc_id").join(common, "source", "left").select("label", F.coalesce("guess", F.lit(0.0)).alias("guess"))
    return E.with_f1(E.class_report(guessed, "label", "guess"))


_add("m7_report", _m7, """select label, tp, predicted, actual, round(coalesce(tp::double / nullif(predicted, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(actual, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(predicted + actual, 0), 0), 6) as f1 from (
  with rows as (select doc_id, toxic::double as label, source, row_number() over (partition by toxic order by md5(cast(doc_id as varchar)), doc_id) <= 0.25 * count(*) over (partition by toxic) as test from labels join documents using (doc_id)),
  common as (select source, (avg(label) >= 0.5)::int::double as guess from rows where not test group by 1),
  told as (select label, coalesce(guess, 0) as guess from rows left join common using (source) where test)
  select l.label, count(*) filter (where t.label = l.label and guess = l.label) as tp, count(*) filter (where guess = l.label) as predicted, count(*) filter (where t.label = l.label) as actual from told t, (select label from told union select guess from told) l group by 1)""")

# Evaluation.
_GOLD = "(select job_id, unnest(case job_id % 6 when 2 then ['python', 'sql', 'kubernetes'] when 1 then ['data engineer'] else ['remote'] end) as skill from posting_text)"


def _gold(s, d):
    k = F.col("job_id") % 6
    return posting_text(s, d).select("job_id", F.explode(F.when(k == 2, F.array(*map(F.lit, ["python", "sql", "kubernetes"]))).when(k == 1, F.array(F.lit("data engineer"))).otherwise(F.array(F.lit("remote")))).alias("skill"))


def _found(s, d):
    return K.extract(posting_text(s, d), "job_id", "description", TAXONOMY).select("job_id", "skill")


_add("e1_set_scores", lambda s, d: E.set_scores(_gold(s, d), _found(s, d), "job_id", "skill"), f"select coalesce(g.skill, f.skill) as skill, count(*) filter (where g.skill is not null and f.skill is not null) as tp, count(*) filter (where g.skill is null) as fp, count(*) filter (where f.skill is null) as fn from {_GOLD} g full join (select job_id, skill from {_EXTRACT}) f on g.job_id = f.job_id and g.skill = f.skill group by 1")


_add("e1_top_errors", lambda s, d: E.top_errors(E.set_scores(_gold(s, d), _found(s, d), "job_id", "skill"), "skill"), f"""select kind, skill, n, cast(r as int) as rank from (select *, row_number() over (partition by kind order by n desc, skill) as r from (
  select skill, unnest(['missed', 'spurious']) as kind, unnest([fn, fp]) as n from ({QUERIES['e1_set_scores'][1]})) where n > 0) where r <= 10""")


def _scored_runs(s, d):
    """Precision, recall and F1 over all pairs and for each category, of the whole extraction and of the plain dictionary."""
    t, gold = posting_text(s, d), _gold(s, d)
    runs = {"whole": K.extract(t, "job_id", "description", TAXONOMY, CONTEXT, PHRASES), "dictionary": _found(s, d)}
    return reduce(lambda a, b: a.unionByName(b), [E.category_scores(gold, f.select("job_id", "skill"), "job_id", "skill", TAXONOMY).withColumn("run", F.lit(k)) for k, f in runs.items()])


_CATEGORY = "(select * from (values " + ", ".join(f"({q_text._q(k)}, {q_text._q(v)})" for k, v in TAXONOMY.items()) + ") as category(skill, category))"
_PRF = "tp, fp, fn, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"
_RUNS = "(" + " union all ".join(f"""select '{run}' as run, coalesce(category, 'ALL') as category, {_PRF} from (
  select category, count(*) filter (where g and f) as tp, count(*) filter (where f and not g) as fp, count(*) filter (where g and not f) as fn
  from (select coalesce(g.skill, f.skill) as skill, g.skill is not null as g, f.skill is not null as f from {_GOLD} g full join (select job_id, skill from {source}) f on g.job_id = f.job_id and g.skill = f.skill) join {_CATEGORY} using (skill) group by rollup (category))""" for run, source in (("whole", q_skills._ALL_SKILLS), ("dictionary", _EXTRACT))) + ")"
_add("e1_category_f1", lambda s, d: _scored_runs(s, d).where("run = 'whole'").drop("run"), f"select * exclude (run) from {_RUNS} where run = 'whole'")


def _levels(s, d):
    """The level that a title names (expected) and the one that the text alone gives (actual); titles without one are left out."""
    t = posting_text(s, d)
    return t.select(T.by_keyword(q_text._title(), terms.SENIORITY_KEYWORDS).alias("expected"), T.seniority(F.lit(None).cast("string"), F.col("description")).alias("actual")).where("expected is not null")


_LEVELS = f"(select {q_text._chain([(q_text._has([k], q_text._TITLE_SQL), v) for k, v in terms.SENIORITY_KEYWORDS.items()])} as expected, level as actual from posting_text join {_LEVEL} using (job_id))"
_FIELDS = ["level", "mode", "employment"]
_WANTED = {"mode": ["remote", "hybrid", "onsite", "remote", None, None], "employment": [None, None, "Full-Time", "Internship", "Contract", None]}  # of the texts' last sentences


def _fields(s, d):
    """Levels, work modes and employment types: what the title or the last sentence says, and what the extraction finds in the text."""
    c, t = F.col("description"), posting_text(s, d)
    gold = lambda f: F.element_at(F.array(*map(F.lit, _WANTED[f])), (F.col("job_id") % 6 + 1).cast("int"))
    return t.select(
        T.by_keyword(q_text._title(), terms.SENIORITY_KEYWORDS).alias("expected_level"), T.seniority(F.lit(None).cast("string"), c).alias("actual_level"),
        gold("mode").alias("expected_mode"), T.extract_work_mode(c).alias("actual_mode"), gold("employment").alias("expected_employment"), T.by_keyword(c, terms.EMPLOYMENT_KEYWORDS).alias("actual_employment"),
    )


_gold_sql = lambda f: f"list_extract([{', '.join('null' if x is None else q_text._q(x) for x in _WANTED[f])}], cast(job_id % 6 + 1 as int))"
_FIELD_ROWS = f"""(select 'level' as field, expected, actual from {_LEVELS} union all select 'mode', {_gold_sql('mode')}, value from ({q_text.QUERIES['p16_extract_work_mode'][1]})
  union all select 'employment', {_gold_sql('employment')}, value from ({q_text.QUERIES['p34_employment_type'][1]}))"""
_FIELD_CONFUSION = f"(select field, expected, coalesce(actual, 'None') as actual, count(*) as n from {_FIELD_ROWS} where expected is not null group by 1, 2, 3)"
_add("e2_field_confusion", lambda s, d: E.field_confusion(_fields(s, d), _FIELDS), f"select * from {_FIELD_CONFUSION}")
_add("e2_field_accuracy", lambda s, d: E.field_accuracy(E.field_confusion(_fields(s, d), _FIELDS)), f"select field, sum(n)::bigint as total, coalesce(sum(n) filter (where expected = actual), 0)::bigint as correct, round(coalesce(sum(n) filter (where expected = actual), 0)::double / sum(n), 3) as accuracy from {_FIELD_CONFUSION} group by 1")
_add("e2_confusion", lambda s, d: _levels(s, d).groupBy("expected", "actual").agg(F.count("*").alias("n")), f"select expected, actual, count(*) as n from {_LEVELS} where expected is not null group by 1, 2")
_add("e2_accuracy", lambda s, d: _levels(s, d).agg(F.count("*").alias("n"), F.round(F.avg((F.col("expected") == F.col("actual")).cast("int")), 6).alias("accuracy")), f"select count(*) as n, round(avg((expected = actual)::int), 6) as accuracy from {_LEVELS} where expected is not null")


def _e4(s, d):
    """A posting is relevant to a question if it has the question's first word of six letters or more."""
    word = table(s, d, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0).alias("word"))
    hits = _hits(s, d).join(word, "item_id").join(posting_text(s, d).select("job_id", F.lower("description").alias("_t")), "job_id")
    return E.ranking(hits.withColumn("relevant", (F.col("word") != "") & F.contains("_t", "word")), "item_id")


_add("e4_ranking_metrics", _e4, _sql("""select item_id, round(count(*) filter (where rel and rank <= 3) / 3.0::double, 4) as p_at_3, round(count(*) filter (where rel and rank <= 5) / 5.0::double, 4) as p_at_5,
  round(coalesce(count(*) filter (where rel and rank <= 5)::double / nullif(count(*) filter (where rel), 0), 0), 4) as r_at_5, round(coalesce(1.0::double / min(rank) filter (where rel), 0), 4) as mrr, max(score) < 0.2 as low_confidence
from (select hit.*, word <> '' and contains(lower(description), word) as rel from hit join (select item_id, regexp_extract(lower(text), '[a-z]{6,}') as word from benchmark) using (item_id) join posting_text using (job_id)) group by 1"""))
_add("e7_stratified_sample", lambda s, d: ml.stratified_sample(table(s, d, "documents").select("doc_id", "source"), "doc_id", "source", 30), "select doc_id, source from (select doc_id, source, row_number() over (order by r, md5(cast(doc_id as varchar)), doc_id) as k from (select *, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) as r from documents)) where k <= 30")
_CONTEXT_WORDS = [*terms.TECH_KEYWORDS, "experience", "years"]
_WINDOW = "substr(lower(description), greatest(strpos(lower(description), skill) - 40, 1), 80 + length(skill))"
_add("e8_context_check", lambda s, d: E.in_context(_found(s, d), posting_text(s, d), "job_id", "description", _CONTEXT_WORDS), f"select job_id, skill, {q_text._has(_CONTEXT_WORDS, _WINDOW)} as technical from {_EXTRACT} join posting_text using (job_id)")


def _misses(s, d):
    """Terms that a posting's texts have within a longer word, where the extraction found none: one pass over the texts, which tells what they hold and what was found."""

    def told(words, low):
        held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in TAXONOMY if len(t) > 3]))
        return T.let(K.known(words, low, TAXONOMY), lambda found: F.transform(held, lambda x: F.struct(x.alias("skill"), F.array_contains(found, x).alias("found"))))

    each = posting_text(s, d).select("job_id", F.explode(K.per_text(F.col("description"), told)).alias("_h")).select("job_id", "_h.*")
    return each.groupBy("job_id", "skill").agg(F.max("found").alias("found")).where("not found").groupBy("skill").agg(F.count("*").alias("missed"))


_add("e8_misses", _misses, "select skill, count(*) as missed from (select job_id, skill from (" + " union all ".join(f"select job_id, {q_text._q(t)} as skill from posting_text where contains(lower(description), {q_text._q(t)})" for t in TAXONOMY if len(t) > 3) + f") except select job_id, skill from {_EXTRACT}) group by 1")


def _e9(s, d):
    text = F.col("description")
    e = q_skills.enrich(posting_text(s, d), text_level=T.seniority(F.lit(None).cast("string"), text), near_empty=F.length(text) < 40)
    pct = lambda c: F.round(F.avg(c.cast("int")) * 100, 2)
    named = T.by_keyword(q_text._title(), terms.SENIORITY_KEYWORDS)
    return e.agg(
        F.count("*").alias("n"), pct(F.col("years") > 0).alias("years_pct"), pct(F.col("skill_count") > 0).alias("skills_pct"), pct(F.col("mode").isNotNull()).alias("mode_pct"), pct(F.col("employment").isNotNull()).alias("employment_pct"),
        pct(F.col("education") != "").alias("education_pct"), pct(F.col("salary_low").isNotNull()).alias("salary_pct"), pct(F.col("near_empty")).alias("near_empty_pct"),
        pct(F.when(named.isNotNull(), F.col("text_level") == named)).alias("level_agreement_pct"))


_add("e9_coverage", _e9, f"""select count(*) as n, round(avg((years > 0)::int) * 100, 2) as years_pct, round(avg((skill_count > 0)::int) * 100, 2) as skills_pct, round(avg((mode is not null)::int) * 100, 2) as mode_pct, round(avg((employment is not null)::int) * 100, 2) as employment_pct,
  round(avg((education <> '')::int) * 100, 2) as education_pct, round(avg((salary_low is not null)::int) * 100, 2) as salary_pct, round(avg(near_empty::int) * 100, 2) as near_empty_pct, round(avg((expected = level)::int) * 100, 2) as level_agreement_pct
from ({q_skills.ENRICH_SQL}) join {_LEVEL} using (job_id) join (select job_id, length(description) < 40 as near_empty, {q_text._chain([(q_text._has([k], q_text._TITLE_SQL), v) for k, v in terms.SENIORITY_KEYWORDS.items()])} as expected from posting_text) using (job_id)""")
_add("e9_mismatches", lambda s, d: posting_text(s, d).select("job_id", T.by_keyword(q_text._title(), terms.SENIORITY_KEYWORDS).alias("expected"), T.seniority(F.lit(None).cast("string"), F.col("description")).alias("actual")).where("expected <> actual").orderBy("job_id").limit(10), f"select job_id, expected, level as actual from (select job_id, {q_text._chain([(q_text._has([k], q_text._TITLE_SQL), v) for k, v in terms.SENIORITY_KEYWORDS.items()])} as expected from posting_text) join {_LEVEL} using (job_id) where expected <> level order by job_id limit 10")


def _e10(s, d):
    """The metrics of the whole extraction against the run before it, by the dictionary alone."""
    long = E.long(_scored_runs(s, d).where("category = 'ALL'"), ["run"], ["precision", "recall", "f1"])
    return E.deltas(long.where("run = 'whole'"), long.where("run = 'dictionary'"), 0.005)


_add("e10_metric_delta", _e10, "select metric, value, previous, case when abs(value - previous) <= 0.005 then 'same' when value > previous then 'up' else 'down' end as trend from (" + " union all ".join(f"select '{m}' as metric, max({m}) filter (where run = 'whole') as value, max({m}) filter (where run = 'dictionary') as previous from {_RUNS} where category = 'ALL'" for m in ("precision", "recall", "f1")) + ")")
_corpus = lambda hits: hits.groupBy("job_id").agg(F.count("*").alias("queries"), F.max("score").alias("best"))
_add("j8_query_corpus", lambda s, d: _corpus(_hits(s, d)), _sql("select job_id, count(*) as queries, max(score) as best from hit group by 1"))


def _m3(s, d):
    return s.createDataFrame([(*map(str, c.values()), round(f1, 4)) for c, f1 in ml.tuned(_labelled(s, d))], "terms string, words string, least string, c string, f1 double")


_add("m3_grid_search", _m3)


def _m5(s, d):
    """A model that was saved and read again tells the same as before."""
    path = f"{files.work_dir(s)}/model-{uuid.uuid4().hex}"
    train, test = _held_out(s, d)
    model = ml.text_classifier(train)
    model.write().save(path)
    again = PipelineModel.load(path).transform(test).select("doc_id", F.col("prediction").alias("loaded"))
    return model.transform(test).select("doc_id", "prediction").join(again, "doc_id").withColumn("same", F.col("prediction") == F.col("loaded"))


_add("m5_save_load", _m5)
_ALIASES = list(terms.SKILL_ALIASES.items())


def _alias_at():
    return F.pmod("p_partkey", F.lit(len(_ALIASES))).cast("int") + 1


_add(
    "e5_alias_cases",
    lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(f"  {k.upper()} ") for k, _ in _ALIASES]), _alias_at()).alias("given"), F.element_at(F.array(*[F.lit(v) for _, v in _ALIASES]), _alias_at()).alias("expected")).withColumn("got", F.element_at(T.canonical_skills(F.array("given")), 1))
    .groupBy("given").agg(F.count("*").alias("n"), F.round(F.avg((F.col("got") == F.col("expected")).cast("int")), 4).alias("accuracy"), F.count_if(F.col("got") != F.col("expected")).alias("failures")),
    "select list_extract([" + ", ".join(q_text._q(f"  {k.upper()} ") for k, _ in _ALIASES) + f"], cast(p_partkey % {len(_ALIASES)} + 1 as int)) as given, count(*) as n, 1.0::double as accuracy, 0::bigint as failures from part group by 1",
)


# Cases of the matcher: a candidate's skills, a posting's, what is matched and missing, and the score.
_CASES = [
    (["python", "django", "postgresql"], ["python", "django", "postgresql"], ["python", "django", "postgresql"], [], 1.0),
    (["python", "django", "redis"], ["python", "django", "postgresql", "redis", "aws"], ["python", "django", "redis"], ["postgresql", "aws"], 0.6),
    (["java", "spring"], ["python", "django"], [], ["python", "django"], 0.0),
    (["python", "django"], [], [], [], 0.0),
    ([], ["python", "django"], [], ["python", "django"], 0.0),
    (["golang", "python"], ["go", "python"], ["go", "python"], [], 1.0),
    (["sklearn", "pandas"], ["scikit-learn", "pandas", "tensorflow"], ["scikit-learn", "pandas"], ["tensorflow"], 2 / 3),
    (["docker", "k8s"], ["docker", "kubernetes", "terraform"], ["docker", "kubernetes"], ["terraform"], 2 / 3),
]


def _matcher(s, d):
    """The cases, one for each part by turns: how often match and score are as expected, and the first case that fails."""
    case = F.from_json(F.lit(json.dumps([dict(zip(("candidate", "job", "matched", "missing", "score"), c)) for c in _CASES])), "array<struct<candidate:array<string>,job:array<string>,matched:array<string>,missing:array<string>,score:double>>")
    k = F.pmod("p_partkey", F.lit(len(_CASES))).cast("int")
    told = E.matcher_cases(table(s, d, "part").select(k.alias("case"), F.element_at(case, k + 1).alias("c")).select("case", "c.*"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 3).alias(c)
    return told.groupBy("case").agg(F.count("*").alias("n"), share("match_ok"), share("score_ok"), F.round(F.max("got_score"), 3).alias("score"), F.max(F.array_join(F.array_sort("got_missing"), ",")).alias("missing"))


_add("e5_matcher_cases", _matcher, f"""select cast(p_partkey % {len(_CASES)} as int) as case, count(*) as n, 1.0::double as match_ok, 1.0::double as score_ok, list_extract([{", ".join(f"{c[4]}::double" for c in _CASES)}], cast(p_partkey % {len(_CASES)} + 1 as int)).round(3) as score,
  list_extract([{", ".join(q_text._q(",".join(sorted(c[3]))) for c in _CASES)}], cast(p_partkey % {len(_CASES)} + 1 as int)) as missing from part group by all""")


def _e6(s, d):
    """Of each answer: words, whether it stands on postings or counts, its parts, the question's words in it, and whether the route is the right one."""
    asked = table(s, d, "benchmark").select("item_id", F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))), 1, 3).alias("_w"), F.lit(1).alias("_1")).join(_asked(s, d).select("item_id", (F.col("route") != "postings").alias("_m")), "item_id")
    parts = sum((F.contains("answer", F.lit(p)).cast("int") for p in ("Skills: ", "Countries: ", "Levels: ")), F.lit(0))
    covered = F.size(F.filter("_w", lambda w: F.contains(F.lower("answer"), w)))
    return _v8(s, d).join(asked, "item_id").select(
        "item_id", F.size(F.split("answer", " ")).alias("words"), F.col("answer").rlike("postings|skills|roles").alias("grounded"), F.when(F.col("route") != "postings", 1.0).otherwise(F.round(parts / 3, 4)).alias("structure"),
        F.when(F.size("_w") > 0, F.round(covered / F.size("_w"), 4)).alias("coverage"), (F.col("_m") == (F.col("route") != "postings")).alias("type_correct"))


_add("e6_answer_metrics", _e6, f"""select a.item_id, cast(len(string_split(answer, ' ')) as int) as words, regexp_matches(answer, 'postings|skills|roles') as grounded,
  case when a.route <> 'postings' then 1.0::double else round((contains(answer, 'Skills: ')::int + contains(answer, 'Countries: ')::int + contains(answer, 'Levels: ')::int)::double / 3, 4) end as structure,
  case when len(w) > 0 then round(len(list_filter(w, lambda x: contains(lower(answer), x)))::double / len(w), 4) end as coverage, (k.route <> 'postings') = (a.route <> 'postings') as type_correct
from ({_V8}) a join (select item_id, text, list_slice(list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}')), 1, 3) as w from benchmark) using (item_id) join {_ASKED_SQL} k on k.item_id = a.item_id""")
