"""Posting-shaped projections over the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = [
    " 5+ years of experience remote senior", " hybrid role for a data engineer, bachelor degree, $4000 - $6000",
    " minimum 3 years, on-site, full-time, python and sql preferred. kubernetes", " internship worldwide remote KES 50,000",
    " manager with phd and 10+ years, aws certified, contract", "",
]
#: What people ask, put behind the tables' invented texts.
ASKED = [
    " what skills are in demand in kenya?", " show remote jobs", " how do i become a data engineer", " how many jobs in egypt", " what is the salary of a developer", "", " which companies are hiring in nigeria",
    " do i need to learn sql and python?", " top roles in africa", " move into analytics", " market trend", " is kubernetes popular",
]
SENIORITY = ["Entry Level", "Mid-Level", "Senior", "Lead", "Executive"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    key = F.col("o_orderkey")
    level = F.element_at(F.array(*map(F.lit, SENIORITY)), F.substring("o_orderpriority", 1, 1).cast("int"))
    low = F.when(key % 3 != 0, F.col("o_totalprice"))
    return j.select(
        key.alias("job_id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("company"), F.col("n_name").alias("country"),
        F.when(F.col("o_orderstatus") == "F", "remote").when(F.col("o_orderstatus") == "O", "hybrid").otherwise("onsite").alias("work_mode"),
        level.alias("seniority"), (key % 14).cast("int").alias("years_experience"),
        F.element_at(F.array(*map(F.lit, ["USD", "EUR", "KES", "XXX"])), (key % 4 + 1).cast("int")).alias("currency"),
        low.alias("salary_min"), (low * 1.2).alias("salary_max"), F.to_date("o_orderdate").alias("date_posted"), F.col("c_mktsegment").alias("tech_category"),
    )


def posting_skills(spark: SparkSession, d: str, by_job: bool = False) -> DataFrame:
    """``by_job`` deals the rows by posting, for a reader that groups by posting: its groupings then need no further shuffle."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    j = j.repartition("l_orderkey") if by_job else j
    return j.groupBy(F.col("l_orderkey").alias("job_id"), F.lower("p_brand").alias("skill"), F.col("p_type").alias("category")).agg(F.max(F.col("l_returnflag") == "R").alias("is_preferred"))


def posting_text(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), "source", F.concat("text", suffix).alias("description"), F.col("lang").alias("country"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    asked = lambda k: F.element_at(F.array(*map(F.lit, ASKED)), (k % len(ASKED) + 1).cast("int"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", asked(F.col("conv_id") * 5 + F.col("turn"))).alias("text"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    li, p, s, n = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))
    have = li.where("l_quantity >= 50").join(p, li.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("candidate_id"), F.lower("p_brand").alias("skill")).distinct()
    who = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("candidate_id"), (F.col("s_suppkey") % 12).cast("int").alias("years"), F.col("n_name").alias("location"))
    return who.join(have, "candidate_id")


def posting_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "AVAILABLE").when(kind == "error", "REMOVED").when(kind == "purchase", "FILLED").otherwise("SEEN")
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), status.alias("status"), "event_type", "value", "props")


_q = lambda s: "'" + s.replace("'", "''") + "'"
SQL = {
    "postings": f"""postings as (
  select o_orderkey as job_id, c_mktsegment as source, c_name as company, n_name as country,
    case o_orderstatus when 'F' then 'remote' when 'O' then 'hybrid' else 'onsite' end as work_mode,
    list_extract([{", ".join(map(_q, SENIORITY))}], cast(substr(o_orderpriority, 1, 1) as int)) as seniority,
    cast(o_orderkey % 14 as int) as years_experience, list_extract(['USD', 'EUR', 'KES', 'XXX'], cast(o_orderkey % 4 + 1 as int)) as currency,
    case when o_orderkey % 3 <> 0 then o_totalprice end as salary_min, case when o_orderkey % 3 <> 0 then o_totalprice end * 1.2::double as salary_max,
    cast(o_orderdate as date) as date_posted, c_mktsegment as tech_category
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)""",
    "posting_skills": """posting_skills as (
  select l_orderkey as job_id, lower(p_brand) as skill, p_type as category, max(l_returnflag = 'R') as is_preferred
  from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)""",
    "posting_text": f"""posting_text as (
  select doc_id as job_id, source, text || list_extract([{", ".join(map(_q, SUFFIXES))}], cast(doc_id % 6 + 1 as int)) as description, lang as country from documents)""",
    "questions": f"""questions as (
  select conv_id, turn, text || list_extract([{", ".join(map(_q, ASKED))}], cast((conv_id * 5 + turn) % {len(ASKED)} + 1 as int)) as text from conversations where role = 'user')""",
    "candidates": """candidates as (
  select distinct s_suppkey as candidate_id, cast(s_suppkey % 12 as int) as years, n_name as location, lower(p_brand) as skill
  from supplier join nation on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join part on l_partkey = p_partkey where l_quantity >= 50)""",
    "posting_events": """posting_events as (
  select event_id, ts, user_id as job_id, case event_type when 'signup' then 'AVAILABLE' when 'error' then 'REMOVED' when 'purchase' then 'FILLED' else 'SEEN' end as status,
    event_type, value, props from events)""",
}


def with_sql(body: str) -> str:
    """``body`` after the CTEs of the projections that it names."""
    used = [cte for name, cte in SQL.items() if name in body]
    return ("with " + ",\n".join(used) + "\n" if used else "") + body
