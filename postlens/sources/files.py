"""Readers and sinks for posting files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from postlens.functions.text import stable_id

#: The posting contract: 22 text columns.
POSTING = t.StructType([t.StructField(c, t.StringType()) for c in (
    "job_id source source_job_id job_title company job_description location country work_mode remote_scope job_field industry employment_type "
    "experience_required education_required salary currency date_posted application_deadline tech_category vacancy_url scraped_at"
).split()])
FEED = (
    "source string, portal string, idInSource string, name string, text string, url string, company struct<name:string>, "
    "location struct<name:string,countryCode:string,country:string>, salary struct<amount:double,text:string>, "
    "json struct<schemaOrg:struct<hiringOrganization:struct<name:string>,jobLocation:struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>,"
    "employmentType:string,salaryCurrency:string,datePosted:string,validThrough:string,industry:string,educationRequirements:string,qualifications:string,relevantOccupation:string>>, "
    "inferredTags struct<WORK_TYPES:array<string>,JOBNAMES:array<string>>"
)


def work_dir(spark: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``, or in local mode (tests) one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-postlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/postlens"


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str, files: int = 1) -> None:
    """Small result tables as JSON lines."""
    df.coalesce(files).write.mode("overwrite").json(path)


def read_postings_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    schema = POSTING if columns is None else ", ".join(f"{k} {v}" for k, v in columns.items())
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


_ON_SITE = ["onsite", "on-site", "office", "full_time", "part_time"]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON lines, flattened to the 22 columns of the contract; malformed lines and records without a title are skipped.

    What schema.org markup says goes before the record's own fields.
    """
    raw = spark.read.schema(FEED).option("mode", "DROPMALFORMED").json(path)
    org, none = F.col("json.schemaOrg"), F.lit(None).cast("string")
    some = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    at = org["jobLocation"]["address"]
    place = F.nullif(F.concat_ws(", ", some(at["addressLocality"]), some(at["addressRegion"]), some(at["addressCountry"])), F.lit(""))
    tags = F.transform(F.coalesce("inferredTags.WORK_TYPES", F.array().cast("array<string>")), F.lower)
    mode = F.when(F.array_contains(tags, "remote"), "remote").when(F.array_contains(tags, "hybrid"), "hybrid").when(F.arrays_overlap(tags, F.array(*map(F.lit, _ON_SITE))), "onsite")
    source = some(F.col("source"), F.col("portal"))
    columns = {
        "job_id": stable_id(source, some(F.col("idInSource"), F.col("url"))), "source": source, "source_job_id": F.col("idInSource"), "job_title": F.trim("name"), "company": some(org["hiringOrganization"]["name"], F.col("company.name")),
        "job_description": some(F.col("text")), "location": F.coalesce(place, some(F.col("location.name"))), "country": some(at["addressCountry"], F.col("location.country"), F.col("location.countryCode")), "work_mode": mode, "remote_scope": none,
        "job_field": some(org["relevantOccupation"]), "industry": some(org["industry"]), "employment_type": some(org["employmentType"]), "experience_required": some(org["qualifications"]), "education_required": some(org["educationRequirements"]),
        "salary": some(F.col("salary.text"), F.col("salary.amount").cast("string")), "currency": some(org["salaryCurrency"]), "date_posted": some(org["datePosted"]), "application_deadline": some(org["validThrough"]),
        "tech_category": F.try_element_at("inferredTags.JOBNAMES", F.lit(1)), "vacancy_url": some(F.col("url")), "scraped_at": none,
    }
    return raw.where(F.trim("name") != "").select(*[columns[c].alias(c) for c in POSTING.names])


def guess_columns(columns: list[str], keywords: dict[str, list[str]]) -> dict[str, str]:
    """Target -> the first column whose name holds one of its keywords (a look at names only)."""
    found = {}
    for target, words in keywords.items():
        hit = next((c for c in columns if any(w in c.lower() for w in words)), None)
        if hit:
            found[target] = hit
    return found


def filter_by_country(df: DataFrame, country: str) -> DataFrame:
    """By the column that looks like a country, else by any text column that names it."""
    at = guess_columns(df.columns, {"country": ["country", "n_name"]}).get("country")
    if at:
        return df.where(F.upper(at) == country.upper())
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, t.StringType)]
    return df.where(F.lower(F.concat_ws(" ", *texts)).contains(country.lower()))


def newest_run(df: DataFrame, column: str = "run_id") -> DataFrame:
    """Rows of the newest run; the filter prunes the partitions of the others."""
    newest = df.agg(F.max(column)).first()[0]
    return df.where(F.col(column) == newest)


def schema_report(df: DataFrame, wanted: list[str]) -> DataFrame:
    """``column, state, nulls, null_pct``: columns present, extra or missing against ``wanted``; a missing column is null in every row."""
    n = lambda c: F.count_if(F.col(c).isNull())
    one = df.agg(F.count("*").alias("_n"), *[n(c).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit("present" if c in wanted else "extra").alias("state"), F.col(c).alias("nulls")) for c in df.columns]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("missing").alias("state"), F.col("_n").alias("nulls")) for c in wanted if c not in df.columns]
    return one.select("_n", F.explode(F.array(*rows)).alias("r")).select("r.*", F.round(F.col("r.nulls") * 100.0 / F.col("_n"), 2).alias("null_pct"))


def summary(df: DataFrame, top: str, whole: str, k: int) -> DataFrame:
    """``metric, key, value``: rows, columns, the ``k`` commonest values of ``top`` and all of ``whole``."""
    count = lambda c: df.groupBy(c).agg(F.count("*").alias("value"))
    named = lambda f, m, c: f.select(F.lit(m).alias("metric"), F.col(c).alias("key"), "value")
    rows = df.agg(F.count("*").alias("value")).select(F.lit("rows").alias("metric"), F.lit("all").alias("key"), "value")
    columns = rows.select(F.lit("columns").alias("metric"), "key", F.lit(len(df.columns)).cast("bigint").alias("value"))
    return rows.unionByName(columns).unionByName(named(count(top).orderBy(F.desc("value"), top).limit(k), top, top)).unionByName(named(count(whole), whole, whole))
