"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import any_contained, canonical_skills
from postlens.operators.aggregates import top_per_group


def set_scores(gold: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """True and false positives and misses of each item, from one full outer join of the pairs."""
    j = gold.distinct().withColumn("_g", F.lit(1)).join(found.distinct().withColumn("_f", F.lit(1)), [key, item], "full_outer")
    g, f = F.col("_g").isNotNull(), F.col("_f").isNotNull()
    return j.groupBy(item).agg(F.count(F.when(g & f, 1)).alias("tp"), F.count(F.when(~g, 1)).alias("fp"), F.count(F.when(~f, 1)).alias("fn"))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class: hits, predictions and members. Each row is counted under its true and its guessed class."""
    both = df.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("_l"), F.col(truth).alias("_t"), F.col(guess).alias("_p"))
    return both.groupBy(F.col("_l").alias("label")).agg(
        F.count(F.when((F.col("_t") == F.col("_l")) & (F.col("_p") == F.col("_l")), 1)).alias("tp"),
        F.count(F.when(F.col("_p") == F.col("_l"), 1)).alias("predicted"), F.count(F.when(F.col("_t") == F.col("_l"), 1)).alias("actual"),
    )


def with_f1(report: DataFrame) -> DataFrame:
    """A class report with precision, recall and F1; their mean over the classes is the macro average."""
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return report.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("actual")), "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual"))})


def category_scores(gold: DataFrame, found: DataFrame, key: str, item: str, categories: dict[str, str]) -> DataFrame:
    """Hits, spurious and missed pairs with precision, recall and F1, of each category and of ALL pairs together."""
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    each = set_scores(gold, found, key, item).withColumn("category", F.try_element_at(table, F.col(item))).where("category is not null")
    sums = each.rollup("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("category", F.coalesce("category", F.lit("ALL")))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def ranking(hits: DataFrame, query: str, weak: float = 0.2) -> DataFrame:
    """Precision at 3 and 5, recall at 5 (of what the list holds), reciprocal rank, and whether the best score is weak."""
    rel = lambda k: F.count(F.when(F.col("relevant") & (F.col("rank") <= k), 1))
    first, all_ = F.min(F.when(F.col("relevant"), F.col("rank"))), F.count(F.when(F.col("relevant"), 1))
    return hits.groupBy(query).agg(
        F.round(rel(3) / 3, 4).alias("p_at_3"), F.round(rel(5) / 5, 4).alias("p_at_5"), F.round(F.coalesce(rel(5) / F.nullif(all_, F.lit(0)), F.lit(0.0)), 4).alias("r_at_5"),
        F.round(F.coalesce(1 / first, F.lit(0.0)), 4).alias("mrr"), (F.max("score") < weak).alias("low_confidence"))


def top_errors(scores: DataFrame, item: str, k: int = 10) -> DataFrame:
    """``kind, rank, item, n``: the items of ``set_scores`` that are missed and spurious most often."""
    each = scores.select(item, F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.col(c).alias("n")) for name, c in (("missed", "fn"), ("spurious", "fp"))])).alias("_e"))
    return top_per_group(each.select("_e.kind", item, "_e.n").where("n > 0"), ["kind"], ["n desc", item], k)


def field_confusion(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, expected, actual, n`` of all fields (columns ``expected_<field>``, ``actual_<field>``) in one pass; rows without an expected value do not count."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"expected_{f}").alias("expected"), F.coalesce(f"actual_{f}", F.lit("None")).alias("actual")) for f in fields]))
    return df.select(each.alias("_f")).select("_f.*").where("expected is not null").groupBy("field", "expected", "actual").agg(F.count("*").alias("n"))


def field_accuracy(confusion: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("expected") == F.col("actual"), F.col("n")).otherwise(0))
    return confusion.groupBy("field").agg(F.sum("n").alias("total"), right.alias("correct"), F.round(right / F.sum("n"), 3).alias("accuracy"))


def matcher_cases(cases: DataFrame) -> DataFrame:
    """Cases ``(key, candidate, job, matched, missing, score)`` of skill lists with what a matcher does, and whether that is as expected."""
    own, need = canonical_skills(F.col("candidate")), canonical_skills(F.col("job"))
    told = cases.withColumns({"got_matched": F.array_intersect(need, own), "got_missing": F.array_except(need, own)})
    share = F.when(F.size("job") > 0, F.size("got_matched") / (F.size("got_matched") + F.size("got_missing"))).otherwise(0.0)
    same = lambda a, b: F.array_sort(a) == F.array_sort(b)
    return told.withColumn("got_score", F.coalesce(share, F.lit(0.0))).withColumns({"match_ok": same("got_matched", "matched") & same("got_missing", "missing"), "score_ok": F.abs(F.col("got_score") - F.col("score")) < 0.01})


def in_context(found: DataFrame, texts: DataFrame, key: str, text: str, words: list[str], width: int = 40) -> DataFrame:
    """Whether one of ``words`` stands within ``width`` characters of an extracted term."""
    j = found.join(texts.select(key, F.lower(text).alias("_t")), key)
    near = F.expr(f"substring(_t, greatest(locate(skill, _t) - {width}, 1), {2 * width} + length(skill))")
    return j.select(key, "skill", any_contained(near, words).alias("technical"))


def long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metric, value``: a row for each metric column."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("_m")).select(*keys, "_m.*")


def deltas(now: DataFrame, before: DataFrame, dead_band: float) -> DataFrame:
    """``metric, value`` of two runs side by side, and the trend outside a dead band."""
    rows = now.select("metric", "value").join(before.select("metric", F.col("value").alias("previous")), "metric", "left")
    return rows.withColumn("trend", F.when(F.abs(F.col("value") - F.col("previous")) <= dead_band, "same").when(F.col("value") > F.col("previous"), "up").otherwise("down"))
