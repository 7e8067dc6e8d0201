"""Invariants and edge cases of the operators."""

import random

from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import aggregates as A
from postlens.operators import dedup, recommend, skills


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0), (None, "d", 0)], "k int, v string, p int")
    once = dedup.keep_first(df, ["k"], ["p", "v"])
    twice = dedup.keep_first(once, ["k"], ["p", "v"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.count() == 3


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, ""), (3, "z")], "k int, v string")
    one = dedup.upsert(old, new, "k", ["v"])
    two = dedup.upsert(one.drop("action"), new, "k", ["v"])
    assert {(r.k, r.v) for r in one.collect()} == {(1, "x"), (2, "y"), (3, "z")} == {(r.k, r.v) for r in two.collect()}


def test_shares_sum_to_all(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "g string")
    assert abs(sum(r.pct for r in A.share(df, "g").collect()) - 100) < 0.2


def test_aliases(spark):
    df = spark.createDataFrame([(["K8s", " Golang ", "go", ""],)], "s array<string>")
    assert df.select(T.canonical_skills(F.col("s")).alias("s")).first().s == ["go", "kubernetes"]


def test_salary_k_multiplies(spark):
    low, high = T.salary_bounds(F.col("t"))
    r = spark.createDataFrame([("pay $50k to $60,000 in 2024",)], "t string").select(low.alias("a"), high.alias("b")).first()
    assert (r.a, r.b) == (50000.0, 60000.0)


def test_symbol_terms_and_boundaries(spark):
    df = spark.createDataFrame([(1, "We use C++, c# and .NET; javascript too"), (2, None), (3, "")], "id int, t string")
    got = skills.extract(df, "id", "t", {"c++": "L", "c#": "L", ".net": "L", "java": "L", "javascript": "L"}).collect()
    assert {r.skill for r in got} == {"c++", "c#", ".net", "javascript"}


WHO = "candidate_id long, skills array<string>, years int, locations array<string>, modes array<string>"
JOBS = "job_id long, required array<string>, preferred array<string>, years_experience int, country string, work_mode string, deadline date"


def test_hybrid_score_of_known_cases(spark):
    who = spark.createDataFrame([(1, ["python", "aws"], 2, ["Kenya"], ["Remote"]), (2, [], None, None, None)], WHO)
    jobs = spark.createDataFrame([
        (1, ["python"], ["aws"], 2, "Kenya", "Remote", None), (2, ["python"], ["aws"], 5, "Uganda", "On-site", None),
        (3, ["python", "go"], [], None, None, None, None), (4, [], [], 0, "", "", None),
    ], JOBS)
    got = {(r.candidate_id, r.job_id): (r.score, r.gap) for r in recommend.top_jobs(who, jobs).collect()}
    assert got[1, 1] == (1.0, 0) and got[1, 2] == (round(0.65 + 0.15 + 0.15 * 0.4, 6), 3)
    assert got[1, 3] == (0.5, 0) and got[1, 4] == (0.0, 0)
    assert all(got[2, j][0] == 0 for j in (1, 2, 3, 4))
    full = {(r.candidate_id, r.job_id): r for r in recommend.explained(recommend.top_jobs(who, jobs), who, jobs).collect()}
    r = full[1, 1]
    assert (r.required_skills, r.preferred_skills, r.experience, r.location_work_mode) == (1.0, 1.0, 1.0, 1.0)
    assert full[1, 3].location_work_mode is None and full[1, 3].missing == ["go"] and full[1, 3].reasons[1] == "Build: go."


def test_order_breaks_ties_by_gap_urgency_and_id(spark):
    from datetime import date

    who = spark.createDataFrame([(1, ["a"], 1, [], [])], WHO)
    jobs = spark.createDataFrame([(i, ["a"], [], 0, None, None, date(2024, 1, day)) for i, day in ((5, 9), (4, 20), (3, 20), (9, 2))], JOBS)
    got = [r.job_id for r in recommend.top_jobs(who, jobs, date(2024, 1, 2), 3).orderBy("rank").collect()]
    assert got == [5, 9, 3]


def test_gaps_weigh_urgent_postings(spark):
    from datetime import date

    who = spark.createDataFrame([(1, ["a"], 1, [], [])], WHO)
    jobs = spark.createDataFrame([(1, ["a", "b"], [], 0, None, None, date(2024, 1, 3)), (2, ["a", "c"], [], 0, None, None, None)], JOBS)
    top = recommend.explained(recommend.top_jobs(who, jobs, date(2024, 1, 1)), who, jobs, date(2024, 1, 1))
    assert {r.skill: r.priority for r in recommend.gaps(top).collect()} == {"b": 0.625, "c": 0.5}


def test_blocks_give_the_same_rows(spark, data, monkeypatch):
    from postlens.plans import q_matching

    whole = q_matching.QUERIES["r5_top_jobs"][0](spark, data).collect()
    monkeypatch.setattr(recommend, "BLOCK", 4)
    monkeypatch.setattr(recommend, "PAIRS", 500)
    assert sorted(q_matching.QUERIES["r5_top_jobs"][0](spark, data).collect()) == sorted(whole)


def test_empty_sides(spark):
    who, jobs = spark.createDataFrame([], WHO), spark.createDataFrame([], JOBS)
    some = spark.createDataFrame([(1, ["a"], 1, [], [])], WHO)
    assert recommend.top_jobs(who, jobs).count() == recommend.top_jobs(some, jobs).count() == recommend.reach(who, jobs).count() == 0


def test_plans_scan_narrow_and_push_filters(spark, data):
    p = spark.read.parquet(f"{data}/orders.parquet").where("o_totalprice > 1000").select("o_orderkey")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_table_function_agrees_with_extract(spark, data):
    from postlens.functions.udtf import register_extract_skills
    from postlens.plans.q_skills import TAXONOMY

    register_extract_skills(spark, TAXONOMY)
    spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "concat(text, ' Python and data engineer') as text").createOrReplaceTempView("texts")
    ours = skills.extract(spark.table("texts"), "doc_id", "text", TAXONOMY).select("doc_id", "skill")
    theirs = spark.sql("select doc_id, skill from texts, lateral extract_skills(text)")
    assert ours.exceptAll(theirs).count() == theirs.exceptAll(ours).count() == 0


def test_clusters_of_a_chain(spark):
    from postlens.sources.files import save

    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8, 9)], "id long")
    got = {r.id: r.cluster for r in dedup.clusters(pairs, nodes, "id", save).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 8, 9: 8}


def _levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_edits_match_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        x = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 200)))
        y = list(x)
        for _ in range(rng.randrange(0, 40)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "a", "bc"])
        y = "".join(y)
        bits = {c: sum(1 << i for i, d in enumerate(x) if d == c) for c in set(x)}
        right = _levenshtein(x, y)
        for most in (0, 5, right, right - 1, 300):
            if most >= 0:
                assert dedup.edits(bits, len(x), y, most) == min(right, most + 1)


def test_segments_bound_edit_distances():
    """The bound is never above the distance, whatever was moved, put in or left out, and leaves out long texts of the same syllables."""
    import numpy as np

    rng, syllables = random.Random(8), ["th", "er", "on", "ing", "and ", "of ", "é", "re", "st ", "ha", "in"]
    for trial in range(120):
        said = ["".join(rng.choice(syllables) for _ in range(rng.choice((1, 2, 30, 90, 300)))) for _ in range(3)]
        base, share = said[0], rng.choice((0.01, 0.08, 0.15))
        at, cut = rng.randrange(len(base)), max(1, int(len(base) * share))
        y = [base[:at] + base[at + cut :], base[:at] + "zq" * cut + base[at:], "".join(rng.choice(["", "x", "ab" + c]) if rng.random() < share else c for c in base)][trial % 3]
        texts = sorted([base, *said[1:]], key=len)
        for x, d in zip(texts, [_levenshtein(x, y) for x in texts] if len(y) < 400 else [dedup.edits({c: sum(1 << i for i, e in enumerate(x) if e == c) for c in set(x)}, len(x), y, 10**5) for x in texts]):
            for most in (d, d + 1, d + 9, 2 * d + 200):
                told = dedup.Segments(texts).least(y, np.full(3, most))
                assert told[texts.index(x)] <= d
    syllables = [a + b for a in ("", "b", "ch", "d", "fr", "g", "l", "m", "n", "st") for b in ("a", "e ", "in", "o")]
    for size in (400, 1500, 3000):  # of some two letters each
        texts = sorted(("".join(rng.choice(syllables) for _ in range(size)) for _ in range(12)), key=len)
        most = np.array([int(0.15 * len(t)) for t in texts])
        assert (dedup.Segments(texts[1:]).least(texts[0], most[1:]) > most[1:]).mean() > 0.9


def test_whole_clusters_match_brute_force(spark, tmp_path):
    """Copies, long texts, other first characters and edits spread over a text; parts of one tile and of several."""
    from postlens.plans import registry

    rng, rows = random.Random(3), []
    for _ in range(12):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice((30, 300, 500))))
        for share in (0, 0, 0.05, 0.12, 0.2):
            t = "".join(rng.choice("xyz") if rng.random() < share else c for c in base)
            rows += [(t, rng.choice(("en", "en", "fr")))] * rng.choice((1, 1, 3))
        rows.append(("zzzz" + base[4:], "en"))
    rows = [(i, t, g) for i, (t, g) in enumerate(rows)] + [(900, None, "en"), (901, "", "en"), (902, "", "en"), (903, "same", None), (904, "same", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    least, want = {}, set()
    for i, t, g in rows:
        least.setdefault((g, t), i)
    one = [(i, t, g) for (g, t), i in least.items() if t]
    for i, x, g in one:
        for j, y, h in one:
            long = max(len(x), len(y))
            if i < j and g == h and min(len(x), len(y)) >= 0.85 * long and round(1 - _levenshtein(x, y) / long, 4) >= 0.85:
                want.add((i, j))
    for tile in (5, 256):
        pairs, _ = dedup.whole_pairs(df, "doc_id", "text", [F.col("lang")], 0.85, tile)
        got = [(r.a, r.b) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {(r.a, r.b) for r in registry.QUERIES["j11_similar_pairs"](spark, str(tmp_path)).collect()} == want
    label = {i: i for i, _, _ in rows}
    links = want | {(least[g, t], i) for i, t, g in rows if t is not None}
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.cluster for r in registry.QUERIES["u10_clusters"](spark, str(tmp_path)).collect()} == label


def test_search_takes_whole_texts(spark, tmp_path):
    """The words that match stand after the twelfth."""
    from postlens.plans import registry

    docs = [(0, "golden harbour lights golden harbour"), (1, "golden harbour bridge"), (2, "plain copper river"), (3, "plain copper valley")]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "plain " + " ".join(["zzz"] * 12) + " golden harbour golden harbour")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {0, 1} <= {r.job_id for r in run("v2_search")}
    assert run("v5_context")[0].context.split(" |")[0] in ("[1] 0", "[1] 1")
    assert {0, 1} <= {r.job_id for r in run("j8_query_corpus")}
    assert run("v4_strong_match")[0].strong
    assert run("e4_ranking_metrics")[0].mrr > 0


def test_aggregates_do_the_surveyed_work(spark, data, monkeypatch):
    from postlens.operators import ml, timeseries
    from postlens.plans import registry
    from postlens.sources.fixtures import postings

    whole = registry.QUERIES["o6_sort_modes"](spark, data)
    assert whole.count() == postings(spark, data).count() and whole.agg(F.max("match")).first()[0] > 50
    asked = []
    monkeypatch.setattr(timeseries, "bootstrap_median", lambda *a: asked.append(a[3]))
    registry.QUERIES["a11_freshness_interval"](spark, data)
    assert asked == [2000]
    assert registry.QUERIES["m6_topics"](spark, data).select("topic").distinct().count() == 6
    rows = spark.createDataFrame([(i, f"word{i % 7} text {i}", float(i < 4)) for i in range(40)], "doc_id long, text string, label double")
    dealt, folds = ml.stratified_folds(rows, "doc_id", "label")
    assert folds == 4 and {r.n for r in dealt.where("label = 1").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {1}
    assert len(ml.GRID["vocabSize"]) * len(ml.GRID["inputCol"]) * len(ml.GRID["minDF"]) * len(ml.GRID["c"]) == 48
    told = ml.tuned(rows, grid={"vocabSize": (50,), "inputCol": ("_one", "_both"), "minDF": (1.0,), "c": (0.1, 10.0)})
    assert len(told) == 4 and all(0 <= f1 <= 1 for _, f1 in told) and told[0][1] == max(f1 for _, f1 in told)
    guesses = spark.createDataFrame([(0.0, 0.0)] * 8 + [(1.0, 0.0), (1.0, 1.0)], "label double, prediction double")
    assert abs(ml.MacroF1().evaluate(guesses) - (16 / 17 + 2 / 3) / 2) < 1e-12


def test_bootstrap_interval_agrees_with_plain_resampling(spark):
    import numpy as np

    from postlens.operators.timeseries import bootstrap_median

    rng = np.random.default_rng(1)
    ages = {"a": rng.integers(0, 90, 400).tolist(), "b": rng.integers(0, 4, 60).tolist(), "c": [1, 2, 3]}
    df = spark.createDataFrame([(g, x) for g, xs in ages.items() for x in [*xs, None]], "g string, age int")
    got = {r.g: r for r in bootstrap_median(df, "g", "age").collect()}
    assert set(got) == {"a", "b"}
    for g, r in got.items():
        plain = [np.median(rng.choice(ages[g], len(ages[g]))) for _ in range(2000)]
        assert r.median == np.median(ages[g]) and r.n == len(ages[g])
        assert abs(r.low - np.quantile(plain, 0.025)) <= 3 and abs(r.high - np.quantile(plain, 0.975)) <= 3 and r.low <= r.median <= r.high


def test_upsert_sink_goes_on_after_a_restart(spark, tmp_path):
    from postlens.streaming import jobs

    def feed(rows):
        spark.createDataFrame(rows, "job_id long, ts long, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("job_id long, ts long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.upserts(stream, jobs.keep_newest(f"{tmp_path}/store", "job_id", ["ts"]), f"{tmp_path}/state").awaitTermination()
        return sorted(tuple(r) for r in jobs.stored(spark, f"{tmp_path}/store").select("job_id", "status").collect())

    feed([(1, 5, "new"), (2, 1, "old")])
    assert run() == [(1, "new"), (2, "old")]
    feed([(1, 3, "late"), (3, 1, "x")])
    feed([(2, 9, "newer")])
    assert run() == [(1, "new"), (2, "newer"), (3, "x")]
    # A batch that is repeated reads the store before it, not its own folder.
    jobs.keep_newest(f"{tmp_path}/store", "job_id", ["ts"])(spark.createDataFrame([(2, 9, "newer")], "job_id long, ts long, status string"), 2)
    assert run() == [(1, "new"), (2, "newer"), (3, "x")]
    # A batch writes the buckets that it touches, and readers go by the manifest: a version without one does not count.
    import os

    versions = {v: sorted(os.listdir(f"{tmp_path}/store/data/{v}")) for v in os.listdir(f"{tmp_path}/store/data")}
    assert {v: sum(b.startswith("bucket=") for b in names) for v, names in versions.items()} == {"version=0": 2, "version=1": 2, "version=2": 1}
    spark.createDataFrame([(1, 99, "not committed")], "job_id long, ts long, status string").write.parquet(f"{tmp_path}/store/data/version=3/bucket=0")
    assert run() == [(1, "new"), (2, "newer"), (3, "x")]
    assert jobs.vacuum(spark, f"{tmp_path}/store", 1) > 0 and run() == [(1, "new"), (2, "newer"), (3, "x")]
    feed([(3, 4, "y"), (8, 1, "z")])
    assert run() == [(1, "new"), (2, "newer"), (3, "y"), (8, "z")]


def test_factors_equal_a_plain_run(spark):
    """Squared error falls each round, and topics and errors are those of a plain run on the whole matrix; topics that are there are found."""
    import numpy as np

    from postlens.operators import ml

    rng = np.random.default_rng(6)
    truth = np.kron(np.eye(3), np.ones(5)) * rng.random((3, 15))
    x = np.vstack([rng.random((60, 3)) ** 4 @ truth, np.zeros((1, 15))])
    rows = [(i, f"t{j:02d}", float(x[i, j])) for i in range(len(x)) for j in range(15) if x[i, j] > 0]
    h, names, errors = ml.factors(spark.createDataFrame(rows, "doc_id long, term string, weight double").repartition(3), "doc_id", 3, 30)
    assert names == [f"t{j:02d}" for j in range(15)] and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < 0.05 * errors[0]
    mine, told = np.random.default_rng(42).random((3, 15)) + 0.1, []
    for _ in range(30):
        w = np.zeros((len(x), 3))
        for _ in range(25):
            for t in range(3):
                w[:, t] = np.maximum(0, w[:, t] + (x @ mine[t] - w @ (mine @ mine[t])) / (mine[t] @ mine[t]))
        told.append(((x - w @ mine) ** 2).sum())
        mine = mine * (w.T @ x) / (w.T @ w @ mine)
    assert np.allclose(errors, told, atol=1e-9) and np.allclose(h, mine, atol=1e-9)
    best = {tuple(sorted(t for k, i, t, _ in ml.topic_words(h, names, 5) if k == topic)) for topic in range(3)}
    assert best == {tuple(names[5 * b : 5 * b + 5]) for b in range(3)}


def test_search_in_blocks_equals_brute_force(spark, monkeypatch):
    """Several passes of queries, small blocks and batches, ties, queries and rows without common terms."""
    import numpy as np

    from postlens.operators import retrieval

    for name, value in (("QUERIES", 3), ("ROWS", 7), ("BLOCK", 2)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(8)
    docs = {i: {f"t{rng.integers(12)}": float(rng.integers(1, 9)) / 8 for _ in range(rng.integers(1, 5))} for i in range(60)}
    docs |= {100 + i: docs[i] for i in range(5)}
    asked = {i: {f"t{rng.integers(14)}": float(rng.integers(1, 9)) / 8 for _ in range(3)} for i in range(10)} | {50: {"none": 1.0}}
    index = spark.createDataFrame([(i, t, w) for i, ws in docs.items() for t, w in ws.items()], "doc_id long, term string, weight double").repartition(2)
    queries = spark.createDataFrame([(i, t, w) for i, ws in asked.items() for t, w in ws.items()], "q_id long, term string, q double")
    got = sorted((r.q_id, r["rank"], r.doc_id, r.score) for r in retrieval.search(index, "doc_id", queries, "q_id", 4, 0.5).collect())
    want = []
    for q, ws in asked.items():
        scores = [(-round(sum(w * d.get(t, 0.0) for t, w in ws.items()), 6), i) for i, d in docs.items() if set(ws) & set(d)]
        kept = [x for x in scores if -x[0] >= 0.5] or scores
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(kept)[:4])]
    assert got == sorted(want)


def test_dictionaries_of_any_size(spark):
    """One literal for ten thousand terms, the same rows as a joined dictionary, and patterns that agree with the plain ones."""
    taxonomy = {f"term{i}": "a" for i in range(6000)} | {f"word{i} pair{i}": "b" for i in range(4000)} | {"c++": "s", ".net": "s", "ci/cd": "s", "r": "s", "go": "s", "node.js": "s", "Looker": "s"}
    texts = [(1, "Term5, term6x word7 pair7 word8  pair8"), (2, "C++ and .NET; CI/CD. R_ go-to"), (3, None), (4, ""), (5, "node.js rgo term5999 xterm1 looker " + "filler " * 3000 + "term77")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    few = {k: v for k, v in list(taxonomy.items())[:300]}
    plans = [skills.extract(df, "doc_id", "text", t)._jdf.queryExecution().analyzed().treeString().count("\n") for t in (few, taxonomy)]
    assert plans[0] == plans[1]
    want = {(1, "term5"), (1, "word7 pair7"), (2, "c++"), (2, ".net"), (2, "ci/cd"), (2, "go"), (5, "node.js"), (5, "term5999"), (5, "term77"), (5, "Looker")}
    assert {(r.doc_id, r.skill) for r in skills.extract(df, "doc_id", "text", taxonomy).collect()} == want
    table = spark.createDataFrame(list(taxonomy.items()), "term string, category string")
    assert {(r.doc_id, r.skill) for r in skills.extract_from(df, "doc_id", "text", table).collect()} == want


def test_enrichment_is_worked_out_once(spark, data):
    from postlens.plans import q_skills
    from postlens.sources.fixtures import posting_text

    plan = q_skills.enrich(posting_text(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-z0-9]+") == 2  # of the text and of the title


def test_signatures_stand_for_postings(spark, monkeypatch):
    """Many equal postings, several passes of candidates: the same best postings as scoring every pair."""
    monkeypatch.setattr(recommend, "BLOCK", 3)
    monkeypatch.setattr(recommend, "BLOCKS", 2)
    monkeypatch.setattr(recommend, "ROWS", 5)
    monkeypatch.setattr(recommend, "PAIRS", 40)
    rng = random.Random(9)
    names = list("abcdef")
    jobs = [(i, sorted(rng.sample(names, rng.randrange(4))), sorted(rng.sample(names, rng.randrange(2))), rng.choice([None, 0, 3, 6]), rng.choice(["KE", "ng ", None]), rng.choice(["remote", None])) for i in range(150)]
    jobs += [(1000 + i, ["a", "b"], [], 3, "KE", "remote") for i in range(200)]
    who = [(i, rng.sample(names, rng.randrange(5)), rng.choice([0, 2, 9]), rng.choice([["KE"], []]), rng.choice([["Remote"], []])) for i in range(14)]
    df = spark.createDataFrame(jobs, "job_id long, required array<string>, preferred array<string>, years_experience int, country string, work_mode string")
    cand = spark.createDataFrame(who, "candidate_id long, skills array<string>, years int, locations array<string>, modes array<string>")
    got = sorted((r.candidate_id, r["rank"], r.job_id, r.score) for r in recommend.top_jobs(cand, df).collect())
    want = []
    for c, skills_, years, places, modes in who:
        scored = []
        for j, need, wish, asked, country, mode in jobs:
            parts = {"required": len(set(need) & set(skills_)) / len(need) if need else None, "preferred": len(set(wish) & set(skills_)) / len(wish) if wish else None, "experience": min(1.0, years / asked) if asked else None}
            near = [x for x in ((country.strip().lower() in [p.lower() for p in places]) * 1.0 if places and country else None, (mode in [m.lower() for m in modes]) * 1.0 if modes and mode else None) if x is not None]
            parts["location_work_mode"] = sum(near) / len(near) if near else None
            known = {k: v for k, v in parts.items() if v is not None}
            total = sum(recommend.WEIGHTS[k] for k in known)
            scored.append((-round(sum(v * recommend.WEIGHTS[k] for k, v in known.items()) / total, 6) if total else 0.0, max((asked or 0) - years, 0), j))
        want += [(c, k + 1, j, -s) for k, (s, _, j) in enumerate(sorted(scored)[:10])]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    reached = {r.job_id: (r.candidates, r.best) for r in recommend.reach(cand, df).collect()}
    for j, need, *_ in jobs:
        n = [len(set(need) & set(w[1])) for w in who]
        assert reached.get(j) == ((sum(x > 0 for x in n), max(n) / len(need)) if any(n) else None)


def test_grid_search_passes(spark, monkeypatch):
    """Combinations with one vocabulary are fitted once, few passes settle all models, and no task gets all texts of one file."""
    from postlens.operators import ml

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "sun", "moon"] + (["rare", "odd"] if i % 3 == 0 else ["plain"])) for _ in range(rng.randrange(1, 9))), float(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double").coalesce(1)
    spaces, models, parts, counted = [], [], [], ml._counted

    def listed(rows, *rest):
        parts.append(rows.select(F.input_file_name().alias("f")).distinct().count())
        spaces.extend(counted(rows, *rest))
        return spaces

    class Listed(ml.Descent):
        def __init__(self, *a):
            super().__init__(*a)
            self.passes = 0
            models.append(self)

        def tell(self, *a):
            self.passes += 1
            super().tell(*a)

    monkeypatch.setattr(ml, "_counted", listed)
    monkeypatch.setattr(ml, "Descent", Listed)
    told = ml.tuned(df, grid={"vocabSize": (50, 60), "inputCol": ("_one",), "minDF": (1.0, 2.0), "c": (0.1, 10.0)})
    assert len(spaces) == len(models) == 5 and all(len(s.names) == 4 for s in spaces) and len(told) == 8
    assert len({(k["c"], f1) for k, f1 in told}) == 2  # combinations with one vocabulary tell the same
    assert all(m.settled.all() for m in models) and max(m.passes for m in models) <= 25
    assert parts[0] > 1


def test_grid_search_equals_plain_fits(spark, monkeypatch):
    """Every fold and combination fitted on its own by Newton's method, on a matrix of the whole text."""
    import re

    import numpy as np
    from pyspark.ml.feature import StopWordsRemover

    from postlens.operators import ml

    monkeypatch.setattr(ml, "SETTLED", 1e-6)
    monkeypatch.setattr(ml, "ROWS_A_TASK", 20)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green", "sun", "moon"] + (["rare", "odd"] if i % 3 == 0 else ["plain"])) for _ in range(rng.randrange(1, 9))), float(i % 3 == 0)) for i in range(45)]
    df = spark.createDataFrame([*rows, (90, None, 1.0), (91, "", 0.0)], "doc_id long, text string, label double")
    grid = {"vocabSize": (50,), "inputCol": ("_one", "_both"), "minDF": (2.0,), "c": (0.5, 10.0)}
    got = {tuple(k.values()): f1 for k, f1 in ml.tuned(df, grid=grid)}
    dealt, folds = ml.stratified_folds(ml.balanced(df), "doc_id", "label")
    stop, held = set(StopWordsRemover.loadDefaultStopWords("english")), [(r.fold, r.label, r.weight, r.text or "") for r in dealt.collect()]
    tokens = [[w for w in re.split(r"\W+", t.lower()) if len(w) >= 2 and w not in stop] for *_, t in held]
    fold, y, weight = (np.array([h[k] for h in held]) for k in range(3))
    for size, column, least, c in got:
        f1 = []
        terms_of = [t + [" ".join(p) for p in zip(t, t[1:])] if column == "_both" else t for t in tokens]
        for f in range(folds):
            train = np.flatnonzero(fold != f)
            df_of = {t: sum(t in terms_of[i] for i in train) for i in train for t in terms_of[i]}
            n_of = {t: sum(terms_of[i].count(t) for i in train) for t in df_of}
            names = sorted((t for t in df_of if df_of[t] >= least), key=lambda t: (-n_of[t], t))[:size]
            x = np.array([[terms_of[i].count(t) * np.log((len(train) + 1) / (df_of[t] + 1)) for t in names] for i in range(len(held))])
            x = np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones((len(held), 1))])
            w, ridge = np.zeros(x.shape[1]), np.append(np.ones(len(names)), 0)
            for _ in range(50):
                p = 1 / (1 + np.exp(-x[train] @ w))
                g = c * x[train].T @ ((p - y[train]) * weight[train]) + ridge * w
                w = w - np.linalg.solve(c * (x[train] * (p * (1 - p) * weight[train])[:, None]).T @ x[train] + np.diag(ridge) + 1e-9 * np.eye(len(w)), g)
            test = fold == f
            guess, real = x[test] @ w > 0, y[test] > 0
            each = [2 * ((guess == v) & (real == v)).sum() / ((guess == v).sum() + (real == v).sum()) for v in (False, True) if ((guess == v) | (real == v)).any()]
            f1.append(sum(each) / len(each))
        assert abs(got[size, column, least, c] - sum(f1) / folds) < 1e-9, (size, column, least, c)


def test_words_of_patterns_are_those_of_the_sql(spark):
    """Letters beyond a-z end a word of a context pattern, as in the SQL's engine; other line ends than a newline do not end a line."""
    taxonomy, context = {"r": "language", "phd": "education"}, {"r": [r"\br\b.*analy"], "phd": [r"in\s+phd.x"]}
    texts = ["für die analyse", "fur die analyse", "für die\nanalyse", "für die analyse", "in\x0bphd x", "in phd\rx", "in phd\nx"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.s for r in skills.with_skills(rows, "t", taxonomy, context, name="s").collect()}
    assert got == {0: ["r"], 1: [], 2: [], 3: ["r"], 4: ["phd"], 5: ["phd"], 6: ["phd"]}
    only = rows.select("k", skills.per_text(rows.t, lambda words, low: skills.rescued(words, low, taxonomy, context)).alias("s"))
    assert {r.k: r.s for r in only.collect()} == {0: ["r"], 1: [], 2: [], 3: ["r"], 4: [], 5: ["phd"], 6: []}


def test_name_line_begins_runs_of_letters_with_capitals(spark):
    from postlens.functions import text as T

    rows = spark.createDataFrame([("JANE  W. DOE",), ("MI!! ÑADORA",)], "t string")
    assert [r[0] for r in rows.select(T.name_line(rows.t)).collect()] == ["Jane W. Doe", "Mi!! ñAdora"]


def test_top_jobs_leaves_most_runs_out_and_loses_none(spark, monkeypatch):
    """Against every pair, with short runs and candidates of all kinds; and few pairs of a large table are scored."""
    import random
    from datetime import date, timedelta

    import numpy as np

    rnd, names, day = random.Random(5), [f"s{i}" for i in range(12)], date(2024, 1, 1)
    some = lambda n: sorted(rnd.sample(names, n))
    jobs = [(i, some(rnd.randint(0, 4)), some(rnd.randint(0, 2)), rnd.randint(0, 5), rnd.choice(["ke", "ng", "", None]), rnd.choice(["remote", "onsite", None]), day + timedelta(rnd.randint(-3, 12))) for i in range(600)]
    who = [(c, some(rnd.choice([0, 2, 6])), rnd.randint(0, 6), rnd.choice([[], ["ke"], ["ng", "ke"], ["za"]]), rnd.choice([[], ["remote"], ["onsite", "remote"]])) for c in range(60)]
    cand = spark.createDataFrame(who, "candidate_id long, skills array<string>, years int, locations array<string>, modes array<string>")
    posted = spark.createDataFrame(jobs, "job_id long, required array<string>, preferred array<string>, years_experience int, country string, work_mode string, deadline date")

    def score(c, j):
        own = lambda given, has: None if not given else len(set(given) & set(c[1])) / len(given)
        place, mode = (None if not x or not given else float(x in given) for x, given in ((j[4], c[3]), (j[5], c[4])))
        known = [x for x in (place, mode) if x is not None]
        parts = [(own(j[1], c), 0.65), (own(j[2], c), 0.15), (min(1, c[2] / j[3]) if j[3] else None, 0.15), (sum(known) / len(known) if known else None, 0.05)]
        total = sum(w for x, w in parts if x is not None)
        return round(sum(x * w for x, w in parts if x is not None) / total, 6) if total else 0.0

    for limits, k in (((3, 2, 50, 40, 7), 4), ((4000, 16, 10_000, 1_000_000, 2048), 25)):
        for name, value in zip(("BLOCK", "BLOCKS", "ROWS", "PAIRS", "RUN"), limits):
            monkeypatch.setattr(recommend, name, value)
        got = {}
        for r in recommend.top_jobs(cand if k > 4 else cand.where("candidate_id < 14"), posted, day, k).collect():
            got.setdefault(r.candidate_id, {})[r["rank"]] = (r.job_id, r.score)
        for c in who if k > 4 else who[:14]:
            best = sorted(((-score(c, j), max(j[3] - c[2], 0), -(0 <= (j[6] - day).days <= 7), j[0]) for j in jobs))[:k]
            assert [got[c[0]][i + 1] for i in range(k)] == [(j, -s) for s, _, _, j in best]

    # 40,000 postings of two places: a candidate of one place and all skills finishes within the first run of each size.
    import pyarrow as pa

    block = recommend._block([spark.createDataFrame([(1, ["a", "b"], 3, ["ke"], ["remote"])], cand.schema).first()])
    scored, real = [], recommend.Postings.score
    monkeypatch.setattr(recommend.Postings, "score", lambda self, w, r: scored.append(len(w)) or real(self, w, r))
    n = 40_000
    rows = {"required": ["a"] * n, "preferred": [""] * n, "years": np.zeros(n), "place": ["ke"] * (n // 2) + ["ng"] * (n // 2), "mode": ["remote"] * n, "urgent": [True] * n, "n_required": pa.array([1] * n, pa.int32()), "n_preferred": pa.array([0] * n, pa.int32()), "first": np.arange(n), "ids": [[i] for i in range(n)]}
    fold = recommend.Best([block], 10)
    fold.add(pa.RecordBatch.from_pydict(rows))
    assert sum(len(b) for b in fold.rows()) == 10 and sum(scored) <= 2 * 2048


def test_summary_reads_texts_once_and_lines_once(spark, data):
    """The metrics read what one pass over the texts wrote, and a line of many mentions without what tells them is gone through once."""
    import time

    from postlens.plans import q_skills, registry

    for name in ("k10_summary", "q3_summary"):
        assert not any("documents" in f for f in registry.QUERIES[name](spark, data).inputFiles())
    rows = [("r " * 60_000, False), ("r " * 30_000 + "\npackage " + "é" * 30_000, False), ("package\nr", False), ("package r", True), ("packager", False), ("r.package", True), ("für package", True), ("packagé\nmodel xr r_", False), ("xr model", False), ("r " * 9 + "\x85 model", True), ("rr r\nx", False)]
    began, only = time.time(), {"r": q_skills.CONTEXT["r"]}
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", skills.per_text(F.col("t"), lambda words, low: skills.rescued(words, low, {"r": "x"}, only)).alias("s")).collect()
    assert {r.i: r.s == ["r"] for r in got} == {i: told for i, (_, told) in enumerate(rows)}
    assert time.time() - began < 30  # each mention went through its line: minutes


def test_unlocks_meet_like_candidates_once(spark, monkeypatch):
    """Copies of candidates (in another order, with nulls) meet the postings once and tell the same; blocks are of near places and years."""
    rnd, skills = random.Random(9), [f"s{i}" for i in range(6)]
    j = spark.createDataFrame([(i, rnd.sample(skills, rnd.randint(1, 4)), rnd.choice("ab"), rnd.choice(["remote", "onsite"])) for i in range(80)], "job_id long, required array<string>, country string, work_mode string")
    one = [(i, rnd.sample(skills, rnd.randint(0, 3)), rnd.randint(0, 12), [rnd.choice("ab")], None) for i in range(20)]
    copies = [(i + 100 * k, have[::-1] + [None] * (k % 2), max(years, 7) + k if years >= 7 else years, home, None) for k in (1, 2, 3) for i, have, years, home, _ in one]
    schema = "candidate_id long, skills array<string>, years int, locations array<string>, modes array<string>"
    met, scan = [], recommend.scan
    monkeypatch.setattr(recommend, "scan", lambda who, *rest: met.append(who) or scan(who, *rest))
    monkeypatch.setattr(recommend, "BLOCK", 8)
    got = {}
    for r in recommend.unlocks(spark.createDataFrame([*one, *copies], schema), j).collect():
        got.setdefault(r.candidate_id, {})[r.skill] = r.unlocked
    assert got and all(got.get(i) == got.get(i % 100) for i, *_ in copies)
    assert met[0].count() == len({(tuple(sorted(have)), min(years, 7), home[0]) for _, have, years, home, _ in one})


def test_large_dictionaries_are_met_by_equality(spark):
    """Runs of words equal to a term, whatever stands around them; plain terms are not looked up in the text."""
    terms = spark.createDataFrame([("data engineer", "role"), ("Engineer", "x"), ("r", "lang"), ("c++", "lang"), ("machine learning ops", "x"), ("go", "lang")], "term string, category string")
    texts = ["Data engineer, C++ and R.", "data  engineer machine learning ops", "xdata engineers", "é data engineer machine learning opsé go", None, "ür go-live data engineer data engineer"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    out = skills.extract_from(rows, "k", "t", terms)
    assert sorted((r.k, r.skill) for r in out.collect()) == [
        (0, "Engineer"), (0, "c++"), (0, "data engineer"), (0, "r"), (1, "Engineer"), (1, "machine learning ops"), (3, "Engineer"), (3, "data engineer"), (3, "go"), (3, "machine learning ops"), (5, "Engineer"), (5, "data engineer"), (5, "go"),
    ]
    assert skills.extract_from(rows, "k", "t", terms.where("false")).count() == 0
    # No text is carried to the join where all terms are plain: what is exploded are runs of words.
    plan = skills.extract_from(rows, "k", "t", terms.where("length(term) > 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_low#" not in plan


def test_dense_top_by_blocks_equals_all_pairs(spark, monkeypatch):
    """With ties, copies, several passes and small blocks; a null vector and one of another length change nothing of the others."""
    import random

    from postlens.operators import retrieval

    rnd = random.Random(3)
    vecs = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)] + [1.0]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 5)
    monkeypatch.setattr(retrieval, "CELLS", 60)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in retrieval.dense_top(df, df.where("vec_id % 30 = 0 and vec_id < 300"), 5).collect())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cosine = lambda a, b: round(dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 6)
    expected = []
    for q, a in vecs[:300:30]:
        best = sorted((-cosine(a, b), v) for v, b in vecs[:300] if v != q)[:5]
        expected += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    assert got == expected


def test_split_deals_a_class_to_many_tasks(spark):
    """The same rows as by one window for each class, but no task holds a class."""
    from pyspark.sql import Window

    from postlens.operators import ml

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("label"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = ml.stratified_split(rows, "doc_id", "label", 0.25).select("*", F.spark_partition_id().alias("task")).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    w = Window.partitionBy("label")
    place = F.row_number().over(w.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    want = {r.doc_id for r in rows.withColumn("n", F.count("*").over(w)).withColumn("r", place).where("r <= 0.25 * n").collect()}
    assert set(split.doc_id[split.test]) == want and len(split) == 4000
    assert split.groupby("label", dropna=False).task.nunique().min() > 1


def test_unlocks_and_career_paths_by_blocks(spark, monkeypatch):
    """Against plain counting, with several blocks of candidates; a list's places do not multiply what the candidates meet."""
    skills, places, rnd = [f"s{i}" for i in range(7)], ["a", "b", "", None], random.Random(5)
    some = lambda n: rnd.sample(skills, rnd.randint(0, n))
    jobs = [(i, some(4), rnd.choice(places), rnd.choice(["remote", "onsite", None]), rnd.choice(["x é", "x z", "w"])) for i in range(150)]
    who = [(i, sorted(some(5)), rnd.randint(0, 12), [rnd.choice(["a", "b", "c"])], ["remote"]) for i in range(40)]
    j = spark.createDataFrame(jobs, "job_id long, required array<string>, country string, work_mode string, role string")
    c = spark.createDataFrame(who, "candidate_id long, skills array<string>, years int, locations array<string>, modes array<string>")
    want = {}
    for i, have, years, (home,), _ in who:
        for _, need, place, mode, _ in jobs:
            total = lambda m, n=len(need): (50 * ((200 * m + n) // (2 * n)) + 25 * min(100, 60 + 6 * years) + 15 * 85 + 10 * (100 if place == home else 90 if mode == "remote" else 55) + 50) // 100  # noqa: B023, E731
            m = len(set(need) & set(have))
            if need and total(m) < 70 <= total(m + 1):
                for s in set(need) - set(have):
                    want[i, s] = want.get((i, s), 0) + 1
    met = []
    monkeypatch.setattr(recommend, "BLOCK", 16)
    scan = recommend.scan
    monkeypatch.setattr(recommend, "scan", lambda a, given, *rest: met.append(given) or scan(a, given, *rest))
    assert {(r.candidate_id, r.skill): r.unlocked for r in recommend.unlocks(c, j).collect()} == want
    assert met[0].count() == len({tuple(sorted(x[1])) for x in jobs if x[1]})
    size = {r: {s for x in jobs if x[4] == r for s in x[1]} for r in ("x é", "x z", "w")}
    ranked = []
    for i, have, *_ in who:
        found = [(-((200 * h + len(need)) // (2 * len(need))), -sum(x[4] == r for x in jobs), r, h) for r, need in size.items() if (h := len(need & set(have)))]
        ranked += [(i, r, -n, len(size[r]) - h, h, -m, k + 1) for k, (m, n, r, h) in enumerate(sorted(found)[:2])]
    assert sorted(tuple(x) for x in recommend.career_paths(c, j.select("role", "job_id", "required"), 2).collect()) == sorted(ranked)


def test_index_counts_texts_in_place(spark):
    """The index of texts, of which some share an id or are null or empty, as plain counting gives it; its counts need no shuffle of words."""
    import math
    import re
    from collections import Counter

    from postlens.operators import retrieval

    rnd = random.Random(4)
    words = ["spark", "flink", "kafka", "the", "ab", "Beam", "hive", "x1yyy"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(60)] + [(3, "spark spark beam"), (3, None), (70, None), (71, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    tf = {}
    for i, t in rows:
        if found := re.findall("[a-z]{3,}", (t or "").lower()):
            tf.setdefault(i, Counter()).update(found)
    df_, cf = Counter(t for c in tf.values() for t in c), sum(tf.values(), Counter())
    names = sorted((t for t in df_ if 2 <= df_[t] <= 0.95 * len(rows)), key=lambda t: (-cf[t], t))[:4]
    want = {}
    for i, c in tf.items():
        w = {t: (1 + math.log(c[t])) * (math.log((1 + len(rows)) / (1 + df_[t])) + 1) for t in names if t in c}
        length = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): round(x / length, 9) for t, x in w.items()}
    index, vocabulary = retrieval.index(df, "id", "text", features=4)
    assert {(r.id, r.term): round(r.weight, 9) for r in index.collect()} == want and len(want) == index.count()
    assert {r.term for r in vocabulary.collect()} == set(names)
    assert "Exchange" not in retrieval.counts(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    packed, _ = retrieval.packed_index(df, "id", "text", features=4)
    asked = retrieval.project(spark.createDataFrame([(1, "spark kafka beam")], "item_id long, text string"), "item_id", "text", vocabulary)
    both = [[tuple(r) for r in retrieval.search(x, "id", asked, "item_id").orderBy("rank").collect()] for x in (index, packed)]
    assert both[0] == both[1] and len(both[0]) == 5


def test_coverage_reads_texts_once(spark, data):
    """Coverage works out all its columns in one pass, without a join of the texts with themselves."""
    from postlens.plans import registry

    plan = registry.QUERIES["e9_coverage"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_reasons_read_what_the_search_read(spark, data):
    """Postings and candidates are worked out once: the reasons read the saved tables, and a posting's rows are dealt once for its three groupings."""
    from postlens.plans import q_matching

    full = q_matching._full(spark, data, 1)
    assert not [p for p in full.inputFiles() if p.rsplit("/", 1)[-1] in ("lineitem.parquet", "orders.parquet", "supplier.parquet")]
    plan = q_matching._jobs(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(job_id") + plan.count("hashpartitioning(l_orderkey") <= 2  # and the postings that meet them


def test_misses_read_texts_once(spark, tmp_path):
    """Terms within longer words, by id: what one text of an id names elsewhere as a word is no miss, and two texts of an id are one miss."""
    from postlens.plans import q_retrieval

    rows = [(6, "kubernetesse"), (12, "pythonic pythonic"), (12, "pythonics"), (18, "pythonic"), (18, "python here"), (24, None), (30, "Pythons")]
    spark.createDataFrame([(k, t, "src0", "en", 0) for k, t in rows], "doc_id long, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    missed = q_retrieval._misses(spark, str(tmp_path))
    assert missed._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {r.skill: r.missed for r in missed.collect() if r.skill in ("python", "kubernetes")} == {"python": 2, "kubernetes": 1}


def test_quantiles_hold_no_group_in_one_task(spark):
    """Quarters of groups over several parts equal plain ones, with repeated values, nulls and a null group; no task collects a group's values."""
    import numpy as np

    from postlens.operators import aggregates

    rng = np.random.default_rng(3)
    rows = [(g, None if x % 9 == 0 else x / 7) for g, n in (("a", 3000), ("b", 1), ("c", 2), (None, 500)) for x in map(int, rng.integers(1, 900, n))] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, usd_mid double")
    told = {r.g: r for r in aggregates.salaries(df, ["g"]).collect()}
    assert set(told) == {g for g, _ in rows}
    for g, r in told.items():
        own = [x for k, x in rows if k == g and x is not None]
        assert (r.total, r.with_salary) == (sum(k == g for k, _ in rows), len(own))
        for name, q in (("q25", 0.25), ("salary_median", 0.5), ("q75", 0.75)):
            assert (getattr(r, name) is None) == (not own) and (not own or abs(getattr(r, name) - np.quantile(own, q)) <= 0.0501)
    plan = aggregates.describe(df, ["usd_mid"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_signatures_sort_by_a_number_first(spark):
    """Postings are sorted by a hash of their signature before its texts, and keep the ids that they stand for."""
    df = spark.createDataFrame([(i, ["brand#11", f"brand#{i % 7}"], [], i % 3, "KE", "remote") for i in range(60)], "job_id long, required array<string>, preferred array<string>, years_experience int, country string, work_mode string")
    out = recommend.signatures(df, k=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_hash#" in plan and "hashpartitioning(required#" not in plan
    assert "_hash" not in out.columns and sorted(len(r.ids) for r in out.collect()) == [2] * 21
