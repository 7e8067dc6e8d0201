"""The corpus pipeline, stage by stage."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm import decontaminate, minhash, secrets
from postlens.llm.shared import cut


def test_stages_keep_columns_and_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    names = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, data), f"test-{name}")
        if name != "packing":
            assert out.columns == names
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
            docs = out
        left[name] = out
    near = minhash.near_duplicates(left["near_dedup"].select("doc_id", "text"))
    assert near.where("doc_id <> component_id").count() == 0
    assert decontaminate.mark(left["decontamination"], items).where("size(hit_items) > 0").count() == 0
    for r in left["secrets"].collect():
        assert not [s for s in secrets.base_spans(r.text) if s[2] < 2] and r.n_chars == len(r.text)
    packed = left["packing"].toPandas()
    want = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text)) for r in left["secrets"].collect()}
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == want


def words_of(t, pattern):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def one_of_each_group(rows):
    """Ids that stay: the smallest of each component of five-word shingle sets with a similarity of 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = words_of(t, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 1000 * both >= 800 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def without_passages(t, windows):
    """The text without the words of benchmark windows, or None if they are more than half of it."""
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t[a:z]) for a, z in found]
    hit = [False] * len(w)
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in windows:
                hit[k : k + size] = [True] * size
    if sum(hit) > len(w) * 0.5:
        return None
    out, last, k = [], 0, 0
    while k < len(w):
        if hit[k]:
            j = k
            while j + 1 < len(w) and hit[j + 1]:
                j += 1
            out.append(t[last : found[k][0]])
            last = found[j][1]
            k = j
        k += 1
    return "".join(out) + t[last:] if t is not None else None


def edge_docs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(150)
    name = docs.columns
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    long = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(60_000))
    odd = [
        (900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, "one"), (900_005, "one"), (900_006, long), (900_007, long + " end"), (900_008, item), (900_009, "Before it " * 40 + item + " after it."),
        (900_010, 'password = "Zx81kQ7pLm2RtVw9"'), (900_011, "ſ ß é İ 漢字"), (900_012, "same text again"), (900_012, "same text again"),
    ]
    rows = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars int")
    return docs.unionByName(rows.select(*[rows[c].cast(docs.schema[c].dataType) for c in name]))


def test_stages_match_brute_force_and_take_edge_rows(spark, data):
    docs = cut(edge_docs(spark, data), "edges")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = cut(stages["toxicity"](spark, docs, data), "edges")
    assert clean.columns == docs.columns and clean.count() >= 100
    rows = [(r.doc_id, r.text) for r in clean.collect()]

    kept = cut(stages["near_dedup"](spark, clean, data), "edges")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(one_of_each_group(rows))

    windows = set()
    for r in items.collect():
        w = words_of(r.text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    freed = cut(stages["decontamination"](spark, kept, data), "edges")
    want = {r.doc_id: without_passages(r.text, windows) for r in kept.collect()}
    want = {i: t for i, t in want.items() if t is not None or i == 900_001}
    assert {r.doc_id: r.text for r in freed.collect()} == want and 900_008 not in want

    safe = cut(stages["secrets"](spark, freed, data), "edges")
    for r in safe.collect():
        spans, t = secrets.all_spans(want[r.doc_id] or ""), want[r.doc_id]
        gone = {k for a, z, _ in spans for k in range(a, z)}
        plain = "".join(c for k, c in enumerate(t or "") if k not in gone)
        assert (r.text or "").replace("[SECRET]", "") == plain and (r.text is None) == (t is None)
        assert r.n_chars is None and t is None or r.n_chars == len(r.text)

    packed = stages["packing"](spark, safe, data).toPandas()
    sizes = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in safe.collect()}
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == sizes
    bins = packed.dropna(subset=["bin_id"]).groupby("bin_id")
    assert (bins.n_tokens.sum() <= bins.bin_capacity.first()).all()


def test_empty_documents_and_clashing_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({"bucket": F.lit(1), "component_id": F.lit("x"), "_n": F.lit(2.5), "toxicity": F.lit("high")})
    for given in (docs.limit(0), docs.limit(30)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, now, data), "clash")
            if name != "packing":
                assert out.columns == given.columns
                now = out
        assert (out.count() == 0) == (given.count() == 0)


def test_run_equals_stages(spark, data):
    assert corpus_pipeline.run(spark, data).select("doc_id").distinct().count() > 50
