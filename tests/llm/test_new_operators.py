"""Merkle manifest, whitening and WARC bundles against brute force, with their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyarrow import fs as files
from pyspark.sql import functions as F

from postlens.llm import html_extract, merkle, shared, warc, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*[framed(v) for v in (r[0], r[3], r[2], r[4], text)])


def tree(nodes):
    """Root of (digest) nodes, and each one's (left, right) by level."""
    paths, groups, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, members = [], []
        for i in range(0, len(level), 8):
            run = level[i : i + 8]
            for j in range(len(run)):
                for leaf_at in groups[i + j]:
                    paths[leaf_at].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            members.append([x for g in groups[i : i + 8] for x in g])
        level, groups = up, members
    return level[0], paths


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts, out = [], []
    for g in langs:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        parts.append((own, *tree([leaf(r, r[1]) for r in own])))
    root, tops = tree([p[1] for p in parts])
    for (own, subroot, paths), top in zip(parts, tops):
        for r, path in zip(own, paths):
            path = path + top
            alter = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if alter and r[1] is not None else r[1]
            now = leaf(r, text)
            for a, b in path:
                now = h(a, now, b)
            out.append((r[0], leaf(r, r[1]), subroot, root, h(*[a + b for a, b in path]), now, now == root))
    return sorted(out, key=repr)


def manifest(spark, rows, tmp_path, name):
    df = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("x"), "path": F.lit(1), "root": F.lit(2.0), "digest": F.lit(3)})
    df.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11(spark, f"{tmp_path}/{name}").collect()), key=repr)


def test_manifest_matches_brute_force(spark, tmp_path, monkeypatch):
    """Nulls, repeated rows and ids, a lone leaf, a null language, long texts; blocks and range partitions of a few rows."""
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "Plain", "ÄÖ UPPER " * 3, "x" * 40_000]), rng.choice(["en", "en", "en", "de"]), rng.choice([None, "s"]), rng.choice([None, 7])) for i in range(160)]
    rows += [(5, "Twice", "en", "s", 1)] * 3 + [(5, "other", "en", "s", 1), (None, None, "en", None, None), (900, "Lone", "fr", "s", 4), (901, "NONE", None, "s", 4), (902, "None", None, "s", 4)]
    want = brute_manifest(rows)
    assert {v[-1] for v in want} == {True, False}
    assert manifest(spark, rows, tmp_path, "whole") == want
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(shared, "RANGE_ROWS", 20)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    assert manifest(spark, rows, tmp_path, "blocks") == want


def test_manifest_of_few_rows(spark, tmp_path):
    one = [(3, "A", "en", None, 1)]
    assert manifest(spark, one, tmp_path, "one") == brute_manifest(one)
    assert manifest(spark, [], tmp_path, "none") == []


def vectors(rows, spark):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_whiten(x, k):
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return fit, e, (x - fit.mean(0)) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((400, 20)) * np.linspace(3, 0.3, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    odd = [(800, None), (801, [1.0] * 19 + [None]), (802, [float("nan")] * 20), (803, [float("inf")] + [0.0] * 19), (804, [1.0, 2.0]), (805, [])]
    rows += [(900 + i, base[0].tolist()) for i in range(150)] + [(None, base[1].tolist()), (7, base[2].tolist())]
    df = vectors(rows + odd, spark).withColumns({"x": F.lit(1), "component": F.lit("c"), "n": F.lit(0)})
    got = whitening.whiten(df.repartition(4)).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit, e, want, explained = brute_whiten(x, 16)
    assert len(got) == 16 * len(rows) and set(got.n) == {len(fit)} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    s = fit.sum(0)
    deviation = {i: int(((len(fit) * v - s) ** 2).sum()) for (i, _), v in zip(rows, x) if i is not None and i != 7}
    signs = {}
    for r in got.itertuples():
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
        if r.vec_id == r.vec_id and r.vec_id != 7:
            assert r.deviation == deviation[r.vec_id]
            at = int(r.vec_id) if r.vec_id < 400 else 0
            value = want[at, r.component - 1]
            sign = signs.setdefault(r.component, np.sign(value * r.whitened))
            assert abs(r.whitened * sign - value) < 1e-8


def test_whitening_of_few_directions(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(40)]
    got = whitening.whiten(vectors(flat, spark)).toPandas()
    assert set(got.component) == {1} and got.explained.iloc[0] == pytest.approx(1)
    assert whitening.whiten(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])], spark)).count() == 0
    assert whitening.whiten(vectors([], spark)).count() == 0
    huge = whitening.whiten(vectors([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], spark)).collect()
    assert len(huge) >= 3 and all(r.deviation is None for r in huge if r.vec_id < 3)


@pytest.mark.parametrize("values", [np.arange(20, 0, -1.0), [5, 5, 5, 2, 2, 1, 1e-3, 0, 0], [1, 1 - 1e-10, 1 - 2e-10, 0.5], 10.0 ** -np.arange(20), [3, 0, 0], [0, 0]])
def test_leading_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))
    v = (q * np.array(values)) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.leading(v, 16)
    assert len(e) >= min(16, sum(x > 1e-10 for x in values))
    assert np.abs(e - np.sort(np.linalg.eigvalsh(v))[::-1][: len(e)]).max(initial=0) < 1e-12 and np.abs(u.T @ u - np.eye(len(e))).max(initial=0) < 1e-12 and np.abs(v @ u - u * e).max(initial=0) < 1e-12
    for at in np.linspace(-0.1, 5.1, 40):
        assert whitening.below(v, at) == (np.linalg.eigvalsh(v) < at).sum()


def test_exact_products():
    rng = np.random.default_rng(1)
    for most in (200, 1 << 41):
        a = rng.integers(-most, most, (700, 5))
        assert (whitening.exact_products(a) == a.T.astype(object) @ a.astype(object)).all()


PAGES = [
    (1, "http://a b/\r\nWARC-Type: x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (None, "v", ""), (2, None, "<p>é</p>"), (5, "w", "x" * 300_000),
    (6, "w", ""), (7, "w", "WARC/1.1\r\n\r\n"), (8, "w", "x" * 300_000), (4, "ü", "<p>é</p>"), (9, "z", "only"), (9, "z", "only"),
]


def brute_records(pages, least=0):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, t in pages if (t or "").encode() == raw and j is not None]
        first = min(same, default=None)
        revisit = len(raw) >= least and i != first
        out.append((i, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, monkeypatch, least):
    """Small frames and bundles, payloads that look like records, heavy payloads by broadcast, others by a shuffle."""
    monkeypatch.setattr(warc, "HEAVY", 3)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"first": F.lit(1), "_sha": F.lit("x"), "bundle": F.lit(2)}).repartition(3)
    path = f"{tmp_path}/archive"
    index = warc.write(df, path, warc.Config(frame_bytes=600, bundle_bytes=500, least=least))
    got = warc.read(index, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute_records(PAGES, least)
    html = {i: (t or "").encode() for i, _, t in PAGES}
    assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == html[r.page_id]) for r in got)
    assert index.select("bundle").distinct().count() > 2

    # Random access, and the bundles as plain archives with a skippable seek table.
    wanted = index.where("page_id in (2, 5)").select("record_id")
    assert sorted(r.page_id for r in warc.fetch(index, path, wanted).collect()) == sorted(i for i, _, _ in PAGES if i in (2, 5))
    store, folder = files.FileSystem.from_uri(path)
    for bundle in {r.bundle for r in index.collect()}:
        plain = zstandard.ZstdDecompressor().stream_reader(open(f"{folder}/{bundle}", "rb"), read_across_frames=True).read()
        table = warc.seek_table(store, f"{folder}/{bundle}")
        assert len(plain) == sum(n for _, _, n in table) and len(list(warc.parse(plain))) == 1 + index.where(F.col("bundle") == bundle).count()
        for r in index.where(F.col("bundle") == bundle).collect():
            frame = warc.read_frame(store, f"{folder}/{bundle}", *table[r.frame][:2])
            assert next(warc.parse(frame[r.offset : r.offset + r.length]))[1]["WARC-Record-ID"] == r.record_id


def test_archive_of_nothing_and_damage(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none, f"{tmp_path}/none"), f"{tmp_path}/none").count() == 0
    ident, record = warc.page_record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    ((_, headers, block),) = warc.parse(record)
    assert headers["WARC-Record-ID"] == ident and warc._page(headers, block)[-1] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc._page(headers, block.replace(b"payload", b"payl0ad"))
    with pytest.raises(ValueError, match="end"):
        list(warc.parse(record[:-2] + b"xx"))


def test_main_text_without_unwanted_parts(spark, data):
    """Comments, related links, an aside and a form inside an article, and a side bar; with and without the article's tag. Gold is what was written as the article."""
    import time

    pages = spark.read.parquet(f"{data}/pages.parquet")
    model = html_extract.train(pages)
    said = [f"Sentence {i} of the article, long enough to be one, with commas." for i in range(3)]
    parts = [
        '<section class="comments"><p>I liked this very much, thank you for writing it.</p></section><div class="related"><a href=y>Other</a><p>Another piece that you may like, read on.</p></div>',
        "<aside>Buy now and save a lot of money.</aside><form><p>Sign up for our letters, one a week.</p></form>",
    ]
    body = f"<p>{said[0]}</p><p>{said[1]}</p>{parts[0]}{parts[1]}<p>{said[2]}</p>"
    bar = '<div class="sidebar"><p>In the bar beside the text, with some words.</p></div>'
    shown = [f"<html><body><nav><a href=x>Home</a></nav>{bar}<{tag}>{body}</{tag}><footer>Imprint</footer></body></html>" for tag in ("article", "div")]
    rows = spark.createDataFrame(list(enumerate(shown)), "page_id long, html string")
    assert {r.text for r in html_extract.extract(rows, model).collect()} == {" ".join(said)}
    began = time.time()
    assert html_extract.Page("x > " + "<a " * 350_000).pieces and time.time() - began < 2


def test_secrets_joined_of_many_parts_or_characters():
    """Values of any number of parts and characters, also constants that double; a stand-in across a seam still counts."""
    from postlens.llm import secrets

    v = "Zx81kQ7pLm2RtVw9"
    found = lambda t: [t[a:z] for a, z, s in secrets.lex(t) if s >= secrets.THRESHOLD]
    doubled = f'a0 = "{v}"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(1500)) + "password = a1500\n"
    assert found(doubled) == [v]
    pieces = [f"{v}{i:03}" for i in range(200)]
    assert found("token = " + " + ".join(f'"{p}"' for p in pieces)) == pieces
    long = "".join(f"Zq{i}x" for i in range(2000))
    assert len(long) > 4096 and found(f'secret = "{long}"') == [long]
    assert found(f'a = "{v}exa"\nb = "mple{v}"\npassword = a + b\n') == []
    assert found(f'a = "{v}ex"\nb = "am"\nc = "ple{v}"\npassword = a + b + c\n') == []
