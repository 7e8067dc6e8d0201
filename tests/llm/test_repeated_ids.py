"""Two texts under one id: neither loses what only the other holds, and no other document is touched."""

import hashlib
import random

import pytest

from postlens.llm import debruijn_dedup, suffix_dedup

rng = random.Random(5)
A = " ".join(f"w{rng.randrange(900)}" for _ in range(200))
B = " ".join(f"b{rng.randrange(900)}" for _ in range(10))
C = " ".join(A.split()[:60]) + " " + B
OTHERS = [(i, " ".join(f"o{i}x{rng.randrange(900)}" for _ in range(30))) for i in range(5, 40)]


def _bytes_gone(rows, i, text):
    raw = text.encode()
    smaller = {t.encode()[p : p + 50] for j, t in rows if j < i for p in range(len(t.encode()) - 49)}
    gone = bytearray(len(raw))
    for p in range(len(raw) - 49):
        if raw[p : p + 50] in smaller:
            gone[p : p + 50] = b"\1" * 50
    return hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest(), sum(gone)


def _words_gone(rows, i, text, k=35):
    windows = [tuple(t.split()[p : p + k]) for _, t in sorted(set(rows)) for p in range(len(t.split()) - k + 1)]
    words, gone = text.split(), set()
    for p in range(len(words) - k + 1):
        if windows.count(tuple(words[p : p + k])) > 1:
            gone |= set(range(p, p + k))
    return hashlib.sha256(" ".join(w for p, w in enumerate(words) if p not in gone).encode()).hexdigest(), len(gone)


@pytest.mark.parametrize("order", [[(1, A), (2, A), (2, B)], [(1, A), (2, B), (2, A)], [(2, C), (1, A), (2, B), (2, A), (2, A), (3, C)], [(2, A), (2, C), (7, C)]])
def test_two_texts_under_one_id(spark, order):
    rows = order + OTHERS
    df = spark.createDataFrame([*rows, (None, A)], "doc_id long, text string").repartition(3)
    for run, size, brute in ((suffix_dedup.remove_substrings, "n_bytes", _bytes_gone), (debruijn_dedup.remove_repeated, "n_words", _words_gone)):
        got = sorted((r.doc_id, r.kept_sha256, r.n_removed) for r in run(df).where("doc_id is not null").collect())
        assert got == sorted((i, *brute(rows, i, t)) for i, t in rows), run
        assert run(df).where("doc_id is null").select("n_removed").first()[0] == 0
