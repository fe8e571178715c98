"""Phrase mining against a plain count of every window of words."""

import random
import re
from collections import Counter

from veilspark.llm import collocations as C


def brute(rows, min_count, top, max_words=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    inside = {}
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(a, inside.get((lang, w[i:i + k]), 0))
    out = {}
    for (lang, w), a in cand.items():
        if 100 * inside.get((lang, w), 0) >= 100 * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:j]] * f[lang, w[j:]]), j, f[lang, w[:j]], f[lang, w[j:]])
                                    for j in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def check(spark, rows, min_count=3, top=50, parts=3, **limits):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    got = C.mine(df, min_count=min_count, top=top, **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_count, top)


def test_random_text(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        words = rng.choices(["a", "b", "C", "é", "d\x00", "ß9", "the", "of"], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " ", "\r", "\x0b"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    check(spark, rows, min_count=4)


def test_partial_stripes_are_merged(spark):
    """Tasks that write their stripes in many parts, and short stretches of text, change nothing."""
    rng = random.Random(2)
    check(spark, [("en", " ".join(rng.choices("abc", k=40))) for _ in range(30)], parts=5,
          max_entries=1, slice_bytes=16)


def test_full_filter_decides_nothing(spark, monkeypatch):
    """With the smallest bitmap nearly every hash passes; the counts stay exact."""
    monkeypatch.setattr(C, "_filter_bits", lambda *a: b"\xff" * 4096)
    rng = random.Random(3)
    check(spark, [("en", " ".join(rng.choices("abcdefg", k=60))) for _ in range(40)])


def test_ties_repeats_and_subsumption(spark):
    check(spark, [("en", "x y z. x y z")] * 5 + [("en", "p q")] * 5 + [("en", "q p")] * 5 + [("de", "a a a a a a a")] * 3)


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F
    a, n = 3_000_000_000_000, 9_000_000_000_000_000
    row = spark.sql(f"select {a}L a, {n}L n, array({a}L, {a}L) firsts, array({a + 7}L) rests").select(F.expr(C._best_cut()).alias("c")).first()
    assert row["c"]["score"] == 1000 * a * n // (a * (a + 7))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    got = sorted(tuple(r) for r in C.mine(odd_docs, min_count=2, top=100_000).collect())
    assert got == brute(rows, 2, 100_000)
    assert C.mine(no_docs).collect() == []
