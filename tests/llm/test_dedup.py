import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_line_dedup_runs import check as check_runs
from veilspark.llm import line_dedup as L
from veilspark.llm import minhash as M
from veilspark.llm import suffix_dedup as S


# ------------------------------------------------------------------ line dedup
def line_check(spark, rows, min_words=50):
    return check_runs(spark, rows, min_words)


def test_line_runs_match_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    rows = []
    for i in range(16):
        if i % 4 == 0:
            a = rng.randint(0, 600)
            rows.append((i, "\n".join(pool[a:a + 700])))              # runs far longer than a block
        elif i % 4 == 1:
            rows.append((i, "\n".join([pool[5] or "x"] * rng.randint(1, 200))))
        else:
            rows.append((i, "\n".join(rng.choice(pool) for _ in range(30)) + "\n" +
                         "\n".join(pool[100:100 + rng.randint(1, 60)])))
    line_check(spark, rows)


def test_planted_passage_goes_and_its_first_place_stays(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(17)) for i in range(3))     # 51 words
    short = " ".join(f"q{j}" for j in range(20))
    own = ["\n".join(" ".join(f"d{d}w{i}x{j}" for j in range(12)) for i in range(6)) for d in range(4)]
    rows = [(1, own[0] + "\n" + passage), (2, passage + "\n" + own[1] + "\n" + short), (3, own[2] + "\n" + short),
            (4, own[3] + "\n" + passage + "\n" + passage)]
    got = line_check(spark, rows)
    assert got == {1: rows[0][1], 2: own[1] + "\n" + short, 3: rows[2][1], 4: own[3]}


def test_line_dedup_is_native_and_handles_awkward_rows(odd_docs, no_docs):
    out = L.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    rows = sorted((r["n_words"], r["text"]) for r in out.collect() if r["text"])
    kept = {n for n, _ in rows}
    assert 1 in kept and 2 not in kept and {6, 9, 10} <= kept      # one-line copies are one run
    assert out.filter("text is null").count() == 1
    assert L.deduplicate(no_docs).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


# ------------------------------------------------------------------ near duplicates
def sets_of(text, size):
    ws = (text or "").encode().translate(M.LOWER_AZ).split()
    return {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def components(rows, size=4):
    sets = [sets_of(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}, {d: len(s) for (d, _), s in zip(rows, sets)}


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(5)]
    rows = []
    for i in range(260):                                  # near copies at all distances, some beyond the threshold
        b = list(rng.choice(base[:2] if i % 3 else base))
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            b[rng.randrange(len(b))] = f"e{rng.randint(0, 9999)}"
        rows.append((i * 3 % 260, " ".join(b)))
    rows += [(1000, "one"), (1001, "ONE"), (1002, "one two three"), (1003, "one two  three"), (1004, ""), (1005, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comp, n = components(rows)
    got = {r["doc_id"]: r for r in M.link(docs).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == comp
    assert {d: r["n_shingles"] for d, r in got.items()} == n
    assert all(r["kept"] == (d == comp[d]) for d, r in got.items())
    assert sorted(r["doc_id"] for r in M.deduplicate(docs).collect()) == sorted(set(comp.values()))


def test_blocks_of_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    test_components_match_brute_force(spark)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for size in (1, 3, 40, 600):
        errors = []
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            a, b = np.unique(x[:size]), np.unique(x[size // 4:size + size // 4])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((M.sketch(a) == M.sketch(b)).mean() - true)
        assert abs(np.mean(errors)) < 0.05
    assert (M.sketch(a) == M.sketch(a[::-1].copy())).all()


def test_near_dedup_awkward_rows(odd_docs, no_docs):
    out = M.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((r["n_words"]) for r in out.collect()) == [1, 3, 4, 5, 6, 7, 9, 10]
    assert M.link(no_docs).count() == 0 and M.link(odd_docs).count() == odd_docs.count()


# ------------------------------------------------------------------ repeated byte strings
@pytest.fixture(scope="module")
def byte_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(30, 900))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            x = rng.randint(0, len(b))
            t += b[x:x + rng.randint(0, 500)] + "".join(rng.choice("xyé") for _ in range(rng.randint(0, 40)))
        rows.append((i, t + ("ab" * rng.randint(50, 400) if i % 10 == 0 else "")))
    return rows + [(1000 + i, rows[7][1]) for i in range(3)] + [(2000, None), (2001, "")]


@pytest.mark.parametrize("hot", [S.HOT, 0])
def test_repeated_bytes_match_brute_force(spark, byte_rows, hot):
    docs = spark.createDataFrame(byte_rows, "doc_id long, text string")
    want = brute.suffix_dedup([(d, (t or "").encode()) for d, t in byte_rows], S.LENGTH)
    got = S.remove_repeats(docs, hot=hot, keep_text=True).collect()
    assert len(got) == len(byte_rows)
    for r in got:
        gone, runs, kept = want[r["doc_id"]]
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == (gone, runs, kept)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_deep_shallow_orders_like_sorting():
    rng = random.Random(6)
    stems = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(8)]
    text = [(rng.choice(stems) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))).encode() for _ in range(300)]
    text += [b"", b"a\0", b"a", b"a\0\0b"]
    group = np.array([rng.randint(0, 3) for _ in text])
    order, lcp = S.deep_shallow(group, text, shallow=16)
    want = sorted(range(len(text)), key=lambda i: (group[i], text[i]))
    assert [(group[i], text[i].rstrip(b"\0")) for i in order] == [(group[i], text[i].rstrip(b"\0")) for i in want]
    for k in range(1, len(order)):
        a, b = text[order[k - 1]], text[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            assert lcp[k] == S.common(a, b)


def test_every_string_holds_an_anchor_chosen_by_content():
    rng = random.Random(7)
    core = bytes(rng.choice(b"abcdef ") for _ in range(S.LENGTH))
    offsets = set()
    for _ in range(20):
        before = bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(0, 300)))
        at, _ = S.anchors(before + core + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 300))))
        offsets.add(frozenset(int(p) - len(before) for p in at
                              if len(before) <= p <= len(before) + S.LENGTH - S.K))
    assert len(frozenset.intersection(*offsets)) >= 1


def test_repeated_bytes_awkward_rows(odd_docs, no_docs):
    out = {r["doc_id"]: r for r in S.remove_repeats(odd_docs).collect()}
    assert out[0]["n_removed"] == out[0]["n_bytes"] and out[2]["n_bytes"] == 0 and out[8]["n_removed"] == 0
    assert S.remove_repeats(no_docs).count() == 0
