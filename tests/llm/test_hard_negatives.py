"""Hard negatives against a comparison of every anchor with every row."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor_id string"


def brute(rows, every=50):
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        own[i] = min(own.get(i, (label, x)), (label, x))
    own = {i: ((label + 1) % 10 if i % 7 == 0 else label, x) for i, (label, x) in own.items()}
    out = []
    for a, (la, xa) in own.items():
        if a % every:
            continue
        s = sorted((-sum(p * q for p, q in zip(xa, x)), i, label) for i, (label, x) in own.items() if i != a)
        for ps, p, _ in [t for t in s if t[2] == la][:5]:
            far = [t for t in s if t[2] != la and 50 * -ps <= 100 * -t[0] <= 95 * -ps][:3]
            out += [(a, p, r, i, -ps, -ns) for r, (ns, i, _) in enumerate(far, 1)]
    return sorted(out)


def relabel(i, label):
    return F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)


def check(spark, rows, every=50, **kw):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    got = H.mine(df, relabel=relabel, anchor_every=every, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every)


def test_random_rows_in_small_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], rng.randrange(4)) for i in range(400)]
    check(spark, rows, every=10, block_rows=64, block_anchors=16)
    assert brute(rows, 10)


def test_ties_go_by_id(spark):
    """Few distinct vectors: most scores are equal, in one block and across blocks."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(3)], rng.randrange(3)) for i in range(300)]
    check(spark, rows, every=20, block_rows=50)
    check(spark, rows, every=20)


def test_one_label_holds_most_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(5)], 0 if i % 10 else 1) for i in range(300)]
    check(spark, rows, every=25, block_rows=40, block_anchors=4)


def test_odd_rows(spark):
    good = [(i, [0.1 * (i % 5), -0.2, 0.3 * (i % 3)], i % 2) for i in range(1, 60)]
    rows = good + [(None, [1.0, 1.0, 1.0], 0), (100, None, 0), (101, [1.0, 1.0, 1.0], None), (102, [1.0, None, 1.0], 0),
                   (103, [1.0, float("nan"), 1.0], 0), (104, [float("inf"), 1.0, 1.0], 1), (50, [0.0, 0.0, 0.0], 1),
                   (1, [0.1, -0.2, 0.3], 1), (1, [0.1, -0.2, 0.3], 1), (105, [0.9], 0), (106, [], 1), (110, [0.0, 0.0, 0.0], 0)]
    check(spark, rows, every=10)
    check(spark, [], every=10)
    check(spark, [(50, [0.5], 1)], every=10)


def test_walk_stops_early_and_loses_nothing():
    """One long axis: the threshold falls fast, so most rows are never met."""
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (5000, 4)).astype(np.int64)
    x[:, 0] = rng.integers(-1000, 1001, 5000)
    lists, anchor = H.Lists(np.arange(5000), x), np.array([100, 1, -1, 0])
    met = 0
    for rows, _, threshold in lists.walk(anchor):
        met += len(rows)
        if threshold < 90_000:
            break
    assert met < 2500
    (r, s), = H.top_windows(lists, anchor, [(-np.inf, 95_000)], 3)
    score = x @ anchor
    want = sorted((-v, i) for i, v in enumerate(score) if v <= 95_000)[:3]
    assert sorted(zip((-s).tolist(), r.tolist())) == want


def test_scores_too_large_are_an_error(spark):
    import pytest
    df = spark.createDataFrame([(50, [3e30], 1, "", ""), (51, [3e30], 1, "", "")], SCHEMA)
    with pytest.raises(Exception, match="62 bits|overflow|OVERFLOW"):
        H.mine(df).collect()


def test_large_integers_are_exact(spark):
    rows = [(i, [30000.0 + i / 256, 30000.0 - i / 512], i % 2) for i in range(1, 60)]
    check(spark, rows, every=10)
