"""Pivot-pruned nearest neighbour within a radius, against every pair."""

import numpy as np
import pytest

from veilspark.operators import threshold as Th

DIM = 6


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIM)).round(2)
    if copies:
        x[:copies] = x[0]
    return x.astype(np.float32)


def brute(q, c, radius):
    out = {}
    for i, v in q:
        if v is None:
            continue
        near = [(round(float(np.sqrt(((np.float64(v) - np.float64(w)) ** 2).sum())), 9), j) for j, w in c if w is not None]
        near = [t for t in near if t[0] <= radius]
        out[i] = min(near) if near else None
    return out


def frame(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(t) for t in v]) for i, v in rows], f"{key} long, embedding array<float>")


@pytest.mark.parametrize("max_bytes", [1 << 20, 2000])       # one block, or cells in salted groups
@pytest.mark.parametrize("radius", [0.0, 0.4, 1.5])
def test_matches_all_pairs(spark, max_bytes, radius):
    stored = list(enumerate(vectors(1400, 1, copies=300))) + [(5000, None)]
    probes = [(10_000 + i, v) for i, v in enumerate(np.r_[vectors(60, 2), vectors(1400, 1, copies=300)[:40]])] + [(9, None)]
    got = Th.nearest_within(frame(spark, probes, "qid"), frame(spark, stored, "id"), radius=radius, dim=DIM, max_bytes=max_bytes).collect()
    want = brute(probes, stored, radius)
    assert {r["qid"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r["qid"]]
        assert (r["id"] is None and r["distance"] is None) if w is None else (r["id"], round(r["distance"], 9)) == (w[1], w[0]), r
    if radius < 1:
        assert sum(r["compared"] for r in got) < 0.1 * len(probes) * len(stored)


def test_tiles_cut_probes_and_candidates(monkeypatch):
    monkeypatch.setattr(Th, "TILE_PAIRS", 7)
    x, q = vectors(200, 3), vectors(30, 4)
    p = Th.choose_pivots(x.astype(float), 3)
    stored = Th.Stored(np.arange(200), x.astype(float), Th.pivot_distances(x.astype(float), p))
    best, dist, _ = stored.nearest(q.astype(float), Th.pivot_distances(q.astype(float), p), 2.0)
    want = brute(list(enumerate(q)), list(enumerate(x)), 2.0)
    for i in range(30):
        assert want[i] is None if best[i] < 0 else (round(float(dist[i]), 9), int(stored.ids[best[i]])) == want[i]


def test_wrong_length_and_empty(spark):
    q, none = frame(spark, [(1, vectors(1, 5)[0])], "qid"), frame(spark, [], "id")
    assert [(r["id"], r["compared"]) for r in Th.nearest_within(q, none, radius=1.0, dim=DIM).collect()] == [(None, 0)]
    short = frame(spark, [(1, [1.0, 2.0])], "id")
    with pytest.raises(Exception, match="vectors must have"):
        Th.nearest_within(q, short, radius=1.0, dim=DIM).collect()
    with pytest.raises(ValueError):
        Th.nearest_within(q, none, radius=float("inf"), dim=DIM)
