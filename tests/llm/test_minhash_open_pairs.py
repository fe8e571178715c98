"""Open buckets: exact comparison between components, few links."""

import random

import numpy as np

from veilspark.llm import minhash as M

SCHEMA = "bucket long, band int, node binary, comp binary, n long, shared long, sketch array<int>, set binary"


def test_a_low_estimate_does_not_drop_a_similar_pair(spark):
    # Two sets of 100 with 90 in common, whose sketches happen to agree in one band only.
    a, b = np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)
    sk_a, sk_b = list(range(M.T)), list(range(M.R)) + list(range(1000, 1000 + M.T - M.R))
    other = np.arange(500, 600, dtype=np.uint64)
    sk_c = list(range(M.R)) + list(range(3000, 3000 + M.T - M.R))
    rows = [(7, 0, x, x, 100, 100, s, h.tobytes()) for x, s, h in ((b"a", sk_a, a), (b"b", sk_b, b), (b"c", sk_c, other))]
    got = M._open_links(M._open_blocks(spark.createDataFrame(rows, SCHEMA)), M.THRESHOLD).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in got] == [(b"a", b"b")]


def test_links_join_the_same_components_as_all_pairs(spark, monkeypatch):
    """Small blocks, one large component and many small ones, against every pair."""
    monkeypatch.setattr(M, "BLOCK", 5)
    rng = random.Random(3)
    base = [np.array(rng.sample(range(10_000), 60)) for _ in range(4)]
    rows, sets = [], {}
    for i in range(60):
        s = base[i % 4].copy()
        s[:rng.choice([0, 2, 5, 8, 20])] = rng.sample(range(10_000, 20_000), 60)[:1]
        s = np.unique(s).astype(np.uint64)
        node, comp = bytes([i]), b"big" if i % 4 == 0 and i < 40 else bytes([i])
        sets[node] = (s, comp)
        rows.append((1, 0, node, comp, len(s), len(s), [0] * M.T, s.tobytes()))
    blocks = M._open_blocks(spark.createDataFrame(rows, SCHEMA))
    got = [(bytes(r["a"]), bytes(r["b"])) for r in M._open_links(blocks, M.THRESHOLD).collect()]
    assert all(M.similar(sets[a][0], sets[b][0]) and sets[a][1] != sets[b][1] for a, b in got)
    most = {}
    for r in blocks.groupBy("kind", "i", "j").agg({"comp": "approx_count_distinct"}).collect():
        most[r["kind"], r["i"], r["j"]] = r[3]
    assert len(got) <= sum(most.values())

    def groups(links):
        root = {c: c for _, c in sets.values()}
        for a, b in links:
            x, y = root[sets[a][1]], root[sets[b][1]]
            root = {k: x if v == y else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    every = [(a, b) for a in sets for b in sets if a < b and M.similar(sets[a][0], sets[b][0])]
    assert groups(got) == groups(every)
