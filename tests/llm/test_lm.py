import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import lm_hmm as H
from veilspark.llm.common import held_out


def naive(p, seq):
    """Unscaled forward recursion."""
    a = p.start * p.emit[seq[0]]
    for o in seq[1:]:
        a = (a @ p.move) * p.emit[o]
    return math.log10(a.sum())


def test_forward_is_exact_and_em_never_loses_likelihood():
    rng = np.random.default_rng(1)
    p = H.initial(np.ones(12), 3)
    seqs = [rng.integers(0, 12, n).astype(np.int32) for n in (1, 7, 30, 2, 30, 1)]
    seqs += [np.tile([0, 1, 2], 20).astype(np.int32), np.tile([7, 8], 25).astype(np.int32)]
    got = H.forward(p, H._Packed(seqs), keep=False)[0]
    assert np.allclose(got, [naive(p, s) for s in seqs])
    last = -1e9
    for _ in range(15):
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((12, 3))
        ll = H.expected(p, H._Packed([s.copy() for s in seqs]), start, move, emit)
        assert ll >= last - 1e-9 and np.isclose(emit.sum(), sum(map(len, seqs)))
        last = ll
        p = H.Parameters(start / start.sum(), move / move.sum(1, keepdims=True), (emit + 1e-12) / (emit + 1e-12).sum(0))


def test_expected_counts_match_enumeration():
    from itertools import product
    p = H.initial(np.ones(4), 2)
    seq = np.array([0, 3, 1], np.int32)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    H.expected(p, H._Packed([seq]), start, move, emit)
    w = {z: p.start[z[0]] * p.emit[0, z[0]] * p.move[z[0], z[1]] * p.emit[3, z[1]] * p.move[z[1], z[2]] * p.emit[1, z[2]]
         for z in product(range(2), repeat=3)}
    total = sum(w.values())
    assert np.allclose(start, [sum(v for z, v in w.items() if z[0] == k) / total for k in range(2)])
    assert np.allclose(move[0, 1], sum(v * sum((z[i], z[i + 1]) == (0, 1) for i in range(2)) for z, v in w.items()) / total)
    assert np.allclose(emit[3, 1], sum(v for z, v in w.items() if z[1] == 1) / total)


def test_one_look_gives_class_and_count_and_rows_add_up_alike():
    top = [(f"w{i}".encode(), 100 - i) for i in range(40)]
    classes = H.Classes(top, 10, 4)
    words = [b"w39", b"w3", b"new", H.END, b"w10", b"w3"]
    c, counts = classes.with_counts(words)
    assert c.tolist() == classes.of(words).tolist() and c[1] == c[5] == 3 and (c[[0, 2, 3, 4]] >= 10).all()
    assert counts.tolist() == [61, 97, 0, 0, 90, 97]
    assert [x.tolist() for x in classes.with_counts([])] == [[], []]
    for kind in (np.float32, np.float64):
        for n in (1, 127, 500):
            a = np.random.default_rng(n).random((n, 8)).astype(kind)
            assert np.array_equal(H._row_sums(a), a.sum(1))
    packed = H._Packed([np.array([1, 2], np.int32)])
    assert packed.obs.dtype == packed.doc.dtype == np.intp


@pytest.fixture(scope="module")
def scored(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "UNSEENWORD of"), (0, "again"), (None, "of")],
                                  "doc_id long, text string")
    docs = docs.unionByName(extra)
    train = docs.filter(~held_out(F.col("doc_id"), 5))
    # Small bounds, so that shared classes and the joined counts are used.
    model = H.train(train, key="doc_id", states=4, own=300, shared=64, broadcast_words=500, warm=3, full=2)
    return docs.collect(), train.collect(), H.score(docs, model).collect(), model


def test_counts_and_base_score_match_brute_force(scored):
    docs, train, got, _ = scored
    c = Counter(w for r in train for w in H.tokens((r["text"] or "").encode()))
    n, v = sum(c.values()), len(c)
    want = []
    for r in docs:
        ws = H.tokens((r["text"] or "").encode())
        want.append((r["doc_id"] if r["doc_id"] is not None else -1, len(ws), sum(c[w] > 0 for w in ws),
                     round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)))
    assert sorted(want) == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"],
                                   round(r["base_score"], 5)) for r in got)
    assert {r["train_tokens"] for r in got} == {n}


def test_score_is_the_sequence_likelihood(scored):
    docs, train, got, model = scored
    c = Counter(w for r in train for w in H.tokens((r["text"] or "").encode()))
    classes, p = model.classes.value, model.params
    in_class = Counter()
    kinds = Counter()
    for w, k in c.items():
        b = int(classes.of([w])[0])
        in_class[b] += k
        kinds[b] += 1
    want = []
    for r in docs:
        ws = H.tokens((r["text"] or "").encode())
        b = classes.of(ws)
        x = float(H.forward(p, H._Packed([b]), keep=False)[0][0])
        x += sum(math.log10((c[w] + 0.5) / (in_class[k] + 0.5 * (kinds[k] + 1)))
                 for w, k in zip(ws, b.tolist()) if k >= classes.n_own)
        want.append(round(x, 4))
    assert sorted(want) == sorted(round(r["score"], 4) for r in got)


def test_held_out_texts_score_better_than_the_base(scored):
    from zlib import crc32
    out = [r for r in scored[2] if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_no_training_rows_and_no_rows(spark, no_docs, odd_docs):
    model = H.train(no_docs.select("doc_id", "text"), warm=1, full=1)
    out = H.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(r["n_known"] == 0 for r in out)
    assert H.score(no_docs, model).count() == 0
