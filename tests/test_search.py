"""k-NN against numpy brute force; match keys; probe blocks; score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators.search import knn, metadata_contains

DIM = 64


def _brute(rows, k, metric, same_label):
    ids = np.array([r["vec_id"] for r in rows])
    X = np.array([r["embedding"] for r in rows], dtype=np.float64)
    lab = np.array([r["label"] for r in rows])
    out = {}
    for i, q in enumerate(X):
        d = np.sqrt(((X - q) ** 2).sum(1)) if metric == "l2" else -(X @ q)
        mask = lab == lab[i] if same_label else np.ones(len(X), bool)
        cand = sorted((d[j], ids[j]) for j in np.nonzero(mask)[0])[:k]
        out[ids[i]] = [c[1] for c in cand]
    return out


@pytest.mark.parametrize("metric", ["l2", "inner"])
@pytest.mark.parametrize("same_label", [True, False])
@pytest.mark.parametrize("probe_rows", [50_000, 60])     # broadcast / salted groups
def test_knn_matches_brute_force(spark, sf_small, metric, same_label, probe_rows):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = e.collect()
    q = e.select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("ql"))
    c = e.select(F.col("vec_id").alias("id"), "embedding", "label")
    res = knn(q, c, k=4, metric=metric, match=[("ql", "label")] if same_label else None,
              dim=DIM, probe_bytes=probe_rows * 8 * DIM)
    got = {}
    for r in res.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    want = _brute(rows, 4, metric, same_label)
    for qid, ids in want.items():
        assert [i for _, i in sorted(got[qid])] == ids


def test_probe_blocks_equal_single_pass(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    c = e.select(F.col("vec_id").alias("id"), "embedding")
    one = {(r["qid"], r["rank"], r["id"]) for r in knn(q, c, k=3, dim=DIM).collect()}
    many = {(r["qid"], r["rank"], r["id"]) for r in knn(q, c, k=3, dim=DIM, probe_bytes=97 * 8 * DIM).collect()}
    assert one == many


def test_score_and_empty_probe_set(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    c = e.select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("qid"), "embedding")
    top = knn(q, c, k=1, dim=DIM).first()
    assert top["id"] == 0 and abs(top["distance"]) < 1e-6 and abs(top["score"]) < 1e-6
    assert knn(q.where("false"), c, k=2, dim=DIM).count() == 0


def test_metadata_contains(spark):
    df = spark.createDataFrame([({"doc": "a", "x": "1"},), ({"doc": "b"},), ({},)], "m map<string,string>")
    assert df.where(metadata_contains(F.col("m"), {"doc": "a"})).count() == 1
    assert df.where(metadata_contains(F.col("m"), {})).count() == 3
    assert df.where(metadata_contains(F.col("m"), {"doc": "a", "x": "2"})).count() == 0
    probe = F.create_map(F.lit("doc"), F.lit("b"))
    assert df.where(metadata_contains(F.col("m"), probe)).count() == 1


def test_hot_key_is_split(spark, sf_small):
    """One key holding most rows: the salted path still returns exact results."""
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    hot = F.when(F.col("label") < 8, F.lit(0)).otherwise(F.col("label"))
    q = e.select(F.col("vec_id").alias("qid"), "embedding", hot.alias("ql"))
    c = e.select(F.col("vec_id").alias("id"), "embedding", hot.alias("label"))
    a = {(r["qid"], r["rank"], r["id"]) for r in knn(q, c, k=3, match=[("ql", "label")], dim=DIM).collect()}
    b = {(r["qid"], r["rank"], r["id"]) for r in knn(q, c, k=3, match=[("ql", "label")], dim=DIM, probe_bytes=40 * 8 * DIM).collect()}
    assert a == b


@pytest.mark.parametrize("probe_bytes", [1 << 20, 8])
def test_null_vectors_are_skipped_and_wrong_lengths_fail(spark, probe_bytes):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "id long, embedding array<float>")
    q = spark.createDataFrame([(10, [0.9, 0.1]), (11, None)], "qid long, embedding array<float>")
    got = [(r["qid"], r["id"]) for r in knn(q, c, k=5, dim=2, probe_bytes=probe_bytes).orderBy("qid", "rank").collect()]
    assert got == [(10, 1), (10, 2)]
    bad = c.unionByName(spark.createDataFrame([(3, [1.0, 0.0, 0.0])], c.schema))
    with pytest.raises(Exception, match="vectors must have 2 values"):
        knn(q, bad, k=5, dim=2, probe_bytes=probe_bytes).collect()
    with pytest.raises(Exception, match="vectors must have 3 values"):
        knn(q, c, k=5, dim=3, probe_bytes=probe_bytes).collect()


@pytest.mark.parametrize("probe_bytes", [1 << 20, 16])
def test_ties_go_by_id(spark, probe_bytes):
    """400 equal vectors in shuffled order: the five least ids come back, for either id type."""
    ids = np.random.default_rng(1).permutation(400).tolist()
    c = spark.createDataFrame([(i, f"n{i:03d}", [0.5, 0.25]) for i in ids], "id long, name string, v array<float>")
    q = spark.createDataFrame([(j, [0.1 * j, 0.3]) for j in range(3)], "qid long, embedding array<float>")
    for col, want in (("id", [0, 1, 2, 3, 4]), ("name", ["n000", "n001", "n002", "n003", "n004"])):
        got = {}
        for r in knn(q, c.repartition(5), k=5, dim=2, c_id=col, c_vec="v", probe_bytes=probe_bytes).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r[col]))
        assert all([x for _, x in sorted(v)] == want for v in got.values()) and len(got) == 3


def test_condition_and_late_columns(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], {"lang": "en", "x": "1"}, "one"), (2, [0.9, 0.0], {"lang": "de"}, "two"),
                               (3, [0.0, 1.0], {"lang": "en"}, "three"), (4, [1.0, 0.0], None, "four")],
                              "id long, embedding array<float>, metadata map<string,string>, content string")
    q = spark.createDataFrame([(7, [0.9, 0.0])], "qid long, embedding array<float>")
    got = knn(q, c, k=2, dim=2, where=metadata_contains(F.col("metadata"), {"lang": "en"}), payload=["content"])
    assert [(r["id"], r["content"]) for r in got.orderBy("rank").collect()] == [(1, "one"), (3, "three")]


class _LenModel:
    """Stand-in model: a 2-d vector of (characters, words)."""

    def encode(self, texts):
        return [[float(len(t)), float(len(t.split()))] for t in texts]


def test_model_embedder_hook(spark):
    from veilspark.operators.embed import ModelEmbedder, embed
    df = spark.createDataFrame([(1, "a bc"), (2, None), (3, "one two three four")], "id int, t string")
    out = {r["id"]: r["embedding"] for r in embed(df, "t", ModelEmbedder(_LenModel, dim=2, max_length=3)).collect()}
    assert out == {1: [4.0, 2.0], 2: [0.0, 0.0], 3: [13.0, 3.0]}      # truncated to 3 words first


def test_kernel_equals_brute_force_and_holds_little():
    """Any metric, ties, blocks and a loose first limit: the kernel's k rows are the brute force's; its tiles stay small."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from veilspark.operators.search import _make_search
    rng = np.random.default_rng(5)
    for metric in ("l2", "inner"):
        q, x = rng.integers(-3, 4, (300, 4)).astype(float), rng.integers(-3, 4, (1500, 4)).astype(float)
        x[7] = np.inf
        _, best = _make_search(3, metric, 4, tile_cells=5000)
        b = best(q)
        for lo in range(0, len(x), 400):
            b.add(pa.array(np.arange(lo, min(lo + 400, len(x)))), x[lo:lo + 400])
        d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)) if metric == "l2" else -(q[:, None] * np.where(np.isinf(x), np.nan, x)[None]).sum(2)
        d[:, 7] = np.inf
        want = {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), np.round(d[i], 9)))[:3]}
        assert set(zip(b.who.tolist(), b.ids.to_pylist())) == want
    _, best = _make_search(3, "l2", 64)
    b = best(rng.normal(size=(4000, 64)))
    rows = rng.normal(size=(4096, 64))
    tracemalloc.start()
    b.add(pa.array(np.arange(4096)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20                                  # before: over 100 MB, tiles of 32 MB several times


def test_kernel_merges_within_one_key(spark):
    """A match key's rows are merged with that key's probes only, in blocks: many keys, same answers."""
    import numpy as np
    rng = np.random.default_rng(6)
    rows = [(i, f"t{i % 37}", [float(v) for v in rng.normal(size=4)]) for i in range(900)]
    c = spark.createDataFrame(rows, "id long, doc string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, f"t{i % 41}", v) for i, _, v in rows[:200]], "qid long, title string, embedding array<double>")
    got = {(r["qid"], r["rank"], r["id"]) for r in knn(q, c, dim=4, k=2, match=[("title", "doc")]).collect()}
    want = set()
    for i, _, v in rows[:200]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, t, w in rows if t == f"t{i % 41}")[:2]
        want |= {(i, n + 1, j) for n, (_, j) in enumerate(near)}
    assert got == want
