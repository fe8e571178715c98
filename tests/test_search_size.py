"""What a search moves, and that single precision decides nothing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators import search as S


def rows(spark, vectors, key="t"):
    return spark.createDataFrame([(i, [float(x) for x in v], key) for i, v in enumerate(vectors)], "id long, embedding array<double>, t string")


def test_a_probe_is_copied_once_for_many_collection_rows(spark):
    rng = np.random.default_rng(3)
    c = rows(spark, rng.random((32, 4))).select("id", F.col("embedding").alias("vec"), F.col("t").alias("mkey"))
    p = rows(spark, rng.random((4, 4))).select(F.col("id").alias("qid"), F.col("embedding").alias("vec"), F.col("t").alias("mkey"))
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])
    assert S._by_groups(p, c, "id", 1, "l2", 4, schema, 4).count() == 4       # one part of 32 rows; eight of four before


@pytest.mark.parametrize("probe_bytes", [S.PROBE_BYTES, 64])
def test_only_winners_rows_are_joined(spark, probe_bytes):
    rng = np.random.default_rng(4)
    c, q = rows(spark, rng.random((40, 4))), rows(spark, rng.random((5, 4)))
    got = S.knn(q, c, dim=4, k=2, q_id="id", match=[("t", "t")], payload=["t", "embedding"], probe_bytes=probe_bytes)
    found = {(r["qid"], r["rank"]): (r["id"], r["embedding"]) for r in got.collect()}
    a, b = (np.array([r["embedding"] for r in d.orderBy("id").collect()]) for d in (q, c))
    near = np.argsort(np.linalg.norm(a[:, None] - b[None], axis=2), axis=1, kind="stable")
    assert found == {(i, j + 1): (int(near[i, j]), b[near[i, j]].tolist()) for i in range(5) for j in range(2)}
    if probe_bytes == S.PROBE_BYTES:
        assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("metric", ["l2", "inner"])
@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e14, 1e100])
def test_single_precision_decides_nothing(metric, scale):
    rng = np.random.default_rng(5)
    base = rng.random((7, 8)) * scale
    x = np.repeat(base, 300, axis=0) * (1 + rng.integers(-40, 40, (2100, 1)) * 1e-9)     # equal in single precision
    x[17], x[1800, 3] = np.nan, np.inf
    q = base[:5] * 1.01
    matrix, best = S._make_search(3, metric, 8, digits=300 if scale < 1 else 9)
    b = best(q)
    for lo in range(0, len(x), 1500):
        b.add(pa.array(np.arange(lo, min(lo + 1500, len(x)))), x[lo:lo + 1500])
    ok = np.isfinite(x).all(1)
    with np.errstate(invalid="ignore"):
        d = np.array([[np.sqrt(((v - u) ** 2).sum()) if metric == "l2" else -(v * u).sum() for v in x] for u in q])
    d[:, ~ok] = np.inf
    got = sorted(zip(b.who.tolist(), b.ids.to_pylist()))
    places = 300 if scale < 1 else 9
    assert got == sorted((i, int(j)) for i in range(5) for j in np.lexsort((np.arange(len(x)), np.round(d[i], places)))[:3])
