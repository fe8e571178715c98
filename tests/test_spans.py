"""Span offsets, merge, overlap rule and entity resolution on hand-worked cases."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.spans import (SPANS, drop_cross_type_overlaps, merge_spans,
                                       regex_matches, resolve_entities)


def _spans(spark, rows):
    return spark.createDataFrame([(rows,)], T.StructType([T.StructField("s", SPANS)]))


def _tuples(r):
    return [(x["start"], x["end"], x["pii_type"]) for x in r]


def test_regex_offsets_are_code_points(spark):
    text = "é😀 mail a@b.io, then ü x@y.org"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(regex_matches(F.col("t"), r"[a-z]+@[a-z]+\.[a-z]+").alias("m")).first()["m"]
    for m in got:
        assert text[m["start"]:m["end"]] == m["value"]
    assert [m["value"] for m in got] == ["a@b.io", "x@y.org"]


def test_regex_no_match_and_null(spark):
    df = spark.createDataFrame([("nothing here",), (None,)], "t string")
    got = [r["m"] for r in df.select(regex_matches(F.col("t"), "[0-9]+").alias("m")).collect()]
    assert got[0] == [] and got[1] is None


def test_merge_touch_gap_and_nested(spark):
    S = lambda a, b, t="P": (a, b, t, 1.0)
    rows = [S(0, 3), S(3, 5),        # touching -> merge
            S(10, 12), S(13, 15),    # gap 1 -> merge
            S(20, 22), S(24, 26),    # gap 2 -> separate
            S(30, 40), S(32, 35)]    # nested shorter: end must stay 40 (no tail leak)
    got = _spans(spark, rows).select(merge_spans(F.col("s")).alias("m")).first()["m"]
    assert _tuples(got) == [(0, 5, "P"), (10, 15, "P"), (20, 22, "P"), (24, 26, "P"), (30, 40, "P")]


def test_merge_keeps_types_apart(spark):
    rows = [(0, 3, "A", 1.0), (4, 6, "B", 1.0), (7, 9, "A", 1.0)]
    got = _spans(spark, rows).select(merge_spans(F.col("s")).alias("m")).first()["m"]
    assert _tuples(got) == [(0, 3, "A"), (4, 6, "B"), (7, 9, "A")]


def test_cross_type_overlap_resolved_by_score_then_length(spark):
    rows = [(0, 10, "LOW", 0.4), (5, 12, "HIGH", 0.9), (11, 20, "MID", 0.6), (30, 35, "A", 0.5),
            (30, 38, "B", 0.5)]
    got = _spans(spark, rows).select(drop_cross_type_overlaps(F.col("s")).alias("m")).first()["m"]
    assert sorted(_tuples(got)) == [(5, 12, "HIGH"), (30, 38, "B")]


def _py_containment(values):
    reps, out = [], []
    for v in values:
        for r in reps:
            if v in r or r in v:
                out.append(r)
                break
        else:
            reps.append(v)
            out.append(v)
    return out


def test_containment_is_greedy_and_not_transitive(spark):
    vals = ["Bob", "Bob Lee", "Lee", "Ann"]
    df = spark.createDataFrame([(vals,)], "v array<string>")
    c = df.select(resolve_entities(F.col("v"), "CONTAINMENT").alias("r")).first()["r"]
    e = df.select(resolve_entities(F.col("v"), "EQUALITY").alias("r")).first()["r"]
    assert c == ["Bob", "Bob", "Lee", "Ann"] == _py_containment(vals)
    assert e == vals


def test_containment_matches_python_fold_on_many_lists(spark):
    import random
    rnd = random.Random(7)
    words = ["a", "ab", "b", "abc", "bc", "c", "ca"]
    lists = [[rnd.choice(words) for _ in range(rnd.randint(0, 8))] for _ in range(200)]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lists)], "i int, v array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", resolve_entities(F.col("v"), "CONTAINMENT").alias("r")).collect()}
    for i, l in enumerate(lists):
        assert got[i] == _py_containment(l)


def test_containment_matches_the_pairwise_rule():
    import random

    from veilspark.functions.entities import resolve_containment

    def pairwise(values):
        reps, out = [], []
        for v in values:
            if not v:
                out.append(v)
                continue
            r = next((x for x in reps if x in v or v in x), None)
            if r is None:
                reps.append(v)
            out.append(v if r is None else r)
        return out

    rng = random.Random(1)
    for _ in range(400):
        values = ["".join(rng.choices("ab é"[:rng.randint(2, 4)], k=rng.randint(0, 7))) for _ in range(rng.randint(0, 40))]
        values += [None] * rng.randint(0, 1)
        assert resolve_containment(values) == pairwise(values)


def test_containment_of_thousands_stays_linear():
    """2,000 and 8,000 entities of one row: four times as many take about four times as long."""
    import time

    from veilspark.functions.entities import resolve_containment

    def seconds(n):
        values = [f"person number {i * 7919 % 1_000_003} of somewhere{i % 97}" for i in range(n)]
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            assert len(set(resolve_containment(values))) > n * 0.9
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(8000) < 12 * seconds(2000)


def test_label_mode_keeps_nothing_of_the_value(spark):
    from veilspark.operators.anonymize import anonymize, deanonymize
    df = spark.createDataFrame([("write a@b.io or c@d.org", "kept"), (None, "x")], "t string, _spans string")
    got = anonymize(df, "t", "s", mode="label").collect()
    assert [r["t"] for r in got] == ["write αEMAIL_ADDRESSα or αEMAIL_ADDRESSα", None] and got[0]["_spans"] == "kept"
    both = anonymize(df, "t", "s", mode="aes", resolution="CONTAINMENT")
    assert both.columns == df.columns and deanonymize(both, "t", "s").first()["t"] == "write a@b.io or c@d.org"


def test_made_texts_are_dealt_over_the_cores(spark):
    """Customers lie in one split; the detectors' rows must not, with the same rows in the end."""
    import os
    import tempfile

    import __spark_entry__ as E
    d = tempfile.mkdtemp(prefix="vs-cust-", dir="/tmp")
    cust = [(i, f"Customer#{i:09d}", i % 3) for i in range(1, 401)] + [(None, "Customer#x", None)]
    spark.createDataFrame(cust, "c_custkey long, c_name string, c_nationkey long").coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(i, f"NAT{i}") for i in range(3)], "n_nationkey long, n_name string").write.parquet(f"{d}/nation.parquet")
    before = spark.conf.get("spark.veilspark.balanceScans")
    spark.conf.set("spark.veilspark.balanceScans", "false")
    try:
        for name, n in (("pii_number_edges", 800), ("pii_value_edges", 1200), ("pii_threshold", 800)):
            df = E.queries()[name](spark, d)
            per_task = [len(p) for p in df.select("c_custkey").rdd.glom().collect()]
            assert sum(1 for p in per_task if p) >= 4 and max(per_task) < sum(per_task) / 2, (name, per_task)
            assert sum(per_task) >= n
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "size(" not in plan, name                 # no inferred filter that runs the detectors again
    finally:
        spark.conf.set("spark.veilspark.balanceScans", before)
