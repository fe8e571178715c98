"""Collection lifecycle and the semantic cache (hit / cutoff / expiry)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators.cache import cache_lookup, cache_store, expired
from veilspark.operators.embed import HashEmbedder
from veilspark.sources.collection import Collection, sanitize_name

KEY = "k"


def _coll(spark, dim=4, name="nodes"):
    return Collection(spark, tempfile.mkdtemp(prefix="vs-coll-", dir="/tmp"), name, dim).create()


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "id long, content string, embedding array<float>")


def test_lifecycle(spark):
    assert sanitize_name("prompt_cache") == "promptcache"
    c = _coll(spark)
    c.create()  # idempotent
    assert c.scan().count() == 0
    c.save_nodes(_nodes(spark, [(1, "a", [1.0, 0.0, 0.0, 0.0]), (2, "a", [0.0, 1.0, 0.0, 0.0]), (3, "b", [0.0, 0.0, 1.0, 0.0])]))
    c.save_nodes(_nodes(spark, [(4, "c", [0.0, 0.0, 0.0, 1.0])]))
    c.save_nodes(_nodes(spark, [(4, "c", [0.0, 0.0, 0.0, 1.0])]))             # replay: by id, nothing new
    assert c.scan().count() == 4
    c.delete_by_content(spark.createDataFrame([("a",)], "content string"))
    assert sorted(r["id"] for r in c.scan().collect()) == [3, 4]
    c.save_nodes(_nodes(spark, [(1, "a", [1.0, 0.0, 0.0, 0.0]), (4, "c", [0.0, 0.0, 0.0, 1.0])]))   # replay after delete
    assert sorted(r["id"] for r in c.scan().collect()) == [3, 4]
    c.drop()
    with pytest.raises(RuntimeError):
        c.scan()


def test_dimension_is_enforced(spark):
    c = _coll(spark)
    with pytest.raises(Exception):
        c.save_nodes(_nodes(spark, [(1, "a", [1.0, 0.0])]))


def test_expired_rules(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-07 12:00:00",), (None,)], "t string") \
        .select(F.to_timestamp("t").alias("t"))
    as_of = F.to_timestamp(F.lit("2024-01-08 06:00:00"))
    got = [r["e"] for r in df.select(expired(F.col("t"), 86400, as_of).alias("e")).collect()]
    assert got == [True, False, False]


def test_cache_hit_miss_expired(spark):
    emb = HashEmbedder(64, 256)
    coll = _coll(spark, dim=64, name="prompt_cache")
    recs = spark.createDataFrame([
        (1, "what is the capital of france", '{"a":"paris","mail":"jo@ex.com"}', "2024-01-07 00:00:00"),
        (2, "how tall is the tower", '{"a":"330m"}', "2023-01-01 00:00:00"),
        (3, "x" * 300, '{"a":"too long"}', "2024-01-07 00:00:00")],
        "id long, prompt string, record_json string, created string") \
        .withColumn("created_at", F.to_timestamp_ntz("created"))
    cache_store(recs, coll, secret=KEY, embedder=emb, created_col="created_at")
    assert coll.scan().count() == 2            # the long prompt is not admitted
    stored = {r["id"]: r["metadata"]["cache"] for r in coll.scan().collect()}
    assert "jo@ex.com" not in stored[1] and "α" in stored[1]       # PII tokenized at rest
    probes = spark.createDataFrame([(10, "what is the capital of france"), (11, "how tall is the tower"),
                                    (12, "completely different words entirely")], "pid long, prompt string")
    out = {r["pid"]: r for r in cache_lookup(probes, coll.scan(), secret=KEY, embedder=emb,
                                             as_of=F.to_timestamp_ntz(F.lit("2024-01-08 00:00:00"))).collect()}
    assert out[10]["status"] == "hit" and out[10]["record_json"] == '{"a":"paris","mail":"jo@ex.com"}'
    assert out[11]["status"] == "expired" and out[11]["record_json"] is None
    assert out[12]["status"] == "miss"


def test_second_handle_sees_writes(spark):
    root = tempfile.mkdtemp(prefix="vs-coll-", dir="/tmp")
    a = Collection(spark, root, "shared", 4).create()
    a.save_nodes(_nodes(spark, [(1, "a", [1.0, 0.0, 0.0, 0.0]), (2, "b", [0.0, 1.0, 0.0, 0.0])]))
    a.delete_by_content(spark.createDataFrame([("a",)], "content string"))
    b = Collection(spark, root, "shared", 4)          # a fresh reader sees the delete
    assert [r["id"] for r in b.scan().collect()] == [2]
    a.drop()
    with pytest.raises(RuntimeError):
        Collection(spark, root, "shared", 4).scan()


def _vec(n):
    return [float(n % 7), 1.0, 0.0, 0.0]


def test_equal_ids_in_one_call_are_one_node(spark):
    c = _coll(spark)
    c.save_nodes(_nodes(spark, [(1, "b", _vec(1)), (1, "a", _vec(2)), (2, "x", _vec(3)), (2, "x", _vec(3))]).repartition(4))
    assert sorted((r["id"], r["content"]) for r in c.scan().collect()) == [(1, "a"), (2, "x")]


def test_a_save_reads_only_the_ranges_of_its_ids(spark):
    """Batches of growing ids: the files read for the known ids stay as few as the table grows."""
    c = Collection(spark, tempfile.mkdtemp(prefix="vs-coll-", dir="/tmp"), "grow", 4, span_bits=8).create()
    read = []
    for batch in range(6):
        rows = [(batch * 256 + i, f"c{batch}-{i}", _vec(i)) for i in range(40)]
        parts = sorted({r["p"] for r in _nodes(spark, rows).select(c._part(F.col("id")).alias("p")).collect()})
        read.append(c._known(parts).select(F.input_file_name().alias("f")).distinct().count())
        c.save_nodes(_nodes(spark, rows))
        c.save_nodes(_nodes(spark, rows))                    # a replay adds nothing
    assert read == [0] * 6 and c.scan().count() == 240
    files = c._known([2]).select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < files <= 8


def test_two_writers_and_compaction(spark):
    c = _coll(spark)
    c.save_nodes(_nodes(spark, [(1, "a", _vec(1)), (2, "b", _vec(2)), (3, "c", _vec(3))]))
    c._write(c.scan().where("id = 2"))                       # as a second writer that did not see the first
    assert c.scan().count() == 4 and c.scan(distinct=True).count() == 3
    c.delete_by_content(spark.createDataFrame([("a",)], "content string"))
    d = c.compact("second")
    assert sorted(r["id"] for r in d.scan().collect()) == [2, 3]
    d.save_nodes(_nodes(spark, [(1, "a", _vec(1)), (4, "d", _vec(4)), (-5, "e", _vec(5))]))
    assert sorted(r["id"] for r in d.scan().collect()) == [-5, 2, 3, 4]
    assert sorted(d.scan().columns) == sorted(c.scan().columns)
