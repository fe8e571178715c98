"""Sources (page text, resource load) and stream helpers."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from veilspark.sources.documents import demo_documents, html_to_text, load_resources, to_documents
from veilspark.streaming.streams import purge_idle_sessions


def test_html_to_text(spark):
    html = ('<html><head><style>p{x:1}</style><script>var a="<p>";</script></head><body>'
            '<!-- ad --><h1>T&amp;C</h1><p>a &lt;b&gt;\n\n  c&nbsp;d &quot;e&quot; &#39;f&#39;</p></body></html>')
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text(F.col("h")).alias("t")).first()["t"] == "T&C a <b> c d \"e\" 'f'"


def test_resource_names(spark):
    docs = to_documents(spark.createDataFrame([("r1", "x"), ("r2", "y")], "resource string, text string"),
                        resource=F.col("resource"))
    req = spark.createDataFrame([("r1", "Name"), ("r2", None)], "resource string, name string")
    got = {r["resource"]: r["metadata"]["doc"] for r in load_resources(docs, req, "resource", "name").collect()}
    assert got == {"r1": "Name", "r2": "r2"}
    assert [r["metadata"]["doc"] for r in demo_documents(spark).orderBy("resource").collect()] == \
        ["resource1", "resource2", "resource3"]


def test_purge_idle_sessions(spark):
    m = spark.createDataFrame([("s1", "a", "t", "2024-01-01 00:00:00"), ("s1", "b", "t", "2024-01-09 00:00:00"),
                               ("s2", "c", "t", "2024-01-01 00:00:00")],
                              "session_id string, alias string, token string, ts string") \
        .withColumn("last_used", F.to_timestamp("ts"))
    left = purge_idle_sessions(m, ttl_seconds=3 * 86400, as_of=F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    assert sorted(r["alias"] for r in left.collect()) == ["a", "b"]     # s1 still live, s2 idle


def test_stream_ingest_equals_batch(spark, sf_small):
    s = E.queries()["stream_ingest"](spark, sf_small)
    b = E.queries()["ingest"](spark, sf_small).select("id", "doc", "content")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_load_documents_from_json_and_text(spark):
    import tempfile
    from veilspark.sources.documents import load_documents
    d = tempfile.mkdtemp(prefix="vs-src-", dir="/tmp")
    spark.createDataFrame([("a", "x y", "A"), ("b", "z", None)], "resource string, text string, name string") \
        .write.mode("overwrite").json(f"{d}/json")
    j = load_documents(spark, f"{d}/json", "json", name_col="name")
    assert {r["resource"]: r["metadata"]["doc"] for r in j.collect()} == {"a": "A", "b": "b"}
    spark.createDataFrame([("line one",), ("line two",)], "value string").write.mode("overwrite").text(f"{d}/txt")
    t = load_documents(spark, f"{d}/txt", "text", text_col="value", resource_col="value")
    assert sorted(r["text"] for r in t.collect()) == ["line one", "line two"]


def test_character_references_are_read_once(spark):
    import html

    from veilspark.sources.documents import decode_references
    cases = ["&#8217;&#x2019;&#X1f600;", "&#38;lt; &#38;#65; &amp;amp;", "&#0;&#xD800;&#1114112;&#9999999;&#xFFFFFF;", "&lt;&gt;&quot;&#39;&amp;",
             "&#12; &#x; &#; & &unknown; &#123456789;", "", None, "no reference"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["t"] for r in df.select("i", decode_references(F.col("t")).alias("t")).collect()}
    assert got[0] == "’’😀" and got[1] == "&lt; &#65; &amp;" and got[2] == "�" * 5 and got[3] == html.unescape(cases[3])
    assert got[4] == "\x0c &#x; &#; & &unknown; &#123456789;" and got[5] == "" and got[6] is None and got[7] == cases[7]


def test_text_files_and_single_resources(spark, tmp_path):
    from veilspark.sources.documents import load_resource, load_text
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    rows = {r["resource"]: r["text"] for r in load_text(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == "one\ntwo" and rows.get("b.txt", "") == ""
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "concat('t', id) as text").write.parquet(path)
    one = load_resource(spark.read.parquet(path), 7, key_col="id")
    assert [tuple(r)[:2] for r in one.collect()] == [("7", "t7")]
    plan = one._jdf.queryExecution().toString()
    assert "EqualTo(id,7)" in plan


def test_ids_of_large_keys_and_many_chunks(spark):
    from veilspark.plans.pipelines import compose_id
    rows = [(5, 3), (5, 1_000_000), (2 ** 62, 1), (-2 ** 62, 1), (2 ** 62, 2), (-4, 7), (9_223_372_036_853, 999_999)]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", compose_id(F.col("k"), F.col("n")).alias("id"))
    got = {(r["k"], r["n"]): r["id"] for r in df.collect()}
    assert got[5, 3] == 5_000_003 and got[-4, 7] == -3_999_993 and len(set(got.values())) == len(rows)
    assert got[5, 1_000_000] < 0 and got[2 ** 62, 1] < 0


def test_table_stream_reads_files_and_folders(spark):
    """A table is one file or a folder of files; a stream gives all its rows either way."""
    import glob
    import os
    import shutil
    import tempfile
    d = tempfile.mkdtemp(prefix="vs-table-", dir="/tmp")
    rows = [(i, f"s{i % 3}", f"mail a{i}@b{i}.example.org now") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.repartition(4).write.parquet(f"{d}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{d}/one")
    os.mkdir(f"{d}/file")
    shutil.copy(glob.glob(f"{d}/one/*.parquet")[0], f"{d}/file/documents.parquet")
    for form in ("folder", "file"):
        back = E.queries()["stream_deanonymize"](spark, f"{d}/{form}").collect()
        assert sorted((r["doc_id"], r["text"], r["malformed"]) for r in back) == [(i, t, False) for i, _, t in rows]
        assert E.queries()["stream_alias_map"](spark, f"{d}/{form}").count() == 40
