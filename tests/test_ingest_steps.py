"""The ingest path's steps: vectors against plain Python, and what a replayed save may not do."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators.chunk import chunk_documents
from veilspark.operators.embed import LATIN, HashEmbedder
from veilspark.plans.pipelines import chunk_nodes, embed_chunks, ingest_into, ingest_nodes
from veilspark.sources.collection import Collection

ODD = ["", " ", None, "a", "é1 ñ", "word-word_word", "ends", "begins", "αβγ δ 中文 7", "smile 😀 ok", "x" * 55 + " " + "y" * 56 + " " + "z" * 200,
       " ".join(f"w{i}" for i in range(300)), " " * 300 + "late", "²½ Ⅷ ªº ŉɏ", "tab\tnl\nnb sp", "ǅɐx", "� a"]


def plain_vector(text, dim=64, most=256):
    v = np.zeros(dim)
    for w in re.findall(r"[^\W_]+", " ".join(text.split(" ")[:most])):
        v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32).tolist()


def test_vectors_of_odd_texts(spark):
    texts = ODD + [t for t in ODD if t] * 70                      # more rows than one counted part
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r["i"]: r["v"] for r in rows.select("i", HashEmbedder().column(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        words = [c for c in (t or "") if unicodedata.category(c)[0] in "LN"]
        same = all(re.fullmatch(r"[^\W_]", c) for c in words)      # where Python's \w agrees with \p{L}\p{N}
        assert not same or got[i] == plain_vector(t or ""), t


def test_letters_below_latin_are_those_of_the_jvm(spark):
    codes = spark.range(LATIN).select("id", F.char(F.lit(65)).alias("a"))
    chars = spark.createDataFrame([(c, chr(c)) for c in range(LATIN)], "id long, c string")
    got = {r["id"]: r["w"] for r in codes.join(chars, "id").select("id", F.col("c").rlike(r"^[\p{L}\p{N}]$").alias("w")).collect()}
    assert got == {c: unicodedata.category(chr(c))[0] in "LN" for c in range(LATIN)}


def test_windows_count_words_at_every_blank(spark):
    from veilspark.fixed import WS_CHARS
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "é", "中", "😀", ".", "-", "​", "Â", *WS_CHARS]) for _ in range(rnd.randrange(90))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunk_documents(df, "text", max_words=9, overlap=3, min_words=2, keep_cols=["id"]).collect():
        got.setdefault(r["id"], []).append((r["chunk_no"], r["content"]))
    from tests.test_chunk import py_chunks
    for i, t in enumerate(texts):
        assert [c for _, c in sorted(got.get(i, []))] == py_chunks(t, 9, 3, 2)


DOCS = [(1, "s", "call me at a.person@example.com now. and then some more words here."), (2, "s", "one two three. four five six."),
        (3, None, None), (4, "t", "δέκα λέξεις εδώ. three more words")]


def test_known_chunks_are_not_embedded_again(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, source string, text string")
    c = Collection(spark, str(tmp_path), "again", 64).create()
    ingest_into(c, docs.where("doc_id < 3"), secret="k", salt="s")
    before = sorted((r["id"], r["content"]) for r in c.scan().collect())

    class Failing(HashEmbedder):
        def column(self, text):
            return F.raise_error(F.lit("embedded again")).cast("array<float>")

    ingest_into(c, docs.where("doc_id < 3"), secret="k", salt="s", embedder=Failing())       # a replay writes nothing
    assert sorted((r["id"], r["content"]) for r in c.scan().collect()) == before
    with pytest.raises(Exception, match="embedded again"):
        ingest_into(c, docs, secret="k", salt="s", embedder=Failing())
    ingest_into(c, docs, secret="k", salt="s", metadata={"kind": "x"})                       # known ones and new ones
    want = {r["id"]: (r["content"], r["embedding"]) for r in ingest_nodes(docs, secret="k", salt="s").collect()}
    got = c.scan().collect()
    assert {r["id"]: (r["content"], r["embedding"]) for r in got} == want and len(got) == len(want)
    assert {r["id"] // 1_000_000: r["metadata"].get("kind") for r in got} == {1: None, 2: None, 4: "x"}


def test_one_row_of_an_id_is_chosen_after_anonymizing(spark, tmp_path):
    """Equal ids inside one call: the least stored text stays, whatever the plain texts are."""
    docs = spark.createDataFrame([(1, "s", "zz two three b@example.com"), (1, "s", "yy two three"), (1, "s", "yy two three")],
                                 "doc_id long, source string, text string")
    c = Collection(spark, str(tmp_path), "one", 64).create()
    ingest_into(c, docs, secret="k", salt="s")
    (row,) = c.scan().collect()
    chunks = chunk_nodes(docs, secret="k", salt="s")
    least = min(r["content"] for r in chunks.collect())
    assert row["content"] == least
    assert row["embedding"] == embed_chunks(chunks).where(F.col("content") == least).first()["embedding"]
