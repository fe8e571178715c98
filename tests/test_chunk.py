"""The chunk window against a plain-Python fold of the window rule."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators.chunk import chunk_documents, merge_metadata


def py_chunks(text, M, O, mn):
    out, cur, total = [], [], 0
    for piece in text.split("."):
        n = len(piece.split())
        cur.append((piece, n))
        total += n
        if n < mn:
            continue
        while total > min(M, O + n) and len(cur) > 1:
            total -= cur.pop(0)[1]
        out.append(". ".join(p for p, _ in cur))
    return out


EDGE = ["", "a.", "...", "a b. c d. e f", "one two three four five six seven eight nine ten eleven. x y z",
        "a b c d e f g h i j k l m n o p q r s t u v w x y z. tail words here.", ". . a b c. . d e f. "]


@pytest.mark.parametrize("M,O", [(256, 10), (40, 10), (5, 2), (3, 0)])
def test_edge_texts(spark, M, O):
    df = spark.createDataFrame(list(enumerate(EDGE)), "id int, text string")
    got = {}
    for r in chunk_documents(df, "text", max_words=M, overlap=O, min_words=3, keep_cols=["id"]).collect():
        got.setdefault(r["id"], []).append((r["chunk_no"], r["content"]))
    for i, t in enumerate(EDGE):
        assert [c for _, c in sorted(got.get(i, []))] == py_chunks(t, M, O, 3)


@pytest.mark.parametrize("M,O", [(256, 10), (40, 10)])
def test_corpus_documents(spark, sf_small, M, O):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunk_documents(docs, "text", max_words=M, overlap=O, keep_cols=["doc_id"]).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["content"]))
    for r in docs.collect():
        assert [c for _, c in sorted(got.get(r["doc_id"], []))] == py_chunks(r["text"], M, O, 3)


def test_metadata_merge_document_wins(spark):
    df = spark.createDataFrame([({"chunk": "1", "a": "x"}, {"a": "doc", "doc": "d"})],
                               "c map<string,string>, d map<string,string>")
    got = df.select(merge_metadata(F.col("c"), F.col("d")).alias("m")).first()["m"]
    assert got == {"chunk": "1", "a": "doc", "doc": "d"}


def test_sentence_splitter_keeps_abbreviations(spark):
    from veilspark.operators.chunk import split_sentences
    df = spark.createDataFrame([("Dr. Smith met Mr. Lee at 5 p.m. today! Was it late? Yes.  Done",)], "t string")
    got = df.select(split_sentences(F.col("t")).alias("s")).first()["s"]
    assert got == ["Dr. Smith met Mr. Lee at 5 p.m.", "today!", "Was it late?", "Yes.", "Done"]
