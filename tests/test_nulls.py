"""NULL and empty text pass through every text operator without failing."""

from pyspark.sql import functions as F

from veilspark.operators.anonymize import anonymize, deanonymize
from veilspark.operators.chunk import chunk_documents
from veilspark.operators.detect import detect_pii
from veilspark.operators.embed import HashEmbedder, embed
from veilspark.operators.modifiers import apply_modifier, purge_toxic, remove_stop_words


def _df(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "mail a@ex.com. more words here.")],
                                 "id int, text string")


def test_null_and_empty_text(spark):
    df = _df(spark)
    assert detect_pii(df, "text").count() == 3
    a = anonymize(df, "text", "k")
    back = {r["id"]: r["text"] for r in deanonymize(a, "text", "k").collect()}
    assert back == {1: None, 2: "", 3: "mail a@ex.com. more words here."}
    ch = chunk_documents(df, "text", max_words=10, overlap=2, keep_cols=["id"]).collect()
    assert {r["id"] for r in ch} == {3}
    e = {r["id"]: r["embedding"] for r in embed(df, "text", HashEmbedder(8, 16)).collect()}
    assert e[1] == [0.0] * 8 and e[2] == [0.0] * 8 and abs(sum(x * x for x in e[3]) - 1) < 1e-5
    sw = {r["id"]: r["text"] for r in apply_modifier(df, "text", remove_stop_words()).collect()}
    assert sw[1] is None and sw[2] == ""
    pt = {r["id"]: r["text"] for r in apply_modifier(df, "text", purge_toxic(0.5, ["idiot"])).collect()}
    assert pt[1] is None and pt[2] == ""


def test_empty_dataframe(spark):
    df = _df(spark).where(F.lit(False))
    assert anonymize(df, "text", "k").count() == 0
    assert chunk_documents(df, "text", keep_cols=["id"]).count() == 0
