"""Text modifiers and their application to nested columns.

A modifier is a ``Column -> Column`` function on strings.  ``apply_modifier``
walks a column's schema and rebuilds it with higher-order functions:

* string → modified; map → values modified, keys kept;
* node struct (``content`` + ``metadata``) → both; a *list* of nodes → content only;
* message struct (``role`` + ``content``) in a list → content (NULL → "");
  ``name``/``function`` untouched;
* choice struct (``message``) in a list → ``message.content``;
* other arrays → element-wise; other structs → every field; other types pass.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.fixed import PURGED_TEXT, STOP_WORDS
from veilspark.operators.chunk import blank_words
from veilspark.session import shared_path

Modifier = Callable[[Column], Column]


def _fields(st: T.StructType) -> dict:
    return {f.name: f.dataType for f in st.fields}


def _is_node(st) -> bool:
    f = _fields(st)
    return isinstance(f.get("content"), T.StringType) and isinstance(f.get("metadata"), T.MapType)


def _is_message(st) -> bool:
    f = _fields(st)
    return "role" in f and isinstance(f.get("content"), T.StringType)


def _is_choice(st) -> bool:
    f = _fields(st)
    return isinstance(f.get("message"), T.StructType) and _is_message(f["message"])


def modify(c: Column, dt: T.DataType, fn: Modifier) -> Column:
    """Rebuild ``c`` (of type ``dt``) with ``fn`` applied to its text leaves."""
    if isinstance(dt, T.StringType):
        return fn(c)
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: modify(v, dt.valueType, fn))
    if isinstance(dt, T.ArrayType):
        el = dt.elementType
        if isinstance(el, T.StructType) and _is_node(el):
            return F.transform(c, lambda x: x.withField("content", fn(x["content"])))
        if isinstance(el, T.StructType) and _is_message(el):
            return F.transform(c, lambda x: x.withField("content", fn(F.coalesce(x["content"], F.lit("")))))
        if isinstance(el, T.StructType) and _is_choice(el):
            return F.transform(c, lambda x: x.withField(
                "message", x["message"].withField("content", fn(x["message"]["content"]))))
        return F.transform(c, lambda x: modify(x, el, fn))
    if isinstance(dt, T.StructType):
        if _is_node(dt):
            fields = {"content": fn(c["content"]), "metadata": modify(c["metadata"], _fields(dt)["metadata"], fn)}
        else:
            fields = {f.name: modify(c[f.name], f.dataType, fn) for f in dt.fields
                      if _touches_text(f.dataType)}
        out = c
        for name, val in fields.items():
            out = out.withField(name, val)
        return F.when(c.isNull(), c).otherwise(out)
    return c


def _touches_text(dt) -> bool:
    if isinstance(dt, T.StringType):
        return True
    if isinstance(dt, T.MapType):
        return _touches_text(dt.valueType)
    if isinstance(dt, T.ArrayType):
        return _touches_text(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_touches_text(f.dataType) for f in dt.fields)
    return False


def apply_modifier(df: DataFrame, cols, fn: Modifier) -> DataFrame:
    """Apply ``fn`` to every text leaf of the given (possibly nested) columns."""
    for c in ([cols] if isinstance(cols, str) else cols):
        df = df.withColumn(c, modify(F.col(c), df.schema[c].dataType, fn))
    return df


def chain(*fns: Modifier) -> Modifier:
    """Ordered composition (each modifier sees the previous one's output)."""
    return lambda c: reduce(lambda acc, f: f(acc), fns, c)


LOWER_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TO = "abcdefghijklmnopqrstuvwxyz"


# --- T3 stop words -----------------------------------------------------------
def default_stop_words() -> list[str]:
    """The English stop-word list (the one Spark's ``StopWordsRemover`` bundles)."""
    return list(STOP_WORDS)


def remove_stop_words(stop_words=None) -> Modifier:
    """Keep words whose lower case is not a stop word, strip non-ASCII, join by one blank."""
    ascii_lower = str.maketrans(LOWER_FROM, LOWER_TO)          # the same rule for texts and list
    words = sorted({w.translate(ascii_lower) for w in (stop_words if stop_words is not None else default_stop_words())})

    def fn(c: Column) -> Column:
        toks = blank_words(c)
        kept = F.filter(toks, lambda w: ~F.translate(w, LOWER_FROM, LOWER_TO).isin(words))
        return F.array_join(F.transform(kept, lambda w: F.regexp_replace(w, r"[^\x00-\x7F]", "")), " ")
    return fn


# --- T4-T6 toxicity ------------------------------------------------------------
TOX_WORD_RX = "[a-z]+"
LEXICON_BYTES = 32 << 20


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, LOWER_FROM, LOWER_TO), F.lit(TOX_WORD_RX), F.lit(0))


def learn_toxic_lexicon(docs: DataFrame, labels: DataFrame, *, min_docs: int = 5,
                        key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words found in at least ``min_docs`` toxic documents and in no clean one.

    One distributed aggregation: distinct (doc, word) pairs are counted per
    word with partial aggregation, so frequent words never concentrate rows.
    """
    lab = labels.select(key_col, "toxic")
    w = docs.select(key_col, text_col).join(lab, key_col) \
        .select("toxic", F.explode(F.array_distinct(ascii_words(F.col(text_col)))).alias("word"))
    g = w.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic_docs"),
                              F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("clean_docs"))
    return g.where((F.col("toxic_docs") >= min_docs) & (F.col("clean_docs") == 0)).select("word")


def toxic_hits(text: Column, lexicon_words: list[str]) -> Column:
    """Number of word occurrences that are in a given list (for :func:`purge_toxic`)."""
    return F.coalesce(F.size(F.filter(ascii_words(text), lambda w: w.isin(list(lexicon_words)))), F.lit(0))


def toxic_hit_counts(df: DataFrame, text_col: str, lexicon: DataFrame, out_col: str = "toxic_hits",
                     max_bytes: int = LEXICON_BYTES) -> DataFrame:
    """Add the number of lexicon-word occurrences per row (0 for a NULL text), for any lexicon size.

    The lexicon is written once and measured.  Up to ``max_bytes`` it is
    broadcast and the count is a column: no shuffle.  A larger one is joined
    with (text digest, word) rows; texts themselves are never shuffled, and the
    counts come back to the rows by digest (equal texts share one).
    """
    spark = df.sparkSession
    path = shared_path(spark, f"lexicon/{uuid.uuid4().hex}")
    lexicon.select("word").where("word is not null").distinct().write.parquet(path)
    lex = spark.read.schema("word string").parquet(path)
    if (lex.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) <= max_bytes:
        words = frozenset(w.encode() for w in lex.toArrow().column("word").to_pylist())
        sent = spark.sparkContext.broadcast(words)
        lower, rx = bytes.maketrans(LOWER_FROM.encode(), LOWER_TO.encode()), re.compile(TOX_WORD_RX.encode())

        def hits(texts: pa.Array) -> pa.Array:
            known = sent.value.__contains__
            return pa.array([sum(map(known, rx.findall(t.translate(lower)))) if t else 0
                             for t in texts.cast(pa.large_binary()).to_pylist()], pa.int32())

        # Never evaluated twice, whatever is filtered on the count.
        return df.withColumn(out_col, F.arrow_udf(hits, T.IntegerType()).asNondeterministic()(F.col(text_col)))
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = df.select(key.alias("_t"), F.explode(ascii_words(F.col(text_col))).alias("word")).join(lex, "word") \
        .groupBy("_t").agg(F.count("*").alias("_all"))
    copies = df.groupBy(key.alias("_t")).agg(F.count("*").alias("_copies"))
    counts = found.join(copies, "_t").select("_t", F.expr("cast(_all div _copies as int)").alias("_n"))
    return df.withColumn("_t", key).join(counts, "_t", "left") \
        .withColumn(out_col, F.coalesce("_n", F.lit(0))).drop("_t", "_n")


def toxicity_weights(docs: DataFrame, labels: DataFrame, *, key_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "toxic") -> DataFrame:
    """T4 (count form): (word, weight), log-odds of a word's presence in toxic against clean texts.

    Counts over all labelled rows by one grouped aggregation; weights are whole
    millionths, so sums do not depend on their order.  The prior is the weight
    of the empty word.
    """
    lab = labels.where(F.col(label_col).isin(0, 1)).select(key_col, F.col(label_col).alias("_y"))
    rows = docs.select(key_col, text_col).join(lab, key_col).select(
        "_y", F.explode(F.array_append(F.array_distinct(F.coalesce(ascii_words(F.col(text_col)), F.array().cast("array<string>"))),
                                       F.lit(""))).alias("word"))
    n = rows.groupBy("word").agg(F.sum("_y").alias("t"), F.sum(1 - F.col("_y")).alias("c"))
    total = n.where("word = ''").select(F.col("t").alias("nt"), F.col("c").alias("nc"))
    ratio = F.when(F.col("word") == "", (F.col("t") + 0.5) / (F.col("c") + 0.5)).otherwise(
        ((F.col("t") + 0.5) / (F.col("nt") + 1.0)) / ((F.col("c") + 0.5) / (F.col("nc") + 1.0)))
    one = total.first()                                  # one row, or none
    nt, nc = (one["nt"], one["nc"]) if one else (0, 0)
    return n.withColumns({"nt": F.lit(nt), "nc": F.lit(nc)}).select(
        "word", F.round(F.log(ratio) * 1e6).cast("long").alias("weight"))


def toxicity_by_words(docs: DataFrame, weights: DataFrame, *, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, score, is_toxic): the weights of a text's different words added up; unknown words weigh nothing.

    ``key_col`` is unique.  Only (key, word) rows are shuffled, with partial sums.
    """
    rows = docs.select(key_col, F.explode(F.array_append(F.array_distinct(F.coalesce(
        ascii_words(F.col(text_col)), F.array().cast("array<string>"))), F.lit(""))).alias("word"))
    return rows.join(weights, "word").groupBy(key_col).agg(F.sum("weight").alias("score")) \
        .select(key_col, "score", (F.col("score") > 0).alias("is_toxic"))


def toxicity_score(hits: Column) -> Column:
    """T4 score in [0, 1): ``1 - exp(-hits)``; toxic when above the threshold (default 0.5)."""
    return F.lit(1.0) - F.exp(-hits.cast("double"))


def purge_toxic(threshold: float, lexicon: list[str]) -> Modifier:
    """T5: replace the whole text by a fixed sentence when its score exceeds ``threshold``."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    return lambda c: F.when(toxicity_score(toxic_hits(c, lexicon)) > F.lit(threshold),
                            F.lit(PURGED_TEXT)).otherwise(c)


def toxicity_classifier(labeled: DataFrame, *, text_col: str = "text", label_col: str = "toxic",
                        num_features: int = 1 << 16, max_iter: int = 20, reg: float = 0.01):
    """T4 (model form): bag-of-words linear SVM trained on labelled texts.

    Regex tokenizer → hashing TF → ``LinearSVC`` (distributed gradient
    aggregation).  The hashed training features are computed once and
    persisted for the iterations, then released; the returned
    ``PipelineModel`` scores any DataFrame with a ``text_col`` column.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tox_words", pattern="[^a-zA-Z]+", toLowercase=True)
    tf = HashingTF(inputCol="_tox_words", outputCol="_tox_tf", numFeatures=num_features)
    feats = tf.transform(tok.transform(labeled)).select(
        F.col(label_col).cast("double").alias("_tox_label"), "_tox_tf").persist()
    try:
        svm = LinearSVC(featuresCol="_tox_tf", labelCol="_tox_label", maxIter=max_iter,
                        regParam=reg).fit(feats)
    finally:
        feats.unpersist()
    return PipelineModel(stages=[tok, tf, svm])
