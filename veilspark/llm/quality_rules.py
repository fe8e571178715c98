"""Quality rules with adaptive thresholds.

Per document a few shape metrics are measured.  Per (language, source) a
mergeable quantile sketch (KLL) of every metric is built by partial
aggregation over all documents with words, merged upward per language and over
all rows, and read off as fences that follow the group's own tails:
``hi = q75 + margin * max(q90 - q50, grain)`` and
``lo = q25 - margin * max(q50 - q10, grain)``.  The grain only keeps a fence
open where nine documents of ten have one and the same value (no symbols, no
repeated lines); the quantiles lie where junk, being rarer than one in ten,
does not move them.  A group of fewer than ``min_group`` documents uses the
fences of its language, and a sparse language those of the whole corpus.  The fences replace fixed cutoffs and are joined back to the
documents for the verdict.

Edge cases: NULL or empty text has no words, so it fails the base rule; NULL
language or source is a group of its own; repeated rows count and are judged
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ASCII_WS, materialize

SYMBOLS = "#*$%&|<>"
#: Rules: metric -> (side that is bad, margin in tail widths, least tail width).
RULES = {"mean_chars": ("both", 2.0, 0.1), "symbol_rate": ("high", 2.0, 0.015),
         "dup_rate": ("high", 2.0, 0.05), "repeat_rate": ("high", 4.0, 0.01)}
MIN_GROUP = 50
KLL_K = 400

METRICS = "doc_id {id}, lang string, source string, n_words long, word_chars long, " \
          "n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-windows, lines)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0
    chars = len(text) - sum(map(text.count, ASCII_WS))
    lines = [x for x in text.split("\n") if x.strip(ASCII_WS)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        first: dict = {}
        marked = bytearray(n)
        for i, g in enumerate(grams):
            j = first.setdefault(g, i)
            if j != i:
                marked[j:j + 3] = b"\1\1\1"
                marked[i:i + 3] = b"\1\1\1"
        repeated = sum(marked)
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measure(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """One row of metrics per document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for b in batches:
            got = [measure_text(t) for t in b.column(3).to_pylist()]
            cols = list(zip(*got)) if got else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in cols)],
                names=["doc_id", "lang", "source", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, METRICS.format(id=id_type))


def rates(m: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return m.withColumns({
        "mean_chars": F.col("word_chars") / n, "symbol_rate": F.col("n_symbols") / n,
        "dup_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / n})


def fences(m: DataFrame, kll_k: int = KLL_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fences per (lang, source), per lang and overall, from merged sketches."""
    sketches = m.groupBy("lang", "source").agg(
        F.count("*").alias("n"),
        *[F.kll_sketch_agg_double(F.col(r), F.lit(kll_k)).alias(r) for r in RULES])
    sketches = materialize(sketches, "rule-sketches")

    def merged(*keys):
        aggs = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(r)).alias(r) for r in RULES]]
        return sketches.groupBy(*keys).agg(*aggs) if keys else sketches.agg(*aggs)

    def read(df, keys, tag):
        out = [*keys, F.col("n").alias(f"n_{tag}")]
        for r, (_, margin, grain) in RULES.items():
            q10, q25, q50, q75, q90 = (F.kll_sketch_get_quantile_double(F.col(r), F.lit(q)) for q in (0.1, 0.25, 0.5, 0.75, 0.9))
            out.append(F.struct((q25 - margin * F.greatest(q50 - q10, F.lit(grain))).alias("lo"),
                                (q75 + margin * F.greatest(q90 - q50, F.lit(grain))).alias("hi")).alias(f"{r}_{tag}"))
        return df.select(*out)

    return (read(sketches, ["lang", "source"], "g"), read(merged("lang"), ["lang"], "l"),
            read(merged().filter("n is not null"), [], "a"))


def judge(docs: DataFrame, *, min_group: int = MIN_GROUP, kll_k: int = KLL_K, **columns) -> DataFrame:
    """Metrics, base rule and verdict per document, with the fences used."""
    m = rates(materialize(measure(docs, **columns), "rule-metrics"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumn("base_failed", base_failed)
    by_group, by_lang, overall = fences(m.filter(F.col("n_words") > 0), kll_k)
    # One row of fences per group: sparse groups take their language's, then the corpus's.
    levels = by_group.alias("g").join(by_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
    corpus = overall.first()                                        # one row, or none
    whole = {r: F.struct(*[F.lit(corpus[f"{r}_a"][x] if corpus else None).cast("double").alias(x)
                           for x in ("lo", "hi")]) for r in RULES}
    pick = {r: F.when(F.col("n_g") >= min_group, F.col(f"{r}_g"))
            .when(F.col("n_l") >= min_group, F.col(f"{r}_l")).otherwise(whole[r]) for r in RULES}
    used = levels.select(F.col("g.lang").alias("f_lang"), F.col("g.source").alias("f_source"),
                         *[pick[r].alias(f"{r}_fence") for r in RULES])
    joined = m.join(used, m["lang"].eqNullSafe(F.col("f_lang")) & m["source"].eqNullSafe(F.col("f_source")), "left")
    ok = F.lit(True)
    for r, (side, _, _) in RULES.items():
        f = F.col(f"{r}_fence")
        ok = ok & (F.col(r) <= f["hi"])
        if side == "both":
            ok = ok & (F.col(r) >= f["lo"])
    kept = ~F.col("base_failed") & F.coalesce(ok, F.lit(False))
    return joined.withColumn("kept", kept).drop("f_lang", "f_source")


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The kept documents; the rows of one id (NULL included) share one verdict, so one bad row rejects them all."""
    verdict = judge(docs, **options).groupBy("doc_id").agg(F.bool_and("kept").alias("kept")).filter("kept")
    kept = verdict.select(F.col("doc_id").alias("_kept_id"))
    id_col = options.get("id_col", "doc_id")
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")
