"""Quality classification by hierarchical empirical Bayes.

Three layers of evidence for "this document is good":

* the document: a naive Bayes log-likelihood ratio over binned shape features
  (word length, symbols, repeated words, line shape ...), counted over all
  labelled rows by grouped aggregation;
* its path (a host and a section of it; here source and language) and its host
  (here the source): posterior shares of good documents.

The shares are shrunk in two steps: a host's share towards the global share, a
path's towards its host's, each by a beta prior whose strength is estimated
from the data (method of moments on grouped sums).  Sparse sites therefore stay
near the prior, large ones speak for themselves.  Labels enter a document's
site counts leave-one-out, so that no document is judged by its own label.

Every step is a grouped aggregation; the tables joined back have one row per
host or path, never per document.  Hot hosts are only ever summed (partial
aggregation before the shuffle).

Edge cases: NULL or empty texts fall into the lowest bins; a NULL host or path
is a site of its own; unlabelled rows are scored; a document with several
labels counts each; repeated rows are judged one by one; with no labels at all
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

BINS = 12
THRESHOLD = 0.5


def features(text: Column) -> dict[str, Column]:
    """Shape features of a text, each in 0..1 (or NULL), as column expressions."""
    words = F.greatest(F.regexp_count(text, F.lit(r"[^\s]+")), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.greatest(F.regexp_count(text, F.lit(r"[^\n]+")), F.lit(1)).cast("double")
    return {
        "length": F.log10(words) / 5,
        "word_chars": F.least(chars / words / 20, F.lit(1.0)),
        "symbols": F.least(F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / words, F.lit(1.0)),
        "digits": F.least(F.regexp_count(text, F.lit(r"[0-9]")) / chars * 4, F.lit(1.0)),
        "capitals": F.least(F.regexp_count(text, F.lit(r"\p{Lu}")) / words, F.lit(1.0)),
        "stops": F.least(F.regexp_count(text, F.lit(r"[.!?]")) / words * 4, F.lit(1.0)),
        "line_words": F.least(words / lines / 100, F.lit(1.0)),
        "distinct": F.size(F.array_distinct(F.split(text, r"\s+"))) / words,
    }


def binned(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_cols: list[str]) -> DataFrame:
    """id, host, path and one bin number per feature."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.to_json(F.struct(F.col(host_col).alias("h"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(path_cols)]))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), path.alias("path"),
        *[F.greatest(F.lit(0), F.least(F.floor(v * BINS), F.lit(BINS - 1))).cast("int").alias(f"f_{k}")
          for k, v in features(t).items()])


def _strength(sites: DataFrame, n: str, s: str, prior: Column | float) -> float:
    """Beta prior strength by moments: how far site shares spread beyond chance around ``prior``."""
    p = prior if isinstance(prior, Column) else F.lit(prior)
    share = F.col(s) / F.col(n)
    r = sites.filter(F.col(n) > 0).agg(
        F.sum(F.col(n)).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * F.pow(share - p, 2)).alias("ss"),
        F.sum(F.col(n) * p * (1 - p)).alias("pq"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not r["n"] or r["k"] < 2 or not r["pq"]:
        return 10.0
    pq = r["pq"] / r["n"]                                   # mean binomial variance of one draw
    spare = r["n"] - r["nn"] / r["n"]
    between = (r["ss"] - (r["k"] - 1) * pq) / spare if spare > 0 else 0.0
    if between <= 1e-9:
        return 1e4                                          # sites differ by chance alone
    return float(min(1e4, max(1.0, pq / between - 1)))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), label_col: str = "quality",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, doc_llr, host_rate, path_rate, score, kept; a row per input row."""
    rows = materialize(binned(docs, id_col, text_col, host_col, list(path_cols)), "quality-bins")
    names = [c for c in rows.columns if c.startswith("f_")]
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")) \
        .filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(
            F.count("*").alias("ly"), F.sum("y").alias("sy"))
    rows = materialize(rows.join(lab, "doc_id", "left").fillna(0, ["ly", "sy"]), "quality-rows")

    # Document evidence: counts of (feature, bin, label), at most features x bins rows.
    seen = rows.filter("ly > 0").select(
        "ly", "sy", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("bin")) for c in names])).alias("x"))
    table = seen.groupBy("x.f", "x.bin").agg(F.sum("ly").alias("n"), F.sum("sy").alias("s")).collect()
    total = rows.agg(F.sum("ly").alias("n"), F.sum("sy").alias("s")).first()
    n, s = (total["n"] or 0), (total["s"] or 0)
    rate = (s + 1) / (n + 2)
    llr = F.lit(0.0)
    for c in names:
        got = {r["bin"]: (r["s"], r["n"] - r["s"]) for r in table if r["f"] == c}
        ratio = [F.lit(float(_llr(*got.get(i, (0, 0)), s, n - s))) for i in range(BINS)]
        llr = llr + F.element_at(F.array(*ratio), F.col(c) + 1)
    # Features overlap; their joint evidence is tempered.
    llr = llr * F.lit(0.5)

    # Sites: host towards global, path towards host.  Sums are leave-one-out when joined.
    paths = rows.groupBy("host", "path").agg(F.sum("ly").alias("pn"), F.sum("sy").alias("ps"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))
    k_host = _strength(hosts, "hn", "hs", rate)
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))) \
        .select(F.col("p.path").alias("site"), "pn", "ps", "hn", "hs")
    host_rate = (F.col("hs") + k_host * rate) / (F.col("hn") + k_host)
    k_path = _strength(both, "pn", "ps", host_rate)
    own_host = (F.col("hs") - F.col("sy") + k_host * rate) / (F.col("hn") - F.col("ly") + k_host)
    own_path = (F.col("ps") - F.col("sy") + k_path * F.col("host_rate")) / (F.col("pn") - F.col("ly") + k_path)
    out = rows.withColumn("doc_llr", llr).join(both, F.col("path") == F.col("site"), "left") \
        .withColumn("host_rate", own_host).withColumn("path_rate", own_path)
    logit = F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    value = 1 / (1 + F.exp(-(F.col("doc_llr") + logit))) if n else F.lit(0.5)
    return out.withColumn("score", value).select(
        "doc_id", "doc_llr", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))


def _llr(good: int, bad: int, all_good: int, all_bad: int) -> float:
    from math import log
    return log((good + 1) / (all_good + BINS)) - log((bad + 1) / (all_bad + BINS))
