"""Semantic prompt cache over a :class:`Collection`.

Store (C2): admit prompts no longer than ``max_length`` characters (F6), embed
the *raw* prompt (probe and stored vectors must share one space), anonymize
the stored prompt and the JSON record, append.
Lookup (C1): embed probes, top-1 by L2, a hit needs score < threshold (F4)
and an unexpired row (F5, ``as_of`` is a parameter so runs repeat);
null ``created_at`` never expires.  Only a row within the threshold's distance
can be a hit or expired, so the search is the pivot-pruned one of
:mod:`threshold`: the same answers, without a distance for every pair.  Evict (C3): delete expired rows by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.fixed import CACHE_THRESHOLD, CACHE_TTL_SECONDS
from veilspark.operators.anonymize import anonymize, deanonymize_text
from veilspark.operators.embed import HashEmbedder
from veilspark.operators.search import knn
from veilspark.operators.search import score as distance_score
from veilspark.operators.threshold import nearest_within, radius_of


def admit(prompt: Column, max_length: int) -> Column:
    """the reference compares characters with the embedder's token limit."""
    return F.length(prompt) <= F.lit(int(max_length))


def expired(created_at: Column, ttl_seconds: int, as_of: Column) -> Column:
    """``created_at + ttl < as_of``; NULL created_at never expires."""
    return F.coalesce(created_at + F.make_dt_interval(secs=F.lit(int(ttl_seconds))) < as_of,
                      F.lit(False))


def cache_store(records: DataFrame, collection, *, secret: str, embedder=None,
                prompt_col: str = "prompt", record_col: str = "record_json",
                id_col: str = "id", created_col: str | None = None, salt: str = "") -> None:
    """Admit → embed raw prompt → anonymize prompt and record → append."""
    embedder = embedder or HashEmbedder(collection.dim)
    r = records.where(admit(F.col(prompt_col), embedder.max_length))
    r = r.withColumn("embedding", embedder.column(F.col(prompt_col)))
    r = anonymize(r, [prompt_col, record_col], secret, mode="aes", salt=salt, scope=id_col)
    cols = [F.col(id_col).alias("id"), F.col(prompt_col).alias("content"),
            F.create_map(F.lit("cache"), F.col(record_col)).alias("metadata"), "embedding"]
    if created_col:
        cols.append(F.col(created_col).alias("created_at"))
    collection.save_nodes(r.select(*cols))


def cache_lookup(prompts: DataFrame, cache: DataFrame, *, secret: str, as_of: Column,
                 embedder=None, threshold: float = CACHE_THRESHOLD,
                 ttl_seconds: int = CACHE_TTL_SECONDS, pid_col: str = "pid",
                 prompt_col: str = "prompt") -> DataFrame:
    """``(pid, status, cache_id, score, record_json)``; status hit|miss|expired.

    ``cache`` is a collection scan.  The record is restored only on a hit.
    """
    embedder = embedder or HashEmbedder()
    q = prompts.select(F.col(pid_col).alias("qid"), embedder.column(F.col(prompt_col)).alias("embedding"))
    c = cache.select("id", "embedding", "created_at", F.col("metadata")["cache"].alias("record"))
    if threshold < 1:
        top = nearest_within(q, c, radius=radius_of(threshold), dim=embedder.output_dim).where("id is not null") \
            .withColumn("score", distance_score(F.col("distance"))).join(c.drop("embedding"), "id")
    else:                                               # every distance is below the threshold
        top = knn(q, c, k=1, metric="l2", payload=["created_at", "record"], dim=embedder.output_dim)
    j = prompts.select(F.col(pid_col).alias("qid")).join(top, "qid", "left")
    is_exp = expired(F.col("created_at"), ttl_seconds, as_of)
    status = (F.when(F.col("id").isNull() | (F.col("score") >= F.lit(threshold)), F.lit("miss"))
              .when(is_exp, F.lit("expired")).otherwise(F.lit("hit")))
    out = j.select(F.col("qid").alias(pid_col), status.alias("status"),
                   F.col("id").alias("cache_id"), "score", "record")
    return out.select(pid_col, "status",
                      F.when(F.col("status") == "hit", F.col("cache_id")).alias("cache_id"),
                      F.when(F.col("status") == "hit", deanonymize_text(F.col("record"), secret))
                      .alias("record_json"))


def cache_evict(collection, *, as_of: Column, ttl_seconds: int = CACHE_TTL_SECONDS) -> None:
    """Delete every expired row (by content, like the reference's delete)."""
    collection.delete_where(expired(F.col("created_at"), ttl_seconds, as_of))
