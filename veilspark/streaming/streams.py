"""The request/ingest path as Structured Streaming jobs.

* X1 ``anonymize_stream`` — stateless projection on ``readStream``; file sink
  (exactly-once through the sink's commit log).  Tokens use a derived IV, so a
  replayed batch writes identical bytes.
* X1 ``deanonymize_stream`` — the way back, with a flag for malformed rows.
* X2 ``ingest_stream`` — ``foreachBatch`` runs the batch ingest plan; saving
  is idempotent by node id, so replays and several streams are safe.
* X3 ``cache_lookup_stream`` — stream–static lookup against the cache table.
* X4 ``alias_stream`` — per-batch alias map rows appended with the batch
  time; :func:`purge_idle_sessions` is the batch job that expires sessions.

Checkpoints live under the shared folder the session names in
``spark.checkpoint.dir`` (see :func:`veilspark.session.shared_path`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.aliases import alias_tokens
from veilspark.operators.anonymize import anonymize, deanonymize
from veilspark.operators.cache import cache_lookup
from veilspark.plans.pipelines import ingest_into


def table_stream(spark: SparkSession, folder: str, table: str, schema, max_bytes: int = 256 << 20) -> DataFrame:
    """A file-source stream over ``<folder>/<table>.parquet``, one file or a folder of files (schema given, never inferred).

    The path is a pattern: a file source takes a single file only by one.  A batch is bounded in
    bytes, so many small files do not make as many batches of one task each.
    """
    return (spark.readStream.format("parquet").schema(schema)
            .option("maxBytesPerTrigger", max_bytes).load(f"{folder.rstrip('/')}/{table}.parque[t]"))


def _writer(df: DataFrame, checkpoint: str, available_now: bool):
    w = df.writeStream.option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")


def anonymize_stream(stream: DataFrame, cols, secret: str, *, sink: str, checkpoint: str,
                     available_now: bool = True, **kw):
    """Anonymize each arriving row; append to a Parquet sink."""
    out = anonymize(stream, cols, secret, **kw)
    return _writer(out, checkpoint, available_now).format("parquet").option("path", sink) \
        .outputMode("append").start()


def deanonymize_stream(stream: DataFrame, cols, secret: str, *, sink: str, checkpoint: str,
                       available_now: bool = True, **kw):
    """Restore each arriving row; malformed rows are flagged; append to a Parquet sink."""
    out = deanonymize(stream, cols, secret, **kw)
    return _writer(out, checkpoint, available_now).format("parquet").option("path", sink) \
        .outputMode("append").start()


def ingest_stream(stream: DataFrame, collection, *, secret: str | None, checkpoint: str,
                  available_now: bool = True, **ingest_kw):
    """Documents stream → chunk/embed/anonymize → collection (idempotent per batch)."""
    def batch(bdf: DataFrame, batch_id: int) -> None:
        ingest_into(collection, bdf, secret=secret, **ingest_kw)
    return _writer(stream, checkpoint, available_now).foreachBatch(batch).start()


def cache_lookup_stream(stream: DataFrame, cache_collection, *, secret: str, as_of: Column,
                        sink: str, checkpoint: str, available_now: bool = True, **kw):
    """Prompts stream looked up against the (static) cache table, one folder per batch."""
    def batch(bdf: DataFrame, batch_id: int) -> None:
        res = cache_lookup(bdf, cache_collection.scan(), secret=secret, as_of=as_of, **kw)
        res.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    return _writer(stream, checkpoint, available_now).foreachBatch(batch).start()


def alias_stream(stream: DataFrame, *, text_col: str, session_col: str, row_key: str,
                 text_sink: str, map_sink: str, checkpoint: str, available_now: bool = True):
    """Alias tokens per batch; map rows carry ``last_used`` (the batch time)."""
    def batch(bdf: DataFrame, batch_id: int) -> None:
        bdf = bdf.persist()          # two outputs read the batch; compute it once
        try:
            text, amap = alias_tokens(bdf, text_col, session_col, row_key)
            text.write.mode("overwrite").parquet(f"{text_sink}/batch={batch_id}")
            amap.withColumn("last_used", F.current_timestamp()) \
                .write.mode("overwrite").parquet(f"{map_sink}/batch={batch_id}")
        finally:
            bdf.unpersist()
    return _writer(stream, checkpoint, available_now).foreachBatch(batch).start()


def purge_idle_sessions(token_map: DataFrame, *, ttl_seconds: int, as_of: Column) -> DataFrame:
    """X4 expiry: keep sessions used within the TTL (partial max per session, no collect)."""
    last = token_map.groupBy("session_id").agg(F.max("last_used").alias("_last"))
    live = last.where(F.col("_last") + F.make_dt_interval(secs=F.lit(int(ttl_seconds))) >= as_of)
    return token_map.join(live.select("session_id"), "session_id", "left_semi")
