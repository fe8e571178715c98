"""The two end-to-end jobs, each one lazy plan.

ingest:  documents → chunk windows → embed (raw text) → anonymize at rest → nodes
         (into a collection, texts are dealt first and embedded where they are written)
rag:     conversations → requests (last user turn as prompt, titles) →
         per-title k-NN over nodes → context → anonymized request messages
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.anonymize import anonymize
from veilspark.operators.chunk import chunk_documents
from veilspark.operators.context import (assemble_requests, empty_context, format_context,
                                         retrieve_by_title)
from veilspark.operators.embed import HashEmbedder


def compose_id(key, n, width: int = 1_000_000):
    """``key * width + n`` where that is exact; otherwise a hash of both, always negative.

    No number and no key ends the job: a document of more than ``width``
    chunks, or a key from a 64-bit hash, gets hashed ids (63 bits).
    """
    most = (2 ** 63 - 1) // width - 1
    fits = (n >= 0) & (n < width) & (key >= -most) & (key <= most)
    return F.when(fits, key * width + n).otherwise(
        F.xxhash64(key, n).bitwiseOR(F.lit(-2 ** 63).cast("long")))


def chunk_nodes(docs: DataFrame, *, secret: str | None, embedder=None, key_col: str = "doc_id",
                doc_col: str = "source", text_col: str = "text", max_words: int | None = None,
                overlap: int = 10, min_words: int = 3, salt: str = "") -> DataFrame:
    """A6 up to the embedding: ``(id, doc, content, plain, metadata)``; narrow.

    ``content`` is anonymized; ``plain`` is the chunk's own text where that is another one, else NULL.
    The id is composed of key and chunk number (see :func:`compose_id`), so a
    re-run or a retried task writes the same rows (appends are idempotent by id).
    """
    embedder = embedder or HashEmbedder()
    c = chunk_documents(docs.select(key_col, doc_col, text_col), text_col,
                        max_words=max_words or embedder.max_length, overlap=overlap,
                        min_words=min_words, keep_cols=[key_col, doc_col])
    n = c.select(compose_id(F.col(key_col), F.col("chunk_no")).alias("id"),
                 F.col(doc_col).cast("string").alias("doc"), "content", F.col("content").alias("plain"))
    if secret:
        n = anonymize(n, "content", secret, mode="aes", salt=salt, scope="id")
    n = n.withColumn("plain", F.when(F.col("plain") != F.col("content"), F.col("plain")))
    return n.withColumn("metadata", F.create_map(F.lit("doc"), F.col("doc")))


def embed_chunks(chunks: DataFrame, embedder=None) -> DataFrame:
    """The embedding, of the text before it was anonymized, in the place of ``plain``."""
    text = F.coalesce("plain", "content")
    return chunks.withColumn("embedding", (embedder or HashEmbedder()).column(text)).drop("plain")


def ingest_nodes(docs: DataFrame, *, secret: str | None, embedder=None, **kw) -> DataFrame:
    """Nodes ``(id, doc, content, metadata, embedding)``; narrow from scan to sink (see :func:`chunk_nodes`)."""
    return embed_chunks(chunk_nodes(docs, secret=secret, embedder=embedder, **kw), embedder)


def ingest_into(collection, docs: DataFrame, *, secret: str | None, embedder=None, metadata=None, **kw) -> None:
    """A6 into a collection: chunks are dealt to their ranges, and those that are new are embedded there.

    ``metadata``: entries that every node gets besides its ``doc``.
    """
    chunks = chunk_nodes(docs, secret=secret, embedder=embedder, **kw)
    if metadata:
        more = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv])
        chunks = chunks.withColumn("metadata", F.map_concat("metadata", more))
    collection.save_nodes(chunks, embed=lambda new: embed_chunks(new, embedder))


def conversation_requests(conv: DataFrame) -> DataFrame:
    """Requests from a long message table: prompt = last user turn, last turn number.

    Aggregates are partial (max of a struct), so a huge conversation is fine.
    """
    g = conv.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("_last_user"),
        F.max("turn").alias("last_turn"))
    return g.select(F.col("conv_id").alias("request_id"),
                    F.coalesce(F.col("_last_user.text"), F.lit("")).alias("prompt"),
                    "last_turn")


def rag_requests(conv: DataFrame, nodes: DataFrame, titles, *, secret: str, node_secret: str | None,
                 embedder=None, k: int = 3, mode: str = "aes", salt: str = "", where=None, **anon_kw) -> DataFrame:
    """A5: anonymized request messages with retrieved context (long form).

    ``titles(requests) -> (request_id, prompt, title_pos, title)`` names the
    documents that each request asks; ``where`` is a condition on the nodes.
    """
    embedder = embedder or HashEmbedder()
    req = conversation_requests(conv)
    hits = retrieve_by_title(titles(req), nodes, embedder=embedder, k=k, where=where)
    ctx = format_context(hits, secret=node_secret)
    ctx = req.select("request_id", "last_turn").join(ctx, "request_id", "left").select(
        "request_id", (F.col("last_turn") + 2).cast("int").alias("msg_no"),
        F.coalesce(F.col("context"), empty_context()).alias("context"))
    msgs = conv.select(F.col("conv_id").alias("request_id"), (F.col("turn") + 1).cast("int").alias("msg_no"),
                       "role", F.col("text").alias("content"))
    return assemble_requests(msgs, ctx, secret=secret, mode=mode, salt=salt, **anon_kw)
