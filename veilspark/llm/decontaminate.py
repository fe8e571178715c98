"""Benchmark decontamination.

Every benchmark text gives windows of ``n`` consecutive normalised words (a
shorter text is one window).  The windows form a hash set; each task scans the
word windows of its documents against it with a rolling 64-bit hash and
verifies every hit on the words themselves.

The set is broadcast only when the benchmark's total text size is proven to be
within ``max_broadcast_bytes``; a larger benchmark takes a shuffled join of
window digests (128 bits) instead, with the same results.

Edge cases: NULL or empty text has no words and no hits; an item without words
has no window; a NULL ``item_id`` still marks words but is listed as ``null``;
repeated rows are judged one by one; an empty benchmark hits nothing; columns
of ``docs`` pass through unchanged, whatever their names (the result struct
takes a free name).
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import free_name, materialize, text_bytes

WINDOW = 10
MAX_BROADCAST_BYTES = 2 << 20        # of text; the index in memory is about a hundred times as large

# Word bytes: digits, letters (lower-cased) and every non-ASCII byte; all else separates.
_NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
                else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_SEP = b" \x01 "          # a document's end inside a batch; \x01 is never part of a word
_WORD = re.compile(rb"[^ ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("clean_text", T.StringType()),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` ids (wrapping 64-bit polynomial)."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        out = out * _BASE + x[j:j + len(out)]
    return out


class _Index:
    """Windows of the benchmark: word ids, and per window length sorted hashes and items."""

    def __init__(self, rows, n: int):
        self.vocab: dict[bytes, int] = {b"\x01": -2}
        self.windows: dict[tuple, set] = {}
        for item, text in rows:
            ws = words_of(text)
            if not ws:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            size = min(n, len(ids))
            name = "null" if item is None else item
            for i in range(len(ids) - size + 1):
                self.windows.setdefault(tuple(ids[i:i + size]), set()).add(name)
        by_len: dict[int, list] = {}
        for w in self.windows:
            by_len.setdefault(len(w), []).append(w)
        self.hashes = {size: np.unique(_rolling(np.array(ws, np.int64).reshape(-1), size)[::size])
                       for size, ws in by_len.items()}

    def scan(self, texts: list) -> list[tuple]:
        """Per text: (words, hit words, items, hit word spans)."""
        words = _SEP.join([t.translate(_NORMAL) if t else b"" for t in texts] + [b""]).split()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, count=len(words))
        ends = np.flatnonzero(ids == -2)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        out = [(int(b - a), 0, (), ()) for a, b in zip(starts, ends)]
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        edge = np.zeros(len(ids) + 1, np.int32)
        items: dict[int, set] = {}
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(bad[size:] == bad[:-size])
            if not len(at):
                continue
            h = _rolling(ids, size)[at]
            k = np.searchsorted(hashes, h)
            at = at[hashes[np.minimum(k, len(hashes) - 1)] == h]
            for i in at.tolist():
                found = self.windows.get(tuple(ids[i:i + size].tolist()))
                if found:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items.setdefault(int(np.searchsorted(ends, i)), set()).update(found)
        if items:
            hit = np.cumsum(edge[:-1]) > 0
            for d, found in items.items():
                a, b = starts[d], ends[d]
                m = np.concatenate([[0], hit[a:b].astype(np.int8), [0]])
                lo, hi = np.flatnonzero(np.diff(m) == 1), np.flatnonzero(np.diff(m) == -1)
                out[d] = (int(b - a), int((hi - lo).sum()), tuple(sorted(found)),
                          tuple(zip(lo.tolist(), hi.tolist())))
        return out


def cut_words(text: bytes, spans) -> bytes:
    """``text`` without the words of ``spans`` and what lies between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def _result(text: bytes | None, found: tuple) -> dict:
    n, hit, items, spans = found
    clean = cut_words(text, spans) if spans else text
    return {"n_words": n, "n_hit": hit, "item_ids": list(items),
            "spans": [{"start": a, "end": b} for a, b in spans],
            "clean_text": None if clean is None else clean.decode("utf-8", "replace")}


def _arrow_schema(df: DataFrame, extra: T.StructType) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType(list(df.schema) + list(extra))
    return schema, to_arrow_schema(schema)


def _scan_broadcast(docs, rows, text_col, n, name) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(_Index(rows, n))
    schema, arrow = _arrow_schema(docs, T.StructType([T.StructField(name, RESULT)]))

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(text_col))
            got = [_result(t, f) for t, f in zip(texts, index.value.scan(texts))]
            yield pa.RecordBatch.from_arrays(
                [*(c.cast(f.type) for c, f in zip(b.columns, arrow)),
                 pa.array(got, type=arrow.field(len(arrow) - 1).type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def _window_rows(df: DataFrame, key: str, text_col: str, n: int, sizes: list[int] | None) -> DataFrame:
    """(key, at, size, digest): one row per word window; digests are 128 bits."""
    from hashlib import blake2b

    def run(batches):
        for b in batches:
            keys, at, size_of, digest = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                ws = words_of(t)
                for size in (sizes if sizes is not None else [min(n, len(ws))] if ws else []):
                    for i in range(len(ws) - size + 1):
                        keys.append(k)
                        at.append(i)
                        size_of.append(size)
                        digest.append(blake2b(b" ".join(ws[i:i + size]), digest_size=16).digest())
            yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.string()), "at": pa.array(at, pa.int32()),
                                              "size": pa.array(size_of, pa.int32()),
                                              "digest": pa.array(digest, pa.binary())})

    return df.select(F.col(key).cast("string"), text_col).mapInArrow(
        run, "k string, at int, size int, digest binary")


def _scan_join(docs, benchmark, text_col, item_col, item_text, n, name) -> DataFrame:
    """The same result through a shuffled join of window digests, for any benchmark size."""
    key, inner = free_name(docs, "doc_key"), "text"
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    wanted = materialize(_window_rows(benchmark, item_col, item_text, n, None), "decon-windows")
    sizes = [r[0] for r in wanted.select("size").distinct().collect()]     # at most n values
    texts = keyed.select(key, F.col(text_col).alias(inner)).filter(F.col(inner).isNotNull()) \
        .groupBy(key).agg(F.any_value(inner).alias(inner))
    hits = (_window_rows(texts, key, inner, n, sizes).withColumnRenamed("k", "doc")
            .join(wanted.select(F.coalesce("k", F.lit("null")).alias("item"), "digest", "size").distinct(),
                  ["digest", "size"])
            .groupBy("doc").agg(F.collect_set("item").alias("items"),
                                F.collect_set(F.struct("at", "size")).alias("at")))
    joined = keyed.join(hits.select(F.col("doc").alias(key), F.struct("items", "at").alias(name + "_hits")),
                        key, "left")
    out = T.StructType(list(docs.schema) + [T.StructField(name, RESULT)])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)
    cols, hit_col = docs.columns, name + "_hits"

    def run(batches):
        for b in batches:
            texts, got = text_bytes(b.column(text_col)), []
            for t, h in zip(texts, b.column(hit_col).to_pylist()):
                n_words, spans = len(words_of(t)), []
                for w in sorted((x["at"], x["at"] + x["size"]) for x in h["at"]) if h else []:
                    if spans and w[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], w[1]))
                    else:
                        spans.append(w)
                got.append(_result(t, (n_words, sum(e - s for s, e in spans),
                                       sorted(h["items"]) if h else [], spans)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).cast(f.type) for c, f in zip(cols, arrow)),
                 pa.array(got, type=arrow.field(len(arrow) - 1).type)], schema=arrow)

    return joined.mapInArrow(run, out)


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", n: int = WINDOW,
         max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a result struct (see ``RESULT``), and that column's name.

    ``spans`` are word positions [start, end); ``clean_text`` is the text
    without them.
    """
    name = free_name(docs, "decon")
    size = benchmark.agg(F.sum(F.octet_length(item_text)).alias("b"), F.count("*").alias("n")).first()
    if (size["b"] or 0) + 64 * size["n"] <= max_broadcast_bytes:
        rows = [(r[0], None if r[1] is None else bytes(r[1])) for r in benchmark.select(
            F.col(item_col).cast("string"), F.col(item_text).cast("binary")).collect()]
        return _scan_broadcast(docs, rows, text_col, n, name), name
    return _scan_join(docs, benchmark, text_col, item_col, item_text, n, name), name


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "remove_spans",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without benchmark passages.

    ``remove_spans`` cuts the hit words out of the text; ``drop_documents``
    drops every document with a hit.  The columns of ``docs`` come back.
    """
    found, name = scan(docs, benchmark, text_col=text_col, **options)
    if action == "drop_documents":
        return found.filter(F.col(name)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    if action != "remove_spans":
        raise ValueError("action is remove_spans or drop_documents")
    return found.select(*[F.col(name)["clean_text"].alias(c) if c == text_col else F.col(f"`{c}`")
                          for c in docs.columns])


def _sql(n: int = WINDOW) -> str:
    """DuckDB SQL of the digest that query op7 returns."""
    def words(t):
        return (f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                f"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

    return f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({n}, len(w)) AS n
  FROM (SELECT item_id, {words('text')} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
  FROM d JOIN (SELECT DISTINCT n FROM iw) s ON len(d.w) >= s.n)),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""


ORACLE_SQL = _sql()
