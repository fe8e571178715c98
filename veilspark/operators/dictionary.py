"""P1g: dictionary terms of any length, found in one pass per text.

A term is a run of word tokens (:data:`PHRASE_TOKEN_RX`).  All beginnings of
all terms form a trie; its node for a path of tokens is the path's 64-bit
hash.  The tokens of a batch of texts walk it side by side: every token starts
a path, and a path goes on while its hash is a node, so the work is one step
per token and one for each further token of a path that the dictionary shares
- nothing is written per n-gram, and a term may have any number of words.

* A dictionary whose finished index (hash arrays and terms, as built) fits
  ``max_bytes`` is broadcast; a match is compared with the term itself, so a
  colliding hash finds nothing.  Detection is then a column: no shuffle, no key.
* A larger dictionary is never broadcast.  Spark builds a bitmap of its path
  hashes (of bounded size); texts walk that, and the few phrases that reach a
  path's end are joined with the terms.

Both give the same spans: every occurrence of every term that starts and ends
at token borders, overlapping ones included.  NULL texts have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.spans import SPAN, SPANS

# --- fixed values: word tokens of dictionary terms ---------------------------
PHRASE_TOKEN_RX = r"[\p{L}\p{N}][\p{L}\p{N}#_'&-]*"

MAX_BYTES = 32 << 20
MAX_BITMAP_BITS = 1 << 28          # 32 MB
_TOKEN = regex.compile(PHRASE_TOKEN_RX)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 256                       # texts walked at a time


def _step(path, token):
    """Hash of a path that goes on with a token."""
    x = (path ^ (token + _MULT + (path << np.uint64(7)) + (path >> np.uint64(3)))) * _MULT
    return x ^ (x >> np.uint64(32))


def _token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def term_paths(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node hashes, end hash of each usable term, that term's position).

    A term that does not start and end with a token can never match.
    """
    hashes: dict[str, int] = {}
    rows, lens, flat = [], [], []
    for i, t in enumerate(terms):
        spans = [m.span() for m in _TOKEN.finditer(t)] if t else []
        if spans and spans[0][0] == 0 and spans[-1][1] == len(t):
            rows.append(i)
            lens.append(len(spans))
            for s, e in spans:
                w = t[s:e]
                h = hashes.get(w)
                if h is None:
                    h = hashes[w] = _token_hash(w)
                flat.append(h)
    size, tokens = np.array(lens, np.int64), np.array(flat, np.uint64)
    first = np.cumsum(size) - size
    path, ends = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    nodes = []
    for depth in range(int(size.max()) if len(size) else 0):
        on = np.flatnonzero(size > depth)
        path[on] = _step(path[on], tokens[first[on] + depth])
        nodes.append(np.unique(path[on]))
        done = on[size[on] == depth + 1]
        ends[done] = path[done]
    return np.unique(np.concatenate(nodes)) if nodes else np.zeros(0, np.uint64), ends, np.array(rows, np.int64)


def _among(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return sorted_[at] == h


def walk(texts: list, is_node, is_end):
    """(row, start, end, path hash) of every path that reaches an end."""
    hashes: dict[str, int] = {}
    row, start, end, token, last = [], [], [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        for m in _TOKEN.finditer(t):
            s, e = m.span()
            w = t[s:e]
            h = hashes.get(w)
            if h is None:
                h = hashes[w] = _token_hash(w)
            start.append(s)
            end.append(e)
            token.append(h)
        new = len(start) - len(row)
        row += [i] * new
        last += [len(start)] * new
    row, start, end, last = (np.array(x, np.int64) for x in (row, start, end, last))
    token = np.array(token, np.uint64)
    at, depth, found = np.arange(len(row)), 0, []
    path = np.zeros(len(row), np.uint64)
    while len(at):
        path = _step(path, token[at + depth])
        go = is_node(path)
        at, path = at[go], path[go]
        hit = is_end(path)
        if hit.any():
            found.append((row[at[hit]], start[at[hit]], end[at[hit] + depth], path[hit]))
        depth += 1
        go = at + depth < last[at]
        at, path = at[go], path[go]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate([f[j] for f in found]) for j in range(4))


class TermIndex:
    """The trie of a dictionary small enough to be held, with its terms."""

    def __init__(self, terms: list[str], types: list[str], scores: list[float]):
        self.nodes, ends, rows = term_paths(terms)
        order = np.argsort(ends, kind="stable")
        self.ends, rows = ends[order], rows[order]
        self.terms = pa.array([terms[i] for i in rows], pa.string())
        self.kinds = sorted(set(zip(types, scores)))
        number = {k: i for i, k in enumerate(self.kinds)}
        self.kind = np.array([number[types[i], scores[i]] for i in rows], np.int16)

    @property
    def nbytes(self) -> int:
        return self.nodes.nbytes + self.ends.nbytes + self.terms.nbytes + self.kind.nbytes

    def find(self, texts: list) -> list[list[dict]]:
        """Spans of every text."""
        out: list[list] = [[] for _ in texts]
        row, start, end, path = walk(texts, lambda h: _among(self.nodes, h), lambda h: _among(self.ends, h))
        first, last = np.searchsorted(self.ends, path), np.searchsorted(self.ends, path, "right")
        for i, s, e, a, b in zip(row.tolist(), start.tolist(), end.tolist(), first.tolist(), last.tolist()):
            phrase = texts[i][s:e]
            for j in range(a, b):
                if self.terms[j].as_py() == phrase:
                    kind, score = self.kinds[self.kind[j]]
                    out[i].append({"start": s, "end": e, "pii_type": kind, "score": score})
        return out


def _wanted(dictionary: DataFrame, scores: dict[str, float], threshold: float) -> DataFrame:
    """(term, pii_type, score) of the types asked for, each once."""
    kept = {t: s for t, s in scores.items() if s >= threshold}
    if not kept:
        return dictionary.select("term", F.lit("").alias("pii_type"), F.lit(0.0).alias("score")).limit(0)
    score = F.coalesce(*[F.when(F.col("pii_type") == t, F.lit(float(s))) for t, s in kept.items()])
    return dictionary.select("term", F.upper("pii_type").alias("pii_type")) \
        .where(F.col("pii_type").isin(list(kept)) & F.col("term").isNotNull()).dropDuplicates(["term", "pii_type"]) \
        .withColumn("score", score)


def term_column(dictionary: DataFrame, scores: dict[str, float], threshold: float = 0.0, max_bytes: int = MAX_BYTES):
    """``Column -> Column`` giving the spans of a text, or None if the dictionary is too large to hold.

    The terms' bytes are summed first, so at most ``max_bytes`` are fetched; the
    finished index is measured again before it is broadcast.
    """
    d = _wanted(dictionary, scores, threshold)
    if (d.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) > max_bytes:
        return None
    rows = d.toArrow()
    index = TermIndex(*(rows.column(c).to_pylist() for c in ("term", "pii_type", "score")))
    if index.nbytes > max_bytes:
        return None
    sent = dictionary.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("score", pa.float64())]))

    def spans(texts: pa.Array) -> pa.Array:
        listed, out = texts.to_pylist(), []
        for lo in range(0, len(listed), _SLICE):
            out += sent.value.find(listed[lo:lo + _SLICE])
        return pa.array(out, kind)

    # Never evaluated twice: a filter on the spans must not be pushed through the column.
    return F.arrow_udf(spans, SPANS).asNondeterministic()


def _bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """Bitmap (two bits a hash) of the ``h`` column, built by Spark's bitmap aggregates."""
    size = 1 << 15
    while size < 16 * n and size < MAX_BITMAP_BITS:
        size *= 2
    h = F.col("h")
    at = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(0x7FFFFFFF)) % size,
                                         F.shiftright(h, 32).bitwiseAND(F.lit(0x7FFFFFFF)) % size)).alias("b")) \
        .select((F.col("b") + 1).alias("b"))
    out = np.zeros(size // 8, np.uint8)
    for r in at.groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect():
        out[(r["n"] - 1) * 4096:r["n"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    size, out = np.uint64(8 * len(bits)), np.ones(len(h), bool)
    for part in (h & np.uint64(0x7FFFFFFF), (h >> np.uint64(32)) & np.uint64(0x7FFFFFFF)):
        at = part % size
        out &= ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def term_rows(df: DataFrame, key_col: str, text_col: str, dictionary: DataFrame, scores: dict[str, float],
              threshold: float = 0.0) -> DataFrame:
    """(key, start, end, pii_type, score) for a dictionary of any size, by bitmap and join."""
    d = _wanted(dictionary, scores, threshold)

    def paths(batches):
        for b in batches:
            nodes, ends, _ = term_paths(b.column(0).to_pylist())
            ends = np.unique(ends)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[nodes, ends].view(np.int64)),
                                              pa.array(np.r_[np.zeros(len(nodes), bool), np.ones(len(ends), bool)])], names=["h", "is_end"])

    hashes = d.select("term").mapInArrow(paths, "h long, is_end boolean")
    n = hashes.agg(F.count("*")).first()[0]
    maps = tuple(_bitmap(hashes.where(F.col("is_end") == end), n) for end in (False, True))
    sent = df.sparkSession.sparkContext.broadcast(maps)
    schema = T.StructType([T.StructField(key_col, df.schema[key_col].dataType), T.StructField("start", T.IntegerType()),
                           T.StructField("end", T.IntegerType()), T.StructField("phrase", T.StringType())])

    def candidates(batches):
        nodes, ends = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), _SLICE):
                part = texts[lo:lo + _SLICE]
                row, start, end, _ = walk(part, lambda h: _in_bitmap(nodes, h), lambda h: _in_bitmap(ends, h))
                phrases = [part[i][s:e] for i, s, e in zip(row.tolist(), start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row + lo)), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                     pa.array(phrases, pa.string())], names=[key_col, "start", "end", "phrase"])

    return df.select(key_col, text_col).mapInArrow(candidates, schema).join(d, F.col("phrase") == F.col("term")) \
        .select(key_col, "start", "end", "pii_type", "score")


__all__ = ["PHRASE_TOKEN_RX", "SPAN", "TermIndex", "term_column", "term_rows"]
