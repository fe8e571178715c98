"""K1–K5: split documents into pieces and emit overlapping word windows.

Window rule (per piece j with n_j words, in order): the piece joins the
window; if n_j < min it emits nothing; otherwise pieces leave the front while
the window has more than max(=M) ... precisely while its word count exceeds
``min(M, overlap + n_j)`` and it holds more than one piece; then the window is
emitted, joined by ". ".

Closed form used here: with prefix sums P, the window of an emitted j starts
at ``max(start of the previous emitted window, t_j)`` where ``t_j`` is the
first piece s with ``P[j] - P[s-1] <= min(M, overlap + n_j)`` (or j itself).
Splitting and the windows' texts are JVM expressions; one Arrow-batched UDF
counts the pieces' words by one look at each byte and finds the windows (cumsum
+ searchsorted), because Spark has no prefix-scan over arrays.  Everything stays
narrow: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.fixed import DEFAULT_MIN_CHUNK, DEFAULT_OVERLAP, WS_CHARS

# --- fixed values: sentence splitting ---------------------------------------
SENTENCE_END = r"([.!?])[\t\n\f\r ]+"
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc")
ROWS = 1024               # documents of an Arrow batch that are counted at a time
_PROTECT = "\u0002"
_CUT = "\u0001"


def split_simple(text: Column) -> Column:
    """K1: ``text.split('.')`` — blanks kept, trailing empty piece kept."""
    return F.split(text, r"\.", -1)


def split_sentences(text: Column) -> Column:
    """K2: cut after . ! ? followed by blanks, except after a known abbreviation."""
    abbr = r"(^|[^\p{L}])(" + "|".join(ABBREVIATIONS) + r")\."
    t = F.regexp_replace(text, abbr, "$1$2" + _PROTECT)
    t = F.regexp_replace(t, SENTENCE_END, "$1" + _CUT)
    return F.transform(F.split(t, _CUT, -1), lambda s: F.replace(s, F.lit(_PROTECT), F.lit(".")))


def blank_words(text: Column) -> Column:
    """Python ``s.split()``: map every Unicode blank to ' ' (a character map,
    no regex), split on the single space, drop the empty pieces."""
    return F.filter(F.split(F.translate(text, WS_CHARS, " " * len(WS_CHARS)), " ", -1),
                    lambda w: w != "")


def _counter():
    """``word_counts``, as a closure (it travels to the workers by value)."""
    narrow = np.array([c < 128 and chr(c) in WS_CHARS for c in range(256)])
    wide: dict[int, list[bytes]] = {}            # by first byte; those that share it are equally long
    for c in WS_CHARS:
        if ord(c) >= 128:
            wide.setdefault(c.encode()[0], []).append(c.encode())

    def word_counts(pieces: pa.Array) -> np.ndarray:
        """Python ``len(s.split())`` of each string (no NULLs): the words that begin between its offsets."""
        _, offsets, data = pieces.buffers()
        kind = np.int64 if pa.types.is_large_string(pieces.type) else np.int32
        at = np.frombuffer(offsets, kind)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        text = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at -= at[0]
        blank = narrow[text]
        for lead, chars in wide.items():
            found = np.flatnonzero(text[:max(0, len(text) - len(chars[0]) + 1)] == lead)
            for char in chars if len(found) else ():
                hit = found[np.logical_and.reduce([text[found + i] == b for i, b in enumerate(char)])]
                for i in range(len(char)):
                    blank[hit + i] = True
        first = ~blank
        first[1:] &= blank[:-1]
        begin = at[:-1][at[:-1] < len(text)]
        first[begin] = ~blank[begin]
        upto = np.r_[0, np.cumsum(first)]
        return upto[at[1:]] - upto[at[:-1]]

    return word_counts


def windows(pieces: Column, max_words: int, overlap: int, min_words: int) -> Column:
    """First and last piece, from 1, of each emitted window."""
    M, O, m, rows, word_counts = int(max_words), int(overlap), int(min_words), ROWS, _counter()

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
    def _windows(col: pa.Array) -> pa.Array:
        starts, ends, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for lo in range(0, len(col), rows):              # what is held beside the batch does not depend on its size
            part = col.slice(lo, rows)
            lens = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)   # NULL text: no pieces, no windows
            counts, to = word_counts(part.flatten()), np.cumsum(lens)
            for a, b in zip(to - lens, to):
                n = counts[a:b]
                end = np.flatnonzero(n >= m) + 1
                sizes.append(len(end))
                if len(end):
                    P = np.concatenate(([0], np.cumsum(n)))
                    t = np.searchsorted(P, P[end] - np.minimum(M, O + n[end - 1]), side="left") + 1
                    starts.append(np.maximum.accumulate(np.minimum(t, end)))
                    ends.append(end)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)], ["s", "e"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pairs)

    return _windows(pieces)


def chunk_documents(df: DataFrame, text_col: str = "text", *, splitter: str = "simple",
                    max_words: int = 256, overlap: int = DEFAULT_OVERLAP,
                    min_words: int = DEFAULT_MIN_CHUNK, keep_cols=None,
                    meta_col: str | None = None) -> DataFrame:
    """K3+K5: one row per emitted window: ``(*keep_cols, chunk_no, content[, metadata])``.

    ``chunk_no`` is 1-based in emission order.  With ``meta_col`` the
    document metadata is merged over per-chunk metadata (K4, document wins).
    """
    keep = list(keep_cols or [])
    split = split_simple if splitter == "simple" else split_sentences
    d = df.select(*keep, *( [meta_col] if meta_col else []),
                  split(F.col(text_col)).alias("_pieces"))
    d = d.withColumn("_windows", windows(F.col("_pieces"), max_words, overlap, min_words))
    # Build each window's text before exploding, so an output row carries only
    # its own content (never the document's whole piece array).
    texts = F.transform("_windows", lambda w, i: F.struct((i + 1).cast("int").alias("chunk_no"), F.array_join(
        F.slice(F.col("_pieces"), w["s"], w["e"] - w["s"] + 1), ". ").alias("content")))
    d = d.select(*keep, *([meta_col] if meta_col else []), F.explode(texts).alias("_w"))
    out = d.select(*keep, *([meta_col] if meta_col else []), F.col("_w.chunk_no").alias("chunk_no"),
                   F.col("_w.content").alias("content"))
    if meta_col:
        out = out.withColumn(meta_col, merge_metadata(
            F.create_map(F.lit("chunk"), F.col("chunk_no").cast("string")), F.col(meta_col)))
    return out


def merge_metadata(per_chunk: Column, doc_meta: Column) -> Column:
    """K4: ``{**per_chunk, **doc_meta}`` without tripping duplicate-key checks."""
    return F.map_concat(F.map_filter(per_chunk, lambda k, v: ~F.map_contains_key(doc_meta, k)),
                        doc_meta)
