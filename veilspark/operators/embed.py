"""Turn text into vectors.

``HashEmbedder`` (default) is feature hashing: the bucket of a word is the
first 8 hex digits of its MD5 modulo ``dim``; the vector is the L2-normalised
bucket histogram.  Texts of letters below ``LATIN`` are parted by one look at
each byte, and the different words of a batch are hashed side by side; texts with
other characters are parted and hashed by the JVM, whose Unicode tables decide
what a word is.
``ModelEmbedder`` is the hook for a real model: an iterator pandas UDF that
loads the model once per Python worker and encodes whole Arrow batches.
"""

from __future__ import annotations

import unicodedata
from hashlib import md5
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: hash-embedding word pattern -------------------------------
EMBED_WORD_RX = r"[\p{L}\p{N}]+"
ROWS = 1024               # rows of an Arrow batch that are counted at a time
LATIN = 0x250             # up to here, two bytes of UTF-8 at most, letters and digits are the same in Java's and Python's tables
NOT_LATIN_RX = rf"[^\x00-\u{LATIN - 1:04X}]"


def truncate_words(text: Column, max_length: int) -> Column:
    """First ``max_length`` pieces of ``text.split(' ')`` re-joined by one blank."""
    return F.substring_index(text, " ", int(max_length))


def word_buckets(text: Column, dim: int) -> Column:
    words = F.regexp_extract_all(text, F.lit(EMBED_WORD_RX), F.lit(0))
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")
                                         % F.lit(int(dim))).cast("int"))


def _md5_heads():
    """``heads(words)``: the first four bytes of each word's MD5 as a number, as a closure."""
    sines = [int(abs(np.sin(i + 1)) * 2 ** 32) for i in range(64)]
    turns = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]

    def mixed(i, b, c, d):
        if i < 16:
            return d ^ (b & (c ^ d)), i
        if i < 32:
            return c ^ (d & (b ^ c)), 5 * i + 1
        if i < 48:
            return b ^ c ^ d, 3 * i + 5
        return c ^ (b | ~d), 7 * i

    def heads(words: pa.Array) -> np.ndarray:
        """Of a binary array without NULLs; words of one MD5 block are hashed side by side, a round a step."""
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        lens = np.diff(at)
        short = np.flatnonzero(lens < 56)
        out = np.zeros(len(words), np.uint32)
        for i in np.flatnonzero(lens >= 56).tolist():
            out[i] = int.from_bytes(md5(words[i].as_py(), usedforsecurity=False).digest()[:4], "big")
        if not len(short):
            return out
        n, text = len(short), np.frombuffer(data, np.uint8)
        own = np.repeat(np.arange(n), lens[short])
        place = np.arange(len(own)) - np.repeat(np.cumsum(lens[short]) - lens[short], lens[short])
        block = np.zeros((n, 64), np.uint8)
        block[own, place] = text[at[short][own] + place]
        block[np.arange(n), lens[short]] = 0x80
        block[:, 56:64] = (8 * lens[short]).astype("<u8").view(np.uint8).reshape(n, 8)
        words32 = np.ascontiguousarray(block.view("<u4").T)
        start = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = start
        for i in range(64):
            mix, g = mixed(i, b, c, d)
            mix += a
            mix += words32[g % 16]
            mix += np.uint32(sines[i])
            a, d, c, b = d, c, b, b + (mix << np.uint32(turns[i]) | mix >> np.uint32(32 - turns[i]))
        out[short] = (start[0] + a).byteswap()
        return out

    return heads


class HashEmbedder:
    """Deterministic feature-hashing embedder (no model, no network)."""

    def __init__(self, dim: int = 64, max_length: int = 256):
        self.output_dim = int(dim)
        self.max_length = int(max_length)

    def column(self, text: Column) -> Column:
        dim = self.output_dim
        letter = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(LATIN)])
        ascii_letter = np.r_[letter[:128], np.zeros(128, bool)]
        step, heads = ROWS, _md5_heads()                     # held by the closure: workers do not import this module

        def word_cells(texts: pa.Array) -> np.ndarray:
            """``row * dim + bucket`` of every word of texts whose characters are below LATIN (no NULLs)."""
            _, offsets, data = texts.buffers()
            kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            text = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
            at -= at[0]
            inside = ascii_letter[text]
            lead = np.flatnonzero(text >= 0xC2)              # of two bytes each
            if len(lead):
                two = letter[(text[lead].astype(np.int64) & 0x1F) << 6 | (text[lead + 1] & 0x3F)]
                inside[lead] = inside[lead + 1] = two
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            rows = at[:-1][at[:-1] < len(text)]
            first[rows] = inside[rows]                       # a word ends with its text
            kept = np.flatnonzero(inside)
            begin = np.flatnonzero(first[kept])
            words = pa.Array.from_buffers(pa.binary(), len(begin), [
                None, pa.py_buffer(np.r_[begin, len(kept)].astype(np.int32)), pa.py_buffer(text[kept])]).dictionary_encode()
            buckets = heads(words.dictionary).astype(np.int64) % dim
            row = np.searchsorted(at, kept[begin], side="right") - 1
            return row * dim + buckets[words.indices.to_numpy()] if len(begin) else row

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def _hist(texts: pa.Array, others: pa.Array) -> pa.Array:
            out = [np.zeros((0, dim), np.float32)]
            for lo in range(0, len(texts), step):            # what is held beside the batch does not depend on its size
                part = others.slice(lo, step)
                n, lens = len(part), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                # One bincount for all rows: cell = row * dim + bucket.
                cells = np.repeat(np.arange(n, dtype=np.int64), lens) * dim + part.flatten().to_numpy(zero_copy_only=False)
                latin = pc.if_else(part.is_null(), pc.fill_null(texts.slice(lo, step), ""), "")
                cells = np.r_[cells, word_cells(latin)].astype(np.int64)
                m = np.bincount(cells, minlength=n * dim).reshape(n, dim).astype(np.float64)
                norm = np.sqrt((m * m).sum(axis=1))
                nz = norm > 0
                m[nz] /= norm[nz, None]
                out.append(m.astype(np.float32))
            flat = np.concatenate(out).reshape(-1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(flat))

        seen = truncate_words(text, self.max_length)
        return _hist(seen, F.when(seen.rlike(NOT_LATIN_RX), word_buckets(seen, dim)))


class ModelEmbedder:
    """Hook for a sentence model: ``load()`` returns an object with ``encode(list[str])``.

    The model is loaded once per Python worker and applied to whole Arrow
    batches (iterator pandas UDF).  Not used by the registered checks.
    """

    def __init__(self, load: Callable[[], object], dim: int, max_length: int):
        self.load, self.output_dim, self.max_length = load, int(dim), int(max_length)

    def column(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                vecs = model.encode(s.fillna("").tolist())
                yield pd.Series([np.asarray(v, dtype=np.float32) for v in vecs])

        return _enc(truncate_words(text, self.max_length))


def embed(df: DataFrame, text_col: str = "content", embedder=None,
          out_col: str = "embedding") -> DataFrame:
    """Attach ``out_col: array<float>`` computed from ``text_col``."""
    embedder = embedder or HashEmbedder()
    return df.withColumn(out_col, embedder.column(F.col(text_col)))
