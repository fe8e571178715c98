"""Phrase collocation mining by stripes.

A stripe is one prefix with an associative counter of its next words.  The
corpus is read level by level (Apriori): level 1 holds the stripe of the empty
prefix (all words), level k the stripes of the prefixes of k-1 words whose
prefix and suffix both reach ``min_count``.  A task builds its own stripes and
writes them as one row per (prefix, shard); equal keys are then merged
elementwise in sorted order, one stripe at a time.  The stripe of a hot prefix
(one that begins at least 1 of ``HOT`` words of the corpus, so there are at
most ``HOT`` of them) is dealt out by a hash of the next word, so that it
never lands in one task whole.  From the merged stripes come

* the extensions that reach ``min_count`` (the phrases of the next length),
* the prefix totals: every phrase inherits the counts of its beginnings from
  its prefix and those of its endings from its suffix, so a cut needs no search,
* the subsumption maxima: the largest count among a phrase's extensions by one
  word.  A phrase inside a longer one occurs at least as often as that one,
  so some one-word extension ties with it exactly if any longer candidate does.

Two words are where most stripe entries are, and nearly all of them are rare.
Before level 2 a screen counts pairs of frequent words by 44 bits of their hash
(five bytes an entry, dealt out by the hash); only pairs whose hash reaches
``min_count`` enter a stripe.  A count by hash is never too small, so the
screen loses nothing, and what it lets through is counted exactly.

Which prefixes go on is told by a bitmap of hashes, built by Spark's bitmap
aggregates.  Its size is bounded (``MAX_FILTER_BITS``), and it never decides a
count: a hash that collides costs work only, because stripes are keyed by the
words themselves and a prefix that is no phrase finds no partner in the join.
From level 2 on a pass also writes what may still hold longer phrases (runs of
consecutive frequent prefixes), so later passes read a small part of the text.

Words: A-Z are lower-cased, texts are split at ``.,;:!?`` and line ends into
pieces and pieces at blanks and tabs into words; phrases do not cross pieces.

Edge cases: a NULL text is empty; a NULL language counts as ``und``; rows
repeat as often as they are given; an empty table, or one without frequent
phrases, gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import materialize, text_bytes

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
MAX_FILTER_BITS = 1 << 28          # 32 MB, whatever the corpus
FIRST_SHARDS = 4096                # shares of the empty prefix's stripe, which holds all words
HOT, HOT_SHARDS = 2000, 64
SLICE_BYTES = 4 << 20              # text taken at a time
MAX_ENTRIES = 1 << 20              # stripe entries a task holds before it writes them out

_BREAK = b"\xff"                   # ends a piece; no byte of UTF-8
_NORMAL = bytes(0xFF if c in b".,;:!?" or 0x0A <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)

PARTIAL = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("shard", T.IntegerType()),
    T.StructField("ph", T.LongType()), T.StructField("nexts", T.StringType()),
    T.StructField("counts", T.BinaryType()), T.StructField("runs", T.StringType())])
STRIPES = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("total", T.LongType()),
    T.StructField("nexts", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("hashes", T.ArrayType(T.LongType()))])
_PARTIAL_ARROW = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("shard", pa.int32()), ("ph", pa.int64()),
                            ("nexts", pa.string()), ("counts", pa.binary()), ("runs", pa.string())])


def _chain(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its prefix and that of its last word."""
    x = (state ^ (word + _MULT + (state << np.uint64(6)) + (state >> np.uint64(2)))) * _MULT
    return x ^ (x >> np.uint64(31))


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    size = np.uint64(8 * len(bits))
    out = np.ones(len(h), bool)
    for part in (h & np.uint64(0x7FFFFFFF), (h >> np.uint64(32)) & np.uint64(0x7FFFFFFF)):
        at = part % size
        out &= ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return out


def _screened(state: np.ndarray) -> np.ndarray:
    """The bits of a pair's hash by which the screen counts it."""
    return state >> np.uint64(20)


def _spread(key: np.ndarray) -> np.ndarray:
    """A hash of 64 bits from a screen's key."""
    x = key * _MULT
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Word -> number inside a task; words that the filter turns away are -1."""

    def __init__(self, lang: str, bits: np.ndarray | None):
        self.seed, self.bits = zlib.crc32(lang.encode()), None if bits is None else bits.data
        self.words: list[bytes] = []
        self.hashes: list[int] = []
        self[_BREAK] = -1

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if self.bits is not None:                        # as ``_passes``, for one hash
            size = 8 * len(self.bits)
            for part in (h & 0x7FFFFFFF, h >> 32 & 0x7FFFFFFF):
                at = part % size
                if not self.bits[at >> 3] >> (at & 7) & 1:
                    self[word] = -1
                    return -1
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(h)
        return n


class _Stripes:
    """The stripes of one language inside a task."""

    def __init__(self, lang: str, level: int, bits: np.ndarray | None, pairs: np.ndarray | None, hot: frozenset, limit: int):
        self.lang, self.level, self.bits, self.pairs, self.limit = lang, level, bits, pairs, limit
        self.hot = {p.encode() for k, p in hot if k == lang}
        self.reset()

    def reset(self) -> None:
        self.words = _Words(self.lang, self.bits if self.level == 2 else None)
        self.prefixes: dict[bytes, int] = {}
        self.keys, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.held = 0

    def add(self, blob: bytes) -> bytes:
        """Count one stretch of text; returns the runs that may hold longer phrases."""
        level = self.level
        toks = blob.translate(_NORMAL).replace(_BREAK, b" \xff ").split()
        ids = np.fromiter(map(self.words.__getitem__, toks), np.int64, len(toks))
        if level == 1:
            seen = np.bincount(ids[ids >= 0], minlength=1)
            at = np.flatnonzero(seen)
            self._hold(at, seen[at])
            return b""
        width = level - 1                                # words of a prefix
        n = len(ids) - width + 1
        if n < 2:
            return b""
        fits = ids >= 0                                  # places where a frequent prefix starts
        if level > 2:
            whole = fits[:n].copy()
            hashes = np.array(self.words.hashes, np.uint64)
            state = hashes[ids[:n]] if len(hashes) else np.zeros(n, np.uint64)
            for j in range(1, width):
                whole &= fits[j:n + j]
                state = _chain(state, hashes[ids[j:n + j]])
            at = np.flatnonzero(whole)
            fits = np.zeros(n, bool)
            fits[at[_passes(self.bits, state[at])]] = True
        at = np.flatnonzero(fits[:-1] & fits[1:])
        if level == 2 and len(at):
            hashes = np.array(self.words.hashes, np.uint64)
            at = at[_passes(self.pairs, _spread(_screened(_chain(hashes[ids[at]], hashes[ids[at + 1]]))))]
        if not len(at):
            return b""
        prefix = ids[at]
        for j in range(1, width):
            prefix = np.unique(prefix << 32 | ids[at + j], return_inverse=True)[1]
        if width > 1:
            own, first = np.unique(prefix, return_index=True)
            rows = np.stack([ids[at[first] + j] for j in range(width)], 1).astype(np.int32)
            number = np.array([self.prefixes.setdefault(r.tobytes(), len(self.prefixes)) for r in rows], np.int64)
            prefix = number[prefix]                      # own is 0..len-1
        self._hold(*np.unique(prefix << 32 | ids[at + width], return_counts=True))
        if level == 2:                                   # the screen already tells of pairs
            fits = np.zeros(n, bool)
            fits[at] = True
            return self._runs(toks, fits, 2, 2)
        return self._runs(toks, fits, width, 3)

    def _runs(self, toks: list[bytes], fits: np.ndarray, width: int, least: int) -> bytes:
        """Stretches of ``least`` or more places of ``width`` words that may be frequent: ``level + 1`` words or more."""
        edge = np.flatnonzero(np.diff(np.r_[0, fits.astype(np.int8), 0]))
        start, end = edge[::2], edge[1::2]
        long = end - start >= least
        return b"\n".join(b" ".join(toks[s:e + width - 1]) for s, e in zip(start[long].tolist(), end[long].tolist()))

    def _hold(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys.astype(np.int64))
        self.counts.append(counts.astype(np.int64))
        self.held += len(keys)
        if self.held > 4 * self.limit:
            self._merge()

    def _merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        own, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, counts)
        self.keys, self.counts, self.held = [own], [total], len(own)

    def full(self) -> bool:
        if len(self.words) > self.limit:
            return True
        if self.held > self.limit:
            self._merge()
        return self.held > self.limit

    def rows(self):
        """Partial stripes as Arrow batches, one row per prefix (and shard, where it is hot).

        The next words are joined by blanks, which no word holds; counts are 32-bit numbers.
        """
        self._merge()
        keys, counts = self.keys[0], self.counts[0]
        if not len(keys):
            return
        words, hashes = self.words.words, np.array(self.words.hashes, np.uint64)
        if self.level == 1:
            names, states = [b""], np.zeros(1, np.uint64)
        elif self.level == 2:
            names, states = words, hashes
        else:
            rows = np.frombuffer(b"".join(self.prefixes), np.int32).reshape(-1, self.level - 1)
            names = [b" ".join([words[i] for i in r]) for r in rows.tolist()]
            states = hashes[rows[:, 0]]
            for j in range(1, rows.shape[1]):
                states = _chain(states, hashes[rows[:, j]])
        shards = np.array([FIRST_SHARDS if self.level == 1 else HOT_SHARDS if n in self.hot else 1 for n in names], np.int64)
        nxt, prefix = keys & 0xFFFFFFFF, keys >> 32
        shard = (hashes[nxt] >> np.uint64(40)).astype(np.int64) % shards[prefix]
        order = np.lexsort((shard, prefix))
        nxt, prefix, shard, counts = nxt[order], prefix[order], shard[order], counts[order].astype("<u4")
        first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (shard[1:] != shard[:-1])])
        ends = np.r_[first[1:], len(nxt)]
        vocabulary, titles = pa.array(words, pa.binary()), pa.array(names, pa.binary())
        step = 2048
        for lo in range(0, len(first), step):
            f, e = first[lo:lo + step], ends[lo:lo + step]
            offsets, own = (np.r_[f, e[-1]] - f[0]).astype(np.int32), prefix[f]
            lists = pa.ListArray.from_arrays(pa.array(offsets), vocabulary.take(pa.array(nxt[f[0]:e[-1]])))
            numbers = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(offsets * 4), pa.py_buffer(counts[f[0]:e[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([
                pa.array([self.lang] * len(f), pa.string()), titles.take(pa.array(own)).cast(pa.string()),
                pa.array(shard[f], pa.int32()), pa.array(states[own].view(np.int64)),
                pc.binary_join(lists, b" ").cast(pa.string()), numbers, pa.nulls(len(f), pa.string())], schema=_PARTIAL_ARROW)


def _slices(batches, slice_bytes):
    """(lang, stretch of joined texts) of bounded size; one text is never cut."""
    for b in batches:
        langs, texts = b.column(0).to_pylist(), text_bytes(b.column(1))
        held: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(langs, texts):
            if not text:
                continue
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= slice_bytes:
                for k, v in held.items():
                    yield k, _BREAK.join(v)
                held, size = {}, 0
        for k, v in held.items():
            yield k, _BREAK.join(v)


def _screen(sent, limit: int, slice_bytes: int, min_count: int):
    """Counts of pairs of frequent words by hash: one row per shard, sorted keys and capped counts."""
    kind = "<u1" if min_count <= 255 else "<u4"

    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        words: dict[str, _Words] = {}
        keys, counts, held = [], [], 0

        def merge():
            nonlocal keys, counts, held
            if keys:
                own, at = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, at, np.concatenate(counts))
                keys, counts, held = [own], [total], len(own)

        def rows():
            merge()
            if not keys or not len(keys[0]):
                return
            shard = (keys[0] >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            offsets = np.r_[first, len(shard)].astype(np.int32)
            low = keys[0].astype("<u4")
            capped = np.minimum(counts[0], np.iinfo(kind).max).astype(kind)
            blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets * x.itemsize), pa.py_buffer(x.tobytes())])
                     for x in (low, capped)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), *blobs], names=["shard", "keys", "counts"])

        for lang, blob in _slices(batches, slice_bytes):
            w = words.setdefault(lang, _Words(lang, bits))
            toks = blob.translate(_NORMAL).replace(_BREAK, b" \xff ").split()
            ids = np.fromiter(map(w.__getitem__, toks), np.int64, len(toks))
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            hashes = np.array(w.hashes, np.uint64)
            own, n = np.unique(_screened(_chain(hashes[ids[at]], hashes[ids[at + 1]])), return_counts=True)
            keys.append(own)
            counts.append(n)
            held += len(own)
            if held > 4 * limit:
                merge()
            if held > 2 * limit:
                yield from rows()
                keys, counts, held = [], [], 0
            if sum(map(len, words.values())) > limit:
                words = {}
        yield from rows()
    return run


def _screen_merger(min_count: int):
    """Hashes of the pairs that reach ``min_count``, from partial counts sorted by shard."""
    kind = "<u1" if min_count <= 255 else "<u4"

    def run(batches):
        now, keys, counts, held = None, [], [], 0

        def merge():
            nonlocal keys, counts, held
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(own), np.int64)
            np.add.at(total, at, np.concatenate(counts))
            keys, counts, held = [own], [total], len(own)

        def done():
            merge()
            full = keys[0][counts[0] >= min_count].astype(np.uint64) | np.uint64(now << 32)
            return pa.RecordBatch.from_arrays([pa.array(_spread(full).view(np.int64))], names=["h"])

        for b in batches:
            for shard, k, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if shard != now and now is not None:
                    yield done()
                    keys, counts, held = [], [], 0
                now = shard
                keys.append(np.frombuffer(k, "<u4"))
                counts.append(np.frombuffer(c, kind).astype(np.int64))
                held += len(keys[-1])
                if held > 8 * MAX_ENTRIES:
                    merge()
        if now is not None:
            yield done()
    return run


def _counter(level: int, sent, pairs, hot: frozenset, limit: int, slice_bytes: int):
    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8) if sent is not None else None
        seen = np.frombuffer(pairs.value, np.uint8) if pairs is not None else None
        own: dict[str, _Stripes] = {}
        for lang, blob in _slices(batches, slice_bytes):
            s = own.get(lang)
            if s is None:
                s = own[lang] = _Stripes(lang, level, bits, seen, hot, limit)
            runs = s.add(blob)
            if runs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), *[pa.nulls(1, f.type) for f in _PARTIAL_ARROW][1:-1],
                     pa.array([runs], pa.binary()).cast(pa.string())], schema=_PARTIAL_ARROW)
            if s.full() or sum(x.held + len(x.words) for x in own.values()) > 4 * limit:
                for x in own.values():                   # written in parts; merged later
                    yield from x.rows()
                own = {}
        for s in own.values():
            yield from s.rows()
    return run


def _merger(min_count: int, keep_all: bool):
    """Merge sorted partial stripes elementwise; the last one of a batch waits for the next."""
    out_schema = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("total", pa.int64()),
                            ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])

    def emit(keys, group, words, counts):
        """Rows of the groups 0..len(keys)-1; entries come sorted by group."""
        total = np.bincount(group, counts, len(keys)).astype(np.int64) if counts.sum() < 1 << 53 else \
            np.array([counts[group == g].sum() for g in range(len(keys))], np.int64)
        keep = counts >= min_count
        group, words, counts = group[keep], words.filter(pa.array(keep)), counts[keep]
        offsets = np.searchsorted(group, np.arange(len(keys) + 1)).astype(np.int32)
        seeds = [zlib.crc32(k[0].encode()) for k in keys]
        h = np.fromiter(map(xxhash.xxh64_intdigest, text_bytes(words), map(seeds.__getitem__, group.tolist())),
                        np.uint64, len(group))
        prefix = np.array([k[3] for k in keys], np.int64).view(np.uint64)
        empty = np.array([k[1] == "" for k in keys], bool)
        h = np.where(empty[group], h, _chain(prefix[group], h)).view(np.int64)
        lens = np.diff(offsets)
        at = np.flatnonzero((lens > 0) | keep_all)
        pick = pa.array(at)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (words, pa.array(counts), pa.array(h))]
        return pa.RecordBatch.from_arrays([
            pa.array([keys[i][0] for i in at], pa.string()), pa.array([keys[i][1] for i in at], pa.string()),
            pa.array(total[at]), *[x.take(pick) for x in lists]], schema=out_schema)

    def merged(group, words, counts):
        t = pa.table({"g": group, "w": words, "c": counts}).group_by(["g", "w"]).aggregate([("c", "sum")]).combine_chunks()
        g, c = t.column("g").to_numpy(), t.column("c_sum").to_numpy()
        order = np.argsort(g, kind="stable")
        w = t.column("w")
        w = w.chunk(0) if isinstance(w, pa.ChunkedArray) and w.num_chunks == 1 else pa.concat_arrays(w.chunks)
        return g[order], w.take(pa.array(order)), c[order]

    def run(batches):
        wait = None                                      # (key, words, counts)
        for b in batches:
            if not b.num_rows:
                continue
            names = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            keys, row = [], np.empty(len(names), np.int64)
            for i, k in enumerate(names):
                if not keys or keys[-1] != k:
                    keys.append(k)
                row[i] = len(keys) - 1
            lists = pc.split_pattern(b.column(4), " ")
            group = np.repeat(row, lists.value_lengths().to_numpy(zero_copy_only=False))
            words, c = lists.flatten(), np.frombuffer(b"".join(b.column(5).to_pylist()), "<u4").astype(np.int64)
            if wait is not None:
                if wait[0] == keys[0]:
                    group, words, c = np.r_[np.zeros(len(wait[2]), np.int64), group], pa.concat_arrays([wait[1], words]), np.r_[wait[2], c]
                else:
                    yield emit([wait[0]], np.zeros(len(wait[2]), np.int64), wait[1], wait[2])
            group, words, c = merged(group, words, c)
            cut = int(np.searchsorted(group, len(keys) - 1))
            if len(keys) > 1:
                yield emit(keys[:-1], group[:cut], words.slice(0, cut), c[:cut])
            wait = (keys[-1], words.slice(cut), c[cut:])
        if wait is not None:
            yield emit([wait[0]], np.zeros(len(wait[2]), np.int64), wait[1], wait[2])
    return run


def _filter_bits(phrases: DataFrame, column: str, n: int) -> bytes:
    """Bitmap of the phrases' hashes, two bits each, by Spark's bitmap aggregates (bounded size)."""
    size = 1 << 15
    while size < 16 * n and size < MAX_FILTER_BITS:
        size *= 2
    h = F.col(column)
    at = phrases.select(F.explode(F.array(
        h.bitwiseAND(F.lit(0x7FFFFFFF)) % size,
        F.shiftright(h, 32).bitwiseAND(F.lit(0x7FFFFFFF)) % size)).alias("at")).select((F.col("at") + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    out = bytearray(size // 8)
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = r["m"]
    return bytes(out)


def stripes(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
            max_words: int = MAX_WORDS, max_entries: int = MAX_ENTRIES, slice_bytes: int = SLICE_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, and (lang, n).

    Level ``k`` holds (lang, phrase, prefix, suffix, a, firsts, rests): the
    counts of the first 1..k words and of the last k-1..1 words.
    """
    sc = docs.sparkSession.sparkContext
    corpus = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    levels: list[DataFrame] = []
    sent = totals = None
    hot: frozenset = frozenset()
    for k in range(1, max_words + 1):
        pairs = None
        if k == 2:
            seen = corpus.mapInArrow(_screen(sent, max_entries, slice_bytes, min_count), "shard int, keys binary, counts binary")
            seen = materialize(seen.repartition("shard").sortWithinPartitions("shard").mapInArrow(
                _screen_merger(min_count), "h long"), "stripes-screen")
            pairs = sc.broadcast(_filter_bits(seen, "h", seen.count()))
        part = corpus.mapInArrow(_counter(k, sent, pairs, hot, max_entries, slice_bytes), PARTIAL)
        if k > 1:                                        # read twice: stripes and runs
            part = materialize(part, f"stripes-part-{k}")
        found = part.where("runs is null").select("lang", "prefix", "shard", "ph", "nexts", "counts")
        keys = ["lang", "prefix", "shard", "ph"]
        merged = materialize(found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
            _merger(min_count, k == 1), STRIPES), f"stripes-{k}")
        for old in (sent, pairs):
            if old is not None:
                old.destroy()
        entry = F.explode(F.arrays_zip("nexts", "counts", "hashes")).alias("e")
        if k == 1:
            totals = materialize(merged.groupBy("lang").agg(F.sum("total").alias("n")), "stripes-totals")
            n_words = totals.agg(F.sum("n")).first()[0] or 0
            level = merged.select("lang", entry).select(
                "lang", F.col("e.nexts").alias("phrase"), F.lit("").alias("prefix"), F.lit("").alias("suffix"),
                F.col("e.counts").alias("a"), F.array("e.counts").alias("firsts"),
                F.array().cast("array<bigint>").alias("rests"), F.col("e.hashes").alias("h"))
        else:
            last = levels[-1]
            ahead = last.select("lang", F.col("phrase").alias("prefix"), F.col("firsts").alias("before"))
            behind = last.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("tail"), F.col("rests").alias("after"))
            level = merged.join(ahead, ["lang", "prefix"]).select("lang", "prefix", "before", entry).select(
                "lang", "prefix", "before", F.concat_ws(" ", "prefix", "e.nexts").alias("phrase"),
                F.col("e.counts").alias("a"), F.col("e.hashes").alias("h")) \
                .withColumn("suffix", F.expr("substring(phrase, instr(phrase, ' ') + 1)")) \
                .join(behind, ["lang", "suffix"]).select(
                    "lang", "phrase", "prefix", "suffix", "a", F.concat("before", F.array("a")).alias("firsts"),
                    F.concat(F.array("tail"), "after").alias("rests"), "h")
        level = materialize(level, f"stripes-phrases-{k}")
        levels.append(level)
        n = level.count()
        if not n or k == max_words:
            break
        sent = sc.broadcast(_filter_bits(level, "h", n))
        common = level.where(F.col("a") * HOT >= n_words).select("lang", "phrase")       # at most HOT rows
        hot = frozenset((r["lang"], r["phrase"]) for r in common.collect())
        if k >= 2:
            corpus = part.where("runs is not null").select("lang", F.col("runs").alias("text"))
    return levels, totals


def _best_cut() -> str:
    """Least score over the cuts, the first of equal ones; exact in 38 digits."""
    wide = "cast({} as decimal(19,0))"
    left, right = "firsts[j - 1]", "rests[j - 1]"
    score = (f"({wide.format('a')} * {wide.format('n')} * cast(1000 as decimal(4,0))) div "
             f"({wide.format(left)} * {wide.format(right)})")
    return (f"array_min(transform(sequence(1, size(rests)), j -> "
            f"named_struct('score', {score}, 'j', j, 'l', {left}, 'r', {right})))")


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
         max_words: int = MAX_WORDS, top: int = TOP, **limits) -> DataFrame:
    """The best ``top`` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    ``limits`` (``max_entries``, ``slice_bytes``) bound what a task holds; they never change the rows.
    """
    from functools import reduce

    from pyspark.sql import Window
    levels, totals = stripes(docs, text_col=text_col, lang_col=lang_col, min_count=min_count, max_words=max_words, **limits)
    kept = []
    for i, level in enumerate(levels[1:], 1):
        if i + 1 < len(levels):
            longer = levels[i + 1]
            most = longer.select("lang", F.col("prefix").alias("phrase"), F.col("a").alias("longer")) \
                .unionByName(longer.select("lang", F.col("suffix").alias("phrase"), F.col("a").alias("longer"))) \
                .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            level = level.join(most, ["lang", "phrase"], "left").where("longer is null or longer < a")
        kept.append(level.select("lang", "phrase", "a", "firsts", "rests"))
    if not kept:
        kept = [levels[0].select("lang", "phrase", "a", "firsts", "rests").limit(0)]
    scored = reduce(DataFrame.unionByName, kept).join(totals, "lang").withColumn("cut", F.expr(_best_cut()))
    rows = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                         F.col("cut.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= top).drop("_r")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""WITH p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 100),
s AS (SELECT DISTINCT lang, sub, a FROM (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS sub FROM (
    SELECT lang, w, a, m, unnest(generate_series(1, len(w) - m + 1)) AS i
    FROM (SELECT lang, w, a, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2)))),
d AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = c.lang AND s.sub = c.phrase AND 100 * s.a >= 100 * c.a)),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:k], ' ') AS p2
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM d)),
sc AS (SELECT cuts.lang, cuts.phrase, cuts.a, cuts.j, f1.a AS l, f2.a AS r, n.n,
    (CAST(1000 AS HUGEINT) * cuts.a * n.n) // (CAST(f1.a AS HUGEINT) * f2.a) AS score
  FROM cuts JOIN f f1 ON f1.lang = cuts.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = cuts.lang AND f2.phrase = p2
  JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000"""
