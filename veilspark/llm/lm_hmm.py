"""Language-model scoring with a hidden Markov model.

Tokens are the text's words and one end token.  Every word belongs to a class:
the ``own`` most frequent training words have one each, all others share
``shared`` classes by hash.  A state emits a class, and a class its words:

    P(tokens) = sum over state paths  prod  A[s', s] * E[s, class(w)] * P(w | class)

Baum-Welch trains A, E and the start vector: each task runs scaled
forward-backward over its documents and returns expected counts, which are
added up across partitions block by block; only the finished sums (states x
classes, a fixed size) reach the driver.  All ``warm + full`` passes, like all
word counts, cover every training document; the texts are split into words
once, and the passes read their classes from a table.  For training, documents
are cut at ``SEGMENT`` tokens; scoring runs the scaled forward recursion over
whole texts.

Word counts are a table as large as the vocabulary.  The most frequent
``broadcast_words`` are broadcast (a fixed bound); the other words of a text
are joined with the table by a shuffle, and added up per document.

Edge cases: NULL and empty texts are one end token; repeated rows are scored
one by one (a row's key holds a running number); without training documents
all counts are zero and every word is unknown; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import LOWER_AZ, materialize, text_bytes

STATES = 8
OWN = 12_288
SHARED = 4_096
BROADCAST_WORDS = 262_144
WARM, FULL = 6, 2
SEGMENT = 512
CHUNK_TOKENS = 400_000
EM_TOKENS = 1_000_000          # tokens that a training task takes side by side, in single precision
COUNTER_WORDS = 400_000
BLOCKS = 64
END = b""                 # the end token; no word is empty


def tokens(text: bytes | None) -> list[bytes]:
    ws = text.translate(LOWER_AZ).split() if text else []
    ws.append(END)
    return ws


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over all texts (one column); counted in each task before the shuffle."""
    def run(batches):
        c: Counter = Counter()

        def out():
            words = list(c)
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()),
                                               "c": pa.array([c[w] for w in words], pa.int64())})
        for b in batches:
            for t in text_bytes(b.column(0)):
                c.update(tokens(t))
            if len(c) > COUNTER_WORDS:
                yield out()
                c.clear()
        yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Classes:
    """Word classes, and the counts that are broadcast with them.

    ``top``: the most frequent words with their counts, the first ``own`` of
    which have a class of their own.
    """

    def __init__(self, top: list[tuple[bytes, int]], own: int, shared: int):
        self.n_own, self.shared = min(own, len(top)), shared
        self.size = self.n_own + shared
        self.index = {w: i for i, (w, _) in enumerate(top[:own])}
        self.own_counts = np.array([c for _, c in top[:own]], np.int64)
        self.others = dict(top[own:])

    def of(self, words: list[bytes]) -> np.ndarray:
        """Class of each word."""
        return self._of(words)[0]

    def _of(self, words):
        c = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, count=len(words))
        at = np.flatnonzero(c < 0)
        rest = [words[i] for i in at.tolist()]
        c[at] = self.n_own + np.fromiter(map(zlib.crc32, rest), np.int64, count=len(rest)) % self.shared
        return c, at, rest

    def with_counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class and broadcast count (0: not broadcast) of each word."""
        c, at, rest = self._of(words)
        counts = np.zeros(len(words), np.int64)
        own = c < self.n_own
        counts[own] = self.own_counts[c[own]]
        counts[at] = np.fromiter(map(self.others.get, rest, repeat(0)), np.int64, count=len(rest))
        return c, counts


class Parameters:
    """start (K), move (K, K), emit (classes, K)."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit


def initial(class_counts: np.ndarray, states: int) -> Parameters:
    """Every state near the class frequencies, told apart by fixed noise; staying is likely."""
    rng = np.random.default_rng(7)
    p = (class_counts + 0.5) / (class_counts.sum() + 0.5 * len(class_counts))
    emit = p[:, None] * np.exp(rng.normal(0, 0.7, (len(p), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(0))


class _Packed:
    """Sequences laid out by time step, longest first, so that a step is one matrix product."""

    def __init__(self, seqs: list[np.ndarray]):
        size = np.array([len(s) for s in seqs])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        longest = int(size[0])
        self.live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")   # sequences with a step t
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        doc = np.repeat(np.arange(len(seqs)), size)
        t = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        where = self.at[t] + doc
        self.obs = np.empty(len(doc), np.intp)    # numpy's own index type: others are converted at each use
        self.obs[where] = np.concatenate([seqs[i] for i in self.order])
        self.doc = np.empty(len(doc), np.intp)
        self.doc[where] = doc


def _row_sums(a: np.ndarray) -> np.ndarray:
    """``a.sum(1)``; many rows of eight by adding columns, in the order in which numpy adds a row."""
    if a.shape[1] != 8 or len(a) < 128:
        return a.sum(1)
    a = a[:, 0::2] + a[:, 1::2]
    a = a[:, 0::2] + a[:, 1::2]
    return a[:, 0] + a[:, 1]


def forward(p: Parameters, packed: _Packed, keep: bool = True):
    """Scaled forward recursion: log10 likelihood by sequence (input order), and alpha, scale, emission rows."""
    e = p.emit.take(packed.obs, axis=0)
    alpha = np.empty_like(e) if keep else None
    scale = np.empty(len(e), e.dtype)
    a = p.start * e[:packed.live[0]]
    for t, n in enumerate(packed.live.tolist()):
        lo = packed.at[t]
        if t:
            a = (a[:n] @ p.move) * e[lo:lo + n]
        c = _row_sums(a)
        a = a / c[:, None]
        scale[lo:lo + n] = c
        if keep:
            alpha[lo:lo + n] = a
    by = np.bincount(packed.doc, np.log10(scale), len(packed.order))
    out = np.empty(len(by))
    out[packed.order] = by
    return out, alpha, scale, e


def expected(p: Parameters, packed: _Packed, start, move, emit) -> float:
    """Add the expected counts of the sequences to start, move and emit; log10 likelihood."""
    ll, alpha, scale, e = forward(p, packed)
    live, at, states = packed.live, packed.at, len(p.start)
    beta = np.ones((live[-1], states), e.dtype)
    for t in range(len(live) - 1, -1, -1):
        lo, n = at[t], live[t]
        w = e[lo:lo + n] * beta / scale[lo:lo + n, None]
        alpha_t = alpha[lo:lo + n]
        gamma = alpha_t * beta
        e[lo:lo + n] = gamma                       # the emission rows are not needed again
        if t:
            before = at[t - 1]
            move += p.move * (alpha[before:before + n].T @ w)
            beta = np.ones((live[t - 1], states), e.dtype)
            beta[:n] = w @ p.move.T
        else:
            start += gamma.sum(0)
    for k in range(states):
        emit[:, k] += np.bincount(packed.obs, e[:, k], len(emit))
    return float(ll.sum())


def encode(texts: DataFrame, classes) -> DataFrame:
    """(seq binary): the classes of every text's tokens as 32-bit numbers; ``classes`` is a broadcast."""
    def run(batches):
        c = classes.value
        for b in batches:
            yield pa.RecordBatch.from_pydict({"seq": pa.array(
                [c.of(tokens(t)).tobytes() for t in text_bytes(b.column(0))], pa.binary())})

    return texts.mapInArrow(run, "seq binary")


def _chunks(batches, segment: int | None):
    """Class sequences in chunks of about EM_TOKENS tokens."""
    seqs, n = [], 0
    for b in batches:
        for t in b.column(0).to_pylist():
            c = np.frombuffer(t, np.int32)
            for i in range(0, len(c), segment or len(c)):
                seqs.append(c[i:i + (segment or len(c))])
            n += len(c)
            if n >= EM_TOKENS:
                yield seqs
                seqs, n = [], 0
    if seqs:
        yield seqs


def em_step(encoded: DataFrame, p: Parameters, unigram: np.ndarray, smooth: float = 20.0):
    """One Baum-Welch pass over all given sequences (``encode``); without any, the parameters stay."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(p)
    size, states = p.emit.shape

    def run(batches):
        # Single precision for a pass's expected counts; they are added up in double.  Scoring is in double.
        q = Parameters(*(x.astype(np.float32) for x in (shared.value.start, shared.value.move, shared.value.emit)))
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        ll = 0.0
        for seqs in _chunks(batches, SEGMENT):
            ll += expected(q, _Packed(seqs), start, move, emit)
        head = np.concatenate([[ll], start, move.ravel()])
        parts = [head, *np.array_split(emit.ravel(), BLOCKS)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()),
                                          "v": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["v"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "v": [np.asarray(total).tobytes()]})

    # Two levels, so that no task adds up more than a share of the partitions.
    part = encoded.mapInArrow(run, "block int, v binary")
    some = part.withColumn("g", F.spark_partition_id() % 32).groupBy("block", "g").applyInPandas(
        lambda pdf: add(pdf), "block int, v binary")
    rows = {r[0]: np.frombuffer(bytes(r[1])) for r in some.groupBy("block").applyInPandas(
        add, "block int, v binary").collect()}
    shared.unpersist()
    if not rows:
        return p, 0.0
    head = rows[0]
    ll, start, move = head[0], head[1:1 + states], head[1 + states:].reshape(states, states)
    if not start.sum():                                # smoothing alone would make all states alike
        return p, 0.0
    emit = np.concatenate([rows[i] for i in range(1, BLOCKS + 1)]).reshape(size, states) + smooth * unigram[:, None]
    return Parameters((start + 0.1) / (start + 0.1).sum(),
                      (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(0)), float(ll)


class LanguageModel:
    """Trained parameters, word classes, the table of counts and the totals."""

    def __init__(self, params, classes, counts, total, vocabulary, class_log):
        self.params, self.classes, self.counts = params, classes, counts
        self.total, self.vocabulary, self.class_log = total, vocabulary, class_log


def train(texts: DataFrame, *, key=None, states: int = STATES, own: int = OWN, shared: int = SHARED,
          broadcast_words: int = BROADCAST_WORDS, warm: int = WARM, full: int = FULL) -> LanguageModel:
    """Train on one text column (``text``) by ``warm + full`` passes over all texts; ``key`` is not used any more."""
    spark = texts.sparkSession
    only = texts.select(F.col("text"))
    counts = materialize(count_words(only), "lm-counts")
    t = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(t["n"]), int(t["v"])
    # The words from the least frequency on at which they are at most ``broadcast_words``: found on a
    # histogram of log frequencies (a few thousand rows), so no task and no sort sees all words.
    level = F.floor(F.log2("c") * 32).cast("int")
    least, room = None, broadcast_words
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    found = counts.filter(level >= least).collect() if least is not None else []
    top = sorted(((bytes(r[0]), int(r[1])) for r in found), key=lambda x: (-x[1], x[0]))
    names = [w for w, _ in top[:own]]
    classes = Classes(top, own, shared)
    # Totals of the shared classes: everything but the words with a class of their own.
    rest = {r[0]: (int(r[1]), int(r[2])) for r in counts.groupBy((F.crc32("word") % shared).alias("h"))
            .agg(F.sum("c"), F.count("*")).collect()}                     # at most ``shared`` rows
    c_of, v_of = np.zeros(shared), np.zeros(shared)
    for h, (c, k) in rest.items():
        c_of[h], v_of[h] = c, k
    for w, c in top[:own]:
        h = zlib.crc32(w) % shared
        c_of[h] -= c
        v_of[h] -= 1
    class_counts = np.concatenate([[c for _, c in top[:own]], c_of])
    unigram = (class_counts + 0.5) / (class_counts.sum() + 0.5 * len(class_counts))
    class_log = np.concatenate([np.zeros(len(names)), np.log10(c_of + 0.5 * (v_of + 1))])
    params = initial(class_counts, states)
    sent = spark.sparkContext.broadcast(classes)
    encoded = materialize(encode(only, sent), "lm-classes")
    for _ in range(warm + full):
        params, _ = em_step(encoded, params, unigram)
    return LanguageModel(params, sent, counts, n, v, class_log)


def score(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; a row per input row."""
    from pyspark import TaskContext
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.params, model.class_log))
    sent = model.classes
    id_type = docs.schema[id_col].dataType.simpleString()
    # One pass scores every text and lists the words whose counts were not broadcast.
    schema = f"doc_id {id_type}, row long, n_tokens long, known long, base double, score double, words array<binary>"

    def run(batches):
        (params, class_log), classes = shared.value, sent.value
        n_own = classes.n_own
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, texts = b.column(0), text_bytes(b.column(1))
            lo = 0
            while lo < len(texts):
                hi, n, split = lo, 0, []
                while hi < len(texts) and (n < CHUNK_TOKENS * 2):
                    split.append(tokens(texts[hi]))
                    n += len(split[-1])
                    hi += 1
                found = [classes.with_counts(ws) for ws in split]
                ll = forward(params, _Packed([c for c, _ in found]), keep=False)[0]
                out = {"n": [], "known": [], "base": [], "score": [], "words": []}
                for ws, (c, got), s in zip(split, found, ll.tolist()):
                    known = got > 0
                    logs = np.log10(got[known] + 0.5)
                    out["n"].append(len(ws))
                    out["known"].append(int(known.sum()))
                    out["base"].append(float(logs.sum()))
                    out["score"].append(s - float(class_log[c].sum()) + float(logs[c[known] >= n_own].sum()))
                    out["words"].append([ws[i] for i in np.flatnonzero(~known).tolist()])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array(range(row, row + hi - lo), pa.int64()),
                    pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()),
                    pa.array(out["base"], pa.float64()), pa.array(out["score"], pa.float64()),
                    pa.array(out["words"], pa.list_(pa.binary()))],
                    names=["doc_id", "row", "n_tokens", "known", "base", "score", "words"])
                row += hi - lo
                lo = hi

    first = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                        .mapInArrow(run, schema), "lm-scores")
    words = first.select("row", F.explode("words").alias("word"))
    some = words.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("more_known"))
    base_total = math.log10(model.total + 0.5 * (model.vocabulary + 1))
    more = F.coalesce("more", F.lit(0.0))
    return first.drop("words").join(some, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("score") + more).alias("score"))
