"""Toxicity: a counterfactually regularised word classifier.

A logistic model over the distinct words of a text and their beginnings (a
stem marks a word whatever its ending) is fitted with an L1 penalty and a
counterfactual penalty: in labelled sentences that mention an
identity term, the term is swapped for another of its group (and blanked), and
the change of the score is penalised.  Weight on the mention of a group
therefore shrinks, and neutral mentions are not flagged.

Word statistics and sentence pairs are gathered by Spark from a bounded sample
of the labelled rows (``max_train_rows``, chosen by a hash of the id); the fit
itself is a few hundred vector steps over at most ``max_train_rows`` sparse
rows and ``max_features`` words.  Scoring is one narrow pass over whole texts
with the non-zero weights (at most ``max_features``) broadcast.

Edge cases: NULL and empty texts have no words and get the intercept's score;
NULL labels are not used; repeated rows are judged one by one; without labels of
both kinds the score is a constant below the threshold (a smoothed prior); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import free_name, materialize

MAX_TRAIN_ROWS = 20_000
MAX_FEATURES = 8_192
MIN_DOCS = 4
STEMS = range(3, 9)               # lengths of the beginnings
MEMORY_WORDS = 100_000            # words whose features a task remembers
THRESHOLD = 0.7

# --- fixed values: identity terms by group (swapped within a group)
IDENTITY = {
    "gender": "women men woman man girls boys female male frauen männer femmes hommes mujeres hombres".split(),
    "religion": "muslim christian jewish hindu buddhist atheist muslims christians jews hindus muslime "
                "christen juden musulmans chrétiens juifs musulmanes cristianos judíos".split(),
    "origin": "african asian european american mexican arab immigrant immigrants refugee refugees "
              "ausländer flüchtlinge immigrés réfugiés inmigrantes refugiados".split(),
    "colour": "black white brown".split(),
    "orientation": "gay lesbian straight bisexual transgender homosexual heterosexual queer".split(),
    "age_ability": "old young elderly disabled blind deaf".split(),
}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def parts_of(word: str) -> list[str]:
    """A word's features: itself, and its proper beginnings (marked by a trailing hyphen)."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def features_of(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in parts_of(w)}


def swaps(text: str | None, groups: dict) -> list[tuple[str, str]]:
    """(term, replacement) of every identity mention, sentence by sentence; "" blanks the term."""
    if not text:
        return []
    place = {w: (g, i) for g, ws in groups.items() for i, w in enumerate(ws)}
    out = []
    for s in _SENTENCE.split(text.lower()):
        for w in set(_WORD.findall(s)) & place.keys():
            g, i = place[w]
            out += [(w, groups[g][(i + 1) % len(groups[g])]), (w, "")]
    return out


class Model:
    """Intercept and the non-zero feature weights."""

    def __init__(self, intercept: float, weights: dict[str, float]):
        self.intercept, self.weights = intercept, weights
        self.seen: dict[str, tuple] = {}              # word -> its features that have a weight

    def score(self, text: str | None) -> float:
        seen, w = self.seen, self.weights
        if len(seen) > MEMORY_WORDS:
            seen.clear()
        found: set[str] = set()
        for x in words_of(text):
            got = seen.get(x)
            if got is None:
                got = seen[x] = tuple(f for f in parts_of(x) if f in w)
            found.update(got)
        z = self.intercept + math.fsum(w[f] for f in found)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def fit(rows: list[tuple[int, np.ndarray]], vocab: list[str], pairs: list[tuple[str, str, int]], *,
        l1: float = 2e-4, l2: float = 1e-6, counterfactual: float = 1.0, steps: int = 400, rate: float = 0.5) -> Model:
    """Proximal AdaGrad on mean log loss + L1 + L2 + counterfactual penalty.

    rows: (label, indices of the words present); pairs: (term, replacement, sentences).
    """
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = 0.05
        return Model(math.log(p / (1 - p)), {})
    idx = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, int)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = {w: i for i, w in enumerate(vocab)}
    # What a swap takes out and puts in: the two words' features, as rows of a sparse matrix.
    which, col, sign, n = [], [], [], []
    for a, b, times in pairs:
        out, into = {at[f] for f in parts_of(a) if f in at}, {at[f] for f in parts_of(b) if f in at}
        if out != into:
            moved = [(i, 1.0) for i in out - into] + [(i, -1.0) for i in into - out]
            which += [len(n)] * len(moved)
            col += [i for i, _ in moved]
            sign += [x for _, x in moved]
            n.append(times)
    which, col, sign, n = np.array(which, int), np.array(col, int), np.array(sign), np.array(n, float)
    n = n / max(1.0, n.sum())
    prior = y.mean()
    bias, w = math.log(prior / (1 - prior)), np.zeros(len(vocab))
    g2, b2 = np.zeros(len(vocab)), 0.0
    for _ in range(steps):
        z = bias + np.bincount(row, w[idx], len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        grad = np.bincount(idx, err[row], len(vocab)) + l2 * w
        if len(n):
            change = np.bincount(which, sign * w[col], len(n))
            grad += counterfactual * np.bincount(col, sign * (n * change)[which], len(vocab))
        g2 += grad * grad
        step = rate / (np.sqrt(g2) + 1e-8)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        gb = float(err.sum())
        b2 += gb * gb
        bias -= rate * gb / (math.sqrt(b2) + 1e-8)
    return Model(float(bias), {vocab[i]: float(w[i]) for i in np.flatnonzero(w)})


def _small(batches, rows: int = 128):
    """Batches of few texts: a text gives thousands of features, and lists of them must stay short."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def train(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
          max_train_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS,
          groups: dict | None = None, **fit_options) -> Model:
    """Fit on a bounded sample of labelled rows (id, text, label)."""
    groups = IDENTITY if groups is None else groups
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                           F.col(label_col).cast("int").alias("y")).filter("y is not null")
    total = rows.count()
    share = min(1.0, max_train_rows / max(1, total))
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
    picked = materialize(picked, "toxicity-sample")

    def word_rows(batches):
        for b in _small(batches):
            words, ys = [], []
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ws = features_of(t)
                words += ws
                ys += [y] * len(ws)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "y": pa.array(ys, pa.int32())})

    def swap_rows(batches):
        for b in _small(batches):
            got = [p for t in b.column(1).to_pylist() for p in swaps(t, groups)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in got], pa.string()),
                                              "b": pa.array([p[1] for p in got], pa.string())})

    y_total = picked.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, pos = y_total["n"], y_total["y"] or 0
    rate = pos / n if n else 0.0
    # The words whose share of toxic texts differs most from the mean, in standard errors.
    df = picked.mapInArrow(word_rows, "word string, y int").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("y").alias("y")).filter(F.col("n") >= min_docs)
    z = F.abs(F.col("y") - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
    vocab = [r[0] for r in df.orderBy(z.desc(), F.col("word")).limit(max_features).select("word").collect()]
    pairs = [tuple(r) for r in picked.mapInArrow(swap_rows, "a string, b string")
             .groupBy("a", "b").count().collect()]                    # at most two per identity term
    vocab += sorted({f for a, _, _ in pairs for f in parts_of(a)} - set(vocab))
    index = picked.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocab)})

    def encode(batches):
        for b in _small(batches):
            known = index.value
            out = [sorted(known[w] for w in features_of(t) & known.keys()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b.column(2), "x": pa.array(out, pa.list_(pa.int32()))})

    got = picked.mapInArrow(encode, "y int, x array<int>").toArrow()          # bounded by max_train_rows
    flat = got.column("x").combine_chunks()
    if hasattr(flat, "chunks"):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.list_(pa.int32()))
    values, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
    data = [(int(y), values[ends[i]:ends[i + 1]]) for i, y in enumerate(got.column("y").to_pylist())]
    index.unpersist()
    return fit(data, vocab, pairs, **fit_options)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score column (0 to 1), and that column's name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    name = free_name(docs, "toxicity")
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in _small(batches):
            s = [shared.value.score(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(c.cast(f.type) for c, f in zip(b.columns, arrow)), pa.array(s, pa.float64())], schema=arrow)
        shared.value.seen.clear()                     # the worker lives on in later stages

    return docs.mapInArrow(run, schema), name


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, training=None,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``; their columns come back.

    ``training``: a condition on the id column that says which rows may be learnt from.
    """
    lab = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label_y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(lab, F.col("id") == F.col("label_id")).select("id", "text", "label_y")
    if training is not None:
        joined = joined.filter(training(F.col("id")))
    model = train(joined, id_col="id", text_col="text", label_col="label_y", **options)
    scored, name = score(docs, model, text_col=text_col)
    return scored.filter(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
