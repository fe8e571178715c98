"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become integers (``floor(256 * x)``).  Rows are dealt into blocks of
bounded size by a hash of their id, anchors into blocks of their own, and a
task meets one block of each.  In a block every dimension has its list of
candidates sorted by component.  An anchor walks all lists at once, from the
top where its own component is positive and from the bottom where it is
negative (sorted access); every row met for the first time is scored whole
(random access, exact integers); the products of the anchor's components with
the last ones read add up to the threshold, which no row unmet can exceed.  A
window is closed once the threshold falls *strictly* below its k-th score (a
tie could still win by its id) or below the least score it admits, and the
walk ends when all windows are closed.

Two such searches follow each other: the best rows of the anchor's label (its
positives), then, for each positive, the best rows of other labels whose score
lies in the window that the positive's score sets.  Block winners are merged
by (score, id); only k rows per anchor, window and block are ever shuffled.

The pairs (anchor block, row block) are the stated query set against all rows;
rows and anchors are copied once per block of the other side, and nothing is
collected: any label may hold most rows.

Edge cases: a row with a NULL id, label, vector or component, or one that is
not finite, takes no part; of several rows with one id, the least (label,
vector) takes part; a vector shorter than the longest one counts as followed
by zeros; an anchor of zeros meets every row; scores that pass 62 bits are an
error; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95                 # per cent of the positive's score
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 512
FIRST_STEP = 64                    # rows read from every list at first; doubled each time


def quantize(rows: DataFrame, *, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, x): rows that take part, one per id, components as integers."""
    v, x = F.col("v"), F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    r = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)))
    return r.groupBy("id").agg(F.min(F.struct("label", x.alias("x"))).alias("r")).select("id", "r.label", "r.x")


class Lists:
    """A block's rows with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(x, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(x, order, 0).T)

    def walk(self, anchor: np.ndarray):
        """(rows met for the first time, their scores, threshold for all others), deeper and deeper."""
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        n = len(self.ids)
        if not len(up) and not len(down):
            yield np.arange(n), self.x @ anchor, -np.inf
            return
        seen, at, step = np.zeros(n, bool), 0, FIRST_STEP
        while at < n:
            to = min(n, at + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - to:n - at].ravel()] = True
            met[self.order[down, at:to].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            threshold = self.sorted[up, n - to] @ anchor[up] + self.sorted[down, to - 1] @ anchor[down]
            yield new, self.x[new] @ anchor, threshold if to < n else -np.inf
            at, step = to, 2 * step


def top_windows(lists: Lists, anchor: np.ndarray, windows: list[tuple], k: int, allowed: np.ndarray | None = None):
    """For each (least, largest) score, the rows and scores of its first ``k`` by (score, id)."""
    found = [(np.zeros(0, np.int64), np.zeros(0, lists.x.dtype)) for _ in windows]
    open_ = [i for i, (lo, hi) in enumerate(windows) if lo <= hi]
    for rows, scores, threshold in lists.walk(anchor) if open_ else ():
        if allowed is not None:
            keep = allowed[rows]
            rows, scores = rows[keep], scores[keep]
        still = []
        for i in open_:
            lo, hi = windows[i]
            keep = (scores >= lo) & (scores <= hi)
            r, s = np.concatenate([found[i][0], rows[keep]]), np.concatenate([found[i][1], scores[keep]])
            if len(s) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                r, s = r[s >= kth], s[s >= kth]
                if len(s) > k:                           # ties go by id
                    first = np.lexsort((lists.ids[r], -s))[:k]
                    r, s = r[first], s[first]
            found[i] = r, s
            if threshold >= lo and not (len(s) >= k and threshold < s.min()):
                still.append(i)
        open_ = still
        if not open_:
            break
    return found


def _matrix(column, width: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), width)


def _exact(x: np.ndarray, anchors: np.ndarray):
    """Both sides in a type that holds every score: doubles below 2^53 (fast products), else 64-bit integers."""
    if not x.size or not anchors.size:
        return x, anchors
    most = x.shape[1] * max(int(x.max()), -int(x.min())) * max(int(anchors.max()), -int(anchors.min()))
    if most >= 1 << 62:
        raise ValueError("scores of these vectors pass 62 bits")
    return (x.astype(np.float64), anchors.astype(np.float64)) if most < 1 << 53 else (x, anchors)


def _positives(width: int, k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(rows) and len(anchors):
            x, a = _exact(_matrix(rows.column("x"), width), _matrix(anchors.column("x"), width))
            ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            a_ids, a_labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
            for label in np.unique(a_labels):
                own = np.flatnonzero(labels == label)
                if not len(own):
                    continue
                lists = Lists(ids[own], x[own])
                for i in np.flatnonzero(a_labels == label):
                    (r, s), = top_windows(lists, a[i], [(-np.inf, np.inf)], k, lists.ids != a_ids[i])
                    out[0].append(np.full(len(r), a_ids[i]))
                    out[1].append(lists.ids[r])
                    out[2].append(s.astype(np.int64))
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out],
                        names=["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(width: int, k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if len(rows) and len(anchors):
            x, a = _exact(_matrix(rows.column("x"), width), _matrix(anchors.column("x"), width))
            lists, labels = Lists(rows.column("id").to_numpy(), x), rows.column("label").to_numpy()
            a_ids, a_labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
            other = {label: labels != label for label in np.unique(a_labels)}
            for i, wanted in enumerate(anchors.column("positives").to_pylist()):
                limits = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in wanted]
                for p, (r, s) in zip(wanted, top_windows(lists, a[i], limits, k, other[a_labels[i]])):
                    out[0].append(np.full(len(r), a_ids[i]))
                    out[1].append(np.full(len(r), p["positive_id"]))
                    out[2].append(np.full(len(r), p["positive_score"]))
                    out[3].append(lists.ids[r])
                    out[4].append(s.astype(np.int64))
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out],
                        names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


def _first(df: DataFrame, group: list[str], score: str, by: str, k: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(by))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mine(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         relabel=None, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``relabel(id, label)`` may change the labels first.
    """
    r = quantize(rows, id_col=id_col, vec_col=vec_col, label_col=label_col)
    if relabel is not None:
        r = r.withColumn("label", relabel(F.col("id"), F.col("label")).cast("long"))
    r = materialize(r, "hard-negative-rows")
    is_anchor = F.col("id") % anchor_every == 0
    size = r.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("a"), F.max(F.size("x")).alias("w")).first()
    width = size["w"] or 0
    n_rows, n_anchors = max(1, -(-size["n"] // block_rows)), max(1, -(-size["a"] // block_anchors))
    x = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    every = r.select("id", "label", x.alias("x"))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    blocks = every.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int")).withColumn("ab", numbers(n_anchors))
    asked = every.where(is_anchor).withColumn("ab", F.pmod(F.xxhash64("id"), F.lit(n_anchors)).cast("int"))

    def meet(anchors, task, schema):
        own = anchors.withColumn("rb", numbers(n_rows))
        return blocks.groupBy("rb", "ab").cogroup(own.groupBy("rb", "ab")).applyInArrow(task, schema)

    near = meet(asked, _positives(width, positives), "anchor_id long, positive_id long, positive_score long")
    near = _first(near, ["anchor_id"], "positive_score", "positive_id", positives, "_rank")
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    armed = materialize(asked.join(lists, asked["id"] == lists["anchor_id"]).drop("anchor_id"), "hard-negative-anchors")
    far = meet(armed, _negatives(width, negatives, low, high),
               "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank") \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
    ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id
WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""
