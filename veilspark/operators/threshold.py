"""Exact nearest neighbour within a radius, pruned by pivots.

A cache hit needs a distance below a cutoff, so most pairs need no distance at
all.  ``pivots`` stored vectors (far from each other, chosen in a bounded
sample) give every vector its distances to them.  By the triangle inequality
two vectors within ``radius`` differ by at most ``radius`` in each of these
distances, so a pair that differs by more in any one is skipped; only the
others are measured.  The result is exact whatever the pivots are.

Two placements of one kernel:

* distinct stored vectors that fit ``max_bytes`` (measured as fetched) are
  broadcast, and the probes are read without a shuffle;
* more of them meet the probes in cells: the bucket numbers of the distances
  to the first ``CELL_PIVOTS`` pivots.  A stored vector lies in one cell, a
  probe visits the few cells that its radius touches, and cells are dealt in
  salted groups of bounded size, however full one cell is.

Stored copies of one vector are one candidate (the least id), so a large
group of copies costs one comparison.  Ties go by distance (to nine decimals),
then id.  NULL vectors are skipped; another length than ``dim`` is an error.
"""

from __future__ import annotations

import itertools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.operators.search import DIGITS, score
from veilspark.session import shared_path

PIVOTS = 16
CELL_PIVOTS = 4
SAMPLE = 1024                 # stored vectors among which the pivots are chosen
MAX_BYTES = 32 << 20
TILE_PAIRS = 1 << 20

FOUND = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()),
                      T.StructField("distance", T.DoubleType()), T.StructField("compared", T.LongType())])


def _matrix(column, dim: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = c.value_lengths().to_numpy(zero_copy_only=False)
    if not (lens == dim).all():
        raise ValueError(f"vectors must have {dim} values, found {sorted(set(lens.tolist()))}")
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), dim)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


class Stored:
    """Candidates ordered by their distance to the first pivot."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray):
        order = np.lexsort((ids, near[:, 0]))
        self.ids, self.x, self.near = ids[order], x[order], near[order]

    def nearest(self, q: np.ndarray, near: np.ndarray, radius: float):
        """Per probe: position of the nearest candidate within ``radius`` or -1, its distance, pairs measured."""
        n, reach = len(q), radius + 1e-9
        best, dist, compared = np.full(n, -1), np.full(n, np.inf), np.zeros(n, np.int64)
        first = self.near[:, 0]
        lo, hi = np.searchsorted(first, near[:, 0] - reach), np.searchsorted(first, near[:, 0] + reach, "right")
        size = hi - lo
        cut = 0
        while cut < n:
            total = np.cumsum(size[cut:])
            to = cut + max(1, int(np.searchsorted(total, TILE_PAIRS, "right")))
            own = np.arange(cut, to)
            cut = to
            # One probe may meet more candidates than a tile holds: its candidates come in parts.
            widest = int(size[own].max()) if len(own) else 0
            for part in range(0, widest, TILE_PAIRS):
                a, b = np.minimum(lo[own] + part, hi[own]), np.minimum(lo[own] + part + TILE_PAIRS, hi[own])
                some = b - a
                p = np.repeat(own, some)
                s = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(a, some)
                for j in range(1, self.near.shape[1]):
                    keep = np.abs(near[p, j] - self.near[s, j]) <= reach
                    p, s = p[keep], s[keep]
                compared += np.bincount(p, minlength=n)
                d = np.empty(len(p))
                for i in range(0, len(p), 1 << 15):
                    d[i:i + (1 << 15)] = np.sqrt(((self.x[s[i:i + (1 << 15)]] - q[p[i:i + (1 << 15)]]) ** 2).sum(1))
                keep = d <= reach
                p, s, d = p[keep], s[keep], d[keep]
                held = np.flatnonzero(best[own] >= 0) + own[0] if len(own) else own
                p, s, d = np.r_[held, p], np.r_[best[held], s], np.r_[dist[held], d]
                order = np.lexsort((self.ids[s], np.round(d, DIGITS), p))
                lead = order[np.r_[True, p[order][1:] != p[order][:-1]]] if len(order) else order
                best[p[lead]], dist[p[lead]] = s[lead], d[lead]
        return best, dist, compared


def _rows(qid, stored: Stored, best, dist, compared) -> pa.RecordBatch:
    found = best >= 0
    ids = np.where(found, stored.ids[np.maximum(best, 0)], 0)
    return pa.RecordBatch.from_arrays([
        qid, pa.array(ids, pa.int64(), mask=~found), pa.array(np.where(found, dist, 0.0), mask=~found), pa.array(compared)],
        names=["qid", "id", "distance", "compared"])


def nearest_within(queries: DataFrame, collection: DataFrame, *, radius: float, dim: int, q_id: str = "qid",
                   q_vec: str = "embedding", c_id: str = "id", c_vec: str = "embedding", pivots: int = PIVOTS,
                   max_bytes: int = MAX_BYTES) -> DataFrame:
    """(qid, id, distance, compared): each probe's nearest stored vector within ``radius``.

    ``id`` and ``distance`` are NULL where there is none; ``compared`` is the
    number of distances measured for the probe.  Probes without a vector are absent.
    """
    spark = collection.sparkSession
    if not (radius >= 0 and math.isfinite(radius)):
        raise ValueError("radius must be finite and not negative")
    probes = queries.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).alias("vec"))
    distinct = collection.select(F.col(c_id).cast("long").alias("id"), F.col(c_vec).alias("vec")).where("vec is not null") \
        .groupBy("vec").agg(F.min("id").alias("id"))
    path = shared_path(spark, f"threshold/{uuid.uuid4().hex}")
    distinct.write.parquet(f"{path}/stored")
    distinct = spark.read.schema(distinct.schema).parquet(f"{path}/stored")
    sample = distinct.orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return probes.where("vec is not null").select("qid", F.lit(None).cast("long").alias("id"),
                                                      F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("compared"))
    p = choose_pivots(_matrix(sample.column("vec"), dim), pivots)
    most = max(1, max_bytes // (8 * (dim + len(p) + 1)))
    few = distinct.limit(most + 1).toArrow() if sample.num_rows == SAMPLE else sample
    if few.num_rows <= most:
        x = _matrix(few.column("vec"), dim)
        sent = spark.sparkContext.broadcast((few.column("id").to_numpy(), x, pivot_distances(x, p), p))

        def scan(batches):
            ids, x, near, p = sent.value
            stored = Stored(ids, x, near)
            for b in batches:
                b = b.filter(b.column("vec").is_valid())
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    q = _matrix(part.column("vec"), dim)
                    yield _rows(part.column("qid"), stored, *stored.nearest(q, pivot_distances(q, p), radius))

        return probes.mapInArrow(scan, FOUND)
    return _by_cells(probes, distinct, p, radius, dim, path, most)


def _by_cells(probes: DataFrame, distinct: DataFrame, p: np.ndarray, radius: float, dim: int, path: str, most: int) -> DataFrame:
    """Both sides placed in cells, cells in salted groups of at most about ``most`` rows."""
    spark = probes.sparkSession
    width = 2 * (radius + 1e-9) or 1e-9
    axes = min(CELL_PIVOTS, len(p))

    def place(reach: float, key: str):
        def run(batches):
            for b in batches:
                b = b.filter(b.column("vec").is_valid())
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    near = pivot_distances(_matrix(part.column("vec"), dim), p)
                    low = np.floor((near[:, :axes] - reach) / width).astype(np.int64).tolist()
                    high = np.floor((near[:, :axes] + reach) / width).astype(np.int64).tolist()
                    cells = [[",".join(map(str, c)) for c in itertools.product(*(range(a, z + 1) for a, z in zip(f, t)))]
                             for f, t in zip(low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(key), part.column("vec"), pa.array(near.tolist(), pa.list_(pa.float64())), pa.array(cells)],
                        names=[key, "vec", "near", "cells"])
        return run

    def placed(df, reach, key):
        schema = T.StructType([df.schema[key], df.schema["vec"], T.StructField("near", T.ArrayType(T.DoubleType())),
                               T.StructField("cells", T.ArrayType(T.StringType()))])
        df.select(key, "vec").mapInArrow(place(reach, key), schema).write.parquet(f"{path}/{key}")
        return spark.read.schema(schema).parquet(f"{path}/{key}").select(key, "vec", "near", F.explode("cells").alias("cell"))

    asked, held = placed(probes, radius + 1e-9, "qid"), placed(distinct, 0.0, "id")
    cells = held.groupBy("cell").agg(F.count("*").alias("n_c")).join(
        asked.groupBy("cell").agg(F.count("*").alias("n_q")), "cell") \
        .select("cell", F.ceil(F.col("n_c") / most).cast("int").alias("n_salt"), F.ceil(F.col("n_q") / most).cast("int").alias("n_blk"))
    left = asked.join(cells, "cell").select(
        "qid", "vec", "near", "cell", F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1)).alias("salt"),
        F.pmod(F.xxhash64("qid"), F.col("n_blk")).cast("int").alias("blk"))
    right = held.join(cells, "cell").select(
        "id", "vec", "near", "cell", F.pmod(F.xxhash64("id"), F.col("n_salt")).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("blk"))
    n_pivots = len(p)

    def meet(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if not len(qt) or not len(ct):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                             "distance": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        stored = Stored(ct.column("id").to_numpy(), _matrix(ct.column("vec"), dim), _matrix(ct.column("near"), n_pivots))
        got = stored.nearest(_matrix(qt.column("vec"), dim), _matrix(qt.column("near"), n_pivots), radius)
        return pa.Table.from_batches([_rows(qt.column("qid").combine_chunks(), stored, *got)])

    keys = ["cell", "salt", "blk"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)
    none = spark.read.parquet(f"{path}/qid").select("qid", F.lit(None).cast("long").alias("id"),
                                                    F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("compared"))
    best = F.min(F.when(F.col("id").isNotNull(), F.struct(F.round("distance", DIGITS).alias("r"), "id", "distance")))
    return met.unionByName(none).groupBy("qid").agg(best.alias("b"), F.sum("compared").alias("compared")) \
        .select("qid", "b.id", "b.distance", "compared")


def radius_of(threshold: float) -> float:
    """The distance at which :func:`score` reaches ``threshold`` (< 1)."""
    return -math.log1p(-threshold)


__all__ = ["nearest_within", "radius_of", "choose_pivots", "score"]
