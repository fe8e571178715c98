"""Exact k-nearest-neighbour search with metadata filters.

The collection is read once, as ``(id, vector, key)`` only; the k winners are
stored, and other columns are read for them by id.  One kernel does the search in both placements:

* probes whose vectors are proven to fit ``probe_bytes`` are broadcast and
  ``mapInArrow`` runs the kernel over the collection, without a shuffle;
* more probes meet the collection in salted groups (``cogroup``), both sides
  of a group bounded by ``probe_bytes``, however large one match key is.

The kernel keeps a running top-k per probe across its batches.  A matrix
product in tiles of bounded size gives distances up to a rounding error (in
single precision, where its range holds them); every row that may be among the k
nearest under that error is measured in double precision.  Order goes by ``DIGITS`` decimals, so that distances which are
equal but for the order of summation are ties.  Ties are always decided by id, and
the placements agree row for row.  Its memory depends on the probes and k, not on the number of batches.

A vector of another length than ``dim`` is an error; a NULL vector is skipped.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.fixed import DEFAULT_K
from veilspark.session import shared_path

PROBE_BYTES = 32 << 20
DIGITS = 9
TILE_CELLS = 1 << 19          # cells of one distance tile (2 MB in single precision, near a core's cache)
SINGLE = 1e30                 # squared lengths up to here are multiplied in single precision
SEED = 512                    # rows that give a probe its first limit
CLOSE = 16                    # a probe with more than CLOSE * k candidates in a tile has its limit tightened
BLOCK = 4096                  # collection rows of one key that are compared at a time
GROUP_ROWS = 1 << 15          # probes of a co-grouped part: a task's time is bounded, not only its memory
GROUP_TIMES = 8               # collection rows of such a part, for each of its probes: a probe is copied once per part


def score(distance: Column) -> Column:
    """F8: similarity score ``1 - exp(-|d|)``."""
    return F.lit(1.0) - F.exp(-F.abs(distance))


def metadata_contains(meta: Column, probe: dict | Column) -> Column:
    """``meta @> probe`` for a string map; an empty probe matches everything.

    A dict gives one ``meta[key] = value`` condition per entry.
    """
    if isinstance(probe, dict):
        cond = F.lit(True)
        for k, v in probe.items():
            cond = cond & (meta[F.lit(k)] == F.lit(str(v)))
        return F.coalesce(cond, F.lit(False))
    return F.coalesce(F.forall(F.map_entries(probe), lambda e: meta[e["key"]] == e["value"]),
                      F.lit(False))


def _key_expr(cols) -> Column:
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("")


def _make_search(k: int, metric: str, dim: int, tile_cells: int = TILE_CELLS, digits: int = DIGITS):
    """The kernel, as closures (they travel to the workers by value)."""
    unit, single, seed, tiny = 10.0 ** -digits, SINGLE, SEED, 1e-30

    def matrix(vectors):
        """float64 rows of an Arrow list column (no NULLs); other lengths are an error."""
        lens = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if not (lens == dim).all():
            raise ValueError(f"vectors must have {dim} values, found {sorted(set(lens.tolist()))}")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(vectors), dim)

    def ranks(ids):
        """Places of ids in their own order, whatever their type."""
        at = pc.array_sort_indices(ids).to_numpy()
        out = np.empty(len(at), np.int64)
        out[at] = np.arange(len(at))
        return out

    def first_k(who, dist, rank):
        """Positions of the k least (dist, rank) of each ``who``."""
        order = np.lexsort((rank, np.round(dist, digits), who))
        w = who[order]
        start = np.r_[0, np.flatnonzero(w[1:] != w[:-1]) + 1] if len(w) else np.zeros(0, int)
        place = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
        return order[place < k]

    class Best:
        """Running top-k of every probe."""

        def __init__(self, q):
            self.q, self.qn = q, (q * q).sum(1)
            self.kinds, self.seeded = {}, False
            self.bound = np.full(len(q), np.inf)            # exact distance of the k-th so far
            self.who, self.dist, self.ids = np.zeros(0, np.int64), np.zeros(0), None

        def kind(self, longest):
            """(type, c, left side) of the product with rows of squared lengths up to ``longest``.

            One product gives near - slack without the probe's own term: [-2q, 1] . [x, (1 - c) x.x]
            for l2, [-q, -c |q|] . [x, |x|] for inner; c covers the rounding of the type.
            """
            fits = max(longest, np.max(self.qn, initial=0.0, where=np.isfinite(self.qn))) <= single
            if fits not in self.kinds:
                t, c = (np.float32, 4e-7 * (dim + 8)) if fits else (np.float64, 1e-14 * (dim + 8))
                with np.errstate(over="ignore", invalid="ignore"):
                    left = np.c_[-2.0 * self.q, np.ones(len(self.q))] if metric == "l2" else \
                        np.c_[-self.q, -c * np.sqrt(self.qn)]
                    self.kinds[fits] = t, c, left.astype(t)
            return self.kinds[fits]

        def add(self, ids, x):
            """Offer rows ``x`` (with ``ids``, an Arrow array) to every probe."""
            if not self.seeded:                             # a few rows first: their limits spare the others most measuring
                self.seeded = True
                if len(x) > 2 * seed:
                    self.add(ids.slice(0, seed), x[:seed])
                    ids, x = ids.slice(seed), x[seed:]
            xn, rank = (x * x).sum(1), ranks(ids)
            finite = np.where(np.isfinite(xn), xn, np.nan)  # NaN compares false: such a row is nobody's neighbour
            kind, slack, left = self.kind(np.max(finite, initial=0.0, where=np.isfinite(xn)))
            with np.errstate(over="ignore", invalid="ignore"):
                right = np.c_[x, (1 - slack) * finite if metric == "l2" else np.sqrt(finite)].astype(kind).T
            step, some = max(1, tile_cells // max(1, len(x))), max(1, tile_cells // dim)
            who, row, dist = [], [], []
            for lo in range(0, len(self.q), step):
                p = slice(lo, lo + step)
                with np.errstate(invalid="ignore", over="ignore"):
                    near = left[p] @ right
                own = np.where(np.isfinite(self.qn[p]), self.qn[p], np.nan)
                if metric == "l2":
                    most = (self.bound[p] + unit) ** 2 * (1 + 1e-12) - (1 - slack) * own + tiny
                else:
                    most = self.bound[p] + unit + 0 * own + tiny
                with np.errstate(over="ignore"):
                    at = np.flatnonzero(near <= np.nextafter(most.astype(kind), kind(np.inf))[:, None])
                r, c = at // len(x), at % len(x)
                many = np.flatnonzero(np.bincount(r, minlength=len(near)) > CLOSE * k)
                if len(many):                               # a loose bound: the k-th of these rows is an upper limit too
                    own = own[many]
                    part = near[many].astype(np.float64)
                    wide = 2 * slack * (own[:, None] + finite[None, :]) if metric == "l2" else \
                        2 * slack * np.sqrt(own)[:, None] * np.sqrt(finite)[None, :]
                    kth = np.partition(part + wide, k - 1, axis=1)[:, k - 1]
                    if metric == "l2":
                        kth = (np.sqrt(np.maximum(kth + (1 + slack) * own, 0)) + unit) ** 2 * (1 + 1e-12) - (1 - slack) * own + tiny
                    else:
                        kth = kth + unit + tiny
                    limit = np.full(len(near), np.inf)
                    limit[many] = np.where(np.isnan(kth), np.inf, kth)
                    keep = near[r, c] <= limit[r]
                    r, c = r[keep], c[keep]
                r += lo
                d = np.empty(len(r))
                for i in range(0, len(r), some):
                    u, v = self.q[r[i:i + some]], x[c[i:i + some]]
                    d[i:i + some] = np.sqrt(((v - u) ** 2).sum(1)) if metric == "l2" else -(v * u).sum(1)
                keep = first_k(r, d, rank[c])
                who.append(r[keep])
                row.append(c[keep])
                dist.append(d[keep])
            if not sum(map(len, who)):
                return
            taken = ids.take(pa.array(np.concatenate(row)))
            self.who = np.concatenate([self.who, *who])
            self.dist = np.concatenate([self.dist, *dist])
            self.ids = taken if self.ids is None else pa.concat_arrays([self.ids, taken])
            keep = first_k(self.who, self.dist, ranks(self.ids))
            self.who, self.dist, self.ids = self.who[keep], self.dist[keep], self.ids.take(pa.array(keep))
            worst = np.full(len(self.q), -np.inf)
            np.maximum.at(worst, self.who, self.dist)
            done = np.bincount(self.who, minlength=len(self.q)) == k
            self.bound[done] = worst[done]

    return matrix, Best


def _by_broadcast(coll, probe, c_id, k, metric, dim, schema) -> DataFrame:
    """``probe``: Arrow table (qid, vec, mkey), bounded and without NULL vectors."""
    matrix, Best = _make_search(k, metric, dim)
    qids, keys = probe.column("qid").to_numpy(), np.asarray(probe.column("mkey").to_pylist(), dtype=object)
    q = matrix(probe.column("vec").combine_chunks()) if len(qids) else np.zeros((0, dim))
    # Probes by key: a key's rows meet, and are merged with, that key's probes only.
    groups = {key: (qids[at], q[at]) for key in set(keys.tolist()) for at in [np.flatnonzero(keys == key)]}
    sent = coll.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        groups = sent.value
        best, held, n_held = {}, {}, 0

        def compare(key):
            ids, x = zip(*held.pop(key))
            if key not in best:
                best[key] = Best(groups[key][1])
            ids, x = pa.concat_arrays(ids), np.concatenate(x)
            for lo in range(0, len(x), BLOCK):
                best[key].add(ids.slice(lo, BLOCK), x[lo:lo + BLOCK])
            return len(x)

        for rb in batches:
            rb = rb.filter(rb.column("vec").is_valid())
            if not rb.num_rows:
                continue
            x = matrix(rb.column("vec"))
            codes = rb.column("mkey").dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            for i, key in enumerate(codes.dictionary.to_pylist()):
                if key in groups:
                    at = np.flatnonzero(code == i)
                    held.setdefault(key, []).append((rb.column("id").take(pa.array(at)), x[at]))
                    n_held += len(at)
                    if sum(len(part) for part, _ in held[key]) >= BLOCK:
                        n_held -= compare(key)
            if n_held > 16 * BLOCK:                          # many keys: rows waiting are bounded too
                for key in list(held):
                    n_held -= compare(key)
        for key in list(held):
            compare(key)
        for key, b in best.items():
            if b.ids is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups[key][0][b.who], pa.int64()), b.ids, pa.array(b.dist)],
                    names=["qid", c_id, "distance"])

    return coll.select(F.col(c_id).alias("id"), "vec", "mkey").mapInArrow(run, schema)


def _by_groups(probes, coll, c_id, k, metric, dim, schema, group_rows) -> DataFrame:
    """Per match key parts of ``group_rows`` probes and GROUP_TIMES as many rows; a hot key is many groups."""
    matrix, Best = _make_search(k, metric, dim)
    keys = coll.groupBy("mkey").agg(F.count("*").alias("n_c")) \
        .join(probes.groupBy("mkey").agg(F.count("*").alias("n_q")), "mkey") \
        .select("mkey", F.ceil(F.col("n_c") / (group_rows * GROUP_TIMES)).cast("int").alias("n_salt"),
                F.ceil(F.col("n_q") / group_rows).cast("int").alias("n_blk"))
    keys = _stored(keys, "keys")                            # few keys are broadcast for their size: vectors are moved once
    px = probes.join(keys, "mkey").select(
        "qid", "vec", "mkey", F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1)).alias("salt"),
        F.pmod(F.xxhash64("qid"), F.col("n_blk")).cast("int").alias("blk"))
    cx = coll.join(keys, "mkey").select(
        F.col(c_id).alias("id"), "vec", "mkey", F.pmod(F.xxhash64(c_id), F.col("n_salt")).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("blk"))

    def group(qt, ct):
        qt, ct = qt.filter(qt.column("vec").is_valid()), ct.filter(ct.column("vec").is_valid())
        out = [pa.array([], pa.int64()), pa.array([], ct.schema.field("id").type), pa.array([], pa.float64())]
        if len(qt) and len(ct):
            best = Best(matrix(qt.column("vec").combine_chunks()))
            for rb in ct.combine_chunks().to_batches(max_chunksize=BLOCK):
                best.add(rb.column("id"), matrix(rb.column("vec")))
            if best.ids is not None:
                out = [pa.array(qt.column("qid").to_numpy()[best.who]), best.ids, pa.array(best.dist)]
        return pa.table(out, names=["qid", c_id, "distance"])

    return px.groupBy("mkey", "salt", "blk").cogroup(cx.groupBy("mkey", "salt", "blk")).applyInArrow(group, schema)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its size is known from then on, and it is made once."""
    path = shared_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_payload(top: DataFrame, rows: DataFrame, c_id: str, most_bytes: int) -> DataFrame:
    """Winners with the columns of their rows.  The winners are stored and counted first: while their ids fit
    ``most_bytes`` they go to the scan of the collection, and only winners' rows are moved."""
    top = _stored(top, "winners")
    ids = top.select(c_id).distinct()
    if ids.count() <= most_bytes // 8:
        rows = rows.join(F.broadcast(ids), c_id, "left_semi")
    return top.join(rows, c_id)


def knn(queries: DataFrame, collection: DataFrame, *, dim: int, k: int = DEFAULT_K, metric: str = "l2",
        q_id: str = "qid", q_vec: str = "embedding", c_id: str = "id", c_vec: str = "embedding",
        match: list[tuple[str, str]] | None = None, where: Column | None = None,
        payload: list[str] | None = None, probe_bytes: int = PROBE_BYTES) -> DataFrame:
    """J1/J2 (+F1): top-k rows of ``collection`` per probe.

    Returns ``(qid, rank, <c_id>, distance, score, *payload)``; ranks are by
    distance then id (ids are unique).  ``metric``: ``l2`` (Euclidean) or
    ``inner`` (negative inner product).  ``match`` pairs (probe column,
    collection column) must be equal (NULL never matches); ``where`` is any
    condition on the collection, e.g. :func:`metadata_contains`, applied
    before the search.  ``payload`` columns are joined after it.
    """
    if metric not in ("l2", "inner"):
        raise ValueError("metric must be 'l2' or 'inner'")
    match, payload = match or [], list(payload or [])
    if where is not None:
        collection = collection.where(where)
    for q, c in match:
        queries, collection = queries.where(F.col(q).isNotNull()), collection.where(F.col(c).isNotNull())
    probes = queries.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).alias("vec"),
                            _key_expr([q for q, _ in match]).alias("mkey"))
    # NULL vectors are skipped inside the Arrow code: a filter on an embedding
    # UDF's output would make the optimizer evaluate the UDF twice.
    coll = collection.select(c_id, F.col(c_vec).alias("vec"), _key_expr([c for _, c in match]).alias("mkey"))
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField(c_id, collection.schema[c_id].dataType),
                           T.StructField("distance", T.DoubleType())])
    most = max(1, probe_bytes // (8 * dim))
    # One bounded fetch both proves the probe side small and delivers it.
    first = probes.limit(most + 1).toArrow()
    if first.num_rows <= most:
        cand = _by_broadcast(coll, first.filter(first.column("vec").is_valid()), c_id, k, metric, dim, schema)
    else:
        cand = _by_groups(probes, coll, c_id, k, metric, dim, schema, min(most, GROUP_ROWS))
    w = Window.partitionBy("qid").orderBy(F.round("distance", DIGITS), F.col(c_id))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if payload:
        top = _with_payload(top, collection.select(c_id, *payload), c_id, probe_bytes)
    return top.select("qid", F.col("rank").cast("int").alias("rank"), c_id, "distance",
                      score(F.col("distance")).alias("score"), *payload)
