"""Near-duplicate detection by fast similarity sketching.

A document's set holds its distinct word shingles.  The sketch places every
element in one of ``T`` bins by a fresh hash in each round, until no bin is
empty; a bin keeps the least value of the first round that reached it, and
rounds ``T`` to ``2T-1`` send every element to one fixed bin, so every
coordinate is filled.  Coordinates of two sketches agree with the probability
of their Jaccard similarity, with concentration bounds as for full
permutations.  Bands of ``R`` coordinates make buckets.

Work is done between distinct sets only (copies collapse first, by partial
aggregation).  In a bucket every member is compared with the bucket's least
member; candidates are verified on the full sets.  Verified links give
components; a bucket whose members lie in several components is then closed
exactly: members that cannot reach the threshold any more (their shingles that
occur in no other open document are too many) drop out by a counting bound,
and the rest are compared across components, on their whole sets, in blocks of
bounded size, each pair in the first band that it shares.  Members of a
bucket's largest component are met by the other members only, never by each
other.  A block keeps track of the components its links have joined and skips
every further pair between joined ones, so it lists fewer links than it holds
components, and the groups of documents are still those that all pairs found
by the banding would give.

Edge cases: NULL or empty text (or white space alone) has an empty set and is
linked with nothing; fewer words than a shingle are one shingle; repeated rows
share a set and a component; a NULL ``doc_id`` takes part, but a component's id
is its least non-NULL id; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import LOWER_AZ, materialize, text_bytes

T = 128
R = 4
BANDS = T // R
SHINGLE = 4
THRESHOLD = (80, 100)          # numerator and denominator of the least similarity
BLOCK = 512                    # members on either side of a block of comparisons
SALTS = 16
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_B = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * _B)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.translate(LOWER_AZ).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count=len(words))
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = h * _B + mix(w[j:j + len(h)])
    return np.unique(mix(h + np.uint64(n)))


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: t coordinates of 32 bits."""
    out, full = np.zeros(t, np.uint32), np.zeros(t, bool)
    i = 0
    while i < t and not full.all():
        rounds = min(t - i, max(1, 3 * t // len(s)))
        x = mix(s[None, :] ^ _SEEDS[i:i + rounds, None])
        slot = (x >> np.uint64(40)) % np.uint64(t) + np.arange(rounds, dtype=np.uint64)[:, None] * np.uint64(t)
        least = np.full(rounds * t, MAX)
        np.minimum.at(least, slot.ravel().astype(np.int64), (x << np.uint64(24)).ravel())
        least = least.reshape(rounds, t)
        got = least != MAX
        first = got.argmax(0)
        new = got.any(0) & ~full
        value = mix(least[first, np.arange(t)] ^ _SEEDS[i + first])
        out[new] = (value[new] >> np.uint64(32)).astype(np.uint32)
        full |= new
        i += rounds
    for b in np.flatnonzero(~full):                       # rounds t .. 2t-1: one bin each
        x = mix(s ^ _SEEDS[t + b]).min()
        out[b] = np.uint32(int(mix(np.array([x]))[0]) >> 32)
    return out


def similar(a: np.ndarray, b: np.ndarray, threshold=THRESHOLD) -> bool:
    """Whether two sorted sets reach the threshold."""
    num, den = threshold
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) * den < num * len(large):
        return False
    k = np.searchsorted(large, small)
    both = int((large[np.minimum(k, len(large) - 1)] == small).sum())
    return both * den >= num * (len(a) + len(b) - both)


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set, NULL if empty), sketch."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, node, sk = [], [], []
            for t in text_bytes(b.column(1)):
                s = shingle_set(t, shingle)
                n.append(len(s))
                node.append(_digest(s) if len(s) else None)
                sk.append(sketch(s).view(np.int32).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                 pa.array(sk, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "node", "sketch"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, f"doc_id {id_type}, n_shingles long, node binary, sketch array<int>")


def _node_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, text): one text for every wanted (node, doc_id)."""
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("text"))
    joined = nodes.join(rows, F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")

    def right(batches):                 # an id may be on several texts
        for b in batches:
            keep = [_digest(shingle_set(t, shingle)) == k for k, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(right, "node binary, text string").dropDuplicates(["node"])


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, threshold) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    p = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b") \
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a") \
        .select("a", "b", "text_a", "text_b")

    def run(batches):
        last, known = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                if a != last:
                    last, known = a, shingle_set(ta, shingle)
                keep.append(similar(known, shingle_set(tb, shingle), threshold))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return p.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable, for every node of an edge (a, b).

    Least-label propagation with pointer jumping; each round is written to the
    shared folder, so nothing is repeated when executors are lost.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = materialize(step.join(jump, "next", "left").select(
            "node", F.col("comp").alias("old"), F.least("next", F.coalesce("far", "next")).alias("comp")), "cc-labels")
        labels = new.select("node", "comp")
        if new.filter("old <> comp").limit(1).count() == 0:
            return labels


def _open_blocks(rows: DataFrame) -> DataFrame:
    """Members of open buckets, once for every block of comparisons that they take part in.

    A bucket's largest component ("top") meets the other members; these meet
    each other.  ``kind`` t: ``i`` is a block of the top, ``j`` one of the
    others; kind o: two blocks of others (or one with itself).
    """
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"),
                                       F.count("*").alias("comps")).filter("comps > 1")
    tops = tops.select("bucket", F.col("top.comp").alias("top"),
                       F.ceil(F.col("top.size") / BLOCK).cast("int").alias("n_top"),
                       F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("n_other"))
    r = rows.join(tops, "bucket")

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    def key(kind, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    of_top = F.pmod(F.xxhash64("node"), F.col("n_top"))
    of_other = F.pmod(F.xxhash64("node"), F.col("n_other"))
    as_top = F.transform(upto(F.col("n_other")), lambda j: key("t", of_top, j, F.lit(0)))
    as_other = F.concat(
        F.transform(upto(F.col("n_top")), lambda i: key("t", i, of_other, F.lit(1))),
        F.transform(upto(F.col("n_other")), lambda j: key("o", F.least(of_other, j), F.greatest(of_other, j),
                                                          (of_other > j).cast("int"))))
    return r.withColumn("at", F.explode(F.when(F.col("comp") == F.col("top"), as_top).otherwise(as_other))) \
        .select("bucket", "at.kind", "at.i", "at.j", "at.side", "band", "node", "comp", "n", "shared", "sketch", "set")


def _open_links(blocks: DataFrame, threshold) -> DataFrame:
    """Exact links (a, b) between components, fewer per block than it holds components."""
    num, den = threshold

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        inside = pdf["kind"].iloc[0] == "o" and int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0])
        pdf = pdf.sort_values("node", ignore_index=True)
        node, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
        root = pd.factorize(pdf["comp"])[0]               # component of each member, joined as links are found
        n, shared = pdf["n"].to_numpy(), pdf["shared"].to_numpy()
        sk = np.stack(pdf["sketch"].to_numpy())
        sets = [np.frombuffer(x, np.uint64) for x in pdf.pop("set")]
        # Hashes as numbers from 0 on, so that one set at a time can be marked in a table.
        at = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        sets = np.split(at, np.cumsum([len(x) for x in sets])[:-1])
        marked = np.zeros(int(at.max()) + 1, bool)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not inside and len(right) < len(left):
            left, right = right, left
        a, b = [], []
        for u in range(len(node)) if inside else left.tolist():
            v = np.arange(u + 1, len(node)) if inside else right
            ok = (root[v] != root[u]) & (np.minimum(n[u], n[v]) * den >= num * np.maximum(n[u], n[v]))
            # both / (n_u + n_v - both) >= num / den needs this many common shingles
            ok &= np.minimum(shared[u], shared[v]) * (num + den) >= num * (n[u] + n[v])
            v = v[ok]
            if not len(v):
                continue
            v = v[(sk[v] == sk[u]).reshape(len(v), -1, R).all(2).argmax(1) == band]
            marked[sets[u]] = True
            for w in v.tolist():
                if root[w] == root[u]:
                    continue
                both = int(np.count_nonzero(marked[sets[w]]))
                if both * den >= num * (n[u] + n[w] - both):
                    first, second = sorted((node[u], node[w]))
                    a.append(first)
                    b.append(second)
                    root[root == root[w]] = root[u]
            marked[sets[u]] = False
        return pd.DataFrame({"a": a, "b": b})

    return blocks.groupBy("bucket", "kind", "i", "j").applyInPandas(links, "a binary, b binary")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, set): the set as sorted 64-bit hashes."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node binary, set binary")


def _unique_counts(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, alone): how many of a node's shingles occur in no other of the given texts."""
    def run(batches):
        for b in batches:
            nodes = b.column(0).to_pylist()
            sets = [shingle_set(t, shingle) for t in text_bytes(b.column(1))]
            if not sets:
                continue
            h = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(u.view(np.int64)), "n": pa.array(n, pa.int64()),
                "node": pa.array(nodes, pa.binary()).take(pa.array(owner[first]))})

    one = texts.select("node", "text").mapInArrow(run, "h long, n long, node binary").groupBy("h").agg(
        F.sum("n").alias("n"), F.min("node").alias("node")).filter("n = 1")
    return one.groupBy("node").agg(F.count("*").alias("alone"))


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
         threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a row per input row."""
    num, den = threshold
    base = materialize(sketches(docs, id_col, text_col, shingle), "near-sketches")
    nodes = base.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes, "near-nodes")
    bands = nodes.select("node", F.posexplode(F.array(
        *[F.xxhash64(F.lit(i), *[F.element_at("sketch", i * R + k + 1) for k in range(R)]) for i in range(BANDS)]
    )).alias("band", "bucket"))
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    members = materialize(bands.join(buckets, "bucket"), "near-members")
    involved = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    texts = materialize(_node_texts(docs, involved, id_col, text_col, shingle), "near-texts")
    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = materialize(verify(stars, texts, shingle, threshold), "near-edges")
    comp = components(edges)

    # Buckets of three or more whose members lie in several components.
    tagged = members.filter("size > 2").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tagged = materialize(tagged.select("bucket", "band", "node", "comp"), "near-tagged")
    several = tagged.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .filter("lo <> hi").select("bucket")
    open_rows = materialize(tagged.join(several, "bucket"), "near-open")
    if not open_rows.isEmpty():
        open_nodes = open_rows.select("node").distinct()
        open_texts = materialize(texts.join(open_nodes, "node"), "near-open-texts")
        alone = _unique_counts(open_texts, shingle)
        alive = nodes.join(open_nodes, "node").join(alone, "node", "left") \
            .withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))) \
            .filter(F.col("shared") * den >= F.col("n") * num).select("node", "n", "shared", "sketch") \
            .join(_sets(open_texts, shingle), "node")
        rows = materialize(open_rows.join(alive, "node"), "near-alive")
        late = materialize(_open_links(_open_blocks(rows), threshold), "near-late")
        if not late.isEmpty():
            comp = components(edges.unionByName(late))

    # A node's id is its own least one, or that of its component; the labels of one component are dealt out by salt.
    of_node = nodes.select("node", "doc_id")
    salted = comp.join(of_node, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("comp").agg(F.min("doc_id").alias("least")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = of_node.join(salted.join(least, ["comp", "salt"]).select("node", "least"), "node", "left") \
        .select("node", F.coalesce("least", "doc_id").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "node").join(ids, "node", "left") \
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group (the least id); a repeated row is the same document."""
    gone = link(docs, id_col=id_col, **options).filter(~F.col("kept") & F.col("doc_id").isNotNull()) \
        .select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == F.col("gone_id"), "left_anti")
