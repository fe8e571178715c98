"""Removal of repeated byte strings by deep-shallow suffix sorting.

Every byte that lies in a ``length``-byte string which also starts elsewhere
is removed.  Anchors thin the suffixes: in each string of ``length`` bytes the
position with the least k-gram hash is an anchor, and equal strings choose
equal anchors.  Anchors whose k-gram occurs once are dropped by a count; the
others carry their context (at most ``length - K`` bytes before and ``length``
bytes from the anchor on), and contexts of one k-gram meet in a task.

There the suffixes at the anchors are sorted the deep-shallow way: a multikey
sort on eight-byte characters down to ``SHALLOW`` bytes, then a blind trie
orders each group that is still equal and yields its common prefix lengths.
Going backwards from the anchor byte by byte, the sorted order's blocks with a
long enough common prefix are intersected with classes of equal bytes before
the anchor; a class of two or more is a repeated string.

Scale: all steps are joins and groupings by hash.  Equal contexts are counted
before they are shuffled, so a passage that a third of all documents shares
arrives once; a k-gram with more than ``hot`` different contexts goes through a
count of its strings' digests instead.  Texts move once, for the documents
that hold a repeated k-gram.  A text that occurs in several rows is sorted
once and, if long enough, removed entirely.

Edge cases: NULL text counts as empty; texts shorter than ``length`` bytes lose
nothing; matches never cross documents; repeated rows repeat each other;
an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, text_bytes

LENGTH = 200
K = 48
SHALLOW = 32
BATCH = 20_000
HOT = 50_000
WRITTEN = 200_000                  # digests a task remembers, so as to give out a context once

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base)
        got[0] = 1
        got = _powers[name] = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def kgram_hashes(text: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on."""
    n = len(text)
    s = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[text] * _power("up", _B, n), dtype=np.uint64)])
    h = (s[k:] - s[:-k]) * _power("down", _B_INVERSE, n - k + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of w values."""
    if w == 1:
        return x
    n = len(x) - w + 1
    pad = -len(x) % w
    fill = np.iinfo(np.uint64).max if op is np.minimum else np.uint64(0)
    rows = np.concatenate([x, np.full(pad, fill, np.uint64)]).reshape(-1, w)
    head = op.accumulate(rows, axis=1).ravel()
    tail = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[:n], head[w - 1:w - 1 + n])


def anchors(text: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that are least in some ``length``-byte string."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = kgram_hashes(np.frombuffer(text, np.uint8), k)
    w = length - k + 1
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)
    return at, h[at]


class BlindTrie:
    """Orders strings by blind descent: a node knows only the depth at which its strings part."""

    __slots__ = ("text", "root")

    def __init__(self, text: list[bytes]):
        self.text, self.root = text, None

    def add(self, i: int) -> None:
        """A leaf is a list of equal strings; a node is (depth, {byte: child})."""
        t, s = self.text, self.text[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is tuple:                       # blind: only branching bytes are read
            d, kids = node
            b = s[d] if d < len(s) else -1
            node = kids.get(b) or next(iter(kids.values()))
        lcp = common(s, t[node[0]])
        if lcp == len(s) == len(t[node[0]]):
            node.append(i)
            return
        parent, edge, node = None, None, self.root       # down again, to where they part
        while type(node) is tuple and node[0] < lcp:
            edge = s[node[0]]
            parent, node = node, node[1][edge]
        if type(node) is tuple and node[0] == lcp:
            node[1][s[lcp] if lcp < len(s) else -1] = [i]
            return
        leaf = node
        while type(leaf) is tuple:
            leaf = next(iter(leaf[1].values()))
        other = t[leaf[0]]
        new = (lcp, {(other[lcp] if lcp < len(other) else -1): node, (s[lcp] if lcp < len(s) else -1): [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def order(self) -> tuple[list[int], list[int]]:
        """The strings in order, and each one's common prefix with the one before it."""
        out, lcps, stack = [], [], [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if type(node) is tuple:
                d, kids = node
                stack += [(kids[b], before if n == 0 else d) for n, b in reversed(list(enumerate(sorted(kids))))]
            else:
                out += node
                lcps += [before] + [len(self.text[node[0]])] * (len(node) - 1)
        return out, lcps


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def deep_shallow(group: np.ndarray, suffixes: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within their groups, and common prefixes with the one before (0 at a group's start)."""
    n = len(suffixes)
    flat = b"".join(s[:shallow].ljust(shallow, b"\0") for s in suffixes)
    chars = np.frombuffer(flat, ">u8").reshape(n, shallow // 8)
    order = np.lexsort([*(chars[:, c] for c in range(chars.shape[1] - 1, -1, -1)), group])
    g, c = group[order], chars[order]
    lcp = np.zeros(n, np.int64)
    size = np.array([len(s) for s in suffixes])[order]
    same_group = g[1:] == g[:-1]
    diff = c[1:] != c[:-1]
    part = np.where(diff.any(1), diff.argmax(1), -1)
    rows = np.flatnonzero(same_group & (part >= 0))
    x = c[rows + 1, part[rows]].astype(np.uint64) ^ c[rows, part[rows]].astype(np.uint64)
    zero = np.zeros(len(x), np.int64)                     # leading equal bytes of the parting character
    for b in range(1, 8):
        zero += x < np.uint64(1) << np.uint64(64 - 8 * b)
    lcp[rows + 1] = np.minimum(part[rows] * 8 + zero, np.minimum(size[rows], size[rows + 1]))
    # Deep: groups that the shallow sort leaves equal.
    tie = np.concatenate([[False], same_group & (part < 0), [False]])
    starts = np.flatnonzero(~tie[:-1] & tie[1:])
    ends = np.flatnonzero(tie[:-1] & ~tie[1:]) + 1
    for a, b in zip(starts.tolist(), ends.tolist()):
        trie = BlindTrie(suffixes)
        for i in order[a:b].tolist():
            trie.add(i)
        o, deep = trie.order()
        order[a:b] = o
        lcp[a + 1:b] = deep[1:]
    return order, lcp


def repeated_offsets(group: np.ndarray, left: list[bytes], right: list[bytes], length: int, k: int) -> np.ndarray:
    """flags[i, j]: the string that starts j bytes before anchor i occurs at another anchor of its group."""
    n, most = len(right), length - k
    order, lcp = deep_shallow(group, right)
    before = np.zeros((n, most), np.int64)                # bytes before the anchor, nearest first; 0: none
    for row, i in enumerate(order.tolist()):
        b = np.frombuffer(left[i], np.uint8)[::-1]
        before[row, :len(b)] = b.astype(np.int64) + 1
    n_left = np.array([len(x) for x in left])[order]
    n_right = np.array([len(x) for x in right])[order]
    g = group[order]
    cls = np.unique(g, return_inverse=True)[1].astype(np.int64)        # equal bytes before the anchor so far
    flags = np.zeros((n, most + 1), bool)
    live = np.arange(n)
    for j in range(most + 1):
        if j:
            keep = n_left[live] >= j
            cls, live = cls[keep], live[keep]
            if not len(live):
                break
            cls = np.unique(cls * 257 + before[live, j - 1], return_inverse=True)[1]
            several = np.bincount(cls)[cls] > 1           # a class of one stays alone from here on
            cls, live = cls[several], live[several]
            if not len(live):
                break
        block = np.cumsum(lcp < length - j)
        ok = n_right[live] >= length - j
        at = live[ok]
        both = block[at] * (n + 1) + cls[ok]
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        flags[at, j] = count[inverse] > 1
    out = np.zeros_like(flags)
    out[order] = flags
    return out


def _spans(flags: np.ndarray, length: int) -> list[list[dict]]:
    """Covered bytes relative to the anchor, per row."""
    out = []
    for f in flags:
        e = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
        out.append([{"lo": -(int(b) - 1), "hi": length - int(a)} for a, b in zip(e[::2], e[1::2])])
    return out


SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
SPANS_DDL = "array<struct<lo:int,hi:int>>"


def _judge_contexts(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """(h, ch, spans) of distinct contexts; all contexts of one h come together."""
    parts = contexts.repartition("h").sortWithinPartitions("h").select("h", "ch", "before", "ctx", "n")

    def judge(rows):
        h = np.array([r[0] for r in rows], np.int64)
        left, right = [r[3][:r[2]] for r in rows], [r[3][r[2]:] for r in rows]
        flags = repeated_offsets(np.unique(h, return_inverse=True)[1], left, right, length, k)
        for i, r in enumerate(rows):
            if r[4] > 1:                                   # the whole context occurs again
                lo, hi = max(0, length - len(right[i])), min(length - k, len(left[i]))
                flags[i, lo:hi + 1] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array([r[1] for r in rows], pa.binary()), pa.array(_spans(flags, length), SPANS)],
            names=["h", "ch", "spans"])

    def run(batches):
        rows = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if len(rows) >= BATCH and r[0] != rows[-1][0]:
                    yield judge(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield judge(rows)

    return parts.mapInArrow(run, f"h long, ch binary, spans {SPANS_DDL}").filter(F.size("spans") > 0)


def _judge_hot(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """The same verdicts by counting the strings' digests; for k-grams with very many contexts."""
    def strings(batches):
        for b in batches:
            h, ch, js, dg, n = [], [], [], [], []
            for hh, c, before, ctx, m in zip(*(x.to_pylist() for x in b.columns)):
                for j in range(max(0, length - (len(ctx) - before)), min(length - k, before) + 1):
                    h.append(hh)
                    ch.append(c)
                    js.append(j)
                    dg.append(blake2b(ctx[before - j:before - j + length], digest_size=16).digest())
                    n.append(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(ch, pa.binary()), pa.array(js, pa.int32()),
                 pa.array(dg, pa.binary()), pa.array(n, pa.int64())], names=["h", "ch", "j", "dg", "n"])

    rows = materialize(contexts.select("h", "ch", "before", "ctx", "n").mapInArrow(
        strings, "h long, ch binary, j int, dg binary, n long"), "suffix-strings")
    many = rows.groupBy("h", "j", "dg").agg(F.sum("n").alias("all")).filter("all > 1").drop("all")
    found = rows.join(many, ["h", "j", "dg"]).groupBy("h", "ch").agg(
        F.collect_set(F.struct((-F.col("j")).alias("lo"), (F.lit(length) - F.col("j")).alias("hi"))).alias("spans"))
    return found.select("h", "ch", "spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   k: int = K, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept (binary).

    A row per input row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))

    def find(batches):
        for b in batches:
            hs, at = [], []
            for t in b.column(1).to_pylist():
                p, h = anchors(t, length, k)
                hs.append(h.view(np.int64))
                at.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hs, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))],
                names=["key", "h", "at"])

    found = rows.filter(F.octet_length("text") >= length).select("key", "text") \
        .mapInArrow(find, "key binary, h array<long>, at array<int>")
    # One row per distinct text; copies fall together before and in the shuffle.
    found = materialize(found.groupBy("key").agg(F.first("h").alias("h"), F.first("at").alias("at"),
                                                 F.count("*").alias("copies")), "suffix-anchors", "zstd")
    each = found.select("key", F.explode(F.arrays_zip("h", "at")).alias("a")).select(
        "key", F.col("a.h").alias("h"), F.col("a.at").alias("at"))
    many = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    wanted = each.join(many, "h").groupBy("key").agg(F.collect_list(F.struct("at", "h")).alias("a"))
    texts = rows.filter(F.octet_length("text") >= length).select("key", "text").dropDuplicates(["key"])
    texts = materialize(texts.join(wanted, "key"), "suffix-texts", "zstd")
    most = length - k

    def cut(batches):
        written: set[bytes] = set()                        # contexts that this task has already given out
        for b in batches:
            for key, t, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                before = [min(x["at"], most) for x in a]
                ctx = [t[x["at"] - n:x["at"] + length] for x, n in zip(a, before)]
                ch = [blake2b(c + bytes([n & 255, n >> 8]), digest_size=16).digest() for c, n in zip(ctx, before)]
                for i, d in enumerate(ch):
                    if d in written:
                        ctx[i] = None
                    else:
                        written.add(d)
                if len(written) > WRITTEN:
                    written.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(a), pa.binary()), pa.array([x["at"] for x in a], pa.int32()),
                     pa.array([x["h"] for x in a], pa.int64()), pa.array(ch, pa.binary()),
                     pa.array(before, pa.int32()), pa.array(ctx, pa.binary())],
                    names=["key", "at", "h", "ch", "before", "ctx"])

    places = texts.mapInArrow(cut, "key binary, at int, h long, ch binary, before int, ctx binary")
    places = materialize(places, "suffix-places", "zstd")
    contexts = materialize(places.groupBy("h", "ch").agg(
        F.count("*").alias("n"), F.first("before").alias("before"), F.first("ctx", ignorenulls=True).alias("ctx")),
        "suffix-contexts", "zstd")
    sizes = contexts.groupBy("h").agg(F.count("*").alias("size")).filter(F.col("size") > hot).select("h")
    verdict = _judge_contexts(contexts.join(sizes, "h", "left_anti"), length, k)
    if not sizes.isEmpty():
        verdict = verdict.unionByName(_judge_hot(contexts.join(sizes, "h"), length, k))
    verdict = materialize(verdict, "suffix-verdicts")
    cuts = places.select("key", "at", "h", "ch").join(verdict, ["h", "ch"]).select(
        "key", F.explode("spans").alias("s"), "at").select(
        "key", (F.col("at") + F.col("s.lo")).alias("lo"), (F.col("at") + F.col("s.hi")).alias("hi")) \
        .groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))

    def apply(batches):
        for b in batches:
            gone, spans, sha, kept = [], [], [], []
            for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out, last, n, m = [], 0, 0, 0
                end = -1
                for lo, hi in sorted((x["lo"], x["hi"]) for x in c):
                    if lo > end:
                        out.append(t[last:lo])
                        m += 1
                    n += max(0, hi - max(lo, end))
                    end = last = max(end, hi)
                out = b"".join([*out, t[last:]])
                gone.append(n)
                spans.append(m)
                sha.append(sha256(out).hexdigest())
                kept.append(out if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(kept, pa.binary())], names=["key", "gone", "spans", "sha", "kept"])

    done = texts.select("key", "text").join(cuts, "key").select("key", "text", "cuts").mapInArrow(
        apply, "key binary, gone long, spans long, sha string, kept binary")
    whole = found.filter("copies > 1").select("key", F.lit(True).alias("whole"))
    thin = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                       F.sha2("text", 256).alias("own_sha"), *([F.col("text")] if keep_text else []))
    out = thin.join(whole, "key", "left").join(done, "key", "left")
    all_gone = F.coalesce("whole", F.lit(False))
    kept = [F.when(all_gone, F.lit(b"")).otherwise(F.coalesce("kept", "text")).alias("kept")] if keep_text else []
    return out.select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"), *kept)
