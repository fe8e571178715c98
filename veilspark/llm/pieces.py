"""SentencePiece encoding with byte offsets, and decoding.

A model file (BPE) is read as plain protobuf fields.  Encoding has three steps:

1. normalisation: at each place of the text the longest prefix known to the
   compiled character map (a double-array trie) is replaced; every normalised
   byte records the source byte it comes from.  Blanks become U+2581 and the
   dummy prefix is set as the model asks;
2. merging: the best-scored neighbouring pair is merged first, the leftmost
   of equal ones; characters without a piece become byte pieces;
3. projection: a piece's place in the normalised text gives its span of bytes
   in the *original* text, through the alignment of step 1.

No piece of the model holds some neighbouring characters (a blank after a
letter, or a line end beside anything); merges cannot cross such a place, so
the text is cut there into units, and the different units of a slice of text
are merged side by side: one row of a matrix each, one merge a row in every
round.  Which cuts hold is read from the pieces, never assumed.

The work is one narrow ``mapInArrow`` pass in short slices of text.  The model
bytes are broadcast; a model file larger than ``MAX_MODEL_BYTES`` is an error.

Edge cases: a NULL text counts as empty and has the end id only; very long
texts are whole, merged by a heap where a unit is long; rows pass through one
by one with their columns, results take free names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import free_name, text_bytes

MAX_MODEL_BYTES = 64 << 20
SLICE_BYTES = 4 << 20              # text encoded at a time; one text is never cut
WIDTHS = (5, 8, 12, 20, 32)        # characters of a matrix row; longer units are merged one by one
KEPT_UNITS = 1 << 18               # different units a task remembers before it starts anew

# --- fixed values: the piece types and model types of the file format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE = "▁"
_SPACE = SPACE.encode()

RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
                       T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


# ------------------------------------------------------------------ model file
def _fields(blob: bytes):
    """(number, value) of every field of one protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = blob[at:at + size]
            at += size
        yield key >> 3, value


class CharMap:
    """Compiled character map: a double-array trie and the replacements it points to."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.texts = blob[4 + size:]
            root = self._offset(self.units[0])
            self.starts = frozenset(b for b in range(256) if self._label(self.units[root ^ b]) == b) if root < len(self.units) else frozenset()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    @staticmethod
    def _label(unit: int) -> int:
        return unit & 0x800000FF

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of ``text[at:]`` and its replacement; 0 if none."""
        units, node, length, value = self.units, self._offset(self.units[0]), 0, 0
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if self._label(unit) != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                length, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return length, self.texts[value:self.texts.index(b"\0", value)] if length else b""


class Model:
    """Pieces, merge scores and normalisation of a BPE model file."""

    def __init__(self, blob: bytes):
        pieces, trainer, normal = [], {}, {}
        for number, value in _fields(blob):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != BPE:
            raise ValueError("not a BPE model")
        self.text = [p[1].decode() for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        if USER_DEFINED in self.kind:
            raise ValueError("models with user-defined pieces are not supported")
        score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] in (NORMAL, UNUSED)}
        self.rank = {t: -score[i] for t, i in self.ids.items()}
        self.unknown = self.kind.index(UNKNOWN)
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE} if trainer.get(35, 0) else {}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        end = trainer.get(47, b"</s>").decode()
        self.end = next((i for i, t in enumerate(self.text) if t == end and self.kind[i] == CONTROL), None)
        self.suffix_blank = bool(trainer.get(24, 0))
        self.map = CharMap(normal.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normal.get(n, 1)) for n in (3, 4, 5))
        # Where a merge can never reach: characters that are no part of a longer piece,
        # and a blank sign after anything else.
        long = [t for t in self.ids if len(t) > 1]
        self.blank_leads = not any(SPACE in t.lstrip(SPACE) for t in long)
        joined = set("".join(long))
        lone = "\n" if "\n" not in joined else ""
        if self.blank_leads:
            self.unit = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|{lone}" if lone else ""))
        else:
            self.unit = re.compile(f"[^{lone}]+|{lone}" if lone else r"[\s\S]+")

    # -------------------------------------------------------------- step 1
    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the source byte."""
        blank = _SPACE if self.escape else b" "
        if not text:
            return b"", np.zeros(1, np.int32)
        if not self.map.units and not self.squeeze:
            if self.escape:
                raw = np.frombuffer(text, np.uint8)
                source = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 0x20, 3, 1))
                out = text.replace(b" ", _SPACE)
            else:
                out, source = text, np.arange(len(text), dtype=np.int32)
            consumed, lead = len(text), 0
        else:
            out, source, consumed, lead = self._mapped(text, blank)
            if not out:                                  # nothing but blanks
                return b"", np.full(1, lead, np.int32)
        parts, sources = [out], [source]
        if self.dummy:
            where = 1 if self.suffix_blank else 0
            parts.insert(where, blank)
            sources.insert(where, np.full(len(blank), consumed if self.suffix_blank else lead, np.int32))
        return b"".join(parts), np.concatenate([*sources, np.full(1, consumed, np.int32)]).astype(np.int32)

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        if self.map.units and text[at] in self.map.starts:
            size, new = self.map.longest(text, at)
            if size:
                return size, new
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at:at + size]

    def _mapped(self, text: bytes, blank: bytes):
        at, end = 0, len(text)
        if self.squeeze:
            while at < end:
                size, new = self._prefix(text, at)
                if new != b" ":
                    break
                at += size
        lead = at
        out, source, after_blank = [], [], self.squeeze
        while at < end:
            size, new = self._prefix(text, at)
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                after_blank = self.squeeze and new.endswith(b" ")
                new = new.replace(b" ", blank)
                out.append(new)
                source += [at] * len(new)
            at += size
        joined, consumed = b"".join(out), at
        if self.squeeze:
            while joined.endswith(blank):
                joined = joined[:-len(blank)]
                consumed = source[len(joined)]
        return joined, np.array(source[:len(joined)], np.int32), consumed, lead

    # -------------------------------------------------------------- step 2
    def merge(self, unit: str) -> list[str]:
        """Merge one unit: best score first, leftmost of equal ones."""
        rank, origin = self.rank, {}

        def pair(a, b):
            both = a + b
            r = rank.get(both)
            if r is not None and self.kind[self.ids[both]] == UNUSED:
                origin[both] = (a, b)
            return r

        syms = list(unit)
        if len(syms) <= 24:
            ranks = [pair(a, b) for a, b in zip(syms, syms[1:])]
            while True:
                best, at = None, -1
                for i, r in enumerate(ranks):
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if at < 0:
                    break
                syms[at:at + 2] = [syms[at] + syms[at + 1]]
                del ranks[at]
                if at < len(ranks):
                    ranks[at] = pair(syms[at], syms[at + 1])
                if at:
                    ranks[at - 1] = pair(syms[at - 1], syms[at])
        else:
            n = len(syms)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := pair(syms[i], syms[i + 1])) is not None]
            heapq.heapify(heap)
            while heap:
                _, i, a, b = heapq.heappop(heap)
                j = after[i]
                if syms[i] != a or j >= n or syms[j] != b:
                    continue
                syms[i], syms[j] = a + b, None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := pair(syms[i], syms[k])) is not None:
                        heapq.heappush(heap, (r, i, syms[i], syms[k]))
                h = before[i]
                if h >= 0 and (r := pair(syms[h], syms[i])) is not None:
                    heapq.heappush(heap, (r, h, syms[h], syms[i]))
            syms = [s for s in syms if s is not None]
        if not origin:
            return syms

        def split(s):
            if s in origin and self.kind[self.ids[s]] == UNUSED:
                return split(origin[s][0]) + split(origin[s][1])
            return [s]
        return [p for s in syms for p in split(s)]

    def decode(self, ids) -> str:
        """Text of any list of ids."""
        out, run, lead = [], bytearray(), True

        def flush():
            if run:
                out.append(run.decode("utf-8", "replace") if _is_utf8(run) else _lossy(bytes(run)))
                run.clear()

        strip = self.dummy or self.squeeze
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            lead = lead and not any(out)
            if self.kind[i] == CONTROL:
                continue
            piece = self.unknown_text if i == self.unknown else self.text[i]
            if lead and strip and i != self.unknown and piece.startswith(SPACE):
                piece = piece[1:]
                lead = self.squeeze
            out.append(piece.replace(SPACE, " ") if i != self.unknown else piece)
        flush()
        return "".join(out)


def _is_utf8(b) -> bool:
    try:
        b.decode()
        return True
    except UnicodeDecodeError:
        return False


def _lossy(b: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that starts no valid character."""
    out, at = [], 0
    while at < len(b):
        for size in (1, 2, 3, 4):
            try:
                out.append(b[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


# ------------------------------------------------------------------ operators
def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        blob = f.read(MAX_MODEL_BYTES + 1)
    if len(blob) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return blob


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol): an open-addressed table read by whole arrays."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.mask = np.uint64((1 << max(4, (4 * len(pairs)).bit_length())) - 1)
        n = int(self.mask) + 1
        self.key = np.full(n, -1, np.int64)
        self.rank, self.merged = np.full(n, self.NONE, np.int32), np.full(n, -1, np.int32)
        left = pairs and np.array(list(pairs), np.int64)
        for (a, b), at in zip(pairs, self._place(left[:, 0], left[:, 1]).tolist() if pairs else ()):
            while self.key[at] >= 0:
                at = (at + 1) % n
            self.key[at] = a << 32 | b
            self.rank[at], self.merged[at] = pairs[a, b]

    def _place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((x ^ (x >> np.uint64(29))) & self.mask).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NONE`` where there is no pair) and merged symbols; negative symbols have no pairs."""
        rank, merged = np.full(left.shape, self.NONE, np.int32), np.full(left.shape, -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        l, r = left.ravel()[todo].astype(np.int64), right.ravel()[todo].astype(np.int64)
        want, at = l << 32 | r, self._place(l, r)
        out_rank, out_merged = rank.ravel(), merged.ravel()
        while len(todo):
            held = self.key[at]
            hit = held == want
            out_rank[todo[hit]], out_merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            on = ~hit & (held >= 0)
            todo, want, at = todo[on], want[on], (at[on] + 1) & np.int64(self.mask)
        return out_rank.reshape(left.shape), out_merged.reshape(left.shape)


class _Numbers(dict):
    """Unit -> number, given out in order."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class _Encoder:
    """Encodes slices of texts; units met before are not merged again (up to a bound)."""

    def __init__(self, blob: bytes):
        self.model = m = Model(blob)
        symbols = dict(m.ids)
        self.n_pieces = len(m.text)
        for t in m.ids:                                  # characters that are parts of pieces only
            for c in t:
                symbols.setdefault(c, self.n_pieces + len(symbols))
        self.of_char = np.full(0x110000, -2, np.int32)
        for t, i in symbols.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        levels = {r: i for i, r in enumerate(sorted(set(m.rank.values())))}
        pairs = {}
        for t, i in m.ids.items():
            for j in range(1, len(t)):
                left, right = symbols.get(t[:j]), symbols.get(t[j:])
                if left is not None and right is not None:
                    pairs[left, right] = (levels[m.rank[t]], i)
        self.pairs = PairTable(pairs)
        self.plain = UNUSED not in m.kind
        self._forget()
        self.byte_ids = np.array([m.byte.get(b, m.unknown) for b in range(256)], np.int32)
        self.surface = [b"" if k == CONTROL else bytes([m.byte_of[i]]) if i in m.byte_of
                        else m.unknown_text.encode() if i == m.unknown else t.replace(SPACE, " ").encode()
                        for i, (t, k) in enumerate(zip(m.text, m.kind))]

    def _forget(self) -> None:
        self.number, self.ids, self.sizes, self.first = _Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Merge the units that got a number since the last time."""
        new = list(itertools.islice(self.number, len(self.first) - 1, None))
        if new:
            ids, sizes, first = self.units(new)
            self.first = np.r_[self.first, first[1:] + self.first[-1]]
            self.ids, self.sizes = np.r_[self.ids, ids], np.r_[self.sizes, sizes]

    def _rounds(self, s: np.ndarray, w: np.ndarray) -> None:
        """Merge every row of symbols ``s`` (-1 after its end) with byte lengths ``w``, in place."""
        width = s.shape[1] - 1                           # the last column is always empty
        cols = np.arange(width)
        live = np.arange(len(s))
        cs, cw = s.copy(), w.copy()
        rank, merged = self.pairs.find(cs[:, :-1], cs[:, 1:])
        while len(live):
            at = rank.argmin(1)
            rows = np.arange(len(live))
            go = rank[rows, at] != PairTable.NONE
            if not go.all():
                s[live[~go]], w[live[~go]] = cs[~go], cw[~go]
                live, cs, cw, rank, merged, at = live[go], cs[go], cw[go], rank[go], merged[go], at[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            cs[rows, at] = merged[rows, at]
            cw[rows, at] += cw[rows, at + 1]
            source = cols + (cols > at[:, None])
            cs[:, :-1], cw[:, :-1] = np.take_along_axis(cs, source, 1), np.take_along_axis(cw, source, 1)
            source = np.minimum(source, width - 1)
            rank, merged = np.take_along_axis(rank, source, 1), np.take_along_axis(merged, source, 1)
            rank[:, -1] = PairTable.NONE
            rank[rows, at], merged[rows, at] = self.pairs.find(cs[rows, at], cs[rows, at + 1])
            left = np.flatnonzero(at)
            r, a = rows[left], at[left] - 1
            rank[r, a], merged[r, a] = self.pairs.find(cs[r, a], cs[r, a + 1])

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, first): pieces of the units one after another; unit i has first[i]..first[i + 1].

        A size is a piece's length in normalised bytes; of the byte pieces of
        one character the last has it all.
        """
        m = self.model
        n_chars = np.fromiter(map(len, units), np.int64, len(units))
        joined = "".join(units)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start = np.cumsum(n_chars) - n_chars
        symbol = self.of_char[chars]
        size = (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)).astype(np.int32)
        parts, low = [], 0
        for width in WIDTHS if self.plain else ():
            rows = np.flatnonzero((n_chars > low) & (n_chars <= width))
            low = width
            for lo in range(0, len(rows), 1 << 15):
                own = rows[lo:lo + (1 << 15)]
                inside = np.arange(width + 1) < n_chars[own][:, None]
                at = np.minimum(start[own][:, None] + np.arange(width + 1), len(chars) - 1)
                s, w = np.where(inside, symbol[at], -1), np.where(inside, size[at], 0)
                self._rounds(s, w)
                left = s != -1
                parts.append((np.repeat(own, left.sum(1)), s[left], w[left]))
        slow = np.flatnonzero(n_chars > low)
        for i in slow.tolist():
            got = m.merge(units[i])
            parts.append((np.full(len(got), i), np.array([m.ids.get(p, -2) for p in got], np.int32),
                          np.array([len(p.encode()) for p in got], np.int32)))
        unit, ids, sizes = (np.concatenate([p[j] for p in parts]) for j in range(3))
        order = np.argsort(unit, kind="stable")
        unit, ids, sizes = unit[order], ids[order], sizes[order]
        strange = (ids < 0) | (ids >= self.n_pieces)
        if strange.any():
            if m.byte:                                   # one piece for each byte of the character
                raw, place = np.frombuffer(joined.encode(), np.uint8), np.cumsum(sizes) - sizes
                times = np.where(strange, sizes, 1)
                again = np.repeat(np.arange(len(ids)), times)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                own = strange[again]
                ids = np.where(own, self.byte_ids[raw[np.minimum(place[again] + nth, len(raw) - 1)]], ids[again])
                sizes = np.where(own & (nth < times[again] - 1), 0, sizes[again])
                unit = unit[again]
            else:
                ids = np.where(strange, m.unknown, ids)
        return ids.astype(np.int32), sizes.astype(np.int64), np.searchsorted(unit, np.arange(len(units) + 1))

    def decode(self, ids: np.ndarray) -> str:
        """As ``Model.decode``, fast where the bytes of the pieces are valid UTF-8 together."""
        m = self.model
        listed = ids.tolist()
        raw = b"".join(map(self.surface.__getitem__, listed))
        first = next((i for i in listed if m.kind[i] != CONTROL), None)
        if (m.dummy or m.squeeze) and first is not None and first != m.unknown and m.text[first].startswith(SPACE):
            if m.squeeze and raw[1:2] == b" ":
                return m.decode(listed)
            raw = raw[1:]
        return raw.decode() if _is_utf8(raw) else m.decode(listed)

    def texts(self, raws: list[bytes], end: bool) -> list[tuple]:
        """(ids, starts, ends, decoded) of every text."""
        m = self.model
        if len(self.number) > KEPT_UNITS:
            self._forget()
        normal, used = [], []
        for raw in raws:
            n, source = m.normalize(raw)
            normal.append((n, source))
            found = m.unit.findall(n.decode())
            used.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
        self._learn()
        ids, sizes, first = self.ids, self.sizes, self.first
        out = []
        for (n, source), u in zip(normal, used):
            times = first[u + 1] - first[u] if len(u) else np.zeros(0, np.int64)
            at = np.repeat(first[u] - (np.cumsum(times) - times), times) + np.arange(times.sum()) if len(u) else np.zeros(0, np.int64)
            i, size = ids[at], sizes[at]
            to = np.cumsum(size)
            starts, ends = source[to - size], source[to]
            if m.byte and not size.all():                # only a character's last byte piece covers it
                ends = np.where(size == 0, starts, ends)
            if not m.byte and len(i) > 1:                # neighbouring unknown pieces are one
                kept = np.flatnonzero(~np.r_[False, (i[1:] == m.unknown) & (i[:-1] == m.unknown)])
                i, starts, ends = i[kept], starts[kept], ends[np.r_[kept[1:] - 1, len(i) - 1]]
            if end:
                i = np.r_[i, np.int32(m.end)]
                starts, ends = np.r_[starts, source[-1]], np.r_[ends, source[-1]]
            out.append((i.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32), self.decode(i)))
        return out


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", end: bool = True,
           out_col: str = "pieces") -> tuple[DataFrame, str]:
    """``docs`` with a struct (ids, starts, ends, decoded), and that column's name.

    ``starts`` and ``ends`` are byte offsets in the original text; the end id
    is an empty span at its end.  ``decoded`` is what decoding the ids gives.
    """
    name = free_name(docs, out_col)
    sent = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    if end and Model(sent.value).end is None:
        raise ValueError("the model has no end piece")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])
    at = docs.columns.index(text_col)
    lists = pa.list_(pa.int32())
    kind = pa.struct([("ids", lists), ("starts", lists), ("ends", lists), ("decoded", pa.string())])

    def run(batches):
        encoder = _Encoder(sent.value)
        for b in batches:
            texts = text_bytes(b.column(at))
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") <= SLICE_BYTES):
                    size += len(texts[hi] or b"")
                    hi += 1
                got = encoder.texts([t or b"" for t in texts[lo:hi]], end)
                offsets = pa.array(np.cumsum([0, *(len(g[0]) for g in got)]), pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([g[j] for g in got]))) for j in range(3)]
                struct_ = pa.StructArray.from_arrays([*columns, pa.array([g[3] for g in got], pa.string())], fields=list(kind))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, struct_], names=[*b.schema.names, name])
                lo = hi

    return docs.mapInArrow(run, schema), name


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> tuple[DataFrame, str]:
    """``rows`` with the text of a list of ids (NULL for a NULL list), and that column's name."""
    name = free_name(rows, out_col)
    sent = rows.sparkSession.sparkContext.broadcast(_read(model_path))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at = rows.columns.index(ids_col)

    def run(batches):
        model = Model(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [None if ids is None else model.decode([i for i in ids if i is not None]) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema), name


def digest(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_covered): what the encoding of each text comes to.

    ``n_covered`` is the number of source bytes inside the pieces' spans.
    """
    found, name = encode(docs.select(id_col, text_col), model_path, text_col=text_col)
    r = F.col(name)
    spans = F.aggregate(F.zip_with(r["starts"], r["ends"], lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(id_col, F.size(r["ids"]).cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(r["ids"].cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2(r["decoded"], 256).alias("decoded_sha256"), spans.alias("n_covered"))
