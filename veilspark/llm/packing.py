"""Sequence packing by minimum bin slack.

Every task tokenizes its documents and cuts each into full windows and one
remainder.  The remainders' lengths form a multiset.  A window takes the longest piece; for the rest of it a bitset
(one integer whose bit s says "length s is reachable") runs the subset-sum
dynamic program over the multiset, longest lengths first; the count used of
each length is read off by backtracking, and the filling closest to the
capacity is taken.  One document in ``filler_every`` is cut into powers of two,
so that the last windows can also be closed exactly.

A task's pool is bounded by ``pool`` pieces whatever the partition's size.
Pieces that fill no window exactly when a task ends are packed together by a
second small step.  Tokens never leave the task: a piece carries
its position, length and checksum.

Edge cases: NULL or empty text is one piece with the end token alone; very long
texts give many full windows; repeated rows are separate documents; an empty
table gives no piece.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

CAPACITY = 2048
END_ID = 1
POOL = 8192
FILLER_EVERY = 16
LEFT = 256                # pieces of a task that may wait for the second step
CACHE_WORDS = 1_000_000
STRETCH = 8 << 20         # bytes of text that are parted at a time
_TASK_BITS = 33           # sequence id = step and task number above, running number below

PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


# Arrow also parts at these four control characters, which are no white space to the tokenizer.
_CONTROLS = "[\x1c-\x1f]"
_NOT_SPACE = re.compile(r"(?:[\x1c-\x1f]|\S)+")


def _split(texts: pa.Array) -> pa.Array:
    """Words of every text, among empty ones where white space begins or ends it."""
    if pc.any(pc.match_substring_regex(texts, _CONTROLS)).as_py():
        return pa.array([_NOT_SPACE.findall(t) for t in texts.to_pylist()], pa.list_(texts.type))
    return pc.utf8_split_whitespace(texts)


# Words of printable ASCII and Latin-1 letters, and how the pre-tokenizer parts them (after lower-casing).
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
# Plain words: ASCII or Latin-1 letters, then closing marks; the pieces are these two.
_MARKS = ".,;:!?"
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
# --- fixed value: the pre-tokenizer pattern that _PIECE equals on such words
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> dict[int, str]:
    """The character that byte-level pieces write for each byte: itself if visible, else 256 and up."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class WordTokenizer:
    """Token ids of a text by the given tokenizer file, remembered by word.

    The tokenizer drops white space and never joins across it, so a text's
    ids are its words' ids in a row.  A new word of Latin letters is parted
    into the pre-tokenizer's pieces, and new pieces go to the tokenizer's
    model; any other word goes through the whole tokenizer.  The memory is
    emptied at ``limit`` words.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == [
            "Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == _PATTERN
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        self.plain = self.by_piece and not any(_PLAIN.fullmatch(x) or not x.strip(_MARKS) for x in special)
        self.chars = _byte_chars()                 # for str.translate
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}         # unsigned 32-bit ids
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)      # first id of word i; at[i + 1] ends it
        self.used = 0

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.chars)
            ids = self.pieces[piece] = array("I", [t.id for t in self.tok.model.tokenize(raw)]).tobytes()
        return ids

    def _ids(self, word: str) -> bytes:
        if not self.by_piece or not _LATIN.fullmatch(word) or self.special.search(word):
            return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._piece, _PIECE.findall(word.lower())))

    def _learn(self, words) -> None:
        # No special token lies in a plain word.
        rows, known, new, plain = [], self.pieces.get, self._piece, self.plain
        for w in words:
            letters = w.rstrip(_MARKS)
            if plain and letters.isalpha() and (letters.isascii() or _PLAIN.fullmatch(w)):
                marks = w[len(letters):]
                letters = letters.lower()
                ids = known(letters) or new(letters)
                rows.append(ids + (known(marks) or new(marks)) if marks else ids)
            else:
                rows.append(self._ids(w) if w else b"")
        sizes = np.fromiter(map(len, rows), np.int64, count=len(rows)) // 4
        n, size = len(self.index), int(sizes.sum())
        while n + len(rows) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
        while self.used + size > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used:self.used + size] = np.frombuffer(b"".join(rows), np.uint32)
        self.at[n + 1:n + 1 + len(rows)] = self.used + np.cumsum(sizes)
        self.used += size
        self.index.update(zip(words, range(n, n + len(rows))))

    def texts(self, texts: pa.Array | list) -> list[np.ndarray]:
        """Ids of every text, the end id last."""
        return list(self.each(texts))

    def each(self, texts: pa.Array | list):
        """Ids of one text after the other."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # Stretches of bounded size: each word is looked up once in a stretch.
        at = np.flatnonzero(np.diff(np.cumsum(pc.binary_length(texts).to_numpy()) // STRETCH, prepend=-1))
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(texts)]):
            yield from self._stretch(texts.slice(lo, hi - lo))

    def _stretch(self, texts: pa.Array):
        split = _split(texts)
        if len(self.index) > self.limit:
            self.forget()
        codes = split.flatten().dictionary_encode()
        words = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        w = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, count=len(words))
        new = np.flatnonzero(w < 0)
        if len(new):
            n = len(self.index)
            self._learn([words[i] for i in new.tolist()])
            w[new] = np.arange(n, n + len(new))
        code = codes.indices.to_numpy()
        counts = np.cumsum(np.r_[0, split.value_lengths().to_numpy()])
        end = np.array([END_ID], np.uint32)
        for lo in range(0, len(texts), 256):
            part = counts[lo:lo + 257]
            first = w.take(code[part[0]:part[-1]])
            size = self.at.take(first + 1)
            first = self.at.take(first)
            size -= first
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            place = np.repeat(first - (ends - size), size)
            place += np.arange(total)
            ids = self.flat.take(place)
            last = np.concatenate([[0], ends])[part - part[0]]
            for a, b in zip(last[:-1].tolist(), last[1:].tolist()):
                yield np.concatenate([ids[a:b], end])


_known: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process, kept between tasks (its words are not)."""
    if path not in _known:
        _known[path] = WordTokenizer(path)
    return _known[path]


def fill(counts: dict[int, int], capacity: int, lengths: list[int] | None = None) -> dict[int, int]:
    """Lengths and how many of each give the total closest to ``capacity``, not above it.

    Longest lengths are offered first; the program stops once the capacity
    itself is reachable.  ``counts`` holds lengths from 1 to the capacity;
    ``lengths`` are its keys in ascending order, if known.
    """
    lengths = sorted(counts) if lengths is None else lengths
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        if not counts[length]:
            continue
        steps.append((length, reach))
        left, many = min(counts[length], capacity // length), 1
        while left:                                     # binary splitting of the count
            take = min(many, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            many *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> total & 1:                  # reachable without this length?
            total -= length
            k += 1
        if k:
            used[length] = k
    return used


class Packer:
    """Pieces of one task, packed window by window from a bounded pool."""

    def __init__(self, capacity: int, pool: int, first_id: int):
        self.capacity, self.pool = capacity, pool
        self.by_length: dict[int, list] = {}
        self.counts: dict[int, int] = {}                    # pieces of each length
        self.lengths: list[int] = []                        # ascending
        self.n, self.tokens, self.next_id, self.out = 0, 0, first_id, []

    def add(self, piece: tuple) -> None:
        """piece: (doc_id, start, length, crc, doc_tokens)."""
        if piece[2] == self.capacity:
            self._emit([piece])
            return
        if piece[2] not in self.counts:
            insort(self.lengths, piece[2])
            self.by_length[piece[2]], self.counts[piece[2]] = [], 0
        self.by_length[piece[2]].append(piece)
        self.counts[piece[2]] += 1
        self.n += 1
        self.tokens += piece[2]
        if self.n > self.pool:
            while self.n > self.pool // 2 and self.tokens >= self.capacity:
                self._window()

    def _emit(self, pieces) -> None:
        offset = 0
        for p in pieces:
            self.out.append((*p, self.next_id, offset))
            offset += p[2]
        self.next_id += 1

    def _window(self, exact: bool = False) -> bool:
        """Pack one window; with ``exact`` only if it can be filled to the last token."""
        longest = self.lengths[-1]                          # each window takes the longest piece and fills up
        self.counts[longest] -= 1
        used = fill(self.counts, self.capacity - longest, self.lengths)
        self.counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        if exact and sum(x * k for x, k in used.items()) < self.capacity:
            return False
        chosen = []
        for length, k in sorted(used.items(), reverse=True):
            same = self.by_length[length]
            chosen += [same.pop() for _ in range(k)]
            self.counts[length] -= k
            if not same:
                del self.by_length[length], self.counts[length], self.lengths[bisect_left(self.lengths, length)]
        self.n -= len(chosen)
        self.tokens -= sum(p[2] for p in chosen)
        self._emit(chosen)
        return True

    def finish(self, close: bool) -> None:
        """Pack what is left: all of it (``close``), or full windows once few pieces are left.

        What then remains has no window yet.
        """
        while self.n and self._window(exact=not close and self.n <= LEFT):
            pass
        if not close:
            for same in self.by_length.values():
                self.out += [(*p, None, None) for p in same]
            self.by_length, self.counts, self.lengths, self.n, self.tokens = {}, {}, [], 0, 0

    def take(self, schema: pa.Schema):
        rows, self.out = self.out, []
        for i in range(0, len(rows), 50_000):
            cols = zip(*rows[i:i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def cut(ids: np.ndarray, capacity: int, filler: bool) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full windows, then the remainder (in powers of two for a filler)."""
    out = [(a, capacity) for a in range(0, len(ids) - capacity + 1, capacity)]
    a = len(out) * capacity
    rest = len(ids) - a
    while rest:
        step = 1 << (rest.bit_length() - 1) if filler else rest
        out.append((a, step))
        a, rest = a + step, rest - step
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, pool: int = POOL, filler_every: int = FILLER_EVERY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(PIECES.format(id=docs.schema[id_col].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        tok = _tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId()
        packer = Packer(capacity, pool, task << _TASK_BITS)
        n = 0
        for b in batches:
            ids_col, text_rows = b.column(0).to_pylist(), b.column(1)
            for doc, ids in zip(ids_col, tok.each(text_rows)):
                n += 1
                raw = ids.astype("<u4", copy=False)
                for a, size in cut(ids, capacity, filler_every > 0 and n % filler_every == 1):
                    packer.add((doc, a, size, zlib.crc32(raw[a:a + size].tobytes()), len(ids)))
            yield from packer.take(arrow)
        tok.forget()                              # the worker lives on in later stages
        packer.finish(close=False)
        yield from packer.take(arrow)

    def run_rest(batches):
        packer = Packer(capacity, pool, 1 << 62 | TaskContext.get().partitionId() << _TASK_BITS)
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                packer.add(row)
        packer.finish(close=True)
        yield from packer.take(arrow)

    first = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                        .mapInArrow(run, schema), "pack")
    rest = first.filter("sequence_id is null")
    tasks = 1 + rest.count() // 100_000
    return first.filter("sequence_id is not null").unionByName(
        rest.repartition(tasks).mapInArrow(run_rest, schema))
