"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_dedup(rows: list[tuple[int, str]], line_hash, min_words: int):
    """{doc_id: kept text}.  ``line_hash``: line -> the number that orders the window minima."""
    docs = {d: t.split("\n") for d, t in rows}
    n = {d: [len(WORD.findall(x)) for x in ls] for d, ls in docs.items()}
    key = {d: ["" if not k else x for x, k in zip(ls, n[d])] for d, ls in docs.items()}
    prints = []
    for d, ls in docs.items():
        total = sum(n[d])
        for i in range(len(ls)):
            if sum(n[d][:i]) + min_words > total:
                break
            best, j, s = None, i, 0
            lo = i
            while lo and not n[d][lo - 1]:          # equal starts are peers
                lo -= 1
            for j in range(lo, len(ls)):
                if s >= min_words:
                    break
                if n[d][j]:
                    cand = (line_hash(ls[j]), -j)
                    best = cand if best is None or cand < best else best
                s += n[d][j]
            prints.append((d, -best[1], ls[-best[1]]))
    prints = sorted(set(prints))
    first = {}
    for d, i, x in prints:
        first.setdefault(x, (d, i))
    gone = {d: set() for d in docs}
    for d, i, x in prints:
        d0, i0 = first[x]
        if (d0, i0) == (d, i):
            continue
        a, b = i, i
        while a and a - (i - i0) > 0 and key[d][a - 1] == key[d0][a - 1 - (i - i0)]:
            a -= 1
        while b + 1 < len(key[d]) and b + 1 - (i - i0) < len(key[d0]) and key[d][b + 1] == key[d0][b + 1 - (i - i0)]:
            b += 1
        if sum(n[d][a:b + 1]) >= min_words:
            gone[d] |= set(range(a, b + 1))
    return {d: "\n".join(x for i, x in enumerate(ls) if i not in gone[d]) for d, ls in docs.items()}


def suffix_dedup(rows: list[tuple[int, bytes]], length: int):
    """{doc_id: (removed bytes, runs, kept bytes)} by counting every string."""
    seen: dict[bytes, int] = {}
    for _, t in rows:
        for i in range(len(t) - length + 1):
            s = t[i:i + length]
            seen[s] = seen.get(s, 0) + 1
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g))
    return out
