"""Greedy containment over one row's entities, without comparing every pair.

A string takes the first earlier representative that contains it or that it
contains; otherwise it becomes a representative.  Representatives are indexed
as they come: whole strings by length (is one of them inside the new string?)
and their one- to three-character pieces (which of them can hold the new
string?), so a string meets the representatives that share its rarest piece.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3


class Representatives:
    """Representatives of one row, in the order they came."""

    def __init__(self):
        self.reps: list[str] = []
        self.by_length: dict[int, dict[str, int]] = {}
        self.pieces: dict[str, list[int]] = {}

    def of(self, value: str) -> str:
        first = len(self.reps)
        for size, known in self.by_length.items():       # a representative inside the value
            if size <= len(value):
                for i in range(len(value) - size + 1):
                    first = min(first, known.get(value[i:i + size], first))
        n = min(GRAM, len(value))                        # the value inside a representative
        holders = min((self.pieces.get(value[i:i + n], ()) for i in range(len(value) - n + 1)), key=len, default=())
        for at in holders:
            if at >= first:
                break
            if value in self.reps[at]:
                first = at
                break
        if first < len(self.reps):
            return self.reps[first]
        self.reps.append(value)
        self.by_length.setdefault(len(value), {})[value] = first
        for k in range(1, GRAM + 1):
            for piece in {value[i:i + k] for i in range(len(value) - k + 1)}:
                self.pieces.setdefault(piece, []).append(first)
        return value


def resolve_containment(values: list) -> list:
    """The representative of every string (NULL stays NULL), in order."""
    known = Representatives()
    return [None if v is None else known.of(v) if v else v for v in values]


def containment_column(values: Column) -> Column:
    """``array<string>`` -> representatives, aligned with the values."""
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else resolve_containment(r) for r in rows.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(values)
