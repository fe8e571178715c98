"""Span arithmetic as Column expressions (no Python at run time).

A span is ``struct<start:int, end:int, pii_type:string, score:double>`` with a
0-based code-point ``start`` and exclusive ``end``, exactly like Python slices.
All functions here build a single projection; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.entities import containment_column

SPAN = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("pii_type", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
SPANS = T.ArrayType(SPAN)

_MATCH = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("value", T.StringType()),
])
MATCHES = T.ArrayType(_MATCH)


def regex_matches(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` with their offsets.

    Offsets come from pairing ``split`` (the text between matches) with
    ``regexp_extract_all`` (the matches): both walk the text with the same
    left-to-right search, so match *i* starts after segments ``0..i`` and
    matches ``0..i-1``.  Returns ``array<struct<start,end,value>>``.
    Each regex runs once per row (higher-order functions are interpreted, so
    an expression referenced twice would be evaluated twice).
    """
    segs = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(segs.alias("s"), found.alias("m"))   # the last pair has m = NULL
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(MATCHES).alias("out"))

    def step(acc, x):
        st = acc["pos"] + F.length(x["s"])
        en = st + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(en.alias("pos"), F.array_append(
            acc["out"], F.struct(st.cast("int").alias("start"), en.cast("int").alias("end"),
                                 x["m"].alias("value"))).alias("out")))

    return F.aggregate(pairs, init, step)["out"]


def context_before(text: Column, start: Column, width: int) -> Column:
    """Up to ``width`` characters before a 0-based ``start``."""
    lo = F.greatest(start - F.lit(width), F.lit(0))
    return F.substring(text, lo + 1, start - lo)


def surface(text: Column, span: Column) -> Column:
    """The substring a span covers."""
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def drop_cross_type_overlaps(spans: Column) -> Column:
    """Resolve overlaps between spans of *different* types.

    Spans are visited by priority (score desc, length desc, start asc, type);
    a span is kept unless it overlaps an already kept span of another type.
    Same-type overlaps are left for :func:`merge_spans`.
    """
    ranked = F.array_sort(spans, lambda a, b: _priority_cmp(a, b))

    def keep(acc, s):
        clash = F.exists(acc, lambda k: (k["pii_type"] != s["pii_type"])
                         & (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(clash, acc).otherwise(F.array_append(acc, s))

    return F.aggregate(ranked, F.array().cast(SPANS), keep)


def _priority_cmp(a: Column, b: Column) -> Column:
    la = a["end"] - a["start"]
    lb = b["end"] - b["start"]
    return (F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
            .when(la > lb, -1).when(la < lb, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["pii_type"] < b["pii_type"], -1).when(a["pii_type"] > b["pii_type"], 1)
            .otherwise(0))


def sort_by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1)
                        .when(a["start"] > b["start"], 1)
                        .when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1)
                        .otherwise(0))


def merge_spans(spans: Column) -> Column:
    """Merge runs of same-type spans that overlap, touch or leave a gap of one.

    Visit spans by start; the next span joins the current one when it has the
    same type and ``end > next.start - 2``.  The merged end is the larger of
    the two ends, so a nested shorter span never shrinks the merge.
    """
    ordered = sort_by_start(spans)

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (last["pii_type"] == s["pii_type"]) \
            & (last["end"] > s["start"] - 2)
        grown = F.struct(last["start"].alias("start"),
                         F.greatest(last["end"], s["end"]).alias("end"),
                         last["pii_type"].alias("pii_type"),
                         F.greatest(last["score"], s["score"]).alias("score"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))) \
            .otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, F.array().cast(SPANS), step)


def resolve_entities(values: Column, mode: str = "EQUALITY") -> Column:
    """Map each surface string (in text order) to its representative.

    EQUALITY: a string is its own representative.
    CONTAINMENT: a string takes the first earlier representative that contains
    it or that it contains; otherwise it becomes a new representative.  Matched
    variants are not added, so the relation is greedy and not transitive.
    Returns ``array<string>`` aligned with ``values``.
    """
    m = mode.upper()
    if m == "EQUALITY":
        return values
    if m != "CONTAINMENT":
        raise ValueError(f"unknown entity resolution {mode!r}")
    return containment_column(values)
