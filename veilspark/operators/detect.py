"""Find PII spans.

Pattern types run as one projection per row (JVM regex, no Python, no
shuffle).  Name-like types (PERSON, LOCATION, NRP) come from a dictionary
table, whose terms of any length are found in one pass per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.pii import (DETECTORS, GAZETTEER_TYPES, SCORES, detector_spans,
                                     normalize_types)
from veilspark.functions.spans import SPANS
from veilspark.operators.dictionary import MAX_BYTES, PHRASE_TOKEN_RX, term_column, term_rows

__all__ = ["PHRASE_TOKEN_RX", "detect_pii", "dictionary_spans", "explode_spans", "pattern_spans"]

def pattern_spans(text: Column, types=None, threshold: float = 0.0) -> Column:
    """All validated spans of the requested pattern types with score >= threshold."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [0, 1]")
    wanted = [t for t in normalize_types(types) if t in DETECTORS]
    if not wanted:
        return F.array().cast(SPANS)
    # Cheap guards skip whole groups of detectors on rows that cannot match:
    # every numeric detector needs a digit, the e-mail detector needs an '@'.
    empty = F.array().cast(SPANS)
    groups: dict[str, list] = {}
    for t in wanted:
        groups.setdefault(DETECTORS[t].needs or "", []).append(detector_spans(text, DETECTORS[t]))
    parts = []
    for need, dets in groups.items():
        spans = dets[0] if len(dets) == 1 else F.concat(*dets)
        if need == "digit":
            spans = F.when(text.rlike("[0-9]"), spans).otherwise(empty)
        elif need:
            spans = F.when(F.instr(text, need) > 0, spans).otherwise(empty)
        parts.append(spans)
    allspans = parts[0] if len(parts) == 1 else F.concat(*parts)
    if threshold > 0:
        allspans = F.filter(allspans, lambda s: s["score"] >= F.lit(threshold))
    return allspans


def no_pattern(text: Column, types=None) -> Column:
    """True where the guards of :func:`pattern_spans` alone say that no detector of these types can match."""
    needs = {DETECTORS[t].needs or "" for t in normalize_types(types) if t in DETECTORS}
    if "" in needs:
        return F.lit(False)
    cond = F.lit(True)
    for need in sorted(needs):
        cond = cond & (~text.rlike("[0-9]") if need == "digit" else F.instr(text, need) == 0)
    return cond


def _term_scores(types) -> dict[str, float]:
    return {t: SCORES[t] for t in normalize_types(types) if t in GAZETTEER_TYPES}


def dictionary_spans(df: DataFrame, key_col: str, text_col: str, dictionary: DataFrame,
                     types=None, threshold: float = 0.0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, spans) for dictionary types; rows without a hit are absent.

    ``dictionary`` has columns ``term`` and ``pii_type``; terms may have any
    number of words (see :mod:`dictionary`).
    """
    find = term_column(dictionary, _term_scores(types), threshold, max_bytes)
    if find is not None:
        return df.select(key_col, find(F.col(text_col)).alias("_dict_spans")).where(F.size("_dict_spans") > 0)
    return term_rows(df, key_col, text_col, dictionary, _term_scores(types), threshold).groupBy(key_col).agg(
        F.collect_list(F.struct("start", "end", "pii_type", "score")).alias("_dict_spans"))


def detect_pii(df: DataFrame, text_col: str = "text", types=None, threshold: float = 0.0,
               out_col: str = "pii", key_col: str | None = None,
               dictionary: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``out_col: array<struct<start,end,pii_type,score>>`` to ``df``.

    ``types`` restricts the detectors before the plan is built (empty = all);
    spans scoring under ``threshold`` are dropped.  Dictionary types need
    ``dictionary``, and one that is too large to hold (``max_bytes``) also a
    ``key_col`` that is unique per row.
    """
    types = normalize_types(types)
    out = df.withColumn(out_col, pattern_spans(F.col(text_col), types, threshold))
    if dictionary is not None and any(t in GAZETTEER_TYPES for t in types):
        find = term_column(dictionary, _term_scores(types), threshold, max_bytes)
        if find is not None:
            return out.withColumn(out_col, F.concat(F.col(out_col), find(F.col(text_col))))
        if key_col is None:
            raise ValueError("a dictionary of this size needs a unique key_col")
        found = dictionary_spans(df, key_col, text_col, dictionary, types, threshold, max_bytes)
        out = out.join(found, key_col, "left").withColumn(
            out_col, F.concat(F.col(out_col), F.coalesce(F.col("_dict_spans"), F.array().cast(SPANS)))
        ).drop("_dict_spans")
    return out


def explode_spans(df: DataFrame, key_cols, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Long form: one row per span with its surface value."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    # Of a plain column, the optimizer would infer size(spans) > 0 and push it to the scan, where every
    # detector then runs twice more, before any join or repartition; an expression is exploded as it is.
    e = df.select(*keys, F.col(text_col), F.explode(F.flatten(F.array(spans_col))).alias("s"))
    return e.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                    F.col("s.pii_type").alias("pii_type"), F.col("s.score").alias("score"),
                    F.substring(F.col(text_col), F.col("s.start") + 1,
                                F.col("s.end") - F.col("s.start")).alias("value"))
