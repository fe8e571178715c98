"""Building blocks for the DuckDB oracle SQL.

The oracle is an independent SQL formulation of each operator; these helpers
only splice the same fixed values (patterns, scores) into SQL text.
"""

from __future__ import annotations

from veilspark.functions import pii as P


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_VALID = {
    "EMAIL_ADDRESS": lambda v: f"regexp_matches({v}, {q(P.EMAIL_OK)})",
    "IP_ADDRESS": lambda v: (f"(regexp_matches({v}, {q(P.IP_OK)}) AND list_bool_and(list_transform("
                             f"string_split({v}, '.'), lambda o: TRY_CAST(o AS INTEGER) <= 255)))"),
    "CREDIT_CARD": lambda v: luhn_sql(v),
    "PHONE_NUMBER": lambda v: "TRUE",
    "US_SSN": lambda v: f"(regexp_matches({v}, {q(P.SSN_OK)}) AND NOT regexp_matches({v}, {q(P.SSN_BAD)}))",
    "DATE_TIME": lambda v: (
        f"(CASE WHEN {v} LIKE '____-%' THEN TRY_CAST(substring({v}, 6, 2) AS INTEGER) BETWEEN 1 AND 12"
        f" AND TRY_CAST(substring({v}, 9, 2) AS INTEGER) BETWEEN 1 AND 31"
        f" WHEN {v} LIKE '%/%' THEN least(TRY_CAST(split_part({v}, '/', 1) AS INTEGER), TRY_CAST(split_part({v}, '/', 2)"
        f" AS INTEGER)) BETWEEN 1 AND 12 AND greatest(TRY_CAST(split_part({v}, '/', 1) AS INTEGER),"
        f" TRY_CAST(split_part({v}, '/', 2) AS INTEGER)) <= 31"
        f" ELSE TRY_CAST(replace(split_part({v}, ' ', 2), ',', '') AS INTEGER) BETWEEN 1 AND 31 END)"),
    "US_PASSPORT": lambda v: f"regexp_matches({v}, {q(P.PASSPORT_OK)})",
    "US_BANK_NUMBER": lambda v: f"regexp_matches({v}, {q(P.BANK_OK)})",
}


def luhn_sql(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"CAST(substring({d}, length({d}) - i + 1, 1) AS INTEGER)"
    term = f"CASE WHEN i % 2 = 0 THEN (CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END) ELSE {digit} END"
    total = f"coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: {term})), 0)"
    return f"(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def match_rows_sql(src: str, key: str, text: str, pattern: str) -> str:
    """Rows (key, text, start, end, value) for every match of pattern in text."""
    rx = q(pattern)
    return f"""(
  SELECT {key}, {text} AS text, CAST(start_ AS INTEGER) AS start,
         CAST(start_ + length(value) AS INTEGER) AS "end", value
  FROM (
    SELECT {key}, {text}, ms[i] AS value,
           coalesce(list_sum(list_transform(segs[1:i], lambda s: length(s))), 0)
         + coalesce(list_sum(list_transform(ms[1:i-1], lambda s: length(s))), 0) AS start_
    FROM (
      SELECT {key}, {text}, ms, segs, unnest(generate_series(1, len(ms))) AS i
      FROM (SELECT {key}, {text}, regexp_extract_all({text}, {rx}) AS ms,
                   string_split_regex({text}, {rx}) AS segs FROM {src})
    )
  )
)"""


def type_spans_sql(src: str, key: str, text: str, pii_type: str, threshold: float = 0.0) -> str:
    """Rows (key, text, start, end, pii_type, score, value) for one pattern type."""
    det = P.DETECTORS[pii_type]
    score = num(det.score)
    if det.context:
        ctx = "substring(text, greatest(start - %d, 0) + 1, start - greatest(start - %d, 0))" % (
            P.CONTEXT_WIDTH, P.CONTEXT_WIDTH)
        boosted = num(min(1.0, det.score + P.CONTEXT_BOOST))
        score = f"CASE WHEN regexp_matches({ctx}, {q(det.context)}) THEN {boosted} ELSE {score} END"
    rows = match_rows_sql(src, key, text, det.pattern)
    whole = ""
    if pii_type in ("CREDIT_CARD", "PHONE_NUMBER", "DATE_TIME"):
        whole = (" AND NOT (start > 0 AND substring(text, start, 1) BETWEEN '0' AND '9')"
                 " AND NOT coalesce(substring(text, \"end\" + 1, 1) BETWEEN '0' AND '9', FALSE)")
    sql = f"""SELECT {key}, text, start, "end", {q(pii_type)} AS pii_type, {score} AS score, value
FROM {rows} WHERE {_VALID[pii_type]('value')}{whole}"""
    if threshold > 0:
        sql = f"SELECT * FROM ({sql}) WHERE score >= {num(threshold)}"
    return sql


SPAN_STRUCT = 'STRUCT(start INTEGER, "end" INTEGER, pii_type VARCHAR, score DOUBLE)'


def spans_list_sql(span_rows: str, key: str) -> str:
    """(key, sp) with sp the list of span structs per key."""
    return f"""SELECT {key}, list({{'start': start, 'end': "end", 'pii_type': pii_type, 'score': score}}) AS sp
FROM ({span_rows}) GROUP BY {key}"""


def resolve_overlaps_sql(sp: str) -> str:
    """Greedy cross-type overlap removal by priority, as a list expression."""
    ranked = (f"list_transform(list_sort(list_transform({sp}, lambda s: {{'ns': -s.score, "
              f"'nl': -(s.\"end\" - s.start), 'start': s.start, 'pii_type': s.pii_type, "
              f"'end': s.\"end\", 'score': s.score}})), lambda s: {{'start': s.start, 'end': s.\"end\", "
              f"'pii_type': s.pii_type, 'score': s.score}})")
    return (f"list_reduce({ranked}, lambda acc, s: CASE WHEN len(list_filter(acc, lambda k: "
            f"k.pii_type <> s.pii_type AND k.start < s.\"end\" AND s.start < k.\"end\")) > 0 "
            f"THEN acc ELSE list_append(acc, s) END, []::{SPAN_STRUCT}[])")


def merge_sql(sp: str) -> str:
    ordered = (f"list_transform(list_sort(list_transform({sp}, lambda s: {{'start': s.start, "
               f"'ne': -s.\"end\", 'pii_type': s.pii_type, 'end': s.\"end\", 'score': s.score}})), "
               f"lambda s: {{'start': s.start, 'end': s.\"end\", 'pii_type': s.pii_type, 'score': s.score}})")
    grown = ("{'start': acc[-1].start, 'end': greatest(acc[-1].\"end\", s.\"end\"), "
             "'pii_type': acc[-1].pii_type, 'score': greatest(acc[-1].score, s.score)}")
    return (f"list_reduce({ordered}, lambda acc, s: CASE WHEN len(acc) > 0 AND acc[-1].pii_type = s.pii_type "
            f"AND acc[-1].\"end\" > s.start - 2 THEN list_append(acc[1:len(acc)-1], {grown}) "
            f"ELSE list_append(acc, s) END, []::{SPAN_STRUCT}[])")


def resolve_sql(values: str, mode: str) -> str:
    if mode.upper() == "EQUALITY":
        return values
    folded = (f"list_reduce({values}, lambda acc, x: list_append(acc, {{'v': x, 'r': coalesce("
              f"list_filter(acc, lambda e: e.v = e.r AND (contains(x, e.r) OR contains(e.r, x)))[1].r, x)}}), "
              f"[]::STRUCT(v VARCHAR, r VARCHAR)[])")
    return f"list_transform({folded}, lambda e: e.r)"


def sha_token_sql(v: str, secret: str) -> str:
    return f"to_base64(unhex(sha256({q(secret)} || '#' || {v})))"


def rebuild_sql(text: str, m: str, toks: str) -> str:
    prev = f"(CASE WHEN i = 1 THEN 0 ELSE {m}[i-1].\"end\" END)"
    body = (f"array_to_string(list_transform(range(1, len({m}) + 1), lambda i: "
            f"substring({text}, {prev} + 1, {m}[i].start - {prev}) || {toks}[i]), '')")
    last = f"{m}[len({m})].\"end\""
    return (f"CASE WHEN {m} IS NULL OR len({m}) = 0 THEN {text} ELSE {body} || "
            f"substring({text}, {last} + 1, greatest(length({text}) - {last}, 0)) END")


def token_counts_sql(src: str, key: str, text: str, types, threshold: float = 0.0) -> str:
    """(key, n_tokens): how many merged spans a text has."""
    parts = [type_spans_sql(src, key, text, t, threshold) for t in types if t in P.DETECTORS]
    rows = " UNION ALL ".join(f'SELECT {key}, start, "end", pii_type, score FROM ({p})' for p in parts)
    return f"""SELECT d.{key}, CAST(coalesce(len({merge_sql(resolve_overlaps_sql('s.sp'))}), 0) AS INTEGER) AS n_tokens
FROM {src} d LEFT JOIN ({spans_list_sql(rows, key)}) s ON d.{key} = s.{key}"""


def anonymize_sql(src: str, key: str, text: str, types, secret: str, resolution: str,
                  threshold: float = 0.0, extra_span_rows: str | None = None, label: bool = False) -> str:
    """(key, text) with PII replaced by sha tokens (or type names), as one SELECT."""
    toks = "list_transform(m, lambda s: 'α' || s.pii_type || 'α')" if label else \
        f"list_transform(reps, lambda r: 'α' || {sha_token_sql('r', secret)} || 'α')"
    parts = [type_spans_sql(src, key, text, t, threshold) for t in types if t in P.DETECTORS]
    rows = " UNION ALL ".join(f'SELECT {key}, start, "end", pii_type, score FROM ({p})' for p in parts)
    if extra_span_rows:
        rows = rows + f' UNION ALL SELECT {key}, start, "end", pii_type, score FROM ({extra_span_rows})'
    return f"""WITH spl AS ({spans_list_sql(rows, key)}),
m AS (SELECT s.{key}, {merge_sql(resolve_overlaps_sql('s.sp'))} AS m FROM spl s),
j AS (SELECT d.{key}, d.{text} AS text, m.m FROM {src} d LEFT JOIN m ON d.{key} = m.{key}),
v AS (SELECT {key}, text, m, {resolve_sql("list_transform(m, lambda s: substring(text, s.start + 1, s.\"end\" - s.start))", resolution)} AS reps FROM j),
t AS (SELECT {key}, text, m, {toks} AS toks FROM v)
SELECT {key}, {rebuild_sql('text', 'm', 'toks')} AS {text} FROM t"""
