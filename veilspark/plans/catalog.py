"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle each.

Every query reads the driver tables under ``sf_dir`` in full; the oracle SQL
runs on the same tables registered as views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.fixed import ALIAS_LEN
from veilspark.functions import pii as P
from veilspark.operators.anonymize import anonymize, deanonymize
from veilspark.operators.detect import detect_pii, explode_spans
from veilspark.plans import sqlgen as S

# --- fixed values: demo secret used by the registered checks (not a real key)
DEMO_SECRET = "veilspark-demo-secret"
DEMO_SALT = "run-0"
FLAGSHIP = "rag_requests"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    """Register a query; ``oracle`` makes its SQL when it is asked for, not while this module loads."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def oracle_sql(name: str) -> str | None:
    """DuckDB SQL of one query (None where SQL cannot say it)."""
    return ORACLES[name]() if name in ORACLES else None


# Text-heavy tables and the key their rows are spread by (see sizing.balance).
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "customer": "c_custkey"}


def table(spark: SparkSession, sf_dir: str, name: str, balanced: bool = True) -> DataFrame:
    """Read a driver table; the session may ask for ``balanced`` scans (see sizing)."""
    from veilspark.plans.sizing import balance
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balance(df, TEXT_TABLES[name]) if balanced and name in TEXT_TABLES else df


def customer_rows(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Customers as input of made texts: 20 bytes a row in the file and milliseconds of detectors, so dealt over all cores."""
    from veilspark.plans.sizing import spread
    return spread(table(spark, sf_dir, "customer", balanced=False).select(*cols))


# ---------------------------------------------------------------- P1 detectors
def _type_query(pii_type: str):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        d = detect_pii(docs, "text", types=[pii_type])
        return explode_spans(d, "doc_id").select("doc_id", "start", "end", "pii_type", "score", "value")
    return run


def _type_oracle(pii_type: str) -> str:
    return (f'SELECT doc_id, start, "end", pii_type, score, value FROM '
            f'({S.type_spans_sql("documents", "doc_id", "text", pii_type)})')


for _name, _t in [("pii_email", "EMAIL_ADDRESS"), ("pii_ip", "IP_ADDRESS"),
                  ("pii_card", "CREDIT_CARD"), ("pii_phone", "PHONE_NUMBER"),
                  ("pii_date", "DATE_TIME")]:
    register(_name, lambda t=_t: _type_oracle(t))(_type_query(_t))

PATTERN_ALL = list(P.PATTERN_TYPES)


def token_count(text):
    """Well-formed tokens in a stored text."""
    return F.size(F.regexp_extract_all(text, F.lit("α[A-Za-z0-9+/=]+α"), F.lit(0)))


# ---------------------------------------------------------------- P2-P5 anonymize (mask)
@register("anonymize_mask", lambda: S.anonymize_sql("documents", "doc_id", "text", PATTERN_ALL,
                                             DEMO_SECRET, "EQUALITY", threshold=0.5))
def q_anonymize_mask(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return anonymize(docs, "text", DEMO_SECRET, mode="sha", resolution="EQUALITY",
                     types=PATTERN_ALL, threshold=0.5)


# The key comes from a one-row table (here: the first region's name) and is in no plan.
@register("anonymize_key_table", lambda: S.anonymize_sql("documents", "doc_id", "text", PATTERN_ALL, "AFRICA", "EQUALITY", threshold=0.5))
def q_anonymize_key_table(spark, sf_dir):
    from veilspark.operators.anonymize import secret_of
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = table(spark, sf_dir, "region").agg(F.min("r_name").alias("secret"))
    return anonymize(docs, "text", secret_of(key), mode="sha", types=PATTERN_ALL, threshold=0.5)


@register("anonymize_label", lambda: S.anonymize_sql("documents", "doc_id", "text", PATTERN_ALL,
                                                      DEMO_SECRET, "EQUALITY", threshold=0.5, label=True))
def q_anonymize_label(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return anonymize(docs, "text", DEMO_SECRET, mode="label", types=PATTERN_ALL, threshold=0.5)


# ---------------------------------------------------------------- P5+P6 round trip
@register("anonymize_roundtrip",
          lambda: f"""SELECT d.doc_id, d.text, FALSE AS malformed, n.n_tokens FROM documents d
JOIN ({S.token_counts_sql('documents', 'doc_id', 'text', PATTERN_ALL, 0.5)}) n ON d.doc_id = n.doc_id""")
def q_anonymize_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    anon = anonymize(docs, "text", DEMO_SECRET, mode="aes", resolution="EQUALITY",
                     types=PATTERN_ALL, threshold=0.5, salt=DEMO_SALT, scope="doc_id")
    return deanonymize(anon.withColumn("n_tokens", token_count(F.col("text"))), "text", DEMO_SECRET)


# Greek text: every "e" becomes the delimiter, so plain delimiters and tokens stand side by side.
GREEK_DOCS_SQL = "SELECT doc_id, replace(text, 'e', 'α') AS text FROM documents"


@register("anonymize_greek", lambda: f"""WITH gd AS ({GREEK_DOCS_SQL})
SELECT d.doc_id, d.text, FALSE AS malformed,
  len(string_split(d.text, 'α')) - 1 + n.n_tokens AS n_pairs
FROM gd d JOIN ({S.token_counts_sql('gd', 'doc_id', 'text', PATTERN_ALL, 0.5)}) n ON d.doc_id = n.doc_id""")
def q_anonymize_greek(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("e"), F.lit("α")).alias("text"))
    anon = anonymize(docs, "text", DEMO_SECRET, mode="aes", types=PATTERN_ALL, threshold=0.5, salt=DEMO_SALT, scope="doc_id")
    pairs = F.floor((F.size(F.split("text", "α", -1)) - 1) / 2).cast("long")
    return deanonymize(anon.withColumn("n_pairs", pairs), "text", DEMO_SECRET)


# ---------------------------------------------------------------- synthetic PII text
# Text with names, places and US identifiers built from customer × nation by
# the same expression on both sides (the corpus itself has none of these).
def customer_text(spark, sf_dir) -> DataFrame:
    c = customer_rows(spark, sf_dir, "c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")

    def pad(x, w):
        return F.lpad(x.cast("string"), w, "0")

    text = F.concat(
        F.lit("Contact "), F.col("c_name"), F.lit(" in "), F.col("n_name"),
        F.lit(", office NATION_"), (F.col("c_nationkey") % 10).cast("string"),
        F.lit(". Call +1 ("), pad(k % 900 + 100, 3), F.lit(") 555-"), pad(k % 10000, 4),
        F.lit(", SSN "), pad(k % 800 + 100, 3), F.lit("-"), pad(k % 89 + 10, 2), F.lit("-"),
        pad(k % 8999 + 1000, 4), F.lit(", passport P"), pad(k, 8),
        F.lit(", account "), pad(k * 7919 % 1000000000000, 12), F.lit(" or ref "), pad(k, 9),
        F.lit(". Ask "), F.col("c_name"), F.lit(" about NATION_"),
        (F.col("c_nationkey") % 10).cast("string"), F.lit("."))
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", text.alias("text"))


CUSTOMER_TEXT_SQL = """SELECT c_custkey, 'Contact ' || c_name || ' in ' || n_name || ', office NATION_'
  || CAST(c_nationkey % 10 AS VARCHAR) || '. Call +1 (' || lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0')
  || ') 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
  || ', SSN ' || lpad(CAST(c_custkey % 800 + 100 AS VARCHAR), 3, '0') || '-'
  || lpad(CAST(c_custkey % 89 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 8999 + 1000 AS VARCHAR), 4, '0')
  || ', passport P' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
  || ', account ' || lpad(CAST(c_custkey * 7919 % 1000000000000 AS VARCHAR), 12, '0')
  || ' or ref ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
  || '. Ask ' || c_name || ' about NATION_' || CAST(c_nationkey % 10 AS VARCHAR) || '.' AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def name_dictionary(spark, sf_dir) -> DataFrame:
    """Gazetteer (term, pii_type) derived from the tables: people and places."""
    people = table(spark, sf_dir, "customer", balanced=False).select(F.col("c_name").alias("term"),
                                                     F.lit("PERSON").alias("pii_type"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"),
                                                    F.lit("LOCATION").alias("pii_type"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("term"),
                                                    F.lit("LOCATION").alias("pii_type"))
    return people.unionByName(nations).unionByName(regions)


DICTIONARY_SQL = """SELECT DISTINCT term, pii_type FROM (
  SELECT c_name AS term, 'PERSON' AS pii_type FROM customer
  UNION ALL SELECT n_name, 'LOCATION' FROM nation
  UNION ALL SELECT r_name, 'LOCATION' FROM region)"""


def dictionary_span_rows_sql(src: str, key: str, dictionary: str = DICTIONARY_SQL, words: int = 3) -> str:
    """(key, start, end, pii_type, score) for dictionary hits of phrases up to ``words`` words."""
    from veilspark.operators.detect import PHRASE_TOKEN_RX
    toks = S.match_rows_sql(src, key, "text", PHRASE_TOKEN_RX)
    return f"""SELECT g.{key}, g.start, g."end", dct.pii_type, {S.num(P.SCORES['PERSON'])} AS score
FROM (
  SELECT {key}, text, toks[i].start AS start, toks[i + n - 1]."end" AS "end"
  FROM (SELECT {key}, text, toks, n, unnest(generate_series(1, len(toks) - n + 1)) AS i
        FROM (SELECT {key}, text, list({{'start': start, 'end': "end"}} ORDER BY start) AS toks
              FROM {toks} GROUP BY {key}, text), (SELECT unnest(generate_series(1, {words})) AS n))
) g JOIN ({dictionary}) dct ON substring(g.text, g.start + 1, g."end" - g.start) = dct.term"""


def _cust_spans(spark, sf_dir, types, threshold):
    d = detect_pii(customer_text(spark, sf_dir), "text", types=types, threshold=threshold,
                   key_col="c_custkey", dictionary=name_dictionary(spark, sf_dir))
    return d


@register("pii_us_ids", lambda: f"""WITH cust_text AS ({CUSTOMER_TEXT_SQL})
SELECT c_custkey, start, "end", pii_type, score, value FROM (
  {S.type_spans_sql('cust_text', 'c_custkey', 'text', 'US_SSN')}
  UNION ALL {S.type_spans_sql('cust_text', 'c_custkey', 'text', 'US_PASSPORT')}
  UNION ALL {S.type_spans_sql('cust_text', 'c_custkey', 'text', 'US_BANK_NUMBER')})""")
def q_pii_us_ids(spark, sf_dir):
    d = _cust_spans(spark, sf_dir, ["US_SSN", "US_PASSPORT", "US_BANK_NUMBER"], 0.0)
    return explode_spans(d, "c_custkey").select("c_custkey", "start", "end", "pii_type", "score", "value")


# Dictionary detection over documents: terms are word sequences that the corpus holds (from benchmark
# items), as groups (NRP), next to the people and places of the other tables.
TERM_RX = r"^[\p{L}]+ [\p{L}]+"
DOC_DICTIONARY_SQL = f"""SELECT DISTINCT regexp_extract(text, {S.q(TERM_RX)}) AS term, 'NRP' AS pii_type FROM benchmark
WHERE regexp_extract(text, {S.q(TERM_RX)}) <> '' UNION ({DICTIONARY_SQL})"""


@register("gazetteer_documents", lambda: f"""SELECT doc_id, start, "end", pii_type, score
FROM ({dictionary_span_rows_sql('documents', 'doc_id', DOC_DICTIONARY_SQL)})""")
def q_gazetteer_documents(spark, sf_dir):
    from veilspark.operators.detect import dictionary_spans
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", TERM_RX, 0).alias("term"),
                                                     F.lit("NRP").alias("pii_type")).where("term <> ''")
    d = dictionary_spans(docs, "doc_id", "text", terms.unionByName(name_dictionary(spark, sf_dir)))
    return d.select("doc_id", F.explode("_dict_spans").alias("s")).select("doc_id", "s.start", "s.end", "s.pii_type", "s.score")


# Terms of four to eight words: how benchmark passages begin; documents hold many of these passages.
LONG_TERM_RX = r"^[\p{L}]+(?: [\p{L}]+){3,7}"
LONG_DICTIONARY_SQL = f"""SELECT DISTINCT term, 'NRP' AS pii_type FROM (
  SELECT array_to_string(string_split(t, ' ')[1:n], ' ') AS term FROM (
    SELECT regexp_extract(text, {S.q(LONG_TERM_RX)}) AS t, unnest([4, 5, 6, 7, 8]) AS n FROM benchmark)
  WHERE t <> '')"""


@register("gazetteer_long_terms", lambda: f"""SELECT doc_id, start, "end", pii_type, score
FROM ({dictionary_span_rows_sql('documents', 'doc_id', LONG_DICTIONARY_SQL, words=8)})""")
def q_gazetteer_long_terms(spark, sf_dir):
    """Names of many words: every beginning of 4 to 8 words is a term, so hits nest."""
    from veilspark.operators.detect import dictionary_spans
    t = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", LONG_TERM_RX, 0).alias("t")).where("t <> ''")
    n = F.explode(F.array(*[F.lit(i) for i in (4, 5, 6, 7, 8)]))
    terms = t.select("t", n.alias("n")).select(F.expr("array_join(slice(split(t, ' '), 1, n), ' ')").alias("term"),
                                               F.lit("NRP").alias("pii_type"))
    d = dictionary_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", terms)
    return d.select("doc_id", F.explode("_dict_spans").alias("s")).select("doc_id", "s.start", "s.end", "s.pii_type", "s.score")


# Numbers at their edges: a 4-6-5 card, digit runs that hold a phone or card, impossible dates.
EDGE_TEXT_SQL = """SELECT c_custkey, 'Amex 3782 822463 10005, run 55' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')
  || ' 78901234, ref 1555-123-45678, call (212) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
  || ', due ' || CAST(c_custkey % 40 AS VARCHAR) || '/' || CAST(c_custkey % 17 AS VARCHAR)
  || '/2024, on May ' || CAST(c_custkey % 35 AS VARCHAR) || ', 2024 or 99/99/2024 or 12024-01-015.' AS text FROM customer"""


def edge_text(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return customer_rows(spark, sf_dir, "c_custkey").select("c_custkey", F.concat(
        F.lit("Amex 3782 822463 10005, run 55"), F.lpad((k % 1000000).cast("string"), 6, "0"),
        F.lit(" 78901234, ref 1555-123-45678, call (212) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"),
        F.lit(", due "), (k % 40).cast("string"), F.lit("/"), (k % 17).cast("string"), F.lit("/2024, on May "),
        (k % 35).cast("string"), F.lit(", 2024 or 99/99/2024 or 12024-01-015.")).alias("text"))


@register("pii_number_edges", lambda: f"""WITH e AS ({EDGE_TEXT_SQL}), v AS (
SELECT c_custkey, text, 'CREDIT_CARD' AS pii_type, '3782 822463 10005' AS value FROM e
UNION ALL SELECT c_custkey, text, 'PHONE_NUMBER', '(212) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') FROM e
UNION ALL SELECT c_custkey, text, 'DATE_TIME', CAST(c_custkey % 40 AS VARCHAR) || '/' || CAST(c_custkey % 17 AS VARCHAR) || '/2024'
  FROM e WHERE least(c_custkey % 40, c_custkey % 17) BETWEEN 1 AND 12 AND greatest(c_custkey % 40, c_custkey % 17) <= 31
UNION ALL SELECT c_custkey, text, 'DATE_TIME', 'May ' || CAST(c_custkey % 35 AS VARCHAR) || ', 2024'
  FROM e WHERE c_custkey % 35 BETWEEN 1 AND 31)
SELECT c_custkey, CAST(strpos(text, value) - 1 AS INTEGER) AS start, CAST(strpos(text, value) - 1 + length(value) AS INTEGER) AS "end",
  pii_type, value FROM v""")
def q_pii_number_edges(spark, sf_dir):
    d = detect_pii(edge_text(spark, sf_dir), "text", types=["CREDIT_CARD", "PHONE_NUMBER", "DATE_TIME"])
    return explode_spans(d, "c_custkey").select("c_custkey", "start", "end", "pii_type", "value")


# Addresses and identifiers at their edges.  The SQL says which values count by arithmetic on the key, without any pattern.
VALUE_TEXT_SQL = """SELECT c_custkey, 'Ref ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' is open; mail jo.x+1@m-1.example.org, not a@b; host 10.0.'
  || CAST(c_custkey % 300 AS VARCHAR) || '.7, not 1.2.3.4.5 or 1.2.3; SSN ' || lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 3, '0') || '-'
  || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 50 AS VARCHAR), 4, '0')
  || ', not 1-123-45-6789; passport K' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
  || ' and no more to say about that number here; account ' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') || '.' AS text FROM customer"""


@register("pii_value_edges", lambda: f"""WITH e AS ({VALUE_TEXT_SQL}), v AS (
SELECT c_custkey, text, 'EMAIL_ADDRESS' AS pii_type, 'jo.x+1@m-1.example.org' AS value FROM e
UNION ALL SELECT c_custkey, text, 'IP_ADDRESS', '10.0.' || CAST(c_custkey % 300 AS VARCHAR) || '.7' FROM e WHERE c_custkey % 300 <= 255
UNION ALL SELECT c_custkey, text, 'US_SSN', lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 3, '0') || '-'
    || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 50 AS VARCHAR), 4, '0') FROM e
  WHERE c_custkey * 7 % 1000 NOT IN (0, 666) AND c_custkey * 7 % 1000 < 900 AND c_custkey % 100 <> 0 AND c_custkey % 50 <> 0
UNION ALL SELECT c_custkey, text, 'US_PASSPORT', 'K' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM e
UNION ALL SELECT c_custkey, text, 'US_BANK_NUMBER', lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') FROM e)
SELECT c_custkey, CAST(strpos(text, value) - 1 AS INTEGER) AS start, CAST(strpos(text, value) - 1 + length(value) AS INTEGER) AS "end",
  pii_type, value FROM v""")
def q_pii_value_edges(spark, sf_dir):
    k = F.col("c_custkey")

    def pad(x, w):
        return F.lpad(x.cast("string"), w, "0")

    text = F.concat(
        F.lit("Ref "), pad(k, 9), F.lit(" is open; mail jo.x+1@m-1.example.org, not a@b; host 10.0."), (k % 300).cast("string"),
        F.lit(".7, not 1.2.3.4.5 or 1.2.3; SSN "), pad(k * 7 % 1000, 3), F.lit("-"), pad(k % 100, 2), F.lit("-"), pad(k % 50, 4),
        F.lit(", not 1-123-45-6789; passport K"), pad(k, 8), F.lit(" and no more to say about that number here; account "),
        pad(k * 7919, 12), F.lit("."))
    d = detect_pii(customer_rows(spark, sf_dir, "c_custkey").select("c_custkey", text.alias("text")), "text", threshold=0.5,
                   types=["EMAIL_ADDRESS", "IP_ADDRESS", "US_SSN", "US_PASSPORT", "US_BANK_NUMBER"])
    return explode_spans(d, "c_custkey").select("c_custkey", "start", "end", "pii_type", "value")


@register("pii_gazetteer", lambda: f"""WITH cust_text AS ({CUSTOMER_TEXT_SQL})
SELECT c_custkey, start, "end", pii_type, score FROM ({dictionary_span_rows_sql('cust_text', 'c_custkey')})""")
def q_pii_gazetteer(spark, sf_dir):
    d = _cust_spans(spark, sf_dir, ["PERSON", "LOCATION"], 0.0)
    return explode_spans(d, "c_custkey").select("c_custkey", "start", "end", "pii_type", "score")


@register("pii_threshold", lambda: f"""WITH cust_text AS ({CUSTOMER_TEXT_SQL})
SELECT c_custkey, start, "end", pii_type, score FROM (
  {' UNION ALL '.join(S.type_spans_sql('cust_text', 'c_custkey', 'text', t, 0.5) for t in P.PATTERN_TYPES)})""")
def q_pii_threshold(spark, sf_dir):
    d = detect_pii(customer_text(spark, sf_dir), "text", types=list(P.PATTERN_TYPES), threshold=0.5)
    return explode_spans(d, "c_custkey").select("c_custkey", "start", "end", "pii_type", "score")


@register("pii_types", lambda: f"""SELECT doc_id, start, "end", pii_type, score FROM (
  {S.type_spans_sql('documents', 'doc_id', 'text', 'EMAIL_ADDRESS')}
  UNION ALL {S.type_spans_sql('documents', 'doc_id', 'text', 'IP_ADDRESS')})""")
def q_pii_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = detect_pii(docs, "text", types=["email_address", "ip_address"])
    return explode_spans(d, "doc_id").select("doc_id", "start", "end", "pii_type", "score")


def _merged_sql() -> str:
    rows = " UNION ALL ".join(
        f'SELECT c_custkey, start, "end", pii_type, score FROM ({S.type_spans_sql("cust_text", "c_custkey", "text", t, 0.5)})'
        for t in P.PATTERN_TYPES)
    rows += f" UNION ALL SELECT * FROM ({dictionary_span_rows_sql('cust_text', 'c_custkey')})"
    return f"""WITH cust_text AS ({CUSTOMER_TEXT_SQL}),
spl AS ({S.spans_list_sql(rows, 'c_custkey')})
SELECT c_custkey, s.start, s."end", s.pii_type, s.score
FROM (SELECT c_custkey, unnest({S.merge_sql(S.resolve_overlaps_sql('sp'))}) AS s FROM spl)"""


@register("pii_merge", lambda: _merged_sql())
def q_pii_merge(spark, sf_dir):
    from veilspark.functions.spans import drop_cross_type_overlaps, merge_spans
    d = _cust_spans(spark, sf_dir, [], 0.5)
    m = d.select("c_custkey", F.explode(merge_spans(drop_cross_type_overlaps(F.col("pii")))).alias("s"))
    return m.select("c_custkey", "s.start", "s.end", "s.pii_type", "s.score")


def _resolve_query(mode):
    def run(spark, sf_dir):
        d = _cust_spans(spark, sf_dir, [], 0.5)
        return anonymize(d, "text", DEMO_SECRET, mode="sha", resolution=mode,
                         spans_col="pii").select("c_custkey", "text")
    return run


def _resolve_oracle(mode):
    inner = S.anonymize_sql("cust_text", "c_custkey", "text", list(P.PATTERN_TYPES), DEMO_SECRET,
                            mode, threshold=0.5,
                            extra_span_rows=dictionary_span_rows_sql("cust_text", "c_custkey"))
    return f"WITH cust_text AS ({CUSTOMER_TEXT_SQL}) SELECT * FROM ({inner})"


register("resolve_equality", lambda: _resolve_oracle("EQUALITY"))(_resolve_query("EQUALITY"))
register("resolve_containment", lambda: _resolve_oracle("CONTAINMENT"))(_resolve_query("CONTAINMENT"))


# ---------------------------------------------------------------- S1, S2, S4 sources
@register("load_bulk", lambda: """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS resource, text,
  source AS doc, lang FROM documents""")
def q_load_bulk(spark, sf_dir):
    from veilspark.sources.documents import to_documents
    raw = table(spark, sf_dir, "documents", balanced=False)
    d = to_documents(raw, resource=F.concat(F.lit("doc-"), F.col("doc_id").cast("string")),
                     name=F.col("source"), extra_meta={"lang": "lang"})
    return d.select("resource", "text", F.col("metadata")["doc"].alias("doc"),
                    F.col("metadata")["lang"].alias("lang"))


@register("load_resource", lambda: """SELECT CAST(d.doc_id AS VARCHAR) AS resource, d.text,
  CASE WHEN l.quality = 1 THEN 'good-' || CAST(d.doc_id AS VARCHAR) ELSE CAST(d.doc_id AS VARCHAR) END AS doc
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_load_resource(spark, sf_dir):
    from veilspark.sources.documents import load_resources, to_documents
    docs = to_documents(table(spark, sf_dir, "documents", balanced=False), resource=F.col("doc_id"))
    lab = table(spark, sf_dir, "labels")
    req = lab.select(F.col("doc_id").cast("string").alias("resource"),
                     F.when(F.col("quality") == 1, F.concat(F.lit("good-"), F.col("doc_id").cast("string")))
                     .alias("name"))
    out = load_resources(docs, req, "resource", "name")
    return out.select("resource", "text", F.col("metadata")["doc"].alias("doc"))


def _page_text_sql(src: str = "pages") -> str:
    from veilspark.sources import documents as D
    t = f"regexp_replace(html, {S.q(D.HTML_DROP_BLOCKS)}, ' ', 'g')"
    t = f"regexp_replace({t}, {S.q(D.HTML_COMMENT)}, ' ', 'g')"
    t = f"regexp_replace({t}, {S.q(D.HTML_TAG)}, ' ', 'g')"
    names = " ".join(f"WHEN {S.q(ent)} THEN {S.q(ch)}" for ent, ch in D.HTML_ENTITIES)
    code = ("CASE WHEN lower(r[3:3]) = 'x' THEN TRY_CAST('0x' || r[4:len(r) - 1] AS BIGINT) "
            "ELSE TRY_CAST(r[3:len(r) - 1] AS BIGINT) END")
    char = (f"CASE r {names} ELSE chr(CAST(CASE WHEN {code} <= 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 "
            f"THEN 65533 ELSE {code} END AS INTEGER)) END")
    return f"""SELECT url AS resource, trim(regexp_replace(array_to_string(list_transform(range(1, len(segs) + 1),
    lambda i: segs[i] || coalesce(chars[i], '')), ''), {S.q(D.HTML_BLANKS)}, ' ', 'g')) AS text
FROM (SELECT url, string_split_regex(t, {S.q(D.HTML_REFERENCE)}) AS segs,
    list_transform(regexp_extract_all(t, {S.q(D.HTML_REFERENCE)}), lambda r: {char}) AS chars
  FROM (SELECT url, {t} AS t FROM {src}))"""


@register("page_text", lambda: _page_text_sql())
def q_page_text(spark, sf_dir):
    from veilspark.sources.documents import pages_to_documents
    return pages_to_documents(table(spark, sf_dir, "pages")).select("resource", "text")


# Pages with references of every kind, one of them by the page's number.
REFERENCE_TAIL = "<p>It&#8217;s &#x2019; &#128512;&#x1F600; &#xd83d;&#0;&#1114112; &#38;lt;&#38;#65;&amp;#66; &#39;"


@register("page_text_entities", lambda: _page_text_sql(
    f"(SELECT url, html || {S.q(REFERENCE_TAIL)} || '&#' || CAST(page_id % 60000 + 161 AS VARCHAR) || ';</p>' AS html FROM pages)"))
def q_page_text_entities(spark, sf_dir):
    from veilspark.sources.documents import pages_to_documents
    p = table(spark, sf_dir, "pages")
    tail = F.concat(F.lit(REFERENCE_TAIL + "&#"), (F.col("page_id") % 60000 + 161).cast("string"), F.lit(";</p>"))
    return pages_to_documents(p.withColumn("html", F.concat("html", tail))).select("resource", "text")


# JSON lines written from documents; every seventh line is cut before its end.
@register("load_json", lambda: """SELECT CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) END AS resource,
  CASE WHEN doc_id % 7 <> 0 THEN text END AS text, CASE WHEN doc_id % 7 <> 0 THEN source END AS doc,
  CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, doc_id % 7 = 0 AS corrupt FROM documents""")
def q_load_json(spark, sf_dir):
    import uuid

    from veilspark.session import shared_path
    from veilspark.sources.documents import load_json
    d = table(spark, sf_dir, "documents", balanced=False)
    line = F.to_json(F.struct("doc_id", "text", "source", "lang"))
    path = shared_path(spark, f"json/{uuid.uuid4().hex}")
    d.select(F.when(F.col("doc_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")) \
        .write.text(path)
    got = load_json(spark, path, "doc_id long, text string, source string, lang string", resource_col="doc_id",
                    name_col="source", extra_meta={"lang": "lang"})
    return got.select("resource", "text", F.col("metadata")["doc"].alias("doc"), F.col("metadata")["lang"].alias("lang"),
                      F.col("corrupt").isNotNull().alias("corrupt"))


@register("load_resource_single", lambda: """SELECT CAST(doc_id AS VARCHAR) AS resource, text, 'the twelfth' AS doc
FROM documents WHERE doc_id = 12""")
def q_load_resource_single(spark, sf_dir):
    from veilspark.sources.documents import load_resource
    got = load_resource(table(spark, sf_dir, "documents", balanced=False), 12, "the twelfth", key_col="doc_id")
    return got.select("resource", "text", F.col("metadata")["doc"].alias("doc"))


# ---------------------------------------------------------------- K1-K5 chunking
def _pieces_sql(splitter: str, src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    if splitter == "simple":
        return f"SELECT {key}, string_split_regex({text}, '\\.') AS pieces FROM {src}"
    from veilspark.operators import chunk as K
    abbr = r"(^|[^\p{L}])(" + "|".join(K.ABBREVIATIONS) + r")\."
    t = f"regexp_replace({text}, {S.q(abbr)}, '\\1\\2' || chr(2), 'g')"
    t = f"regexp_replace({t}, {S.q(K.SENTENCE_END)}, '\\1' || chr(1), 'g')"
    return (f"SELECT {key}, list_transform(string_split({t}, chr(1)), lambda s: replace(s, chr(2), '.')) "
            f"AS pieces FROM {src}")


def chunk_sql(max_words: int, overlap: int, min_words: int = 3, splitter: str = "simple",
              src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    from veilspark.fixed import WORD_RX
    big = 10_000_000
    return f"""WITH p AS (
  SELECT {key}, pieces, unnest(generate_series(1, len(pieces))) AS j FROM ({_pieces_sql(splitter, src, key, text)})
), c AS (
  SELECT {key}, pieces, j, n, sum(n) OVER (PARTITION BY {key} ORDER BY j ROWS UNBOUNDED PRECEDING) AS P
  FROM (SELECT {key}, pieces, j, len(regexp_extract_all(pieces[j], {S.q(WORD_RX)})) AS n FROM p)
), pk AS (
  SELECT {key}, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS P FROM {src}
  UNION ALL SELECT {key}, CAST(j AS BIGINT), CAST(P AS BIGINT) FROM c
), e AS (
  SELECT {key}, pieces, j, CAST(P - least({int(max_words)}, {int(overlap)} + n) AS BIGINT) * {big} AS thr
  FROM c WHERE n >= {int(min_words)}
), a AS (
  SELECT e.{key}, e.pieces, e.j, least(pk.k + 1, e.j) AS t
  FROM e ASOF JOIN pk ON e.{key} = pk.{key} AND e.thr <= pk.P * {big} + pk.k
), s AS (
  SELECT {key}, pieces, j, max(t) OVER (PARTITION BY {key} ORDER BY j ROWS UNBOUNDED PRECEDING) AS st,
         row_number() OVER (PARTITION BY {key} ORDER BY j) AS chunk_no
  FROM a
)
SELECT {key}, CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string(pieces[st:j], '. ') AS content FROM s"""


def _chunk_query(max_words, overlap, splitter="simple"):
    def run(spark, sf_dir):
        from veilspark.operators.chunk import chunk_documents
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return chunk_documents(docs, "text", splitter=splitter, max_words=max_words,
                               overlap=overlap, min_words=3, keep_cols=["doc_id"])
    return run


register("chunk_window", lambda: chunk_sql(256, 10))(_chunk_query(256, 10))
register("chunk_window_small", lambda: chunk_sql(40, 10))(_chunk_query(40, 10))
register("chunk_sentence", lambda: chunk_sql(40, 10, splitter="sentence"))(_chunk_query(40, 10, "sentence"))


@register("split_simple", lambda: f"""SELECT doc_id, CAST(i AS INTEGER) AS piece_no, pieces[i] AS piece
FROM (SELECT doc_id, pieces, unnest(generate_series(1, len(pieces))) AS i FROM ({_pieces_sql('simple')}))""")
def q_split_simple(spark, sf_dir):
    from veilspark.operators.chunk import split_simple
    d = table(spark, sf_dir, "documents", balanced=False).select(
        "doc_id", F.posexplode(split_simple(F.col("text"))))
    return d.select("doc_id", (F.col("pos") + 1).cast("int").alias("piece_no"), F.col("col").alias("piece"))


@register("split_sentence", lambda: f"""SELECT doc_id, CAST(i AS INTEGER) AS piece_no, pieces[i] AS piece
FROM (SELECT doc_id, pieces, unnest(generate_series(1, len(pieces))) AS i FROM ({_pieces_sql('sentence')}))""")
def q_split_sentence(spark, sf_dir):
    from veilspark.operators.chunk import split_sentences
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_sentences(F.col("text"))))
    return d.select("doc_id", (F.col("pos") + 1).cast("int").alias("piece_no"), F.col("col").alias("piece"))


@register("chunk_metadata", lambda: f"""SELECT k.doc_id, k.chunk_no, d.source AS doc, d.lang AS lang,
  CAST(k.chunk_no AS VARCHAR) AS chunk FROM ({chunk_sql(256, 10)}) k JOIN documents d ON k.doc_id = d.doc_id""")
def q_chunk_metadata(spark, sf_dir):
    from veilspark.operators.chunk import chunk_documents
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.create_map(F.lit("doc"), F.col("source"), F.lit("lang"), F.col("lang")).alias("metadata"))
    c = chunk_documents(docs, "text", max_words=256, overlap=10, keep_cols=["doc_id"], meta_col="metadata")
    m = F.col("metadata")
    return c.select("doc_id", "chunk_no", m["doc"].alias("doc"), m["lang"].alias("lang"), m["chunk"].alias("chunk"))


# ---------------------------------------------------------------- E1-E2 embedding
EMBED_DIM = 64
EMBED_MAX = 256


def hash_embed_sql(src: str, key: str, text: str, dim: int = EMBED_DIM, max_len: int = EMBED_MAX) -> str:
    from veilspark.operators.embed import EMBED_WORD_RX
    return f"""SELECT {key}, list_transform(c, lambda x: CAST(CASE WHEN ss = 0 THEN 0 ELSE x / sqrt(ss) END AS FLOAT)) AS embedding
FROM (SELECT {key}, c, list_sum(list_transform(c, lambda x: x * x)) AS ss FROM (
  SELECT t.{key}, list_transform(range(0, {dim}), lambda d: coalesce(h.h[d], 0)) AS c
  FROM (SELECT {key}, regexp_extract_all(array_to_string(string_split({text}, ' ')[1:{max_len}], ' '), {S.q(EMBED_WORD_RX)}) AS w FROM {src}) t
  LEFT JOIN (SELECT {key}, histogram(CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % {dim}) AS h
             FROM (SELECT {key}, unnest(regexp_extract_all(array_to_string(string_split({text}, ' ')[1:{max_len}], ' '), {S.q(EMBED_WORD_RX)})) AS x FROM {src})
             GROUP BY {key}) h ON t.{key} = h.{key}))"""


def chunks_df(spark, sf_dir, max_words=256, overlap=10):
    """Document chunks with node id ``doc_id * 1e6 + chunk_no`` and ``doc = source``."""
    from veilspark.operators.chunk import chunk_documents
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    from veilspark.plans.pipelines import compose_id
    c = chunk_documents(docs, "text", max_words=max_words, overlap=overlap, keep_cols=["doc_id", "source"])
    return c.select(compose_id(F.col("doc_id"), F.col("chunk_no")).alias("id"), "doc_id", "chunk_no",
                    F.col("source").alias("doc"), "content")


CHUNKS_SQL = f"""SELECT k.doc_id * 1000000 + k.chunk_no AS id, k.doc_id, k.chunk_no, d.source AS doc, k.content
FROM ({chunk_sql(256, 10)}) k JOIN documents d ON k.doc_id = d.doc_id"""


@register("embed_truncate", lambda: f"SELECT doc_id, array_to_string(string_split(text, ' ')[1:{EMBED_MAX}], ' ') AS text FROM documents")
def q_embed_truncate(spark, sf_dir):
    """E1 with the embedder's own limit (the text the model actually sees)."""
    from veilspark.operators.embed import truncate_words
    return table(spark, sf_dir, "documents", balanced=False).select(
        "doc_id", truncate_words(F.col("text"), EMBED_MAX).alias("text"))


@register("embed_hash", lambda: f"""WITH ch AS ({CHUNKS_SQL})
SELECT id, embedding FROM ({hash_embed_sql('ch', 'id', 'content')})""")
def q_embed_hash(spark, sf_dir):
    from veilspark.operators.embed import HashEmbedder, embed
    return embed(chunks_df(spark, sf_dir), "content", HashEmbedder(EMBED_DIM, EMBED_MAX)).select("id", "embedding")


# ---------------------------------------------------------------- J1, J2, F1, F8 search
VECTOR_DIM = 64          # of the embeddings table


def _e6(c):
    return F.round(c * F.lit(1e6)).cast("long")


def knn_sql(metric: str, k: int, match_label: bool) -> str:
    fn = "list_distance" if metric == "l2" else "list_negative_inner_product"
    on = "q.label = c.label" if match_label else "TRUE"
    return f"""SELECT qid, CAST(rank AS INTEGER) AS rank, id, CAST(round(d * 1e6) AS BIGINT) AS dist_e6,
  CAST(round((1 - exp(-abs(d))) * 1e6) AS BIGINT) AS score_e6 FROM (
  SELECT q.vec_id AS qid, c.vec_id AS id, {fn}(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({fn}(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9), c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON {on}) WHERE rank <= {k}"""


def _knn_query(metric, k, match_label):
    def run(spark, sf_dir):
        from veilspark.operators.search import knn
        e = table(spark, sf_dir, "embeddings")
        q = e.select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("q_label"))
        c = e.select(F.col("vec_id").alias("id"), "embedding", "label")
        r = knn(q, c, dim=VECTOR_DIM, k=k, metric=metric, match=[("q_label", "label")] if match_label else None)
        return r.select("qid", "rank", "id", _e6(F.col("distance")).alias("dist_e6"),
                        _e6(F.col("score")).alias("score_e6"))
    return run


register("knn_l2", lambda: knn_sql("l2", 5, True))(_knn_query("l2", 5, True))
register("knn_inner", lambda: knn_sql("inner", 5, True))(_knn_query("inner", 5, True))
register("vector_score", lambda: knn_sql("l2", 1, False))(_knn_query("l2", 1, False))
register("knn_l2_unfiltered", lambda: knn_sql("l2", 5, False))(_knn_query("l2", 5, False))


@register("knn_ties", lambda: f"""WITH ch AS (SELECT * FROM ({CHUNKS_SQL}) c),
ce AS ({hash_embed_sql('ch', 'id', 'content')}),
p AS (SELECT item_id AS qid, text AS prompt FROM benchmark),
pe AS ({hash_embed_sql('p', 'qid', 'prompt')})
SELECT qid, CAST(rank AS INTEGER) AS rank, id FROM (
  SELECT pe.qid, ce.id, row_number() OVER (PARTITION BY pe.qid ORDER BY round(list_distance(CAST(pe.embedding AS DOUBLE[]),
    CAST(ce.embedding AS DOUBLE[])), 9), ce.id) AS rank FROM pe, ce) WHERE rank <= 5""")
def q_knn_ties(spark, sf_dir):
    """Chunks hold exact copies, so equal distances are common: ids decide."""
    from veilspark.operators.embed import HashEmbedder, embed
    from veilspark.operators.search import knn
    emb = HashEmbedder(EMBED_DIM, EMBED_MAX)
    c = embed(chunks_df(spark, sf_dir), "content", emb)
    q = embed(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), "text", emb)
    return knn(q, c, dim=EMBED_DIM, k=5).select("qid", "rank", "id")


@register("metadata_filter", lambda: """SELECT doc_id FROM documents WHERE lang = 'en' AND source IS NOT NULL""")
def q_metadata_filter(spark, sf_dir):
    from veilspark.operators.search import metadata_contains
    d = table(spark, sf_dir, "documents", balanced=False)
    meta = F.create_map(F.lit("doc"), F.col("source"), F.lit("lang"), F.col("lang"))
    return d.where(metadata_contains(meta, {"lang": "en"}) & metadata_contains(meta, {})).select("doc_id")


# ---------------------------------------------------------------- S5-S9 collection
def _new_collection(spark, name, dim=EMBED_DIM, include_metadata=True):
    import uuid
    from veilspark.session import shared_path
    from veilspark.sources.collection import Collection
    root = shared_path(spark, f"collections/{uuid.uuid4().hex}")
    return Collection(spark, root, name, dim, include_metadata).create()


def _saved_chunks(spark, sf_dir):
    from veilspark.operators.embed import HashEmbedder, embed
    ch = embed(chunks_df(spark, sf_dir), "content", HashEmbedder(EMBED_DIM, EMBED_MAX))
    coll = _new_collection(spark, "doc_nodes")
    coll.save_nodes(ch.select("id", "content", F.create_map(F.lit("doc"), F.col("doc")).alias("metadata"),
                              "embedding"))
    return coll


@register("save_nodes", lambda: f"""SELECT id, doc, content, 64 AS dim FROM ({CHUNKS_SQL})""")
def q_save_nodes(spark, sf_dir):
    s = _saved_chunks(spark, sf_dir).scan()
    return s.select("id", F.col("metadata")["doc"].alias("doc"), "content",
                    F.size("embedding").alias("dim"))


@register("save_nodes_twice", lambda: f"""WITH ch AS ({CHUNKS_SQL})
SELECT id, min(content) AS content FROM (SELECT id, content FROM ch UNION ALL SELECT id, 'again ' || content FROM ch) GROUP BY id""")
def q_save_nodes_twice(spark, sf_dir):
    """Every id twice in one call, with other contents: one row of each is stored; a second call adds none."""
    from veilspark.operators.embed import HashEmbedder, embed
    ch = embed(chunks_df(spark, sf_dir), "content", HashEmbedder(EMBED_DIM, EMBED_MAX)).select("id", "content", "embedding")
    both = ch.select("id", F.explode(F.array("content", F.concat(F.lit("again "), "content"))).alias("content"), "embedding")
    coll = _new_collection(spark, "doc_nodes")
    coll.save_nodes(both)
    coll.save_nodes(ch)
    return coll.scan().select("id", "content")


@register("delete_by_content", lambda: f"""WITH ch AS ({CHUNKS_SQL})
SELECT id FROM ch WHERE content NOT IN (
  SELECT ch.content FROM ch JOIN labels l ON ch.doc_id = l.doc_id WHERE l.toxic = 1)""")
def q_delete_by_content(spark, sf_dir):
    coll = _saved_chunks(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    keys = chunks_df(spark, sf_dir).join(toxic, "doc_id", "left_semi").select("content")
    coll.delete_by_content(keys)
    return coll.scan().select("id")


# ---------------------------------------------------------------- C1-C3, F4-F6 cache
CACHE_AS_OF = "2024-06-01 00:00:00"
CACHE_AGE_STEP = 36000          # seconds between consecutive items' creation


def _cache_records(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    rec = F.to_json(F.struct(F.col("item_id"), F.concat(F.lit("answer "), F.col("item_id").cast("string"))
                             .alias("answer")))
    created = F.to_timestamp_ntz(F.lit(CACHE_AS_OF)) - F.make_dt_interval(
        secs=(F.col("item_id") * CACHE_AGE_STEP).cast("decimal(18,6)"))
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("prompt"), rec.alias("record_json"),
                    created.alias("created_at"))


CACHE_RECORDS_SQL = f"""SELECT item_id AS id, text AS prompt,
  '{{"item_id":' || CAST(item_id AS VARCHAR) || ',"answer":"answer ' || CAST(item_id AS VARCHAR) || '"}}' AS record_json,
  TIMESTAMP '{CACHE_AS_OF}' - to_seconds(item_id * {CACHE_AGE_STEP}) AS created_at
FROM benchmark"""


def _stored_cache(spark, sf_dir):
    from veilspark.operators.cache import cache_store
    coll = _new_collection(spark, "prompt_cache")
    cache_store(_cache_records(spark, sf_dir), coll, secret=DEMO_SECRET, created_col="created_at",
                salt=DEMO_SALT)
    return coll


@register("cache_admit", lambda: f"SELECT id FROM ({CACHE_RECORDS_SQL}) WHERE length(prompt) <= {EMBED_MAX}")
def q_cache_admit(spark, sf_dir):
    from veilspark.operators.cache import admit
    return _cache_records(spark, sf_dir).where(admit(F.col("prompt"), EMBED_MAX)).select("id")


@register("cache_store", lambda: f"""SELECT id, prompt AS content, record_json, created_at, 64 AS dim
FROM ({CACHE_RECORDS_SQL}) WHERE length(prompt) <= {EMBED_MAX}""")
def q_cache_store(spark, sf_dir):
    from veilspark.operators.anonymize import deanonymize_text
    s = _stored_cache(spark, sf_dir).scan()
    return s.select("id", deanonymize_text(F.col("content"), DEMO_SECRET).alias("content"),
                    deanonymize_text(F.col("metadata")["cache"], DEMO_SECRET).alias("record_json"),
                    "created_at", F.size("embedding").alias("dim"))


@register("cache_expired", lambda: f"""SELECT id FROM ({CACHE_RECORDS_SQL})
WHERE created_at + to_seconds(604800) < TIMESTAMP '{CACHE_AS_OF}'""")
def q_cache_expired(spark, sf_dir):
    from veilspark.operators.cache import expired
    r = _cache_records(spark, sf_dir)
    return r.where(expired(F.col("created_at"), 604800, F.to_timestamp_ntz(F.lit(CACHE_AS_OF)))).select("id")


@register("cache_evict", lambda: f"""WITH r AS (SELECT * FROM ({CACHE_RECORDS_SQL}) WHERE length(prompt) <= {EMBED_MAX})
SELECT id FROM r WHERE prompt NOT IN (
  SELECT prompt FROM r WHERE created_at + to_seconds(604800) < TIMESTAMP '{CACHE_AS_OF}')""")
def q_cache_evict(spark, sf_dir):
    from veilspark.operators.cache import cache_evict
    coll = _stored_cache(spark, sf_dir)
    cache_evict(coll, as_of=F.to_timestamp_ntz(F.lit(CACHE_AS_OF)), ttl_seconds=604800)
    return coll.scan().select("id")


def _cache_probes(spark, sf_dir):
    """Benchmark items (negative or zero ids) and user turns (positive ids): the two cannot meet."""
    from veilspark.plans.pipelines import compose_id
    b = table(spark, sf_dir, "benchmark").select((-F.col("item_id")).alias("pid"), F.col("text").alias("prompt"))
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        (compose_id(F.col("conv_id"), F.col("turn")) + 1).alias("pid"), F.col("text").alias("prompt"))
    return b.unionByName(c)


CACHE_PROBES_SQL = """SELECT -item_id AS pid, text AS prompt FROM benchmark
UNION ALL SELECT conv_id * 1000000 + turn + 1, text FROM conversations WHERE role = 'user'"""


def _lookup_sql(threshold: float, probes: str) -> str:
    """All pairs, the nearest by (distance, id), then cutoff and expiry."""
    return f"""WITH r AS (SELECT * FROM ({CACHE_RECORDS_SQL}) WHERE length(prompt) <= {EMBED_MAX}),
p AS ({probes}),
pe AS ({hash_embed_sql('p', 'pid', 'prompt')}),
re AS ({hash_embed_sql('r', 'id', 'prompt')}),
top AS (
  SELECT pid, id, d FROM (
    SELECT pe.pid, re.id, list_distance(CAST(pe.embedding AS DOUBLE[]), CAST(re.embedding AS DOUBLE[])) AS d,
           row_number() OVER (PARTITION BY pe.pid ORDER BY round(list_distance(CAST(pe.embedding AS DOUBLE[]),
               CAST(re.embedding AS DOUBLE[])), 9), re.id) AS rk
    FROM pe, re) WHERE rk = 1),
st AS (
  SELECT p.pid, top.id, CASE WHEN top.id IS NULL OR 1 - exp(-abs(top.d)) >= {threshold} THEN 'miss'
    WHEN r.created_at + to_seconds(604800) < TIMESTAMP '{CACHE_AS_OF}' THEN 'expired' ELSE 'hit' END AS status,
    r.record_json
  FROM p LEFT JOIN top ON p.pid = top.pid LEFT JOIN r ON top.id = r.id)
SELECT pid, status, CASE WHEN status = 'hit' THEN id END AS cache_id,
  CASE WHEN status = 'hit' THEN record_json END AS record_json FROM st"""


def _lookup_query(threshold: float):
    def run(spark, sf_dir):
        from veilspark.operators.cache import cache_lookup
        coll = _stored_cache(spark, sf_dir)
        return cache_lookup(_cache_probes(spark, sf_dir), coll.scan(), secret=DEMO_SECRET, threshold=threshold,
                            as_of=F.to_timestamp_ntz(F.lit(CACHE_AS_OF)), ttl_seconds=604800)
    return run


register("cache_lookup", lambda: _lookup_sql(0.1, CACHE_PROBES_SQL))(_lookup_query(0.1))
# A wide cutoff (distance 0.87): near prompts hit too, and ties and expiry matter.
register("cache_lookup_threshold", lambda: _lookup_sql(0.58, CACHE_PROBES_SQL))(_lookup_query(0.58))


@register("cache_threshold_share", lambda: f"""WITH r AS (SELECT * FROM ({CACHE_RECORDS_SQL}) WHERE length(prompt) <= {EMBED_MAX}),
p AS ({CACHE_PROBES_SQL})
SELECT (SELECT count(*) FROM p) AS n_probes, (SELECT count(*) FROM r) AS n_stored, TRUE AS below_a_tenth""")
def q_cache_threshold_share(spark, sf_dir):
    """How many pairs the threshold join measures, against all pairs."""
    from veilspark.operators.embed import HashEmbedder
    from veilspark.operators.threshold import nearest_within, radius_of
    e = HashEmbedder(EMBED_DIM, EMBED_MAX)
    stored = _stored_cache(spark, sf_dir).scan()
    q = _cache_probes(spark, sf_dir).select(F.col("pid").alias("qid"), e.column(F.col("prompt")).alias("embedding"))
    found = nearest_within(q, stored, radius=radius_of(0.1), dim=EMBED_DIM)
    zero = F.lit(0).cast("long")
    both = found.select(F.lit(1).cast("long").alias("q"), zero.alias("c"), "compared").unionByName(
        stored.select(zero.alias("q"), F.lit(1).cast("long").alias("c"), zero.alias("compared")))
    return both.agg(F.sum("q").alias("n_probes"), F.sum("c").alias("n_stored"), F.sum("compared").alias("m")).select(
        "n_probes", "n_stored", (F.col("m") * 10 < F.col("n_probes") * F.col("n_stored")).alias("below_a_tenth"))


# ---------------------------------------------------------------- J3, A1-A6
def request_titles(spark, sf_dir):
    """Two document titles per request: a function of the request id over the table's own titles.

    Titles are numbered by (first two digits of their MD5, title) in two steps:
    the 256 bucket sizes give every bucket its first number, and each bucket is
    numbered on its own, so no task sees all titles.
    """
    from pyspark.sql import Window
    titles = table(spark, sf_dir, "documents", balanced=False).select("source").where("source is not null").distinct() \
        .withColumn("b", F.substring(F.md5("source"), 1, 2))
    sizes = sorted((r["b"], r["n"]) for r in titles.groupBy("b").agg(F.count("*").alias("n")).collect())   # 256 rows at most
    total, first = 0, {}
    for b, n in sizes:
        first[b], total = total, total + n
    firsts = F.create_map(*[F.lit(x) for kv in first.items() for x in kv]) if first else F.create_map().cast("map<string,int>")
    ranked = titles.select("source", (F.try_element_at(firsts, F.col("b")) + F.row_number().over(
        Window.partitionBy("b").orderBy("source")) - 1).alias("n"))

    def of(req):
        m = max(total, 1)
        asked = req.select("request_id", "prompt", F.posexplode(F.array(
            F.col("request_id") % m, (F.col("request_id") * 7 + 3) % m)).alias("p", "n"))
        return asked.join(ranked, "n").select("request_id", "prompt", (F.col("p") + 1).cast("int").alias("title_pos"),
                                              F.col("source").alias("title"))
    return of


def _node_collection(spark, sf_dir, metadata=None):
    """The corpus ingested once into a new collection."""
    from veilspark.plans.pipelines import ingest_into
    coll = _new_collection(spark, "node")
    ingest_into(coll, table(spark, sf_dir, "documents"), secret=DEMO_SECRET, max_words=256, overlap=10, salt=DEMO_SALT,
                metadata=metadata)
    return coll


def _saved_nodes(spark, sf_dir, kind: str | None = None):
    """The collection's scan: searches and payloads read stored nodes."""
    coll = _node_collection(spark, sf_dir, None if kind is None else {"kind": kind})
    return coll.scan().withColumn("doc", F.col("metadata")["doc"])


REQ_SQL = """SELECT conv_id AS request_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS prompt,
  max(turn) AS last_turn FROM conversations GROUP BY conv_id"""


def _hits_sql(k: int = 3) -> str:
    return f"""ch AS ({CHUNKS_SQL}),
ce AS (SELECT ch.id, ch.doc, ch.content, e.embedding FROM ch JOIN ({hash_embed_sql('ch', 'id', 'content')}) e ON ch.id = e.id),
req AS ({REQ_SQL}),
tt AS (SELECT source, row_number() OVER (ORDER BY substr(md5(source), 1, 2), source) - 1 AS n, count(*) OVER () AS total
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
pq AS (SELECT request_id * 1000 + title_pos AS qid, * FROM (
  SELECT request_id, prompt, 1 AS title_pos, source AS title FROM req JOIN tt ON n = request_id % total
  UNION ALL SELECT request_id, prompt, 2, source FROM req JOIN tt ON n = (request_id * 7 + 3) % total)),
pe AS (SELECT pq.*, e.embedding FROM pq JOIN ({hash_embed_sql('pq', 'qid', 'prompt')}) e ON pq.qid = e.qid),
hits AS (SELECT * FROM (
  SELECT p.request_id, p.title_pos, c.id, c.doc, c.content,
    row_number() OVER (PARTITION BY p.qid ORDER BY round(list_distance(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9), c.id) AS rank
  FROM pe p JOIN ce c ON c.doc = p.title) WHERE rank <= {k})"""


@register("knn_by_title", lambda: f"""WITH {_hits_sql()}
SELECT request_id, CAST(title_pos AS INTEGER) AS title_pos, CAST(rank AS INTEGER) AS rank, id FROM hits""")
def q_knn_by_title(spark, sf_dir):
    from veilspark.operators.context import retrieve_by_title
    from veilspark.operators.embed import HashEmbedder
    from veilspark.plans.pipelines import conversation_requests
    req = conversation_requests(table(spark, sf_dir, "conversations"))
    probes = request_titles(spark, sf_dir)(req)
    hits = retrieve_by_title(probes, _saved_nodes(spark, sf_dir), embedder=HashEmbedder(EMBED_DIM, EMBED_MAX), k=3)
    return hits.select("request_id", "title_pos", "rank", "id")


def _ctx_sql() -> str:
    from veilspark.fixed import CONTEXT_HEAD, CONTEXT_TAIL
    return f"""WITH {_hits_sql()},
ctx AS (SELECT request_id, {S.q(CONTEXT_HEAD)} || string_agg('From the document with the title ' || doc || ', ' || content,
  chr(10) ORDER BY title_pos, rank) || {S.q(CONTEXT_TAIL)} AS context FROM hits GROUP BY request_id),
full_ctx AS (SELECT r.request_id, r.last_turn, coalesce(c.context, {S.q(CONTEXT_HEAD + CONTEXT_TAIL)}) AS context
  FROM req r LEFT JOIN ctx c ON r.request_id = c.request_id)"""


@register("context_prompt", lambda: f"{_ctx_sql()} SELECT request_id, context FROM full_ctx")
def q_context_prompt(spark, sf_dir):
    from veilspark.operators.context import empty_context, format_context, retrieve_by_title
    from veilspark.operators.embed import HashEmbedder
    from veilspark.plans.pipelines import conversation_requests
    req = conversation_requests(table(spark, sf_dir, "conversations"))
    probes = request_titles(spark, sf_dir)(req)
    hits = retrieve_by_title(probes, _saved_nodes(spark, sf_dir), embedder=HashEmbedder(EMBED_DIM, EMBED_MAX), k=3)
    ctx = format_context(hits, secret=DEMO_SECRET)
    return req.select("request_id").join(ctx, "request_id", "left").select(
        "request_id", F.coalesce("context", empty_context()).alias("context"))


def _rag_sql() -> str:
    from veilspark.fixed import RAG_SYSTEM_PROMPT
    msgs = f"""(SELECT conv_id * 1000 + turn + 1 AS mk, conv_id AS request_id, CAST(turn + 1 AS INTEGER) AS msg_no,
  role, coalesce(text, '') AS content FROM conversations
  UNION ALL SELECT request_id * 1000 + last_turn + 2, request_id, CAST(last_turn + 2 AS INTEGER), 'system', context FROM full_ctx)"""
    anon = S.anonymize_sql("msgs", "mk", "content", PATTERN_ALL, DEMO_SECRET, "EQUALITY", threshold=0.5)
    return f"""{_ctx_sql()}, msgs AS {msgs}, an AS ({anon})
SELECT m.request_id, m.msg_no, m.role, an.content FROM msgs m JOIN an ON m.mk = an.mk
UNION ALL SELECT DISTINCT conv_id, CAST(0 AS INTEGER), 'system', {S.q(RAG_SYSTEM_PROMPT)} FROM conversations"""


@register("rag_requests", lambda: _rag_sql())
def q_rag_requests(spark, sf_dir):
    from veilspark.operators.embed import HashEmbedder
    from veilspark.plans.pipelines import rag_requests
    return rag_requests(table(spark, sf_dir, "conversations"), _saved_nodes(spark, sf_dir), request_titles(spark, sf_dir),
                        secret=DEMO_SECRET, node_secret=DEMO_SECRET, embedder=HashEmbedder(EMBED_DIM, EMBED_MAX),
                        k=3, mode="sha", types=PATTERN_ALL, threshold=0.5)


# Messages that hold personal data: the turn's text and a customer's contact line.
PII_TURNS_SQL = """SELECT conv_id, turn, role, coalesce(t.text, '') || ' ' || c.text AS text FROM conversations t
JOIN cust_text c ON c.c_custkey = (SELECT min(c_custkey) FROM cust_text) + t.conv_id % (SELECT count(*) FROM cust_text)"""


def pii_turns(spark, sf_dir) -> DataFrame:
    """conversations, each turn followed by a customer's contact line (the customer by conversation)."""
    cust = customer_text(spark, sf_dir).select(F.col("c_custkey").alias("n"), F.col("text").alias("line"))
    r = cust.agg(F.min("n").alias("first"), F.count("*").alias("total")).first()
    conv = table(spark, sf_dir, "conversations").withColumn("n", F.lit(r["first"]) + F.col("conv_id") % r["total"])
    return conv.join(cust, "n").select("conv_id", "turn", "role", F.concat(
        F.coalesce("text", F.lit("")), F.lit(" "), F.col("line")).alias("text"))


@register("rag_from_collection", lambda: _rag_sql())
def q_rag_from_collection(spark, sf_dir):
    """The corpus is ingested once; requests search the saved collection through its metadata map."""
    from veilspark.operators.embed import HashEmbedder
    from veilspark.operators.search import metadata_contains
    from veilspark.plans.pipelines import rag_requests
    nodes = _saved_nodes(spark, sf_dir, "document")
    return rag_requests(table(spark, sf_dir, "conversations"), nodes, request_titles(spark, sf_dir),
                        secret=DEMO_SECRET, node_secret=DEMO_SECRET, embedder=HashEmbedder(EMBED_DIM, EMBED_MAX),
                        k=3, mode="sha", types=PATTERN_ALL, threshold=0.5,
                        where=metadata_contains(F.col("metadata"), {"kind": "document"}))


@register("assemble_request", lambda: f"""WITH cust_text AS ({CUSTOMER_TEXT_SQL}), pt AS ({PII_TURNS_SQL}),
msgs AS (SELECT conv_id * 1000 + turn + 1 AS mk, conv_id AS request_id,
  CAST(turn + 1 AS INTEGER) AS msg_no, role, text AS content FROM pt),
an AS ({S.anonymize_sql("msgs", "mk", "content", PATTERN_ALL, DEMO_SECRET, "EQUALITY", threshold=0.5)})
SELECT m.request_id, m.msg_no, m.role, an.content FROM msgs m JOIN an ON m.mk = an.mk
UNION ALL SELECT DISTINCT conv_id, CAST(0 AS INTEGER), 'system', {S.q(__import__('veilspark.fixed', fromlist=['x']).RAG_SYSTEM_PROMPT)} FROM conversations""")
def q_assemble_request(spark, sf_dir):
    from veilspark.operators.context import assemble_requests
    conv = pii_turns(spark, sf_dir)
    msgs = conv.select(F.col("conv_id").alias("request_id"), (F.col("turn") + 1).cast("int").alias("msg_no"),
                       "role", F.col("text").alias("content"))
    return assemble_requests(msgs, None, secret=DEMO_SECRET, mode="sha", types=PATTERN_ALL, threshold=0.5)


@register("ingest", lambda: f"""WITH ch AS ({CHUNKS_SQL}) SELECT ch.id, doc, content, 64 AS dim, n_tokens
FROM ch JOIN ({S.token_counts_sql('ch', 'id', 'content', PATTERN_ALL, 0.5)}) n ON ch.id = n.id""")
def q_ingest(spark, sf_dir):
    from veilspark.operators.anonymize import deanonymize_text
    s = _node_collection(spark, sf_dir).scan()
    return s.select("id", F.col("metadata")["doc"].alias("doc"),
                    deanonymize_text(F.col("content"), DEMO_SECRET).alias("content"),
                    F.size("embedding").alias("dim"), token_count(F.col("content")).alias("n_tokens"))


@register("response_restore", lambda: f"""WITH cust_text AS ({CUSTOMER_TEXT_SQL}), pt AS ({PII_TURNS_SQL}),
a AS (SELECT conv_id * 1000 + turn AS mk, conv_id, turn, text FROM pt WHERE role = 'assistant')
SELECT a.conv_id, a.turn, 'assistant' AS role, a.text AS content, n.n_tokens FROM a
JOIN ({S.token_counts_sql('a', 'mk', 'text', PATTERN_ALL, 0.5)}) n ON a.mk = n.mk""")
def q_response_restore(spark, sf_dir):
    from veilspark.operators.context import restore_response
    conv = pii_turns(spark, sf_dir).where(F.col("role") == "assistant")
    anon = anonymize(conv, "text", DEMO_SECRET, mode="aes", types=PATTERN_ALL, threshold=0.5,
                     salt=DEMO_SALT, scope="conv_id")
    resp = anon.select("conv_id", "turn", token_count(F.col("text")).alias("n_tokens"), F.struct(
        F.concat(F.lit("chatcmpl-"), F.col("conv_id").cast("string")).alias("id"),
        F.lit("chat.completion").alias("object"), F.lit(0).cast("long").alias("created"),
        F.lit("model").alias("model"),
        F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"),
                                                           F.col("text").alias("content"),
                                                           F.lit(None).cast("string").alias("name")).alias("message"),
                         F.lit("stop").alias("finish_reason"))).alias("choices"),
        F.struct(F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"),
                 F.lit(0).cast("long").alias("total_tokens")).alias("usage")).alias("provider_response"))
    r = restore_response(resp, secret=DEMO_SECRET)
    return r.select("conv_id", "turn", "n_tokens", F.explode("messages").alias("m")).select(
        "conv_id", "turn", "n_tokens", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@register("record_json", lambda: """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
  event_id % 7 = 0 AS corrupt FROM events""")
def q_record_json(spark, sf_dir):
    """Every seventh record is cut off before its end."""
    from veilspark.operators.context import parse_records
    cut = F.expr("substring(props, 1, length(props) - 1)")
    ev = table(spark, sf_dir, "events").withColumn(
        "props", F.when(F.col("event_id") % 7 == 0, cut).otherwise(F.col("props")))
    p = parse_records(ev, "props", "k int")
    return p.select("event_id", F.col("record.k").alias("k"), "corrupt")


@register("response_json", lambda: """SELECT conv_id, turn, '{"id":"r-' || CAST(conv_id AS VARCHAR)
  || '","choices":[{"index":0,"message":{"role":"assistant","content":"' || length(text) || ' chars"},"finish_reason":"stop"}]'
  || ',"usage":{"prompt_tokens":' || CAST(turn AS VARCHAR) || ',"total_tokens":' || CAST(turn + 1 AS VARCHAR) || '}}' AS json,
  length(text) || ' chars' AS content, turn + 1 AS total_tokens
FROM conversations WHERE role = 'assistant'""")
def q_response_json(spark, sf_dir):
    """A nested response written as JSON and read back."""
    from veilspark.operators.context import RESPONSE, parse_records
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    text = F.concat(F.length("text").cast("string"), F.lit(" chars"))
    resp = F.struct(F.concat(F.lit("r-"), F.col("conv_id").cast("string")).alias("id"),
                    F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), text.alias("content"))
                                     .alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"),
                    F.struct(F.col("turn").alias("prompt_tokens"), (F.col("turn") + 1).alias("total_tokens")).alias("usage"))
    p = parse_records(c.withColumn("json", F.to_json(resp)), "json", RESPONSE)
    return p.where("not corrupt").select(
        "conv_id", "turn", "json", F.col("record.choices")[0]["message"]["content"].alias("content"),
        F.col("record.usage.total_tokens").cast("int").alias("total_tokens"))


# ---------------------------------------------------------------- P7-P9, F9 aliases
def _anon_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return anonymize(docs, "text", DEMO_SECRET, mode="sha", types=PATTERN_ALL, threshold=0.5)


ANON_DOCS_SQL = (f"SELECT a.doc_id, d.source, a.text FROM ("
                 f"{S.anonymize_sql('documents', 'doc_id', 'text', PATTERN_ALL, DEMO_SECRET, 'EQUALITY', 0.5)}"
                 f") a JOIN documents d ON a.doc_id = d.doc_id")


def _alias_sql(session: str, row: str, pos: str) -> str:
    return (f"substring(translate(to_base64(unhex(sha256({session} || '#' || CAST({row} AS VARCHAR) || '#' || "
            f"CAST({pos} AS VARCHAR)))), '+/', '-_'), 1, {ALIAS_LEN})")


@register("alias_set", lambda: f"""WITH an AS ({ANON_DOCS_SQL})
SELECT doc_id, CASE WHEN len(string_split(text, 'α')) % 2 = 0 THEN NULL ELSE array_to_string(list_transform(
  string_split(text, 'α'), lambda s, i: CASE WHEN (i - 1) % 2 = 1 THEN 'α' || {_alias_sql('source', 'doc_id', 'i - 1')} || 'α'
  ELSE s END), '') END AS text FROM an""")
def q_alias_set(spark, sf_dir):
    from veilspark.operators.aliases import alias_tokens
    text, _ = alias_tokens(_anon_docs(spark, sf_dir), "text", "source", "doc_id")
    return text.select("doc_id", "text")


ALIAS_MAP_SQL = f"""SELECT source AS session_id, 'α' || {_alias_sql('source', 'doc_id', 'i - 1')} || 'α' AS alias, segs[i] AS token
FROM (SELECT doc_id, source, segs, unnest(generate_series(1, len(segs))) AS i
      FROM (SELECT doc_id, source, string_split(text, 'α') AS segs FROM an WHERE len(string_split(text, 'α')) % 2 = 1))
WHERE (i - 1) % 2 = 1"""


@register("alias_map", lambda: f"WITH an AS ({ANON_DOCS_SQL}) {ALIAS_MAP_SQL}")
def q_alias_map(spark, sf_dir):
    from veilspark.operators.aliases import alias_tokens
    _, amap = alias_tokens(_anon_docs(spark, sf_dir), "text", "source", "doc_id")
    return amap


@register("alias_get", lambda: f"WITH an AS ({ANON_DOCS_SQL}) SELECT doc_id, source, text, FALSE AS missing_alias FROM an")
def q_alias_get(spark, sf_dir):
    from veilspark.operators.aliases import alias_tokens, expand_aliases
    from veilspark.session import ensure_checkpoint_dir
    # The tokenized text feeds three branches (map, aliased text, expansion):
    # cut the lineage once in the shared checkpoint folder instead of
    # re-running detection for each branch.
    ensure_checkpoint_dir(spark)
    anon = _anon_docs(spark, sf_dir).checkpoint(eager=True)
    text, amap = alias_tokens(anon, "text", "source", "doc_id")
    return expand_aliases(text, amap, "text", "source", "doc_id")


@register("alias_delete_session", lambda: f"""WITH an AS ({ANON_DOCS_SQL}), m AS ({ALIAS_MAP_SQL})
SELECT session_id, alias FROM m WHERE session_id NOT IN (
  SELECT DISTINCT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)""")
def q_alias_delete_session(spark, sf_dir):
    from veilspark.operators.aliases import alias_tokens, delete_sessions
    _, amap = alias_tokens(_anon_docs(spark, sf_dir), "text", "source", "doc_id")
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    sessions = docs.join(toxic, "doc_id", "left_semi").select(F.col("source").alias("session_id"))
    return delete_sessions(amap, sessions).select("session_id", "alias")


@register("alias_upsert", lambda: f"""WITH an AS ({ANON_DOCS_SQL}), m AS ({ALIAS_MAP_SQL})
SELECT session_id, alias, CASE WHEN session_id = 'src0' THEN 'rewritten' ELSE token END AS token FROM m""")
def q_alias_upsert(spark, sf_dir):
    """One session's aliases are written again, later; the last write wins."""
    from veilspark.operators.aliases import alias_tokens, set_aliases
    _, amap = alias_tokens(_anon_docs(spark, sf_dir), "text", "source", "doc_id")
    old = amap.withColumn("written", F.lit(1))
    new = old.where("session_id = 'src0'").withColumn("token", F.lit("rewritten")).withColumn("written", F.lit(2))
    return set_aliases(old, new, order_col="written").select("session_id", "alias", "token")


ALIAS_USE_SQL = "TIMESTAMP '2024-01-01' + to_days(CAST(substring(session_id, 4) AS INTEGER))"


@register("alias_purge", lambda: f"""WITH an AS ({ANON_DOCS_SQL}), m AS ({ALIAS_MAP_SQL}),
u AS (SELECT *, {ALIAS_USE_SQL} AS t FROM m)
SELECT session_id, alias FROM u WHERE session_id = 'src1' OR t >= TIMESTAMP '2024-01-11'""")
def q_alias_purge(spark, sf_dir):
    """Sessions idle for ten days go; expanding a text of session src1 counts as use."""
    from veilspark.operators.aliases import alias_tokens, touch_aliases
    from veilspark.streaming.streams import purge_idle_sessions
    text, amap = alias_tokens(_anon_docs(spark, sf_dir), "text", "source", "doc_id")
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    day = F.substring("session_id", 4, 10).cast("int")
    amap = amap.withColumn("last_used", start + F.make_dt_interval(days=day))
    used = touch_aliases(amap, text.where("source = 'src1'"), "text", "source", F.to_timestamp_ntz(F.lit("2024-01-21 00:00:00")))
    return purge_idle_sessions(used, ttl_seconds=10 * 86400, as_of=F.to_timestamp_ntz(F.lit("2024-01-21 00:00:00"))) \
        .select("session_id", "alias")


@register("alias_delete_count", lambda: f"""WITH an AS ({ANON_DOCS_SQL}), m AS ({ALIAS_MAP_SQL}),
s AS (SELECT DISTINCT source AS session_id FROM documents UNION SELECT 'unknown')
SELECT s.session_id, count(m.alias) AS deleted FROM s LEFT JOIN m ON s.session_id = m.session_id GROUP BY s.session_id""")
def q_alias_delete_count(spark, sf_dir):
    """how many aliases each session's deletion removes; 0 where there is none."""
    from veilspark.operators.aliases import alias_tokens, delete_counts
    _, amap = alias_tokens(_anon_docs(spark, sf_dir), "text", "source", "doc_id")
    docs = table(spark, sf_dir, "documents")
    sessions = docs.select(F.col("source").alias("session_id")).distinct().union(
        spark.createDataFrame([("unknown",)], "session_id string"))
    return delete_counts(amap, sessions)


# ---------------------------------------------------------------- T1-T6 modifiers
def _vowels(c):
    return F.translate(c, "aeiou", "AEIOU")


def _stop_sql(text: str) -> str:
    from veilspark.fixed import WS_CLASS
    from veilspark.operators import modifiers as Mo
    words = ", ".join(S.q(w) for w in sorted(set(w.lower() for w in Mo.default_stop_words())))
    return (f"array_to_string(list_transform(list_filter(list_filter(string_split_regex({text}, {S.q(WS_CLASS + '+')}), "
            f"lambda w: w <> ''), lambda w: NOT list_contains([{words}], translate(w, {S.q(Mo.LOWER_FROM)}, "
            f"{S.q(Mo.LOWER_TO)}))), lambda w: regexp_replace(w, '[^\\x00-\\x7F]', '', 'g')), ' ')")


@register("stop_words", lambda: f"SELECT doc_id, {_stop_sql('text')} AS text FROM documents")
def q_stop_words(spark, sf_dir):
    from veilspark.operators.modifiers import apply_modifier, remove_stop_words
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_modifier(d, "text", remove_stop_words())


@register("modifier_chain", lambda: f"SELECT doc_id, translate({_stop_sql('text')}, 'aeiou', 'AEIOU') AS text FROM documents")
def q_modifier_chain(spark, sf_dir):
    from veilspark.operators.modifiers import apply_modifier, chain, remove_stop_words
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_modifier(d, "text", chain(remove_stop_words(), _vowels))


@register("modifier_nested", lambda: """SELECT conv_id, turn,
  translate(text, 'aeiou', 'AEIOU') AS node_content, translate(text, 'aeiou', 'AEIOU') AS node_note, 'role' AS node_role_key,
  text AS list_node_note, translate(text, 'aeiou', 'AEIOU') AS list_node_content,
  translate(coalesce(text, ''), 'aeiou', 'AEIOU') AS msg_content, role AS msg_role,
  translate(role, 'aeiou', 'AEIOU') AS tag_role, translate(text, 'aeiou', 'AEIOU') AS map_value, turn AS kept_int
FROM conversations""")
def q_modifier_nested(spark, sf_dir):
    from veilspark.operators.modifiers import apply_modifier
    c = table(spark, sf_dir, "conversations")
    nested = c.select("conv_id", "turn", F.struct(
        F.struct(F.col("text").alias("content"), F.create_map(F.lit("note"), F.col("text"), F.lit("role"), F.col("role"))
                 .alias("metadata")).alias("node"),
        F.array(F.struct(F.col("text").alias("content"), F.create_map(F.lit("note"), F.col("text")).alias("metadata")))
        .alias("nodes"),
        F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content"),
                         F.lit(None).cast("string").alias("name"))).alias("messages"),
        F.array(F.col("role")).alias("tags"),
        F.create_map(F.col("role"), F.col("text")).alias("extra"),
        F.col("turn").alias("n")).alias("payload"))
    m = apply_modifier(nested, "payload", _vowels)
    p = F.col("payload")
    return m.select("conv_id", "turn", p["node"]["content"].alias("node_content"),
                    p["node"]["metadata"]["note"].alias("node_note"),
                    F.map_keys(p["node"]["metadata"])[1].alias("node_role_key"),
                    p["nodes"][0]["metadata"]["note"].alias("list_node_note"),
                    p["nodes"][0]["content"].alias("list_node_content"),
                    p["messages"][0]["content"].alias("msg_content"), p["messages"][0]["role"].alias("msg_role"),
                    p["tags"][0].alias("tag_role"), F.map_values(p["extra"])[0].alias("map_value"),
                    p["n"].alias("kept_int"))


TOX_LEXICON_SQL = """SELECT word FROM (
  SELECT w.word, sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS t, sum(CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END) AS c
  FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS word FROM documents) w
  JOIN labels l ON w.doc_id = l.doc_id GROUP BY w.word) WHERE t >= 5 AND c = 0"""


def _tox_hits_sql(text: str) -> str:
    return (f"len(list_filter(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            f"'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'), lambda w: list_contains(lex.words, w)))")


def _lexicon(spark, sf_dir):
    from veilspark.operators.modifiers import learn_toxic_lexicon
    return learn_toxic_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), min_docs=5)


@register("toxicity_lexicon", lambda: TOX_LEXICON_SQL)
def q_toxicity_lexicon(spark, sf_dir):
    from veilspark.operators.modifiers import learn_toxic_lexicon
    return learn_toxic_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), min_docs=5)


@register("toxicity_purge", lambda: f"""WITH lex AS (SELECT coalesce(list(word), []) AS words FROM ({TOX_LEXICON_SQL}))
SELECT doc_id, CASE WHEN {_tox_hits_sql('text')} > 0
  THEN {S.q(__import__('veilspark.fixed', fromlist=['x']).PURGED_TEXT)} ELSE text END AS text FROM documents, lex""")
def q_toxicity_purge(spark, sf_dir):
    from veilspark.fixed import PURGED_TEXT
    from veilspark.operators.modifiers import toxic_hit_counts, toxicity_score
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = toxic_hit_counts(d, "text", _lexicon(spark, sf_dir))
    return h.select("doc_id", F.when(toxicity_score(F.col("toxic_hits")) > F.lit(0.5), F.lit(PURGED_TEXT))
                    .otherwise(F.col("text")).alias("text"))


@register("toxicity_flag", lambda: f"""WITH lex AS (SELECT coalesce(list(word), []) AS words FROM ({TOX_LEXICON_SQL}))
SELECT conv_id, turn, CAST({_tox_hits_sql('text')} AS INTEGER) AS hits, {_tox_hits_sql('text')} > 0 AS is_toxic
FROM conversations, lex""")
def q_toxicity_flag(spark, sf_dir):
    from veilspark.operators.modifiers import toxic_hit_counts, toxicity_score
    c = table(spark, sf_dir, "conversations")
    h = toxic_hit_counts(c, "text", _lexicon(spark, sf_dir), out_col="hits")
    return h.select("conv_id", "turn", "hits", (toxicity_score(F.col("hits")) > F.lit(0.5)).alias("is_toxic"))


# T4 by counts: log-odds of words over all labelled rows, whole millionths, so sums are exact.
TOX_WEIGHTS_SQL = """SELECT word, CAST(round(ln(CASE WHEN word = '' THEN (t + 0.5) / (c + 0.5)
    ELSE ((t + 0.5) / (nt + 1.0)) / ((c + 0.5) / (nc + 1.0)) END) * 1e6) AS BIGINT) AS weight
FROM (SELECT w.word, CAST(sum(l.toxic) AS DOUBLE) AS t, CAST(sum(1 - l.toxic) AS DOUBLE) AS c
  FROM (SELECT DISTINCT doc_id, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'), '')) AS word FROM documents) w
  JOIN labels l ON w.doc_id = l.doc_id WHERE l.toxic IN (0, 1) GROUP BY w.word),
 (SELECT sum(l.toxic) AS nt, sum(1 - l.toxic) AS nc FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IN (0, 1))"""


@register("toxicity_nb", lambda: f"""SELECT d.doc_id, CAST(sum(m.weight) AS BIGINT) AS score, sum(m.weight) > 0 AS is_toxic
FROM (SELECT DISTINCT doc_id, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'), '')) AS word FROM documents) d
JOIN ({TOX_WEIGHTS_SQL}) m ON d.word = m.word GROUP BY d.doc_id""")
def q_toxicity_nb(spark, sf_dir):
    from veilspark.operators.modifiers import toxicity_by_words, toxicity_weights
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_by_words(docs, toxicity_weights(docs, table(spark, sf_dir, "labels")))


# ---------------------------------------------------------------- X1-X4 streams
def _stream_dirs(spark, name):
    import uuid
    from veilspark.session import shared_path
    base = shared_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    return f"{base}/sink", f"{base}/checkpoint", f"{base}/map"


def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@register("stream_anonymize", lambda: S.anonymize_sql("documents", "doc_id", "text", PATTERN_ALL,
                                              DEMO_SECRET, "EQUALITY", threshold=0.5))
def q_stream_anonymize(spark, sf_dir):
    from veilspark.streaming.streams import anonymize_stream, table_stream
    schema = table(spark, sf_dir, "documents").select("doc_id", "text").schema
    sink, ckpt, _ = _stream_dirs(spark, "anonymize")
    s = table_stream(spark, sf_dir, "documents", schema)
    _run(anonymize_stream(s, "text", DEMO_SECRET, sink=sink, checkpoint=ckpt, mode="sha",
                          types=PATTERN_ALL, threshold=0.5))
    return spark.read.schema(schema).parquet(sink)


@register("stream_ingest", lambda: f"SELECT id, doc, content FROM ({CHUNKS_SQL})")
def q_stream_ingest(spark, sf_dir):
    from veilspark.operators.anonymize import deanonymize_text
    from veilspark.streaming.streams import ingest_stream, table_stream
    schema = table(spark, sf_dir, "documents").schema
    _, ckpt, _ = _stream_dirs(spark, "ingest")
    coll = _new_collection(spark, "node")
    s = table_stream(spark, sf_dir, "documents", schema)
    _run(ingest_stream(s, coll, secret=DEMO_SECRET, checkpoint=ckpt, max_words=256, overlap=10, salt=DEMO_SALT))
    return coll.scan().select("id", F.col("metadata")["doc"].alias("doc"),
                              deanonymize_text(F.col("content"), DEMO_SECRET).alias("content"))


@register("stream_ingest_two_sources", lambda: f"""SELECT id, content FROM ({CHUNKS_SQL})
UNION ALL SELECT -(item_id + 1) * 1000000 + chunk_no AS id, content
FROM ({chunk_sql(256, 10, src="benchmark", key="item_id")})""")
def q_stream_ingest_two_sources(spark, sf_dir):
    """Two streams fill one collection; the first is then run again from a fresh checkpoint."""
    from veilspark.operators.anonymize import deanonymize_text
    from veilspark.streaming.streams import ingest_stream, table_stream
    coll = _new_collection(spark, "node")

    def docs():
        return table_stream(spark, sf_dir, "documents", table(spark, sf_dir, "documents").schema)

    items = table_stream(spark, sf_dir, "benchmark", table(spark, sf_dir, "benchmark").schema).select(
        (-F.col("item_id") - 1).alias("doc_id"), F.lit("benchmark").alias("source"), "text")
    for stream in (docs(), items, docs()):
        _, ckpt, _ = _stream_dirs(spark, "ingest")
        _run(ingest_stream(stream, coll, secret=DEMO_SECRET, checkpoint=ckpt, max_words=256, overlap=10, salt=DEMO_SALT))
    return coll.scan().select("id", deanonymize_text(F.col("content"), DEMO_SECRET).alias("content"))


@register("stream_deanonymize", lambda: "SELECT doc_id, text, FALSE AS malformed FROM documents")
def q_stream_deanonymize(spark, sf_dir):
    """Anonymize as a stream, restore the sink's rows as a second stream."""
    from veilspark.streaming.streams import anonymize_stream, deanonymize_stream, table_stream
    schema = table(spark, sf_dir, "documents").select("doc_id", "text").schema
    sink, ckpt, back = _stream_dirs(spark, "anonymize")
    s = table_stream(spark, sf_dir, "documents", schema)
    _run(anonymize_stream(s, "text", DEMO_SECRET, sink=sink, checkpoint=ckpt, mode="aes", types=PATTERN_ALL,
                          threshold=0.5, salt=DEMO_SALT, scope="doc_id"))
    stored = spark.readStream.schema(schema).parquet(sink)
    _run(deanonymize_stream(stored, "text", DEMO_SECRET, sink=back, checkpoint=f"{back}-checkpoint"))
    return spark.read.parquet(back).select("doc_id", "text", "malformed")


@register("stream_cache_lookup", lambda: _lookup_sql(0.1, "SELECT item_id AS pid, text AS prompt FROM benchmark"))
def q_stream_cache_lookup(spark, sf_dir):
    from veilspark.streaming.streams import cache_lookup_stream, table_stream
    coll = _stored_cache(spark, sf_dir)
    schema = table(spark, sf_dir, "benchmark").schema
    sink, ckpt, _ = _stream_dirs(spark, "cache")
    s = table_stream(spark, sf_dir, "benchmark", schema).select(
        F.col("item_id").alias("pid"), F.col("text").alias("prompt"))
    _run(cache_lookup_stream(s, coll, secret=DEMO_SECRET, as_of=F.to_timestamp_ntz(F.lit(CACHE_AS_OF)),
                             sink=sink, checkpoint=ckpt, ttl_seconds=604800))
    return spark.read.option("recursiveFileLookup", "true").parquet(sink) \
        .select("pid", "status", "cache_id", "record_json")


@register("stream_alias_map", lambda: f"WITH an AS ({ANON_DOCS_SQL}) {ALIAS_MAP_SQL}")
def q_stream_alias_map(spark, sf_dir):
    from veilspark.streaming.streams import alias_stream, table_stream
    schema = table(spark, sf_dir, "documents").select("doc_id", "source", "text").schema
    sink, ckpt, msink = _stream_dirs(spark, "alias")
    s = table_stream(spark, sf_dir, "documents", schema).select("doc_id", "source", "text")
    s = anonymize(s, "text", DEMO_SECRET, mode="sha", types=PATTERN_ALL, threshold=0.5)
    _run(alias_stream(s, text_col="text", session_col="source", row_key="doc_id", text_sink=sink,
                      map_sink=msink, checkpoint=ckpt))
    return spark.read.option("recursiveFileLookup", "true").parquet(msink).select("session_id", "alias", "token")


# ---------------------------------------------------------------- DATE_TIME on order text
def order_text(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    d = F.col("o_orderdate")
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" placed "),
                    F.date_format(d, "yyyy-MM-dd"), F.lit(" at "), F.date_format(d, "HH:mm"),
                    F.lit(", ship by "), F.date_format(d, "MM/dd/yyyy"), F.lit(", confirm on "),
                    F.date_format(d, "MMMM d, yyyy"), F.lit(" ("), F.col("o_orderpriority"), F.lit(")."))
    return o.select("o_orderkey", text.alias("text"))


ORDER_TEXT_SQL = """SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' placed ' || strftime(o_orderdate, '%Y-%m-%d')
  || ' at ' || strftime(o_orderdate, '%H:%M') || ', ship by ' || strftime(o_orderdate, '%m/%d/%Y')
  || ', confirm on ' || strftime(o_orderdate, '%B %-d, %Y') || ' (' || o_orderpriority || ').' AS text FROM orders"""


@register("pii_date_orders", lambda: f"""WITH ot AS ({ORDER_TEXT_SQL})
SELECT o_orderkey, start, "end", pii_type, score, value FROM ({S.type_spans_sql('ot', 'o_orderkey', 'text', 'DATE_TIME')})""")
def q_pii_date_orders(spark, sf_dir):
    d = detect_pii(order_text(spark, sf_dir), "text", types=["DATE_TIME"])
    return explode_spans(d, "o_orderkey").select("o_orderkey", "start", "end", "pii_type", "score", "value")


# ---------------------------------------------------------------- P6 with malformed input
@register("deanonymize", lambda: """SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE text END AS text,
  lang = 'de' AS malformed FROM documents""")
def q_deanonymize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    anon = anonymize(docs, "text", DEMO_SECRET, mode="aes", types=PATTERN_ALL, threshold=0.5,
                     salt=DEMO_SALT, scope="doc_id")
    # German rows get a stray delimiter appended: their text must come back NULL and flagged.
    tampered = anon.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("α")))
                               .otherwise(F.col("text")))
    return deanonymize(tampered, "text", DEMO_SECRET).select("doc_id", "text", "malformed")


# ---------------------------------------------------------------- T4 classifier (rows-only)
@register("toxicity_model")
def q_toxicity_model(spark, sf_dir):
    from veilspark.operators.modifiers import toxicity_classifier
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity_classifier(docs.join(labels, "doc_id"), text_col="text", label_col="toxic")
    return model.transform(docs).select("doc_id", F.col("prediction").cast("int").alias("is_toxic"))
