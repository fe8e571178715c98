"""WARC derivatives.

A ``response`` record (HTTP headers and HTML payload) becomes two records that
refer to it: ``metadata`` (title, language, description, counts of links and
text) and ``conversion`` (the plain text).  Both keep ``WARC-Refers-To``, the
response's target URI and date and its payload digest; block digests and
lengths are of the record's own bytes.  Record identifiers are name-based
(from the response's identifier and the record type), so a repeated run or a
retried task writes the same records.  Everything is a chain of column
expressions: no shuffle, no Python.

Edge cases: a NULL or empty page is an empty payload and still gives both
records; a NULL URL is an empty target; repeated rows give repeated records;
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"       # capture date where the source has none; a parameter

# --- fixed values: the character references decoded in plain text, in order
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&amp;", "&")]
# --- fixed values: what is taken out of the markup, in order
DROPPED = [r"(?is)<!--.*?-->", r"(?is)<script[^>]*>.*?</script[^>]*>", r"(?is)<style[^>]*>.*?</style[^>]*>",
           r"(?is)<head[^>]*>.*?</head[^>]*>", r"(?is)<nav[^>]*>.*?</nav[^>]*>"]
BREAKS = r"(?i)<(?:br|/?p|/?div|/?li|/?tr|/?h[1-6]|/?ul|/?ol|/?table|/?article|/?section)(?:[\s/][^>]*)?>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r"(?i)<html[^>]*\slang=\"([A-Za-z-]+)\""


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _uuid(seed: Column) -> Column:
    """A name-based identifier, ``<urn:uuid:...>``."""
    h = F.sha2(seed.cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Markup to text: blocks become lines, runs of blanks one blank, empty lines go."""
    for rx in DROPPED:
        html = F.regexp_replace(html, rx, " ")
    html = F.regexp_replace(html, BREAKS, "\n")
    html = _unescape(F.regexp_replace(html, r"(?s)<[^>]*>", ""))
    html = F.regexp_replace(html, r"[ \t\r\f]+", " ")
    html = F.regexp_replace(html, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(html, r"^[ \n]+|[ \n]+$", "")


def _count(text: Column, rx: str) -> Column:
    return F.regexp_count(text, F.lit(rx)).cast("long")


def responses(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", date: str = DATE) -> DataFrame:
    """Response records of raw pages: key, record_id, target_uri, date, headers, payload, payload_digest."""
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF +
                             "Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(
        F.col(id_col).alias("key"), url.alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"),
        html.alias("payload"), _digest(html).alias("payload_digest"),
        _uuid(F.concat(F.lit("response "), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), url))
        .alias("record_id"))


def derive(resp: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records, two rows each.

    Columns: key, record_type, record_id, refers_to, target_uri, date,
    content_type, source_digest, source_headers, block, block_digest,
    content_length, warc_headers.
    """
    p = F.col("payload")
    title = F.trim(_unescape(F.regexp_replace(F.regexp_extract(p, TITLE, 1), r"\s+", " ")))
    base = resp.withColumn("text_", plain_text(p))
    meta = F.concat(
        F.lit("title: "), title, F.lit(CRLF + "language: "), F.regexp_extract(p, LANGUAGE, 1),
        F.lit(CRLF + "http-status: "), F.regexp_extract("headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1),
        F.lit(CRLF + "http-content-type: "), F.regexp_extract("headers", r"(?i)\ncontent-type: *([^\r\n]*)", 1),
        F.lit(CRLF + "links: "), _count(p, r"(?i)<a\s[^>]*href=").cast("string"),
        F.lit(CRLF + "images: "), _count(p, r"(?i)<img[\s>]").cast("string"),
        F.lit(CRLF + "text-length: "), F.octet_length("text_").cast("string"), F.lit(CRLF))
    two = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), meta.alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain; charset=utf-8").alias("c"),
                 F.col("text_").alias("b")))
    out = base.select("key", "record_id", "target_uri", "date", "headers", "payload_digest",
                      F.explode(two).alias("r"))
    rid = _uuid(F.concat(F.col("r.t"), F.lit(" "), F.col("record_id")))
    out = out.select(
        "key", F.col("r.t").alias("record_type"), rid.alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "date", F.col("r.c").alias("content_type"), F.col("payload_digest").alias("source_digest"),
        F.col("headers").alias("source_headers"), F.col("r.b").alias("block"), _digest(F.col("r.b")).alias("block_digest"),
        F.octet_length("r.b").cast("long").alias("content_length"))
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
             ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"),
             ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"),
             ("Content-Length", "content_length")]
    head = F.concat(F.lit("WARC/1.1"), *[x for k, c in lines for x in (F.lit(CRLF + k + ": "), F.col(c).cast("string"))],
                    F.lit(CRLF + CRLF))
    return out.withColumn("warc_headers", head)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one per partition (``.warc`` text parts)."""
    records.select(F.concat("warc_headers", "block").alias("value")) \
        .write.option("lineSep", CRLF + CRLF).text(path)


#: DuckDB SQL for ``derive(responses(pages))`` without the serialised header.
def _sql() -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"

    crlf = "chr(13) || chr(10)"
    text = "payload"
    for rx in DROPPED:
        text = f"regexp_replace({text}, {q(rx)}, ' ', 'g')"
    text = f"regexp_replace({text}, {q(BREAKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, '(?s)<[^>]*>', '', 'g')"

    def unescape(x):
        for name, char in ENTITIES:
            x = f"replace({x}, {q(name)}, {q(char)})"
        return x

    text = f"regexp_replace({unescape(text)}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')"
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = "regexp_replace(regexp_extract(payload, " + q(TITLE) + ", 1), '\\s+', ' ', 'g')"

    def uid(seed):
        h = f"sha256({seed})"
        return ("'<urn:uuid:' || " + " || '-' || ".join(
            f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'")

    return f"""WITH resp AS (
  SELECT page_id AS key, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
         {uid("'response ' || coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '')")} AS refers_to,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: '
           || CAST(strlen(coalesce(html, '')) AS VARCHAR) || {crlf} || {crlf} AS source_headers
  FROM pages),
t AS (SELECT *, {text} AS text_ FROM resp),
r AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || trim({unescape(title)}) || {crlf} || 'language: ' || regexp_extract(payload, {q(LANGUAGE)}, 1)
    || {crlf} || 'http-status: 200' || {crlf} || 'http-content-type: text/html; charset=utf-8' || {crlf} || 'links: '
    || CAST(len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href=')) AS VARCHAR) || {crlf} || 'images: '
    || CAST(len(regexp_extract_all(payload, '(?i)<img[\\s>]')) AS VARCHAR) || {crlf} || 'text-length: '
    || CAST(strlen(text_) AS VARCHAR) || {crlf} AS block FROM t
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text_ FROM t)
SELECT key AS page_id, record_type, {uid("record_type || ' ' || refers_to")} AS record_id, refers_to, target_uri,
  '{DATE}' AS date, content_type, 'sha256:' || sha256(payload) AS source_digest, source_headers, block,
  'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length
FROM r"""


ORACLE_SQL = _sql()
