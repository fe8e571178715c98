"""Document sources as DataFrames ``(resource, text, metadata)``.

Any Spark source works (parquet, json, text, jdbc); the loader only projects
the columns into the document shape.  Metadata always carries ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def load_documents(spark: SparkSession, path: str, fmt: str = "parquet", *,
                   text_col: str = "text", resource_col: str = "resource",
                   name_col: str | None = None, extra_meta: dict[str, str] | None = None,
                   options: dict | None = None) -> DataFrame:
    """S1 bulk load: read any source into ``(resource, text, metadata)``."""
    raw = spark.read.format(fmt).options(**(options or {})).load(path)
    return to_documents(raw, text_col=text_col, resource=F.col(resource_col),
                        name=F.col(name_col) if name_col else None, extra_meta=extra_meta)


def to_documents(df: DataFrame, *, text_col: str = "text", resource: Column,
                 name: Column | None = None, extra_meta: dict[str, str] | None = None,
                 keep: dict[str, str] | None = None) -> DataFrame:
    """``(resource, text, metadata)``; ``keep`` names further columns (result name to source column)."""
    resource = resource.cast("string")
    doc = F.coalesce(name.cast("string"), resource) if name is not None else resource
    kv = [F.lit("doc"), doc]
    for k, c in (extra_meta or {}).items():
        kv += [F.lit(k), F.col(c).cast("string")]
    return df.select(resource.alias("resource"), F.col(text_col).alias("text"),
                     F.create_map(*kv).alias("metadata"), *[F.col(c).alias(k) for k, c in (keep or {}).items()])


def load_resources(docs: DataFrame, requests: DataFrame, resource_col: str = "resource",
                   name_col: str | None = None) -> DataFrame:
    """S2 single-resource load, batched: one row per requested resource.

    ``requests`` holds ``resource`` (and optionally a display ``name``); the
    document becomes ``doc = coalesce(name, resource)``.  An equi-join; Spark
    broadcasts a small request set.
    """
    r = requests.select(F.col(resource_col).cast("string").alias("resource"),
                        (F.col(name_col).cast("string") if name_col else F.lit(None).cast("string"))
                        .alias("_name"))
    j = docs.join(r, "resource")
    return j.select("resource", "text", F.map_concat(
        F.map_filter("metadata", lambda k, v: k != "doc"),
        F.create_map(F.lit("doc"), F.coalesce("_name", "resource"))).alias("metadata"))


def load_resource(docs: DataFrame, resource, name: str | None = None, *, key_col: str = "resource",
                  text_col: str = "text") -> DataFrame:
    """S2 single resource: ``(resource, text, metadata)`` of the rows whose key equals ``resource``.

    The literal keeps the key column's own type, so the condition reaches the
    scan (Parquet statistics and partitions skip the rest).
    """
    found = docs.where(F.col(key_col) == F.lit(resource).cast(docs.schema[key_col].dataType))
    key = F.col(key_col).cast("string")
    return found.select(key.alias("resource"), F.col(text_col).alias("text"),
                        F.create_map(F.lit("doc"), F.lit(name) if name is not None else key).alias("metadata"))


def load_json(spark: SparkSession, path: str, schema: str, *, text_col: str = "text", resource_col: str = "resource",
              name_col: str | None = None, extra_meta: dict[str, str] | None = None) -> DataFrame:
    """S1 from JSON lines with a given schema: ``(resource, text, metadata, corrupt)``.

    A line that is no JSON object of that schema becomes a row of NULLs with
    the raw line in ``corrupt``; it never ends the job or shifts other rows.
    """
    read = T._parse_datatype_string(schema)
    raw = spark.read.schema(T.StructType([*read.fields, T.StructField("_corrupt", T.StringType())])) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = raw.select(*[F.when(F.col("_corrupt").isNull(), F.col(f.name)).alias(f.name) for f in read.fields], "_corrupt")
    return to_documents(good, text_col=text_col, resource=F.col(resource_col), name=F.col(name_col) if name_col else None,
                        extra_meta=extra_meta, keep={"corrupt": "_corrupt"})


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """S1 from text files, one document per file: ``(resource, text, metadata)``, the file name as resource."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("file"))
    return to_documents(raw, resource=F.col("file"))


def demo_documents(spark: SparkSession) -> DataFrame:
    """S3: the three fixed demo rows (for examples only; no registered query uses it)."""
    rows = [("resource1", "Demo text"), ("resource2", "Demo text"), ("resource3", "Demo text")]
    df = spark.createDataFrame(rows, "resource string, text string")
    return to_documents(df, resource=F.col("resource"))


# --- fixed values: HTML cleanup patterns ------------------------------------
HTML_DROP_BLOCKS = r"(?is)<(script|style)[^>]*>.*?</(script|style)\s*>"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"<[^>]*>"
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                 ("&nbsp;", " "), ("&amp;", "&")]
HTML_BLANKS = r"[ \t\n\r\f]+"
HTML_REFERENCE = r"&(?:#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|lt|gt|quot|nbsp|amp);"


def decode_references(text: Column) -> Column:
    """Character references, numeric ones by code point (``&#8217;``, ``&#x2019;``), each read once.

    What a reference spells is not read again (``&#38;lt;`` gives ``&lt;``).
    0, surrogates and numbers past U+10FFFF become U+FFFD.
    """
    def char(ref):
        body = F.substring(ref, F.lit(3), F.length(ref) - 3)
        hexa = F.lower(F.substring(body, 1, 1)) == "x"
        code = F.when(hexa, F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).try_cast("long")
        code = F.when((code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code)
        out = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        for name, value in HTML_ENTITIES:
            out = F.when(ref == name, F.lit(value)).otherwise(out)
        return out

    between = F.split(text, HTML_REFERENCE, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(HTML_REFERENCE), F.lit(0)), char)
    whole = F.array_join(F.transform(F.arrays_zip(between.alias("s"), chars.alias("c")),
                                     lambda x: F.concat(x["s"], F.coalesce(x["c"], F.lit("")))), "")
    return F.when(F.instr(text, "&") > 0, whole).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Drop script/style/comments, strip tags, decode character references, collapse blanks."""
    t = F.regexp_replace(html, HTML_DROP_BLOCKS, " ")
    t = F.regexp_replace(t, HTML_COMMENT, " ")
    t = F.regexp_replace(t, HTML_TAG, " ")
    return F.trim(F.regexp_replace(decode_references(t), HTML_BLANKS, " "))


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """S4 (re-aimed article loader): web pages → ``(resource, text, metadata)``."""
    d = pages.select(F.col("url").alias("resource"), html_to_text(F.col("html")).alias("text"),
                     F.col("url"))
    return d.select("resource", "text", F.create_map(F.lit("doc"), F.col("url")).alias("metadata"))
