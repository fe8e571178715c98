"""Line deduplication by windows of lines.

A window is the shortest run of lines from a given line on, or up to a given
line, that holds at least ``min_words`` words.  Its key is a 128-bit hash of
all its lines, so equal keys mean equal windows, and every window meets the
first place (by document id, then line) that has the same lines.  A line of a
run of at least ``min_words`` words which an earlier place shares lies in a
window inside that run: in the one from a line on, or, in the last lines of
the run, in the one up to that line.  So the lines of all windows with an
earlier equal one are exactly the lines of the repeated runs; they are deleted,
and the first occurrence stays.

Only DataFrame functions are used.  Texts are shuffled once (to cut them); all
else are hashes.  A window spans at most ``min_words`` lines with words; blank
lines between them count by their number, so a task holds arrays of bounded
size however many places share a line.  Equal windows are aggregated to their
first place before they are joined.

Edge cases: NULL text stays NULL and empty text empty; blank lines count as
equal lines without words; a text of fewer than ``min_words`` words is left
alone; rows with the same id and text are one place (their results agree);
rows with the same id and other texts are ordered by a hash; a NULL id comes
first; the order of lines and all other columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import free_name, materialize

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
PLACE = ["d", "x"]                                     # a document: its id and its text's hash
KEY = ["blank", "a", "b"]                              # a window: blank lines at its edge, and its lines


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text")) \
        .filter(F.col("text").isNotNull())


def windows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(d, x, lo, hi, blank, a, b): the windows [lo, hi) from each line on and up to each line.

    ``blank`` counts the blank lines at the open edge: before the first line with words
    (0, 1, ...), or after the last one (-1, -2, ... for 0, 1, ...).
    """
    lines = _places(docs, id_col, text_col).withColumn("lines", F.split("text", "\n")).select(
        "d", "x", F.size("lines").alias("n"), F.posexplode("lines").alias("idx", "line")).filter(F.col("line").rlike(WORD))
    rows = lines.select("d", "x", "n", "idx", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"),
                        F.regexp_count("line", F.lit(WORD)).cast("int").alias("w"))
    # Rows of one document meet once; equal rows of the input fall together there.
    rows = rows.repartition(*PLACE).groupBy(*PLACE, "idx").agg(*[F.first(c).alias(c) for c in ("n", "h", "h2", "w")])
    by_line = Window.partitionBy(*PLACE).orderBy("idx")
    rows = rows.withColumns({
        "e": F.sum("w").over(by_line), "total": F.sum("w").over(Window.partitionBy(*PLACE)),
        "before": F.col("idx") - F.coalesce(F.lag("idx").over(by_line), F.lit(-1)) - 1,
        "after": F.coalesce(F.lead("idx").over(by_line), F.col("n")) - F.col("idx") - 1})
    # A line as it follows the one before it in a window.
    rows = rows.withColumn("s", F.col("e") - F.col("w")) \
        .withColumn("g", F.struct(F.xxhash64("before", "h").alias("g"), F.xxhash64("before", "h2").alias("g2")))
    ahead = Window.partitionBy(*PLACE).orderBy("s").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*PLACE).orderBy("e").rangeBetween(1 - min_words, 0)
    rows = rows.withColumns({
        "next": F.collect_list("g").over(ahead), "end": F.max("idx").over(ahead) + 1,
        "prior": F.collect_list("g").over(back), "from": F.first(F.struct("idx", "s", "h", "h2")).over(back)})

    def keyed(h, h2, links):
        rest = F.slice(links, 2, min_words)
        return F.xxhash64(h, h2, rest), F.xxhash64(F.lit(1), h, h2, rest)

    ahead_key = keyed(F.col("h"), F.col("h2"), F.col("next"))
    back_key = keyed(F.col("from.h"), F.col("from.h2"), F.col("prior"))
    rows = rows.withColumns({"a1": ahead_key[0], "b1": ahead_key[1], "a2": back_key[0], "b2": back_key[1]})
    on = F.when(F.col("s") + min_words <= F.col("total"), F.transform(
        F.sequence(F.lit(0), F.col("before")),
        lambda k: F.struct((F.col("idx") - k).alias("lo"), F.col("end").alias("hi"), k.alias("blank"),
                           F.col("a1").alias("a"), F.col("b1").alias("b"))))
    # Without blank lines at its end, a window that is also the shortest from its first line on is there already.
    same = F.col("e") - F.col("w") - F.col("from.s") < min_words
    up = F.when(F.col("e") >= min_words, F.transform(
        F.filter(F.sequence(F.lit(0), F.col("after")), lambda k: (k > 0) | ~same),
        lambda k: F.struct(F.col("from.idx").alias("lo"), (F.col("idx") + k + 1).alias("hi"), (-1 - k).alias("blank"),
                           F.col("a2").alias("a"), F.col("b2").alias("b"))))
    both = rows.select(*PLACE, on.alias("on"), up.alias("up")).select(
        *PLACE, F.concat(F.coalesce("on", F.array()), F.coalesce("up", F.array())).alias("both"))
    return both.select(*PLACE, F.inline("both"))


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(d, x, lo, hi): the line ranges [lo, hi) that repeat earlier runs; ranges that touch are one."""
    found = materialize(windows(docs, id_col, text_col, min_words), "line-windows")
    first = found.groupBy(*KEY).agg(F.min(F.struct("d", "x", "lo")).alias("f"), F.count("*").alias("n")) \
        .filter("n > 1").select(*KEY, "f")
    same = F.col("d").eqNullSafe(F.col("f.d")) & (F.col("x") == F.col("f.x")) & (F.col("lo") == F.col("f.lo"))
    later = found.join(first, KEY).filter(~same).select(*PLACE, "lo", "hi")
    by = Window.partitionBy(*PLACE).orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)) \
        .withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*PLACE, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, drop_emptied: bool = True, report: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text.

    ``drop_emptied``: documents that had words and lost them all are dropped.
    ``report``: adds a struct ``lines_removed`` (n_lines, n_removed, n_runs).
    """
    runs = repeated_runs(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    cuts = runs.groupBy("d", "x").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    x, gone, name = (free_name(docs, n) for n in ("text_hash", "cuts", "lines_removed"))
    cuts = cuts.select(F.col("d").alias(gone + "_d"), F.col("x").alias(gone + "_x"), F.col("cut").alias(gone))
    # Always by a shuffle on the key: whether the cuts could be broadcast depends on how many there are.
    both = docs.withColumn(x, F.xxhash64(text_col)).join(
        cuts.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col(gone + "_d")) & (F.col(x) == F.col(gone + "_x")), "left")
    lines = F.split(text_col, "\n")
    # Positions first, so that a line is looked up and not compared with every run.
    lost = F.array_distinct(F.flatten(F.transform(gone, lambda g: F.sequence(g["lo"], g["hi"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    extra = [F.struct(F.size(lines).cast("long").alias("n_lines"),
                      F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_runs")).alias(name)] if report else []
    out = both.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *extra,
                      F.col(gone).isNotNull().alias(gone))
    if drop_emptied:
        out = out.filter(~F.col(gone) | F.col(text_col).rlike(WORD))
    return out.drop(gone)
