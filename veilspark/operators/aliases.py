"""Short per-session aliases for long tokens.

``alias_tokens`` replaces every ``αtokenα`` occurrence by a short
``αaliasα`` (one alias per occurrence) and emits the map rows
``(session_id, alias, token)``.  Aliases are derived from a hash of
(session, row, position), so a retried task writes the same aliases; at 72
bits, a billion of them in one session hold two equal ones with a chance of
1 in 9,000.
``expand_aliases`` restores ``αtokenα`` by an equi-join on
``(session_id, alias)`` — only alias segments are joined, so a row's plain
text never meets a NULL join key, and a hot session does not skew the join
(the key includes the alias).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.fixed import ALIAS_LEN, TOKEN_DELIM
from veilspark.functions.tokens import b64


def alias_for(session: Column, row_key: Column, pos: Column, length: int = ALIAS_LEN) -> Column:
    """URL-safe base64 of SHA-256(session#row#pos), first ``length`` characters."""
    h = b64(F.unhex(F.sha2(F.concat_ws("#", session.cast("string"), row_key.cast("string"),
                                       pos.cast("string")), 256)))
    return F.substring(F.translate(h, "+/", "-_"), 1, int(length))


def alias_tokens(df: DataFrame, text_col: str, session_col: str, row_key: str,
                 delim: str = TOKEN_DELIM, length: int = ALIAS_LEN) -> tuple[DataFrame, DataFrame]:
    """(text with aliases, map rows ``(session_id, alias, token)``)."""
    segs = F.split(F.col(text_col), delim, -1)
    s, r = F.col(session_col), F.col(row_key)

    def swap(seg, i):
        # an empty token is an escaped delimiter and stays
        return F.when((i % 2 == 1) & (seg == ""), F.lit(delim + delim)) \
            .when(i % 2 == 1, F.concat(F.lit(delim), alias_for(s, r, i, length), F.lit(delim))) \
            .otherwise(seg)

    malformed = F.size(segs) % 2 == 0
    text = df.withColumn(text_col, F.when(malformed, F.lit(None).cast("string"))
                         .otherwise(F.array_join(F.transform(segs, swap), "")))
    m = df.where(~malformed).select(s.alias("session_id"), r.alias("_row"),
                                    F.posexplode(segs).alias("pos", "token")).where((F.col("pos") % 2 == 1) & (F.col("token") != ""))
    amap = m.select("session_id", F.concat(F.lit(delim), alias_for(F.col("session_id"), F.col("_row"),
                                                                   F.col("pos"), length), F.lit(delim))
                    .alias("alias"), "token")
    return text, amap


def set_aliases(token_map: DataFrame, new_rows: DataFrame, order_col: str) -> DataFrame:
    """P9 set: upsert — the last write (by ``order_col``) per (session_id, alias) wins."""
    w = Window.partitionBy("session_id", "alias").orderBy(F.col(order_col).desc())
    u = token_map.unionByName(new_rows, allowMissingColumns=True)
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def expand_aliases(df: DataFrame, token_map: DataFrame, text_col: str, session_col: str,
                   row_key: str, delim: str = TOKEN_DELIM, missing_col: str = "missing_alias") -> DataFrame:
    """Replace ``αaliasα`` by ``αtokenα``; unknown alias → NULL text + flag.

    An alias that the map gives two tokens (a collision, or a double write) is
    treated as unknown: its text is withheld and flagged, never guessed.

    Returns ``(row_key, session_col, text_col, missing_col)``.  Rows without
    the delimiter pass straight through; only rows holding aliases are
    exploded, joined and regrouped (the only shuffle).
    """
    has = F.coalesce(F.instr(F.col(text_col), delim) > 0, F.lit(False))
    untouched = df.where(~has).select(F.col(row_key), F.col(session_col), F.col(text_col),
                                      F.lit(False).alias(missing_col))
    e = df.where(has).select(F.col(row_key), F.col(session_col),
                             F.posexplode(F.split(F.col(text_col), delim, -1)).alias("pos", "seg"))
    escaped = (F.col("pos") % 2 == 1) & (F.col("seg") == "")
    plain = e.where((F.col("pos") % 2 == 0) | escaped).select(
        row_key, session_col, "pos", F.when(escaped, F.lit(delim + delim)).otherwise(F.col("seg")).alias("out"),
        F.lit(False).alias("miss"))
    al = e.where((F.col("pos") % 2 == 1) & (F.col("seg") != "")).withColumn("alias", F.concat(F.lit(delim), F.col("seg"), F.lit(delim)))
    tm = token_map.groupBy(F.col("session_id").alias(session_col), "alias").agg(
        F.when(F.min("token") == F.max("token"), F.min("token")).alias("token"))
    looked = al.join(tm, [session_col, "alias"], "left").select(
        row_key, session_col, "pos", F.concat(F.lit(delim), F.col("token"), F.lit(delim)).alias("out"),
        F.col("token").isNull().alias("miss"))
    parts = plain.unionByName(looked)
    g = parts.groupBy(row_key, session_col).agg(
        F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("_p"),
        F.max("pos").alias("_maxpos"), F.max(F.col("miss").cast("int")).alias("_miss"))
    bad = (g["_miss"] == 1) | (g["_maxpos"] % 2 == 1)
    expanded = g.select(row_key, session_col,
                        F.when(bad, F.lit(None).cast("string"))
                        .otherwise(F.array_join(F.transform("_p", lambda x: x["out"]), "")).alias(text_col),
                        bad.alias(missing_col))
    return untouched.unionByName(expanded)


def touch_aliases(token_map: DataFrame, df: DataFrame, text_col: str, session_col: str, used_at: Column,
                  delim: str = TOKEN_DELIM) -> DataFrame:
    """The map with ``last_used`` moved to ``used_at`` for every alias that ``df`` refers to."""
    used = df.select(F.col(session_col).alias("session_id"), F.posexplode(F.split(F.col(text_col), delim, -1))
                     .alias("pos", "seg")).where((F.col("pos") % 2 == 1) & (F.col("seg") != "")) \
        .select("session_id", F.concat(F.lit(delim), F.col("seg"), F.lit(delim)).alias("alias"),
                F.lit(True).alias("_used")).distinct()
    return token_map.join(used, ["session_id", "alias"], "left").withColumn(
        "last_used", F.when(F.col("_used"), F.greatest("last_used", used_at)).otherwise(F.col("last_used"))).drop("_used")


def delete_counts(token_map: DataFrame, sessions: DataFrame, session_col: str = "session_id") -> DataFrame:
    """F9 result: (session_id, deleted) per requested session; 0 where the map holds none."""
    s = sessions.select(F.col(session_col).alias("session_id")).distinct()
    n = token_map.groupBy("session_id").agg(F.count("*").alias("deleted"))
    return s.join(n, "session_id", "left").select("session_id", F.coalesce("deleted", F.lit(0)).alias("deleted"))


def delete_sessions(token_map: DataFrame, sessions: DataFrame, session_col: str = "session_id") -> DataFrame:
    """drop every alias of the given sessions (anti join)."""
    s = sessions.select(F.col(session_col).alias("session_id")).distinct()
    return token_map.join(s, "session_id", "left_anti")
