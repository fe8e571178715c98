"""Merge spans, resolve entities, replace by tokens, and restore.

Everything is a per-row projection over array columns (higher-order
functions), so anonymize and deanonymize are narrow: no shuffle; only CONTAINMENT
resolution calls Python, on a row's entity strings.
Intermediate arrays are materialised as their own columns so that Catalyst
evaluates each expensive expression once (it will not inline an expensive
alias that is used several times).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.fixed import DEFAULT_THRESHOLD, EQUALITY, TOKEN_DELIM
from veilspark.functions.spans import (drop_cross_type_overlaps, merge_spans, regex_matches,
                                       resolve_entities, surface)
from veilspark.functions.tokens import decrypt_token, make_token, wrap
from veilspark.operators.detect import no_pattern, pattern_spans


def rebuild_text(text: Column, items: Column, escape: str | None = None) -> Column:
    """Replace each (sorted, disjoint) ``items[i].start..end`` by ``items[i].repl``.

    One left-to-right fold; ``items`` is consumed once.  ``escape``: a
    delimiter that is doubled (an empty token) where the kept text holds it.
    """
    def kept(piece):
        return F.replace(piece, F.lit(escape), F.lit(escape * 2)) if escape else piece

    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = kept(F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]))
        return F.struct(x["end"].alias("pos"), F.array_append(F.array_append(acc["out"], gap), x["repl"])
                        .alias("out"))

    folded = F.aggregate(items, init, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""),
        kept(F.substring(text, acc["pos"] + 1, F.greatest(F.length(text) - acc["pos"], F.lit(0))))))
    return folded


def anonymize_column(df: DataFrame, col: str, secret: str | Column, *, mode: str = "aes",
                     resolution: str = EQUALITY, types=None, threshold: float = DEFAULT_THRESHOLD,
                     salt: str = "", scope: str | None = None,
                     spans_col: str | None = None, out_col: str | None = None,
                     delim: str = TOKEN_DELIM) -> DataFrame:
    """Replace PII in ``col`` by ``delim+token+delim``.

    ``mode``: ``aes`` (reversible), ``sha`` (one-way) or ``label`` (the type's
    name; nothing of the value is kept, and entities of a type look alike).

    Spans come from ``spans_col`` when given (e.g. from :func:`detect_pii`
    with a dictionary), else from the pattern detectors.  Same entity within
    the row (under ``resolution``) shares one token.  ``scope`` names a column
    mixed into the IV so that one value gets different tokens in different
    rows/sessions.  Each stage consumes the previous array exactly once.
    """
    out_col = out_col or col
    t = F.col(col)
    raw = F.col(spans_col) if spans_col else pattern_spans(t, types, threshold)
    merged = merge_spans(drop_cross_type_overlaps(raw))
    scope_c = F.col(scope) if scope else None

    def token(s, rep):
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), wrap(
            s["pii_type"] if mode == "label" else make_token(rep, secret, mode, salt, scope_c), delim).alias("repl"))

    def replaced(tokens):
        whole = F.when(t.isNull(), t)
        if not spans_col:                                            # most texts hold nothing to look for: no fold over no spans
            whole = whole.when(no_pattern(t, types), F.replace(t, F.lit(delim), F.lit(delim * 2)))
        return whole.otherwise(rebuild_text(t, tokens, delim))

    if resolution.upper() == EQUALITY or mode == "label":            # a value stands for itself: one JVM projection
        return df.withColumn(out_col, replaced(F.transform(merged, lambda s: token(s, surface(t, s)))))
    # Spans and representatives as columns of their own, so that each is computed once.
    spans, reps = _free(df, "_spans"), _free(df, "_reps")
    out = df.withColumn(spans, merged)
    out = out.withColumn(reps, resolve_entities(F.transform(spans, lambda s: surface(t, s)), resolution))
    pairs = F.arrays_zip(F.col(spans).alias("s"), F.col(reps).alias("r"))
    return out.withColumn(out_col, replaced(F.transform(pairs, lambda p: token(p["s"], p["r"])))).drop(spans, reps)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def secret_of(table: DataFrame, column: str = "secret") -> Column:
    """The secret held by a one-row table, as a column: it is read when the job runs and no plan's text holds it.

    More rows than one are an error; no row makes every token NULL.
    """
    return table.select(column).scalar()


def _with_secret(df: DataFrame, secret):
    """(df, secret, helper column to drop): a secret column becomes a column of the rows, usable in their expressions."""
    if not isinstance(secret, Column):
        return df, secret, []
    name = _free(df, "_secret")
    return df.withColumn(name, secret), F.col(name), [name]


def anonymize(df: DataFrame, cols, secret: str | Column, **kw) -> DataFrame:
    """Anonymize several string columns (each column is its own entity scope).

    ``secret`` is a string or a column such as :func:`secret_of`.
    """
    df, secret, helper = _with_secret(df, secret)
    for c in ([cols] if isinstance(cols, str) else cols):
        df = anonymize_column(df, c, secret, **kw)
    return df.drop(*helper)


def deanonymize_text(text: Column, secret: str | Column, delim: str = TOKEN_DELIM) -> Column:
    """Restore a tokenized text; NULL when malformed (odd delimiters or a bad token)."""
    segs = F.split(text, delim, -1)
    restored = F.transform(segs, lambda s, i: F.when(i % 2 == 0, s).when(s == "", F.lit(delim))
                           .otherwise(decrypt_token(s, secret)))
    ok = (F.size(segs) % 2 == 1) & F.forall(restored, lambda x: x.isNotNull())
    return F.when(F.instr(text, delim) == 0, text).when(ok, F.array_join(restored, ""))


# --- fixed values: shape of a well-formed token (base64 of iv + >= 1 block) ---
TOKEN_BODY_RX = "[A-Za-z0-9+/]{43,}={0,2}"


def restore_tokens(text: Column, secret: str | Column, delim: str = TOKEN_DELIM) -> Column:
    """Lenient restore: only well-formed ``delim+base64+delim`` tokens that decrypt
    are replaced, and doubled delimiters unescaped; any other delimiter stays."""
    found = regex_matches(text, f"{delim}({TOKEN_BODY_RX})?{delim}")
    items = F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        F.when(m["value"] == delim * 2, F.lit(delim)).otherwise(F.coalesce(
            decrypt_token(F.substring(m["value"], 2, F.length(m["value"]) - 2), secret), m["value"])).alias("repl")))
    return F.when(text.isNull(), text).otherwise(rebuild_text(text, items))


def deanonymize(df: DataFrame, cols, secret: str | Column, *, on_error: str = "null",
                delim: str = TOKEN_DELIM, flag_col: str = "malformed",
                restore: str = "strict") -> DataFrame:
    """Restore tokens in ``cols``.

    restore: ``strict`` — every delimiter pair must hold a valid token (the
    reference rule); ``tokens`` — only well-formed tokens are restored, other
    delimiters stay (for text that legitimately contains the delimiter).
    on_error (strict): ``null`` — malformed text becomes NULL and ``flag_col``
    is set; ``raise`` — the job fails on the first malformed row.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    df, secret, helper = _with_secret(df, secret)
    if restore == "tokens":
        for c in cols:
            df = df.withColumn(c, restore_tokens(F.col(c), secret, delim))
        return df.withColumn(flag_col, F.lit(False)).drop(*helper)
    flags = []
    for c in cols:
        df = df.withColumn(f"__r_{c}", deanonymize_text(F.col(c), secret, delim))
        bad = F.col(c).isNotNull() & F.col(f"__r_{c}").isNull()
        r = F.col(f"__r_{c}")
        if on_error == "raise":
            r = F.when(bad, F.raise_error(F.lit(f"malformed tokenized text in {c}"))).otherwise(r)
        df = df.withColumn(f"__bad_{c}", bad).withColumn(c, r)
        flags.append(F.col(f"__bad_{c}"))
    flag = flags[0] if len(flags) == 1 else F.greatest(*flags)
    return df.withColumn(flag_col, flag).drop(*[f"__bad_{c}" for c in cols],
                                              *[f"__r_{c}" for c in cols], *helper)
