"""Token codecs as Column expressions.

``aes``  — reversible: base64(iv ‖ AES-256-CBC(PKCS(value))), key = SHA-256(secret).
           The IV is *derived* (never drawn at random) so that a token column is
           deterministic: Catalyst may evaluate an expression twice, and a retried
           task must write the same bytes.  A per-run ``salt`` keeps one PII value
           from mapping to one token across runs.
``sha``  — one-way mask: base64(SHA-256(secret ‖ '#' ‖ value)).

A secret is a string, which then stands in the plan's text, or a column, which
does not (see ``anonymize.secret_of``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.fixed import TOKEN_DELIM


def _column(secret: str | Column) -> Column:
    return secret if isinstance(secret, Column) else F.lit(secret)


def _key_bytes(secret: str | Column) -> Column:
    return F.unhex(F.sha2(_column(secret), 256))


def b64(binary: Column) -> Column:
    """Base64 without line breaks (Spark's encoder wraps at 76 characters)."""
    return F.translate(F.base64(binary), "\r\n", "")


def aes_token(value: Column, secret: str | Column, salt: str = "", scope: Column | None = None) -> Column:
    scope = scope if scope is not None else F.lit("")
    iv = F.unhex(F.substring(F.sha2(F.concat_ws("#", F.lit("iv"), _column(secret), F.lit(salt),
                                                scope.cast("string"), value), 256), 1, 32))
    return b64(F.aes_encrypt(value, _key_bytes(secret), F.lit("CBC"), F.lit("PKCS"), iv))


def sha_token(value: Column, secret: str | Column) -> Column:
    return b64(F.unhex(F.sha2(F.concat_ws("#", _column(secret), value), 256)))


def make_token(value: Column, secret: str | Column, mode: str = "aes", salt: str = "",
               scope: Column | None = None) -> Column:
    if mode == "aes":
        return aes_token(value, secret, salt, scope)
    if mode == "sha":
        return sha_token(value, secret)
    raise ValueError(f"unknown token mode {mode!r}")


def decrypt_token(token: Column, secret: str | Column) -> Column:
    """Inverse of :func:`aes_token`; NULL when the token is not valid."""
    raw = F.try_aes_decrypt(F.try_to_binary(token, F.lit("base64")), _key_bytes(secret),
                            F.lit("CBC"), F.lit("PKCS"))
    return raw.cast("string")


def wrap(token: Column, delim: str = TOKEN_DELIM) -> Column:
    return F.concat(F.lit(delim), token, F.lit(delim))
