"""Pattern detectors for PII, as Column expressions.

A detector finds *candidates* with a regex (no boundary assertion, so Java
regex and RE2 agree), then keeps those passing a validator, and scores them.
Card, phone and date candidates must not touch a further digit, so that a part
of a longer number is never taken for a whole one.  Weak detectors get a low base
score that a context word in the preceding characters raises.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.spans import context_before, regex_matches

# --- fixed values: detector patterns, scores and context words --------------
EMAIL_RX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
EMAIL_OK = r"\.[A-Za-z]{2,}$"
IP_RX = r"[0-9]+(\.[0-9]+){3,}"
IP_OK = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
CARD_RX = r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,}"
CARD_OK = r"^[0-9]{13,19}$"
PHONE_RX = r"(\+1[ .-]?)?(\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"
SSN_RX = r"[0-9]+(-[0-9]+){2,}"
SSN_OK = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
SSN_BAD = r"^(000|666|9[0-9][0-9])-|-00-|-0000$"
DATE_RX = (r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?"
           r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
           r"|(January|February|March|April|May|June|July|August|September|October"
           r"|November|December) [0-9]{1,2}(, [0-9]{4})?")
DATE_SLASH_OK = r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/|^(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|1[0-2])/"
DATE_WORD_OK = r"^[A-Z][a-z]+ (0?[1-9]|[12][0-9]|3[01])(,|$)"
DATE_ISO_OK = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
PASSPORT_RX = r"[A-Z]?[0-9]{8,}"
PASSPORT_OK = r"^([0-9]{9}|[A-Z][0-9]{8})$"
BANK_RX = r"[0-9]{8,}"
BANK_OK = r"^[0-9]{8,17}$"
PASSPORT_CONTEXT = r"(?i)passport"
BANK_CONTEXT = r"(?i)(account|acct|bank|iban|routing)"
CONTEXT_WIDTH = 40

SCORES = {
    "EMAIL_ADDRESS": 1.0,
    "IP_ADDRESS": 0.95,
    "CREDIT_CARD": 1.0,
    "PHONE_NUMBER": 0.75,
    "US_SSN": 0.85,
    "DATE_TIME": 0.6,
    "US_PASSPORT": 0.05,
    "US_BANK_NUMBER": 0.05,
    "PERSON": 0.85,
    "LOCATION": 0.85,
    "NRP": 0.85,
}
CONTEXT_BOOST = 0.6


@dataclass(frozen=True)
class Detector:
    """One pattern detector: candidate regex, validator, base score, context."""

    pii_type: str
    pattern: str
    validator: Callable[[Column], Column] | None = None
    context: str | None = None
    score: float = field(default=0.5)
    needs: str | None = "digit"     # a guard: "digit", a literal character, or None
    whole: bool = False             # no digit directly before or after


def luhn_ok(value: Column) -> Column:
    """Luhn checksum over the digits of ``value`` (separators ignored)."""
    d = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(d)

    def add(acc, i):
        digit = F.substring(d, n - i + 1, 1).cast("int")
        dbl = F.when(i % 2 == 0, F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)) \
            .otherwise(digit)
        return acc + dbl

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.length(d).between(13, 19) & (total % 10 == 0)


def ip_ok(value: Column) -> Column:
    return value.rlike(IP_OK) & F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


def date_ok(value: Column) -> Column:
    return value.rlike(DATE_ISO_OK) | value.rlike(DATE_SLASH_OK) | value.rlike(DATE_WORD_OK)


def _rx_ok(rx: str) -> Callable[[Column], Column]:
    return lambda v: v.rlike(rx)


DETECTORS: dict[str, Detector] = {
    "EMAIL_ADDRESS": Detector("EMAIL_ADDRESS", EMAIL_RX, _rx_ok(EMAIL_OK), score=SCORES["EMAIL_ADDRESS"],
                              needs="@"),
    "IP_ADDRESS": Detector("IP_ADDRESS", IP_RX, ip_ok, score=SCORES["IP_ADDRESS"]),
    "CREDIT_CARD": Detector("CREDIT_CARD", CARD_RX, luhn_ok, score=SCORES["CREDIT_CARD"], whole=True),
    "PHONE_NUMBER": Detector("PHONE_NUMBER", PHONE_RX, None, score=SCORES["PHONE_NUMBER"], whole=True),
    "US_SSN": Detector("US_SSN", SSN_RX, lambda v: v.rlike(SSN_OK) & ~v.rlike(SSN_BAD),
                       score=SCORES["US_SSN"]),
    "DATE_TIME": Detector("DATE_TIME", DATE_RX, date_ok, score=SCORES["DATE_TIME"], whole=True),
    "US_PASSPORT": Detector("US_PASSPORT", PASSPORT_RX, _rx_ok(PASSPORT_OK), PASSPORT_CONTEXT,
                            score=SCORES["US_PASSPORT"]),
    "US_BANK_NUMBER": Detector("US_BANK_NUMBER", BANK_RX, _rx_ok(BANK_OK), BANK_CONTEXT,
                               score=SCORES["US_BANK_NUMBER"]),
}
PATTERN_TYPES = tuple(DETECTORS)
GAZETTEER_TYPES = ("PERSON", "LOCATION", "NRP")


def detector_spans(text: Column, det: Detector) -> Column:
    """Validated, scored spans of one detector: ``array<span>``."""
    cands = regex_matches(text, det.pattern)
    if det.validator is not None:
        cands = F.filter(cands, lambda m: det.validator(m["value"]))
    if det.whole:
        cands = F.filter(cands, lambda m: ~((m["start"] > 0) & F.substring(text, m["start"], 1).rlike("[0-9]"))
                         & ~F.substring(text, m["end"] + 1, 1).rlike("[0-9]"))

    def to_span(m):
        score = F.lit(det.score)
        if det.context:
            hit = context_before(text, m["start"], CONTEXT_WIDTH).rlike(det.context)
            score = F.when(hit, F.least(F.lit(1.0), F.lit(det.score + CONTEXT_BOOST))) \
                .otherwise(score)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"),
                        F.lit(det.pii_type).alias("pii_type"), score.cast("double").alias("score"))

    return F.transform(cands, to_span)


def normalize_types(types) -> tuple[str, ...]:
    """Upper-case and check a PII type list; empty means all types."""
    if not types:
        return tuple(PATTERN_TYPES) + GAZETTEER_TYPES
    out = []
    for t in types:
        u = str(t).upper()
        if u not in SCORES:
            raise ValueError(f"unknown PII type {t!r}")
        out.append(u)
    return tuple(dict.fromkeys(out))
