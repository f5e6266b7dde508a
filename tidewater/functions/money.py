"""Amounts of money in text. Currencies are never converted and never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.patterns import ascii_edges

#: Currency symbols and codes, periods, and how amounts are written.
SYMBOLS = {"£": "GBP", "$": "USD", "€": "EUR", "¥": "JPY", "₹": "INR", "KSh": "KES", "R": "ZAR"}
_CODES = "GBP|USD|EUR|CAD|AUD|NZD|JPY|CNY|KRW|SGD|SEK|NOK|DKK|CHF|KES|ZAR|NGN|INR"
_PERIOD = ascii_edges(r"(?i)\b(per\s+(?:year|annum|month|week|semester|term)|p\.?a\.?|annually|monthly|yearly|each\s+year|per\s+academic\s+year)\b")
_AMOUNT = ascii_edges(
    rf"(?i)(?:(£|\$|€|¥|₹|KSh|R)\s?|\b({_CODES})\s+)?(\d{{1,3}}(?:[,\s]\d{{3}})+(?:\.\d{{1,2}})?|\d{{4,}}(?:\.\d{{1,2}})?|\d+(?:\.\d{{1,2}})?\s*(?:k|thousand|million|m)\b)"
)
#: How a share of the fees and a number of awards are written.
_SHARE = r"(\d{1,3})\s?%"
_AWARDS = ascii_edges(r"(?i)\b(?:up\s+to\s+)?(\d{1,4})\s+(?:scholarships?|awards?|studentships?|places?|fellowships?)\s+(?:are\s+|will\s+be\s+|is\s+)?(?:available|offered|awarded|on\s+offer)")


def parse_money(text: Column) -> Column:
    """The first amount as struct(amount, currency, period, original_text, confidence, certainty), or null.

    k, thousand, m and million multiply. A code near the amount gives the currency only
    if the amount has no sign of its own; a bare four-digit number is an amount.
    """
    known = F.coalesce(text, F.lit(""))
    g = lambda i: F.regexp_extract(known, _AMOUNT, i)
    symbol, code, raw = g(1), g(2), g(3)
    low = F.lower(raw)
    plain = F.regexp_replace(F.regexp_replace(low, r"[,\s]", ""), "(?:k|thousand|million|m)$", "").try_cast("double")
    times = F.when(low.rlike("(?:k|thousand)$"), 1000.0).when(low.rlike("(?:million|m)$"), 1_000_000.0).otherwise(1.0)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair]), symbol)
    nearby = F.nullif(F.regexp_extract(known, ascii_edges(rf"\b({_CODES})\b"), 1), F.lit(""))
    currency = F.when(code != "", F.upper(code)).when(symbol != "", named).otherwise(nearby)
    period = F.nullif(F.lower(F.regexp_extract(known, _PERIOD, 1)), F.lit(""))
    sure = currency.isNotNull()
    found = F.struct(
        (plain * times).alias("amount"), currency.alias("currency"), period.alias("period"), F.trim(F.substring(known, 1, 300)).alias("original_text"),
        F.when(sure, 0.85).otherwise(0.5).alias("confidence"), F.when(sure, "CONFIRMED").otherwise("PROBABLE").alias("certainty"),
    )
    return F.when((raw != "") & plain.isNotNull(), found)


def money_near(sentences: Column, keyword: str) -> Column:
    """The amount of the first sentence with the keyword that has one, as parse_money gives it."""
    amounts = F.transform(F.filter(sentences, lambda s: s.rlike(keyword)), parse_money)
    return F.try_element_at(F.filter(amounts, lambda m: m.isNotNull()), F.lit(1))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def authority(rank: Column) -> Column:
    """A source's weight from its rank: 1, then 0.13 less for each further rank, not below 0.2."""
    return F.greatest(F.lit(0.2), 1 - (rank - 1) * F.lit(0.13))


def tuition_percentage(sentences: Column, keyword: str) -> Column:
    """The first percentage of 1 to 100 in a sentence with the keyword."""
    shares = F.transform(F.filter(sentences, lambda s: s.rlike(keyword)), lambda s: F.regexp_extract(s, _SHARE, 1).try_cast("int"))
    return F.try_element_at(F.filter(shares, lambda p: p.between(1, 100)), F.lit(1))


def award_count(sentences: Column) -> Column:
    """How many awards a text offers."""
    numbers = F.transform(sentences, lambda s: F.regexp_extract(s, _AWARDS, 1).try_cast("int"))
    return F.try_element_at(F.filter(numbers, lambda n: n.isNotNull()), F.lit(1))
