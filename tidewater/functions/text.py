"""Text normalisation, hashing and sentence splitting as Column functions. Null counts as empty where a hash or key is made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.patterns import ascii_edges

#: Words that a title key leaves out.
TITLE_STOPWORDS = ("the", "a", "an", "of", "for", "in", "at", "to", "and", "on", "by", "programme", "program", "scheme", "award", "awards")
#: The share of letters below which a text is debris.
LETTER_SHARE = 0.55


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean_text(text: Column) -> Column:
    """Without zero-width characters, non-breaking spaces as spaces, white space collapsed, trimmed."""
    shown = F.regexp_replace(_known(text), "[​-‍﻿]", "")
    return F.trim(F.regexp_replace(F.translate(shown, " ", " "), r"\s+", " "))


def singular(word: Column) -> Column:
    """A word without its plural ending; words of up to 3 letters and those in -ss, -us, -is, -as stay."""
    return (
        F.when((F.length(word) <= 3) | word.rlike("(?:ss|us|is|as)$"), word)
        .when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def title_tokens(title: Column) -> Column:
    """The words of a title's key, in order."""
    low = F.regexp_replace(F.lower(_known(title)), "[‘’“”]", "'")
    low = F.replace(low, F.lit("&amp;"), F.lit("&"))
    low = F.regexp_replace(low, ascii_edges(r"\b(?:19|20)\d{2}\s*[/-]\s*(?:19|20)?\d{2}\b"), " ")
    low = F.regexp_replace(low, ascii_edges(r"\b(?:19|20)\d{2}\b"), " ")
    low = F.regexp_replace(low, ascii_edges(r"'s\b"), "s")
    words = F.split(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 0) & ~w.isin(*TITLE_STOPWORDS))
    return F.transform(kept, singular)


def title_key(title: Column) -> Column:
    """The key under which titles of one award meet: no years, stop words, plurals or punctuation."""
    return F.array_join(title_tokens(title), " ")


def content_hash(text: Column) -> Column:
    """32 hexadecimal digits of SHA-256 over the text without differences of case and white space."""
    plain = F.trim(F.regexp_replace(F.lower(_known(text)), r"\s+", " "))
    return F.substring(F.sha2(plain.cast("binary"), 256), 1, 32)


def fingerprint(*parts: Column) -> Column:
    """32 hexadecimal digits of SHA-256 over the trimmed, lower-cased parts, joined by |."""
    joined = F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts])
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def job_hash(bank: Column, title: Column, url: Column) -> Column:
    """16 hexadecimal digits of SHA-256 over bank:title:url."""
    return F.substring(F.sha2(F.concat_ws(":", *[_known(c) for c in (bank, title, url)]).cast("binary"), 256), 1, 16)


def sentences(text: Column, least: int = 3, most: int = 599, colon: bool = True) -> Column:
    """Trimmed sentences of least to most characters; cut after .!?; (and :), at line ends and at bullets."""
    stops = ".!?;:" if colon else ".!?;"
    parts = F.split(_known(text), rf"(?<=[{stops}])\s+|\n+|\s[•·▪‣–—]\s")
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(plain, lambda s: F.length(s).between(least, most))


def letter_share(text: Column) -> Column:
    """The share of A-Z and a-z among all characters; 0 for an empty text."""
    known = _known(text)
    return F.length(F.regexp_replace(known, "[^A-Za-z]", "")) / F.greatest(F.length(known), F.lit(1))


def is_debris(text: Column) -> Column:
    """Whether a text is markup or data and not prose."""
    known = _known(text)
    keyed = known.rlike(r"(?i)\"(?:widget|url|externalSpa|props|__)\":")
    return (F.length(known) == 0) | known.rlike(r"^\s*[{\[]") | keyed | (letter_share(known) < LETTER_SHARE)


def derived_title(title: Column, heading: Column) -> Column:
    """The first part of a page title (before |, ·, — or –), up to 300 characters; the heading if there is none."""
    first = F.trim(F.element_at(F.split(_known(title), r"\s+[|·—–]\s+"), 1))
    return F.substring(F.when(F.length(first) > 0, first).otherwise(_known(heading)), 1, 300)


def clean_job_title(title: Column) -> Column:
    """A job title without a leading date and calls to action."""
    #: The calls to action.
    calls = r"(?i)\s*(?:More Details|Apply Now|Apply Here|View Details|View Job|Read More|View More)\s*"
    out = F.regexp_replace(F.regexp_replace(_known(title), r"^\d{1,2}/\d{1,2}/\d{2,4}\s+", ""), calls, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?i)\s*\(opens in new window\)\s*", ""), r"\s+", " "))


def phone_254(phone: Column) -> Column:
    """A Kenyan mobile number as 254 and nine digits; null if it is none."""
    digits = F.regexp_replace(_known(phone), r"\D", "")
    tail = F.regexp_extract(digits, r"^(?:254|0)?([17]\d{8})$", 1)
    return F.when(F.length(tail) == 9, F.concat(F.lit("254"), tail))


def snippet(html: Column, size: int = 1200) -> Column:
    """Prose from the middle of a page: tags gone, begun a third in if over 4,000 characters, at the next sentence; empty for debris."""
    plain = F.regexp_replace(_known(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    for pattern in (r"<[^>]+>", r"(?i)&[a-z#0-9]+;", r"\s+"):
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.trim(plain)
    start = F.when(F.length(plain) > 4000, F.floor(F.length(plain) / 3)).otherwise(F.lit(0))
    stop = F.call_function("locate", F.lit(". "), plain, (start + 1).cast("int"))
    begin = F.when((start > 0) & (stop > 0) & (stop - 1 < start + 600), stop + 1).otherwise(start)
    part = F.trim(F.substring(plain, (begin + 1).cast("int"), F.lit(size)))
    return F.when(is_debris(part), F.lit("")).otherwise(part)
