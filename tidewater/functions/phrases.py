"""Vocabularies of phrases that are all looked up in one pass over a text.

The phrases of all vocabularies form a trie, which is written as one regular expression
that looks ahead from each word's start and branches once for each character, not once
for each phrase. It gives the longest phrase that begins there; the shorter ones that end
at a word inside it are known beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "[A-Za-z0-9_]"
_END = ""


def _trie(phrases: Iterable[str]) -> dict:
    root: dict = {}
    for phrase in phrases:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[_END] = {}
    return root


def _pattern(node: dict) -> str:
    """Longer ways before shorter ones."""
    ways = [(r"\s+" if c == " " else re.escape(c)) + _pattern(below) for c, below in sorted(node.items()) if c != _END]
    if not ways:
        return ""
    one = ways[0] if len(ways) == 1 and _END not in node else f"(?:{'|'.join(ways)})"
    return one + ("?" if _END in node else "")


class Vocabularies:
    """Named lists of phrases: words of ASCII letters and digits with single spaces, which match any white space.

    found() gives the phrases of a text and has() tells whether some phrase of a list is
    among them, whatever the case and as whole words only. A null text gives null, an
    empty one no phrase; a phrase that stands in several lists counts for each.
    """

    def __init__(self, **lists: Iterable[str]):
        self._lists = {name: {p.lower() for p in phrases} for name, phrases in lists.items()}
        every = sorted(set().union(*self._lists.values()))
        for p in every:
            if not re.fullmatch(r"[a-z0-9]+(?: [a-z0-9]+)*", p):
                raise ValueError(f"not a phrase of plain words: {p!r}")
        self.pattern = rf"(?i)(?<!{_W})(?=({_pattern(_trie(every))})(?!{_W}))" if every else r"(?!)()"
        # A list is met by its own phrases and by all that begin with one of them and a space.
        self._met = {name: [p for p in every if any(p == q or p.startswith(f"{q} ") for q in own)] for name, own in self._lists.items()}

    def found(self, text: Column) -> Column:
        """The distinct phrases of text: of those that begin at one word, the longest."""
        matches = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1))
        return F.array_distinct(F.transform(matches, lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")))

    def has(self, found: Column, name: str) -> Column:
        """Whether found() holds a phrase of the list."""
        return F.arrays_overlap(found, F.array(*map(F.lit, self._met[name])).cast("array<string>"))
