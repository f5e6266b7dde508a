"""Secret scans: base patterns, and a token-efficiency test that finds random strings.

Base spans are assignments (password = ...), access keys (AKIA...) and long hexadecimal
runs. The token-efficiency test looks at runs of 20 or more key characters that hold
letters and digits, or large and small letters: ordinary words and names take few tokens
of a tiktoken vocabulary, random strings many. A run of under RATIO characters a token
(under LETTERS_RATIO without a digit) is reported, unless it is a known digest (hexadecimal of a digest's length), an identifier (UUID,
or words and numbers joined by separators or capitals), or touches a base span. Where
the whole run is not reported, its parts are tested in the same way: a key in a path or
after a name is the neighbour of ordinary words, which would hide it in the average.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import place_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before this vocabulary's merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The base kinds in their listed order, then the token-efficiency test's.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RATIO = 1.9
#: For runs of letters alone, which hold at least this many large and small ones.
LETTERS_RATIO, LETTERS_MIXED = 1.7, 4
#: Pieces of a run, between its separators. A key can hold separators itself, so neighbouring pieces are tested together up
#: to JOINED characters, where separators are at most a SPARSE-th of them and the first and last piece are no words or numbers.
_PIECE = re.compile(r"[A-Za-z0-9]+")
JOINED = 96
SPARSE = 8
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_UUID_INSIDE = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])")
_PIECES = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]+|[_/+=-]+")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a vocabulary file (one line a token: base64 and rank)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _identifier(run: str) -> bool:
    """Whether most of the run is words, whole numbers and separators."""
    if _UUID.fullmatch(run):
        return True
    known = sum(len(m) for m in _PIECES.findall(run))
    words = sum(len(m) for m in _PIECES.findall(run) if len(m) >= 3 and m.isalpha())
    return known >= 0.9 * len(run) and words >= 0.5 * len(run)


def _random(run: str, vocabulary: str) -> bool:
    bare = run.strip("=")
    ratio = RATIO if any(c.isdigit() for c in bare) else LETTERS_RATIO
    large, small = sum(c.isupper() for c in bare), sum(c.islower() for c in bare)
    if len(bare) < 20 or large + small < 4 or ratio == LETTERS_RATIO and min(large, small) < LETTERS_MIXED:
        return False
    if _DIGEST.fullmatch(bare) and len(bare) in _DIGEST_LENGTHS or _identifier(bare):
        return False
    return len(bare) < ratio * len(encoding(vocabulary).encode_ordinary(bare))


def _random_parts(text: str, start: int, end: int, apart: list[tuple[int, int]], vocabulary: str) -> list[tuple[int, int]]:
    """The parts of the run text[start:end] that are random by themselves; none touches a span of apart, a UUID or a digest."""
    apart = _Touching(sorted(apart + [m.span() for m in _UUID_INSIDE.finditer(text, start, end)]))
    pieces = []  # start, end, may begin or end a part; None: no part goes across
    for m in _PIECE.finditer(text, start, end):
        if apart.of(*m.span()) or _DIGEST.fullmatch(m[0]) and len(m[0]) in _DIGEST_LENGTHS:
            pieces.append(None)
        else:
            pieces.append((m.start(), m.end(), not m[0].isdigit() and not _identifier(m[0])))
    found: list[tuple[int, int]] = []
    for i, first in enumerate(pieces):
        if first is None or not first[2]:
            continue
        held = 0
        for j in range(i, len(pieces)):  # JOINED characters at most, wherever the run ends
            last = pieces[j]
            if last is None or last is not first and last[1] - first[0] > JOINED:
                break
            held += last[1] - last[0]
            size = last[1] - first[0]
            if last[2] and size >= 20 and SPARSE * (size - held) <= size and _random(text[first[0] : last[1]], vocabulary):
                if found and first[0] < found[-1][1]:
                    found[-1] = (found[-1][0], max(found[-1][1], last[1]))
                else:
                    found.append((first[0], last[1]))
    return found


class _Touching:
    """The spans that touch each of a row of ascending spans, in one pass over both."""

    def __init__(self, spans: list[tuple[int, int]]):
        self._spans, self._next, self._now = spans, 0, []

    def of(self, start: int, end: int) -> list[tuple[int, int]]:
        while self._next < len(self._spans) and self._spans[self._next][0] < end:
            self._now.append(self._spans[self._next])
            self._next += 1
        self._now = [s for s in self._now if s[1] > start]
        return self._now[:]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(found)


def secret_spans(text: str, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """Base spans and the token-efficiency test's, in order."""
    base = base_spans(text)
    more = []
    around = _Touching([(s, e) for s, _, e in base])
    for m in RUN.finditer(text):
        touched = around.of(*m.span())
        if not touched and _random(m[0], vocabulary):
            more.append((m.start(), 3, m.end()))
        else:
            more += [(s, 3, e) for s, e in _random_parts(text, *m.span(), touched, vocabulary)]
    return sorted(base + more)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, spans) for every row of docs: all spans in code points, end exclusive; null and empty texts have none.

    Repeated rows repeat, an empty table gives none, and other columns are ignored. A very
    long text is read whole, in time in proportion to its length and its number of spans.
    The vocabulary is a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in secret_spans(t or "", vocabulary)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND)


def redact(docs: DataFrame, vocabulary: str = VOCABULARY, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one), with all columns; null texts stay null."""
    place = place_of(docs, "text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, _, end in secret_spans(text, vocabulary):
            if end <= at:
                continue
            out += [] if start < at else [text[at:start], mark]
            at = end
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([clean(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), text)

    return docs.mapInArrow(run, docs.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the base spans' SHA-256 and all spans as text, from scan()'s result."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
