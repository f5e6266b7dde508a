"""Vectorised word and shingle hashes over batches of UTF-8 texts.

Words are the maximal runs of bytes other than space and \\x09-\\x0D. A word's hash is
a polynomial over random byte values modulo 2**64, read off a running sum; a
shingle's hash is a polynomial over word hashes. Both pass a 64-bit finaliser.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
LONG_WORD = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that end a token of letters, digits and anything beyond ASCII.
SYMBOLS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED_VALUES = _BYTE_VALUES[_FOLD]

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + LONG_WORD + 16)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, _BASE, np.uint64))
            down = np.cumprod(np.full(size, _INVERSE, np.uint64))
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and len + 1 offsets. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def from_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def spans(lengths: np.ndarray, limit: int = SLICE):
    """Consecutive (first, end) ranges of items of about limit in total, at least one item each."""
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def word_bounds(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the words start and end; no word spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = gaps[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[1:] = True, space
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = True
    starts = np.flatnonzero(first[:-1] & ~space)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, space[1:]
    last[cuts - 1] = True
    return starts, np.flatnonzero(last & ~space) + 1


def _hash_slice(data, starts, ends, values):
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=run[1:])
        return (run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)


def hash_ranges(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hashes of the ascending byte ranges [start, end) of part; ranges of over LONG_WORD bytes by BLAKE2b."""
    values = _FOLDED_VALUES if fold else _BYTE_VALUES
    out = np.empty(len(starts), np.uint64)
    usual = ends - starts <= LONG_WORD
    for i in np.flatnonzero(~usual):
        word = part[starts[i] : ends[i]]
        word = _FOLD[word] if fold else word
        out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    at = np.flatnonzero(usual)
    while len(at):
        base = starts[at[0]]
        n = int(np.searchsorted(ends[at], base + SLICE, "right")) or 1
        now, at = at[:n], at[n:]
        out[now] = _hash_slice(part[base : ends[now[-1]]], starts[now] - base, ends[now] - base, values)
    return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (len + 1 indices)."""
    found, counts = [], []
    for a, b in spans(np.diff(offsets)):
        lo, hi = offsets[a], offsets[b]
        part, inner = data[lo:hi], offsets[a : b + 1] - lo
        starts, ends = word_bounds(part, inner, gaps)
        found.append(hash_ranges(part, starts, ends, fold))
        counts.append(np.diff(np.searchsorted(starts, inner)))
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    per_text = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return words, np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (its whole sequence if it has fewer; none without words).

    Returns the hashes in order of text and position, and len + 1 indices of the texts' first ones.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = np.empty(out_first[-1], np.uint64)
    text = np.repeat(np.arange(len(n)), counts)
    position = np.arange(len(out)) - out_first[text] + first[text]
    with np.errstate(over="ignore"):
        total = np.zeros(len(out), np.uint64)
        step = np.uint64(1)
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        short = n[text] < k
        for j in range(k):
            value = padded[position + j]
            if short.any():
                value = np.where(short & (j >= n[text]), np.uint64(0), value)
            total += value * step
            step = step * _STEP + np.uint64(2 * j)
        out[:] = total + np.where(short, n[text], k).astype(np.uint64)
    return mix(out), out_first


def text_shingles(texts: pa.Array, k: int, fold: bool = False):
    """(first text, end, hashes, len + 1 indices) for spans of texts of about SLICE bytes."""
    data, offsets = utf8(texts)
    for a, b in spans(np.diff(offsets)):
        lo = offsets[a]
        words, first = word_hashes(data[lo : offsets[b]], offsets[a : b + 1] - lo, fold)
        hashes, at = shingle_hashes(words, first, k)
        yield a, b, hashes, at
