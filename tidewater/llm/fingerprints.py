"""One-permutation MinHash fingerprints: one hash per shingle, bins, optimal densification, packed low bits.

A text's distinct 5-word shingles are hashed once; the top bits name one of BINS bins,
which keeps its least hash. An empty bin copies the first occupied bin of its own
random probe order (optimal densification: every occupied bin is equally likely, and
independently for each empty bin). Only the low BITS bits of each bin are kept, hashed
with the bin's own constant, so that texts of few shingles, whose bins share few minima,
agree by chance in each bin for itself and not in all bins at once; of two
fingerprints with agreement m the likeness is (m - 2**-BITS) / (1 - 2**-BITS), not below 0,
since that many bins agree by chance.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import words

SHINGLE = 5
BINS, BITS = 512, 4
_PROBES = 16
#: Rows that are drawn for each range of the table.
_DRAWN = 5

_rng = np.random.Generator(np.random.PCG64(512))
_ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1).astype(np.int64)  # row: a bin's probe order
_RANK = np.argsort(_ORDER, axis=1).astype(np.int32)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIN_VALUES = _rng.integers(0, 1 << 63, BINS, dtype=np.uint64)


def bins_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Densified bins (texts x BINS) of the shingle hashes that at delimits; texts without shingles stay empty."""
    n = len(at) - 1
    table = np.full(n * BINS, _EMPTY, np.uint64)
    text = np.repeat(np.arange(n), np.diff(at))
    place = text * BINS + (hashes >> np.uint64(64 - 9)).astype(np.int64)
    np.minimum.at(table, place, hashes & np.uint64((1 << 55) - 1))
    table = table.reshape(n, BINS)
    full = table != _EMPTY
    rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    if not len(rows):
        return table
    part, was = table[rows], full[rows]
    left = ~was
    for t in range(_PROBES):
        take = left & was[:, _ORDER[:, t]]
        part = np.where(take, part[:, _ORDER[:, t]], part)
        left &= ~take
    for r in np.flatnonzero(left.any(axis=1)):
        holes, known = np.flatnonzero(left[r]), np.flatnonzero(was[r])
        best = known[_RANK[np.ix_(holes, known)].argmin(axis=1)]
        part[r, holes] = part[r, best]
    table[rows] = part
    return table


def pack(table: np.ndarray) -> list[str]:
    """Hexadecimal fingerprints; an empty string for a text without shingles."""
    low = (words.mix(table ^ _BIN_VALUES) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    packed = (low[:, 0::2] << BITS) | low[:, 1::2]
    return ["" if empty else row.tobytes().hex() for row, empty in zip(packed, table[:, 0] == _EMPTY, strict=True)]


def fingerprints(texts: pa.Array) -> list[str]:
    out: list[str] = []
    for _, _, hashes, at in words.text_shingles(texts, SHINGLE):
        out += pack(bins_of(hashes, at))
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of fingerprints; 1 for two empty ones, 0 for one."""
    out = np.zeros(len(a))
    both = [i for i in range(len(a)) if a[i] and b[i]]
    out[[i for i in range(len(a)) if not a[i] and not b[i]]] = 1.0
    if both:
        x, y = (np.frombuffer(bytes.fromhex("".join(s[i] for i in both)), np.uint8).reshape(len(both), -1) for s in (a, b))
        same = ((x >> BITS) == (y >> BITS)).sum(axis=1) + ((x & 15) == (y & 15)).sum(axis=1)
        chance = 2.0**-BITS
        out[both] = np.maximum(0.0, (same / BINS - chance) / (1 - chance))
    return out


def fingerprint_column(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PART = 4 << 20


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the next one of its range; rows come range by range, in order, and a range ends with its guest."""
    pending: list[tuple[int, str, str]] = []
    total = 0
    last = None
    for batch in batches:
        for place, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if last is not None and last[0] == place:
                pending.append((last[1], last[2], text))
                total += len(last[2]) + len(text)
            last = None if guest else (place, doc_id, text)
            if total > _PART:
                yield _compared(pending)
                pending, total = [], 0
    if pending:
        yield _compared(pending)


def _compared(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    ids, own, following = (list(x) for x in zip(*rows, strict=True))
    edited = [_edit(a, b) for a, b in zip(own, following, strict=True)]
    a, e, b = (fingerprints(pa.array(x, pa.large_string())) for x in (own, edited, following))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(a), pa.array(e),
            pa.array(likeness(a, e)), pa.array(likeness(a, b)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _count_not_above(cuts: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the ascending cuts are at most (key, tie), by a coarse and a fine step of about sqrt(len(cuts)) each."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    parts = [[{"k": k, "h": h} for k, h in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    one = "struct<k:bigint,h:bigint>"
    literal = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)
    above = lambda c: (c["k"] < key) | ((c["k"] == key) & (c["h"] <= tie))
    part = F.size(F.filter(literal([b[0] for b in parts], f"array<{one}>"), above))
    inside = F.element_at(literal(parts, f"array<array<{one}>>"), F.greatest(part, F.lit(1)))
    return F.greatest(part - 1, F.lit(0)) * step + F.size(F.filter(inside, above))


def _cuts(keys: DataFrame, n: int, ranges: int) -> list[tuple[int, int]]:
    """Ascending (k, h) that part n rows into about so many ranges, from a draw of some rows for each; they decide where rows lie, not what comes out."""
    if ranges < 2:
        return []
    drawn = sorted(keys.sample(min(1.0, _DRAWN * ranges / n), 17).select("k", "h").toPandas().itertuples(index=False, name=None))
    return sorted({(int(k), int(h)) for k, h in drawn[:: max(1, len(drawn) // ranges)][1:]})


def edited_pairs(docs: DataFrame, rows_per_range: int = 2000, max_ranges: int = 200_000) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and their likeness.

    The next document is the one that follows in descending doc_id (null ids last, ties by
    the text's hash); after the last comes the first. The table is cut into ranges of
    doc_id and hash at drawn rows, so many rows of one doc_id take several ranges too
    (max_ranges cuts at most are on the driver; beyond that ranges grow, and as a task reads
    its ranges row by row, only their time does). Each range gets as a guest a copy of the
    first row of the next non-empty range, so every row meets its next row in one shuffle of
    the texts. Null texts count as empty; repeated rows follow each other; an empty table
    gives no rows; in a table of one row the next document is the row itself; other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key, tie = F.coalesce(F.col("doc_id"), F.lit(-(2**63))), F.xxhash64("text")
    n = docs.count()
    cuts = _cuts(rows.select(key.alias("k"), tie.alias("h")), n, max(1, min(max_ranges, n // rows_per_range)))
    # Ranges are numbered in descending doc_id, the order in which documents follow each other.
    placed = rows.withColumn("place", (F.lit(len(cuts)) - _count_not_above(cuts, key, tie)).cast("int"))

    heads = placed.groupBy("place").agg(F.max(F.struct(key.alias("k"), tie.alias("h"))).alias("head"))
    order = Window.orderBy("place")
    around = heads.select("place", "head", F.lag("place").over(order).alias("before"), F.max("place").over(Window.partitionBy(F.lit(0))).alias("end"))
    guests = around.select(F.coalesce("before", "end").alias("to"), F.col("head.k").alias("k"), F.col("head.h").alias("h"))
    guests = placed.select("text", "doc_id", key.alias("k"), tie.alias("h")).join(F.broadcast(guests), ["k", "h"])  # a row for each range
    guests = guests.dropDuplicates(["to"]).select(F.col("to").alias("place"), F.lit(True).alias("guest"), "doc_id", "text")
    laid = placed.select("place", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(cuts), n // (8 * rows_per_range)))
    laid = laid.repartitionById(width, F.pmod("place", F.lit(width))).sortWithinPartitions("place", "guest", F.col("doc_id").desc_nulls_last(), tie.desc())
    return laid.mapInArrow(_pairs, _RESULT)
