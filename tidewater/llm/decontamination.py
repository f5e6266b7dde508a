"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters, digits and characters beyond ASCII. Runs of
TILE tokens are seeds: tiles that cover COVERAGE of an item's n tokens hold at least
least_shared(n) positions of it whose seeds the document has too, whatever the order of
the passages. So a document and an item are a candidate pair if they share one of the
item's rarest seeds (all but least_shared(n) - 1 positions, the rare ones first), and
are tiled if they share least_shared(n) positions; no pair that tiling would find is
lost. For each such pair the longest common runs of unmarked tokens are marked again and
again, found by running Karp-Rabin at falling search lengths down to TILE tokens, so a
passage whose sentences were reordered is still covered. A document is contaminated
by an item if the tiles cover at least COVERAGE of the item's tokens. Equal texts are
judged once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import words
from tidewater.llm.storage import materialise

TILE, COVERAGE = 3, Fraction(3, 5)
#: The seeds' filter is a bit map of this fixed size; a larger benchmark lets more seeds through to the join, which decides.
FILTER_BITS = 24
#: Bytes of item texts, about, that go with a document's text at once; a document that may hold more is sent again for each further so many.
ITEM_BYTES = 8 << 20
#: Pairs of positions that are looked at together.
PAIRS = 1 << 20
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in order, and len + 1 indices of the texts' first ones."""
    data, offsets = words.utf8(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    return words.word_hashes(data, offsets, gaps=words.SYMBOLS)


def _windows(run: np.ndarray, powers: np.ndarray, length: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and rolling hashes of the windows of wholly unmarked tokens."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[length:] == taken[:-length])
    with np.errstate(over="ignore"):
        return at, (run[at + length] - run[at]) * powers[len(powers) - 1 - at]


def _beginnings(own: tuple[np.ndarray, np.ndarray, np.ndarray], at: tuple[np.ndarray, np.ndarray, np.ndarray], m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (item, text) positions where runs begin: windows of one hash behind different tokens, in parts of about PAIRS.

    own and at: positions, window hashes and the tokens before (below m, 0 and 1 for none) of
    the item's and the text's windows. Windows behind one token are inside a longer run, and
    are passed over without looking at each pair.
    """
    known, group = np.unique(own[1], return_inverse=True)
    code = group * m + own[2]
    order = np.argsort(code, kind="stable")
    code = code[order]
    place = np.minimum(np.searchsorted(known, at[1]), max(0, len(known) - 1))
    same = known[place] == at[1] if len(known) else np.zeros(len(at[1]), bool)
    text, base, before = at[0][same], place[same] * m, at[2][same]
    edges = [np.searchsorted(code, x, side) for x, side in ((base, "left"), (base + before, "left"), (base + before, "right"), (base + m - 1, "right"))]
    first, n = np.concatenate([edges[0], edges[2]]), np.concatenate([edges[1] - edges[0], edges[3] - edges[2]])
    text = np.concatenate([text, text])[n > 0]
    first, n = first[n > 0], n[n > 0]
    for a, b in words.spans(n, PAIRS):
        many = n[a:b]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield own[0][order[np.repeat(first[a:b], many) + within]], np.repeat(text[a:b], many)


def _lengths(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many unmarked tokens are equal from each pair of positions on."""
    k = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        x, y = p[live] + k[live], d[live] + k[live]
        inside = (x < len(item)) & (y < len(text))
        live, x, y = live[inside], x[inside], y[inside]
        live = live[free_item[x] & free_text[y] & (item[x] == text[y])]
        k[live] += 1
    return k


def tile(item: np.ndarray, text: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, text position, length) of two token sequences, longest first.

    Memory is in proportion to both lengths, also where one token repeats without end.
    """
    least = min(least, len(item))
    if not least or len(text) < least:
        return []
    n = max(len(item), len(text))
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _ROLL, np.uint64))])
        runs = [np.concatenate([[np.uint64(0)], np.cumsum(x * powers[: len(x)])]) for x in (item, text)]
    known, both = np.unique(np.concatenate([item, text]), return_inverse=True)
    m = len(known) + 2
    item, text = both[: len(item)] + 2, both[len(item) :] + 2
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []

    def before(tokens: np.ndarray, free: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
        return np.where((at > 0) & free[at - 1], tokens[at - 1], none)

    length = max(least, min(len(item), len(text)) // 2)
    while True:
        found = np.zeros((3, 0), np.int64)
        if length <= min(len(item), len(text)):
            own, own_hash = _windows(runs[0], powers, length, free_item)
            at, at_hash = _windows(runs[1], powers, length, free_text)
            for p, d in _beginnings((own, own_hash, before(item, free_item, own, 0)), (at, at_hash, before(text, free_text, at, 1)), m):
                k = _lengths(item, text, free_item, free_text, p, d)
                found = np.concatenate([found, np.stack([k, p, d])[:, k >= length]], axis=1)
        longest = int(found[0].max(initial=0))
        if longest > 2 * length:
            length = longest
            continue
        marked = False
        for k, p, d in found[:, np.lexsort((found[2], found[1], -found[0]))].T.tolist():
            if free_item[p] and free_text[d] and free_item[p : p + k].all() and free_text[d : d + k].all():
                free_item[p : p + k] = free_text[d : d + k] = False
                tiles.append((p, d, k))
                marked = True
        if marked:
            continue  # what marked tokens have cut off may still hold matches of this length
        if length == least:
            return tiles
        length = max(least, length // 2)


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many seeds' positions of an item of n tokens lie inside tiles that cover COVERAGE of it, at least.

    A tile of k >= TILE tokens holds k - TILE + 1 positions, so one for each TILE tokens or more.
    """
    tokens = -(-n * COVERAGE.numerator // COVERAGE.denominator)
    return np.maximum(1, -(-tokens // TILE))


_SEEDS = "item string, seed long, n int, least int"


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An item's distinct seeds with how many of its positions have them; an item below TILE tokens has itself as its only one."""
    for batch in batches:
        found, first = tokens(batch.column(1))
        hashes, at = words.shingle_hashes(found, first, TILE)
        for i in range(batch.num_rows):
            own, n = np.unique(hashes[at[i] : at[i + 1]].view(np.int64), return_counts=True)
            least = np.repeat(least_shared(first[i + 1] - first[i]), len(own))
            columns = [batch.column(0).take(pa.array(np.full(len(own), i))), pa.array(own), pa.array(n.astype(np.int32)), pa.array(least.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SEEDS.split(", ")])


def _probes(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return seed & mask, (seed >> np.uint64(bits)) & mask


_HITS = "doc_id long, digest binary, seeds array<long>"


def _hits(packed: np.ndarray, bits: int):
    """Documents with seeds that may be in the benchmark: doc_id, the text's MD5 and those seeds, ascending."""

    def held(at: np.ndarray) -> np.ndarray:
        return (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seeds = [], []
            data, offsets = words.utf8(pc.utf8_lower(batch.column(2).cast(pa.large_string()).fill_null("")))
            for a, b in words.spans(np.diff(offsets)):
                lo = offsets[a]
                found = words.word_hashes(data[lo : offsets[b]], offsets[a : b + 1] - lo, gaps=words.SYMBOLS)
                hashes, at = words.shingle_hashes(*found, TILE)
                x, y = _probes(hashes, bits)
                hit = np.flatnonzero(held(x) & held(y))
                edges = np.searchsorted(hit, at)
                for t in np.flatnonzero(np.diff(edges)):
                    rows.append(a + int(t))
                    seeds.append(np.unique(hashes[hit[edges[t] : edges[t + 1]]].view(np.int64)))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(seeds, pa.list_(pa.int64()))], names=["doc_id", "digest", "seeds"])

    return run


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (digest, item) that share enough of the item's positions."""
    for batch in batches:
        keep = []
        own, n, seeds = (batch.column(c) for c in ("own", "n", "seeds"))
        for i, least in enumerate(batch.column("least").to_pylist()):
            a, b, have = (x.slice(i, 1).flatten().to_numpy() for x in (own, n, seeds))
            keep.append(int(b[np.isin(a, have)].sum()) >= least)
        yield batch.select(["digest", "item"]).filter(pa.array(keep, pa.bool_()))


_FOUND = "digest binary, item string, n_tokens long, n_tiles long, coverage double"


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text against its items."""
    for batch in batches:
        out: list[tuple] = []
        digests = batch.column("digest").to_pylist()
        for i in range(batch.num_rows):
            text, _ = tokens(batch.column("text").slice(i, 1))
            listed = batch.column("items").slice(i, 1).flatten()
            own, start = tokens(listed.field("item_text"))
            for j, name in enumerate(listed.field("item").to_pylist()):
                item = own[start[j] : start[j + 1]]
                tiles = tile(item, text)
                covered = sum(k for _, _, k in tiles)
                if len(item) and covered * COVERAGE.denominator >= len(item) * COVERAGE.numerator:
                    out.append((digests[i], name, len(item), len(tiles), covered / len(item)))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])


def _prefix(seeds: DataFrame, met: DataFrame) -> DataFrame:
    """(item, seed): each item's seeds but for the least - 1 positions of those that are in the most texts.

    A document with least positions of an item has one of these, in whatever order the seeds are taken.
    """
    common = met.groupBy(F.col("seed").alias("s")).agg(F.count(F.lit(1)).alias("texts"))
    known = seeds.join(common, F.col("seed") == F.col("s"))  # seeds of no text pair with none; they are rarer than all that follow
    rare = Window.partitionBy("item").orderBy(F.col("texts").desc(), F.col("seed").desc())
    return known.withColumn("to_end", F.sum("n").over(rare.rowsBetween(Window.unboundedPreceding, 0))).where("to_end >= least").select("item", "seed")


def _found(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tiled pairs (digest of a text, item: MD5 of an item's text, ...), the documents with seeds (doc_id, digest), and the items (item_id, item)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.md5(text.cast("binary")).alias("item"), text.alias("item_text"))
    bodies = materialise(items.select("item", "item_text").where("item is not null").distinct(), "items")
    seeds = materialise(bodies.mapInArrow(_seed_rows, _SEEDS), "seeds")

    mask = (1 << filter_bits) - 1
    probes = F.array(F.col("seed").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("seed", filter_bits).bitwiseAND(F.lit(mask)))
    bit = seeds.select(F.explode(probes).alias("bit")).select(F.shiftright("bit", 3).alias("byte"), F.expr("shiftleft(1, cast(bit & 7 as int))").alias("flag"))
    bitmap = np.zeros(max(1, 1 << filter_bits >> 3), np.uint8)
    for byte, flags in bit.groupBy("byte").agg(F.bit_or("flag")).toLocalIterator():  # at most 2**(filter_bits - 3) rows
        bitmap[byte] = flags
    packed = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        return _hits(packed.value, filter_bits)(batches)

    hits = materialise(texts.mapInArrow(run, _HITS), "hits")
    once = materialise(hits.groupBy("digest").agg(F.first("seeds").alias("seeds")), "hit-texts")  # copies have the same seeds
    met = once.select("digest", F.explode("seeds").alias("seed"))
    pairs = met.join(_prefix(seeds, met), "seed").select("digest", "item").distinct()
    own = seeds.groupBy("item").agg(F.first("least").alias("least"), F.collect_list(F.struct("seed", "n")).alias("s")).select("item", "least", F.col("s.seed").alias("own"), F.col("s.n").alias("n"))
    near = pairs.join(own, "item").join(once, "digest").select("digest", "item", "least", "own", "n", "seeds")
    near = materialise(near.mapInArrow(_sharing, "digest binary, item string"), "near")

    size = bodies.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    part = F.pmod(F.xxhash64("item"), F.lit(size // ITEM_BYTES + 1)).alias("part")
    listed = near.join(bodies, "item").groupBy("digest", part).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    wanted = texts.select("digest", "text").join(near.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    found = listed.join(wanted, "digest").select("digest", "text", "items").mapInArrow(_tiled, _FOUND)
    return materialise(found, "contaminated"), hits.select("doc_id", "digest"), items.select("item_id", "item").distinct()


def contaminations(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_tiles, coverage): the documents that hold benchmark items, once per pair and row of docs.

    Null and empty texts match nothing, and null and empty items are in nothing. An item of
    fewer than TILE tokens can have no tile and matches only a document that consists of
    just these tokens. Rows with a null doc_id are judged too (and give a null doc_id), and
    so are items with a null item_id; repeated documents repeat, repeated items do not; an
    empty table gives none, other columns are ignored. A very long text is tiled whole. A
    text moves once with all items that it may hold (about ITEM_BYTES of them at most).
    """
    found, rows, items = _found(docs, benchmark, filter_bits)
    return rows.join(found, "digest").join(items, "item").select("doc_id", "item_id", "n_tokens", "n_tiles", "coverage")


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all columns.

    Each row is judged by its own text, so rows that share a doc_id may fare differently,
    and copies of a text never do. Rows with a null text stay.
    """
    found, _, _ = _found(docs, benchmark)
    held = found.select(F.col("digest").alias("found_digest")).distinct()
    own = F.unhex(F.md5(docs["text"].cast("string").cast("binary")))
    return docs.join(held, own == held["found_digest"], "left_anti")
