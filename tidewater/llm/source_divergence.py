"""Source divergence audit: exact differences between the term shares of sources, by two-dimensional group-block tiling.

Terms are runs of letters A-Z, a-z and of anything beyond ASCII, A-Z lower-cased. A language
keeps the terms of at least min_docs of its documents. Group (language, source) gives kept term
t the share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N its count over the V kept terms;
all shares and sums are integers.

Two groups are compared over all kept terms. The vocabulary of a language is cut into chunks of
about CHUNK terms and its groups into blocks of about BLOCK sources. A group's counts in one chunk
are one packed row. Each packed row is replicated to the tiles (block, block) of its block, and a
task gets one tile over RANGE successive chunks: it holds two blocks' counts of one chunk as a
matrix, adds up the pair submatrix and goes on to the next chunk. Terms that no group of the tile
has add the same difference each and are only counted. A task's rows are thus bounded by
2 * BLOCK * RANGE packed rows whatever the size of a source, of the vocabulary or of a language.
Partial submatrices are summed by pair.

Odd cases: null text, lang and source count as ''; a group without kept terms has N = 0 and is
compared like the others; a language without kept terms (V = 0) has differences of 0; repeated
rows count as documents of their own; other columns are not read; no rows give none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.storage import materialise, place_of

MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Sources of a block, terms of a chunk, chunks of a task: about so many each.
BLOCK, CHUNK, RANGE = 32, 1024, 16
#: Parts of a language's terms, for joins by language; a language has as many chunks at least.
SALTS = 16
#: Entries that a task counts before it hands them on.
_HELD = 1 << 19
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in found.items():
            n = len(times) + 1  # the row without a term says that the group is there
            terms = pa.array([None, *times], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), terms, pa.array([0, *times.values()], pa.int64()), pa.array([0, *(docs[t] for t in times)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            own = Counter(_TERM.findall(text.lower()))  # bytes.lower() changes A-Z only
            times, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(times)
            times.update(own)
            docs.update(own.keys())
            held += len(times)
            if held > _HELD:
                yield from told()
                held = 0
    yield from told()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and one row without a term for each group."""
    places = [place_of(docs, c) for c in ("lang", "source", "text")]
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    rows = named.select(*(F.coalesce(F.col(f"c{i}").cast("string"), F.lit("")).alias(c) for i, c in zip(places, ("lang", "source", "text"), strict=True)))
    found = rows.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> str:
    """The share as SQL: the quotient's digits in three steps, so that longs do for counts up to 9 * 10**15."""
    rest, quotient = f"({count} + {PRIOR})", "0"
    for _ in range(3):
        quotient = f"({quotient} * 1000 + ({rest} * 1000) div ({total} + {PRIOR} * {terms}))"
        rest = f"(({rest} * 1000) % ({total} + {PRIOR} * {terms}))"
    return f"1 + {quotient}"


def shares(counts: np.ndarray, totals: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The same shares of a matrix of counts, a row for each group."""
    whole = np.maximum(totals + PRIOR * terms, 1)[:, None]
    rest, quotient = counts + PRIOR, np.zeros_like(counts)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + more
    return 1 + quotient


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """The pair submatrix of two blocks over this task's chunks; rows without places name the groups."""
    heads = rows[rows["chunk"] < 0].sort_values(["block", "seat"])
    blocks = sorted({int(rows["a"].iloc[0]), int(rows["b"].iloc[0])})
    own = [heads[heads["block"] == b] for b in blocks]
    left, right = own[0], own[-1]
    if not len(left) or not len(right):  # a block to which no source was dealt
        return pd.DataFrame(np.empty((0, 4), object), columns=["lang", "source", "item", "value"])
    at = {(b, s): i for part in own for i, (b, s) in enumerate(zip(part["block"], part["seat"], strict=True))}
    terms, width = int(heads["terms"].iloc[0]), int(heads["width"].iloc[0])

    def matrix(part: pd.DataFrame, vectors: pd.DataFrame, size: int) -> np.ndarray:
        counts = np.zeros((len(part), size), np.int64)
        for block, seat, places, values in zip(vectors["block"], vectors["seat"], vectors["places"], vectors["counts"], strict=True):
            counts[at[block, seat], places] = values
        return shares(counts, part["total"].to_numpy(np.int64), np.full(len(part), terms, np.int64))

    def differences(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.stack([np.abs(other - row).sum(axis=1) for row in one])

    sums, seen = np.zeros((len(left), len(right)), np.int64), 0
    for _, vectors in rows[rows["chunk"] >= 0].groupby("chunk"):
        size = 1 + max(int(p.max()) for p in vectors["places"])
        seen += size
        sums += differences(*(matrix(part, vectors[vectors["block"] == b], size) for part, b in ((left, blocks[0]), (right, blocks[-1]))))
    if width > seen:
        none = rows.iloc[:0]
        sums += (width - seen) * differences(matrix(left, none, 1), matrix(right, none, 1))
    i, j = np.indices(sums.shape).reshape(2, -1)
    one, other, value = left["source"].to_numpy()[i], right["source"].to_numpy()[j], sums.ravel()
    if len(blocks) == 1:
        one, other, value = one[i != j], other[i != j], value[i != j]
    else:
        one, other, value = np.concatenate([one, other]), np.concatenate([other, one]), np.concatenate([value, value])
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": one, "item": other, "value": value})


class Audit:
    """The tables of an audit: groups (lang, source, total, terms, lang_total) and kept counts; pairs() and terms() are its two reports."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK, chunk: int = CHUNK, span: int = RANGE):
        self.block, self.chunk, self.span = block, chunk, span
        counts = materialise(term_counts(docs), "term-counts")
        words = counts.where(F.col("term").isNotNull())
        kept = materialise(words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        # a language may hold most terms: they meet its size, and are numbered, in SALTS parts
        parts = F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("part")
        salted = kept.withColumn("part", F.expr(f"cast(pmod(xxhash64(term), {SALTS}) as int)")).join(langs.select("lang", "terms", parts), ["lang", "part"])
        own = F.expr(f"cast(pmod(xxhash64(term, 1), ceil(terms / {chunk * SALTS})) as int)")
        chunked = salted.withColumn("chunk", own * SALTS + F.col("part"))
        in_chunk = Window.partitionBy("lang", "part", "chunk").orderBy("term")
        numbered = chunked.select("lang", "term", "lang_n", "chunk", (F.row_number().over(in_chunk) - 1).alias("place"))
        self.counts = materialise(words.drop("docs").join(numbered, ["lang", "term"]), "kept-counts")
        widths = chunked.groupBy("lang", "part", F.floor(F.col("chunk") / span).alias("range")).agg(F.count(F.lit(1)).alias("width")).groupBy("lang", "range").agg(F.sum("width").alias("width"))
        self.widths = widths
        groups = counts.where(F.col("term").isNull()).select("lang", "source")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sized = groups.join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")), "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        sized = sized.na.fill(0, ["terms", "lang_total", "total"]).withColumn("blocks", F.ceil(F.col("groups") / block)).withColumn("block", F.expr("cast(pmod(xxhash64(source), blocks) as int)"))
        seat = Window.partitionBy("lang", "block").orderBy("source")
        self.groups = materialise(sized.withColumn("seat", F.row_number().over(seat) - 1), "groups")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): the summed differences of each group and each other group of its language."""
        place = self.groups.select("lang", "source", "block", "seat", "blocks")
        packed = self.counts.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("packed"))  # one chunk's terms at most
        vectors = packed.join(place, ["lang", "source"]).select(
            "lang", F.floor(F.col("chunk") / self.span).alias("range"), "chunk", F.lit(None).cast("string").alias("source"), "block", "seat", "blocks",
            F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("terms"), F.lit(None).cast("long").alias("width"), F.col("packed.place").alias("places"), F.col("packed.n").alias("counts"),
        )
        ranges = self.groups.join(self.widths, "lang", "left").select(
            "lang", F.coalesce("range", F.lit(0)).alias("range"), F.lit(-1).alias("chunk"), "source", "block", "seat", "blocks",
            "total", "terms", F.coalesce("width", F.lit(0)).alias("width"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<long>").alias("counts"),
        )
        tiles = vectors.unionByName(ranges).withColumn("other", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
        tiles = tiles.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), *(c for c in vectors.columns if c not in ("lang", "blocks")))
        parts = tiles.groupBy("lang", "a", "b", "range").applyInPandas(_tile, "lang string, source string, item string, value long")
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a group has and its language as a whole gives a smaller share, the top ones."""
        both = self.counts.join(self.groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
        both = both.withColumn("value", F.expr(f"({_share('n', 'total', 'terms')}) - ({_share('lang_n', 'lang_total', 'terms')})")).where("value > 0")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def report(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts pair (all ranks) and term (ranks to top)."""
    audit = Audit(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(audit.terms(top).withColumn("part", F.lit("term")).select(columns))
