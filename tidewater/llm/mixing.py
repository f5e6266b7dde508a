"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

1. Every source gets a target number of words from the weights; no target is above
   MOST times its source, and the excess goes to the others by weight.
2. A source's documents fall into blocks by a keyed hash, and the blocks have a keyed
   random order. The mix reads the source's permuted blocks from the start, again and
   again, until the target is met; so the whole number of passes and a cut (the last
   block of the last pass, and which of its documents) say all that is taken.
3. The blocks that are read are exact quotas. A binary tree over the output shards
   splits them: at each node the left half's share of every source is a draw from the
   multivariate hypergeometric distribution. A shard reads its quota of each source's
   sequence of blocks, disjoint from all others, and shuffles its rows locally. What no
   shard's quota reads is not in the mix.

Only the list of sources with its sums is on the driver: one row for each source. Blocks
are ranked by two levels of sums, so a source's blocks are never all in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.storage import inline_rows, materialise

MOST = 3
SHARDS = 8
#: A mix is told by the list of its sources; beyond this many an error is raised, as the list is held by the driver.
SOURCES = 10_000
_WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORDS)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """60 bits of an MD5 of the parts, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Mix:
    """seed: of the orders and draws. rows_per_block: documents in a block, about."""

    seed: int = 1
    rows_per_block: int = 256
    shards: int = SHARDS
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)


def _keyed(docs: DataFrame, mix: Mix) -> DataFrame:
    """row (all columns of docs), doc_id, source, size and key; docs may have columns of any name."""
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"), _hash(F.lit(str(mix.seed)), known).alias("key"),
    )


def _slim(docs: DataFrame, mix: Mix) -> DataFrame:
    """What the plan needs of each row, counted once and written to the shared folder."""
    return materialise(_keyed(docs, mix).select("doc_id", "source", "size", "key"), "mix")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds weight and target to sources (source, source_size): water-filling under MOST times the size.

    The sources in code point order, null last, weigh weights, repeating. If every source
    is full the targets add up to MOST times all sizes, else to all sizes.
    """
    whole = Window.partitionBy(F.lit(0))
    place = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    known = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(MOST)))
    # Full sources come first by cap / weight; the level is what the others get for each unit of weight.
    by_fill = whole.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns(
        {
            "_total": F.sum("source_size").over(whole).cast("double"),
            "_spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("_total") - F.col("_spent")) / F.col("_left")
    fits = level * F.col("weight") <= F.col("cap")
    known = known.withColumn("_level", F.max(F.when(fits, level)).over(whole))  # the first that fits; later ones are lower
    target = F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    return known.select("source", "source_size", "n_rows", "weight", target.alias("target"))


def split_quotas(blocks: dict, shards: int, seed: int) -> dict:
    """Quotas of each source's blocks for each shard, by a tree of multivariate hypergeometric draws.

    At a node that stands for some shards, the left half of them gets its part of all
    blocks (in proportion, rounded), drawn without replacement from the node's blocks.
    """
    names = list(blocks)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(names), shards), np.int64)
    todo = [(0, shards, np.array([blocks[n] for n in names], np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[:, lo] = counts
            continue
        mid = (lo + hi) // 2
        left = int(counts.sum()) * (mid - lo) // (hi - lo)
        drawn = rng.multivariate_hypergeometric(counts, left, method="marginals") if len(names) else counts
        todo += [(mid, hi, counts - drawn), (lo, mid, drawn)]
    return {n: out[i].tolist() for i, n in enumerate(names)}


def _ranked(blocks: DataFrame) -> DataFrame:
    """Blocks (s, order, block, words) with rank (from 0) in their source's order and end, the sum of words up to there.

    Orders are cut into 1024 parts of equal width; sums over the parts come first, and each
    part is then ranked by itself.
    """
    placed = blocks.withColumn("part", F.shiftright("order", 50))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("s", "part").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    starts = parts.select(F.col("s").alias("s0"), F.col("part").alias("part0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    own = Window.partitionBy("s", "part").orderBy("order", "block")
    inside = placed.withColumns({"_rank": F.row_number().over(own) - 1, "_end": F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    met = inside.join(starts, F.col("s").eqNullSafe(F.col("s0")) & (F.col("part") == F.col("part0")))
    return met.select(*blocks.columns, (F.col("_rank") + F.col("n0")).cast("long").alias("rank"), (F.col("_end") + F.col("w0")).alias("end"))


def plan(slim: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix of rows (source, size, key) as one row for each source: source, source_size, target, n_blocks, held (blocks that have rows), passes, cut_order, cut_block, cut_keys and bounds.

    The documents of the blocks before (cut_order, cut_block), and those of this block
    whose keys are in cut_keys, are read passes + 1 times, the others passes times. bounds:
    for each shard where its range in the source's sequence of blocks ends, as the number
    of whole passes and the order and block of the first block that is not its own.
    """
    spark = slim.sparkSession
    keyed = slim.select("source", "size", "key")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    rows = targets(sizes, mix.weights).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    told = []
    for r in rows:
        passes = min(MOST, int(r["target"] // r["source_size"])) if r["source_size"] else 0
        rest = max(0.0, r["target"] - passes * r["source_size"]) if passes < MOST else 0.0
        told.append((r["source"], r["source_size"], r["target"], max(1, r["n_rows"] // mix.rows_per_block), passes, rest))
    sources = inline_rows(spark, told, "source string, source_size long, target double, n_blocks long, passes int, rest double")

    placed = keyed.join(_small(sources.select(F.col("source").alias("s"), "n_blocks", "rest")), F.col("source").eqNullSafe(F.col("s")), "inner")
    placed = placed.withColumn("block", F.pmod(F.col("key"), F.col("n_blocks"))).withColumn("order", block_order(F.col("s"), F.col("block"), mix))
    blocks = _ranked(placed.groupBy("s", "order", "block", "rest").agg(F.sum("size").alias("words")))
    cut = blocks.where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("words") < F.col("rest")) & (F.col("rest") > 0))
    cut = cut.groupBy("s").agg(F.min(F.struct("rank", "order", "block", (F.col("rest") - F.col("end") + F.col("words")).alias("lack"))).alias("c"))
    cut = cut.select("s", F.col("c.rank").alias("cut_rank"), F.col("c.order").alias("cut_order"), F.col("c.block").alias("cut_block"), F.col("c.lack").alias("lack"))

    # The documents of each source's cut block, large ones first, that still fit under the target. A block
    # has about rows_per_block keys, however large the source.
    inside = placed.join(_small(cut.select(F.col("s").alias("t"), "cut_order", "cut_block", "lack")), F.col("s").eqNullSafe(F.col("t")) & (F.col("order") == F.col("cut_order")) & (F.col("block") == F.col("cut_block")))
    same = inside.groupBy("s", "lack", "key").agg(F.sum("size").alias("w"))
    queue = same.groupBy("s", "lack").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "key"))).alias("q"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("keys"))

    def step(done: Column, one: Column) -> Column:
        near = done["sum"] - one["w"] <= F.col("lack")
        return F.struct(F.when(near, done["sum"] - one["w"]).otherwise(done["sum"]).alias("sum"), F.when(near, F.concat(done["keys"], F.array(one["key"]))).otherwise(done["keys"]).alias("keys"))

    last = queue.select(F.col("s").alias("l"), F.aggregate("q", start, step)["keys"].alias("cut_keys"))
    held = blocks.groupBy(F.col("s").alias("h")).agg(F.count(F.lit(1)).alias("held"))
    full = held.join(cut, F.col("h").eqNullSafe(F.col("s")), "left").join(last, F.col("h").eqNullSafe(F.col("l")), "left")
    full = materialise(full.select("h", "held", "cut_rank", "cut_order", "cut_block", "cut_keys"), "cuts")
    facts = {r["h"]: r for r in full.select("h", "held", "cut_rank", (F.size("cut_keys") > 0).alias("some")).collect()}  # one row for each source

    read = {}
    for name, _, _, _, passes, _ in told:
        f = facts[name]
        read[name] = passes * f["held"] + (0 if f["cut_rank"] is None else f["cut_rank"] + bool(f["some"]))
    quotas = split_quotas(read, mix.shards, mix.seed)
    spots = [(name, *divmod(int(end), facts[name]["held"])) for name in read for end in np.cumsum(quotas[name])]
    spots = inline_rows(spark, spots, "source string, whole int, rank long")
    at = blocks.select("s", F.col("rank").alias("r"), "order", "block")
    ends = at.join(_small(spots), F.col("s").eqNullSafe(F.col("source")) & (F.col("r") == F.col("rank")))
    ends = ends.groupBy(F.col("s").alias("e")).agg(F.sort_array(F.collect_list(F.struct("whole", "order", "block"))).alias("bounds"))
    out = sources.join(full, F.col("source").eqNullSafe(F.col("h"))).join(ends, F.col("source").eqNullSafe(F.col("e")))
    return materialise(out.select("source", "source_size", "target", "n_blocks", "held", "passes", "cut_order", "cut_block", "cut_keys", "bounds"), "plan")


def block_order(source: Column, block: Column, mix: Mix) -> Column:
    return _hash(F.lit(str(mix.seed)), F.coalesce(source, F.lit("")), block.cast("string"))


def _small(sources: DataFrame) -> DataFrame:
    """A hint to broadcast: the list of sources has at most SOURCES rows."""
    return F.broadcast(sources)


def mixed(keyed: DataFrame, told: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Keyed rows with their source's plan (p_ columns), block, order and copies: how often the mix reads the row (0 to MOST).

    Nothing is shuffled: all that a row needs is in its source's row of the plan. Null
    texts have no words; they are read with the block that they fall into. A null source
    is a source. Repeated rows fall together.
    """
    rows = keyed.join(_small(told.select(*[F.col(c).alias(f"p_{c}") for c in told.columns])), F.col("source").eqNullSafe(F.col("p_source")))
    rows = rows.withColumn("block", F.pmod(F.col("key"), F.col("p_n_blocks")))
    rows = rows.withColumn("order", block_order(F.col("source"), F.col("block"), mix))
    same = (F.col("order") == F.col("p_cut_order")) & (F.col("block") == F.col("p_cut_block"))
    before = (F.col("order") < F.col("p_cut_order")) | ((F.col("order") == F.col("p_cut_order")) & (F.col("block") < F.col("p_cut_block")))
    extra = F.coalesce((before | (same & F.array_contains("p_cut_keys", F.col("key")))).cast("int"), F.lit(0))
    return rows.withColumn("copies", F.col("p_passes") + extra)


def _dealt(keyed: DataFrame, told: DataFrame, mix: Mix) -> DataFrame:
    """Keyed rows once for each copy that a shard's quota reads, with copy (from 0), mix_shard and mix_order; nothing is shuffled."""
    copies = mixed(keyed, told, mix).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.struct(F.col("copy").alias("whole"), F.col("order").alias("order"), F.col("block").alias("block"))
    shard = F.size(F.filter("p_bounds", lambda b: b <= at))
    order = _hash(F.lit(f"order{mix.seed}"), F.col("key").cast("string"), F.col("copy").cast("string"))
    return copies.select(*keyed.columns, "copy", shard.alias("mix_shard"), order.alias("mix_order")).where(F.col("mix_shard") < mix.shards)


def assigned(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: docs' columns, and for every copy that is read its copy (from 0), mix_shard and mix_order.

    mix_order sorts a shard's rows at random (a keyed hash), so a shard is shuffled where it
    is read. Columns of docs with one of these three names are replaced. Null and empty texts
    have no words and come with the block that they fall into; rows without doc_id fall into
    one block of their source; repeated rows are read alike; a null source is a source; an
    empty table stays empty.
    """
    added = ("copy", "mix_shard", "mix_order")
    rows = _dealt(_keyed(docs, mix), plan(_slim(docs, mix), mix), mix)
    kept = [c for c in docs.columns if c.lower() not in added]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)


def in_shards(rows: DataFrame) -> DataFrame:
    """Assigned rows with each shard's rows together, shuffled by mix_order; ranges of both, so that a shard may be many tasks."""
    return rows.orderBy("mix_shard", "mix_order")


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs; taken counts repeats.

    The mix's rows, without their texts, are written shard by shard to the shared folder, and
    taken is the words of a row's copies that are in it; rows that the mix does not read have 0.
    """
    slim = _slim(docs, mix)
    told = plan(slim, mix)
    written = materialise(in_shards(_dealt(slim, told, mix)), "mixed")
    # Repeated rows are read alike: each has its part of what they have together.
    at = ("doc_id", "source", "size", "key")
    read = written.groupBy(*[F.col(c).alias(f"t_{c}") for c in at]).agg(F.sum("size").alias("words"), F.count_if(F.col("copy") == 0).alias("n"))
    met = slim.join(read, reduce(and_, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in at]), "left")
    met = met.join(_small(told.select(*[F.col(c).alias(f"p_{c}") for c in ("source", "source_size", "target")])), F.col("source").eqNullSafe(F.col("p_source")))
    return met.select(
        "doc_id", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), F.coalesce(F.expr("words div n"), F.lit(0)).cast("long").alias("taken")
    )


def repeated(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs with each row as often as the mix's shards read it (rows that they do not read are gone), in docs' columns."""
    rows = _dealt(_keyed(docs, mix), plan(_slim(docs, mix), mix), mix)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
