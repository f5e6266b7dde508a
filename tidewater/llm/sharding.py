"""Rendezvous sharding of stable record keys over weighted shards, with DataFrame functions only.

Each shard draws a number u in (0, 1) from a hash of the key and the shard's number; the
row goes to the shard with the least -ln(u) / weight. A row's shard depends on its key
and the weights alone, and a further shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of MD5(key#shard)."""
    bits = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key. Weight 0 takes no rows; a null key counts as the empty string."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight above 0")
    known = F.coalesce(key.cast("string"), F.lit(""))
    costs = [F.struct((-F.ln(_draw(known, i)) / float(w)).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """docs with a column shard_id, by doc_id alone; no shuffle.

    Rows of one doc_id share a shard, repeated rows too; those without doc_id share the
    empty key's. Texts do not matter, null, empty or long. A column shard_id that docs has
    is replaced, others stay; an empty table stays empty.
    """
    return docs.withColumn("shard_id", rendezvous(F.col("doc_id"), weights))


def manifest(docs: DataFrame, weights: Sequence[float], rows_per_block: int = 20_000) -> DataFrame:
    """Each row's place: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1 (1 for null), text_crc32 the CRC-32 of these
    bytes (0 for null and empty). Slots count the rows of a shard from 0 without gaps, in
    the order of blocks (by a hash of doc_id), doc_id and CRC. Only ids, sizes and CRCs are
    shuffled; a block holds about rows_per_block rows, so no task numbers a whole shard, and
    what is added up over a shard is one count for each block. Null doc_ids share a key.
    """
    total = docs.count()
    blocks = max(1, total // rows_per_block)
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, 1.0]).alias("grown_shard"),
        F.pmod(F.xxhash64(known, F.coalesce(F.crc32(text.cast("binary")), F.lit(0))), F.lit(blocks)).cast("int").alias("block"),
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(own)).join(starts, ["shard", "block"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard"
    )
