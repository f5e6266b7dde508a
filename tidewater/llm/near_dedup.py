"""MinHash near-duplicate groups: universal hash minima, banding, verification, components.

The steps:

1. One Python pass gives each text its set of distinct k-word shingles (as 64-bit
   hashes), a 128-bit key of that set, ROWS * BANDS universal hash minima and a hash
   for each band. Equal sets form a class; only its smallest id goes on.
2. A bucket is a band hash that several classes share. A class's centrality is the
   number of classes that it meets over its buckets; each bucket's most central class
   is its leader, and the other members are compared with it, not with each other.
3. Pairs are compared by their minima first (dropped far below the threshold) and
   then on their whole sets; links go to large-star and small-star components.
4. The members of buckets that still hold several components are compared across
   components (never within one) by exact prefix and position filters over their whole
   sets, so no link between them is left out, while a group of n near copies costs
   about n comparisons and not n * n.

The chance that a pair at the threshold shares no band is (1 - 0.8**4)**32 < 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words
from tidewater.llm.components import components
from tidewater.llm.storage import materialise

ROWS, BANDS = 4, 32
#: Pairs whose minima agree in less than this are over five standard deviations below 0.8.
SIGNATURE_FLOOR = 0.6

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_BLOCK = 2048


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over a set, as 32-bit values."""
    low = None
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), _BLOCK):
            values = np.multiply.outer(_A, shingles[i : i + _BLOCK])
            values += _B[:, None]
            least = values.min(axis=1)
            low = least if low is None else np.minimum(low, least)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band, with the band's number in it."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            out = words.mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out.view(np.int64)


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(words.mix(shingles).sum(dtype=np.uint64))
        b = int(words.mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return signed(a), signed(b)


_PROFILE = "doc_id long, n_shingles long, key_a long, key_b long, signature binary, bands array<long>"


def _profiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, keys_a, keys_b, signatures, bands = [], [], [], [], []
            for a, b, hashes, at in words.text_shingles(texts, k, fold=True):
                for i in range(b - a):
                    own = np.unique(hashes[at[i] : at[i + 1]])
                    sizes.append(len(own))
                    if not len(own):
                        keys_a.append(0), keys_b.append(0), signatures.append(None), bands.append(None)
                        continue
                    x, y = _set_key(own)
                    low = minima(own)
                    keys_a.append(x), keys_b.append(y), signatures.append(low.tobytes()), bands.append(band_hashes(low))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys_a, pa.int64()), pa.array(keys_b, pa.int64()),
                    pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "key_a", "key_b", "signature", "bands"],
            )

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs (u, v) whose signatures agree in at least SIGNATURE_FLOOR of all minima."""
    width = ROWS * BANDS
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, width) for c in (2, 3))
        good = (a == b).mean(axis=1) >= SIGNATURE_FLOOR
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["u", "v"])


def _confirm(k: int, numerator: int, denominator: int):
    """Keep pairs (u, v) whose whole shingle sets have denominator * |A & B| >= numerator * |A | B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = []
            for c in (2, 3):
                own = []
                for a, b, hashes, at in words.text_shingles(batch.column(c), k, fold=True):
                    own += [np.unique(hashes[at[i] : at[i + 1]]) for i in range(b - a)]
                sides.append(own)
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common > 0 and denominator * common >= numerator * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, k: int, numerator: int, denominator: int, name: str) -> DataFrame:
    """Those of the distinct pairs (u, v) that are links, written to the shared folder."""
    left = signatures.select(F.col("doc_id").alias("u"), F.col("signature").alias("s"))
    right = signatures.select(F.col("doc_id").alias("v"), F.col("signature").alias("t"))
    near = pairs.join(left, "u").join(right, "v").select("u", "v", "s", "t").mapInArrow(_agreement, "u long, v long")
    near = materialise(near.distinct(), f"{name}-near")
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("y"))
    sure = near.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(_confirm(k, numerator, denominator), "u long, v long")
    return materialise(sure, f"{name}-links")


def _unique_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for a, b, hashes, at in words.text_shingles(texts, k, fold=True):
        for i in range(b - a):
            yield np.unique(hashes[at[i] : at[i + 1]])


def _counts(k: int, bits: int):
    """(cell, n): how many of the sets' shingles fall into each of 2**bits cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for own in _unique_sets(batch.column("text"), k):
                np.add.at(total, (own >> np.uint64(64 - bits)).astype(np.int64), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    return run


def _prefixes(k: int, numerator: int, denominator: int, bits: int, counts_of):
    """(doc_id, component, size, prefix): each set's rarest shingles in order, as many as a link needs to share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of()
        for batch in batches:
            prefixes, sizes = [], []
            for own in _unique_sets(batch.column("text"), k):
                n = len(own)
                p = n - -(-numerator * n // denominator) + 1
                order = np.lexsort((own, counts[(own >> np.uint64(64 - bits)).astype(np.int64)]))[:p]
                prefixes.append(own[order].view(np.int64))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("component"), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "component", "size", "prefix"],
            )

    return run


def _pairs_across(mixed: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """All pairs (u, v) of mixed (doc_id, component, text) from different components that may be links.

    An exact filter, not a sampled one: in any order of all shingles, the first shingle that
    two linked sets share is among the first n - ceil(t * n) + 1 of each, and no more than
    1 + min(what comes after it) can be shared in all. With the rare shingles first, sets
    that were edited in many places meet none of their group. Two components are compared
    if some shingle's best positions in both allow a link, whatever the number of such
    shingles; then their members are, each pair once, the smaller component's first.
    """
    spark = mixed.sparkSession
    n = mixed.count()
    bits = min(20, max(16, n.bit_length()))
    counts = np.zeros(1 << bits, np.int64)
    for r in mixed.select("text").mapInArrow(_counts(k, bits), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["cell"]] = r["n"]  # at most 2**20 rows
    shared = spark.sparkContext.broadcast(counts)
    members = mixed.select("doc_id", "component", "text").mapInArrow(
        _prefixes(k, numerator, denominator, bits, lambda: shared.value), "doc_id long, component long, size long, prefix array<long>"
    )
    members = materialise(members, "prefixes")

    def reaches(rest_a: Column, rest_b: Column, size_a: Column, size_b: Column) -> Column:
        return (1 + F.least(rest_a, rest_b)) * (numerator + denominator) >= numerator * (size_a + size_b)

    tokens = members.select("component", "size", F.posexplode("prefix").alias("pos", "token"))
    groups = tokens.groupBy("token", "component").agg(F.max(F.col("size") - 1 - F.col("pos")).alias("rest"), F.min("size").alias("size"))
    split = groups.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    groups = materialise(groups.join(split, "token"), "groups")
    a, b = (groups.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("component", "rest", "size")]) for x in "ab")
    near = a.join(b, "token").where((F.col("component_a") < F.col("component_b")) & reaches(*[F.col(c) for c in ("rest_a", "rest_b", "size_a", "size_b")]))
    near = near.select("component_a", "component_b").distinct()

    held = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    of = lambda x: held.select(F.col("component").alias(f"component_{x}"), F.col("n").alias(f"n_{x}"))
    near = near.join(of("a"), "component_a").join(of("b"), "component_b")
    first = F.col("n_a") <= F.col("n_b")
    near = near.select(F.when(first, F.col("component_a")).otherwise(F.col("component_b")).alias("cx"), F.when(first, F.col("component_b")).otherwise(F.col("component_a")).alias("cy"))
    x, y = (members.select(F.col("component").alias(f"c{s}"), F.col("doc_id").alias(s), F.col("size").alias(f"size_{s}"), F.col("prefix").alias(f"prefix_{s}")) for s in "xy")
    common = F.try_element_at(F.array_intersect("prefix_x", "prefix_y"), F.lit(1))  # both are in the same order, so it is the first for either
    rest = lambda s: F.col(f"size_{s}") - F.array_position(f"prefix_{s}", common)
    met = near.join(x, "cx").join(y, "cy").where(common.isNotNull() & reaches(rest("x"), rest("y"), F.col("size_x"), F.col("size_y")))
    return met.select(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("u")).distinct()


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, component) after further links (u, v): only the components that these join are worked on again."""
    if more.isEmpty():
        return found
    ends = more.select(F.col("u").alias("id")).unionByName(more.select(F.col("v").alias("id"))).distinct()
    alone = ends.join(found, "id", "left_anti").withColumn("component", F.col("id"))
    base = materialise(found.unionByName(alone), "components")
    a, b = base.select(F.col("id").alias("u"), F.col("component").alias("cu")), base.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    met = more.join(a, "u").join(b, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = components(met).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return base.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; other columns are ignored).

    Texts are lower-cased in A-Z and cut into words at white space; documents are linked
    if denominator * |A & B| >= numerator * |A | B| for their sets of k-word shingles.
    A text of fewer than k words has one shingle, its whole sequence. Null, empty and
    blank texts have none and are linked with nothing. Rows that share a doc_id
    but not their text are placed by their own text. A row without doc_id is linked with nothing and kept (component_id null).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = materialise(texts.mapInArrow(_profiles(k), _PROFILE), "profiles")
    usable = profiles.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = materialise(classes, "classes")

    leaders = classes.select(F.col("class_id").alias("doc_id")).distinct()
    signed = materialise(usable.select("doc_id", "signature", "bands").join(leaders, "doc_id", "left_semi"), "signed")
    members = signed.select("doc_id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(members.join(shared, "bucket"), "met")
    # Only texts that share a bucket are compared; the others move no more after this.
    texts = materialise(texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")
    central = met.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weighed = met.select("doc_id", "bucket").join(central, "doc_id")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("i")))["i"].alias("i")).select("bucket", (-F.col("i")).alias("hub"))
    stars = met.select("doc_id", "bucket").join(hubs, "bucket").where("doc_id != hub")
    pairs = materialise(stars.select(F.least("doc_id", "hub").alias("v"), F.greatest("doc_id", "hub").alias("u")).distinct(), "pairs")

    links = _verified(pairs, signed, texts, k, numerator, denominator, "star")
    found = components(links)

    placed = met.select("doc_id", "bucket").join(found, met["doc_id"] == found["id"], "left")
    placed = placed.select("doc_id", "bucket", F.coalesce("component", "doc_id").alias("component"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    mixed = placed.join(split, "bucket", "left_semi").select("doc_id", "component").distinct()
    mixed = materialise(texts.join(mixed, "doc_id").select("doc_id", "component", "text"), "mixed")
    rest = _pairs_across(mixed, k, numerator, denominator).join(pairs, ["u", "v"], "left_anti")
    more = _verified(materialise(rest, "rest"), signed, texts, k, numerator, denominator, "rest")
    found = _joined(found, more)

    top = classes.join(found, classes["class_id"] == found["id"], "left").select(
        "key_a", "key_b", "n_shingles", F.coalesce("component", "class_id").alias("component_id")
    )
    rows = profiles.select("doc_id", "n_shingles", "key_a", "key_b")
    out = rows.join(top, ["key_a", "key_b", "n_shingles"], "left")
    component: Column = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs without the near-duplicates of a document with a smaller doc_id.

    Of repeated rows with one doc_id all stay or all go.
    """
    gone = near_duplicates(docs, k).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(materialise(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
