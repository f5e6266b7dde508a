"""Incremental, reversible line dedup: exact reference counts with a sharded cuckoo filter in front.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; keys are
held as 128-bit BLAKE2b digests (two longs). A store has two tables in a shared folder:

* refs (h1, h2, n): in how many documents each key is, exactly. Inserting documents adds
  to it, deleting documents takes away from it.
* filters (shard, slots, exceptions): for each shard of keys a cuckoo filter of those with
  n >= min_docs. A key that reaches min_docs is inserted into its shard's filter, one that
  falls below is deleted from it, which a Bloom filter could not do. All other keys of refs
  are looked up once when a filter changes; those that it would take for members (2e-9 of
  them) are its exceptions. So for the store's documents filter and exceptions together
  answer exactly, without a join of lines.

apply() looks up every line of the documents and drops the lines of common keys. Filters up
to FILTER_BYTES in all go to every task. Beyond that the lines' keys are dealt to the filters
by shard and salt (a common line meets SALTS copies of its filter), streamed past them, and
only hits return to the documents. Both ways give the same rows.

Odd cases: a null or empty text is one empty line; an empty key is never common; each row is
a document of its own, also if rows repeat or doc_id is null; a line that repeats inside a
document counts once; extra columns are ignored, or returned untouched by without_common_lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.storage import materialise, place_of
from tidewater.llm.words import mix

MIN_DOCS = 10
SLOTS = 4
#: Keys of one shard; a store whose shards grow to twice as many is dealt out anew.
SHARD_KEYS = 1 << 15
LEAST_SHARDS = 64
#: Filters of this size in all are sent to every task.
FILTER_BYTES = 64 << 20
#: Tasks that share the lines of one shard, if the filters are larger.
SALTS = 16
_LOAD, _TURNS = 0.85, 500
_BLANK = b" \t\n\x0b\x0c\r"
_FILTER_SCHEMA = "shard int, slots binary, exceptions binary"


class Cuckoo:
    """A cuckoo filter: buckets (a power of two) of SLOTS 32-bit fingerprints, 0 for free. Takes and returns arrays."""

    def __init__(self, buckets: int = 1, slots: bytes | None = None):
        self.slots = np.zeros((buckets, SLOTS), np.uint32) if slots is None else np.frombuffer(slots, np.uint32).reshape(-1, SLOTS).copy()

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of all these keys, doubled until they fit."""
        buckets = 1
        while buckets * SLOTS * _LOAD < len(keys):
            buckets *= 2
        while not (made := cls(buckets)).insert(keys):
            buckets *= 2
        return made

    def _homes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = np.maximum(keys >> np.uint64(32), np.uint64(1)).astype(np.uint32)
        return prints, (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if some did not fit; then the filter has to be made anew with more buckets."""
        prints, at = self._homes(keys)
        rng = np.random.Generator(np.random.PCG64(len(self.slots)))
        for _ in range(_TURNS):
            for _ in range(2):  # each in its own bucket, then in the other one
                order = np.argsort(at, kind="stable")
                prints, at = prints[order], at[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                free = self.slots[at] == 0
                fits = rank < free.sum(axis=1)
                column = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
                self.slots[at[fits], column[fits]] = prints[fits]
                prints, at = prints[~fits], at[~fits]
                at = self._other(at, prints)
            if not len(prints):
                return True
            one = np.unique(at, return_index=True)[1]
            column = rng.integers(0, SLOTS, len(one))
            out = self.slots[at[one], column]
            self.slots[at[one], column] = prints[one]
            prints[one], at[one] = out, self._other(at[one], out)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted; an error for others."""
        prints, at = self._homes(keys)
        while len(prints):
            other = self._other(at, prints)
            one = np.unique(np.stack([np.minimum(at, other), prints.astype(np.int64)]), axis=1, return_index=True)[1]
            here = self.slots[at[one]] == prints[one][:, None]
            there = self.slots[other[one]] == prints[one][:, None]
            first = here.any(axis=1)
            if not (first | there.any(axis=1)).all():
                raise ValueError("a key that is not in the filter cannot be deleted")
            bucket = np.where(first, at[one], other[one])
            self.slots[bucket, np.where(first[:, None], here, there).argmax(axis=1)] = 0
            prints, at = np.delete(prints, one), np.delete(at, one)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self._homes(keys)
        return ((self.slots[at] == prints[:, None]) | (self.slots[self._other(at, prints)] == prints[:, None])).any(axis=1)


def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys' digests; b'' stands for an empty key."""
    lines = (text or b"").split(b"\n")
    keys = [line.strip(_BLANK).lower() for line in lines]  # bytes.lower() changes A-Z only
    return lines, [k and hashlib.blake2b(k, digest_size=16).digest() for k in keys]


def _longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _shards_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.astype(np.uint64) % np.uint64(shards)).astype(np.int64)


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[bytes, int] = {}
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            for key in set(line_keys(text)[1]):
                if key:
                    counts[key] = counts.get(key, 0) + 1
        at = _longs(list(counts))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(list(counts.values()), pa.int64())], ["h1", "h2", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    place = place_of(docs, "text")
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(F.col(f"c{place}").alias("text"))


def line_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n): in how many of these documents each non-empty key is."""
    return _texts(docs).mapInArrow(_key_counts, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Filters:
    """All shards' filters in one array, for tasks that hold them whole."""

    first: np.ndarray  # each shard's first bucket
    buckets: np.ndarray
    slots: np.ndarray
    exceptions: frozenset[bytes]

    @classmethod
    def of(cls, rows: list, shards: int) -> Filters:
        by_shard = {r["shard"]: r for r in rows}
        parts = [np.frombuffer(by_shard[s]["slots"], np.uint32).reshape(-1, SLOTS) if s in by_shard else np.zeros((1, SLOTS), np.uint32) for s in range(shards)]
        sizes = np.array([len(p) for p in parts], np.int64)
        out = frozenset(e[i : i + 16] for r in rows for e in [bytes(r["exceptions"])] for i in range(0, len(e), 16))
        return cls(np.cumsum(sizes) - sizes, sizes, np.concatenate(parts), out)

    def common(self, digests: list[bytes]) -> np.ndarray:
        """Which of the keys are common; an empty one never is."""
        found = np.zeros(len(digests), bool)
        full = np.array([bool(d) for d in digests], bool)
        keys = _longs(digests)
        shard, h2 = _shards_of(keys[:, 0], len(self.first)), keys[:, 1].astype(np.uint64)
        prints = np.maximum(h2 >> np.uint64(32), np.uint64(1)).astype(np.uint32)
        mask, first = (self.buckets[shard] - 1).astype(np.uint64), self.first[shard]
        at = (h2 & mask).astype(np.int64)
        other = at ^ (mix(prints.astype(np.uint64)) & mask).astype(np.int64)
        found[full] = ((self.slots[first + at] == prints[:, None]) | (self.slots[first + other] == prints[:, None])).any(axis=1)
        if self.exceptions:
            for i in np.flatnonzero(found):
                found[i] = digests[i] not in self.exceptions
        return found


def _without(texts: list[bytes | None], common) -> Iterator[tuple[int, int, bytes]]:
    """(lines, dropped lines, kept text) of each text; common takes all digests of the texts at once."""
    split = [line_keys(t) for t in texts]
    drop = common([d for _, digests in split for d in digests])
    at = 0
    for lines, _ in split:
        own = drop[at : at + len(lines)]
        at += len(lines)
        yield len(lines), int(own.sum()), b"\n".join(x for x, gone in zip(lines, own, strict=True) if not gone) if own.any() else b"\n".join(lines)


class LineStore:
    """The state of an incremental line dedup: each insert or delete returns the next state and leaves this one readable."""

    def __init__(self, spark: SparkSession, min_docs: int, shards: int, refs: DataFrame, filters: DataFrame):
        self.spark, self.min_docs, self.shards, self.refs, self.filters = spark, min_docs, shards, refs, filters

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = MIN_DOCS) -> LineStore:
        if min_docs < 1:
            raise ValueError("min_docs has to be 1 or more")
        return cls(spark, min_docs, 0, spark.createDataFrame([], "h1 long, h2 long, n long"), spark.createDataFrame([], _FILTER_SCHEMA))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineStore:
        """A store that save() has written."""
        told = spark.read.parquet(f"{path}/settings").first()
        return cls(spark, told["min_docs"], told["shards"], spark.read.parquet(f"{path}/refs"), spark.read.schema(_FILTER_SCHEMA).parquet(f"{path}/filters"))

    def save(self, path: str) -> None:
        """Write the state to a new folder; the settings come last, so a half-written one cannot be opened."""
        self.refs.write.parquet(f"{path}/refs")
        self.filters.write.parquet(f"{path}/filters")
        self.spark.range(1).select(F.lit(self.min_docs).alias("min_docs"), F.lit(self.shards).alias("shards")).write.parquet(f"{path}/settings")

    def insert(self, docs: DataFrame) -> LineStore:
        """The state with these documents too. Costs a pass over them and one over the counted keys."""
        return self._changed(line_counts(docs))

    def delete(self, docs: DataFrame) -> LineStore:
        """The state without these documents, as if they had never been inserted; an error if some key is not there as often."""
        return self._changed(line_counts(docs).withColumn("n", -F.col("n")))

    def _changed(self, delta: DataFrame) -> LineStore:
        rows = delta.select("h1", "h2", F.lit(0).cast("long").alias("old"), "n")
        if self.shards:
            rows = rows.unionByName(self.refs.select("h1", "h2", F.col("n").alias("old"), "n"))
            rows = rows.groupBy("h1", "h2").agg(F.sum("old").alias("old"), F.sum("n").alias("n"))
        changed = materialise(rows, "line-refs")
        told = changed.agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("least")).first()
        if told["keys"] and told["least"] < 0:
            raise ValueError("documents can only be deleted as often as they were inserted")
        shards, filters = self.shards, self.filters
        if not shards or told["keys"] > 2 * SHARD_KEYS * shards:
            shards, filters = max(LEAST_SHARDS, -(-told["keys"] // SHARD_KEYS)), self.spark.createDataFrame([], _FILTER_SCHEMA)
            changed = changed.withColumn("old", F.lit(0).cast("long"))
        return LineStore(self.spark, self.min_docs, shards, changed.where("n > 0").select("h1", "h2", "n"), materialise(self._filters(changed, filters, shards), "line-filters"))

    def _filters(self, changed: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
        least = self.min_docs

        def update(was: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            h1, h2, old, n = (keys[c].to_numpy() for c in ("h1", "h2", "old", "n"))
            hashes, member = h2.astype(np.uint64), n >= least
            made = None
            if len(was):
                made = Cuckoo(slots=was["slots"].iloc[0])
                made.delete(hashes[(old >= least) & ~member])
                if not made.insert(hashes[(old < least) & member]):
                    made = None  # full: make it anew from the exact counts
            made = made or Cuckoo.of(hashes[member])
            taken = np.flatnonzero(made.holds(hashes) & ~member & (n > 0))
            shard = int(keys["shard"].iloc[0]) if len(keys) else int(was["shard"].iloc[0])
            return pd.DataFrame({"shard": [shard], "slots": [made.slots.tobytes()], "exceptions": [np.stack([h1[taken], h2[taken]], axis=1).tobytes()]})

        # the remainder of h1 as an unsigned number
        high, low = F.shiftrightunsigned("h1", 32), F.col("h1").bitwiseAND(0xFFFFFFFF)
        keys = changed.withColumn("shard", ((high % shards * (2**32 % shards) + low % shards) % shards).cast("int"))
        return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(update, _FILTER_SCHEMA)

    def apply(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text): the documents without the lines of common keys; they have to be in the store.

        (A document that was never inserted may lose a line of its own with a chance of 2e-9 each.)
        """
        ids, texts = place_of(docs, "doc_id"), place_of(docs, "text")
        named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
        rows = named.select(F.col(f"c{ids}").alias("doc_id"), F.col(f"c{texts}").alias("text"))
        return self._applied(rows)

    def without_common_lines(self, docs: DataFrame) -> DataFrame:
        """The documents with all their columns; text loses the lines of common keys, and a null text stays null."""
        place = place_of(docs, "text")
        names = [f"c{i}" for i in range(len(docs.columns))]
        named = docs.toDF(*names)
        rest = F.struct(*(n for i, n in enumerate(names) if i != place)) if len(names) > 1 else F.lit(None).cast("int")
        found = self._applied(named.select(F.struct(rest.alias("rest"), F.col(names[place]).isNull().alias("none")).alias("doc_id"), F.col(names[place]).alias("text")))
        columns = [F.when(~F.col("doc_id.none"), F.col("text")) if i == place else F.col(f"doc_id.rest.{n}") for i, n in enumerate(names)]
        return found.select(columns).toDF(*docs.columns)

    def _applied(self, rows: DataFrame) -> DataFrame:
        kind = rows.schema["doc_id"].dataType
        schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())])
        size = self.filters.agg(F.sum(F.length("slots") + F.length("exceptions"))).first()[0] or 0
        if size > FILTER_BYTES:
            return self._applied_by_shard(rows, schema)
        held = self.spark.sparkContext.broadcast(Filters.of(self.filters.collect(), max(1, self.shards)))  # FILTER_BYTES at most

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _answer(batch.column(0), _without(batch.column(1).cast(pa.binary()).to_pylist(), held.value.common))

        return rows.mapInArrow(drop, schema)

    def _applied_by_shard(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        shards = self.shards
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "line-docs")

        def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    at = _longs([d for d in dict.fromkeys(line_keys(text)[1]) if d])
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_shards_of(at[:, 0], shards), pa.int32()), pa.array(np.full(n, row % SALTS), pa.int32()), pa.array(np.full(n, row)), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                        ["shard", "salt", "row", "h1", "h2", "slots", "exceptions"],
                    )

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held, odd = None, None, frozenset()
            for batch in batches:
                for part in _runs(batch):
                    if part.column(2)[0].as_py() is None:
                        shard, held = part.column(0)[0].as_py(), Cuckoo(slots=part.column(5)[0].as_py())
                        told = part.column(6)[0].as_py()
                        odd = frozenset(told[i : i + 16] for i in range(0, len(told), 16))
                    elif part.column(0)[0].as_py() == shard:
                        keys = np.stack([part.column(i).to_numpy() for i in (3, 4)], axis=1)
                        hit = np.flatnonzero(held.holds(keys[:, 1].astype(np.uint64)))
                        digests = [keys[i].tobytes() for i in hit]
                        real = [i for i, d in enumerate(digests) if d not in odd]
                        yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(hit[real])), pa.array([digests[i] for i in real], pa.binary())], ["row", "digest"])

        schema_keys = "shard int, salt int, row long, h1 long, h2 long, slots binary, exceptions binary"
        keys = rows.select("row", "text").mapInArrow(keys_of, schema_keys)
        none = F.lit(None).cast("long")
        copies = self.filters.select("shard", F.explode(F.array(*(F.lit(s) for s in range(SALTS)))).alias("salt"), none.alias("row"), none.alias("h1"), none.alias("h2"), "slots", "exceptions")
        met = keys.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("row").asc_nulls_first())
        hits = met.mapInArrow(probe, "row long, digest binary").groupBy("row").agg(F.collect_list("digest").alias("hits"))  # at most a document's own lines

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for text, hit in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    own = set(hit or ())
                    found += _without([text], lambda digests, own=own: np.array([d in own for d in digests], bool))
                yield _answer(batch.column(0), found)

        return rows.join(hits, "row", "left").select("doc_id", "text", "hits").mapInArrow(drop, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut into filter rows, each alone, and the runs of keys of one shard between them."""
    if not batch.num_rows:
        return
    shard, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    table = batch.column(2).is_null().to_numpy(zero_copy_only=False)
    new = np.flatnonzero(table[1:] | table[:-1] | (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
    for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _answer(ids: pa.Array, found) -> pa.RecordBatch:
    found = list(found)
    texts = pa.array([t for _, _, t in found], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array([n for n, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), texts], ["doc_id", "n_lines", "n_dropped", "text"])


def digest_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of apply()'s rows."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
