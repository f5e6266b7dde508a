"""Token files in training order.

Documents are tokenised with a tiktoken vocabulary and packed, in the order of each
input partition, into sequences of a fixed number of tokens (an end token after each
document; only a partition's last sequence is padded). Sequence i of N goes to slot
P(i), where P is a keyed Feistel permutation of the next larger even power of two, walked
until it falls below N. A shard is a file of consecutive slots, each of the same number
of bytes, so slot s stands at a known place and a reader can resume anywhere. Slots are
spread over 0 .. N - 1 without gaps, so the ranges of slots that tasks write are known
beforehand: each task writes a run of whole shards, and their number follows the bytes.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words
from tidewater.llm.secrets import VOCABULARY, encoding

SEQUENCE = 512
SLOTS = 8192
#: Bytes of token files that one task writes, about, where there is more than one such part for each core.
TASK_BYTES = 256 << 20
KEY = 20240229
ROUNDS = 6


class Tokenizer:
    """Token ids of whole batches; pieces of text that were met before come from a bounded cache.

    A text is cut before each single space or line feed that stands between other
    characters; the vocabulary's pattern has a boundary there, so the pieces' ids put
    together are the text's. The cache is a direct-mapped table of 64-bit piece hashes.
    """

    SLOT_BITS, POOL = 21, 24_000_000

    def __init__(self, path: str):
        self._encode = encoding(path).encode_ordinary
        self.end = encoding(path).n_vocab
        self._bytes = np.array([len(encoding(path).decode_single_token_bytes(i)) for i in range(self.end)])
        self._reset()

    def _reset(self) -> None:
        self._keys = np.zeros(1 << self.SLOT_BITS, np.uint64)
        self._at = np.zeros(1 << self.SLOT_BITS, np.int64)
        self._length = np.zeros(1 << self.SLOT_BITS, np.int32)
        self._pool, self._used = np.zeros(1 << 20, np.uint16), 0

    def _append(self, ids: np.ndarray) -> int:
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros(len(self._pool), np.uint16)])
        self._pool[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        return self._used - len(ids)

    @staticmethod
    def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start, texts' starts included (and none of empty texts)."""
        first = np.zeros(len(data), bool)
        if len(data) > 2:
            gap = words.SPACE[data]
            first[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~gap[:-2] & ~gap[2:]
            # white space beyond ASCII starts with one of these bytes; no cut next to what may be such
            two, three = data == 0xC2, (data >= 0xE1) & (data <= 0xE3)
            first[1:-1] &= ~(two | three)[2:]
            first[2:] &= ~two[:-2]
            first[3:] &= ~three[:-3]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges[edges + 1 < len(data)]] = False
        first[edges - 1] = False  # a space at a text's end stays with what is before it
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(first)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces into the pool; their places and lengths there."""
        at, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        gap = words.SPACE[data]
        inner = gap[starts] & (ends - starts > 1) & ~gap[ends - 1]
        inner[inner] = ~gap[starts[inner] + 1]
        joined = np.flatnonzero(inner)
        if len(joined):
            sizes = (ends - starts)[joined]
            place = np.repeat(starts[joined] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            ids = np.array(self._encode(data[place].tobytes().decode("utf-8", "replace")), np.uint16)
            upto = np.cumsum(self._bytes[ids])
            last = np.searchsorted(upto, np.cumsum(sizes))
            if upto[-1] != sizes.sum() or (upto[last] != np.cumsum(sizes)).any():
                inner[:] = False  # some bytes are not UTF-8; one by one then
            else:
                begin = np.concatenate([[0], last[:-1] + 1])
                at[joined], length[joined] = self._append(ids) + begin, last + 1 - begin
        for i in np.flatnonzero(~inner):
            ids = np.array(self._encode(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")), np.uint16)
            at[i], length[i] = self._append(ids), len(ids)
        return at, length

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts in order, or none of them; number of tokens of each text)."""
        found, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for a, b in words.spans(np.diff(offsets)):
            if self._used > self.POOL:
                self._reset()
            part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if not len(part):
                counts.append(np.zeros(b - a, np.int64))
                continue
            starts = self._cuts(part, inner)
            ends = np.append(starts[1:], len(part))
            hashes = words.hash_ranges(part, starts, ends)
            slot = (words.mix(hashes) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
            hit = (self._keys[slot] == hashes) & (self._length[slot] > 0)
            at, length = self._at[slot], self._length[slot].astype(np.int64)
            miss = np.flatnonzero(~hit)
            if len(miss):
                _, one, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
                one = miss[one]
                new_at, new_length = self._learn(part, starts[one], ends[one])
                at[miss], length[miss] = new_at[back], new_length[back]
                self._keys[slot[one]], self._at[slot[one]], self._length[slot[one]] = hashes[one], new_at, new_length
            total = np.concatenate([[0], np.cumsum(length)])
            counts.append(np.diff(total[np.searchsorted(starts, inner)]))
            if ids:
                found.append(self._pool[np.repeat(at - total[:-1], length) + np.arange(total[-1])])
        return np.concatenate(found), np.concatenate(counts)


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer; its cache outlives a task."""
    return Tokenizer(path)


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of sequences: a bijection of 0 .. n - 1 that depends on the key."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = words.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (words.mix(right ^ k) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo[np.flatnonzero(todo)[x < n]] = False
    return out.astype(np.int64)


def sequences(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of packed sequences (rows x length; the last one padded with the end token), their numbers of tokens and first documents."""
    tokens = tokenizer(vocabulary)
    held, owners, starts = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        data, offsets = words.utf8(batch.column(1))
        for a, b in words.spans(np.diff(offsets), 8 * words.SLICE):
            ids, counts = tokens.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.cumsum(counts + 1) - 1
            line = np.full(len(ids) + b - a, tokens.end, np.uint16)
            inside = np.ones(len(line), bool)
            inside[ends] = False
            line[inside] = ids
            doc_ids = batch.column(0).slice(a, b - a).fill_null(-1).to_numpy(zero_copy_only=False)
            owners, starts = np.concatenate([owners, doc_ids]), np.concatenate([starts, len(held) + ends - counts])
            line = np.concatenate([held, line])
            full = len(line) // length
            if full:
                yield line[: full * length].reshape(full, length), np.full(full, length), owners[np.searchsorted(starts, np.arange(full) * length, "right") - 1]
            held, starts = line[full * length :], starts - full * length
            keep = max(0, int(np.searchsorted(starts, 0, "right")) - 1)
            owners, starts = owners[keep:], starts[keep:]
    if len(held):
        yield np.concatenate([held, np.full(length - len(held), tokens.end, np.uint16)])[None, :], np.array([len(held)]), owners[:1]


def n_sequences(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int) -> int:
    """How many sequences sequences() gives."""
    tokens, total = tokenizer(vocabulary), 0
    for batch in batches:
        total += int(tokens.encode(*words.utf8(batch.column(1)), ids=False)[1].sum()) + batch.num_rows
    return -(-total // length)


def write_shards(docs: DataFrame, folder: str, length: int = SEQUENCE, slots: int = SLOTS, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the token files to a new folder below folder, and return one row for each slot.

    Columns: slot, shard, start (the sequence's byte in its file), n_tokens (without
    padding), first_doc_id (-1 for
    null), crc32 of the sequence's bytes, and file. Every shard's file
    has `slots` records of 2 * length bytes (the last one fewer). Files are written under
    another name and then moved, so a task that runs twice leaves one whole file. docs has
    to be read in the same partitions each time (files, or a checkpoint): a first pass
    counts each partition's sequences, a second one numbers them. If the passes differ,
    or a slot is missing, the write fails. Null and empty texts are an end token each,
    repeated rows repeat, very long texts fill as many sequences as they need, an empty table
    gives no rows and no files; other columns are ignored. Texts are tokenised twice, as the
    numbering needs the counts and tokens are not kept in between. With many sequences choose
    larger slots: the number of files is that of sequences by slots.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = n_sequences(batches, vocabulary, length)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], names=["part", "n"])

    counts = {r["part"]: r["n"] for r in rows.mapInArrow(count, "part long, n long").collect()}  # one row for each partition
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    starts_shared = spark.sparkContext.broadcast(starts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = starts_shared.value[part]
        codec = pa.Codec("zstd", compression_level=1)
        for block, n_tokens, owners in sequences(batches, vocabulary, length):
            place = permute(np.arange(at, at + len(block)), total, key)
            at += len(block)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place), pa.array(place // slots), pa.array(n_tokens, pa.int64()), pa.array(owners, pa.int64()),
                    pa.array([codec.compress(row.tobytes(), asbytes=True) for row in block], pa.binary()),
                ],
                names=["slot", "shard", "n_tokens", "first_doc_id", "tokens"],
            )
        if at != starts_shared.value[part] + counts_shared.value[part]:
            raise RuntimeError("the input's partitions changed between the passes")

    counts_shared = spark.sparkContext.broadcast(counts)
    target = f"{folder}/{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, codec = None, pa.Codec("zstd")
        for batch in batches:
            files, offsets, crcs = [], [], []
            for slot, shard, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        writer.close()
                    writer = _ShardWriter(target, shard, slots, length, total)
                data = codec.decompress(packed, 2 * length, asbytes=True)
                files.append(writer.path)
                offsets.append(writer.add(slot, data))
                crcs.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(offsets, pa.int64()), batch.column(2), batch.column(3), pa.array(crcs, pa.int64()), pa.array(files, pa.string())],
                names=["slot", "shard", "start", "n_tokens", "first_doc_id", "crc32", "file"],
            )
        if writer is not None:
            writer.close()

    shards = max(1, -(-total // slots))
    sequenced = rows.mapInArrow(number, "slot long, shard long, n_tokens long, first_doc_id long, tokens binary")
    tasks = min(shards, max(spark.sparkContext.defaultParallelism, total * 2 * length // TASK_BYTES))
    part = F.expr(f"cast(shard * {tasks} div {shards} as int)")  # ranges of shards, all but evenly
    laid = sequenced.repartitionById(tasks, part).sortWithinPartitions("shard", "slot")
    return laid.mapInArrow(write, "slot long, shard long, start long, n_tokens long, first_doc_id long, crc32 long, file string")


class _ShardWriter:
    """Writes one shard's records in order, under another name until it is whole."""

    def __init__(self, target: str, shard: int, slots: int, length: int, total: int):
        self.files, root = fs.FileSystem.from_uri(target)
        self.files.create_dir(root, recursive=True)
        self.shard, self.next, self.end, self.size = shard, shard * slots, min(total, (shard + 1) * slots), 2 * length
        self.path = f"{target}/shard-{shard:06d}.bin"
        self._final, self._begin = f"{root}/shard-{shard:06d}.bin", shard * slots
        self._draft = f"{self._final}.{uuid.uuid4().hex}"
        self._out = self.files.open_output_stream(self._draft)

    def add(self, slot: int, data: bytes) -> int:
        if slot != self.next or len(data) != self.size:
            raise RuntimeError(f"slot {self.next} is missing or not whole")
        self._out.write(data)
        self.next += 1
        return (slot - self._begin) * self.size

    def close(self) -> None:
        self._out.close()
        if self.next != self.end:
            raise RuntimeError(f"slot {self.next} is missing")
        self.files.move(self._draft, self._final)


def read_slots(target: str, first: int, count: int, length: int = SEQUENCE, slots: int = SLOTS) -> np.ndarray:
    """Sequences first .. first + count - 1 from a folder of token files; fewer at the end."""
    files, root = fs.FileSystem.from_uri(target)
    out = []
    while count > 0:
        shard, at = divmod(first, slots)
        path = f"{root}/shard-{shard:06d}.bin"
        if files.get_file_info(path).type != fs.FileType.File:
            break
        with files.open_input_file(path) as source:
            n = min(count, slots - at, source.size() // (2 * length) - at)
            if n <= 0:
                break
            out.append(np.frombuffer(source.read_at(n * 2 * length, at * 2 * length), np.uint16).reshape(n, length))
        first, count = first + n, count - n
    return np.concatenate(out) if out else np.zeros((0, length), np.uint16)
