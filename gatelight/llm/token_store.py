"""Token ids of a corpus in raw binary shards with constant-time access by document key.

A store is a folder in shared storage. Documents are ordered by key over range partitions;
each partition is one shard of two files:

``NNNNNNNN.ids``
    the ids of its documents back to back, little-endian, two or four bytes each
    as ``width`` says.
``NNNNNNNN.idx``
    the magic ``GLTS0001``; the counts (documents with a key, distinct keys, documents
    without one) as three uint64; ``width`` and the length of the hash as two uint64; a
    minimal perfect hash over the distinct keys; per slot a 32-bit fingerprint, the first
    row of the key and its number of rows; then per row the key and, for all rows and the
    end, the offset in ids.

A key is found by its slot, checked by its fingerprint and read by one seek. ``shards`` is
the table of shards with the number of ids before each. Files are written under a name of
their own and moved into place, so a repeated task replaces what a lost one left.

Null texts hold the end id alone. Documents with null ids come first and are reached by
reading in order, not by key. Documents that share a key keep all their rows (ordered by
text), found together under the key. An empty table makes an empty store. Any folder that
``pyarrow.fs`` opens will do.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatelight.llm.common import id_and_text, slices, texts_of
from gatelight.llm.perfect_hash import PerfectHash, mixed
from gatelight.llm.word_ids import word_ids

_MAGIC = b"GLTS0001"
_HEAD = struct.Struct("<8s5Q")
_NAMED = "shard int, n_docs long, n_tokens long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


def _open(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


@dataclass
class ShardIndex:
    """The index of one shard, as it is stored."""

    hash: PerfectHash
    fingerprints: np.ndarray
    first_row: np.ndarray
    row_count: np.ndarray
    keys: np.ndarray
    offsets: np.ndarray
    unkeyed: int
    width: int

    @classmethod
    def over(cls, keys: list[int | None], lengths: list[int], width: int) -> ShardIndex:
        unkeyed = sum(k is None for k in keys)
        own = np.array(keys[unkeyed:], np.int64)
        distinct, first, count = np.unique(own, return_index=True, return_counts=True)
        found = PerfectHash.over(distinct.view(np.uint64))
        slot = found.slots(distinct.view(np.uint64))
        fingerprints, first_row, row_count = np.zeros(len(slot), np.uint32), np.zeros(len(slot), np.uint64), np.zeros(len(slot), np.uint32)
        fingerprints[slot], first_row[slot], row_count[slot] = _fingerprints(distinct), first + unkeyed, count
        offsets = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(lengths, out=offsets[1:])
        return cls(found, fingerprints, first_row, row_count, own, offsets, unkeyed, width)

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for a key that is not there."""
        if not self.hash.size:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys.view(np.uint64))
        known = (slot >= 0) & (self.fingerprints[slot] == _fingerprints(keys))
        first = np.where(known, self.first_row[slot].astype(np.int64), 0)
        # The fingerprint rejects nearly all strangers, the stored key the rest.
        known[known] = self.keys[first[known] - self.unkeyed] == keys[known]
        return first, np.where(known, self.row_count[slot].astype(np.int64), 0)

    def to_bytes(self) -> bytes:
        found = self.hash.to_bytes()
        head = _HEAD.pack(_MAGIC, len(self.keys), self.hash.size, self.unkeyed, self.width, len(found))
        arrays = (self.fingerprints, "<u4"), (self.row_count, "<u4"), (self.first_row, "<u8"), (self.keys, "<i8"), (self.offsets, "<u8")
        return head + found + b"".join(np.ascontiguousarray(a, t).tobytes() for a, t in arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        magic, n_keyed, n_keys, unkeyed, width, size = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard index")
        at = _HEAD.size
        found, at = PerfectHash.from_bytes(data[at : at + size]), at + size
        parts = []
        for kind, n in (("<u4", n_keys), ("<u4", n_keys), ("<u8", n_keys), ("<i8", n_keyed), ("<u8", n_keyed + unkeyed + 1)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        fingerprints, row_count, first_row, keys, offsets = parts
        return cls(found, fingerprints, first_row, row_count, keys, offsets, unkeyed, width)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64), 0x5EED) >> np.uint64(32)).astype(np.uint32)


def _put(folder: str, name: str, write) -> None:
    """Writes a file under a name of its own, then moves it into place."""
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    draft = posixpath.join(path, f".{name}-{uuid.uuid4().hex}")
    with files.open_output_stream(draft) as out:
        write(out)
    files.move(draft, posixpath.join(path, name))


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2, docs_per_shard: int = 16_384) -> DataFrame:
    """Writes the store and returns its table of shards: ``shard``, ``n_docs``, ``n_tokens``, ``start``.

    There are at least as many shards as the session has cores, more as the table grows.
    Texts cross the network once, in their own form; ids are made where they are stored.
    """
    spark = docs.sparkSession
    shards = max(spark.sparkContext.defaultParallelism, -(-docs.count() // docs_per_shard))
    ordered = id_and_text(docs).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    wide = _vocabulary(tokenizer_file) > 1 << 16 or end_id >= 1 << 16

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        own, end = word_ids(tokenizer_file), np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        lengths: list[int] = []

        def payload(out) -> None:
            for batch in slices(batches, 256, "text"):
                coded = [own.encode(t) + end for t in texts_of(batch, "text")]
                keys.extend(batch.column("doc_id").to_pylist())
                lengths.extend(len(c) // 4 for c in coded)
                ids = np.frombuffer(b"".join(coded), "<u4")
                out.write((ids if wide else ids.astype("<u2")).tobytes())

        name = f"{shard:08d}"
        _put(folder, f"{name}.ids", payload)
        _put(folder, f"{name}.idx", lambda out: out.write(ShardIndex.over(keys, lengths, 4 if wide else 2).to_bytes()))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["shard", "n_docs", "n_tokens"])

    ordered.mapInArrow(work, _NAMED).write.parquet(f"{folder}/shards.parquet")
    return shards_of(spark, folder)


def _vocabulary(tokenizer_file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file).get_vocab_size()


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a store; ``start`` is the number of ids in all shards before. One row per shard, so the order is cheap."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    named = spark.read.schema(_NAMED).parquet(f"{folder}/shards.parquet")
    return named.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


class Shard:
    """One open shard: its index in memory, its ids on disk."""

    def __init__(self, folder: str, shard: int) -> None:
        files, path = _open(folder)
        with files.open_input_stream(posixpath.join(path, f"{shard:08d}.idx")) as file:
            self.index = ShardIndex.from_bytes(file.read())
        self.ids = files.open_input_file(posixpath.join(path, f"{shard:08d}.ids"))

    def read(self, row: int, rows: int = 1) -> list[bytes]:
        """The ids of neighbouring rows as little-endian uint32, with one read."""
        width, ends = self.index.width, self.index.offsets[row : row + rows + 1].astype(np.int64)
        self.ids.seek(int(ends[0]) * width)
        data = np.frombuffer(self.ids.read(int(ends[-1] - ends[0]) * width), f"<u{width}").astype("<u4")
        return [data[a:b].tobytes() for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]

    def get(self, key: int) -> list[bytes]:
        """The ids of every document with this key; none if it is not in the shard."""
        first, count = self.index.rows(np.array([key], np.int64))
        return self.read(int(first[0]), int(count[0])) if count[0] else []


def read(spark: SparkSession, folder: str, chunk: int = 2 << 20) -> DataFrame:
    """Every document of a store, found by its key: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian uint32).

    A task holds one shard's index and about ``chunk`` ids, or one document if that is longer.
    """
    shards = shards_of(spark, folder)
    parts = max(1, min(shards.count(), 100_000))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                yield from _documents(Shard(folder, number), start, chunk)

    return shards.select("shard", "start").repartitionByRange(parts, "shard").mapInArrow(work, TOKENS)


def _documents(shard: Shard, start: int, chunk: int) -> Iterator[pa.RecordBatch]:
    index = shard.index
    rows = len(index.keys) + index.unkeyed
    # Rows by key: each distinct key is looked up, and gives its rows.
    keys = np.unique(index.keys)
    first, count = index.rows(keys)
    if len(keys) and (int(count.sum()) != len(index.keys) or (count == 0).any()):
        raise ValueError("the index misses keys it holds")
    of_row: list[int | None] = [None] * index.unkeyed + [None] * len(index.keys)
    for key, f, n in zip(keys.tolist(), first.tolist(), count.tolist()):
        of_row[f : f + n] = [key] * n
    at = 0
    while at < rows:
        until = int(np.searchsorted(index.offsets, index.offsets[at] + np.uint64(chunk), side="right")) - 1
        until = min(max(until, at + 1), rows, at + 8192)
        ids = shard.read(at, until - at)
        offsets = index.offsets[at:until].astype(np.int64) + start
        arrays = [pa.array(of_row[at:until], pa.int64()), pa.array(offsets), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])
        at = until


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """The ids of the given keys: keys meet the range of one shard each and are read by seeks.

    The ranges are one row a shard; keys outside every range or absent give no row.
    """
    spark = keys.sparkSession
    shards = shards_of(spark, folder)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("shard").to_pylist():
                own = Shard(folder, number).index.keys
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([own[0]]), pa.array([own[-1]])], ["shard", "low", "high"])

    bounds = [tuple(r) for r in shards.select("shard").mapInArrow(ranges, "shard int, low long, high long").orderBy("low", "shard").collect()]
    lows, highs, numbers = (np.array([b[i] for b in bounds], np.int64) for i in (1, 2, 0))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("key").drop_null().to_numpy(zero_copy_only=False)
            # Equal keys may straddle neighbouring shards.
            a, b = np.searchsorted(highs, asked, "left"), np.searchsorted(lows, asked, "right")
            count = np.maximum(b - a, 0)
            place = np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[place].astype(np.int32)), pa.array(np.repeat(asked, count))], ["shard", "key"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: Shard | None = None
        number = None
        for batch in batches:
            out_keys, out_ids = [], []
            for shard, asked in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist()):
                if shard != number:
                    opened, number = Shard(folder, shard), shard
                for ids in opened.get(asked):
                    out_keys.append(asked)
                    out_ids.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.int64()), pa.array(out_ids, pa.binary())], ["doc_id", "ids"])

    asked = keys.select(F.col(key).cast("long").alias("key")).distinct().mapInArrow(route, "shard int, key long")
    return asked.repartition("shard", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("shard").mapInArrow(fetch, "doc_id long, ids binary")


def stored_documents(docs: DataFrame, folder: str, tokenizer_file: str) -> DataFrame:
    """Writes the store and reads every document back, with the checksum of its ids."""
    write(docs, folder, tokenizer_file)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
