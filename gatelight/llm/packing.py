"""Packing texts into token windows of equal size by multiway differencing.

Every task tokenises its documents in order and closes a block when it holds about
``block_windows`` windows of tokens. Within a block, pieces of a full window stand alone;
the rest is dealt out by Karmarkar-Karp differencing over as many windows as the tokens
need: the two partial partitions with the largest imbalance are merged, the fullest windows
of one with the emptiest of the other, until one partition is left. Where one of its
windows exceeds the capacity, the number of windows rises by one and the block is dealt
anew. A document is cut at full windows, then into parts of at most a quarter of a window
(larger items leave sums too unequal to fill windows), and where a block ends.

There is no shuffle and no group: a hot source is spread as the input is, memory is bounded
by one block and the longest text, and a repeated task gives the same windows because the
order of a split is fixed.

Null texts are empty and hold the end id alone; null ids are carried; repeated rows are
packed one by one; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm.common import id_and_text, slices, texts_of
from gatelight.llm.word_ids import word_ids

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window (0 to ``windows`` - 1) of each item, sums as equal as multiway differencing makes them."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    # A partial partition: sums in descending order, and the cell of items behind each sum.
    # A cell is an item (below n) or the union of two older cells; -1 is an empty one.
    unions: list[tuple[int, int]] = []
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        sums, cells = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], cells[0] = sizes[i], i
        heap.append((-int(sizes[i]), len(heap), sums, cells))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums, cells = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        sums, facing = sums + other[::-1], more[::-1]
        both = (cells >= 0) & (facing >= 0)
        joined = np.where(cells >= 0, cells, facing)
        where = np.flatnonzero(both)
        if len(where):
            joined[where] = n + len(unions) + np.arange(len(where))
            unions += zip(cells[where].tolist(), facing[where].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, cells = sums[order], joined[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, cells))
        serial += 1
    window = np.full(n + len(unions), -1, np.int64)
    cells = heap[0][3]
    window[cells[cells >= 0]] = np.flatnonzero(cells >= 0)
    for k in range(len(unions) - 1, -1, -1):
        a, b = unions[k]
        window[a] = window[b] = window[n + k]
    return window[:n]


def fitted(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows, none above ``capacity``; no item may exceed it."""
    windows = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    while windows:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes, windows).max() <= capacity:
            return window, windows
        windows += 1
    return np.zeros(0, np.int64), 0


class _Packer:
    """Pieces of one task: collects a block, deals it out, numbers its windows."""

    def __init__(self, capacity: int, block_windows: int, slack: int, block_items: int, first: int) -> None:
        self.capacity, self.longest, self.items_most = capacity, max(1, capacity // 4), block_items
        self.block = block_windows * (capacity - slack)
        self.next_sequence = first
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            yield doc_id, at, self.capacity, total, self.next_sequence, 0, ids[4 * at : 4 * (at + self.capacity)]
            self.next_sequence += 1
            at += self.capacity
        while at < total:
            take = min(total - at, self.block - self.tokens, self.longest)
            self.waiting.append((doc_id, at, ids[4 * at : 4 * (at + take)], total))
            self.tokens += take
            at += take
            if self.tokens == self.block or len(self.waiting) == self.items_most:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        sizes = np.array([len(ids) // 4 for _, _, ids, _ in self.waiting], np.int64)
        window, windows = fitted(sizes, self.capacity)
        filled = [0] * windows
        for (doc_id, start, ids, total), w in zip(self.waiting, window.tolist()):
            yield doc_id, start, len(ids) // 4, total, self.next_sequence + w, filled[w], ids
            filled[w] += len(ids) // 4
        self.next_sequence += windows
        self.waiting, self.tokens = [], 0


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 2, block_windows: int = 256, slack: int = 2, block_items: int = 8192) -> DataFrame:
    """One row per piece: document, place in the document, window, place in the window, and its ids.

    ``slack`` is the room, in tokens a window, that a block leaves for unequal sums.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(tokenizer_file), np.array([end_id], "<u4").tobytes()
        packer = _Packer(capacity, block_windows, slack, block_items, TaskContext.get().partitionId() << 36)

        def rows() -> Iterator[tuple]:
            for batch in slices(batches, 256, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                    yield from packer.add(doc_id, own.encode(text) + end)
            yield from packer.close()

        held: list[tuple] = []
        for row in rows():
            held.append(row)
            if len(held) == 1024:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return id_and_text(docs).mapInArrow(work, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def packed_pieces(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, tokenizer_file).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
