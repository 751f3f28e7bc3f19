"""Postings of sparse vectors with block maxima, and exact top-k by upper bounds.

The chunk store is indexed in shards of bounded size. A shard keeps, for every token, the
chunks that hold it in order of their place, their weights, and the largest weight of every
block of postings. A question reads the lists of its own tokens, from the one that can add
most to the one that can add least. Once the lists left cannot lift a new chunk over the
k-th best score so far, they are only looked up for chunks that still have a chance, block by
block (MaxScore: Turtle and Flood, 1995; block maxima: Ding and Suel, 2011). The result is
exact, and only ``k`` rows of a question leave a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.sources.shared import stored_blocks

SHARD_CHUNKS = 16_384
BLOCK = 64
QUESTIONS_PER_BLOCK = 1_024
#: The row of a shard that lists its chunks instead of a token's postings.
CHUNKS = -1
#: Scores are rounded to nine digits before they are ranked, so bounds give way by more than that.
_SLACK = 1e-8
_TABLE = "shard long, token_id int, places binary, weights binary, most binary, documents array<string>, indexes array<int>, levels array<int>"


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _binaries(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The bytes of consecutive parts of an array, which end at ``stops``, and a null behind them."""
    offsets = np.append(0, stops * data.itemsize).astype(np.int32)
    return pa.concat_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]), pa.array([None], pa.binary())])


def _shard_rows(table: pa.Table, shard: int) -> pa.RecordBatch:
    vectors = _one(table.column("sparse"))
    lengths, flat = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), vectors.flatten()
    ids, weights = flat.field("i").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False).astype(np.float64)
    place = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    sound = np.isfinite(weights) & (weights > 0) & ~np.isnan(ids.astype(np.float64))
    ids, weights, place = ids[sound].astype(np.int32), weights[sound], place[sound]
    order = np.lexsort((place, ids))
    ids, weights, place = ids[order], weights[order], place[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    n = len(starts)
    ends = np.append(starts[1:], len(ids))[:n]
    blocks = -(-(ends - starts) // BLOCK)
    stops = np.cumsum(blocks)
    begins = np.repeat(starts - BLOCK * (stops - blocks), blocks) + BLOCK * np.arange(blocks.sum())
    most = np.maximum.reduceat(weights, begins) if n else weights
    lists = [[None] * n + [_one(table.column(c)).to_pylist()] for c in ("document_id", "chunk_index", "access_level")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, shard)), pa.array(np.append(ids[starts], CHUNKS).astype(np.int32)),
            _binaries(place, ends), _binaries(weights, ends), _binaries(most, stops),
            pa.array(lists[0], pa.list_(pa.string())), pa.array(lists[1], pa.list_(pa.int32())), pa.array(lists[2], pa.list_(pa.int32())),
        ],
        ["shard", "token_id", "places", "weights", "most", "documents", "indexes", "levels"],
    )


def build_postings(chunks: DataFrame, shard_chunks: int = SHARD_CHUNKS) -> DataFrame:
    """The postings table of searchable chunks (document_id, chunk_index, access_level, sparse).

    Chunks are indexed where they are read: nothing is shuffled. Save the result: shards are
    numbered as tasks come upon them. Weights that are null, not finite or not positive are no postings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_chunks - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == shard_chunks:
                    yield _shard_rows(pa.Table.from_batches(held), shard)
                    shard, held, n = shard + 1, [], 0
        if n:
            yield _shard_rows(pa.Table.from_batches(held), shard)

    columns = ["document_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("access_level").cast("int").alias("access_level"), "sparse"]
    return chunks.select(*columns).mapInArrow(run, _TABLE)


class Shard:
    """The posting lists of some tokens over the chunks of one shard."""

    def __init__(self, lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], levels: np.ndarray) -> None:
        self.lists, self.levels = lists, levels
        #: Postings read or looked up so far.
        self.read = 0

    @classmethod
    def of(cls, rows: list[dict]) -> tuple[Shard, list[str], list[int]]:
        (chunks,) = [r for r in rows if r["token_id"] == CHUNKS]
        lists = {r["token_id"]: (np.frombuffer(r["places"], "<i4"), np.frombuffer(r["weights"], "<f8"), np.frombuffer(r["most"], "<f8")) for r in rows if r["token_id"] != CHUNKS}
        return cls(lists, np.array(chunks["levels"], np.float64)), chunks["documents"], chunks["indexes"]

    def _add(self, token: int, weight: float, places: np.ndarray, sums: np.ndarray, needed: np.ndarray | None = None) -> None:
        """Adds a list's weights to the sums of these places; ``needed``: what a place still lacks, as blocks below it are skipped."""
        held, weights, most = self.lists[token]
        at = np.searchsorted(held, places)
        there = at < len(held)
        if needed is not None:
            there &= weight * most[np.minimum(at, len(held) - 1) // BLOCK] >= needed
        at, where = at[there], np.flatnonzero(there)
        self.read += len(at)
        hit = held[at] == places[where]
        sums[where[hit]] += weight * weights[at[hit]]

    def best(self, tokens: np.ndarray, weights: np.ndarray, level: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of every chunk that may be among the ``k`` best, permitted at ``level``; scores are whole."""
        known = [i for i, t in enumerate(tokens.tolist()) if t in self.lists and weights[i] > 0]
        bounds = {i: float(weights[i] * self.lists[int(tokens[i])][2].max()) for i in known}
        known.sort(key=lambda i: -bounds[i])
        rest = np.append(np.cumsum([bounds[i] for i in reversed(known)])[::-1], 0.0)  # what lists from here on can add
        sums = np.where(self.levels <= level, 0.0, -np.inf)
        least, n = 0.0, 0
        for n, i in enumerate(known):
            if least > 0 and rest[n] < least - _SLACK:
                break  # these lists alone make no chunk one of the best
            held, values, _ = self.lists[int(tokens[i])]
            sums[held] += weights[i] * values
            self.read += len(held)
            if len(sums) > k:
                # Sums only grow, so the k-th best is among those above the one before.
                above = sums[sums > least]
                if len(above) >= k:
                    least = float(np.partition(above, len(above) - k)[len(above) - k])
        else:
            n = len(known)
        places = np.flatnonzero((sums > 0) & (sums + rest[n] >= least - _SLACK))
        partial = sums[places]
        for m in range(n, len(known)):
            i = known[m]
            needed = least - _SLACK - partial - rest[m + 1]
            self._add(int(tokens[i]), float(weights[i]), places, partial, needed)
            alive = partial + rest[m + 1] >= least - _SLACK
            places, partial = places[alive], partial[alive]
        # Once more for the few that are left, in the order of the tokens: sums do not depend on the way they were found.
        scores = np.zeros(len(places))
        for i in sorted(known, key=lambda i: int(tokens[i])):
            self._add(int(tokens[i]), float(weights[i]), places, scores)
        return places, scores


def search(questions_at: str, questions: DataFrame, postings: DataFrame, k: int, ranked: Callable, out: str) -> DataFrame:
    """Top ``k`` chunks of each question in each shard.

    ``questions`` (question_id, user_access_level, sparse) stand at ``questions_at`` too, from where every shard
    streams them. Only lists of tokens that some question holds are handed to the shards.
    ``ranked(ids, question, scores, documents, indexes)`` cuts the found rows of a block to the best and names them as ``out`` does.
    """
    no_token = questions.sparkSession.range(1).select(F.lit(CHUNKS).alias("token_id"))
    asked = questions.select(F.explode("sparse.i").alias("token_id")).distinct().unionByName(no_token)

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, documents, indexes = Shard.of([row for batch in batches for row in batch.to_pylist()])
        documents, indexes = np.array(documents, dtype=object), np.array(indexes)
        for block in stored_blocks(questions_at, ["question_id", "user_access_level", "sparse"], QUESTIONS_PER_BLOCK):
            found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            vectors = _one(block.column("sparse"))
            stops, flat = np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), vectors.flatten()
            tokens, weights = flat.field("i").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False).astype(np.float64)
            for n, (level, a, b) in enumerate(zip(block.column("user_access_level").to_pylist(), [0, *stops[:-1].tolist()], stops.tolist())):
                if level is not None and a < b:
                    places, scores = shard.best(tokens[a:b], weights[a:b], level, k)
                    for part, value in zip(found, (np.full(len(places), n), places, scores)):
                        part.append(value)
            question, places, scores = map(np.concatenate, found)
            if len(places):
                yield ranked(np.array(block.column("question_id").to_pylist(), dtype=object), question, scores, documents[places], indexes[places])

    return postings.join(asked, "token_id", "left_semi").groupBy("shard").applyInArrow(run, out)
