"""Exact top-k of chunks per question, for any number of questions.

Questions are written once to the shared folder. A task holds a bounded batch of chunks (or
one shard of postings) and streams the questions past it, block by block, so nothing is
replicated by a shuffle and the plan is the same for ten questions and for ten million. Only
the k best rows of a question leave a batch: no pair of question and chunk becomes a row, and
a token that occurs in every chunk costs no rows more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.operators import postings as pl
from gatelight.operators.vectors import folded
from gatelight.session import saved
from gatelight.sources.shared import stored_blocks

# Chunks held by a task at once, questions that stream past them at once, and chunks scored at once.
CHUNKS_HELD = 16_384
QUESTIONS_PER_BLOCK = 1_024
CHUNKS_PER_STEP = 2_048
# Places a question's rows from all tasks are first merged in.
MERGE_SALTS = 32

_OUT = "leg string, question_id string, document_id string, chunk_index int, score double"


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths, column.flatten()


def _one(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks) if table.num_rows else table.column(name).combine_chunks()


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Nine digits, halves away from zero as SQL rounds them; never a negative zero."""
    scaled = scores * 1e9
    return np.trunc(scaled + np.copysign(0.5, scaled)) / 1e9 + 0.0


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors for each vector length; every row counts by its own length. Vectors with null or odd numbers are none."""
    lengths, flat = _flat(column)
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        vectors = numbers[starts[rows][:, None] + np.arange(length)]
        sound = np.isfinite(vectors).all(axis=1)
        out[length] = (rows[sound], _unit(vectors[sound]))
    return out


class _Best:
    """Running top-k per question: score down, then document_id and chunk_index up."""

    def __init__(self, questions: int, k: int):
        self.k, self.floor = k, np.full(questions, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.held, self.limit = 0, max(4 * k * questions, 4096)

    def add(self, scores: np.ndarray, documents: np.ndarray, indexes: np.ndarray) -> None:
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            self.floor = np.maximum(self.floor, kth)
        row, question = np.nonzero((scores >= self.floor) & np.isfinite(scores))
        if len(row):
            self.parts.append(
                pd.DataFrame(
                    {"q": question, "score": scores[row, question], "d": documents[row], "c": indexes[row]}
                )
            )
            self.held += len(row)
            if self.held > self.limit:
                self._cut()

    @staticmethod
    def cut(rows: pd.DataFrame, k: int) -> pd.DataFrame:
        best = rows.sort_values(["q", "score", "d", "c"], ascending=[True, False, True, True])
        return best[best.groupby("q").cumcount() < k]

    def _cut(self) -> None:
        best = self.cut(pd.concat(self.parts, ignore_index=True), self.k)
        full = best[best.groupby("q").cumcount() == self.k - 1]
        self.floor[full["q"].to_numpy()] = np.maximum(self.floor[full["q"].to_numpy()], full["score"].to_numpy())
        self.parts, self.held = [best], len(best)
        self.limit = max(self.limit, 2 * self.held)

    def result(self, leg: str, ids: np.ndarray) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        self._cut()
        return self.rows(leg, ids, self.parts[0])

    @staticmethod
    def rows(leg: str, ids: np.ndarray, best: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([leg] * len(best), pa.string()),
                pa.array(ids[best["q"].to_numpy()], pa.string()),
                pa.array(best["d"], pa.string()),
                pa.array(best["c"].to_numpy(), pa.int32()),
                pa.array(best["score"].to_numpy(), pa.float64()),
            ],
            names=["leg", "question_id", "document_id", "chunk_index", "score"],
        )


def _ranked(leg: str, k: int):
    def cut(ids: np.ndarray, question: np.ndarray, scores: np.ndarray, documents: np.ndarray, indexes: np.ndarray) -> pa.RecordBatch:
        """The ``k`` best rows of each question."""
        rows = pd.DataFrame({"q": question, "score": _rounded(scores), "d": documents, "c": indexes})
        return _Best.rows(leg, ids, _Best.cut(rows, k))

    return cut


def _dense_best(held: pa.Table, questions_at: str, k: int) -> Iterator[pa.RecordBatch]:
    """Every block of questions past the held chunks; every vector is compared with those of its own length."""
    documents, indexes = np.array(held.column("document_id").to_pylist(), dtype=object), _numbers(held.column("chunk_index"))
    levels, vectors = _numbers(held.column("access_level")).astype(np.float64), _by_length(_one(held, "dense"))
    for block in stored_blocks(questions_at, ["question_id", "user_access_level", "dense"], QUESTIONS_PER_BLOCK):
        allowed = _numbers(_one(block, "user_access_level")).astype(np.float64)
        best = _Best(len(allowed), k)
        for length, (asked, wanted) in _by_length(_one(block, "dense")).items():
            rows, units = vectors.get(length, (np.zeros(0, np.int64), None))
            for at in range(0, len(rows), CHUNKS_PER_STEP):
                some = rows[at : at + CHUNKS_PER_STEP]
                scores = np.full((len(some), len(allowed)), -np.inf)
                scores[:, asked] = _rounded(units[at : at + CHUNKS_PER_STEP] @ wanted.T)
                # A level that is not known is barred, on either side.
                scores[~(levels[some][:, None] <= allowed[None, :])] = -np.inf
                best.add(scores, documents[some], indexes[some])
        out = best.result("dense", np.array(block.column("question_id").to_pylist(), dtype=object))
        if out is not None:
            yield out


def _dense_leg(questions_at: str, chunks: DataFrame, k: int) -> DataFrame:
    given = "dense" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, min(CHUNKS_HELD - n, CHUNKS_PER_STEP))
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                # Folded here and not by a worker of its own, which every task would hold beside this one.
                held.append(part if given else folded(part).drop_columns(["sparse"]))
                if n == CHUNKS_HELD:
                    yield from _dense_best(pa.Table.from_batches(held), questions_at, k)
                    held, n = [], 0
        if n:
            yield from _dense_best(pa.Table.from_batches(held), questions_at, k)

    return chunks.select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("access_level").cast("int").alias("access_level"), "dense" if given else "sparse").mapInArrow(run, _OUT)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark cuts to k in every task before it shuffles."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def best_first(*before: Column) -> list[Column]:
    """Order of hits: score down, ties by key so that every run agrees."""
    return [*before, F.col("score").desc(), F.col("document_id").asc(), F.col("chunk_index").asc()]


def nearest_chunks(
    questions: DataFrame, chunks: DataFrame, k: int, legs: tuple[str, ...] = ("dense", "sparse"), postings: DataFrame | None = None
) -> DataFrame:
    """Top ``k`` chunks per question and leg: cosine over ``dense``, dot product over ``sparse``.

    ``questions``: question_id, user_access_level and the leg columns; ``chunks``:
    document_id, chunk_index, access_level and the leg columns, already filtered to
    searchable rows. Chunks without a ``dense`` column are compared by the folding of their
    sparse one (:func:`vectors.folded`). A chunk above the user's level never enters a ranking. ``postings``
    is the stored index of the chunks' sparse vectors (:func:`postings.build_postings`);
    without it one is built and stored for this call. Sparse weights count where positive.
    Result: leg, question_id, document_id, chunk_index, score (9 digits), rank.
    """
    if getattr(questions, "saved_at", None) is None:
        questions = saved(stored_questions(questions, legs))
    found = []
    if "dense" in legs:
        found.append(_dense_leg(questions.saved_at, chunks, k))
    if "sparse" in legs:
        table = saved(pl.build_postings(chunks)) if postings is None else postings
        found.append(pl.search(questions.saved_at, questions, table, k, _ranked("sparse", k), _OUT))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # Rows of one question come from every task: cut in salted places first, then in one.
    salted = both.withColumn("_salt", F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(MERGE_SALTS)))
    some = top_k(salted, ["leg", "question_id", "_salt"], best_first(), k, "_place").drop("_salt", "_place")
    return top_k(some, ["leg", "question_id"], best_first(), k)


def stored_questions(questions: DataFrame, legs: tuple[str, ...], *others: str) -> DataFrame:
    """The columns of a question that a search reads, in the types it reads them in."""
    return questions.select(F.col("question_id").cast("string").alias("question_id"), F.col("user_access_level").cast("int").alias("user_access_level"), *legs, *others)


def odd_vectors(questions: DataFrame, chunks: DataFrame, vector: str = "dense") -> DataFrame:
    """Chunks no question can be compared with, as error rows: document_id, chunk_index, length.

    Their vector has another length than every question's, is missing, or holds a null or non-finite number.
    """
    known = questions.select(F.size(vector).alias("length")).distinct()
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = chunks.select("document_id", "chunk_index", F.coalesce(F.size(vector), F.lit(-1)).alias("length"), F.coalesce(odd, F.lit(True)).alias("_odd"))
    there = known.withColumn("_known", F.lit(True))
    return rows.join(there, "length", "left").filter(F.col("_known").isNull() | F.col("_odd")).select("document_id", "chunk_index", "length")
