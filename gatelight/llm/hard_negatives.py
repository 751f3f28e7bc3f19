"""Hard negatives by threshold joins over an inverted index with bounded prefixes.

For every anchor row the highest-scoring other rows of its label are its positives, and for
each positive the best rows of other labels whose score lies in a window below the
positive's score are its hard negatives. Scores are integer inner products.

1. Rows that take part get a row number and are written once; anchors are read back from
   that table, so a row and its copy in the anchors carry the same number.
2. Rows stay where they are. A task holds up to ``rows_held`` rows and streams all anchors
   past them, block by block, from the shared folder: nothing is replicated or shuffled.
3. For a threshold, the held rows are indexed: dimensions stand in order of their weight,
   lightest first, and a row leaves out its first dimensions as long as the norm of that
   prefix times the largest such norm of the block's anchors is below the threshold: no
   pair can reach it by them alone. Rows are sorted by what they leave out, so the posting
   list of a dimension is the front part of the sorted rows.
4. Partial scores are summed over the posting lists from the last dimension down. A pair is
   dropped as soon as its sum plus the product of the remaining norms is below the
   threshold; what a row left out is added for the pairs that remain.
5. Anchors whose windows hold fewer than ``k`` rows come again with a lower threshold, until
   each is full or the threshold has passed its lower end.
6. At most ``k`` rows for each window leave a task; Spark merges them.

Rows with a null id, label or vector, or with a null or non-finite component, take no part,
nor do rows whose squared length reaches 2**62, as their scores could pass 64 bits. Vectors
meet only vectors of their own length; empty ones score 0. Rows that share an id are rows of
their own. Anchors without positives, and positives without rows in their window, give no
rows; so does an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.llm.common import new_folder
from gatelight.sources.shared import stored_blocks

ROWS_HELD = 65_536
ROWS_INDEXED = 4_096
ANCHORS_READ = 1_024
ANCHORS_JOINED = 64
DIMENSIONS_AT_ONCE = 8
#: Share of pairs above which partial scores are summed as a matrix, below it pair by pair.
FEW_PAIRS = 1 / 16
_FOUND = "anchor_row long, place int, vec_id long, score long"


def participants(rows: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; each component x of ``v`` is floor(``scale`` * x), x as double."""
    given = rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = given.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(sound)
    squares = F.aggregate("x", F.lit(0.0), lambda total, x: total + F.pow(F.rint(x * float(scale) - 0.5), F.lit(2)))
    return whole.filter(squares < float(1 << 62)).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * float(scale))).alias("v"))


@dataclass
class _Rows:
    """Rows of one vector length, with the norms of every prefix of their dimensions."""

    ids: np.ndarray
    row: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norms: np.ndarray  # of the first 0, 8, 16 ... dimensions

    @classmethod
    def of(cls, ids: np.ndarray, row: np.ndarray, label: np.ndarray, v: np.ndarray) -> _Rows:
        cuts = _cuts(v.shape[1])
        squares = np.zeros((len(v), len(cuts)))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
            squares[:, i] = squares[:, i - 1] + (v[:, a:b].astype(np.float64) ** 2).sum(axis=1)
        return cls(ids, row, label, v, np.sqrt(squares))

    def some(self, which) -> _Rows:
        return _Rows(self.ids[which], self.row[which], self.label[which], self.v[which], self.norms[which])


def _cuts(dimensions: int) -> list[int]:
    return [*range(0, dimensions, DIMENSIONS_AT_ONCE), dimensions]


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length."""
    column = table.column("v").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    found = {}
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        found[length] = at, flat[starts[at][:, None] + np.arange(length)].astype(np.int64)
    return found


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class Index:
    """An inverted index of rows for scores from ``threshold`` on, against anchors with these largest prefix norms."""

    def __init__(self, rows: _Rows, threshold: float, anchor_norms: np.ndarray) -> None:
        together = rows.norms * anchor_norms
        # The longest prefix that cannot reach the threshold alone, in steps of dimensions.
        self.left_out = np.clip((together * (1 + 1e-12) + 1 < threshold).sum(axis=1) - 1, 0, None)
        order = np.argsort(self.left_out, kind="stable")
        self.rows, self.left_out, self.cuts = rows.some(order), self.left_out[order], _cuts(rows.v.shape[1])
        #: The posting lists of a step of dimensions hold the first so many rows.
        self.postings = np.searchsorted(self.left_out, np.arange(len(self.cuts) - 1), side="right")

    def join(self, anchors: _Rows, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of every pair whose score reaches the anchor's threshold."""
        rows, steps = self.rows, len(self.cuts) - 1
        n = int(self.postings[-1]) if steps else len(rows.ids)
        reach = float(anchors.norms[:, -1].max(initial=0)) * float(rows.norms[:, -1].max(initial=0))
        kind, slack = (np.float64 if reach < 1 << 52 else np.int64), 1 + 1e-12 * reach  # scores are exact in either kind
        q, x = anchors.v.astype(kind), rows.v[:n].astype(kind)
        sums, at, summed_from = np.zeros((len(q), n), kind), np.arange(n), np.full(n, steps)
        for step in reversed(range(steps)):
            a, b, listed = self.cuts[step], self.cuts[step + 1], int(self.postings[step])
            sums[:, :listed] += q[:, a:b] @ x[:listed, a:b].T
            summed_from[:listed] = step
            alive = sums + anchors.norms[:, summed_from] * rows.norms[at, summed_from] + slack >= threshold[:, None]
            if np.count_nonzero(alive) < FEW_PAIRS * alive.size:
                break
        else:
            alive = sums + anchors.norms[:, summed_from] * rows.norms[at, summed_from] + slack >= threshold[:, None]
        i, j = np.nonzero(alive)
        score, open_from = sums[i, j], summed_from[j]
        for step in reversed(range(steps)):
            todo = np.flatnonzero(open_from > step)
            if not len(todo):
                continue
            a, b = self.cuts[step], self.cuts[step + 1]
            score[todo] += np.einsum("pd,pd->p", q[i[todo], a:b], x[j[todo], a:b])
            open_from[todo] = step
            keep = score + anchors.norms[i, open_from] * rows.norms[j, open_from] + slack >= threshold[i]
            i, j, score, open_from = i[keep], j[keep], score[keep], open_from[keep]
        keep = score >= threshold[i]
        return i[keep], j[keep], score[keep].astype(np.int64)


def _best_in_windows(held: list[_Rows], anchors: _Rows, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[np.ndarray]:
    """(anchor, place of the window, id, score): the best ``k`` rows of each window among those held; NaN ends no window."""
    most = max((float(r.norms[:, -1].max(initial=0)) for r in held), default=0.0)
    bound = np.ceil(anchors.norms[:, -1] * most) + 1
    low, high = np.maximum(low, -bound[:, None]), np.minimum(high, bound[:, None])
    with np.errstate(invalid="ignore"):
        first, last = np.nanmax(high, axis=1), np.nanmin(low, axis=1)
    width = np.maximum(np.abs(first) / 8, 16)
    out, open_ = [], np.flatnonzero(first >= last)
    while len(open_):
        threshold = np.maximum(first[open_] - width[open_], last[open_])
        some = anchors.some(open_)
        found = [np.zeros((4, 0), np.int64)]
        for rows in held:
            index = Index(rows, float(threshold.min()), some.norms.max(axis=0))
            i, j, score = index.join(some, threshold)
            fits = ((index.rows.label[j] == some.label[i]) == same) & (index.rows.row[j] != some.row[i])
            i, j, score = i[fits], j[fits], score[fits]
            for w in range(low.shape[1]):
                inside = (score >= low[open_[i], w]) & (score <= high[open_[i], w])
                found.append(np.stack([i[inside], np.full(inside.sum(), w), index.rows.ids[j[inside]], score[inside]]))
        i, w, ids, score = np.concatenate(found, axis=1)
        order = np.lexsort((ids, -score, w, i))
        i, w, ids, score = i[order], w[order], ids[order], score[order]
        group = i * low.shape[1] + w
        counts = np.bincount(group, minlength=len(open_) * low.shape[1])
        place = np.arange(len(group)) - (np.cumsum(counts) - counts)[group]
        full = (counts.reshape(len(open_), -1) >= k) | (threshold[:, None] <= low[open_]) | np.isnan(low[open_])
        done = full.all(axis=1)
        kept = done[i] & (place < k)
        out.append(np.stack([anchors.row[open_[i[kept]]], w[kept], ids[kept], score[kept]]))
        open_ = open_[~done]
        width[open_] *= 2
    return out


def _nearest(rows: DataFrame, anchors_at: str, columns: list[str], k: int, same: bool, rows_held: int) -> DataFrame:
    """The best ``k`` rows of each window of each stored anchor, cut in every task; ``low`` and ``high`` may be missing."""

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[_Rows]] = {}
        for length, (at, v) in _by_length(table).items():
            lightest = np.argsort((v.astype(np.float64) ** 2).sum(axis=0), kind="stable")
            whole = _Rows.of(_numbers(table, "vec_id")[at], _numbers(table, "row")[at], _numbers(table, "label")[at], v[:, lightest])
            held[length] = lightest, [whole.some(slice(a, a + ROWS_INDEXED)) for a in range(0, len(at), ROWS_INDEXED)]
        for block in stored_blocks(anchors_at, columns, ANCHORS_READ):
            for length, (at, v) in _by_length(block).items():
                if length not in held:
                    continue
                lightest, parts = held[length]
                anchors = _Rows.of(_numbers(block, "vec_id")[at], _numbers(block, "row")[at], _numbers(block, "label")[at], v[:, lightest])
                if "low" in columns:
                    low, high = (_windows(block, c)[at] for c in ("low", "high"))
                else:
                    low, high = np.full((len(at), 1), -np.inf), np.full((len(at), 1), np.inf)
                for a in range(0, len(at), ANCHORS_JOINED):
                    some = slice(a, a + ANCHORS_JOINED)
                    for found in _best_in_windows(parts, anchors.some(some), low[some], high[some], k, same):
                        if found.shape[1]:
                            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3])], ["anchor_row", "place", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            if n and n + batch.num_rows > rows_held:
                yield from search(pa.Table.from_batches(waiting))
                waiting, n = [], 0
            waiting.append(batch)
            n += batch.num_rows
        if n:
            yield from search(pa.Table.from_batches(waiting))

    best = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), "vec_id")
    return rows.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _windows(block: pa.Table, name: str) -> np.ndarray:
    """The ends of each anchor's windows, side by side, NaN where an anchor has fewer."""
    lists = block.column(name).to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), np.nan)
    for i, ends in enumerate(lists):
        out[i, : len(ends)] = ends
    return out


def mined(
    rows: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 10,
    lowest: int = 30, highest: int = 90, rows_held: int = ROWS_HELD, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """For each anchor (``anchor`` tests ``vec_id``) and positive its best negatives with
    ``lowest`` * positive_score <= 100 * negative_score <= ``highest`` * positive_score."""
    spark = rows.sparkSession
    numbered_at, windows_at = new_folder(spark, "rows"), new_folder(spark, "anchor-windows")
    participants(rows, label, key, vector).withColumn("row", F.monotonically_increasing_id()).write.parquet(numbered_at)
    numbered = spark.read.parquet(numbered_at)
    anchors_at = new_folder(spark, "anchors")
    numbered.filter(anchor).write.parquet(anchors_at)
    anchors = spark.read.parquet(anchors_at)
    columns = ["row", "vec_id", "label", "v"]
    near = _nearest(numbered, anchors_at, columns, positives, True, rows_held)
    window = F.struct(
        F.col("rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        # Whole scores between the two shares: the lower end rounded up, the upper one down.
        F.ceil(F.col("score").cast("decimal(20,0)") * lowest / 100).cast("long").alias("low"),
        F.floor(F.col("score").cast("decimal(20,0)") * highest / 100).cast("long").alias("high"),
    )
    windows = near.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(window)).alias("windows"))
    asked = anchors.join(windows, "row").select(*columns, "windows", F.col("windows.low").alias("low"), F.col("windows.high").alias("high"))
    asked.write.parquet(windows_at)
    asked = spark.read.parquet(windows_at)
    found = _nearest(numbered, windows_at, [*columns, "low", "high"], negatives, False, rows_held)
    named = asked.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("place", "w"))
    return found.join(named, ["anchor_row", "place"]).select(
        "anchor_id", "w.positive_id", "rank", F.col("vec_id").alias("negative_id"), "w.positive_score", F.col("score").alias("negative_score")
    )


def mined_of_every_hundredth(rows: DataFrame) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the label is one further, after 9 comes 0."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows, label, F.col("vec_id") % 100 == 0)


MINED_SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM given),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""
