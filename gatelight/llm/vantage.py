"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt over shards of bounded size by a hash of their id, so copies of one
vector are spread. Each shard becomes one tree: a node splits its vectors at the median
distance to a vantage point and keeps, for either side, the smallest and largest distance;
equal vectors are one point with several ids. By the triangle inequality the distance from
a query to the vantage points bounds its distance to every leaf. A query first scans its
most promising leaf, then every leaf whose bound times ``factor`` does not exceed its k-th
distance so far. ``factor`` 1 is exact search; larger values skip more leaves.

Trees and queries meet shard by shard in sorted order: a task holds one tree while blocks
of queries stream past it. Every shard sees every query, as an exact search must; each
gives back k rows a query, cut to k again before and after the shuffle.

Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
rows without an id. Vectors of another length than the query's are no candidates. Rows that
share an id are several candidates; as a query an id stands once, with its smallest vector.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatelight.llm.common import written

LEAF = 64
_ROW = "dim int, shard int, tag int, ids array<long>, data binary"


class Tree:
    """Points in leaf order with their ids, and the nodes above the leaves.

    ``nodes`` has, for each node, its vantage point's place and the ranges of distances
    (low, high) on its near and far side; ``leaves`` has the first place and the end of each
    leaf; ``paths`` lists for every leaf the (node, side) pairs above it.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        whole = np.ascontiguousarray(vectors, np.float64) + 0.0
        rows = whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel()
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        by = np.lexsort((ids, group.ravel()))
        self.all_ids, self.starts = ids[by], np.append(np.searchsorted(group.ravel()[by], np.arange(len(first))), len(ids))
        # For each group its ids in order, as keys of group and number of the id.
        self.known = np.unique(ids)
        self.keys = group.ravel()[by] * len(self.known) + np.searchsorted(self.known, self.all_ids)
        self.lone = self.all_ids[self.starts[:-1]] == self.all_ids[self.starts[1:] - 1]
        points = whole[first]
        order, self.vantage, self.bounds, self.leaves, self.paths = np.arange(len(points)), [], [], [], []
        todo = [(0, len(points), [])]
        while todo:
            low, high, path = todo.pop()
            if high - low <= LEAF:
                self.leaves.append((low, high))
                self.paths.append(path)
                continue
            own = order[low:high]
            point = points[own[0]]
            # The far end of a fixed start makes a wide spread.
            point = points[own[np.argmax(_distances(points[own], point))]]
            away = _distances(points[own], point)
            by_distance = np.argsort(away, kind="stable")
            order[low:high], away = own[by_distance], away[by_distance]
            middle = (high - low) // 2
            node = len(self.vantage)
            self.vantage.append(point)
            self.bounds.append((away[0], away[middle - 1], away[middle], away[-1]))
            todo += [(low, low + middle, [*path, (node, 0)]), (low + middle, high, [*path, (node, 1)])]
        self.points, self.place = points[order], order
        self.norms = (self.points**2).sum(axis=1)
        self.scale = float(self.norms.max()) if len(points) else 0.0

    def bounds_of(self, queries: np.ndarray) -> np.ndarray:
        """A lower bound of the distance from each query to each leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not self.vantage:
            return out
        away = np.sqrt(_squares(queries, np.array(self.vantage)))
        for leaf, path in enumerate(self.paths):
            for node, side in path:
                low, high = self.bounds[node][2 * side : 2 * side + 2]
                np.maximum(out[:, leaf], np.maximum(low - away[:, node], away[:, node] - high), out=out[:, leaf])
        return out

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The k nearest candidates of each query: query number, id, distance; and the number of points looked at."""
        m = len(queries)
        if not m or not len(self.points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        # One slot more than k, as the query may stand among copies; fast squares decide with a margin, exact distances later.
        best, margin = np.full((m, k + 1), np.inf), 1e-9 * ((queries**2).sum(axis=1) + self.scale) + 1e-300
        limits, pairs, seen = self.bounds_of(queries), [], 0
        promising = limits.argmin(axis=1)
        slack = 1e-4 * np.sqrt(margin * 1e9)
        for first in (True, False):
            for leaf, (low, high) in enumerate(self.leaves):
                if first:
                    some = np.flatnonzero(promising == leaf)
                else:
                    some = np.flatnonzero((promising != leaf) & (limits[:, leaf] * factor <= np.sqrt(best[:, k]) + slack))
                if not len(some):
                    continue
                squares = _squares(queries[some], self.points[low:high])
                seen += squares.size
                # A point with no other id than the query's own is no candidate.
                held = self.place[low:high]
                squares[self.lone[held] & (self.all_ids[self.starts[held]] == own_ids[some][:, None])] = np.inf
                best[some] = np.partition(np.concatenate([best[some], squares], axis=1), k, axis=1)[:, : k + 1]
                # The partition leaves the k + 1 smallest in front, the largest of them last.
                near = squares <= (best[some, k] + margin[some])[:, None]
                q, x = np.nonzero(near)
                pairs.append((some[q], low + x, squares[q, x]))
        q, x, squares = (np.concatenate([p[i] for p in pairs]) for i in range(3))
        keep = squares <= best[q, k] + margin[q]
        q, x = q[keep], self.place[x[keep]]
        # Of copies only the smallest ids can be among the nearest, the query's own left out.
        own_from, own_to = self._own_rows(x, own_ids[q])
        counts = np.minimum(self.starts[x + 1] - self.starts[x] - (own_to - own_from), k)
        at = np.repeat(self.starts[x], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at += np.where(at >= np.repeat(own_from, counts), np.repeat(own_to - own_from, counts), 0)
        ids, asked = self.all_ids[at], np.repeat(q, counts)
        distance = np.repeat(_exact(queries[q], self.points_by_place(x)), counts)
        order = np.lexsort((ids, distance, asked))
        asked, ids, distance = asked[order], ids[order], distance[order]
        rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
        return asked[rank < k], ids[rank < k], distance[rank < k], seen

    def _own_rows(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows with id ``own`` start and end in the group of each point ``x``."""
        number = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        key = x * len(self.known) + number
        start, end = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        return start, np.where(self.known[number] == own, end, start)

    def points_by_place(self, place: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_back"):
            self._back = np.argsort(self.place)
        return self.points[self._back[place]]


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(axis=1))


def _squares(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.maximum((queries**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * queries @ points.T, 0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances with the squares added one after another."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1]) if len(a) else np.zeros(0)


def usable(vector: Column) -> Column:
    """Whether a vector can take part: there, not zero, all numbers finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, rows_per_shard: int = 8_192, queries_per_block: int = 1_024) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``: the nearest rows of every query, nearest first."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asked"))
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    total = own.count()
    asked = own.filter("asked").groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    shards, blocks = max(1, -(-total // rows_per_shard)), max(1, -(-asked.count() // queries_per_block))

    def grouped(tag: int):
        def gather(keys: tuple, table: pa.Table) -> pa.Table:
            column = table.column("v").combine_chunks()
            ids = table.column("vec_id").combine_chunks()
            return pa.table([pa.array([keys[0].as_py()], pa.int32()), pa.array([keys[1].as_py()], pa.int32()), pa.array([tag], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([column.flatten().to_numpy().astype("<f8").tobytes()], pa.binary())], names=["dim", "shard", "tag", "ids", "data"])

        return gather

    def dealt(df: DataFrame, parts: int, tag: int) -> DataFrame:
        numbered = df.select("dim", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)).cast("int").alias("shard"), "vec_id", "v")
        return numbered.groupBy("dim", "shard").applyInArrow(grouped(tag), _ROW)

    trees = dealt(own, shards, 0)
    # A block of queries goes to every shard.
    questions = written(dealt(asked, blocks, 1), "query-blocks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = trees.unionByName(questions.select(trees.columns)).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "tag")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, place = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, shard, tag = (batch.column(c)[row].as_py() for c in ("dim", "shard", "tag"))
                ids = batch.column("ids")[row].values.to_numpy()
                data = np.frombuffer(batch.column("data")[row].as_buffer(), "<f8").reshape(-1, dim)
                if tag == 0:
                    tree, place = Tree(data, ids), (dim, shard)
                elif place == (dim, shard):
                    q, found, distance, _ = tree.search(data, ids, k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(distance)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    place = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours_of_every_hundredth(vectors: DataFrame) -> DataFrame:
    """The ten nearest rows of each row whose id is divisible by 100, by exact search."""
    return nearest(vectors, F.col("vec_id") % 100 == 0, k=10, factor=1.0)


NEIGHBOURS_SQL = """
WITH valid AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10"""
