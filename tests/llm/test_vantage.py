"""Vantage-point search against brute force."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from gatelight.llm import vantage


def _brute(rows, asked, k):
    """rows: (id, vector); what exact search must give."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    queries = {}
    for i, v in good:
        if asked(i) and (i not in queries or list(v) < list(queries[i])):
            queries[i] = v
    out = []
    for q, v in queries.items():
        near = sorted((float(np.sqrt(np.cumsum((v - w) ** 2)[-1])), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_hard_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)]
    copy = rows[7][1]
    rows += [(1000 + i, copy) for i in range(40)] + [(100, copy), (100, copy)]
    rows += [(None, copy), (2000, None), (2001, []), (2002, [0.0] * 4), (2003, [1.0, None, 2.0, 3.0]), (2100, [float("nan")] * 4), (2200, [float("inf"), 1.0, 1.0, 1.0]), (2300, [1.0, 2.0]), (2400, [1.0, 2.5])]
    got = sorted(map(tuple, vantage.nearest(_table(spark, rows), F.col("vec_id") % 100 == 0, k=10, rows_per_shard=50, queries_per_block=2).collect()))
    assert got == _brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 100 == 0, 10)
    assert vantage.neighbours_of_every_hundredth(_table(spark, rows).limit(0)).count() == 0
    assert vantage.neighbours_of_every_hundredth(_table(spark, [(100, copy)])).count() == 0


def test_repeated_query_rows_among_copies(spark):
    rng = np.random.default_rng(8)
    copy = [0.5, 1.0, -2.0]
    rows = [(100, copy)] * 3 + [(1000 + i, copy) for i in range(40)] + [(i, rng.normal(size=3).round(1).tolist()) for i in range(1, 90)]
    # An id with many vectors of its own around, and one that sorts between and after the copies.
    rows += [(200, [0.5 + i / 64, 1.0, 4.0]) for i in range(15)] + [(1020, copy), (5000, copy), (5000, copy)]
    got = sorted(map(tuple, vantage.nearest(_table(spark, rows), F.col("vec_id").isin(100, 200, 1020, 5000), k=10).collect()))
    assert got == _brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i in (100, 200, 1020, 5000), 10)


def test_pruning_and_recall():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 5
    points = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8))
    ids, queries = np.arange(6000), points[:200]
    tree = vantage.Tree(points, ids)
    truth = defaultdict(set)
    for q in range(200):
        away = np.linalg.norm(points - points[q], axis=1)
        away[q] = np.inf
        truth[q] = set(np.argsort(away)[:10].tolist())

    def recall(factor):
        q, found, _, seen = tree.search(queries, ids[:200], 10, factor)
        return sum(i in truth[a] for a, i in zip(q.tolist(), found.tolist())) / 2000, seen

    exact, seen_exact = recall(1.0)
    loose, seen_loose = recall(1.6)
    assert exact == 1.0 and seen_exact < 0.6 * 200 * 6000
    assert loose >= 0.9 and seen_loose < seen_exact


def test_trees_hold_every_row():
    rng = np.random.default_rng(7)
    points = np.repeat(rng.normal(size=(50, 3)), 20, axis=0)
    tree = vantage.Tree(points, np.arange(1000))
    assert sorted(tree.all_ids.tolist()) == list(range(1000)) and len(tree.points) == 50
