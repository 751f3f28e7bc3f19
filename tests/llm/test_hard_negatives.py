"""Hard negatives against all pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, row long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, None, "x", 7) for i, v, l in rows], SCHEMA)


def plain(rows):
    """All pairs of rows (vec_id, vector, label)."""
    sound = [(i, np.floor(256 * np.asarray(v, np.float64)), (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows
             if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, l) in enumerate(sound):
        if i % 100:
            continue
        scored = [(-int(np.dot(v, w)), j, m) for b, (j, w, m) in enumerate(sound) if b != a and len(v) == len(w)]
        for s, p, _ in sorted(x[:2] + (0,) for x in scored if x[2] == l)[:5]:
            near = sorted((t, j) for t, j, m in scored if m != l and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(near[:10], 1)]
    return Counter(out)


def got(df):
    return Counter(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    v = centres[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


@pytest.mark.parametrize("spread, d", [(0.7, 20), (3.0, 64), (1.0, 3)])
def test_equals_all_pairs(spark, monkeypatch, spread, d):
    monkeypatch.setattr(hn, "ROWS_INDEXED", 37)
    monkeypatch.setattr(hn, "ANCHORS_JOINED", 3)
    rows = [(i, v, i % 4) for i, v in enumerate(vectors(3, 1200, d, spread))]
    df = table(spark, rows).repartition(3)
    want = plain(rows)
    assert got(hn.mined_of_every_hundredth(df)) == want and len(want) > 50
    assert got(hn.mined(df, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), F.col("vec_id") % 100 == 0, rows_held=100)) == want


def test_hard_rows(spark):
    v = vectors(5, 60, 8)
    rows = [(i * 50, v[i], i % 3) for i in range(40)]
    rows += [(7, v[0], 1)] * 30 + [(100, v[2], 0), (100, v[3], 1)]  # copies, repeated ids
    rows += [(None, v[1], 1), (200, None, 1), (300, v[1], None), (400, [1.0, None], 1), (500, [float("nan")] * 8, 1), (600, [float("inf")] * 8, 2)]
    rows += [(700, [], 1), (800, [], 1), (801, [], 2), (900, [1.0, 2.0], 1), (901, [1.0, 2.5], 1), (902, [0.5, 0.75], 2), (1000, [0.0] * 8, 0), (1001, [0.0] * 8, 0), (1002, [0.0] * 8, 1)]
    assert got(hn.mined_of_every_hundredth(table(spark, rows))) == plain(rows)
    assert hn.mined_of_every_hundredth(table(spark, [])).count() == 0


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 1e5], i % 3) for i in range(300)]
    rows.append((200, [3e38] * 4, 1))  # too long to score
    df = table(spark, rows)
    assert got(hn.mined_of_every_hundredth(df)) == plain(rows[:-1])


def test_index_joins_exactly_and_leaves_dimensions_out():
    rng = np.random.default_rng(2)
    v = np.floor(256 * np.asarray(vectors(2, 400, 32, 0.5))).astype(np.int64)
    rows = hn._Rows.of(np.arange(400), np.arange(400), np.zeros(400, int), v)
    anchors = rows.some(np.arange(0, 400, 20))
    for t in (60_000, 40_000, 10_000, 0, -70_000):
        threshold = rng.integers(t, t + 5_000, len(anchors.ids)).astype(float)
        index = hn.Index(rows, threshold.min(), anchors.norms.max(axis=0))
        i, j, score = index.join(anchors, threshold)
        want = {(a, b): s for a, row in enumerate(anchors.v @ v.T) for b, s in enumerate(row) if s >= threshold[a]}
        assert {(a, int(index.rows.ids[b])): s for a, b, s in zip(i.tolist(), j.tolist(), score.tolist())} == want
        assert (index.left_out > 0).any() == (t > 0) or t == 10_000
