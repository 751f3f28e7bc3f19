import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatelight.operators import postings, ranking, vectors
from gatelight.plans import retrieval
from gatelight.session import saved
from tests.conftest import rows

QUESTION = "question_id string, user_access_level int, dense array<double>, sparse array<struct<i:int,v:double>>"
CHUNK = "document_id string, chunk_index int, access_level int, dense array<double>, sparse array<struct<i:int,v:double>>"


def made(seed, n, dims=8, vocabulary=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        ids = sorted(set(int(x) for x in rng.integers(0, vocabulary, rng.integers(0, 6))))
        out.append(([float(x) for x in rng.normal(size=dims)], [(i, 1.0 / len(ids)) for i in ids]))
    return out


def brute(questions, chunks, k):
    want = []
    for qid, level, qd, qs in questions:
        for leg in ("dense", "sparse"):
            scored = []
            for d, c, lvl, cd, cs in chunks:
                if lvl > level:
                    continue
                if leg == "dense":
                    score = round(float(np.dot(qd, cd) / np.linalg.norm(qd) / np.linalg.norm(cd)), 9)
                else:
                    shared = dict(qs).keys() & dict(cs).keys()
                    if not shared:
                        continue
                    score = round(sum(dict(qs)[i] * dict(cs)[i] for i in shared), 9)
                scored.append((-score, d, c))
            want += [(leg, qid, d, c, -s, n) for n, (s, d, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force_in_blocks_of_any_size(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ranking, "CHUNKS_HELD", 7)
        monkeypatch.setattr(ranking, "QUESTIONS_PER_BLOCK", 2)
        monkeypatch.setattr(postings, "QUESTIONS_PER_BLOCK", 4)
    questions = [(f"q{n}", 1 + n % 3, *v) for n, v in enumerate(made(1, 9))]
    chunks = [(f"d{n // 3}", n % 3, 1 + n % 3, *v) for n, v in enumerate(made(2, 150))]
    q, c = spark.createDataFrame(questions, QUESTION), spark.createDataFrame(chunks, CHUNK).repartition(5)
    want = brute(questions, chunks, 7)
    for table in (None, saved(postings.build_postings(c, 11))):
        got = ranking.nearest_chunks(q, c, 7, postings=table)
        found = sorted((r.leg, r.question_id, r.document_id, r.chunk_index, r.score, r["rank"]) for r in got.collect())
        assert [f[:4] + f[5:] for f in found] == [w[:4] + w[5:] for w in want]
        assert np.allclose([f[4] for f in found], [w[4] for w in want], atol=1e-8)


def test_ten_thousand_questions(spark):
    vectors_ = made(3, 40)
    chunks = [(f"d{n:02}", 0, 1, *v) for n, v in enumerate(vectors_)]
    questions = [(f"q{n:05}", 1, *vectors_[n % 40]) for n in range(10_000)]
    got = ranking.nearest_chunks(spark.createDataFrame(questions, QUESTION), spark.createDataFrame(chunks, CHUNK), 3)
    few = brute([q for q in questions[:40]], chunks, 3)
    found = {(r.leg, r.question_id, r["rank"]): r.document_id for r in got.collect()}
    want = {(leg, qid, rank): d for leg, qid, d, _, _, rank in few}
    assert len(found) == 250 * len(want)
    assert all(found[leg, f"q{int(qid[1:]) + 40 * n:05}", rank] == d for (leg, qid, rank), d in want.items() for n in (0, 100, 249))


def test_block_maxima_skip_lists_that_cannot_matter():
    rng = np.random.default_rng(8)
    n, lists = 4_000, {}
    for token, (share, top) in enumerate([(1.0, 0.01), (0.9, 0.02), (0.02, 1.0), (0.01, 2.0)]):
        held = np.flatnonzero(rng.random(n) < share).astype(np.int32)
        weights = rng.random(len(held)) * top
        lists[token] = held, weights, np.maximum.reduceat(weights, np.arange(0, len(held), postings.BLOCK))
    levels = rng.integers(1, 4, n).astype(float)
    levels[::50] = np.nan
    shard = postings.Shard(lists, levels)
    places, scores = shard.best(np.arange(5), np.array([1.0, 1.0, 0.7, 0.9, 3.0]), 2, 10)
    whole = np.zeros(n)
    for token, weight in zip(range(4), (1.0, 1.0, 0.7, 0.9)):
        whole[lists[token][0]] += weight * lists[token][1]
    whole[~(levels <= 2)] = -1
    best = np.lexsort((np.arange(n), -whole))[:10]
    assert set(best) <= set(places) and np.allclose(whole[places], scores)
    assert shard.read < 0.1 * sum(len(x[0]) for x in lists.values())


def test_many_equal_copies_are_ranked_by_key(spark):
    vec = ([1.0, 0.0], [(3, 1.0)])
    copies = spark.range(12_000).select(
        F.format_string("d%05d", "id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("access_level"),
        F.lit([1.0, 0.0]).alias("dense"), F.array(F.struct(F.lit(3).alias("i"), F.lit(1.0).alias("v"))).alias("sparse"),
    ).orderBy(F.desc("document_id"))
    q = spark.createDataFrame([("q", 1, *vec)], QUESTION)
    got = ranking.nearest_chunks(q, copies, 5)
    for leg in ("dense", "sparse"):
        assert [r.document_id for r in got.filter(F.col("leg") == leg).orderBy("rank").collect()] == [f"d0000{n}" for n in range(5)]


def test_question_without_tokens_has_no_sparse_leg(spark):
    q = spark.createDataFrame([("q", 1, [1.0, 0.0], [])], QUESTION)
    c = spark.createDataFrame([("d", 0, 1, [0.5, 0.5], [(1, 1.0)])], CHUNK)
    assert rows(ranking.nearest_chunks(q, c, 5), "leg") == [("dense",)]


def test_one_odd_vector_hides_no_other_and_unknown_levels_are_barred(spark, monkeypatch):
    q = spark.createDataFrame([("q", 2, [1.0, 0.0], [(1, 1.0)]), ("null level", None, [1.0, 0.0], [(1, 1.0)])], QUESTION)
    chunks = [("a", 0, 1, [1.0, 0.0], [(1, 1.0)]), ("b", 0, 1, [0.5, 0.5], [(1, 0.5)]), ("long", 0, 1, [1.0, 0.0, 0.0], []), ("none", 0, 1, None, None), ("nan", 0, 1, [float("nan"), 1.0], []), ("secret", 0, None, [1.0, 0.0], [(1, 1.0)])]
    c = spark.createDataFrame(chunks, CHUNK).coalesce(1)
    want = [("dense", "q", "a"), ("dense", "q", "b"), ("sparse", "q", "a"), ("sparse", "q", "b")]
    for step in (2048, 1):
        monkeypatch.setattr(ranking, "CHUNKS_PER_STEP", step)
        assert rows(ranking.nearest_chunks(q, c, 5), "leg", "question_id", "document_id") == want
    assert rows(ranking.odd_vectors(q, c), "document_id", "length") == [("long", 3), ("nan", 2), ("none", -1)]


def test_fusion(spark):
    legs = spark.createDataFrame(
        [("dense", "q", "a", 0, 1), ("dense", "q", "b", 0, 2), ("sparse", "q", "b", 0, 1), ("sparse", "q", "c", 0, 2)],
        "leg string, question_id string, document_id string, chunk_index int, rank int",
    )
    got = retrieval.fuse(legs, 2)
    assert [(r.document_id, r.score) for r in got.orderBy("rank").collect()] == [("b", round(1 / 61 + 1 / 62, 9)), ("a", round(1 / 61, 9))]


HIT = "question_id string, question string, content string, rank int, document_id string"


def test_rerank_orders_and_falls_back(spark):
    hits = spark.createDataFrame(
        [("q", "alpha beta", "nothing", 1, "a"), ("q", "alpha beta", "alpha", 2, "b"), ("q", "alpha beta", "beta alpha", 3, "c"), ("q", "alpha beta", "alpha x", 4, "d")], HIT
    )
    assert [r.document_id for r in retrieval.rerank(hits).orderBy("rank").collect()] == ["c", "b", "d", "a"]
    broken = lambda question, content: F.when(content != "alpha", 1.0)
    kept = retrieval.rerank(hits, broken).orderBy("rank").collect()
    assert [(r.document_id, r.rerank_score) for r in kept] == [("a", None), ("b", None), ("c", None), ("d", None)]


def test_final_cut_does_not_refill(spark):
    left = spark.createDataFrame([("q", "", "", r, str(r)) for r in (2, 5, 9)], HIT)
    assert [(r.document_id, r["rank"]) for r in retrieval.final_cut(left, 2).orderBy("rank").collect()] == [("2", 1), ("5", 2)]


def test_leg_depths():
    assert (retrieval.leg_limit(True), retrieval.leg_limit(False)) == (90, 15)
    assert retrieval.leg_limit(True, top=50) == 150


def test_context_and_no_hit(spark):
    hits = spark.createDataFrame(
        [("q", 2, "/w/b.txt", "two", 1), ("q", 1, "C:\\w\\a.txt", "one", 1), ("q", 3, None, "three", 1)],
        "question_id string, rank int, source_file string, content string, access_level int",
    )
    assert retrieval.context(hits).first().context == "[1] a.txt\none\n\n[2] b.txt\ntwo\n\n[3] 不明\nthree"
    asked = spark.createDataFrame([("q", "why?"), ("r", "100%?")], "question_id string, question string")
    assert rows(retrieval.no_hit_answers(asked, hits)) == [("r", retrieval.NO_HIT_ANSWER)]
    built = {r.question_id: r.messages for r in retrieval.messages(asked, retrieval.context(hits)).collect()}
    assert built["r"][1].content == "【参考情報】\n\n\n【質問】\n100%?" and built["q"][0].role == "system"


def test_citations_and_source_list(spark):
    answers = spark.createDataFrame([(1, "a [1] b [2][7] [x]")], "answer_id int, answer string")
    sources = spark.createDataFrame([(1, 1, "a.txt", False, False), (1, 2, "b.txt", True, False)], "answer_id int, id int, source_file string, redacted boolean, legacy boolean")
    got = retrieval.citations(answers, sources)
    assert rows(got, "position", "number", "state", "source_file") == [(0, "1", "source", "a.txt"), (1, "2", "unavailable", None), (2, "7", "text", None)]
    listed = spark.createDataFrame([(1, 0, 1, "a.txt"), (1, 1, 2, "a.txt"), (1, 2, 3, ""), (1, 3, 4, None)], "answer_id int, position int, id int, source_file string")
    assert rows(retrieval.distinct_sources(listed), "source_key", "position", "id") == [("a.txt", 0, 1), ("id:3", 2, 3), ("id:4", 3, 4)]


def test_embed_with_a_model(spark):
    def encoder():
        def encode(texts):
            return np.array([[len(t), float(t.startswith("query: "))] for t in texts])
        return encode

    df = spark.createDataFrame([("abc",), (None,)], "content string")
    got = [r.dense for r in vectors.embed(df, encoder, is_query=True).collect()]
    assert np.allclose(np.linalg.norm(got, axis=1), 1) and np.allclose(got[0], np.array([10, 1]) / np.sqrt(101), atol=1e-6)


def test_projection_is_signed_folding(spark):
    df = spark.createDataFrame([([(1, 0.6), (65, 0.4)],), ([],)], "sparse array<struct<i:int,v:double>>")
    got = [r.dense for r in vectors.project_sparse(df).collect()]
    assert np.isclose(got[0][1], 1.0) and sum(map(abs, got[0])) == abs(got[0][1]) and not any(got[1])


def test_chunks_without_dense_vectors_are_folded_where_they_are_compared(spark):
    texts = [("d%d" % n, 0, 1 + n % 3, " ".join(f"w{n * m % 17}" for m in range(1, 9))) for n in range(60)]
    chunks = vectors.build_sparse(spark.createDataFrame(texts, "document_id string, chunk_index int, access_level int, content string")).drop("content")
    asked = spark.createDataFrame([("q%d" % n, 2, f"w{n} w{n + 3} w5") for n in range(5)], "question_id string, user_access_level int, question string")
    asked = saved(ranking.stored_questions(vectors.project_sparse(vectors.build_sparse(asked, "question")), ("dense", "sparse")))
    folded = ranking.nearest_chunks(asked, chunks, 7, ("dense",))
    assert rows(folded) == rows(ranking.nearest_chunks(asked, vectors.project_sparse(chunks), 7, ("dense",)))
    stored = saved(chunks)
    plan = ranking.nearest_chunks(asked, stored, 7, ("dense",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one Python worker in a task


def test_a_sparse_store_takes_one_python_worker_per_task(spark):
    from gatelight.operators.chunking import chunk_text

    texts = ["Foo bar. " * 90 + "社内規定 の foo", "", None, "a\n\n\n\nB a"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, content string")
    both = chunk_text(docs, sparse=True)
    assert rows(both) == rows(vectors.build_sparse(chunk_text(docs)))
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_index_and_bounds_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [[{"i": int(i), "v": float(v)} for i, v in zip(rng.choice(30, n, replace=False), rng.integers(-1, 9, n) / 8)] for n in rng.integers(0, 20, 300)]
    monkeypatch.setattr(postings, "BLOCK", 8)
    table = pa.table({"document_id": [f"d{n}" for n in range(300)], "chunk_index": pa.array(range(300), pa.int32()), "access_level": pa.array([1 + n % 3 for n in range(300)], pa.int32()), "sparse": pa.array(vectors, pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())])))})
    found = {r["token_id"]: r for r in postings._shard_rows(table, 5).to_pylist()}
    want = {t: [(n, e["v"]) for n, v in enumerate(vectors) for e in v if e["i"] == t and e["v"] > 0] for t in range(30)}
    assert found.pop(postings.CHUNKS)["documents"] == table.column("document_id").to_pylist() and set(found) == {t for t, held in want.items() if held}
    for t, row in found.items():
        places, weights = zip(*want[t])
        assert np.frombuffer(row["places"], "<i4").tolist() == list(places) and np.frombuffer(row["weights"], "<f8").tolist() == list(weights)
        assert np.frombuffer(row["most"], "<f8").tolist() == [max(weights[a : a + 8]) for a in range(0, len(weights), 8)]
    assert len(postings._shard_rows(table.slice(0, 0), 5)) == 1


def test_k_th_best_is_sought_among_few_places(monkeypatch):
    rng = np.random.default_rng(9)
    n = 16_384
    lists = {}
    for token in range(40):
        held = np.flatnonzero(rng.random(n) < 0.05).astype(np.int32)
        weights = rng.random(len(held))
        lists[token] = held, weights, np.maximum.reduceat(weights, np.arange(0, len(held), postings.BLOCK))
    sought = []
    whole = np.partition
    monkeypatch.setattr(postings.np, "partition", lambda values, at: sought.append(len(values)) or whole(values, at))
    postings.Shard(lists, np.ones(n)).best(np.arange(40), np.ones(40), 1, 90)
    assert sought and sum(sought) < 0.1 * 40 * n
