import random
from math import sqrt

import pytest
from pyspark.sql import functions as F

from gatelight.operators import metrics, paired
from tests.conftest import rows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("values,p,want", [([2, 4, 7, 11, 16], 95, 15.0), ([2, 4, 7, 11, 16], 50, 7.0), ([7], 95, 7.0), ([1, 2, 3, 10], 95, 8.95), ([2, 2, 2], 0, 2.0), ([1, 3], 100, 3.0)])
def test_percentile(spark, values, p, want):
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, x double")
    assert metrics.percentiles(df, ["g"], "x", {"p": p}).first().p == pytest.approx(want)


def test_percentile_of_large_groups(spark):
    rng = random.Random(3)
    data = [("hot", 5.0)] * 12_000 + [("hot", rng.random() * 100) for _ in range(23_456)] + [("tail", rng.paretovariate(0.5)) for _ in range(11_111)] + [("small", 1.0), ("small", 9.0)]
    got = metrics.percentiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x", {"a": 0, "b": 12.5, "c": 50, "d": 95, "e": 99.99, "f": 100})
    for row in got.collect():
        s = sorted(x for g, x in data if g == row.g)
        for name, p in {"a": 0, "b": 12.5, "c": 50, "d": 95, "e": 99.99, "f": 100}.items():
            k = (len(s) - 1) * p / 100
            low = int(k)
            want = s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (k - low)
            assert row[name] == pytest.approx(want), (row.g, name)


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    assert rows(metrics.percentiles(df, ["g"], "x", {"p": 50}), "g", "p") == sorted([(None, 2.0), ("a", 2.0)], key=repr)
    assert rows(paired.mean_and_error(df, ["g"], "x"), "g", "n", "mean") == sorted([(None, 2, 2.0), ("a", 1, 2.0)], key=repr)


def test_missing_categories_and_short_ids_are_found(spark):
    questions = spark.createDataFrame(
        [("Q001", "general", False, 1, ["/a"], ["x"]), ("Q2", "general", False, 1, ["/a"], ["x"])],
        "question_id string, category string, should_refuse boolean, user_access_level int, expected_sources array<string>, expected_answer_keywords array<string>",
    )
    corpus = spark.createDataFrame([("/a", "x" * 1000)], "source_path string, content string")
    found = rows(metrics.dataset_problems(questions, corpus, {"general": 2, "executive": 6}, expected_total=50), "check", "subject")
    assert found == [("category count", "executive"), ("id out of sequence", "Q2"), ("question count", "2")]


def test_recall_and_rank(spark):
    found, none = F.lit(["a", "b", "c", "d", "e", "f"]), F.array().cast("array<string>")
    assert value(spark, metrics.recall_at_k(found, F.lit(["e"]))) == 1.0
    assert value(spark, metrics.recall_at_k(found, F.lit(["f"]))) == 0.0
    assert value(spark, metrics.recall_at_k(none, F.lit(["f"]))) == 0.0
    assert value(spark, metrics.recall_at_k(found, none)) == 1.0
    assert value(spark, metrics.reciprocal_rank(found, F.lit(["x", "c", "b"]))) == 0.5
    assert value(spark, metrics.reciprocal_rank(found, F.lit(["x"]))) == 0.0
    assert value(spark, metrics.reciprocal_rank(none, none)) == 1.0


def test_judge_scores(spark):
    def scores(raw):
        return tuple(spark.range(1).select(*[c.alias(n) for n, c in metrics.judge_scores(F.lit(raw)).items()]).first())

    assert scores('ok {"context_relevance": 1.5, "answer_relevance": "0.5", "faithfulness": -2} end') == (1.0, 0.5, 0.0)
    assert scores('{"context_relevance": "much"}') == (0.0, 0.0, 0.0)
    assert scores("none") == (0.0, 0.0, 0.0) and scores('{"a": 1} and {"b": 2}') == (0.0, 0.0, 0.0)
    assert scores('x\n{"faithfulness":\n 0.25, "sentence_grounded": [1, 0]}') == (0.0, 0.0, 0.25)


def test_grounded_share(spark):
    assert value(spark, metrics.grounded_share(F.lit("A. B. C."), F.lit([1.0, 0.0]))) == 0.5
    assert value(spark, metrics.grounded_share(F.lit("A."), F.lit([1.0, 0.0]))) == 1.0
    assert value(spark, metrics.grounded_share(F.lit(""), F.lit([1.0]))) == 0.0


def test_permission_check(spark):
    hits = spark.createDataFrame([("a", 1, 2), ("a", 3, 2), ("b", 1, 1), ("c", None, 1)], "question_id string, access_level int, user_access_level int")
    asked = spark.createDataFrame([(q,) for q in "abcd"], "question_id string")
    got = {r.question_id: (r.permission_ok, r.error is not None) for r in metrics.permission_check(hits, asked).collect()}
    assert got == {"a": (False, False), "b": (True, False), "c": (True, True), "d": (True, False)}


RESULT = (
    "setting string, question_id string, category string, recall_at_5 double, mrr double, correctness double, permission_ok boolean, refusal_correct boolean, "
    "context_relevance double, answer_relevance double, faithfulness double, first_token_latency double, total_latency double, error string"
)


def result(spark, *given):
    base = ("s", "q", "general", 1.0, 1.0, 1.0, True, True, 1.0, 1.0, 1.0, 1.0, 2.0, None)
    names = [part.split()[0] for part in RESULT.split(", ")]
    return spark.createDataFrame([tuple(g.get(n, b) for n, b in zip(names, base)) for g in given], RESULT)


def test_summary_leaves_errors_out(spark):
    table = result(spark, {}, {"recall_at_5": 0.0, "error": "run_failed: x"}, {"setting": "t", "error": "run_failed: y"})
    got = {r.setting: r for r in metrics.summarize(table).collect()}
    assert (got["s"].n, got["s"].errors, got["s"].recall_at_5, got["s"].refusal_rate, got["s"].ftl_p95) == (1, 1, 1.0, 1.0, 1.0)
    assert got["t"].all_errored and got["t"].total_p50 == 0.0
    assert dict(rows(metrics.verdicts(metrics.summarize(table)))) == {"s": True, "t": False}
    # Without a judge three means are 0, so nothing passes.
    blind = metrics.summarize(result(spark, {"faithfulness": 0.0, "context_relevance": 0.0, "answer_relevance": 0.0}))
    assert dict(rows(metrics.verdicts(blind))) == {"s": False}
    slow = metrics.threshold_table(metrics.summarize(result(spark, {"first_token_latency": 6.0}))).filter("not passed")
    assert rows(slow, "metric", "value", "bound") == [("ftl_p50", 6.0, 5.0)]


def test_failures(spark):
    table = result(spark, {}, {"question_id": "x", "permission_ok": False, "refusal_correct": False, "error": "run_failed: z"})
    assert rows(metrics.failures(table), "question_id", "reasons") == [("x", "run_failed: z; 権限フィルタ違反; 拒否すべきだが応答してしまった")]


def test_dataset_problems_of_a_sound_set(spark):
    asked = spark.createDataFrame([("Q001", "general", False, 1, ["/a"], ["long"]), ("Q002", "permission_test", True, 1, [], [])], "question_id string, category string, should_refuse boolean, user_access_level int, expected_sources array<string>, expected_answer_keywords array<string>")
    corpus = spark.createDataFrame([("/a", "long " * 300)], "source_path string, content string")
    assert metrics.dataset_problems(asked, corpus, {"general": 1, "permission_test": 1}).count() == 0


def errors(spark, values, clusters):
    df = spark.createDataFrame([("g", v, c) for v, c in zip(values, clusters)], "g string, value double, cluster string")
    return paired.mean_and_error(df, ["g"], "value", "cluster").first()


@pytest.mark.parametrize("clusters,squared", [("aabb", 5 / 192), ("abab", 11 / 192), ("abba", 29 / 192), ("abcd", 20 / 192)])
def test_clustered_errors(spark, clusters, squared):
    got = errors(spark, [0.5, 0.0, -0.5, 1.0], clusters)
    want_plain = 20 / 192
    assert got.se_clt == pytest.approx(sqrt(want_plain)) and got["mean"] == 0.25
    devs = dict.fromkeys(clusters, 0.0)
    for v, c in zip([0.5, 0.0, -0.5, 1.0], clusters):
        devs[c] += v - 0.25
    own = sum((v - 0.25) ** 2 for v in [0.5, 0.0, -0.5, 1.0])
    direct = want_plain + (sum(d * d for d in devs.values()) - own) / 16
    assert got.se_cluster == pytest.approx(sqrt(max(direct, 0)))
    assert direct == pytest.approx(squared)


def test_error_edges(spark):
    one = errors(spark, [0.5], "a")
    assert (one.n, one["mean"], one.se_clt, one.se_cluster) == (1, 0.5, None, None)
    same = errors(spark, [0.1] * 7, "aabbccd")
    assert same.se_clt == 0.0 and same.se_cluster == 0.0


def test_compare_and_verdict(spark):
    schema = "qid string, score double, cluster string"
    a = spark.createDataFrame([("1", 0.875, "r"), ("2", 1.0, "r"), ("3", 0.5, "s"), ("4", 1.0, "s"), ("5", 1.0, "s")], schema)
    b = spark.createDataFrame([("1", 0.5, "r"), ("2", 0.0, "r"), ("3", 1.0, "s"), ("4", 1.0, "s"), ("6", 1.0, "s")], schema)
    d = paired.paired_difference(a, b).withColumn("c", F.lit("B-A"))
    got = paired.compare(d, ["c"]).first()
    assert got.n == 4 and got.dbar == pytest.approx(-0.21875) and got.main == "cluster" and got.high - got.dbar == pytest.approx(1.96 * got.se_cluster)
    assert paired.compare(d, ["c"], use_cluster=False).first().low == pytest.approx(got.clt_low)

    def said(n, dbar, low, high, width):
        lit = [F.lit(x).cast("double") for x in (n, dbar, low, high, width)]
        return value(spark, paired.verdict(*lit))

    assert said(1, 0.5, None, None, 0.1) == paired.TOO_FEW
    assert said(9, 0.5, 0.1, 0.9, None) == paired.NO_NOISE_BAND
    assert said(9, 0.5, 0.1, 0.9, 0.2) == paired.BELIEVE
    assert said(9, 0.5, 0.1, 0.9, 0.6) == paired.NOISE
    assert said(9, 0.5, 0.0, 0.9, 0.2) == paired.NOISE
    assert value(spark, paired.noise_width(F.lit(-0.3), F.lit(0.1))) == 0.3


def test_passages_are_looked_up_without_a_row_per_run(spark):
    from gatelight.catalog.inputs import first_containing

    docs = [(9, "x a b c d e f g h i"), (3, "a b c d e f g h i"), (5, None), (6, ""), (7, "one two"), (8, "a b c d e f g h  i")]
    asked = [(1, "a b c d e f g h i"), (2, "one two"), (3, "a b c d e f g h j"), (4, None), (5, "b c d e f g h i"), (5, "x a b c d e f g"), (6, "a b c d e f g h  i")]
    found = first_containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 3), (2, 7), (5, 3), (6, 8)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_passages_are_found_wherever_they_begin_and_end(spark):
    from gatelight.catalog.inputs import first_containing

    long = "The hidden rule of the house, as it was written down long ago by somebody who is no longer here, says: wait."
    docs = [(4, long), (2, "more, and then: " + long + "s and sees"), (7, "naïve résumé 😀 end"), (None, "unnumbered words"), (9, ""), (8, None), (6, "ends in blanks  \n"), (6, "twice the same id")]
    asked = {
        1: long, 2: long[2:-3], 3: long[20:] + "s and s", 4: " " + long[:80], 5: long[:80] + "x", 6: "ïve rés", 7: "é 😀", 8: "h", 9: "ds", 10: "blanks  \n", 11: "s  \n", 12: "blanks \n",
        13: "", 14: None, 15: "unnumbered", 16: "numb", 17: "naive", 18: "twice the same id!", 19: "e the s", 20: long.upper(), 21: "longer here, says: wait.s",
    }
    rows = [*asked.items(), (5, "somebody wh"), (None, "house")]
    found = first_containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"))
    lowest = {}
    for item, passage in rows:
        if held := [d for d, t in docs if t is not None and passage is not None and passage in t]:
            numbers = [d for d in [*held, lowest.get(item)] if d is not None]
            lowest[item] = min(numbers, default=None)
    assert lowest[2] == lowest[3] == lowest[4] == lowest[21] == 2 and lowest[6] == lowest[7] == 7 and lowest[11] == lowest[19] == 6 and lowest[16] is None
    assert dict(map(tuple, found.collect())) == lowest


def test_passages_against_plain_search(monkeypatch):
    """Windows of every width, over the ends of texts and of the places hashed at once."""
    import random

    import pyarrow as pa

    from gatelight.functions import passages

    rng = random.Random(7)
    for places in (1, 64, 1000):
        monkeypatch.setattr(passages, "_PLACES", places)
        for letters in ("a", "ab", "aé 😀\0"):
            texts = [None, "", *["".join(rng.choices(letters, k=k)) for k in (1, 5, 63, 64, 65, 200, 700)]]
            asked = [None, "", "zz", "a" * 90]
            for n in (1, 2, 3, 4, 7, 8, 9, 16, 31, 33, 64, 65, 130, 200):
                begin = rng.randrange(700 - n + 1)
                asked += [texts[-1][begin : begin + n], texts[-1][begin : begin + n] + "b"]
            held = passages.Passages(asked).held_by(pa.array(["aaa", *texts, "a"], pa.string()).slice(1, len(texts)))
            assert set(held) == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(asked) if t is not None and p is not None and p in t}
