import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gatelight.functions import text as tx


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t"))).first()[0]


def test_tokens(spark):
    assert one(spark, "社内規定", tx.tokens) == ["社内", "内規", "規定"]
    assert one(spark, "社A内 Foo-bar2 où", tx.tokens) == ["社内", "a", "foo", "bar2", "o"]
    assert one(spark, "社", tx.tokens) == []
    assert one(spark, "ＡＢ", tx.tokens) == []  # full-width forms are outside the class


def test_token_id_is_the_head_of_the_hash(spark):
    for token in ("a", "foo", "社内"):
        want = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % 131072
        assert one(spark, token, tx.token_id) == want


def test_sparse_vector(spark):
    vec = one(spark, "b a b 社内規定", tx.sparse_vector)
    assert [e.i for e in vec] == sorted({e.i for e in vec}) and len(vec) == 5
    assert abs(sum(e.v for e in vec) - 1) < 1e-12
    assert max(e.v for e in vec) == 2 / 6
    assert one(spark, "、", tx.sparse_vector) == []


def test_sparse_vector_against_counting(spark):
    texts = ["a b a c", "", "x", "あいあいあ x x", "規程 2024 規程 2024"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.sparse_vector(F.col("t")).alias("v")).collect()
    for row in got:
        wide = [c for c in row.t if "\u3000" <= c <= "\ufaff"]
        import re
        tokens = [a + b for a, b in zip(wide, wide[1:])] + [w.lower() for w in re.findall("[a-zA-Z0-9]+", row.t)]
        ids = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big") % 131072 for t in tokens]
        assert [(e.i, e.v) for e in row.v] == sorted((i, ids.count(i) / len(ids)) for i in set(ids))


def test_sentences(spark):
    assert one(spark, "これは。あれは！ Yes. no", tx.sentences) == ["これは。", "あれは！", "Yes.", "no"]
    assert one(spark, "a..b", tx.sentences) == ["a.", ".", "b"]
    assert one(spark, "終わり。\u3000次", tx.sentences) == ["終わり。", "次"]
    assert one(spark, " \n ", tx.sentences) == []
    assert one(spark, "結論: A\n理由: B。次", tx.sentence_lines) == ["結論: A", "理由: B。", "次"]


def test_basename(spark):
    for path, name in {"/a/b.txt": "b.txt", "C:\\x\\y.doc": "y.doc", "a/b\\c": "c", "plain": "plain", "/a/": "", "C:z": "z", None: ""}.items():
        assert one(spark, path, tx.basename) == name


def test_refusal_and_keywords(spark):
    assert one(spark, "その情報は現在の資料には含まれていません。", tx.is_refusal)
    assert not one(spark, "5 日です", tx.is_refusal)
    share = lambda *k: (lambda t: tx.keyword_share(t, F.lit(list(k)) if k else F.array().cast("array<string>")))
    assert one(spark, "5 日以内", share("5", "日", "月")) == 2 / 3
    assert one(spark, "x", share()) == 1.0


def test_verbatim_quote(spark):
    test = lambda q: (lambda t: tx.quoted_verbatim(F.lit(q), t))
    assert one(spark, "休 暇\u3000は 五日", test("休暇は\n五日"))
    assert not one(spark, "休暇は五日", test("六日"))
    assert not one(spark, "休暇", test(" \u3000"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x1c\u3000\u2028abあ.", max_size=12), min_size=1, max_size=8))
def test_strip_matches_python(texts):
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_a_sparse_vector_counts_what_tokens_and_token_id_give(spark):
    texts = ["b a b 社内規定", "Kİ où É9 ＡＢ", "社 x 内", "", None, "😀社😀内 Zz zZ " * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tx.sparse_vector(F.col("t")).alias("v"), F.transform(tx.tokens(F.col("t")), tx.token_id).alias("ids")
    )
    for row in got.collect():
        want = None if row.ids is None else [(i, row.ids.count(i) / len(row.ids)) for i in sorted(set(row.ids))]
        assert (None if row.v is None else [(e.i, e.v) for e in row.v]) == want
    plan = got.select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan  # ids are hashed once per token, not by an expression per occurrence
