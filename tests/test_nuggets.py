import pytest
from pyspark.sql import functions as F

from gatelight.functions import text as tx
from gatelight.operators import nuggets as ng
from tests.conftest import rows

LIST = "array<struct<nid:string,text:string,importance:string,quote:string,keywords:array<string>>>"


def fact(nid, importance="vital", quote="abc", text="t", keywords=("k",)):
    return (nid, text, importance, quote, list(keywords))


def test_validation(spark):
    given = [
        (1, "a", "r", [fact("a-1"), fact("a-2", "okay")]), (2, "a", "r", [fact("b-1")]), (3, None, "r", [fact("a-1")]), (4, "c", "none", [fact("c-1", quote="zzz")]),
        (5, "d", None, []), (6, "e", "r", [fact("a-1", "must", "a b\nc", " "), fact("", "okay", " "), fact("e-3", "okay", "zzz")]),
    ]
    df = spark.createDataFrame(given, f"row_no int, qid string, rule_id string, nuggets {LIST}")
    corpus = spark.createDataFrame([("r", "xx a b c xx")], "rule_id string, body string")
    got = rows(ng.validate_nuggets(df, corpus), "row_no", "problem", "nid")
    assert got == sorted([
        (2, "qid repeated", None), (3, "qid missing", None), (4, "rule unknown", None), (5, "rule_id missing", None), (5, "no facts", None),
        (6, "nid repeated", "a-1"), (6, "text empty", "a-1"), (6, "importance unknown", "a-1"), (6, "nid missing", None), (6, "quote empty", ""),
        (6, "quote not verbatim", "e-3"), (6, "no vital fact", None),
    ], key=repr)


def test_sound_list_has_no_problems(spark):
    df = spark.createDataFrame([(1, "a", "r", [fact("a-1")])], f"row_no int, qid string, rule_id string, nuggets {LIST}")
    assert ng.validate_nuggets(df, spark.createDataFrame([("r", "abc")], "rule_id string, body string")).count() == 0


def test_freeze_notices_every_change(spark):
    schema = f"qid string, rule_id string, version string, nuggets {LIST}"
    old = spark.createDataFrame([(q, "r", "v1", [fact(f"{q}-1", quote="a\r\nb")]) for q in "abc"], schema)
    new = spark.createDataFrame([("a", "r", "v1", [fact("a-1", quote="a\nb")]), ("b", "r", "v1", [fact("b-1", quote="other")]), ("d", "r", "v1", [fact("d-1")])], schema)
    assert rows(ng.check_freeze(ng.freeze(old), new)) == [("b", "changed"), ("c", "missing"), ("d", "added")]
    assert rows(ng.refused_freezes(ng.freeze(old), new), "state") == [("added",), ("changed",), ("missing",)]
    assert ng.refused_freezes(ng.freeze(old), new.withColumn("version", F.lit("later"))).count() == 0
    (head,) = ng.freeze_head(old).collect()
    assert head.rows == old.count() and head.frozen_at is not None
    assert ng.freeze_versions(old).first() == (1, True)
    assert ng.freeze_versions(old.withColumn("version", F.lit(""))).first() == (1, False)


def test_freeze_sees_borders_nulls_and_every_field(spark):
    kind = "qid string, rule_id string, question string, version string, reviewed_by string, excluded array<struct<text:string,why:string>>, nuggets array<struct<nid:string,text:string,importance:string,quote:string,keywords:array<string>>>"

    def fact(nid="n", text="t", keywords=("a", "b")):
        return [(nid, text, "vital", "q", list(keywords))]

    variants = [
        ("q", "r", "w", "v", "me", None, fact()), ("q", "r", "other", "v", "me", None, fact()), ("q", "r", "w", "v", None, None, fact()), ("q", "r", "w", "v", "me", [("x", "y")], fact()),
        ("q", "r", "w", "v", "me", None, fact(keywords=["a,b"])), ("q", "r", "w", "v", "me", None, fact(nid=None, text="nt")), ("q", "r", "w", "v", "me", None, fact(nid="nt", text=None)),
    ]
    hashes = [ng.freeze(spark.createDataFrame([v], kind)).first().sha256 for v in variants]
    assert len(set(hashes)) == len(variants)
    lines = [ng.freeze(spark.createDataFrame([("q", "r", t, "v", "me", None, fact())], kind)).first().sha256 for t in ("a\r\nb", "a\nb", "a\rb")]
    assert len(set(lines)) == 1


@pytest.mark.parametrize("reply,want", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('x {"a": [1]} y', '{"a": [1]}'), ("see [1] and {\"a\": 2}", '{"a": 2}'), ("see [1]", "[1]"),
    ("{broken [2]", "[2]"), ("nothing", None), ("", None), (None, None), ("```\nno\n``` [3]", "[3]"), ('["x", {"b": 1}] tail', '{"b": 1}'), ("7", "7"),
])
def test_extract_json(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "t string").select(ng.extract_json(F.col("t"))).first()[0]
    import json
    assert (None if got is None else json.loads(got)) == (None if want is None else json.loads(want))


@pytest.mark.parametrize("found,n,labels,error", [
    ('{"labels": ["必須", "okay"]}', 2, ["vital", "okay"], None), ('["相反"]', 1, ["contradiction"], None), ('[{"label": " 定型 "}, {"ラベル": "不要"}]', 2, ["boilerplate", "irrelevant"], None),
    ('{"labels": ["必須"]}', 2, None, "wrong number of labels"), ('["なぞ"]', 1, None, "unknown label"), ('{"x": 1}', 1, None, "no label array"), ('{"labels": "必須"}', 1, None, "no label array"),
    (None, 1, None, "no JSON"), ("[null]", 1, None, "unknown label"),
])
def test_parse_labels(spark, found, n, labels, error):
    df = spark.createDataFrame([(found, n)], "found string, n_sentences int")
    got = ng.parse_labels(df).first()
    assert (got.labels, got.label_error) == (labels, error)


@pytest.mark.parametrize("found,facts,error", [
    ('{"facts": [{"nid": "a", "score": "full"}, {"nid": "b", "score": 0.5}]}', [("a", "full"), ("b", "partial")], None),
    ('["すべて", 0]', [("a", "full"), ("b", "none")], None), ('[{"id": "b", "verdict": "一部"}, {"id": "a", "label": "NONE"}]', [("b", "partial"), ("a", "none")], None),
    ('[{"score": 1.0}, "1"]', [("a", "full"), ("b", "full")], None), ("[1]", None, "wrong number of facts"), ('[{"nid": "a", "score": 1}, {"nid": "a", "score": 1}]', None, "fact repeated"),
    ('[{"nid": "a", "score": 1}, {"nid": "z", "score": 1}]', None, "other facts"), ('["full", "much"]', None, "unknown level"), ('{"facts": {}}', None, "no fact array"),
])
def test_parse_facts(spark, found, facts, error):
    df = spark.createDataFrame([(found, ["a", "b"])], "found string, vital_nids array<string>")
    got = ng.parse_facts(df).first()
    assert ([tuple(f) for f in got.facts] if got.facts is not None else None, got.fact_error) == (facts, error)


def test_judging_with_one_retry(spark):
    nuggets = spark.createDataFrame([(q, "r", [fact(f"{q}-1"), fact(f"{q}-2", "okay")]) for q in "abcde"], f"qid string, rule_id string, nuggets {LIST}")
    answers = spark.createDataFrame([(q, "r1", "" if q == "d" else "一つ。") for q in "abcde"] + [("zz", "r1", "x")], "qid string, run string, answer string")
    good, fine = '{"labels": ["必須"]}', '{"facts": ["full"]}'
    replies = spark.createDataFrame(
        [("a", "labels", 0, good), ("a", "facts", 0, fine), ("b", "labels", 0, "bad"), ("b", "labels", 1, good), ("b", "facts", 0, "bad"), ("b", "facts", 1, fine),
         ("c", "labels", 0, "bad"), ("c", "labels", 1, "[]"), ("c", "facts", 0, fine), ("e", "labels", 0, good), ("e", "facts", 0, "[]"), ("e", "facts", 1, "[9]")],
        "qid string, call string, attempt int, raw string",
    ).withColumn("run", F.lit("r1"))
    got = {r.qid: (r.status, r.labels, r.facts and [tuple(f) for f in r.facts], r.error, r.retries) for r in ng.judge_records(answers, nuggets, replies).collect()}
    assert got == {
        "a": ("ok", ["vital"], [("a-1", "full")], None, 0), "b": ("ok", ["vital"], [("b-1", "full")], None, 2),
        "c": ("undetermined", None, None, "labels: wrong number of labels", 1), "d": ("ok", [], [("d-1", "none")], None, 0),
        "e": ("undetermined", None, None, "facts: unknown level", 1),
    }


def records(spark, *given):
    schema = "setting string, run string, qid string, answer string, status string, sentences array<string>, labels array<string>, facts array<struct<nid:string,level:string>>"
    return spark.createDataFrame(list(given), schema)


def test_scores(spark):
    nuggets = spark.createDataFrame(
        [("q", "r", [fact("1", keywords=("x", "y")), fact("2", keywords=("y",)), fact("3", "okay", keywords=("z",))]), ("p", "r", [fact("4", keywords=())]), ("m", "r", [fact("5")])],
        f"qid string, rule_id string, nuggets {LIST}",
    )
    table = records(
        spark, ("A", "A1", "q", "has x", "ok", ["s1", "s2"], ["vital", "contradiction"], [("1", "full"), ("2", "partial")]),
        ("A", "A2", "q", "has x y", "ok", ["s3", "s2"], ["vital", "contradiction"], [("1", "full"), ("2", "full")]),
        ("A", "A3", "q", "?", "undetermined", ["s"], None, None), ("A", "A1", "p", "?", "undetermined", ["s"], None, None), ("A", "A1", "zz", "?", "ok", [], [], []),
    )
    scored = ng.score_records(table, nuggets)
    first = scored.filter("run = 'A1' and qid = 'q'").first()
    assert (first.v, first.v_strict, first.c, first.m6, first.contradictions, first.n_vital, first.head) == (0.75, 0.5, 1.0, 0.5, ["s2"], 1, "has x")
    lost = scored.filter("run = 'A3'").first()
    assert (lost.determined, lost.v, lost.m6, lost.n_vital) == (False, None, None, 0)
    per = ng.question_scores(scored)
    q = per.filter("qid = 'q'").first()
    assert (q.s, q.k_used, q.k_total, q.m6, q.mean_contradiction) == (0.875, 2, 3, 0.75, 1.0)
    assert rows(ng.lost_facts(scored)) == [("A", "q", "2", 0.75)]
    assert rows(ng.contradictions(scored), "qid", "sentence") == [("q", "s2")]
    outside = ng.coverage(per, table, nuggets, ["A"])
    assert rows(outside) == [("A", "m", "missing"), ("A", "p", "excluded"), ("A", "zz", "unknown")]
    summary = ng.setting_summary(per, outside).first()
    assert (summary.n, summary.mean_v, summary.se_clt, summary.n_excluded, summary.n_missing, summary.n_m6) == (1, 0.875, None, 1, 1, 1)


def test_vital_keywords_keep_first_seen_order(spark):
    df = spark.createDataFrame([([fact("1", keywords=("b", "a")), fact("2", "okay", keywords=("z",)), fact("3", keywords=("a", "c"))],)], f"n {LIST}")
    assert df.select(ng.vital_keywords(F.col("n"))).first()[0] == ["b", "a", "c"]


def test_drafts(spark):
    good = '{"nuggets": [{"text": " one ", "importance": "必須", "quote": "a b", "keywords": ["k", 5]}, {"text": "two", "importance": "?", "quote": "zz", "keywords": "k"}]}'
    df = spark.createDataFrame([("a", "r", good), ("b", "r", '{"nuggets": []}'), ("c", "r", '{"nuggets": [{"text": " "}]}'), ("d", "r", None)], "qid string, rule_id string, found string")
    got = ng.clean_drafts(df, spark.createDataFrame([("r", "a\u3000b")], "rule_id string, body string"))
    assert rows(got, "nid", "text", "importance", "keywords", "flags") == sorted([
        ("a-n1", "one", "vital", ["k", "5"], []), ("a-n2", "two", "okay", [], ["importance_unknown", "quote_not_verbatim"]),
        ("", "", "", [], ["draft_failed"]), ("", "", "", [], ["draft_failed"]), ("", "", "", [], ["draft_failed"]),
    ], key=repr)


def test_drafts_keep_what_was_left_out_and_why_they_failed(spark):
    good = '{"nuggets": [{"text": "one"}], "excluded": [{"text": "x", "why": "y"}, 3, "z"]}'
    df = spark.createDataFrame([("a", "r", good, None), ("b", "r", '{"nuggets": []}', None), ("c", "r", '{"nuggets": [{"text": " "}], "excluded": [{}]}', None), ("d", "r", None, "no answer"), ("e", "r", '{"nuggets": [{"text": "t"}], "excluded": "none"}', None)], "qid string, rule_id string, found string, error string")
    got = ng.clean_drafts(df, spark.createDataFrame([("r", "b")], "rule_id string, body string"))
    assert rows(got, "qid", "excluded", "draft_error") == sorted([
        ("a", ['{"text":"x","why":"y"}'], None), ("b", [], ng.DRAFT_WITHOUT_LIST), ("c", [], ng.DRAFT_WITHOUT_TEXT), ("d", [], "no answer"), ("e", [], None)], key=repr)


def test_lost_facts_stand_in_the_order_of_the_list(spark):
    names = [f"q-n{n}" for n in range(1, 12)]
    facts = spark.createDataFrame([("q", [fact(n) for n in names])], f"qid string, nuggets {LIST}")
    lost = spark.createDataFrame([("B", "q", n, 0.5 if n == "q-n10" else 0.0) for n in reversed(names)], "setting string, qid string, nid string, mean_points double")
    none = spark.createDataFrame([], "qid string, sentence string, first_seen struct<run:string,place:int>")
    worst = ng.worst_questions(spark.createDataFrame([("q", -1.0)], "qid string, d double"), spark.createDataFrame([("q", "r", "h")], "qid string, rule_id string, head string"), lost, none, facts)
    assert [x.split()[0] for x in worst.first().lost.split("; ")] == names


def test_a_record_without_a_level_stops_the_scoring(spark):
    nuggets = spark.createDataFrame([("q", "r", [fact("q-n1"), fact("q-n2")])], f"qid string, rule_id string, nuggets {LIST}")
    records = spark.createDataFrame([("S", "q", "1", "x", ["x"], ["okay"], [("q-n1", "full")], "ok")], "setting string, qid string, run string, answer string, sentences array<string>, labels array<string>, facts array<struct<nid:string,level:string>>, status string")
    with pytest.raises(Exception, match="no level of fact q-n2 in run 1"):
        ng.score_records(records, nuggets).collect()


def test_json_is_found_in_time_that_grows_with_the_text():
    import json
    import time

    from gatelight.functions.json_scan import first_json

    began = time.time()
    assert first_json('{"a":' * 200_000) is None
    assert first_json("[" * 1_000_000) is None
    assert first_json('{"a":[' * 150_000 + '{"b": 1}') == '{"b": 1}'
    assert first_json('{"a":' * 100_000 + "1" + "}" * 100_000) == json.dumps(json.loads('{"a":' * 500 + "1" + "}" * 500))
    assert time.time() - began < 20
    assert first_json('{"x": "open {"labels": ["a"]} y') == '{"labels": ["a"]}'
    assert first_json('{"x": "{}" oops') == "{}" and first_json('a {b} {"c": [1, {"d": -0.5e3}], "e": null}') == '{"c": [1, {"d": -500.0}], "e": null}'
    assert first_json('{"a" {"b": 2}}') == '{"b": 2}' and first_json("[1, 2,]") is None and first_json('{"a": 1,} [3]') == "[3]"


def test_inputs_prompts_and_provenance(spark):
    nuggets = spark.createDataFrame([("q", "r", "Why?", "v1", [fact("1", text="5 日")]), ("p", "r", "", "v1", [fact("2")])], f"qid string, rule_id string, question string, version string, nuggets {LIST}")
    corpus = spark.createDataFrame([("r", "本文 100%")], "rule_id string, body string")
    answers = spark.createDataFrame([("q", "A", "はい。以上"), ("p", "A", "x"), ("zz", "A", "x")], "qid string, run string, answer string")
    asked = spark.createDataFrame([("p", "From file")], "qid string, question string")
    inputs = ng.judge_inputs(answers, nuggets, corpus, asked)
    assert rows(inputs, "qid", "question") == [("p", "From file"), ("q", "Why?")]
    assert rows(ng.skipped_answers(answers, nuggets)) == [("A", 1)]
    prompt = ng.judge_prompts(inputs.filter("qid = 'q'")).first()
    assert "1. はい。\n2. 以上" in prompt.label_prompt and "全 2 文" in prompt.label_prompt and "- 1: 5 日（必須）" in prompt.label_prompt
    assert '"nid": "1"' in prompt.fact_prompt and "本文 100%" in prompt.fact_prompt
    manifest = ng.freeze(nuggets)
    stamped = ng.stamp(answers, manifest, "m", 0)
    assert rows(ng.foreign_records(stamped, manifest), "qid") == [("zz",)]
    assert ng.judge_mix(stamped).first() == (1, True)


def test_drafts_are_parsed_once(spark):
    drafts = spark.createDataFrame([("q", "r", '{"nuggets": [{"text": "a", "quote": "a b"}], "excluded": []}'), ("p", "r", "{}")], "qid string, rule_id string, found string")
    cleaned = ng.clean_drafts(drafts, spark.createDataFrame([("r", "a b c")], "rule_id string, body string"))
    assert sorted((r.qid, r.nid, r.flags) for r in cleaned.collect()) == [("p", "", ["draft_failed"]), ("q", "q-n1", ["importance_unknown"])]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object(found" not in plan and "from_json(StructField(nuggets" not in plan
