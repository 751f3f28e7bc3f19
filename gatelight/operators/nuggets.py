"""Fact-level scoring: checking fact lists, reading judge replies, scores per record and setting."""

from __future__ import annotations

import string
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.functions import text as tx
from gatelight.functions.json_scan import first_json
from gatelight.operators.paired import mean_and_error
from gatelight.session import saved

HEAD_CHARS = 80
JUDGE_VERSION = "NJ-1"

# Sentence labels with their display names, fact levels with their
# spellings and points, importance with its spellings.
LABELS = {
    "vital": "必須",
    "okay": "補足",
    "boilerplate": "定型",
    "irrelevant": "不要",
    "not_stated": "記載なし",
    "contradiction": "相反",
}
FACT_LEVELS = {
    "full": ("full", "すべて", "全て", "全部", "1", "1.0"),
    "partial": ("partial", "一部", "0.5"),
    "none": ("none", "述べない", "なし", "無し", "0", "0.0"),
}
FACT_POINTS = {"full": 1.0, "partial": 0.5, "none": 0.0}
IMPORTANCE = {"vital": "vital", "必須": "vital", "okay": "okay", "補足": "okay"}

_NUGGET_LIST = "array<struct<nid:string,text:string,importance:string,quote:string,keywords:array<string>>>"


def _lookup(pairs: dict[str, object], key: Column) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    table = F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])
    return F.try_element_at(table, key)


def label_of(text: Column) -> Column:
    spellings = {**{jp: en for en, jp in LABELS.items()}, **{en: en for en in LABELS}}
    return _lookup(spellings, tx.strip(text))


def level_of(text: Column) -> Column:
    return _lookup({s: level for level, all_ in FACT_LEVELS.items() for s in all_}, F.lower(tx.strip(text)))


def points_of(level: Column) -> Column:
    return _lookup(FACT_POINTS, level)


# ---- fact lists -----------------------------------------------------------------


def vital(nuggets: Column) -> Column:
    return F.filter(nuggets, lambda n: n["importance"] == "vital")


def vital_keywords(nuggets: Column) -> Column:
    """Keywords of the vital facts, first-seen order, no repeats."""
    lists = F.transform(vital(nuggets), lambda n: F.coalesce(n["keywords"], F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(lists))


def validate_nuggets(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Problems of a fact list: row_no, qid, nid, problem. Empty when it is sound.

    ``rows``: row_no (file order), qid, rule_id, nuggets; ``corpus``: rule_id, body.
    A row without qid is not read further; one without facts is checked no deeper.
    Repeats are found by comparing with the first place of each key, a small table
    built by a pre-aggregated minimum.
    """
    named = F.coalesce("qid", F.lit("")) != ""
    first_row = rows.filter(named).groupBy("qid").agg(F.min("row_no").alias("_first"))
    bodies = corpus.select(F.col("rule_id").alias("_rule"), F.col("body").alias("_body"))
    known = rows.join(first_row, "qid", "left").join(bodies, F.col("rule_id") == F.col("_rule"), "left")
    empty = F.coalesce(F.size("nuggets"), F.lit(0)) <= 0
    ruled = F.coalesce("rule_id", F.lit("")) != ""
    facts = rows.filter(named).select("row_no", "qid", F.posexplode("nuggets").alias("place", "n"))
    firsts = facts.filter(F.coalesce("n.nid", F.lit("")) != "").groupBy(F.col("n.nid").alias("nid")).agg(F.min(F.struct("row_no", "place")).alias("_seen"))

    def problem(name: str, condition: Column, nid: Column | None = None) -> Column:
        row = F.struct((F.lit(None).cast("string") if nid is None else nid).alias("nid"), F.lit(name).alias("problem"))
        return F.when(F.coalesce(condition, F.lit(False)), row)

    def found(df: DataFrame, *problems: Column) -> DataFrame:
        return df.select("row_no", F.coalesce("qid", F.lit("")).alias("qid"), F.inline(F.array_compact(F.array(*problems))))

    # All problems of a row are found in one pass, and so are all of a fact.
    of_rows = found(
        known,
        problem("qid missing", ~named),
        problem("qid repeated", named & (F.col("row_no") > F.col("_first"))),
        problem("rule_id missing", named & ~ruled),
        problem("rule unknown", named & ruled & F.col("_rule").isNull()),
        problem("no facts", named & empty),
        problem("no vital fact", named & ~empty & (F.size(vital(F.col("nuggets"))) == 0)),
    )
    quoted = known.filter(named).select("row_no", "qid", "_body", F.posexplode("nuggets").alias("place", "n")).withColumn("nid", F.coalesce("n.nid", F.lit("")))
    seen = quoted.join(firsts, "nid", "left")
    nid, real, quote = F.col("nid"), F.col("n").isNotNull(), F.col("n.quote")
    of_facts = found(
        seen,
        problem("fact is no object", ~real),
        problem("nid missing", real & (nid == "")),
        problem("nid repeated", F.struct("row_no", "place") > F.col("_seen"), nid),
        problem("text empty", real & tx.is_blank(F.col("n.text")), nid),
        problem("importance unknown", real & ~F.coalesce(F.col("n.importance").isin("vital", "okay"), F.lit(False)), nid),
        problem("keywords not texts", real & F.exists("n.keywords", lambda k: k.isNull()), nid),
        problem("quote empty", real & tx.is_blank(quote), nid),
        problem("quote not verbatim", real & ~tx.is_blank(quote) & F.col("_body").isNotNull() & ~tx.quoted_verbatim(quote, F.col("_body")), nid),
    )
    return of_rows.unionByName(of_facts)


def unreviewed(rows: DataFrame) -> DataFrame:
    return rows.filter(tx.is_blank(F.col("reviewed_by"))).select("qid")


FROZEN_FIELDS = ("qid", "set", "rule_id", "question", "excluded", "drafted_by", "reviewed_by", "version")


def _even(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def freeze(rows: DataFrame) -> DataFrame:
    """Manifest of a fact list: version, qid, sha256.

    The hash covers every field as JSON, nulls included and line ends made equal, so
    neither a border between fields nor a missing one can be mistaken. Fields the list
    does not have count as null.
    """
    kinds = dict(rows.dtypes)
    plain = [(_even(F.col(c)) if kinds.get(c) == "string" else F.col(c) if c in kinds else F.lit(None).cast("string")).alias(c) for c in FROZEN_FIELDS]
    facts = F.transform("nuggets", lambda n: F.struct(*[_even(n[c]).alias(c) for c in ("nid", "text", "importance", "quote")], F.transform(n["keywords"], _even).alias("keywords")))
    whole = F.to_json(F.struct(*plain, facts.alias("nuggets")), {"ignoreNullFields": "false"})
    return rows.select("version", "qid", F.sha2(whole, 256).alias("sha256"))


def freeze_head(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per version: how many rows are frozen under it, and when."""
    return rows.groupBy("version").agg(F.count("*").alias("rows")).withColumn("frozen_at", F.current_timestamp() if at is None else at)


def refused_freezes(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that may not be frozen: their version is frozen already with other content."""
    taken = manifest.select("version").distinct()
    return check_freeze(manifest, rows.join(taken, "version", "left_semi"))


def freeze_versions(rows: DataFrame) -> DataFrame:
    """One row: whether the list has exactly one, non-empty version."""
    versions = rows.select(F.coalesce("version", F.lit("")).alias("v")).distinct()
    return versions.agg(
        F.count("*").alias("versions"), ((F.count("*") == 1) & (F.max("v") != "")).alias("freezable")
    )


def check_freeze(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that differ from their manifest: changed, missing or added. Empty when they agree.

    A changed row means the same version now stands for other content, so neither
    freezing nor scoring may go on.
    """
    versions = rows.select("version").distinct()
    old = manifest.join(versions, "version", "left_semi").select("version", "qid", F.col("sha256").alias("_old"))
    new = freeze(rows).select("version", "qid", F.col("sha256").alias("_new"))
    state = (
        F.when(F.col("_new").isNull(), "missing")
        .when(F.col("_old").isNull(), "added")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    return old.join(new, ["version", "qid"], "full_outer").select("qid", state.alias("state")).filter("state is not null")


# ---- judge replies --------------------------------------------------------------


def _salvaged(reply: str) -> str | None:
    """A reply's JSON: of the first fenced part, else of the whole text, that holds any.

    A part counts as it stands; where it is no JSON, the first object in it does, or else
    the first array.
    """
    parts = reply.split("```")
    closed = (p.lstrip(string.ascii_letters) for p in parts[1 : len(parts) - 1 : 2])
    return next((found for found in map(first_json, (*closed, reply)) if found is not None), None)


def extract_json(reply: Column) -> Column:
    """JSON text of a judge's reply, null when there is none.

    Replies that are JSON as they stand are recognised natively; only the others
    are read by Python, in Arrow batches.
    """

    @F.pandas_udf("string")
    def salvage(replies: pd.Series) -> pd.Series:
        return replies.map(_salvaged, na_action="ignore")

    whole = tx.strip(reply)
    clean = F.when(F.substring(whole, 1, 1).isin("{", "["), tx.json_value(whole))
    return F.coalesce(F.to_json(clean), salvage(F.when(clean.isNull(), reply)))


def _items(found: Column, field: str) -> Column:
    """The array under ``field``, or the bare array; elements as JSON text."""
    bare = F.substring(tx.strip(found), 1, 1) == "["
    inner = F.get_json_object(found, f"$.{field}")
    array = F.when(bare, found).when(F.substring(inner, 1, 1) == "[", inner)
    return F.from_json(array, "array<string>")


def _field(item: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(item, f"$.{n}") for n in names])


def _is_object(item: Column) -> Column:
    return F.coalesce(F.substring(item, 1, 1) == "{", F.lit(False))


def parse_labels(df: DataFrame, found: str = "found", sentences: str = "n_sentences") -> DataFrame:
    """Adds ``labels`` (one internal label per sentence) or ``label_error``."""
    df = df.withColumn("_items", _items(F.col(found), "labels"))
    df = df.withColumn(
        "_labels",
        F.transform("_items", lambda i: label_of(F.when(_is_object(i), _field(i, "label", "ラベル")).otherwise(i))),
    )
    error = (
        F.when(F.col(found).isNull(), "no JSON")
        .when(F.col("_items").isNull(), "no label array")
        .when(F.size("_items") != F.col(sentences), "wrong number of labels")
        .when(F.exists("_labels", lambda x: x.isNull()), "unknown label")
    )
    return (
        df.withColumn("label_error", error)
        .withColumn("labels", F.when(F.col("label_error").isNull(), F.col("_labels")))
        .drop("_items", "_labels")
    )


def parse_facts(df: DataFrame, found: str = "found", nids: str = "vital_nids") -> DataFrame:
    """Adds ``facts`` (array of nid, level in the list's order) or ``fact_error``."""
    df = df.withColumn("_items", _items(F.col(found), "facts"))
    df = df.withColumn(
        "_facts",
        F.transform(
            "_items",
            lambda i, p: F.struct(
                F.coalesce(F.when(_is_object(i), _field(i, "nid", "id")), F.get(F.col(nids), p)).alias("nid"),
                level_of(F.when(_is_object(i), _field(i, "score", "verdict", "label")).otherwise(i)).alias("level"),
            ),
        ),
    )
    named = F.transform("_facts", lambda f: f["nid"])
    error = (
        F.when(F.col(found).isNull(), "no JSON")
        .when(F.col("_items").isNull(), "no fact array")
        .when(F.size("_items") != F.size(nids), "wrong number of facts")
        .when(F.exists("_facts", lambda f: f["level"].isNull()), "unknown level")
        .when(F.size(F.array_distinct(named)) != F.size(named), "fact repeated")
        .when(F.size(F.array_except(named, F.col(nids))) > 0, "other facts")
    )
    return (
        df.withColumn("fact_error", error)
        .withColumn("facts", F.when(F.col("fact_error").isNull(), F.col("_facts")))
        .drop("_items", "_facts")
    )


def judge_records(answers: DataFrame, nuggets: DataFrame, replies: DataFrame) -> DataFrame:
    """Judged records from answers and the judge's replies.

    ``answers``: qid, run, answer; ``replies``: qid, run, call (labels, facts),
    attempt (0, 1), raw. The first reply of a call that can be read counts; with
    none the record is undetermined, and facts are not looked at without labels.
    An empty answer states nothing: ok, every fact none.
    """
    known = answers.join(nuggets.select("qid", "rule_id", "nuggets"), "qid").withColumns(
        {
            "sentences": tx.sentence_lines(F.col("answer")),
            "vital_nids": F.transform(vital(F.col("nuggets")), lambda n: n["nid"]),
        }
    )
    asked = known.select("qid", "run", F.size("sentences").alias("n_sentences"), "vital_nids")
    read = replies.join(asked, ["qid", "run"]).withColumn("found", extract_json(F.col("raw")))
    read = parse_facts(parse_labels(read))
    label_call, fact_call = F.col("call") == "labels", F.col("call") == "facts"

    def first_good(call: Column, value: str, error: str) -> Column:
        return F.min(F.when(call & F.col(error).isNull(), F.struct(F.col("attempt"), F.col(value).alias("v"))))

    def last_error(call: Column, error: str) -> Column:
        return F.max_by(F.when(call, F.col(error)), F.when(call, F.col("attempt")))

    calls = read.groupBy("qid", "run").agg(
        first_good(label_call, "labels", "label_error").alias("_l"),
        last_error(label_call, "label_error").alias("_le"),
        first_good(fact_call, "facts", "fact_error").alias("_f"),
        last_error(fact_call, "fact_error").alias("_fe"),
    )
    none_said = F.size("sentences") == 0
    l_retry = F.coalesce(F.col("_l.attempt"), F.lit(1))
    f_retry = F.coalesce(F.col("_f.attempt"), F.lit(1))
    both = F.col("_l").isNotNull() & F.col("_f").isNotNull()
    all_none = F.transform("vital_nids", lambda n: F.struct(n.alias("nid"), F.lit("none").alias("level")))
    return known.join(calls, ["qid", "run"], "left").select(
        "qid",
        "run",
        "answer",
        "sentences",
        F.when(none_said, F.array().cast("array<string>")).when(both, F.col("_l.v")).alias("labels"),
        F.when(none_said, all_none).when(both, F.col("_f.v")).alias("facts"),
        F.when(none_said | both, "ok").otherwise("undetermined").alias("status"),
        F.when(none_said | both, None)
        .when(F.col("_l").isNull(), F.concat(F.lit("labels: "), F.coalesce("_le", F.lit("no reply"))))
        .otherwise(F.concat(F.lit("facts: "), F.coalesce("_fe", F.lit("no reply"))))
        .alias("error"),
        F.when(none_said, 0).when(F.col("_l").isNull(), l_retry).otherwise(l_retry + f_retry).alias("retries"),
    )


def judge_inputs(answers: DataFrame, nuggets: DataFrame, corpus: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """What a judge needs per answer; answers to unknown questions are left out.

    Answers whose rule has no text, or that have no question text, are no input either:
    ``judge_input_errors`` lists them.
    """
    every = _judge_rows(answers, nuggets, corpus, questions)
    return every.filter(F.col("body").isNotNull() & (F.col("question") != ""))


def judge_input_errors(answers: DataFrame, nuggets: DataFrame, corpus: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Answers that cannot be judged: run, qid, problem."""
    every = _judge_rows(answers, nuggets, corpus, questions)
    problem = F.when(F.col("body").isNull(), "rule without text").when(F.col("question") == "", "question without text")
    return every.select("run", "qid", problem.alias("problem")).filter("problem is not null")


def _judge_rows(answers: DataFrame, nuggets: DataFrame, corpus: DataFrame, questions: DataFrame | None) -> DataFrame:
    facts = nuggets.select("qid", "rule_id", "question", "nuggets", "version")
    if questions is not None:
        facts = facts.join(questions.select("qid", F.col("question").alias("_asked")), "qid", "left")
        own = F.when(F.coalesce("question", F.lit("")) != "", F.col("question"))
        facts = facts.withColumn("question", F.coalesce(own, F.col("_asked"), F.lit(""))).drop("_asked")
    facts = facts.withColumn("question", F.coalesce("question", F.lit("")))
    return answers.join(facts, "qid").join(corpus.select("rule_id", "body"), "rule_id", "left")


def skipped_answers(answers: DataFrame, nuggets: DataFrame) -> DataFrame:
    """Per run, how many answers have no fact list."""
    return answers.join(nuggets.select("qid"), "qid", "left_anti").groupBy("run").agg(F.count("*").alias("skipped"))


def stamp(records: DataFrame, manifest: DataFrame, model: str, seed: int) -> DataFrame:
    """Adds where a record comes from: judge, seed and the frozen facts it was judged by."""
    frozen = manifest.select("qid", F.col("sha256").alias("nuggets_sha256"), F.col("version").alias("nuggets_version"))
    return records.join(frozen, "qid", "left").withColumns(
        {"judge_version": F.lit(JUDGE_VERSION), "judge_model": F.lit(model), "judge_seed": F.lit(seed)}
    )


def foreign_records(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records judged by facts other than the frozen ones."""
    frozen = manifest.select(F.col("sha256").alias("nuggets_sha256"), "qid")
    return records.join(frozen, ["qid", "nuggets_sha256"], "left_anti")


def judge_mix(records: DataFrame) -> DataFrame:
    """One row: how many (judge version, model) pairs; more than one must not be scored together."""
    pairs = records.select(F.coalesce("judge_version", F.lit("None")).alias("v"), F.coalesce("judge_model", F.lit("None")).alias("m")).distinct()
    return pairs.agg(F.count("*").alias("judges"), (F.count("*") <= 1).alias("scorable"))


# ---- prompts --------------------------------------------------------------------

# The two instructions given to a judge.
LABEL_PROMPT = """[判定手順 NJ-1 / 呼び出し1: 文のラベル]
次の規程本文・質問・番号付きの回答文・事実の一覧を読み、回答の各文に次の 6 つのラベルのどれか 1 つだけを付けてください。
- 必須: 「必須」とされた事実のどれかを述べている文
- 補足: 規程に合っているが、必須の事実ではない文
- 定型: 決まり文句（挨拶・「以上です」など）
- 不要: 質問と関係のない内容の文
- 記載なし: 規程にその情報が無いと述べる文
- 相反: 規程本文と食い違う断定をしている文

## 規程本文
%1$s

## 質問
%2$s

## 事実の一覧
%3$s

## 回答の文（全 %4$d 文）
%5$s

## 出力
JSON だけを返してください。説明は不要です。ラベルは文の番号順に、ちょうど %4$d 個。
ラベルは 必須 / 補足 / 定型 / 不要 / 記載なし / 相反 のいずれか。
{"labels": ["必須", "補足"]}"""
FACT_PROMPT = """[判定手順 NJ-1 / 呼び出し2: 必須の事実ごとの充足]
次の回答が、下の「必須の事実」をそれぞれどこまで述べているかを判定してください。
- full: 事実の中身（数値・条件・境目を含む）をすべて述べている
- partial: 一部だけ述べている、または数値や条件が欠けている
- none: 述べていない（食い違っている場合も none）

## 規程本文
%1$s

## 質問
%2$s

## 回答
%3$s

## 必須の事実
%4$s

## 出力
JSON だけを返してください。説明は不要です。事実はすべて、上の一覧の順で。
{"facts": [{"nid": "%5$s", "score": "full"}]}"""


def judge_prompts(inputs: DataFrame, *others: str) -> DataFrame:
    """Both prompts per (qid, run) from :func:`judge_inputs`, with ``others`` of its columns."""
    facts = F.array_join(
        F.transform(
            "nuggets",
            lambda n: F.concat(
                F.lit("- "), n["nid"], F.lit(": "), n["text"], F.lit("（"),
                F.when(n["importance"] == "vital", LABELS["vital"]).otherwise(LABELS["okay"]), F.lit("）"),
            ),
        ),
        "\n",
    )
    vitals = F.transform(vital(F.col("nuggets")), lambda n: F.concat(F.lit("- "), n["nid"], F.lit(": "), n["text"]))
    inputs = inputs.withColumn("_s", tx.sentence_lines(F.col("answer")))
    numbered = F.array_join(
        F.transform("_s", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"
    )
    first = F.coalesce(F.get(vital(F.col("nuggets")), 0)["nid"], F.lit(""))
    return inputs.select(
        "qid",
        "run",
        F.format_string(LABEL_PROMPT, F.col("body"), F.col("question"), facts, F.size("_s"), numbered).alias("label_prompt"),
        F.format_string(FACT_PROMPT, F.col("body"), F.col("question"), F.col("answer"), F.array_join(vitals, "\n"), first).alias("fact_prompt"),
        *others,
    )


# Who the judge is told to be, and how it is asked again.
JUDGE_ROLE = "あなたは社内規程の回答を採点する厳密な判定役です。JSON だけを返します。"
ASK_AGAIN = "形式が正しくありません（%s）。指定した JSON だけを、もう一度返してください。"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def judge_messages(inputs: DataFrame, *others: str) -> DataFrame:
    """What is sent to a judge for both calls: (qid, run) with arrays of role and content, and ``others`` of the inputs' columns."""
    head = _message("system", F.lit(JUDGE_ROLE))
    calls = [F.array(head, _message("user", F.col(f"{call}_prompt"))).alias(f"{call}_messages") for call in ("label", "fact")]
    return judge_prompts(inputs, *others).select("qid", "run", *calls, *others)


def retry_messages(messages: Column, reply: Column, error: Column) -> Column:
    """The second and last try: the first one, its reply, and what was wrong with it."""
    return F.concat(messages, F.array(_message("assistant", reply), _message("user", F.format_string(ASK_AGAIN, error))))


# ---- scores ---------------------------------------------------------------------


def _times(labels: Column, name: str) -> Column:
    return F.size(F.filter(labels, lambda x: x == name))


def score_records(records: DataFrame, nuggets: DataFrame) -> DataFrame:
    """Points of each judged record; undetermined ones keep null scores.

    A determined record that lacks the level of a vital fact stops the scoring: it was judged
    by another list.

    ``records``: qid, run, answer, sentences, labels, facts, status (and e.g. setting).
    """
    rows = records.join(nuggets.select("qid", "rule_id", "nuggets"), "qid")
    levels = F.map_from_entries("facts")

    def unjudged(nid: Column) -> Column:
        return F.raise_error(F.concat(F.lit("no level of fact "), nid, F.lit(" in run "), F.coalesce("run", F.lit("")))).cast("double")

    rows = rows.withColumn("_ok", (F.col("status") == "ok") & (F.size(vital(F.col("nuggets"))) > 0))
    rows = rows.withColumn(
        "points",
        F.when(
            F.col("_ok"),
            F.transform(
                vital(F.col("nuggets")),
                lambda n: F.struct(n["nid"].alias("nid"), F.coalesce(points_of(F.try_element_at(levels, n["nid"])), unjudged(n["nid"])).alias("p")),
            ),
        ).otherwise(F.array().cast("array<struct<nid:string,p:double>>")),
    )
    labels = F.when(F.col("_ok"), F.coalesce("labels", F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )
    against = F.transform(
        F.filter(F.arrays_zip(F.col("sentences").alias("s"), labels.alias("l")), lambda z: z["l"] == "contradiction"),
        lambda z: z["s"],
    )
    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["p"])
    keywords = vital_keywords(F.col("nuggets"))
    kept = [c for c in records.columns if c not in ("answer", "sentences", "labels", "facts", "status", "error", "retries")]
    return rows.select(
        *kept,
        "rule_id",
        F.col("_ok").alias("determined"),
        "points",
        F.when(F.col("_ok"), total / F.size("points")).alias("v"),
        F.when(F.col("_ok"), F.size(F.filter("points", lambda p: p["p"] == 1.0)) / F.size("points")).alias("v_strict"),
        against.alias("contradictions"),
        F.when(F.col("_ok"), (F.size(against) > 0).cast("double")).alias("c"),
        F.when(F.col("_ok") & (F.size(keywords) > 0), tx.keyword_share(F.coalesce("answer", F.lit("")), keywords)).alias("m6"),
        *[_times(labels, name).alias(f"n_{name}") for name in LABELS],
        F.substring(F.coalesce("answer", F.lit("")), 1, HEAD_CHARS).alias("head"),
    )


def question_scores(scored: DataFrame) -> DataFrame:
    """Per setting and question: means over the determined runs only.

    Questions without a determined run have k_used 0 and null scores.
    """
    used = F.col("determined")
    return scored.groupBy("setting", "qid").agg(
        F.first("rule_id").alias("rule_id"),
        F.count("*").alias("k_total"),
        F.count_if(used).alias("k_used"),
        F.avg("v").alias("s"),
        F.avg("v_strict").alias("s_strict"),
        F.avg("c").alias("c"),
        F.avg("m6").alias("m6"),
        *[F.avg(F.when(used, F.col(f"n_{name}"))).alias(f"mean_{name}") for name in LABELS],
        F.min_by(F.when(used, F.col("head")), F.when(used, F.col("run"))).alias("head"),
    )


def lost_facts(scored: DataFrame) -> DataFrame:
    """Vital facts whose mean over the determined runs is below 1: setting, qid, nid, mean_points."""
    return (
        scored.filter("determined")
        .select("setting", "qid", F.inline("points"))
        .groupBy("setting", "qid", "nid")
        .agg(F.avg("p").alias("mean_points"))
        .filter("mean_points < 1")
    )


def contradictions(scored: DataFrame) -> DataFrame:
    """Distinct contradicting sentences per question, with the place they were first seen."""
    return (
        scored.filter("determined")
        .select("setting", "qid", "run", F.posexplode("contradictions").alias("place", "sentence"))
        .groupBy("setting", "qid", "sentence")
        .agg(F.min(F.struct("run", "place")).alias("first_seen"))
    )


def coverage(scored_qids: DataFrame, records: DataFrame, nuggets: DataFrame, settings: list[str]) -> DataFrame:
    """Questions outside the score of the named settings: setting, qid, state excluded, missing or unknown."""
    excluded = scored_qids.filter("k_used = 0").select("setting", "qid", F.lit("excluded").alias("state"))
    seen = records.select("setting", "qid").distinct()
    unknown = seen.join(nuggets.select("qid"), "qid", "left_anti").select("setting", "qid", F.lit("unknown").alias("state"))
    due = nuggets.select("qid").distinct().withColumn("setting", F.explode(F.lit(settings)))
    missing = due.join(seen, ["setting", "qid"], "left_anti").select("setting", "qid", F.lit("missing").alias("state"))
    return excluded.unionByName(unknown).unionByName(missing)


def setting_summary(questions: DataFrame, outside: DataFrame, use_cluster: bool = True) -> DataFrame:
    """One row per setting: n, left-out counts, mean score with both errors, the other means."""
    counted = questions.filter("k_used > 0")
    errors = mean_and_error(counted, ["setting"], "s", "rule_id" if use_cluster else None)
    means = counted.groupBy("setting").agg(
        F.avg("s_strict").alias("mean_strict"),
        F.avg("c").alias("contradiction_rate"),
        F.avg("m6").alias("m6"),
        F.count("m6").alias("n_m6"),
        *[F.avg(f"mean_{name}").alias(f"mean_{name}") for name in LABELS],
    )
    left_out = outside.groupBy("setting").agg(
        F.count_if(F.col("state") == "excluded").alias("n_excluded"),
        F.count_if(F.col("state") == "missing").alias("n_missing"),
    )
    return (
        errors.withColumnRenamed("mean", "mean_v")
        .join(means, "setting")
        .join(left_out, "setting", "left")
        .fillna(0, ["n_excluded", "n_missing"])
        .drop("variance")
    )


def worst_questions(
    differences: DataFrame, scores_b: DataFrame, lost: DataFrame, against: DataFrame, nuggets: DataFrame, top: int = 10
) -> DataFrame:
    """The ``top`` questions that lost most (d, then qid), with what B lost, in the order of the fact list, and where it contradicts."""
    worst = differences.orderBy("d", "qid").limit(top)
    facts = nuggets.join(worst.select("qid"), "qid", "left_semi").select("qid", F.posexplode("nuggets").alias("place", "n"))
    texts = facts.select("qid", "place", F.col("n.nid").alias("nid"), F.col("n.text").alias("text"))
    line = F.concat("nid", F.lit(" "), F.coalesce("text", F.lit("")), F.when(F.col("mean_points") > 0, "（一部）").otherwise(""))
    lines = (
        lost.join(worst.select("qid"), "qid", "left_semi")
        .join(texts, ["qid", "nid"], "left")
        .groupBy("qid")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda e: e["line"]), "; ").alias("lost"))
    )
    said = (
        against.join(worst.select("qid"), "qid", "left_semi")
        .groupBy("qid")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("first_seen", "sentence"))), lambda e: e["sentence"]
                ),
                " / ",
            ).alias("contradictions")
        )
    )
    return (
        worst.join(scores_b.select("qid", "rule_id", "head"), "qid")
        .join(lines, "qid", "left")
        .join(said, "qid", "left")
        .fillna("-", ["lost", "contradictions"])
    )


# Why a draft cannot be used.
DRAFT_WITHOUT_LIST = "nuggets の配列が無い"
DRAFT_WITHOUT_TEXT = "事実に text が無い"


def clean_drafts(drafts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Fact rows from raw drafts: qid, rule_id, found (JSON) -> nid, text, importance, quote, keywords, flags, excluded, draft_error.

    One row per fact; ``excluded`` repeats the objects the draft left out on purpose, as JSON texts.
    A draft that cannot be used stays as one row flagged ``draft_failed`` with its reason: the
    ``error`` of the drafts where they have such a column (a reply that never came), or what is wrong with it.
    """
    fact = "struct<text:string,importance:string,quote:string,keywords:string>"
    given = F.col("error").cast("string") if "error" in drafts.columns else F.lit(None).cast("string")
    inner = F.get_json_object("found", "$.nuggets")
    left_out = F.get_json_object("found", "$.excluded")
    texts = F.array().cast("array<string>")
    rows = drafts.select(
        "qid", "rule_id", given.alias("_given"), F.from_json("found", f"struct<nuggets:array<{fact}>>")["nuggets"].alias("_n"),
        F.coalesce(F.filter(F.from_json(F.when(F.substring(left_out, 1, 1) == "[", left_out), "array<string>"), _is_object), texts).alias("excluded"),
        (F.substring(F.coalesce(inner, F.lit("")), 1, 1) == "[").alias("_list"),
    )
    without_list = ~F.col("_list") | F.coalesce(F.size("_n") <= 0, F.lit(True))
    without_text = F.exists("_n", lambda n: n.isNull() | F.coalesce(tx.is_blank(n["text"]), F.lit(True)))
    rows = rows.withColumn("draft_error", F.coalesce("_given", F.when(without_list, DRAFT_WITHOUT_LIST).when(without_text, DRAFT_WITHOUT_TEXT)))
    rows = saved(rows)  # replies are parsed once, for the test of the error and for both kinds of rows
    failed = rows.filter("draft_error IS NOT NULL").select(
        "qid", "rule_id", F.lit("").alias("nid"), F.lit("").alias("text"), F.lit("").alias("importance"),
        F.lit("").alias("quote"), texts.alias("keywords"), F.array(F.lit("draft_failed")).alias("flags"), texts.alias("excluded"), "draft_error",
    )
    facts = rows.filter("draft_error IS NULL").select("qid", "rule_id", "excluded", "draft_error", F.posexplode("_n").alias("place", "n"))
    known = _lookup(IMPORTANCE, F.lower(tx.strip(F.coalesce(F.col("n.importance"), F.lit("")))))
    quote = F.coalesce(F.col("n.quote"), F.lit(""))
    cleaned = facts.join(corpus.select("rule_id", "body"), "rule_id", "left").select(
        "qid",
        "rule_id",
        F.concat("qid", F.lit("-n"), (F.col("place") + 1).cast("string")).alias("nid"),
        tx.strip(F.col("n.text")).alias("text"),
        F.coalesce(known, F.lit("okay")).alias("importance"),
        quote.alias("quote"),
        F.coalesce(F.from_json(F.col("n.keywords"), "array<string>"), texts).alias("keywords"),
        F.array_compact(
            F.array(
                F.when(known.isNull(), "importance_unknown"),
                F.when(~tx.quoted_verbatim(quote, F.col("body")), "quote_not_verbatim"),
            )
        ).alias("flags"),
        "excluded",
        "draft_error",
    )
    return cleaned.unionByName(failed)
