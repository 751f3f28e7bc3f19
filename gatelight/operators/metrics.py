"""Retrieval, operations and answer metrics over question tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.functions import text as tx
from gatelight.session import saved

RECALL_DEPTH = 5
RANK_DEPTH = 10
BLOCK_CHARS = 600

# Categories that must be refused, judge scores, pass lines, reasons, texts.
REFUSAL_CATEGORIES = ("permission_test", "hallucination_test")
JUDGE_SCORES = ("context_relevance", "answer_relevance", "faithfulness")
PASS_LINES = {
    "recall_at_5": (">=", 0.80),
    "mrr": (">=", 0.60),
    "context_relevance": (">=", 0.70),
    "faithfulness": (">=", 0.90),
    "answer_relevance": (">=", 0.80),
    "correctness": (">=", 0.80),
    "permission_rate": (">=", 1.00),
    "refusal_rate": (">=", 0.95),
    "ftl_p50": ("<=", 5.0),
    "ftl_p95": ("<=", 12.0),
    "total_p50": ("<=", 15.0),
}
REASON_PERMISSION = "権限フィルタ違反"
REASON_REFUSAL = "拒否すべきだが応答してしまった"
NO_CHUNKS = "(なし)"


def recall_at_k(retrieved: Column, expected: Column, k: int = RECALL_DEPTH) -> Column:
    """1 when any expected source is among the first k, or none is expected."""
    none = F.coalesce(F.size(expected), F.lit(0)) <= 0
    hit = F.arrays_overlap(F.slice(retrieved, 1, k), expected)
    return F.when(none, 1.0).when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def reciprocal_rank(retrieved: Column, expected: Column, k: int = RANK_DEPTH) -> Column:
    none = F.coalesce(F.size(expected), F.lit(0)) <= 0
    right = F.transform(F.slice(retrieved, 1, k), lambda s: F.array_contains(expected, s))
    place = F.coalesce(F.array_position(right, True), F.lit(0))
    return F.when(none, 1.0).when(place > 0, 1.0 / place).otherwise(0.0)


def _allowed() -> Column:
    return F.coalesce(F.bool_and(F.col("access_level") <= F.col("user_access_level")), F.lit(True))


def _level_error() -> Column:
    return F.when(F.bool_or(F.col("access_level").isNull()), "run_failed: hit without access level")


def permission_check(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question whether every hit was allowed; no hit is fine, a hit without level is an error."""
    seen = hits.groupBy("question_id").agg(_allowed().alias("_ok"), _level_error().alias("error"))
    return questions.select("question_id").join(seen, "question_id", "left").select(
        "question_id", F.coalesce("_ok", F.lit(True)).alias("permission_ok"), "error"
    )


def refusal_correct(should_refuse: Column, answer: Column) -> Column:
    return F.when(F.coalesce(should_refuse, F.lit(False)), tx.is_refusal(answer)).otherwise(F.lit(True))


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, per group: {column name: 0..100}.

    A mergeable sketch first brackets each wanted rank between two values (a group
    of up to 10,000 rows is its own bracket). Rows below the bracket are only
    counted; those inside are counted per distinct value, dealt into ranges of
    values and stored. A range starts where the counts of the ranges before it end,
    so ranks are told range by range: no task ever holds or orders a group, nor a
    bracket, however many values are in it. A bracket that should miss its rank is an
    error, never a missing value. A null key is a group like any other.
    """
    accuracy = 10_000
    margin = 4.0 / accuracy
    names = list(points)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))

    def edge(p: float, bound: Column) -> Column:
        if p <= 0 or p >= 1:
            return bound
        return F.when(F.count("*") <= accuracy, bound).otherwise(F.percentile_approx("x", p, accuracy))

    brackets = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[edge(points[n] / 100 - margin, F.min("x")).alias(f"low_{n}") for n in names],
        *[edge(points[n] / 100 + margin, F.max("x")).alias(f"high_{n}") for n in names],
    )
    # One pass tells a row's place for every point: below its bracket or in it. Only distinct values are kept of the latter.
    places = F.filter(
        F.array(
            *[
                F.when(F.col("x") < F.col(f"low_{n}"), F.struct(F.lit(n).alias("point"), F.lit(None).cast("double").alias("x")))
                .when(F.col("x") <= F.col(f"high_{n}"), F.struct(F.lit(n).alias("point"), F.col("x").alias("x")))
                for n in names
            ]
        ),
        lambda e: e.isNotNull(),
    )
    counted = same_group(rows, brackets, by).select(*by, "total", F.explode(places).alias("e")).groupBy(*by, "total", "e.point", "e.x").agg(F.count("*").alias("times"))
    # A null value, the rows below, comes first.
    ranged = saved(counted.repartitionByRange(*by, "point", F.asc_nulls_first("x")).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "point", "part").agg(F.sum("times").alias("held"))
    order = Window.partitionBy(*by, "point").orderBy("part")
    starts = parts.select(*by, "point", "part", (F.sum("held").over(order) - F.col("held")).alias("start"))
    upto = F.sum("times").over(Window.partitionBy(*by, "point", "part").orderBy(F.asc_nulls_first("x")))
    placed = same_group(ranged.withColumn("upto", upto), starts, [*by, "point", "part"])
    share = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, points[n] / 100.0)]), F.col("point"))
    at = (F.col("total") - 1) * share
    down, up = F.floor(at), F.least(F.floor(at) + 1, F.col("total") - 1)
    last = F.col("start") + F.col("upto") - 1

    def value_at(place: Column) -> Column:
        return F.max(F.when((last - F.col("times") < place) & (place <= last), F.col("x")))

    found = placed.groupBy(*by, "point").agg(value_at(down).alias("low"), value_at(up).alias("high"), F.max(at - down).alias("rest"))
    missed = F.raise_error(F.lit("percentile: the bracket misses its rank")).cast("double")
    each = found.withColumn("at", F.when(F.col("low").isNull() | F.col("high").isNull(), missed).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("rest")))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("point") == n, F.col("at"))).alias(n) for n in names])


def same_group(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Joins on the group keys, where null equals null."""
    keys = {c: f"__{n}_right" for n, c in enumerate(by)}
    named = right.select(*[F.col(c).alias(k) for c, k in keys.items()], *[c for c in right.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return left.join(named, same).drop(*keys.values())


def judge_scores(raw: Column) -> dict[str, Column]:
    """The three scores of a judge's reply: outermost braces, each clamped to 0..1, else 0."""
    found = tx.json_value(F.regexp_extract(raw, r"(?s)(\{.*\})", 1))
    return {name: _clamped(F.try_variant_get(found, f"$.{name}", "string")) for name in JUDGE_SCORES}


def _clamped(text: Column) -> Column:
    number = tx.strip(text).try_cast("double")
    return F.when(number.isNull() | (number < 0), 0.0).when(number > 1, 1.0).otherwise(number)


def judge_blocks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbered chunk texts for a judge, each cut to 600 characters; a fixed word without chunks."""
    from gatelight.plans.retrieval import numbered_blocks

    blocks = numbered_blocks(
        hits, F.coalesce("source_file", F.lit("?")), F.substring(F.coalesce("content", F.lit("")), 1, BLOCK_CHARS)
    )
    return questions.select("question_id").join(blocks, "question_id", "left").select(
        "question_id", F.coalesce("context", F.lit(NO_CHUNKS)).alias("chunks_block")
    )


def grounded_share(answer: Column, flags: Column) -> Column:
    """Mean of the flags of the answer's sentences, as many as both have; 0 without any."""
    n = F.least(F.size(tx.sentences(answer)), F.coalesce(F.size(flags), F.lit(0)))
    total = F.aggregate(F.slice(flags, 1, F.greatest(n, F.lit(0))), F.lit(0.0), lambda acc, f: acc + f)
    return F.when(n > 0, total / n).otherwise(0.0)


def evaluate(
    questions: DataFrame, hits: DataFrame, answers: DataFrame, replies: DataFrame | None = None
) -> DataFrame:
    """One row of metrics per question.

    ``answers``: question_id, answer, first_token_latency, total_latency, error;
    ``replies``: question_id, raw (judge), error. Without a judge its scores are 0.
    """
    lists = hits.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("source_file").alias("s")))), lambda e: e["s"])
        .alias("retrieved"),
        _allowed().alias("_ok"),
        _level_error().alias("_level_error"),
    )
    rows = (
        questions.join(lists, "question_id", "left")
        .join(answers.withColumnRenamed("error", "_run_error"), "question_id", "left")
    )
    if replies is None:
        rows = rows.withColumn("raw", F.lit(None).cast("string")).withColumn("_judge_error", F.lit(None).cast("string"))
    else:
        rows = rows.join(replies.withColumnRenamed("error", "_judge_error"), "question_id", "left")
    retrieved = F.coalesce("retrieved", F.array().cast("array<string>"))
    answer = F.coalesce("answer", F.lit(""))
    error = F.coalesce(
        F.concat(F.lit("run_failed: "), F.col("_run_error")),
        F.col("_level_error"),
        F.concat(F.lit("judge_failed: "), F.col("_judge_error")),
    )
    return rows.select(
        "question_id",
        "category",
        recall_at_k(retrieved, F.col("expected_sources")).alias("recall_at_5"),
        reciprocal_rank(retrieved, F.col("expected_sources")).alias("mrr"),
        tx.keyword_share(answer, F.col("expected_answer_keywords")).alias("correctness"),
        F.coalesce("_ok", F.lit(True)).alias("permission_ok"),
        refusal_correct(F.col("should_refuse"), answer).alias("refusal_correct"),
        *[c.alias(n) for n, c in judge_scores(F.col("raw")).items()],
        F.coalesce("first_token_latency", F.lit(0.0)).alias("first_token_latency"),
        F.coalesce("total_latency", F.lit(0.0)).alias("total_latency"),
        error.alias("error"),
    )


def summarize(results: DataFrame, by: str = "setting") -> DataFrame:
    """One row per setting. Rows with an error count as errors and nowhere else."""
    good = F.col("error").isNull()
    target = good & F.col("category").isin(*REFUSAL_CATEGORIES)
    means = {
        n: F.col(n)
        for n in ("recall_at_5", "mrr", "context_relevance", "faithfulness", "answer_relevance", "correctness")
    }
    means["permission_rate"] = F.col("permission_ok").cast("double")
    table = results.groupBy(by).agg(
        F.count_if(good).alias("n"),
        F.count_if(~good).alias("errors"),
        *[mean_or_zero(F.when(good, c)).alias(n) for n, c in means.items()],
        F.coalesce(F.avg(F.when(target, F.col("refusal_correct").cast("double"))), F.lit(1.0)).alias("refusal_rate"),
    )
    clean = results.filter(good)
    first = percentiles(clean, [by], "first_token_latency", {"ftl_p50": 50, "ftl_p95": 95})
    whole = percentiles(clean, [by], "total_latency", {"total_p50": 50})
    table = table.join(first, by, "left").join(whole, by, "left").withColumn("all_errored", F.col("n") == 0)
    return table.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ftl_p50", "ftl_p95", "total_p50")})


def threshold_table(summary: DataFrame, by: str = "setting") -> DataFrame:
    """One row per setting and pass line: value, limit, passed."""
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"), F.col(name).alias("value"), F.lit(sign).alias("sign"),
                F.lit(limit).alias("bound"),
                (F.col(name) >= limit if sign == ">=" else F.col(name) <= limit).alias("passed"),
            )
            for name, (sign, limit) in PASS_LINES.items()
        ]
    )
    return summary.select(by, "all_errored", F.inline(lines))


def verdicts(summary: DataFrame, by: str = "setting") -> DataFrame:
    return threshold_table(summary, by).groupBy(by).agg(
        (F.bool_and("passed") & ~F.bool_or("all_errored")).alias("passed")
    )


def failures(results: DataFrame) -> DataFrame:
    """Questions that failed, with every reason."""
    reasons = F.array_compact(
        F.array(
            F.col("error"),
            F.when(~F.col("permission_ok"), REASON_PERMISSION),
            F.when(~F.col("refusal_correct"), REASON_REFUSAL),
        )
    )
    return results.withColumn("reasons", F.array_join(reasons, "; ")).filter(F.size(reasons) > 0)


def _filled(number: Column, digits: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def dataset_problems(
    questions: DataFrame, corpus: DataFrame, expected_counts: dict[str, int], prefix: str = "Q", digits: int = 3, expected_total: int | None = None
) -> DataFrame:
    """What is wrong with a question set, one row per finding: check, subject.

    ``corpus``: source_path, content. Sequence numbers (at least ``digits`` digits, filled
    up with zeros) are compared with the count, every expected category with its rows, the
    number of rows with ``expected_total``, sources and documents in both directions,
    keywords against the text of their question's sources. The questions are stored once;
    the corpus is read once, and no text is carried beyond the join with its citations.
    """
    questions = saved(questions)
    total = questions.count()

    def found(check: str, condition: Column, subject: Column) -> Column:
        return F.when(condition, F.struct(F.lit(check).alias("check"), subject.alias("subject")))

    def findings(rows: DataFrame, *checks: Column) -> DataFrame:
        return rows.select(F.inline(F.array_compact(F.array(*checks))))

    # Row by row.
    refusing = F.col("category").isin(*REFUSAL_CATEGORIES)
    asked = F.col("question_id")
    parts = [findings(
        questions,
        found("refuse flag missing", refusing & ~F.col("should_refuse"), asked),
        found("no expected source", ~refusing & (F.size("expected_sources") <= 0), asked),
        found("permission test at top level", (F.col("category") == "permission_test") & (F.col("user_access_level") >= 3), asked),
    )]
    # By category, where every expected one has a row of its own that counts none.
    wanted = questions.sparkSession.createDataFrame(list(expected_counts.items()), "category string, wanted long")
    both = questions.select("category", F.lit(1).alias("n"), F.lit(None).cast("long").alias("wanted")).unionByName(wanted.withColumn("n", F.lit(0)))
    counts = both.groupBy("category").agg(F.sum("n").alias("n"), F.coalesce(F.max("wanted"), F.lit(0)).alias("wanted"))
    parts.append(findings(counts, found("category count", F.col("n") != F.col("wanted"), F.col("category"))))
    if expected_total not in (None, total):
        parts.append(questions.sparkSession.createDataFrame([("question count", str(total))], "check string, subject string"))
    # By id: its rows, its sources, and the keywords of those rows that are to be answered.
    number = F.regexp_extract("question_id", rf"\A{prefix}(\d+)\z", 1).try_cast("bigint")
    out_of_order = F.coalesce((number < 1) | (number > total) | (asked != F.concat(F.lit(prefix), _filled(number, digits))), F.lit(True))
    ids = questions.groupBy("question_id").agg(
        F.count("*").alias("n"), F.flatten(F.collect_list("expected_sources")).alias("sources"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("should_refuse"), F.col("expected_answer_keywords"))))).alias("keywords"),
    )
    cited = ids.select("question_id", "keywords", F.posexplode_outer(F.when(F.size("sources") > 0, F.col("sources"))).alias("place", "cited_path"), (F.col("n") > 1).alias("repeated"), out_of_order.alias("out_of_order"))
    met = cited.join(corpus.select("source_path", "content"), F.col("cited_path") == F.col("source_path"), "full_outer")
    path, first = F.col("source_path"), F.coalesce("place", F.lit(0)) == 0

    def open_(check: str, condition: Column, subject: Column) -> Column:
        return F.when(condition, F.struct(F.lit(check).alias("check"), subject.alias("subject"), F.lit(False).alias("settled")))

    grounded = F.transform(
        "keywords", lambda k: F.struct(
            F.lit("keyword not in sources").alias("check"), F.concat_ws(" ", asked, k).alias("subject"), F.contains(F.coalesce("content", F.lit("")), k).alias("settled")))
    entries = F.concat(F.coalesce(grounded, F.array().cast("array<struct<check:string,subject:string,settled:boolean>>")), F.array_compact(F.array(
        open_("repeated id", first & F.col("repeated"), asked),
        open_("id out of sequence", first & F.col("out_of_order"), asked),
        open_("unknown source", F.col("cited_path").isNotNull() & path.isNull(), F.concat_ws(" ", asked, F.col("cited_path"))),
        open_("document never expected", path.isNotNull() & F.col("cited_path").isNull(), path),
        open_("short document", F.length("content") < 1000, path),
    )))
    # A keyword may be in any of a question's sources; a document is short once, however often it is cited.
    settled = met.select(F.inline(entries)).groupBy("check", "subject").agg(F.bool_or("settled").alias("settled"), F.count("*").cast("int").alias("times"))
    times = F.when(F.col("check") == "unknown source", F.col("times")).otherwise(1)
    parts.append(settled.filter(~F.col("settled")).select("check", F.explode(F.array_repeat("subject", times)).alias("subject")))
    return reduce(lambda a, b: a.unionByName(b), parts)
