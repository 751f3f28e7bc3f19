"""Hybrid retrieval for a whole table of questions, and what is built from its hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.functions import text as tx
from gatelight.operators.access import revalidate, searchable
from gatelight.operators.ranking import best_first, nearest_chunks, stored_questions, top_k
from gatelight.session import saved

TOP_K = 5
RERANK_CANDIDATES = 30
# The fusion constant is not given by the reference behaviour; 60 is the published default
# (Cormack, Clarke and Buettcher, SIGIR 2009).
FUSION_K = 60

# Texts shown to the reader or sent to the model.
NO_HIT_ANSWER = "その質問に関連する資料が見つかりませんでした。"
UNKNOWN_SOURCE = "不明"
SYSTEM_TEXT = """あなたは社内情報専門のアシスタントです。
以下の【参考情報】のみを根拠として質問に回答してください。
参考情報に含まれていない情報については「その情報は現在の資料には含まれていません」と回答してください。
回答は必ず日本語で行ってください。
回答中で根拠にした参考情報には、該当箇所の文末に [1] のようにその番号を付けて引用してください。"""
USER_TEXT = "【参考情報】\n%s\n\n【質問】\n%s"


def fetch_limit(rerank: bool, top: int = TOP_K, candidates: int = RERANK_CANDIDATES) -> int:
    return candidates if rerank else top


def leg_limit(rerank: bool, top: int = TOP_K, candidates: int = RERANK_CANDIDATES) -> int:
    """How deep each leg is read before fusion."""
    return 3 * max(fetch_limit(rerank, top, candidates), top)


def fuse(legs: DataFrame, limit: int, k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion of the legs' rankings, best ``limit`` per question."""
    fused = legs.groupBy("question_id", "document_id", "chunk_index").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")
    )
    return top_k(fused, ["question_id"], best_first(), limit)


def project_hits(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The payload of each hit. Only now is content read, for the few rows that ranked."""
    payload = chunks.select("document_id", "chunk_index", "content", "source_file", "access_level")
    return ranked.join(payload, ["document_id", "chunk_index"])


def overlap_score(question: Column, content: Column) -> Column:
    """Model-free scorer: share of the question's distinct tokens found in the content."""
    asked = F.array_distinct(tx.tokens(question))
    return F.when(
        F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, tx.tokens(content))) / F.size(asked), 9)
    ).otherwise(0.0)


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Orders each question's hits by the scorer, ties by the rank before.

    ``scorer`` is a Column function, native or a pandas UDF. Where it gives null
    for any hit of a question, that question keeps its order and gets no score.
    """
    per_question = Window.partitionBy("question_id")
    scored = hits.withColumn("rerank_score", scorer(F.col("question"), F.col("content")).cast("double"))
    scored = scored.withColumn("_failed", F.max(F.col("rerank_score").isNull()).over(per_question)).withColumn(
        "rerank_score", F.when(~F.col("_failed"), F.col("rerank_score"))
    )
    order = per_question.orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rank"))
    return scored.withColumn("rank", F.row_number().over(order)).drop("_failed")


def final_cut(hits: DataFrame, top: int = TOP_K) -> DataFrame:
    """First ``top`` of what is left, counted anew: rows refused on the way are not refilled."""
    return top_k(hits.withColumnRenamed("rank", "_before"), ["question_id"], [F.col("_before")], top).drop("_before")


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    registry: DataFrame,
    top: int = TOP_K,
    use_rerank: bool = True,
    candidates: int = RERANK_CANDIDATES,
    fusion_k: int = FUSION_K,
    legs: tuple[str, ...] = ("dense", "sparse"),
    scorer: Callable[[Column, Column], Column] = overlap_score,
    payload: DataFrame | None = None,
    postings: DataFrame | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """Prefilter, both legs, fusion, revalidation, rerank, cut: hits of every question.

    The store is read for its vectors and keys, and once more for the content of the
    fused rows; ``payload`` names another table with that content, where vectors and texts
    are kept apart, ``postings`` the stored index of the searchable chunks' sparse vectors,
    ``found`` legs that were ranked before, at this depth or a greater one.
    """
    asked = saved(stored_questions(questions, legs, "question"))
    depth = leg_limit(use_rerank, top, candidates)
    found = nearest_chunks(asked, searchable(chunks), depth, legs, postings) if found is None else found.filter(F.col("rank") <= depth)
    fused = fuse(found, fetch_limit(use_rerank, top, candidates), fusion_k)
    # Written once: Spark then knows its size and chooses the joins by it, so that neither
    # the content nor the registry is shuffled for a few questions.
    fused = saved(fused.join(asked.select("question_id", "question", "user_access_level"), "question_id"))
    hits = project_hits(fused, searchable(chunks if payload is None else payload))
    hits = revalidate(hits, registry, fused)
    if use_rerank:
        hits = rerank(hits, scorer)
    return final_cut(hits, top)


def source_name() -> Column:
    return F.when(F.col("source_file").isNull(), UNKNOWN_SOURCE).otherwise(tx.basename(F.col("source_file")))


def numbered_blocks(hits: DataFrame, head: Column, content: Column) -> DataFrame:
    """``[rank] head`` over content, one text per question. A question has top-k hits, no more."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), head, F.lit("\n"), content)
    return hits.groupBy("question_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), line.alias("t")))), lambda e: e["t"]
            ),
            "\n\n",
        ).alias("context")
    )


def context(hits: DataFrame) -> DataFrame:
    return numbered_blocks(hits, source_name(), F.coalesce("content", F.lit("")))


def messages(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The two-message input of a text model, per question."""
    body = F.format_string(USER_TEXT, F.coalesce("context", F.lit("")), F.col("question"))
    return questions.join(contexts, "question_id", "left").select(
        "question_id",
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_TEXT).alias("content")),
            F.struct(F.lit("user").alias("role"), body.alias("content")),
        ).alias("messages"),
    )


def no_hit_answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """The fixed answer, for questions without a single hit."""
    return questions.join(hits.select("question_id"), "question_id", "left_anti").select(
        "question_id", F.lit(NO_HIT_ANSWER).alias("answer")
    )


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Every ``[n]`` in an answer, in order, and what it points to.

    ``answers``: answer_id, answer; ``sources``: answer_id, id, source_file,
    redacted, legacy. state: ``source``, ``unavailable`` or ``text``.
    """
    marks = answers.select(
        "answer_id", F.posexplode_outer(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1)).alias("position", "number")
    ).filter("position is not null")
    known = sources.select(
        "answer_id",
        F.col("id").cast("string").alias("number"),
        F.col("source_file"),
        (F.coalesce("redacted", F.lit(False)) | F.coalesce("legacy", F.lit(False))).alias("_closed"),
    )
    return marks.join(known, ["answer_id", "number"], "left").select(
        "answer_id",
        "position",
        "number",
        F.when(F.col("_closed").isNull(), "text").when(F.col("_closed"), "unavailable").otherwise("source").alias("state"),
        F.when(~F.col("_closed"), F.col("source_file")).alias("source_file"),
    )


def distinct_sources(sources: DataFrame) -> DataFrame:
    """One row per answer and file name (or id where there is none): the first listed."""
    name = F.when(F.coalesce("source_file", F.lit("")) != "", F.col("source_file"))
    key = F.coalesce(name, F.concat(F.lit("id:"), F.col("id").cast("string")))
    first = [F.min_by(c, "position").alias(c) for c in sources.columns if c not in ("answer_id", "position")]
    return (
        sources.withColumn("source_key", key)
        .groupBy("answer_id", "source_key")
        .agg(F.min("position").alias("position"), *first)
    )
