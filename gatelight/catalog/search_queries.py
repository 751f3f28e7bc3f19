"""Retrieval and its metrics as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.catalog.base import query, view
from gatelight.catalog.inputs import Inputs, sql_basename, sql_strip, _PLACES
from gatelight.functions import text as tx
from gatelight.operators import metrics, ranking
from gatelight.operators.access import searchable
from gatelight.plans import retrieval
from gatelight.session import saved

# ---- dense ranking over the given vectors: the mean vector of each label asks ---

view("points", """
  SELECT vec_id::STRING AS document_id, 0 AS chunk_index, embedding, (1 + label % 3)::INT AS access_level,
    vec_id % 19 <> 0 AS is_active, vec_id % 29 = 0 AS unclassified, label FROM embeddings""")
view("centres", """
  SELECT 'L' || label AS question_id, (1 + label % 3)::INT AS lvl, list(m ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY ALL) GROUP BY label""")


@query(
    "r1_dense_top_k",
    """SELECT question_id, document_id, chunk_index, score, rank::INT AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM (
           SELECT c.question_id, p.document_id, p.chunk_index, round(list_cosine_similarity(c.v, p.embedding::DOUBLE[]), 9) AS score
           FROM centres c JOIN points p ON p.access_level <= c.lvl AND p.is_active AND NOT p.unclassified)) WHERE rank <= 90""",
    ("points", "centres"),
)
def r1(i: Inputs) -> DataFrame:
    return ranking.nearest_chunks(*_label_search(i), 90, ("dense",)).drop("leg")


def _label_search(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """The mean vector of each label as a question, and all vectors as searchable chunks."""
    vec, label = i.table("embeddings"), F.col("label")
    points = vec.select(
        F.col("vec_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("embedding").alias("dense"),
        (1 + label % 3).alias("access_level"), (F.col("vec_id") % 19 != 0).alias("is_active"), (F.col("vec_id") % 29 == 0).alias("unclassified"),
    )
    means = vec.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("dense"))
    asked = centres.select(F.concat(F.lit("L"), label.cast("string")).alias("question_id"), (1 + label % 3).alias("user_access_level"), "dense")
    return asked, searchable(points)


def _with_odd_vectors(points: DataFrame) -> DataFrame:
    """Some vectors one number too long, some missing: in between, whatever batch they fall into."""
    at = F.col("document_id").cast("long") % 5
    return points.withColumn("dense", F.when(at == 1, F.array_append("dense", F.lit(9.0))).when(at == 2, F.lit(None)).otherwise(F.col("dense")))


@query(
    "r1_odd_vectors",
    """SELECT document_id, chunk_index, CASE WHEN document_id::BIGINT % 5 = 1 THEN length(embedding) + 1 ELSE -1 END AS length
       FROM points WHERE document_id::BIGINT % 5 IN (1, 2) AND is_active AND NOT unclassified""",
    ("points",),
)
def r1_odd(i: Inputs) -> DataFrame:
    asked, points = _label_search(i)
    return ranking.odd_vectors(asked, _with_odd_vectors(points))


@query(
    "r1_mixed_lengths",
    """SELECT question_id, document_id, chunk_index, score, rank::INT AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM (
           SELECT c.question_id, p.document_id, p.chunk_index, round(list_cosine_similarity(c.v, p.embedding::DOUBLE[]), 9) AS score
           FROM centres c JOIN points p ON p.access_level <= c.lvl AND p.is_active AND NOT p.unclassified
           WHERE p.document_id::BIGINT % 5 NOT IN (1, 2))) WHERE rank <= 90""",
    ("points", "centres"),
)
def r1_mixed(i: Inputs) -> DataFrame:
    asked, points = _label_search(i)
    return ranking.nearest_chunks(asked, _with_odd_vectors(points), 90, ("dense",)).drop("leg")


view("sparse_leg_known", f"""
  SELECT *, {_PLACES} AS rank FROM (
    SELECT q.question_id, s.document_id, s.chunk_index, round(sum(p.weight * c.weight), 9) AS score
    FROM question_postings p JOIN questions q USING (question_id)
    JOIN chunk_postings c USING (token_id)
    JOIN searchable s ON s.document_id = c.document_id AND s.chunk_index = c.chunk_index AND s.access_level <= q.user_access_level
    WHERE s.chunk_index > 0
    GROUP BY ALL) QUALIFY rank <= 90""", "question_postings", "questions", "chunk_postings", "searchable")


@query("r6_null_levels", "SELECT question_id, document_id, chunk_index, score, rank::INT AS rank FROM sparse_leg_known", ("sparse_leg_known",))
def r6_null_levels(i: Inputs) -> DataFrame:
    # Every document's first chunk has lost its level; nobody may be shown it.
    store = searchable(i.sparse_store).withColumn("access_level", F.when(F.col("chunk_index") > 0, F.col("access_level")))
    return ranking.nearest_chunks(i.asked, store, 90, ("sparse",)).drop("leg")


@query("r2_sparse_top_k", "SELECT question_id, document_id, chunk_index, score, rank::INT AS rank FROM sparse_leg", ("sparse_leg",))
def r2(i: Inputs) -> DataFrame:
    return ranking.nearest_chunks(i.asked, i.sparse_store, 90, ("sparse",), i.postings).drop("leg")


@query(
    "r3_rank_fusion", "SELECT question_id, document_id, chunk_index, score, rank::INT AS rank FROM fused", ("fused",)
)
def r3(i: Inputs) -> DataFrame:
    return retrieval.fuse(ranking.nearest_chunks(i.asked, searchable(i.vector_store), 90, postings=i.postings), 30)


@query(
    "r4_hit_projection",
    """SELECT question_id, document_id, chunk_index, score, content, source_file, access_level
       FROM fused JOIN searchable USING (document_id, chunk_index)""",
    ("fused", "searchable"),
)
def r4(i: Inputs) -> DataFrame:
    fused = retrieval.fuse(ranking.nearest_chunks(i.asked, searchable(i.vector_store), 90, postings=i.postings), 30)
    return retrieval.project_hits(fused, searchable(i.search_store)).select(
        "question_id", "document_id", "chunk_index", "score", "content", "source_file", "access_level"
    )


@query("r5_rerank", "SELECT question_id, document_id, chunk_index, rerank_score, place::INT AS rank FROM reranked", ("reranked",))
def r5(i: Inputs) -> DataFrame:
    # All candidates in their new order: the cut is as wide as the candidate list.
    hits = retrieval.retrieve(i.asked, i.vector_store, i.registry_now, top=retrieval.RERANK_CANDIDATES, payload=i.search_store, postings=i.postings)
    return hits.select("question_id", "document_id", "chunk_index", "rerank_score", "rank")


_HIT = ["question_id", "rank", "document_id", "chunk_index", "score", "source_file", "access_level"]
_HIT_SQL = "question_id, rank::INT AS rank, document_id, chunk_index, score, source_file, access_level"


@query("r6_hybrid_retrieve", f"SELECT {_HIT_SQL}, rerank_score FROM hits", ("hits",))
def r6(i: Inputs) -> DataFrame:
    return i.hits.select(*_HIT, "rerank_score")


@query("r6_hybrid_without_rerank", f"SELECT {_HIT_SQL} FROM hits_plain", ("hits_plain",))
def r6_plain(i: Inputs) -> DataFrame:
    return i.hits_plain.select(*_HIT)


@query(
    "r7_final_cut",
    """SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""",
)
def r7(i: Inputs) -> DataFrame:
    return ranking.top_k(i.table("events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 5).select("user_id", "event_id", "rank")


@query(
    "r8_chunk_lookup",
    """SELECT t.conv_id, t.turn, s.content FROM (SELECT conv_id, turn, (conv_id * 3 + turn)::STRING AS document_id, (turn % 3)::INT AS chunk_index FROM conversations) t
       JOIN store s USING (document_id, chunk_index) WHERE s.is_active""",
    ("store",),
)
def r8(i: Inputs) -> DataFrame:
    keys = i.table("conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).cast("string").alias("document_id"),
        (F.col("turn") % 3).cast("int").alias("chunk_index"),
    )
    return keys.join(i.stored_content(keys), ["document_id", "chunk_index"]).select("conv_id", "turn", "content")


@query("r9_basename", f"SELECT url, {sql_basename('url')} AS name FROM pages")
def r9(i: Inputs) -> DataFrame:
    return i.table("pages").select("url", tx.basename(F.regexp_replace("url", "^", "")).alias("name"))


@query(
    "r10_numbered_context",
    f"""SELECT question_id, string_agg('[' || rank || '] ' || {sql_basename('source_file')} || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context
        FROM hits GROUP BY question_id""",
    ("hits",),
)
def r10(i: Inputs) -> DataFrame:
    return retrieval.context(i.hits)


@query(
    "r11_message_assembly",
    f"""SELECT q.question_id, m.role, CASE m.role WHEN 'system' THEN '{retrieval.SYSTEM_TEXT}'
          ELSE '【参考情報】' || chr(10) || coalesce(c.context, '') || chr(10) || chr(10) || '【質問】' || chr(10) || q.question END AS content
        FROM questions q LEFT JOIN (SELECT question_id, string_agg('[' || rank || '] ' || {sql_basename('source_file')} || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context
          FROM hits GROUP BY question_id) c USING (question_id), (VALUES ('system'), ('user')) m(role)""",
    ("questions", "hits"),
)
def r11(i: Inputs) -> DataFrame:
    built = retrieval.messages(i.asked.select("question_id", "question"), retrieval.context(i.hits))
    return built.select("question_id", F.inline("messages"))


view("cited_turns", """
  SELECT conv_id * 1000000 + turn AS answer_id, conv_id, turn, text || ' [1] and [' || (turn % 5) || '] or [x] [12].' AS answer
  FROM conversations WHERE role = 'assistant'""")
view("turn_sources", """
  SELECT answer_id, id, 'doc' || (conv_id * 3 + id) || '.txt' AS source_file, id = 2 AS redacted FROM cited_turns, (VALUES (1), (2), (3)) v(id)""",
     "cited_turns")


def _cited(i: Inputs) -> tuple[DataFrame, DataFrame]:
    turns = i.table("conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("answer_id"), "conv_id",
        F.concat("text", F.lit(" [1] and ["), (F.col("turn") % 5).cast("string"), F.lit("] or [x] [12].")).alias("answer"),
    )
    sources = turns.select("answer_id", "conv_id", F.explode(F.lit([1, 2, 3])).alias("id")).select(
        "answer_id", "id", F.concat(F.lit("doc"), (F.col("conv_id") * 3 + F.col("id")).cast("string"), F.lit(".txt")).alias("source_file"),
        (F.col("id") == 2).alias("redacted"), F.lit(False).alias("legacy"),
    )
    return turns, sources


@query(
    "r12_citations",
    r"""SELECT c.answer_id, (c.pos - 1)::INT AS position, c.number, CASE WHEN s.id IS NULL THEN 'text' WHEN s.redacted THEN 'unavailable' ELSE 'source' END AS state,
          CASE WHEN NOT s.redacted THEN s.source_file END AS source_file
        FROM (SELECT answer_id, unnest(l) AS number, generate_subscripts(l, 1) AS pos
              FROM (SELECT answer_id, regexp_extract_all(answer, '\[(\d+)\]', 1) AS l FROM cited_turns)) c
        LEFT JOIN turn_sources s ON s.answer_id = c.answer_id AND s.id::STRING = c.number""",
    ("cited_turns", "turn_sources"),
)
def r12(i: Inputs) -> DataFrame:
    turns, sources = _cited(i)
    return retrieval.citations(turns, sources)


@query(
    "r13_source_dedupe",
    """SELECT conv_id AS answer_id, source_key, min(turn) AS position FROM (SELECT conv_id, turn,
         CASE WHEN role = 'user' THEN 'id:' || turn ELSE role || (turn % 4) END AS source_key FROM conversations) GROUP BY ALL""",
)
def r13(i: Inputs) -> DataFrame:
    listed = i.table("conversations").select(
        F.col("conv_id").alias("answer_id"), F.col("turn").alias("position"), F.col("turn").alias("id"),
        F.when(F.col("role") == "user", F.when(F.col("turn") % 2 == 0, "")).otherwise(
            F.concat("role", (F.col("turn") % 4).cast("string"))
        ).alias("source_file"),
    )
    return retrieval.distinct_sources(listed).select("answer_id", "source_key", "position")


@query(
    "r14_no_hit_answer",
    "SELECT question_id, CASE WHEN question_id NOT IN (SELECT question_id FROM hits_plain) THEN 'その質問に関連する資料が見つかりませんでした。' ELSE '-' END AS answer FROM questions",
    ("questions", "hits_plain"),
)
def r14(i: Inputs) -> DataFrame:
    asked = i.asked.select("question_id")
    fixed = retrieval.no_hit_answers(asked, i.hits_plain)
    return asked.join(fixed, "question_id", "left").fillna("-", ["answer"])


# ---- metrics --------------------------------------------------------------------


def _evaluated(i: Inputs) -> DataFrame:
    hits = saved(i.hits)  # read by the answers and by the metrics
    return metrics.evaluate(i.questions, hits, i.answers(hits), i.replies)


@query("m1_recall_at_k", "SELECT question_id, recall_at_5 FROM evaluated", ("evaluated",))
def m1(i: Inputs) -> DataFrame:
    return _evaluated(i).select("question_id", "recall_at_5")


@query("m2_reciprocal_rank", "SELECT question_id, round(mrr, 9) AS mrr FROM evaluated", ("evaluated",))
def m2(i: Inputs) -> DataFrame:
    return _evaluated(i).select("question_id", F.round("mrr", 9).alias("mrr"))


@query(
    "m3_permission_ok",
    """SELECT conv_id::STRING AS question_id, coalesce(bool_and(turn % 4 <= 1 + conv_id % 3), true) AS permission_ok, coalesce(bool_or(role = 'system'), false) AS errored
       FROM (SELECT conv_id, role, CASE WHEN role <> 'system' THEN turn END AS turn FROM conversations) GROUP BY conv_id""",
)
def m3(i: Inputs) -> DataFrame:
    conv = F.col("conv_id")
    hits = i.table("conversations").select(
        conv.cast("string").alias("question_id"), (1 + conv % 3).alias("user_access_level"),
        F.when(F.col("role") != "system", F.col("turn") % 4).alias("access_level"),
    )
    asked = hits.select("question_id").distinct()
    return metrics.permission_check(hits, asked).select("question_id", "permission_ok", F.col("error").isNotNull().alias("errored"))


view("turns", """
  SELECT q.conv_id, q.turn, q.text AS question, CASE WHEN q.conv_id % 4 = 0 THEN a.text || ' 確認できません' ELSE a.text END AS answer,
    list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS keywords, q.conv_id % 3 = 0 AS should_refuse
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]{5,}') AS w FROM conversations) q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'""")


def turn_pairs(i: Inputs) -> DataFrame:
    """A user's turn and the assistant's next one."""
    told = i.table("conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("([a-z]{5,})"), 1))
    replies = told.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return (
        told.filter("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("question"))
        .join(replies, ["conv_id", "turn"])
        .select(
            "conv_id", "turn", "question",
            F.when(F.col("conv_id") % 4 == 0, F.concat("said", F.lit(" 確認できません"))).otherwise(F.col("said")).alias("answer"),
            F.slice(words, 1, 3).alias("keywords"), (F.col("conv_id") % 3 == 0).alias("should_refuse"),
        )
    )


@query("m4_refusal", "SELECT conv_id, turn, contains(answer, '確認できません') AS refused FROM turns", ("turns",))
def m4(i: Inputs) -> DataFrame:
    return turn_pairs(i).select("conv_id", "turn", tx.is_refusal(F.col("answer")).alias("refused"))


@query(
    "m5_keyword_correctness",
    """SELECT conv_id, turn, round(coalesce(length(list_filter(keywords, lambda k: contains(answer, k))) / nullif(length(keywords), 0)::DOUBLE, 1.0), 9) AS correctness FROM turns""",
    ("turns",),
)
def m5(i: Inputs) -> DataFrame:
    return turn_pairs(i).select("conv_id", "turn", F.round(tx.keyword_share(F.col("answer"), F.col("keywords")), 9).alias("correctness"))


@query("m6_refusal_correct", "SELECT conv_id, turn, NOT should_refuse OR contains(answer, '確認できません') AS refusal_correct FROM turns", ("turns",))
def m6(i: Inputs) -> DataFrame:
    return turn_pairs(i).select("conv_id", "turn", metrics.refusal_correct(F.col("should_refuse"), F.col("answer")).alias("refusal_correct"))


@query(
    "m7_percentile",
    """SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, max(value) AS p100 FROM events GROUP BY ALL""",
)
def m7(i: Inputs) -> DataFrame:
    found = metrics.percentiles(i.table("events"), ["event_type"], "value", {"p50": 50, "p95": 95, "p100": 100})
    return found.select("event_type", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95"), "p100")


@query("m8_mean", "SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'purchase' THEN value END), 0), 9) AS mean FROM events GROUP BY ALL")
def m8(i: Inputs) -> DataFrame:
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    return i.table("events").groupBy("user_id").agg(F.round(metrics.mean_or_zero(paid), 9).alias("mean"))


_MARKED = "string_split(regexp_replace(content, '([。．.!?！？])', '\\1' || chr(1), 'g'), chr(1))"


@query(
    "m9_sentence_split",
    f"""SELECT document_id, array_to_string(list_filter(list_transform({_MARKED}, lambda s: {sql_strip('s')}), lambda s: s <> ''), chr(2)) AS sentences FROM corpus""",
    ("corpus",),
)
def m9(i: Inputs) -> DataFrame:
    return i.corpus.select("document_id", F.array_join(tx.sentences(F.col("content")), "\u0002").alias("sentences"))


@query("m10_judge_reply", "SELECT question_id, round(context_relevance, 9) AS context_relevance, answer_relevance, faithfulness FROM evaluated", ("evaluated",))
def m10(i: Inputs) -> DataFrame:
    return i.replies.select("question_id", *[F.round(c, 9).alias(n) for n, c in metrics.judge_scores(F.col("raw")).items()])


@query(
    "m11_judge_chunk_block",
    """SELECT q.question_id, coalesce(string_agg('[' || rank || '] ' || source_file || chr(10) || substr(content, 1, 600), chr(10) || chr(10) ORDER BY rank), '(なし)') AS chunks_block
       FROM questions q LEFT JOIN hits_plain USING (question_id) GROUP BY q.question_id""",
    ("questions", "hits_plain"),
)
def m11(i: Inputs) -> DataFrame:
    return metrics.judge_blocks(i.asked, i.hits_plain)


_N_SENTENCES = f"length(list_filter(list_transform({_MARKED.replace('content', 'answer')}, lambda s: {sql_strip('s')}), lambda s: s <> ''))"


@query(
    "m12_grounded_flags",
    f"""SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE list_sum(flags[1:n]) / n END, 9) AS faithfulness FROM (
          SELECT conv_id, turn, flags, least({_N_SENTENCES}, length(flags)) AS n
          FROM (SELECT *, [(turn % 2)::DOUBLE, 1.0, (conv_id % 2)::DOUBLE][1:(conv_id % 4)::INT] AS flags FROM turns))""",
    ("turns",),
)
def m12(i: Inputs) -> DataFrame:
    flags = F.slice(F.array((F.col("turn") % 2).cast("double"), F.lit(1.0), (F.col("conv_id") % 2).cast("double")), 1, (F.col("conv_id") % 4).cast("int"))
    return turn_pairs(i).select("conv_id", "turn", F.round(metrics.grounded_share(F.col("answer"), flags), 9).alias("faithfulness"))


_ROUNDED = ["recall_at_5", "mrr", "correctness", "context_relevance", "answer_relevance", "faithfulness", "first_token_latency", "total_latency"]


@query(
    "m13_question_evaluation",
    f"SELECT question_id, category, permission_ok, refusal_correct, coalesce(error, '-') AS error, {', '.join(f'round({c}, 9) AS {c}' for c in _ROUNDED)} FROM evaluated",
    ("evaluated",),
)
def m13(i: Inputs) -> DataFrame:
    return _evaluated(i).select(
        "question_id", "category", "permission_ok", "refusal_correct", F.coalesce("error", F.lit("-")).alias("error"),
        *[F.round(c, 9).alias(c) for c in _ROUNDED],
    )


view("summary", """
  SELECT setting, count(*) FILTER (WHERE error IS NULL) AS n, count(*) FILTER (WHERE error IS NOT NULL) AS errors,
    coalesce(avg(recall_at_5) FILTER (WHERE error IS NULL), 0) AS recall_at_5, coalesce(avg(mrr) FILTER (WHERE error IS NULL), 0) AS mrr,
    coalesce(avg(context_relevance) FILTER (WHERE error IS NULL), 0) AS context_relevance,
    coalesce(avg(faithfulness) FILTER (WHERE error IS NULL), 0) AS faithfulness,
    coalesce(avg(answer_relevance) FILTER (WHERE error IS NULL), 0) AS answer_relevance,
    coalesce(avg(correctness) FILTER (WHERE error IS NULL), 0) AS correctness,
    coalesce(avg(permission_ok::INT) FILTER (WHERE error IS NULL), 0) AS permission_rate,
    coalesce(avg(refusal_correct::INT) FILTER (WHERE error IS NULL AND category IN ('permission_test', 'hallucination_test')), 1) AS refusal_rate,
    coalesce(quantile_cont(first_token_latency::DOUBLE, 0.5) FILTER (WHERE error IS NULL), 0) AS ftl_p50,
    coalesce(quantile_cont(first_token_latency::DOUBLE, 0.95) FILTER (WHERE error IS NULL), 0) AS ftl_p95,
    coalesce(quantile_cont(total_latency::DOUBLE, 0.5) FILTER (WHERE error IS NULL), 0) AS total_p50
  FROM (SELECT *, category AS setting FROM evaluated UNION ALL SELECT *, 'all' FROM evaluated
        UNION ALL SELECT * REPLACE (coalesce(error, 'run_failed: all') AS error), 'broken' FROM evaluated) GROUP BY setting""", "evaluated")
_SUMS = ["recall_at_5", "mrr", "context_relevance", "faithfulness", "answer_relevance", "correctness", "permission_rate", "refusal_rate", "ftl_p50", "ftl_p95", "total_p50"]


def _summary(i: Inputs) -> DataFrame:
    rows = saved(_evaluated(i))  # read by the means and by the percentiles
    broken = F.coalesce("error", F.lit("run_failed: all"))
    each = rows.withColumn(
        "s", F.explode(F.array(
            F.struct(F.col("category").alias("setting"), F.col("error").alias("e")),
            F.struct(F.lit("all").alias("setting"), F.col("error").alias("e")),
            F.struct(F.lit("broken").alias("setting"), broken.alias("e")),
        ))
    ).withColumns({"setting": F.col("s.setting"), "error": F.col("s.e")})
    return metrics.summarize(each)


@query("m15_setting_summary", f"SELECT setting, n, errors, n = 0 AS all_errored, {', '.join(f'round({c}, 9) AS {c}' for c in _SUMS)} FROM summary", ("summary",))
def m15(i: Inputs) -> DataFrame:
    return _summary(i).select("setting", "n", "errors", "all_errored", *[F.round(c, 9).alias(c) for c in _SUMS])


view("lines", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', {b})" for m, (s, b) in metrics.PASS_LINES.items()) + ") t(metric, sign, bound)")
view("checked", f"""
  SELECT setting, n, u.metric, u.value, sign, bound, CASE sign WHEN '>=' THEN u.value >= bound ELSE u.value <= bound END AS passed
  FROM (SELECT setting, n, unnest([{', '.join(f"{{'metric': '{c}', 'value': {c}::DOUBLE}}" for c in _SUMS)}]) AS u FROM summary) JOIN lines l ON l.metric = u.metric""",
     "summary", "lines")


@query("m16_threshold_table", "SELECT setting, metric, round(value, 9) AS value, sign, bound::DOUBLE AS bound, passed FROM checked", ("checked",))
def m16(i: Inputs) -> DataFrame:
    return metrics.threshold_table(_summary(i)).select("setting", "metric", F.round("value", 9).alias("value"), "sign", "bound", "passed")


@query("m16_verdict", "SELECT setting, bool_and(passed) AND any_value(n) > 0 AS passed FROM checked GROUP BY setting", ("checked",))
def m16_verdict(i: Inputs) -> DataFrame:
    return metrics.verdicts(_summary(i))


@query(
    "m17_failure_breakdown",
    """SELECT question_id, concat_ws('; ', error, CASE WHEN NOT permission_ok THEN '権限フィルタ違反' END, CASE WHEN NOT refusal_correct THEN '拒否すべきだが応答してしまった' END) AS reasons
       FROM evaluated WHERE error IS NOT NULL OR NOT permission_ok OR NOT refusal_correct""",
    ("evaluated",),
)
def m17(i: Inputs) -> DataFrame:
    return metrics.failures(_evaluated(i)).select("question_id", "reasons")


@query(
    "m18_rerank_on_off",
    """SELECT setting, count(*) AS hits, count(DISTINCT question_id) AS answered, count(*) FILTER (WHERE list_contains(expected_sources, source_file)) AS right_sources
       FROM (SELECT 'rerank_on' AS setting, question_id, source_file FROM hits UNION ALL SELECT 'rerank_off', question_id, source_file FROM hits_plain)
       JOIN questions USING (question_id) GROUP BY setting""",
    ("hits", "hits_plain", "questions"),
)
def m18(i: Inputs) -> DataFrame:
    both = i.hits_of().select(F.lit("rerank_on").alias("setting"), "question_id", "source_file").unionByName(
        i.hits_of(use_rerank=False).select(F.lit("rerank_off").alias("setting"), "question_id", "source_file")
    )
    right = F.array_contains("expected_sources", F.col("source_file"))
    return both.join(i.questions.select("question_id", "expected_sources"), "question_id").groupBy("setting").agg(
        F.count("*").alias("hits"), F.countDistinct("question_id").alias("answered"), F.count_if(right).alias("right_sources")
    )


view("asked_set", """
  SELECT 'Q' || CASE WHEN item_id % 13 = 0 OR item_id >= 1000 THEN (CASE WHEN item_id = 7 THEN 6 ELSE item_id END)::STRING
      ELSE lpad((CASE WHEN item_id = 7 THEN 6 ELSE item_id END)::STRING, 3, '0') END AS question_id, category, should_refuse AND item_id % 5 <> 0 AS should_refuse,
    user_access_level + (item_id % 2)::INT AS user_access_level,
    CASE WHEN item_id % 11 = 0 THEN ['/nowhere/' || item_id] ELSE expected_sources END AS expected_sources,
    list_append(expected_answer_keywords, 'zzzzz') AS expected_answer_keywords FROM questions""", "questions")
view("cited_set", "SELECT question_id, should_refuse, unnest(expected_sources) AS source_path FROM asked_set", "asked_set")


@query(
    "m19_dataset_checks",
    """SELECT 'repeated id' AS "check", question_id AS subject FROM asked_set GROUP BY question_id HAVING count(*) > 1
       UNION ALL SELECT DISTINCT 'id out of sequence', question_id FROM asked_set WHERE substr(question_id, 2)::BIGINT NOT BETWEEN 1 AND (SELECT count(*) FROM asked_set) OR length(question_id) < 4
       UNION ALL SELECT 'category count', category FROM asked_set FULL JOIN (VALUES ('general', 20), ('hallucination_test', 8), ('expected but absent', 4)) w(category, wanted) USING (category)
         GROUP BY category, wanted HAVING count(question_id) <> coalesce(wanted, 0)
       UNION ALL SELECT 'question count', count(*)::STRING FROM asked_set HAVING count(*) <> 50
       UNION ALL SELECT 'refuse flag missing', question_id FROM asked_set WHERE category IN ('permission_test', 'hallucination_test') AND NOT should_refuse
       UNION ALL SELECT 'no expected source', question_id FROM asked_set WHERE category NOT IN ('permission_test', 'hallucination_test') AND length(expected_sources) = 0
       UNION ALL SELECT 'permission test at top level', question_id FROM asked_set WHERE category = 'permission_test' AND user_access_level >= 3
       UNION ALL SELECT 'unknown source', question_id || ' ' || source_path FROM cited_set WHERE source_path NOT IN (SELECT source_path FROM corpus)
       UNION ALL SELECT 'document never expected', source_path FROM corpus WHERE source_path NOT IN (SELECT source_path FROM cited_set)
       UNION ALL SELECT 'short document', source_path FROM corpus WHERE length(content) < 1000
       UNION ALL SELECT 'keyword not in sources', question_id || ' ' || keyword FROM (
         SELECT question_id, unnest(expected_answer_keywords) AS keyword FROM asked_set WHERE NOT should_refuse) w
         LEFT JOIN (SELECT question_id, content FROM cited_set JOIN corpus USING (source_path)) t USING (question_id)
         GROUP BY question_id, keyword HAVING NOT bool_or(contains(coalesce(content, ''), keyword))""",
    ("asked_set", "cited_set", "corpus"),
)
def m19(i: Inputs) -> DataFrame:
    item = F.col("item_id")
    number = F.when(item == 7, 6).otherwise(item)
    asked = i.questions.select(
        F.concat(F.lit("Q"), F.when((item % 13 == 0) | (item >= 1000), number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))).alias("question_id"), "category",
        (F.col("should_refuse") & (item % 5 != 0)).alias("should_refuse"),
        (F.col("user_access_level") + (item % 2).cast("int")).alias("user_access_level"),
        F.when(item % 11 == 0, F.array(F.concat(F.lit("/nowhere/"), item.cast("string")))).otherwise(F.col("expected_sources")).alias("expected_sources"),
        F.array_append("expected_answer_keywords", F.lit("zzzzz")).alias("expected_answer_keywords"),
    )
    return metrics.dataset_problems(asked, i.corpus, {"general": 20, "hallucination_test": 8, "expected but absent": 4}, expected_total=50)
