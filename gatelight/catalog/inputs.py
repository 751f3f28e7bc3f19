"""Inputs of the registered queries, derived from the given tables.

Each input has a Spark form here (class ``Inputs``) and an SQL form (``view``).
States that differ between two points in time (a section of the corpus that was
added or removed since) follow the documents' language, so both sides are large.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gatelight.catalog.base import view
from gatelight.functions.passages import Passages
from gatelight.operators import access, registry, vectors
from gatelight.operators.chunking import chunk_text
from gatelight.operators.postings import build_postings
from gatelight.operators.ranking import nearest_chunks
from gatelight.plans import retrieval
from gatelight.session import saved, shared_dir, spread
from gatelight.sources import chunk_table
from gatelight.sources.shared import stored_blocks

_LOOKED_UP = "document_id string, chunk_index int, is_active boolean, index_version int, content string"
EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC

# (folder_id, path, level, active): src0..src17 active, src18 inactive and written
# with a trailing slash, src19 not registered, one nested folder.
FOLDER_ROWS = [(i + 1, f"/watched/src{i}", 1 + i % 3, True) for i in range(18)] + [
    (19, "/watched/src18/", 2, False),
    (20, "/watched/src1/deep", 3, True),
]
_FOLDER_SQL = ", ".join(f"({i}, '{p}', {lvl}, {str(a).lower()})" for i, p, lvl, a in FOLDER_ROWS)

# Whitespace as the text functions see it, for an engine whose \s is ASCII only.
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_basename(path: str) -> str:
    return rf"coalesce(regexp_extract({path}, '([^/\\]*)$', 1), '')"


view("corpus", """
  SELECT doc_id::STRING AS document_id, doc_id, lang, source, text AS content, sha256(text) AS file_hash,
    '/watched/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'deep/' ELSE '' END || 'doc' || doc_id || '.txt' AS source_path,
    1704067200 + doc_id AS mtime_s
  FROM documents""")
view("folders", f"SELECT * FROM (VALUES {_FOLDER_SQL}) t(folder_id, path, access_level, is_active)")
view("matched", """
  SELECT document_id, folder_id, level, active FROM (
    SELECT c.document_id, f.folder_id, f.access_level AS level, f.is_active AS active,
      row_number() OVER (PARTITION BY c.document_id ORDER BY length(rtrim(f.path, '/')) DESC, f.folder_id) AS rn
    FROM corpus c JOIN folders f
      ON c.source_path = rtrim(f.path, '/') OR starts_with(c.source_path, rtrim(f.path, '/') || '/')) WHERE rn = 1""",
     "corpus", "folders")
view("classified", """
  SELECT c.*, m.folder_id, m.folder_id IS NULL AS unclassified,
    CASE WHEN m.folder_id IS NULL THEN 1 WHEN m.active THEN m.level END AS access_level
  FROM corpus c LEFT JOIN matched m USING (document_id)""", "corpus", "matched")
view("registry", """
  SELECT document_id, doc_id, source_path, 1 AS access_level, false AS unclassified, 1 AS index_version,
    CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE file_hash END AS file_hash,
    CASE doc_id % 23 WHEN 0 THEN 'failed' WHEN 1 THEN 'deleted' WHEN 2 THEN 'purged' WHEN 3 THEN 'processing' ELSE 'done' END AS status,
    mtime_s AS updated_s
  FROM corpus""", "corpus")
view("registry_before", "SELECT r.* FROM registry r JOIN corpus c USING (document_id) WHERE c.lang <> 'es'", "registry", "corpus")
view("scan", "SELECT source_path, file_hash FROM corpus WHERE lang <> 'de'", "corpus")
view("diff", """
  SELECT source_path, coalesce(r.document_id, substr(sha256(source_path), 1, 32)) AS document_id,
    CASE WHEN s.file_hash IS NULL THEN CASE WHEN r.status IN ('deleted', 'purged') THEN 'none' ELSE 'delete' END
         WHEN c.access_level IS NULL THEN 'skip'
         WHEN r.document_id IS NULL THEN 'insert'
         WHEN r.file_hash <> s.file_hash OR r.status IN ('deleted', 'purged', 'failed') THEN 'requeue'
         ELSE 'none' END AS action,
    c.access_level, c.unclassified, coalesce(s.file_hash, r.file_hash) AS file_hash
  FROM scan s FULL OUTER JOIN registry_before r USING (source_path)
  JOIN (SELECT source_path, access_level, unclassified FROM classified) c USING (source_path)""",
     "scan", "registry_before", "classified")
view("tasks", """
  SELECT doc_id AS task_id, document_id, doc_id % 4 AS attempts, 1704067200 + doc_id * 7 AS created_s,
    CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status
  FROM registry""", "registry")
view("registry_now", """
  SELECT document_id, doc_id, source_path, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE coalesce(access_level, 1) END AS access_level,
    unclassified, CASE doc_id % 23 WHEN 1 THEN 'deleted' WHEN 2 THEN 'purged' ELSE 'done' END AS status,
    1 AS index_version, mtime_s AS updated_s
  FROM classified""", "classified")

_RANKS = ["chr(12290) || chr(10)", "chr(12290)", "chr(10) || chr(10)", "chr(10)", "chr(65294)", "'. '"]


def _cut(start: str) -> str:
    """Where the chunk starting at ``start`` ends (size 500, reach 30)."""
    snip = f"substr(t, {start} + 471, 60)"
    found = ", ".join(
        f"{start} + 470 + length({snip}) + 1 - nullif(strpos(reverse({snip}), reverse({mark})), 0)" for mark in _RANKS
    )
    return f"CASE WHEN {start} + 500 < n THEN coalesce({found}, {start} + 500) ELSE {start} + 500 END"


view("texts", rf"""
  SELECT document_id, t, length(t) AS n FROM (
    SELECT document_id, {sql_strip(r"regexp_replace(content, '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM corpus)""",
     "corpus")
view("walk", f"""
  SELECT document_id, t, n, 0 AS b, {_cut('0')} AS e FROM texts
  UNION ALL
  SELECT document_id, t, n, b, {_cut('b')} AS e
  FROM (SELECT document_id, t, n, greatest(e - 50, b + 1) AS b FROM walk WHERE n > 500) WHERE b < n""", "texts")
view("chunks", f"""
  SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY b) - 1)::INT AS chunk_index, content
  FROM (SELECT document_id, b, n, {sql_strip('substr(t, b + 1, e - b)')} AS content FROM walk)
  WHERE content <> '' OR n = 0""", "walk")
view("store", """
  SELECT k.document_id, c.doc_id, c.lang, k.chunk_index, k.content, c.source_path AS source_file,
    coalesce(c.access_level, 1) AS access_level, c.access_level IS NOT NULL AS is_active, 1 AS index_version, c.unclassified
  FROM chunks k JOIN classified c USING (document_id)""", "chunks", "classified")
view("searchable", "SELECT * FROM store WHERE is_active AND NOT coalesce(unclassified, false)", "store")

_TOKENS = r"""list_concat(
    list_transform(range(1, length(regexp_extract_all({0}, '[\x{{3000}}-\x{{faff}}]'))), lambda i:
      regexp_extract_all({0}, '[\x{{3000}}-\x{{faff}}]')[i] || regexp_extract_all({0}, '[\x{{3000}}-\x{{faff}}]')[i + 1]),
    list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+'), lambda w: lower(w)))"""


def sql_tokens(text: str) -> str:
    return _TOKENS.format(text)


def _postings(keys: str, text: str, source: str) -> str:
    return f"""
  SELECT {keys}, token_id, count(*) / any_value(total)::DOUBLE AS weight FROM (
    SELECT {keys}, total, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 131072)::INT AS token_id
    FROM (SELECT {keys}, length(tokens) AS total, unnest(tokens) AS token
          FROM (SELECT {keys}, {sql_tokens(text)} AS tokens FROM {source})))
  GROUP BY {keys}, token_id"""


view("chunk_postings", _postings("document_id, chunk_index", "content", "chunks"), "chunks")
view("found_in", """
  SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
view("questions", """
  SELECT 'B' || item_id AS question_id, item_id, text AS question, (1 + item_id % 3)::INT AS user_access_level,
    item_id % 10 AS user_id, 'user' || (item_id % 10) AS username,
    CASE WHEN f.doc_id IS NULL OR coalesce(c.access_level, 9) > 1 + item_id % 3 THEN [] ELSE [c.source_path] END AS expected_sources,
    CASE WHEN f.doc_id IS NULL THEN 'hallucination_test' WHEN coalesce(c.access_level, 9) > 1 + item_id % 3 THEN 'permission_test'
         ELSE ['general', 'manager', 'executive'][1 + item_id % 3] END AS category,
    f.doc_id IS NULL OR coalesce(c.access_level, 9) > 1 + item_id % 3 AS should_refuse,
    list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS expected_answer_keywords
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]{5,}') AS w FROM benchmark)
  LEFT JOIN found_in f USING (item_id) LEFT JOIN classified c ON c.doc_id = f.doc_id""", "found_in", "classified")
view("question_postings", _postings("question_id", "question", "questions"), "questions")

_PLACES = "row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, chunk_index)"
view("sparse_leg", f"""
  SELECT *, {_PLACES} AS rank FROM (
    SELECT q.question_id, s.document_id, s.chunk_index, round(sum(p.weight * c.weight), 9) AS score
    FROM question_postings p JOIN questions q USING (question_id)
    JOIN chunk_postings c USING (token_id)
    JOIN searchable s ON s.document_id = c.document_id AND s.chunk_index = c.chunk_index AND s.access_level <= q.user_access_level
    GROUP BY ALL) QUALIFY rank <= 90""", "question_postings", "questions", "chunk_postings", "searchable")


def _folded(keys: str, source: str) -> str:
    return f"""
  SELECT {keys}, dim, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY {keys})), 0) AS v FROM (
    SELECT {keys}, token_id % 64 AS dim, sum(CASE WHEN (token_id // 64) % 2 = 0 THEN weight ELSE -weight END) AS v
    FROM {source} GROUP BY ALL)"""


view("chunk_dense", _folded("document_id, chunk_index", "chunk_postings"), "chunk_postings")
view("question_dense", _folded("question_id", "question_postings"), "question_postings")
view("dense_leg", f"""
  SELECT *, {_PLACES} AS rank FROM (
    SELECT q.question_id, s.document_id, s.chunk_index, round(coalesce(any_value(d.dot), 0.0), 9) + 0.0 AS score
    FROM questions q JOIN searchable s ON s.access_level <= q.user_access_level
    LEFT JOIN (SELECT question_id, document_id, chunk_index, sum(a.v * b.v) AS dot
               FROM question_dense a JOIN chunk_dense b USING (dim) GROUP BY ALL) d
      ON d.question_id = q.question_id AND d.document_id = s.document_id AND d.chunk_index = s.chunk_index
    GROUP BY ALL) QUALIFY rank <= 90""", "questions", "searchable", "question_dense", "chunk_dense")


def _fused(name: str, depth: int, limit: int) -> None:
    view(name, f"""
  SELECT *, {_PLACES} AS rank FROM (
    SELECT question_id, document_id, chunk_index, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
    FROM (SELECT * FROM sparse_leg WHERE rank <= {depth} UNION ALL SELECT * FROM dense_leg WHERE rank <= {depth})
    GROUP BY ALL) QUALIFY rank <= {limit}""", "sparse_leg", "dense_leg")


_fused("fused", 90, 30)
_fused("fused_plain", 15, 5)


def _granted(name: str, source: str) -> None:
    view(name, f"""
  SELECT f.question_id, f.document_id, f.chunk_index, f.score, f.rank AS fused_rank, q.question, q.user_access_level,
    s.content, s.source_file, s.access_level
  FROM {source} f JOIN questions q USING (question_id) JOIN searchable s USING (document_id, chunk_index)
  JOIN registry_now r ON r.document_id = f.document_id AND r.status NOT IN ('deleted', 'purged')
    AND r.access_level <= q.user_access_level AND NOT r.unclassified""", source, "questions", "searchable", "registry_now")


_granted("granted", "fused")
_granted("granted_plain", "fused_plain")
view("reranked", f"""
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, fused_rank) AS place FROM (
    SELECT *, coalesce(round(length(list_intersect(list_distinct({sql_tokens('question')}), list_distinct({sql_tokens('content')})))
      / nullif(length(list_distinct({sql_tokens('question')})), 0)::DOUBLE, 9), 0.0) AS rerank_score FROM granted)""", "granted")
view("hits", "SELECT * EXCLUDE (place), place AS rank FROM reranked WHERE place <= 5", "reranked")
view("hits_plain", """
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fused_rank) AS rank FROM granted_plain QUALIFY rank <= 5""",
     "granted_plain")
view("answers", """
  SELECT question_id, item_id, CASE WHEN h.content IS NULL THEN 'その質問に関連する資料が見つかりませんでした。'
      ELSE 'From the files. ' || h.content || ' [1][2] and [9].' END AS answer,
    (item_id * 37 % 100) / 20.0::DOUBLE AS first_token_latency, (item_id * 37 % 100) / 20.0::DOUBLE + item_id % 13 AS total_latency,
    CASE WHEN item_id % 17 = 0 THEN 'timeout' END AS error
  FROM questions q LEFT JOIN (SELECT question_id, content FROM hits WHERE rank = 1) h USING (question_id)""", "questions", "hits")
view("replies", """
  SELECT question_id, CASE item_id % 4
      WHEN 0 THEN 'Here: {"faithfulness": 0.5, "answer_relevance": "1.5", "context_relevance": -1, "rationale": "x"} done'
      WHEN 1 THEN '{"faithfulness": 1, "answer_relevance": "high", "context_relevance": 0.' || (item_id % 10) || '}'
      WHEN 2 THEN 'no verdict' ELSE '{"faithfulness": ' END AS raw,
    CASE WHEN item_id % 19 = 0 THEN 'gone' END AS error
  FROM questions""", "questions")
view("evaluated", """
  SELECT q.question_id, q.category,
    CASE WHEN length(q.expected_sources) = 0 OR list_has_any(coalesce(s, []), q.expected_sources) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_5,
    CASE WHEN length(q.expected_sources) = 0 THEN 1.0
         ELSE coalesce(1.0 / nullif(list_position(s, q.expected_sources[1]), 0), 0.0) END::DOUBLE AS mrr,
    coalesce(length(list_filter(expected_answer_keywords, lambda k: contains(a.answer, k))) / nullif(length(expected_answer_keywords), 0)::DOUBLE, 1.0) AS correctness,
    coalesce(h.ok, true) AS permission_ok,
    NOT should_refuse OR contains(a.answer, '見つかりませんでした') AS refusal_correct,
    j.context_relevance, j.answer_relevance, j.faithfulness, a.first_token_latency, a.total_latency,
    coalesce('run_failed: ' || a.error, 'judge_failed: ' || j.error) AS error
  FROM questions q JOIN answers a USING (question_id)
  LEFT JOIN (SELECT question_id, list(source_file ORDER BY rank) AS s, bool_and(access_level <= user_access_level) AS ok
             FROM hits GROUP BY question_id) h USING (question_id)
  JOIN (SELECT question_id, error,
          CASE WHEN try_cast(json_extract_string(j, '$.context_relevance') AS DOUBLE) IS NULL THEN 0 ELSE greatest(0, least(1, try_cast(json_extract_string(j, '$.context_relevance') AS DOUBLE))) END AS context_relevance,
          CASE WHEN try_cast(json_extract_string(j, '$.answer_relevance') AS DOUBLE) IS NULL THEN 0 ELSE greatest(0, least(1, try_cast(json_extract_string(j, '$.answer_relevance') AS DOUBLE))) END AS answer_relevance,
          CASE WHEN try_cast(json_extract_string(j, '$.faithfulness') AS DOUBLE) IS NULL THEN 0 ELSE greatest(0, least(1, try_cast(json_extract_string(j, '$.faithfulness') AS DOUBLE))) END AS faithfulness
        FROM (SELECT *, try_cast(nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '') AS JSON) AS j FROM replies)) j USING (question_id)""".replace("\\\\", "\\"),
     "questions", "answers", "hits", "replies")


class Inputs:
    """The Spark form of the inputs for one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def corpus(self) -> DataFrame:
        deep = F.when(F.col("doc_id") % 3 == 0, "deep/").otherwise("")
        path = F.concat(F.lit("/watched/"), "source", F.lit("/"), deep, F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return registry.with_hash(
            self.table("documents").select(
                F.col("doc_id").cast("string").alias("document_id"), "doc_id", "lang", "source",
                path.alias("source_path"), F.col("text").alias("content"), (EPOCH + F.col("doc_id")).alias("mtime_s"),
            )
        )

    @cached_property
    def folders(self) -> DataFrame:
        return self.spark.createDataFrame(FOLDER_ROWS, "folder_id int, path string, access_level int, is_active boolean")

    @cached_property
    def classified(self) -> DataFrame:
        return access.classify(self.corpus, self.folders)

    @cached_property
    def registry(self) -> DataFrame:
        return self._registered(self.corpus)

    @cached_property
    def registry_before(self) -> DataFrame:
        """The registry before a part of the corpus was added, for change detection."""
        return self._registered(self.corpus.filter("lang <> 'es'"))

    def _registered(self, corpus: DataFrame) -> DataFrame:
        doc = F.col("doc_id")
        state = doc % 23
        return corpus.select(
            "document_id", "doc_id", "source_path",
            F.lit(1).alias("access_level"), F.lit(False).alias("unclassified"), F.lit(1).alias("index_version"),
            F.when(doc % 11 == 0, "old").otherwise(F.col("file_hash")).alias("file_hash"),
            F.when(state == 0, "failed").when(state == 1, "deleted").when(state == 2, "purged")
            .when(state == 3, "processing").otherwise("done").alias("status"),
            F.col("mtime_s").alias("updated_s"),
        )

    @cached_property
    def scan(self) -> DataFrame:
        return self.corpus.filter("lang <> 'de'").select("source_path", "file_hash")

    @cached_property
    def diff(self) -> DataFrame:
        return registry.diff_snapshot(self.registry_before, self.scan, self.folders)

    @cached_property
    def tasks(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.registry.select(
            doc.alias("task_id"), "document_id", (doc % 4).alias("attempts"), (EPOCH + doc * 7).alias("created_s"),
            F.element_at(F.lit(["pending", "processing", "done", "failed", "cancelled"]), (doc % 5 + 1).cast("int")).alias("status"),
        )

    @cached_property
    def registry_now(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.classified.select(
            "document_id", "doc_id", "source_path",
            F.when(doc % 7 == 0, 3).otherwise(F.coalesce("access_level", F.lit(1))).alias("access_level"),
            "unclassified",
            F.when(doc % 23 == 1, "deleted").when(doc % 23 == 2, "purged").otherwise("done").alias("status"),
            F.lit(1).alias("index_version"), F.col("mtime_s").alias("updated_s"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return chunk_text(spread(self.corpus.select("document_id", "content")))

    @cached_property
    def store(self) -> DataFrame:
        """Chunks with payload, without vectors. Classifying precedes chunking: its joins see one row per document."""
        docs = self.classified.select(
            "document_id", "doc_id", "lang", F.col("source_path").alias("source_file"),
            F.coalesce("access_level", F.lit(1)).alias("access_level"),
            F.col("access_level").isNotNull().alias("is_active"), F.lit(1).alias("index_version"),
            "unclassified", "content",
        )
        return chunk_text(spread(docs))

    def stored_content(self, keys: DataFrame) -> DataFrame:
        """Content of (document_id, chunk_index) keys from the store as a table in buckets, of which only theirs are read."""
        base = self._chunk_table
        return chunk_table.lookup(self.spark, base, _LOOKED_UP, keys)

    @cached_property
    def _chunk_table(self) -> str:
        base = f"{shared_dir(self.spark)}/gatelight-files/chunk-table-{uuid.uuid4().hex}"
        chunk_table.publish(self.store.select("document_id", "chunk_index", "is_active", "index_version", "content"), base)
        return base

    @cached_property
    def _search_documents(self) -> DataFrame:
        """The documents of the searchable part of the store. Whether a chunk is searchable is
        known per document, so other documents are left out before they are chunked."""
        docs = self.classified.select(
            "document_id", F.col("source_path").alias("source_file"), F.col("access_level"),
            F.lit(True).alias("is_active"), "unclassified", "content",
        )
        return spread(access.searchable(docs.filter("access_level is not null")))

    @cached_property
    def search_store(self) -> DataFrame:
        return chunk_text(self._search_documents)

    @cached_property
    def sparse_store(self) -> DataFrame:
        """Keys, level and sparse vectors of the searchable chunks, stored as an ingest stores them."""
        keys = ["document_id", "chunk_index", "access_level", "is_active", "unclassified"]
        return saved(chunk_text(self._search_documents, sparse=True).select(*keys, "sparse"))

    @cached_property
    def vector_store(self) -> DataFrame:
        """The same for both legs: the dense vectors are folded from the sparse ones where they are read. Content stays in ``search_store``."""
        return self.sparse_store

    @cached_property
    def postings(self) -> DataFrame:
        """The stored index of the sparse vectors."""
        return saved(build_postings(access.searchable(self.sparse_store)))

    @cached_property
    def questions(self) -> DataFrame:
        """Benchmark passages as questions; the expected source is the first document that holds the passage."""
        asked = self.table("benchmark")
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), 1))
        item = F.col("item_id")
        held = first_containing(self.table("documents"), asked)
        docs = self.classified.select(F.col("doc_id").alias("found_doc"), "source_path", "access_level")
        level = (1 + item % 3).cast("int")
        closed = F.coalesce("access_level", F.lit(9)) > level
        none = F.array().cast("array<string>")
        return asked.join(held, "item_id", "left").join(docs, "found_doc", "left").select(
            F.concat(F.lit("B"), item.cast("string")).alias("question_id"), "item_id",
            F.col("text").alias("question"), level.alias("user_access_level"),
            (item % 10).alias("user_id"), F.concat(F.lit("user"), (item % 10).cast("string")).alias("username"),
            F.when(F.col("found_doc").isNull() | closed, none).otherwise(F.array("source_path")).alias("expected_sources"),
            F.when(F.col("found_doc").isNull(), "hallucination_test").when(closed, "permission_test")
            .otherwise(F.element_at(F.lit(["general", "manager", "executive"]), level)).alias("category"),
            (F.col("found_doc").isNull() | closed).alias("should_refuse"),
            F.slice(words, 1, 3).alias("expected_answer_keywords"),
        )

    @cached_property
    def asked(self) -> DataFrame:
        """Questions with both vectors, for retrieval: no documents are read for these."""
        item = F.col("item_id")
        plain = self.table("benchmark").select(
            F.concat(F.lit("B"), item.cast("string")).alias("question_id"), F.col("text").alias("question"),
            (1 + item % 3).cast("int").alias("user_access_level"),
        )
        return vectors.project_sparse(vectors.build_sparse(plain, "question"))

    @cached_property
    def found(self) -> DataFrame:
        """Both legs at the depth that reranking asks for; a search without it takes their heads."""
        return saved(nearest_chunks(self.asked, access.searchable(self.vector_store), retrieval.leg_limit(True), postings=self.postings))

    def hits_of(self, **options) -> DataFrame:
        """Hits of a setting whose legs are ranked once for all settings."""
        return retrieval.retrieve(self.asked, self.vector_store, self.registry_now, payload=self.search_store, found=self.found, **options)

    @cached_property
    def hits(self) -> DataFrame:
        return retrieval.retrieve(self.asked, self.vector_store, self.registry_now, payload=self.search_store, postings=self.postings)

    @cached_property
    def hits_plain(self) -> DataFrame:
        return retrieval.retrieve(
            self.asked, self.vector_store, self.registry_now, use_rerank=False, payload=self.search_store, postings=self.postings
        )

    def answers(self, hits: DataFrame) -> DataFrame:
        item = F.col("item_id")
        first = hits.filter("rank = 1").select("question_id", "content")
        text = F.concat(F.lit("From the files. "), F.col("content"), F.lit(" [1][2] and [9]."))
        wait = (item * 37 % 100) / 20.0
        base = self.table("benchmark").select(F.concat(F.lit("B"), item.cast("string")).alias("question_id"), "item_id")
        return base.join(first, "question_id", "left").select(
            "question_id",
            F.coalesce(text, F.lit(retrieval.NO_HIT_ANSWER)).alias("answer"),
            wait.alias("first_token_latency"), (wait + item % 13).alias("total_latency"),
            F.when(item % 17 == 0, "timeout").alias("error"),
        )

    @cached_property
    def replies(self) -> DataFrame:
        item = F.col("item_id")
        raw = (
            F.when(item % 4 == 0, 'Here: {"faithfulness": 0.5, "answer_relevance": "1.5", "context_relevance": -1, "rationale": "x"} done')
            .when(item % 4 == 1, F.concat(F.lit('{"faithfulness": 1, "answer_relevance": "high", "context_relevance": 0.'), (item % 10).cast("string"), F.lit("}")))
            .when(item % 4 == 2, "no verdict")
            .otherwise('{"faithfulness": ')
        )
        return self.table("benchmark").select(
            F.concat(F.lit("B"), item.cast("string")).alias("question_id"), raw.alias("raw"),
            F.when(item % 19 == 0, "gone").alias("error"),
        )


# Passages a task holds at once.
_PASSAGES_PER_BLOCK = 16_384


def first_containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, found_doc: the lowest document holding each passage, character for character, wherever it begins or ends.

    Passages are stored once and streamed past the documents, so places of a text are no rows.
    The minimum is built before the shuffle, however many copies there are.
    """
    asked = saved(passages.select("item_id", "text"))
    passages_at = asked.saved_at
    schema = T.StructType([asked.schema["item_id"], documents.schema["doc_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in stored_blocks(passages_at, ["item_id", "text"], _PASSAGES_PER_BLOCK):
                numbers, lowest = batch.column("doc_id").to_pylist(), {}
                for text, passage in Passages(block.column("text").to_pylist()).held_by(batch.column("text")):
                    number = numbers[text]
                    if lowest.setdefault(passage, number) is None or number is not None and number < lowest[passage]:
                        lowest[passage] = number
                if lowest:
                    items = block.column("item_id").to_pylist()
                    found = [[items[passage] for passage in lowest], list(lowest.values())]
                    yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(found, types)], ["item_id", "doc_id"])

    types = [to_arrow_type(f.dataType) for f in schema.fields]
    runs = spread(documents.select("doc_id", "text")).mapInArrow(run, schema)
    return runs.groupBy("item_id").agg(F.min("doc_id").alias("found_doc"))
