"""Sources, registry, chunking, vectors, chunk store and access rules as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.catalog.base import query, view
from gatelight.catalog.inputs import EPOCH, Inputs, sql_tokens
from gatelight.functions import text as tx
from gatelight.operators import access, cells, chunking, registry, store, vectors
from gatelight.session import shared_dir
from gatelight.sources import chunk_table, files, tables

# ---- sources --------------------------------------------------------------------

_ENDING = "CASE lang WHEN 'en' THEN '.TXT' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.pdf' ELSE '.png' END"


@query(
    "s1_corpus_scan",
    f"""SELECT source_path || {_ENDING} AS source_path, lower({_ENDING}) AS file_type, length(content)::BIGINT AS chars
        FROM corpus WHERE lang <> 'es'""",
    ("corpus",),
)
def s1(i: Inputs) -> DataFrame:
    ending = F.expr(_ENDING)
    named = i.corpus.withColumn("source_path", F.concat("source_path", ending))
    return registry.supported_files(named).select("source_path", "file_type", F.length("content").cast("bigint").alias("chars"))


def _folder(i: Inputs, name: str) -> str:
    return f"{shared_dir(i.spark)}/gatelight-files/{name}-{uuid.uuid4().hex}"


@query(
    "s11_strict_json_lines",
    """SELECT doc_id, source AS field, false AS broken FROM documents WHERE lang <> 'de'
       UNION ALL SELECT doc_id, 'no object ' || doc_id, true FROM documents WHERE lang = 'de'""",
)
def s11(i: Inputs) -> DataFrame:
    folder = _folder(i, "lines")
    line = F.when(F.col("lang") == "de", F.concat(F.lit("no object "), "doc_id")).otherwise(F.to_json(F.struct("doc_id", "source", "text")))
    i.table("documents").select(line.alias("value")).write.text(folder)
    rows, errors = files.read_jsonl(i.spark, folder, "doc_id long, source string, text string")
    broken = errors.select(F.regexp_extract("line", r"(\d+)$", 1).cast("long").alias("doc_id"), F.col("line").alias("field"), F.lit(True).alias("broken"))
    return rows.select("doc_id", F.col("source").alias("field"), F.lit(False).alias("broken")).unionByName(broken)


@query(
    "s12_question_file",
    """SELECT item_id::STRING AS id, text AS question, item_id % 4 = 0 AS broken FROM benchmark WHERE item_id % 4 <> 0
       UNION ALL SELECT '', '{"id": ' || item_id, true FROM benchmark WHERE item_id % 4 = 0""",
)
def s12(i: Inputs) -> DataFrame:
    folder, item = _folder(i, "questions"), F.col("item_id")
    good = F.to_json(F.struct(item.cast("string").alias("id"), F.col("text").alias("question")))
    i.table("benchmark").select(F.when(item % 4 == 0, F.concat(F.lit('{"id": '), item)).otherwise(good).alias("value")).write.text(folder)
    rows, errors = files.read_questions(i.spark, folder)
    return rows.select("id", "question", F.lit(False).alias("broken")).unionByName(errors.select(F.lit("").alias("id"), F.col("line").alias("question"), F.lit(True).alias("broken")))


@query("s13_rule_corpus", "SELECT 'rule-' || item_id AS rule_id, text AS body FROM benchmark")
def s13(i: Inputs) -> DataFrame:
    folder = _folder(i, "rules")
    files.write_rules(i.table("benchmark").select(F.concat(F.lit("rule-"), F.col("item_id").cast("string")).alias("rule_id"), F.col("text").alias("body")), folder)
    return files.read_rules(i.spark, folder)


@query("s15_result_sink", "SELECT doc_id, lang AS run, text FROM documents")
def s15(i: Inputs) -> DataFrame:
    folder = _folder(i, "results")
    tables.write_results(i.table("documents").select("doc_id", F.col("lang").alias("run"), "text"), folder, "run")
    return i.spark.read.schema("doc_id long, text string, run string").json(folder).select("doc_id", "run", "text")


@query(
    "s16_table_sinks",
    """SELECT 'current' AS source, document_id, 0 AS batch, content AS text FROM corpus
       UNION ALL SELECT 'log', document_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END, file_hash FROM corpus""",
    ("corpus",),
)
def s16(i: Inputs) -> DataFrame:
    table, log = _folder(i, "table"), _folder(i, "log")
    tables.publish(i.corpus.select("document_id", F.lit("old").alias("text")), table)
    tables.publish(i.corpus.select("document_id", F.col("content").alias("text")), table)
    rows = i.corpus.select("document_id", F.col("file_hash").alias("text"), "lang")
    for batch, part in ((1, "lang <> 'en'"), (1, "lang = 'en'"), (2, "lang <> 'en'")):  # batch 1 is written again
        tables.append_batch(rows.filter(part).drop("lang"), log, batch)
    current = tables.read_current(i.spark, table).select(F.lit("current").alias("source"), "document_id", F.lit(0).alias("batch"), "text")
    return current.unionByName(tables.read_log(i.spark, log, "document_id string, text string").select(F.lit("log").alias("source"), "document_id", F.col("batch").cast("int").alias("batch"), "text"))


@query("s2_content_fingerprint", "SELECT document_id, file_hash FROM corpus", ("corpus",))
def s2(i: Inputs) -> DataFrame:
    return i.corpus.select("document_id", "file_hash")


@query("s3_change_detection", "SELECT source_path, document_id, action FROM diff", ("diff",))
def s3(i: Inputs) -> DataFrame:
    return i.diff.select("source_path", "document_id", "action")


@query(
    "s3_registry_after_diff",
    """SELECT coalesce(r.document_id, d.document_id) AS document_id, d.source_path,
         CASE WHEN d.action IN ('insert', 'requeue') THEN 'pending' WHEN d.action = 'delete' THEN 'deleted' ELSE r.status END AS status,
         CASE WHEN d.action IN ('insert', 'requeue') THEN d.file_hash ELSE r.file_hash END AS file_hash,
         CASE WHEN d.action IN ('insert', 'requeue') THEN d.access_level ELSE r.access_level END AS access_level
       FROM diff d LEFT JOIN registry_before r USING (source_path) WHERE r.document_id IS NOT NULL OR d.action = 'insert'""",
    ("diff", "registry_before"),
)
def s3_after(i: Inputs) -> DataFrame:
    return registry.apply_diff(i.registry_before, i.diff).select("document_id", "source_path", "status", "file_hash", "access_level")


@query(
    "s4_move",
    """SELECT m.source_path, m.kind, CASE WHEN m.kind = 'upsert' THEN substr(sha256(m.source_path), 1, 32) ELSE c.document_id END AS document_id
       FROM (SELECT source_path, 'delete' AS kind, document_id FROM corpus
             UNION ALL SELECT replace(source_path, '/doc', '/moved/doc'), 'upsert', document_id FROM corpus) m
       JOIN corpus c USING (document_id)""",
    ("corpus",),
)
def s4(i: Inputs) -> DataFrame:
    moves = i.corpus.select(
        F.col("source_path").alias("old_path"), F.replace("source_path", F.lit("/doc"), F.lit("/moved/doc")).alias("new_path")
    )
    events = registry.moves_to_events(moves)
    known = i.corpus.select("source_path", "document_id")
    return events.join(known, "source_path", "left").select(
        "source_path", "kind", F.coalesce("document_id", registry.document_id(F.col("source_path"))).alias("document_id")
    )


@query(
    "s5_requeue_dedupe",
    """SELECT document_id FROM diff WHERE action IN ('insert', 'requeue')
       AND document_id NOT IN (SELECT document_id FROM tasks WHERE status = 'pending')""",
    ("diff", "tasks"),
)
def s5(i: Inputs) -> DataFrame:
    return registry.new_tasks(i.diff, i.tasks)


@query(
    "s6_delete_cascade",
    """SELECT task_id, CASE WHEN status = 'pending' AND document_id IN (SELECT document_id FROM diff WHERE action = 'delete')
         THEN 'cancelled' ELSE status END AS status FROM tasks""",
    ("diff", "tasks"),
)
def s6(i: Inputs) -> DataFrame:
    return registry.cancel_tasks(i.tasks, i.diff).select("task_id", "status")


@query(
    "s7_settle_filter",
    "SELECT document_id FROM corpus WHERE mtime_s <= (SELECT max(mtime_s) FROM corpus) + 5 - 10",
    ("corpus",),
)
def s7(i: Inputs) -> DataFrame:
    stamped = i.corpus.withColumn("mtime", F.timestamp_seconds("mtime_s"))
    now = F.timestamp_seconds(i.corpus.agg(F.max("mtime_s") + 5).scalar())
    return registry.settled(stamped, now).select("document_id")


@query("s8_text_decode", "SELECT document_id, content FROM corpus", ("corpus",))
def s8(i: Inputs) -> DataFrame:
    # French files come with Windows line ends; reading makes them one kind.
    raw = F.when(F.col("lang") == "fr", F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content"))
    return files.decode_text(i.corpus.select("document_id", F.encode(raw, "utf-8").alias("content")))


view("cells", """
  SELECT l_orderkey AS document_id, 'S1' AS sheet, r AS "row", col,
    CASE col WHEN 1 THEN CASE WHEN r = 1 THEN l_returnflag END WHEN 2 THEN l_quantity::BIGINT::STRING ELSE l_linestatus END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INT AS r FROM lineitem),
    (VALUES (1), (2), (3)) c(col)""")
view("filled", """
  SELECT * EXCLUDE (value), CASE WHEN col = 1 AND value IS NULL THEN
    max(value) FILTER (WHERE col = 1 AND "row" = 1) OVER (PARTITION BY document_id) ELSE value END AS value FROM cells""", "cells")


def _cells(i: Inputs) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = i.table("lineitem").withColumn("row", F.row_number().over(order))
    flag = F.when(F.col("row") == 1, F.col("l_returnflag"))
    values = F.array(flag, F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linestatus"))
    table = rows.select(
        F.col("l_orderkey").alias("document_id"), F.lit("S1").alias("sheet"), "row", F.posexplode(values).alias("p", "value")
    ).select("document_id", "sheet", "row", (F.col("p") + 1).alias("col"), "value")
    ranges = i.table("lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").cast("int").alias("max_row")).select(
        "document_id", F.lit("S1").alias("sheet"), F.lit(1).alias("min_row"), "max_row",
        F.lit(1).alias("min_col"), F.lit(1).alias("max_col"),
    )
    return table, ranges


@query("s9_merged_range_fill", 'SELECT document_id, sheet, "row", col, value FROM filled', ("filled",))
def s9(i: Inputs) -> DataFrame:
    return cells.fill_merged(*_cells(i)).select("document_id", "sheet", "row", "col", "value")


@query(
    "s10_sheets_to_text",
    """SELECT document_id, '## シート: S1' || chr(10) || string_agg(line || CASE WHEN "row" = 1 THEN chr(10) || '|---|---|---|' ELSE '' END, chr(10) ORDER BY "row") AS content
       FROM (SELECT document_id, "row", '| ' || string_agg(coalesce(value, ''), ' | ' ORDER BY col) || ' |' AS line FROM filled GROUP BY ALL)
       GROUP BY document_id""",
    ("filled",),
)
def s10(i: Inputs) -> DataFrame:
    return cells.sheets_to_text(cells.fill_merged(*_cells(i)))


@query(
    "s14_answer_read",
    """SELECT run, qid, text, n FROM (SELECT 'run' || (conv_id % 3) AS run, conv_id || '-' || turn AS qid, text,
         count(*) OVER (PARTITION BY conv_id % 3, conv_id || '-' || turn) AS n FROM conversations) WHERE n = 1""",
)
def s14(i: Inputs) -> DataFrame:
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    even = F.col("turn") % 2 == 0
    raw = i.table("conversations").select(
        F.when(even, name).alias("qid"), F.when(~even, name).alias("id"),
        F.when(even, F.col("text")).alias("text"), F.when(~even, F.col("text")).alias("answer"),
        F.lit(None).cast("string").alias("run"), F.concat(F.lit("run"), (F.col("conv_id") % 3).cast("string")).alias("stem"),
    )
    good, _ = files.read_answers(raw)
    return good.select("run", "qid", "text", F.lit(1).alias("n"))


# ---- chunks and vectors ---------------------------------------------------------


@query("v1_chunk_text", "SELECT document_id, chunk_index, content FROM chunks", ("chunks",))
def v1(i: Inputs) -> DataFrame:
    return i.chunks


@query("v2_chunk_count", "SELECT document_id, count(*) AS chunk_count FROM chunks GROUP BY document_id", ("chunks",))
def v2(i: Inputs) -> DataFrame:
    return chunking.chunk_counts(i.chunks)


@query(
    "v3_tokenise",
    f"""SELECT document_id, chunk_index, array_to_string({sql_tokens('content')}, ' ') AS tokens FROM chunks""",
    ("chunks",),
)
def v3(i: Inputs) -> DataFrame:
    return i.chunks.select("document_id", "chunk_index", F.array_join(tx.tokens(F.col("content")), " ").alias("tokens"))


@query(
    "v4_token_hash",
    f"""SELECT token, (('0x' || substr(sha256(token), 1, 8))::BIGINT % 131072)::INT AS token_id, count(*) AS n
        FROM (SELECT unnest({sql_tokens('content')}) AS token FROM chunks) GROUP BY ALL""",
    ("chunks",),
)
def v4(i: Inputs) -> DataFrame:
    counted = i.chunks.select(F.explode_outer(tx.tokens(F.col("content"))).alias("token")).filter("token is not null").groupBy("token").agg(F.count("*").alias("n"))
    return counted.withColumn("token_id", tx.token_id(F.col("token")))


@query("v5_sparse_vector", "SELECT document_id, chunk_index, token_id, round(weight, 9) AS weight FROM chunk_postings", ("chunk_postings",))
def v5(i: Inputs) -> DataFrame:
    long = vectors.postings(vectors.build_sparse(i.chunks).drop("content"))
    return long.withColumn("weight", F.round("weight", 9))


@query(
    "v6_dense_vector",
    """SELECT document_id, chunk_index, dim::INT AS dim, round(v, 9) + 0.0 AS value FROM chunk_dense WHERE round(v, 9) <> 0""",
    ("chunk_dense",),
)
def v6(i: Inputs) -> DataFrame:
    dense = vectors.project_sparse(vectors.build_sparse(i.chunks))
    long = dense.select("document_id", "chunk_index", F.posexplode("dense").alias("dim", "value"))
    return long.withColumn("value", F.round("value", 9)).filter("value <> 0")


# ---- chunk store ----------------------------------------------------------------

view("store_before", """
  SELECT document_id, chunk_index, content, 1 AS index_version, true AS is_active, 1 AS access_level, false AS unclassified FROM store WHERE lang <> 'es'
  UNION ALL SELECT document_id, chunk_index, content, 2, false, 1, false FROM store WHERE lang = 'fr'""", "store")
view("store_whole", """
  SELECT document_id, chunk_index, content, 1 AS index_version, true AS is_active, 1 AS access_level, false AS unclassified FROM store
  UNION ALL SELECT document_id, chunk_index, content, 2, false, 1, false FROM store WHERE lang = 'fr'""", "store")
view("store_new", """
  SELECT document_id, chunk_index, 'new ' || content AS content, 2 AS index_version, true AS is_active, access_level, unclassified
  FROM store WHERE lang IN ('en', 'es')""", "store")
view("store_after", """
  SELECT * FROM store_before WHERE document_id NOT IN (SELECT document_id FROM store_new) UNION ALL SELECT * FROM store_new""",
     "store_before", "store_new")
_KEYS = ["document_id", "chunk_index", "index_version", "is_active", "access_level", "unclassified"]
_KEY_SQL = ", ".join(_KEYS)


def _generations(base: DataFrame) -> DataFrame:
    """One stored generation of every chunk, and an inactive second one of a part, from one walk over the texts."""
    second = F.when(F.col("lang") == "fr", F.array(F.struct(F.lit(1).alias("v"), F.lit(True).alias("a")), F.struct(F.lit(2).alias("v"), F.lit(False).alias("a"))))
    versions = F.coalesce(second, F.array(F.struct(F.lit(1).alias("v"), F.lit(True).alias("a"))))
    rows = base.select("document_id", "chunk_index", "content", F.lit(1).alias("access_level"), F.lit(False).alias("unclassified"), F.explode(versions).alias("g"))
    return rows.select("document_id", "chunk_index", "content", "access_level", "unclassified", F.col("g.v").alias("index_version"), F.col("g.a").alias("is_active"))


def _store_whole(i: Inputs) -> DataFrame:
    return _generations(i.store)


def _store_parts(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """The store before a part of the corpus was added, and the chunks of what was added or changed."""
    base = i.store.select("document_id", "lang", "chunk_index", "content", "access_level", "unclassified")
    before = _generations(base.filter("lang <> 'es'"))
    new = base.filter("lang IN ('en', 'es')").withColumns(
        {"content": F.concat(F.lit("new "), "content"), "index_version": F.lit(2), "is_active": F.lit(True)}
    )
    return before, new.drop("lang")


@query("x1_generation_switch", f"SELECT {_KEY_SQL}, content FROM store_after", ("store_after",))
def x1(i: Inputs) -> DataFrame:
    touched = i.corpus.filter("lang IN ('en', 'es')")
    return store.apply_generation(*_store_parts(i), touched).select(*_KEYS, "content")


@query(
    "x1_staged_generation",
    f"""SELECT {_KEY_SQL} FROM store_before WHERE is_active OR document_id NOT IN (SELECT document_id FROM store_new)
        UNION ALL SELECT {_KEY_SQL.replace('is_active', 'false AS is_active')} FROM store_new""",
    ("store_before", "store_new"),
)
def x1_staged(i: Inputs) -> DataFrame:
    return store.stage_generation(*_store_parts(i)).select(*_KEYS)


@query(
    "x2_current_generation",
    f"""SELECT {_KEY_SQL} FROM (SELECT *, max(coalesce(index_version, -1)) OVER (PARTITION BY document_id) AS top
        FROM (SELECT * FROM store_whole UNION ALL SELECT * FROM store_new) WHERE is_active) WHERE index_version = top""",
    ("store_whole", "store_new"),
)
def x2(i: Inputs) -> DataFrame:
    return store.current_generation(_store_whole(i).unionByName(_store_parts(i)[1])).select(*_KEYS)


def _published(i: Inputs) -> tuple[str, object]:
    """The store as a bucketed table: where it is and what it holds."""
    base, rows = _folder(i, "chunk-table"), _store_whole(i)
    chunk_table.publish(rows, base)
    return base, rows.schema


@query(
    "x3_soft_deactivate",
    f"""SELECT {_KEY_SQL.replace('is_active', "is_active AND document_id NOT IN (SELECT document_id FROM corpus WHERE lang = 'de') AS is_active")} FROM store_whole""",
    ("store_whole", "corpus"),
)
def x3(i: Inputs) -> DataFrame:
    base, schema = _published(i)
    chunk_table.deactivate(i.spark, base, schema, i.corpus.filter("lang = 'de'"))
    return chunk_table.read(i.spark, base, schema).select(*_KEYS)


@query(
    "x4_hard_delete",
    f"SELECT {_KEY_SQL} FROM store_whole WHERE document_id NOT IN (SELECT document_id FROM corpus WHERE lang = 'de')",
    ("store_whole", "corpus"),
)
def x4(i: Inputs) -> DataFrame:
    base, schema = _published(i)
    chunk_table.delete(i.spark, base, schema, i.corpus.filter("lang = 'de'"))
    return chunk_table.read(i.spark, base, schema).select(*_KEYS)


@query(
    "x5_purge",
    """SELECT r.document_id, CASE WHEN r.status = 'deleted' THEN 'purged' ELSE r.status END AS status, coalesce(n, 0) AS chunks_left
       FROM registry r LEFT JOIN (SELECT document_id, count(*) AS n FROM store_whole
         WHERE document_id NOT IN (SELECT document_id FROM registry WHERE status = 'deleted') GROUP BY ALL) USING (document_id)""",
    ("registry", "store_whole"),
)
def x5(i: Inputs) -> DataFrame:
    after, left = store.purge(i.registry, _store_whole(i))
    counts = left.groupBy("document_id").agg(F.count("*").alias("n"))
    return after.join(counts, "document_id", "left").select(
        "document_id", "status", F.coalesce("n", F.lit(0)).alias("chunks_left")
    )


view("running", """
  SELECT document_id, file_hash, CASE WHEN doc_id % 2 = 0 THEN 'processing' ELSE 'pending' END AS status, index_version, 0 AS chunk_count FROM registry""", "registry")
view("results", """
  SELECT document_id, doc_id, file_hash, 2 AS index_version, n AS chunk_count FROM corpus
  JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY ALL) USING (document_id)""", "corpus", "chunks")
view("accepted", """
  SELECT s.document_id, s.chunk_count, r.status = 'processing' AND r.file_hash = s.file_hash AS ok
  FROM results s JOIN running r USING (document_id)""", "results", "running")


def _commit(i: Inputs):
    running = i.registry.select(
        "document_id", "file_hash", F.when(F.col("doc_id") % 2 == 0, "processing").otherwise("pending").alias("status"),
        "index_version", F.lit(0).alias("chunk_count"),
    )
    counts = chunking.chunk_counts(i.chunks)
    results = i.corpus.select("document_id", "file_hash", F.lit(2).alias("index_version")).join(counts, "document_id")
    return running, store.judge_results(running, results)


@query("x6_supersede_check", "SELECT document_id, ok AS accepted FROM accepted", ("accepted",))
def x6(i: Inputs) -> DataFrame:
    return _commit(i)[1].select("document_id", "accepted")


@query(
    "x6_registry_after_commit",
    """SELECT r.document_id, CASE WHEN ok THEN 'done' ELSE r.status END AS status, CASE WHEN ok THEN 2 ELSE r.index_version END AS index_version,
         CASE WHEN ok THEN a.chunk_count ELSE 0 END AS chunk_count FROM running r LEFT JOIN accepted a USING (document_id)""",
    ("running", "accepted"),
)
def x6_registry(i: Inputs) -> DataFrame:
    running, judged = _commit(i)
    after, _, _ = store.commit_results(running, _store_whole(i), i.tasks, judged)
    return after.select("document_id", "status", "index_version", "chunk_count")


@query(
    "x6_chunks_after_commit",
    f"SELECT {_KEY_SQL} FROM store_whole WHERE document_id NOT IN (SELECT document_id FROM accepted WHERE NOT ok)",
    ("store_whole", "accepted"),
)
def x6_chunks(i: Inputs) -> DataFrame:
    running, judged = _commit(i)
    return store.commit_results(running, _store_whole(i), i.tasks, judged)[1].select(*_KEYS)


@query(
    "x6_tasks_after_commit",
    """SELECT task_id, CASE WHEN t.status = 'processing' AND ok THEN 'done' WHEN t.status = 'processing' AND NOT ok THEN 'cancelled' ELSE t.status END AS status
       FROM tasks t LEFT JOIN accepted USING (document_id)""",
    ("tasks", "accepted"),
)
def x6_tasks(i: Inputs) -> DataFrame:
    running, judged = _commit(i)
    return store.commit_results(running, _store_whole(i), i.tasks, judged)[2].select("task_id", "status")


view("changes", """
  SELECT r.document_id, CASE WHEN m.active = false THEN 'deleted' ELSE 'updated' END AS action,
    CASE WHEN m.active IS DISTINCT FROM false THEN coalesce(m.level, 1) END AS new_level,
    CASE WHEN m.active IS DISTINCT FROM false THEN m.folder_id IS NULL END AS new_unclassified
  FROM registry r LEFT JOIN matched m USING (document_id)
  WHERE r.status NOT IN ('deleted', 'purged')
    AND (m.active = false OR coalesce(m.level, 1) <> r.access_level OR (m.folder_id IS NULL) <> r.unclassified)""",
     "registry", "matched")


@query(
    "x7_access_propagation",
    """SELECT s.document_id, chunk_index, index_version, coalesce(new_level, access_level) AS access_level,
         coalesce(new_unclassified, unclassified) AS unclassified, is_active AND action IS DISTINCT FROM 'deleted' AS is_active
       FROM store_whole s LEFT JOIN changes USING (document_id)""",
    ("store_whole", "changes"),
)
def x7(i: Inputs) -> DataFrame:
    base, schema = _published(i)
    chunk_table.propagate(i.spark, base, schema, registry.resync(i.registry, i.folders))
    return chunk_table.read(i.spark, base, schema).select(*_KEYS)


@query(
    "x8_registry_resync",
    "SELECT document_id, action, coalesce(new_level, 0) AS new_level, coalesce(new_unclassified, false) AS new_unclassified FROM changes",
    ("changes",),
)
def x8(i: Inputs) -> DataFrame:
    return registry.resync(i.registry, i.folders).fillna({"new_level": 0, "new_unclassified": False})


@query("x8_resync_counts", "SELECT count(*) FILTER (WHERE action = 'deleted') AS deleted, count(*) FILTER (WHERE action = 'updated') AS updated FROM changes", ("changes",))
def x8_counts(i: Inputs) -> DataFrame:
    return registry.resync_counts(registry.resync(i.registry, i.folders))


view("event_tasks", "SELECT user_id AS task_id, user_id::STRING AS document_id, (user_id % 2)::INT AS attempts, 'processing' AS status, event_id FROM events")


def _event_tasks(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = i.table("events")
    tasks = events.groupBy(F.col("user_id").alias("task_id")).agg(F.max("event_id").alias("last")).select(
        "task_id", F.col("task_id").cast("string").alias("document_id"), (F.col("task_id") % 2).cast("int").alias("attempts"),
        F.lit("processing").alias("status"),
    )
    failed = events.filter("event_type = 'error'").select(F.col("user_id").alias("task_id"))
    documents = tasks.select(
        "document_id", F.when(F.col("task_id") % 5 == 0, "pending").otherwise("processing").alias("status")
    )
    return tasks, failed, documents


@query(
    "x9_retry_policy",
    """SELECT task_id, attempts + n AS attempts, CASE WHEN n = 0 THEN 'processing' WHEN task_id % 5 = 0 THEN 'cancelled'
         WHEN attempts + n >= 3 THEN 'failed' ELSE 'pending' END AS status
       FROM (SELECT task_id, any_value(attempts) AS attempts, count(*) FILTER (WHERE e.event_type = 'error') AS n
             FROM event_tasks JOIN events e USING (event_id) GROUP BY task_id)""",
    ("event_tasks",),
)
def x9(i: Inputs) -> DataFrame:
    return registry.after_failures(*_event_tasks(i)).select("task_id", "attempts", "status")


@query(
    "x10_stale_recovery",
    """SELECT task_id, t.status = 'processing' AS recovered,
         CASE WHEN t.status IN ('pending', 'processing') AND r.status IN ('deleted', 'purged') THEN 'cancelled'
              WHEN t.status = 'processing' THEN 'pending' ELSE t.status END AS status,
         CASE WHEN r.status = 'processing' THEN 'pending' ELSE r.status END AS document_status
       FROM tasks t JOIN registry r USING (document_id)""",
    ("tasks", "registry"),
)
def x10(i: Inputs) -> DataFrame:
    documents = registry.recover_documents(i.registry).select("document_id", F.col("status").alias("document_status"))
    return registry.recover_tasks(i.tasks, i.registry).join(documents, "document_id").select(
        "task_id", "recovered", "status", "document_status"
    )


# ---- access ---------------------------------------------------------------------


@query(
    "a1_folder_match",
    """SELECT document_id, coalesce(folder_id, 0) AS folder_id, coalesce(level, 0) AS level, coalesce(active, false) AS active
       FROM corpus LEFT JOIN matched USING (document_id)""",
    ("corpus", "matched"),
)
def a1(i: Inputs) -> DataFrame:
    return access.match_folders(i.corpus.select("document_id", "source_path"), i.folders).select(
        "document_id", F.coalesce("folder_id", F.lit(0)).alias("folder_id"),
        F.coalesce("folder_level", F.lit(0)).alias("level"), F.coalesce("folder_active", F.lit(False)).alias("active"),
    )


@query("a2_level_at_ingest", "SELECT document_id, coalesce(access_level, -1) AS access_level FROM classified", ("classified",))
def a2(i: Inputs) -> DataFrame:
    return i.classified.select("document_id", F.coalesce("access_level", F.lit(-1)).alias("access_level"))


@query("a3_unclassified", "SELECT document_id, unclassified FROM classified", ("classified",))
def a3(i: Inputs) -> DataFrame:
    return i.classified.select("document_id", "unclassified")


@query("a4_retrieval_prefilter", "SELECT document_id, chunk_index, access_level FROM searchable WHERE access_level <= 2", ("searchable",))
def a4(i: Inputs) -> DataFrame:
    return access.visible_to(i.store, 2).select("document_id", "chunk_index", "access_level")


@query(
    "a5_revalidation",
    """SELECT t.conv_id, t.turn, t.document_id FROM (SELECT conv_id, turn, 1 + conv_id % 3 AS lvl,
           CASE WHEN conv_id % 5 = 0 THEN NULL ELSE (conv_id * 3 + turn)::STRING END AS document_id FROM conversations) t
       JOIN registry_now r ON r.document_id = t.document_id AND r.status NOT IN ('deleted', 'purged') AND r.access_level <= t.lvl AND NOT r.unclassified""",
    ("registry_now",),
)
def a5(i: Inputs) -> DataFrame:
    conv = F.col("conv_id")
    hits = i.table("conversations").select(
        "conv_id", "turn", (1 + conv % 3).alias("user_access_level"),
        F.when(conv % 5 != 0, (conv * 3 + F.col("turn")).cast("string")).alias("document_id"),
    )
    return access.revalidate(hits, i.registry_now).select("conv_id", "turn", "document_id")


view("users", """
  SELECT 'u' || user_id AS username, (1 + user_id % 3)::INT AS access_level, user_id % 7 <> 0 AS is_active, user_id % 4 AS token_version
  FROM events GROUP BY user_id""")


def _users(i: Inputs) -> DataFrame:
    user = F.col("user_id")
    return i.table("events").select("user_id").distinct().select(
        F.concat(F.lit("u"), user.cast("string")).alias("username"), (1 + user % 3).cast("int").alias("access_level"),
        (user % 7 != 0).alias("is_active"), (user % 4).alias("token_version"),
    )


@query(
    "a6_session_validity",
    """SELECT event_id, username, access_level FROM (SELECT event_id, 'u' || user_id AS username,
         CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id % 6 END AS token_version FROM events) s
       JOIN users u USING (username, token_version) WHERE u.is_active""",
    ("users",),
)
def a6(i: Inputs) -> DataFrame:
    event = F.col("event_id")
    sessions = i.table("events").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.when(event % 6 != 5, event % 6).alias("token_version"),
    )
    users = access.backfill_admins(_users(i))
    return access.valid_sessions(sessions, users).select("event_id", "username", "access_level")


@query("a7_admin_backfill", "SELECT username, access_level >= 3 AS is_admin FROM users", ("users",))
def a7(i: Inputs) -> DataFrame:
    return access.backfill_admins(_users(i)).select("username", "is_admin")


@query(
    "v7_store_schema_check",
    """SELECT t.name, coalesce(problem, '-') AS problem, (SELECT count(*) FROM store) AS chunks FROM (VALUES ('whole', NULL), ('without sparse', 'missing column sparse'),
         ('text version', 'column index_version is string'), ('other length', 'dense vectors are not all of length 65')) t(name, problem)""",
    ("store",),
)
def v7(i: Inputs) -> DataFrame:
    whole = vectors.project_sparse(vectors.build_sparse(i.store)).select(*vectors.STORE_FIELDS)
    cases = [("whole", whole, 64), ("without sparse", whole.drop("sparse"), 64), ("text version", whole.withColumn("index_version", F.col("index_version").cast("string")), 64), ("other length", whole, 65)]
    found = [(name, problem) for name, table, dims in cases for problem in vectors.store_problems(table, dims) or ["-"]]
    return i.spark.createDataFrame(found, "name string, problem string").withColumn("chunks", F.lit(i.store.count()).cast("long"))
