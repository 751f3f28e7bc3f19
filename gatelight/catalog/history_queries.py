"""Conversations, audit log and admin events as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.catalog.base import query, view
from gatelight.catalog.inputs import EPOCH, Inputs, sql_basename, sql_strip
from gatelight.catalog.search_queries import turn_pairs
from gatelight.operators import history, registry
from gatelight.plans import retrieval
from gatelight.session import shared_dir
from gatelight.sources import tables

view("messages", """
  SELECT conv_id * 1000000 + turn AS message_id, conv_id AS conversation_id, turn, role, text AS content, (1 + conv_id % 3)::INT AS user_access_level,
    1704067200 + conv_id * 3600 + turn * 60 AS created_s,
    CASE WHEN role <> 'assistant' THEN '[]' WHEN turn % 7 = 6 THEN 'no json' WHEN conv_id % 5 = 0 THEN
      '[' || array_to_string(list_transform([1, 2, 3], lambda k: '{"id":' || k || ',"source_file":"/watched/old/doc' || (conv_id * 3 + k) || '.txt","score":0.5,"content":"copied"}'), ',') || ']'
      ELSE '[' || array_to_string(list_transform([1, 2, 3], lambda k: '{"id":' || k || ',"document_id":"' || (conv_id * 3 + k) || '","chunk_index":0,"source_file":"doc' || (conv_id * 3 + k) || '.txt","score":0.25}'), ',') || ']'
    END AS sources
  FROM conversations""")
view("threads", """
  SELECT conv_id AS conversation_id, conv_id % 10 AS user_id, max(created_s) AS updated_s, min(created_s) AS created_s FROM (
    SELECT conversation_id AS conv_id, created_s FROM messages) GROUP BY conv_id""", "messages")


def messages(i: Inputs) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")

    def item(k: int) -> tuple:
        doc = (conv * 3 + k).cast("string")
        old = F.concat(F.lit(f'{{"id":{k},"source_file":"/watched/old/doc'), doc, F.lit('.txt","score":0.5,"content":"copied"}'))
        new = F.concat(
            F.lit(f'{{"id":{k},"document_id":"'), doc, F.lit('","chunk_index":0,"source_file":"doc'), doc, F.lit('.txt","score":0.25}')
        )
        return old, new

    old, new = zip(*[item(k) for k in (1, 2, 3)])

    def listed(items) -> F.Column:
        return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))

    sources = (
        F.when(F.col("role") != "assistant", "[]").when(turn % 7 == 6, "no json")
        .when(conv % 5 == 0, listed(old)).otherwise(listed(new))
    )
    return i.table("conversations").select(
        (conv * 1000000 + turn).alias("message_id"), conv.alias("conversation_id"), "turn", "role", F.col("text").alias("content"),
        (1 + conv % 3).cast("int").alias("user_access_level"), (EPOCH + conv * 3600 + turn * 60).alias("created_s"), sources.alias("sources"),
    )


def threads(i: Inputs) -> DataFrame:
    return messages(i).groupBy("conversation_id").agg(
        F.max("created_s").alias("updated_s"), F.min("created_s").alias("created_s")
    ).withColumn("user_id", F.col("conversation_id") % 10)


@query("h1_conversation_list", "SELECT conversation_id, user_id, updated_s AS updated_at FROM threads", ("threads",))
def h1(i: Inputs) -> DataFrame:
    return history.conversation_list(threads(i).withColumnRenamed("updated_s", "updated_at")).select("conversation_id", "user_id", "updated_at")


@query(
    "h2_owner_guard",
    """SELECT m.message_id FROM (SELECT message_id, conversation_id, CASE WHEN turn % 3 = 0 THEN 3 ELSE conversation_id % 10 END AS user_id FROM messages) m
       JOIN threads t USING (conversation_id, user_id)""",
    ("messages", "threads"),
)
def h2(i: Inputs) -> DataFrame:
    asked = messages(i).withColumn("user_id", F.when(F.col("turn") % 3 == 0, 3).otherwise(F.col("conversation_id") % 10))
    return history.owned(asked, threads(i)).select("message_id")


@query(
    "h3_title",
    f"SELECT message_id, coalesce(nullif(substr({sql_strip('t')}, 1, 30), ''), '新しい会話') AS title FROM (SELECT message_id, CASE WHEN turn % 5 = 4 THEN ' ' || chr(10) ELSE '  ' || content END AS t FROM messages)",
    ("messages",),
)
def h3(i: Inputs) -> DataFrame:
    asked = F.when(F.col("turn") % 5 == 4, " \n").otherwise(F.concat(F.lit("  "), "content"))
    return messages(i).select("message_id", history.title(asked).alias("title"))


@query(
    "h4_turn_persistence",
    """SELECT conv_id AS conversation_id, turn, p.part, p.role, CASE p.part WHEN 0 THEN question ELSE answer END AS content,
         CASE WHEN p.part = 1 AND conv_id % 2 = 0 THEN '[{"id":1}]' ELSE '[]' END AS sources
       FROM turns, (VALUES (0, 'user'), (1, 'assistant')) p(part, role)""",
    ("turns",),
)
def h4(i: Inputs) -> DataFrame:
    finished = turn_pairs(i).withColumns(
        {"conversation_id": F.col("conv_id"), "created_at": F.col("turn"), "sources": F.when(F.col("conv_id") % 2 == 0, '[{"id":1}]')}
    )
    return history.turn_messages(finished).drop("created_at")


@query("h4_touch", "SELECT conversation_id, updated_s AS updated_at FROM threads", ("threads",))
def h4_touch(i: Inputs) -> DataFrame:
    old = threads(i).select("conversation_id", F.col("created_s").alias("updated_at"))
    return history.touch(old, messages(i).withColumnRenamed("created_s", "created_at"))


view("resolved", f"""
  SELECT m.message_id, (k - 1)::INT AS position, k AS id,
    CASE WHEN m.conversation_id % 5 = 0 THEN 'legacy' WHEN r.document_id IS NULL THEN 'redacted' ELSE 'open' END AS state,
    CASE WHEN m.conversation_id % 5 = 0 OR r.document_id IS NOT NULL THEN 'doc' || (m.conversation_id * 3 + k) || '.txt' END AS source_file,
    CASE WHEN m.conversation_id % 5 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS score,
    CASE WHEN m.conversation_id % 5 <> 0 AND r.document_id IS NOT NULL THEN coalesce(s.content, '{history.CONTENT_GONE}') END AS content
  FROM (SELECT *, unnest([1, 2, 3]) AS k FROM messages WHERE json_valid(sources) AND sources <> '[]') m
  LEFT JOIN registry_now r ON m.conversation_id % 5 <> 0 AND r.document_id = (m.conversation_id * 3 + k)::STRING AND r.status NOT IN ('deleted', 'purged')
    AND r.access_level <= m.user_access_level AND NOT r.unclassified
  LEFT JOIN store s ON s.document_id = r.document_id AND s.chunk_index = 0 AND s.is_active""", "messages", "registry_now", "store")
_DASHED = "coalesce(source_file, '-') AS source_file, score, coalesce(content, '-') AS content"


@query("h5_resolved_sources", f"SELECT message_id, position, id, state, {_DASHED} FROM resolved", ("resolved",))
def h5(i: Inputs) -> DataFrame:
    return history.resolve_sources(messages(i), i.registry_now, i.stored_content).fillna("-", ["source_file", "content"])


@query(
    "h5_history",
    """SELECT m.message_id, m.role, coalesce(r.sources, '-') AS sources FROM messages m LEFT JOIN (
         SELECT message_id, string_agg(id || ':' || state, ',' ORDER BY position) AS sources FROM resolved GROUP BY message_id) r USING (message_id)""",
    ("messages", "resolved"),
)
def h5_history(i: Inputs) -> DataFrame:
    rows = messages(i)
    shown = history.history(rows, history.resolve_sources(rows, i.registry_now, i.stored_content))
    each = F.transform("resolved_sources", lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["state"]))
    return shown.select("message_id", "role", F.coalesce(F.array_join(each, ","), F.lit("-")).alias("sources"))


@query(
    "h6_conversation_delete",
    """SELECT message_id FROM messages WHERE conversation_id NOT IN (SELECT conversation_id FROM threads WHERE conversation_id % 10 = conversation_id % 7)""",
    ("messages", "threads"),
)
def h6(i: Inputs) -> DataFrame:
    rows, owners = messages(i), threads(i)
    requests = owners.select("conversation_id", (F.col("conversation_id") % 7).alias("user_id"))
    return history.delete_conversations(owners, rows, requests)[1].select("message_id")


@query(
    "h7_audit_rows",
    f"""SELECT q.question_id, q.user_id, q.username, q.question, length(a.answer) AS answer_chars, coalesce(a.error, '-') AS error,
          coalesce('[' || string_agg('{{"document_id":"' || document_id || '","chunk_index":' || chunk_index || ',"source_file":"' || {sql_basename('source_file')}
            || '","score":' || score || ',"access_level":' || access_level || '}}', ',' ORDER BY rank) || ']', '[]') AS retrieved_chunks
        FROM questions q JOIN answers a USING (question_id) LEFT JOIN (SELECT question_id, document_id, chunk_index, source_file, score, access_level, rank FROM hits) h USING (question_id) GROUP BY ALL""",
    ("questions", "answers", "hits"),
)
def h7(i: Inputs) -> DataFrame:
    from gatelight.session import saved

    hits = saved(i.hits)
    user = F.col("item_id") % 10
    asked = i.table("benchmark").select(
        F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("question_id"), user.alias("user_id"),
        F.concat(F.lit("user"), user.cast("string")).alias("username"), F.col("text").alias("question"),
    )
    told = i.answers(hits).select("question_id", "answer", "error")
    return history.audit_rows(asked.join(told, "question_id"), hits).fillna("-", ["error"])


@query(
    "h8_audit_page",
    """SELECT message_id AS id, content AS question, coalesce(json_array_length(try_cast(sources AS JSON)), 0)::INT AS chunks FROM messages ORDER BY id DESC LIMIT 100 OFFSET 20""",
    ("messages",),
)
def h8(i: Inputs) -> DataFrame:
    logs = messages(i).select(
        F.col("message_id").alias("id"), F.col("content").alias("question"), F.col("sources").alias("retrieved_chunks"), F.lit("old").alias("answer")
    )
    return history.audit_page(logs, 100, 20).select("id", "question", F.size("retrieved_chunks").alias("chunks"))


view("admin_events", """
  SELECT event_id AS id, user_id, 'u' || user_id AS username, event_type AS action,
    CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 10 = 0 THEN 'broken{' ELSE props END AS detail, event_id % 11 = 0 AS bare FROM events""")


def _admin_events(i: Inputs) -> DataFrame:
    event = F.col("event_id")
    return i.table("events").select(
        event.alias("id"), "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.col("event_type").alias("action"),
        F.when(event % 9 == 0, "").when(event % 10 == 0, "broken{").otherwise(F.col("props")).alias("detail"), (event % 11 == 0).alias("bare"),
    )


_K = "json_extract_string(try_cast(nullif(detail, '') AS JSON), '$.k')"


@query(
    "h9_event_page",
    f"SELECT id, username, action, coalesce({_K}, '-') AS k FROM admin_events ORDER BY id DESC LIMIT 500 OFFSET 7",
    ("admin_events",),
)
def h9(i: Inputs) -> DataFrame:
    page = history.event_page(_admin_events(i), 500, 7)
    return page.select("id", "username", "action", F.coalesce(F.try_element_at("detail", F.lit("k")), F.lit("-")).alias("k"))


@query(
    "h10_event_append",
    """SELECT doc_id AS user_id, '' AS username, 'add_folder' AS action, '{"path":"' || source_path || '","access_level":' || coalesce(access_level::STRING, 'null') || '}' AS detail, mtime_s AS created_at FROM classified""",
    ("classified",),
)
def h10(i: Inputs) -> DataFrame:
    requests = i.classified.select(
        F.col("doc_id").alias("user_id"), F.lit(None).cast("string").alias("username"), F.lit("add_folder").alias("action"),
        F.col("source_path").alias("path"), "access_level", F.col("mtime_s").alias("created_at"),
    )
    return history.admin_event_rows(requests, ["path", "access_level"])


@query(
    "h11_detail_summary",
    f"SELECT id, CASE WHEN bare THEN '-' ELSE coalesce('k=' || {_K}, '') END AS summary FROM admin_events",
    ("admin_events",),
)
def h11(i: Inputs) -> DataFrame:
    detail = F.when(~F.col("bare"), history.read_detail(F.col("detail")))
    return _admin_events(i).select("id", history.detail_summary(detail).alias("summary"))


@query("h12_document_list", "SELECT document_id, source_path, status, updated_s FROM registry", ("registry",))
def h12(i: Inputs) -> DataFrame:
    return history.document_list(i.registry.withColumn("updated_at", F.col("updated_s"))).select("document_id", "source_path", "status", "updated_s")


@query(
    "h13_task_list",
    "SELECT task_id, t.status, source_path FROM tasks t JOIN registry r USING (document_id) ORDER BY created_s DESC, task_id DESC LIMIT 100",
    ("tasks", "registry"),
)
def h13(i: Inputs) -> DataFrame:
    return history.task_list(i.tasks.withColumnRenamed("created_s", "created_at"), i.registry).select("task_id", "status", "source_path")


@query(
    "h14_unclassified_list",
    "SELECT document_id, source_path FROM registry_now WHERE unclassified AND status NOT IN ('deleted', 'purged')",
    ("registry_now",),
)
def h14(i: Inputs) -> DataFrame:
    return history.unclassified_list(i.registry_now.withColumn("updated_at", F.col("updated_s"))).select("document_id", "source_path")


view("requests", """
  SELECT '/watched/' || source AS path, ['add', 'update', 'disable'][1 + n % 3] AS kind, (1 + n // 3 % 4)::INT AS access_level
  FROM (SELECT DISTINCT source, substr(source, 4)::INT AS n FROM documents)""")


@query(
    "h15_folder_upsert",
    """SELECT path, action, CASE WHEN action IN ('insert', 'enable', 'update') THEN asked ELSE coalesce(level, 0) END AS access_level,
         CASE WHEN action IN ('insert', 'enable') THEN true WHEN action = 'disable' THEN false ELSE coalesce(active, false) END AS is_active
       FROM (SELECT path, f.access_level AS level, f.is_active AS active, r.access_level AS asked,
           CASE WHEN kind IS NULL THEN 'keep' WHEN kind = 'disable' THEN CASE WHEN f.path IS NULL THEN 'unknown' ELSE 'disable' END
                WHEN r.access_level NOT BETWEEN 1 AND 3 THEN 'reject_level'
                WHEN kind = 'update' THEN CASE WHEN f.is_active THEN 'update' ELSE 'unknown' END
                WHEN f.path IS NULL THEN 'insert' WHEN f.is_active THEN 'reject_active' ELSE 'enable' END AS action
         FROM (SELECT folder_id, path, access_level, is_active AND folder_id % 7 <> 1 AS is_active FROM folders) f FULL OUTER JOIN requests r USING (path))""",
    ("folders", "requests"),
)
def h15(i: Inputs) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    asked = i.table("documents").select("source").distinct().select(
        F.concat(F.lit("/watched/"), "source").alias("path"), F.element_at(F.lit(["add", "update", "disable"]), n % 3 + 1).alias("kind"),
        (1 + F.floor(n / 3) % 4).cast("int").alias("access_level"),
    )
    now = i.folders.withColumn("is_active", F.col("is_active") & (F.col("folder_id") % 7 != 1))
    return registry.upsert_folders(now, asked).fillna({"access_level": 0, "is_active": False})


@query(
    "h16_source_scrub",
    """SELECT message_id, CASE WHEN contains(sources, '"content"') THEN
         '[' || array_to_string(list_transform([1, 2, 3], lambda k: '{"id":' || k || ',"score":0.5,"source_file":"doc' || (conversation_id * 3 + k) || '.txt"}'), ',') || ']'
         ELSE sources END AS sources FROM messages""",
    ("messages",),
)
def h16(i: Inputs) -> DataFrame:
    spark, base = i.spark, f"{shared_dir(i.spark)}/gatelight-messages/{uuid.uuid4().hex}"
    tables.publish(messages(i).select("message_id", "sources"), base)
    # The second run finds the key in the manifest and leaves the table alone.
    assert [history.strip_legacy_sources(spark, base) for _ in range(2)] == [True, False]
    return tables.read_current(spark, base).select("message_id", "sources")


@query("h17_audit_scrub", "SELECT message_id AS id, '-' AS answer, -1 AS answer_chars FROM messages", ("messages",))
def h17(i: Inputs) -> DataFrame:
    logs = messages(i).select(F.col("message_id").alias("id"), F.col("content").alias("answer"))
    return history.scrub_answers(logs).fillna({"answer": "-", "answer_chars": -1})


@query("h18_additive_migration", "SELECT document_id, status, false AS unclassified, 1 AS index_version, 0 AS chunk_count FROM registry", ("registry",))
def h18(i: Inputs) -> DataFrame:
    old = i.registry.select("document_id", "status", "index_version")
    return history.add_columns(old, {"unclassified": ("boolean", False), "index_version": ("int", 0), "chunk_count": ("int", 0)})
