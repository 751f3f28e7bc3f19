"""Conversations, audit log and admin events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.functions import text as tx
from gatelight.operators.access import GONE, may_read
from gatelight.operators.store import lookup
from gatelight.sources import tables

# Texts shown to the reader.
DEFAULT_TITLE = "新しい会話"
TITLE_CHARS = 30
CONTENT_GONE = "(本文は現在参照できません)"
PAGE_MAX = 500

SOURCES_TYPE = "array<struct<id:int,document_id:string,chunk_index:int,source_file:string,score:double>>"
CHUNKS_TYPE = (
    "array<struct<document_id:string,chunk_index:int,source_file:string,score:double,access_level:int>>"
)


def conversation_list(conversations: DataFrame, user_id: int | None = None) -> DataFrame:
    """Newest first: one owner's list, or every owner's one after the other."""
    newest = [F.desc("updated_at"), F.desc("conversation_id")]
    if user_id is not None:
        return conversations.filter(F.col("user_id") == user_id).orderBy(*newest)
    return conversations.orderBy("user_id", *newest)


def owned(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows whose (conversation_id, user_id) names a conversation and its owner."""
    return rows.join(conversations.select("conversation_id", "user_id"), ["conversation_id", "user_id"], "left_semi")


def title(question: Column) -> Column:
    head = F.substring(tx.strip(question), 1, TITLE_CHARS)
    return F.when(F.coalesce(head, F.lit("")) == "", DEFAULT_TITLE).otherwise(head)


def source_items(hits: DataFrame) -> DataFrame:
    """Per question the id-only source list kept with an answer, as JSON text."""
    item = F.struct(
        F.col("rank").alias("id"),
        "document_id",
        "chunk_index",
        tx.basename(F.col("source_file")).alias("source_file"),
        "score",
    )
    return hits.groupBy("question_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("sources"))


def turn_messages(turns: DataFrame) -> DataFrame:
    """Two message rows per finished turn: the question without sources, the answer with its ids."""
    rows = F.array(
        F.struct(
            F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content"),
            F.lit("[]").alias("sources"),
        ),
        F.struct(
            F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content"),
            F.coalesce("sources", F.lit("[]")).alias("sources"),
        ),
    )
    return turns.select("conversation_id", "turn", "created_at", F.inline(rows))


def touch(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """A conversation is as new as its newest message."""
    newest = messages.groupBy("conversation_id").agg(F.max("created_at").alias("_newest"))
    return (
        conversations.join(newest, "conversation_id", "left")
        .withColumn("updated_at", F.coalesce("_newest", "updated_at"))
        .drop("_newest")
    )


def resolve_sources(messages: DataFrame, registry: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each cited source under present permissions, one row per citation.

    ``messages``: message_id, user_access_level, sources (JSON). state is
    ``legacy`` (no document id: name only), ``redacted`` (not allowed: id and
    score only) or ``open`` (content looked up now). Legacy rows skip the joins,
    where their null keys would all meet in one task. ``chunks`` is the chunk table, or a
    function that looks up the content of keys (as ``chunk_table.lookup`` does by bucket).
    """
    items = messages.select(
        "message_id", "user_access_level", F.posexplode_outer(F.from_json("sources", SOURCES_TYPE)).alias("position", "s")
    ).filter("position is not null").select("message_id", "user_access_level", "position", "s.*")
    old = F.coalesce("document_id", F.lit("")) == ""
    legacy = items.filter(old).select(
        "message_id", "position", "id", F.lit("legacy").alias("state"),
        tx.basename(F.col("source_file")).alias("source_file"), "score", F.lit(None).cast("string").alias("content"),
    )
    live = registry.select(
        "document_id", F.col("access_level").alias("_level"), F.col("status").alias("_status"),
        F.col("unclassified").alias("_loose"),
    )
    checked = items.filter(~old).join(live, "document_id", "left").withColumn(
        "_open", may_read(F.col("user_access_level"), F.col("_level"), F.col("_status"), F.col("_loose"))
    )
    asked = checked.filter("_open").select("document_id", "chunk_index")
    found = chunks(asked) if callable(chunks) else lookup(chunks, asked)
    shown = checked.join(found, ["document_id", "chunk_index"], "left").select(
        "message_id", "position", "id",
        F.when(F.col("_open"), "open").otherwise("redacted").alias("state"),
        F.when(F.col("_open"), tx.basename(F.col("source_file"))).alias("source_file"),
        "score",
        F.when(F.col("_open"), F.coalesce("content", F.lit(CONTENT_GONE))).alias("content"),
    )
    return legacy.unionByName(shown)


def history(messages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Messages with their resolved sources put back as an array, in order."""
    item = F.struct("position", "id", "state", "source_file", "score", "content")
    lists = resolved.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("resolved_sources"))
    return messages.join(lists, "message_id", "left")


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Without the requested conversations and their messages; a request counts only from the owner."""
    gone = owned(requests, conversations).select("conversation_id").distinct()
    return (
        conversations.join(gone, "conversation_id", "left_anti"),
        messages.join(gone, "conversation_id", "left_anti"),
    )


def audit_rows(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Who asked what on which grounds: five fields per chunk, the answer's length, never its text."""
    item = F.struct(
        "document_id", "chunk_index", tx.basename(F.col("source_file")).alias("source_file"), "score", "access_level"
    )
    lists = hits.groupBy("question_id").agg(
        F.to_json(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda e: e["item"]),
            {"ignoreNullFields": "false"},
        ).alias("retrieved_chunks")
    )
    return questions.join(lists, "question_id", "left").select(
        "question_id",
        "user_id",
        "username",
        "question",
        F.coalesce("retrieved_chunks", F.lit("[]")).alias("retrieved_chunks"),
        F.coalesce(F.length("answer"), F.lit(0)).alias("answer_chars"),
        "error",
    )


def _page(rows: DataFrame, key: str, limit: int, offset: int, before: int | None) -> DataFrame:
    """A page counted from the newest, or the one after id ``before``: its cost does not grow with its depth."""
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1..{PAGE_MAX} and offset at least 0")
    if before is not None:
        rows = rows.filter(F.col(key) < before)
    newest = rows.orderBy(F.desc(key))
    return (newest.offset(offset) if offset else newest).limit(limit)


def audit_page(logs: DataFrame, limit: int = 50, offset: int = 0, before: int | None = None) -> DataFrame:
    """A page of the audit log, newest id first; unreadable chunk lists read as empty."""
    page = _page(logs.drop("answer"), "id", limit, offset, before)
    empty = F.array().cast(CHUNKS_TYPE)
    return page.withColumn("retrieved_chunks", F.coalesce(F.from_json("retrieved_chunks", CHUNKS_TYPE), empty))


def event_page(events: DataFrame, limit: int = 50, offset: int = 0, before: int | None = None) -> DataFrame:
    """A page of admin events, newest id first; unreadable or missing details read as empty."""
    return _page(events, "id", limit, offset, before).withColumn("detail", read_detail(F.col("detail")))


def read_detail(detail: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(detail, "map<string,string>"), empty)


def admin_event_rows(requests: DataFrame, detail: list[str]) -> DataFrame:
    """Event rows from (user_id, username, action, created_at) and the named detail fields."""
    return requests.select(
        "user_id", F.coalesce("username", F.lit("")).alias("username"), "action",
        F.to_json(F.struct(*detail), {"ignoreNullFields": "false"}).alias("detail"), "created_at",
    )


def detail_summary(detail: Column) -> Column:
    """``k=v, k=v`` of a detail map; ``-`` when there is none."""
    pairs = F.transform(F.map_entries(detail), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.when(detail.isNull(), "-").otherwise(F.array_join(pairs, ", "))


def document_list(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("updated_at"), F.asc("document_id"))


def task_list(tasks: DataFrame, registry: DataFrame, limit: int = 100) -> DataFrame:
    """Newest tasks with the path of their document."""
    return tasks.join(registry.select("document_id", "source_path"), "document_id").orderBy(
        F.desc("created_at"), F.desc("task_id")
    ).limit(limit)


def unclassified_list(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("unclassified") & ~F.col("status").isin(*GONE)).orderBy(
        F.desc("updated_at"), F.asc("document_id")
    )


def scrub_sources(sources: Column) -> Column:
    """Source lists without copied content, as JSON text.

    An item that holds content keeps its id and score, and whatever it has of
    document id, chunk index and file name (cut to its last part). Other items and
    texts that are no list come back unchanged.
    """
    items = F.from_json(sources, "array<variant>")
    null = F.parse_json(F.lit("null"))

    def fields(item: Column) -> Column:
        return F.try_variant_get(item, "$", "map<string,variant>")

    def holds(item: Column) -> Column:
        return F.coalesce(F.map_contains_key(fields(item), "content"), F.lit(False))

    def clean(item: Column) -> Column:
        def entry(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("k"), value.alias("v"))

        def kept(name: str) -> Column:
            value = fields(item)[name]
            return F.when(value.isNotNull() & ~F.is_variant_null(value), entry(name, value))

        name = F.try_variant_get(item, "$.source_file", "string")
        parts = F.array(
            entry("id", F.coalesce(fields(item)["id"], null)),
            entry("score", F.coalesce(fields(item)["score"], null)),
            kept("document_id"),
            kept("chunk_index"),
            F.when(name.isNotNull(), entry("source_file", tx.basename(name).cast("variant"))),
        )
        return F.to_json(F.map_from_entries(F.array_compact(parts)))

    texts = F.transform(items, lambda i: F.when(holds(i), clean(i)).otherwise(F.to_json(i)))
    scrubbed = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    return F.when(F.coalesce(F.exists(items, holds), F.lit(False)), scrubbed).otherwise(sources)


#: Fixed value: the key under which the scrub of old source lists is entered in a table's migrations.
STRIP_LEGACY_SOURCES = "strip_legacy_message_sources_content"


def strip_legacy_sources(spark: SparkSession, messages_at: str) -> bool:
    """Scrubs the published message table once; later runs read no message. Says whether this run did it."""
    return tables.migrate(spark, messages_at, STRIP_LEGACY_SOURCES, lambda rows: rows.withColumn("sources", scrub_sources(F.col("sources"))))


def scrub_answers(logs: DataFrame) -> DataFrame:
    """First migration only: the log of old holds answers; from then on it holds their length."""
    if "answer_chars" in logs.columns:
        return logs
    return logs.withColumn("answer_chars", F.lit(None).cast("int")).withColumn("answer", F.lit(None).cast("string"))


def add_columns(rows: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns with their default, existing ones untouched: {name: (type, default)}."""
    missing = {n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in rows.columns}
    return rows.withColumns(missing) if missing else rows
