"""File events as a stream: settle, suppress repeats, and keep registry and chunks up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatelight.operators.access import GONE, classify
from gatelight.operators.chunking import chunk_counts, chunk_text
from gatelight.operators.registry import document_id, supported_files
from gatelight.session import discard, saved
from gatelight.sources.tables import append_batch, bucket_of, compact_log, compactions, read_log, vacuum

EVENT_SCHEMA = "event_id bigint, ts timestamp, kind string, source_path string, old_path string, content string"
REGISTRY_SCHEMA = (
    "document_id string, source_path string, file_hash string, access_level int, unclassified boolean, "
    "status string, index_version int, chunk_count bigint"
)
CHUNK_SCHEMA = (
    "document_id string, source_file string, access_level int, unclassified boolean, index_version int, "
    "chunk_index int, content string"
)


def split_moves(events: DataFrame) -> DataFrame:
    """A move becomes a delete of the old path and a creation of the new one."""
    here = F.struct("source_path", F.when(F.col("kind") == "moved", "created").otherwise(F.col("kind")).alias("kind"), "content")
    gone = F.struct(F.col("old_path").alias("source_path"), F.lit("deleted").alias("kind"), F.lit(None).cast("string").alias("content"))
    sides = F.when(F.col("kind") == "moved", F.array(gone, here)).otherwise(F.array(here))
    return events.select("event_id", "ts", F.inline(sides))


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path. Folded before the shuffle, so a path touched
    a million times sends one row per task."""
    rest = [c for c in events.columns if c != "source_path"]
    last = F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("source_path").agg(last).select("source_path", "e.*")


def settle(events: DataFrame, gap: str = "10 seconds", watermark: str = "10 seconds") -> DataFrame:
    """One row per path and burst of changes: what the burst ended with, once the path is quiet for ``gap``.

    The same plan over a stream (bursts come out as the watermark passes them) or a table.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    last = F.max_by(F.struct("event_id", "kind"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("source_path", F.session_window("ts", gap).alias("burst")).agg(
        last, F.max("ts").alias("settled_from"), F.count("*").alias("changes")
    ).select("source_path", "e.event_id", "e.kind", "settled_from", "changes")


def effective(events: DataFrame, registry: DataFrame, folders: DataFrame) -> DataFrame:
    """Last event per path, judged against the registry: insert, requeue, delete, skip or none.

    Comparing with the registry, not with earlier events, is what lets content go
    A, B, A: the return to A differs from the registry's B.
    """
    last = last_events(events)
    known = registry.select(
        "source_path", F.col("document_id").alias("_id"), F.col("file_hash").alias("_hash"),
        F.col("status").alias("_status"), F.col("index_version").alias("_version"),
    )
    both = classify(last.join(known, "source_path", "left"), folders)
    gone = F.col("kind") == "deleted"
    changed = (F.col("_hash") != F.col("file_hash")) | F.col("_status").isin(*GONE, "failed")
    action = (
        F.when(gone, F.when(F.col("_id").isNull() | F.col("_status").isin(*GONE), "none").otherwise("delete"))
        .when(F.col("access_level").isNull(), "skip")
        .when(F.col("_id").isNull(), "insert")
        .when(changed, "requeue")
        .otherwise("none")
    )
    return both.withColumn("action", action).withColumn(
        "document_id", F.coalesce("_id", document_id(F.col("source_path")))
    )


def current_registry(log: DataFrame) -> DataFrame:
    """Newest row of each path."""
    rest = [c for c in log.columns if c not in ("source_path", "batch")]
    return log.groupBy("source_path").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("source_path", "r.*")


def visible_chunks(chunk_log: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks of the generation the registry names: older ones, and those of a batch
    that never got to its registry rows, match nothing."""
    live = registry.filter(F.col("status") == "done").select("document_id", "index_version")
    return chunk_log.join(live, ["document_id", "index_version"], "left_semi").drop("batch").withColumn(
        "is_active", F.lit(True)
    )


def apply_batch(events: DataFrame, batch: int, base: str, folders: DataFrame) -> None:
    """One micro-batch: writes only what changed. The registry rows come last and make the chunks count."""
    spark = events.sparkSession
    found = supported_files(split_moves(events)).withColumn("file_hash", F.sha2("content", 256))
    # The few bucket numbers of the batch's paths: no other bucket of the log is read.
    buckets = sorted(r.bucket for r in found.select(bucket_of(F.col("source_path")).alias("bucket")).distinct().collect())
    log = read_log(spark, f"{base}/registry", REGISTRY_SCHEMA, before=batch, buckets=buckets)
    touched = log.join(found.select("source_path").distinct(), "source_path", "left_semi")
    # Read by the chunks and by the registry rows, and the log must not change between the two.
    todo = saved(effective(found, current_registry(touched), folders).filter(F.col("action").isin("insert", "requeue", "delete")))
    fresh = todo.filter("action <> 'delete'").withColumn("index_version", F.coalesce(F.col("_version"), F.lit(0)) + 1)
    chunks = chunk_text(
        fresh.select(
            "document_id", F.col("source_path").alias("source_file"), "access_level", "unclassified", "index_version", "content"
        )
    )
    append_batch(chunks, f"{base}/chunks", batch, "document_id")
    counts = chunk_counts(spark.read.schema(CHUNK_SCHEMA).parquet(f"{base}/chunks/batch={batch}"))
    done = fresh.join(counts, "document_id", "left").select(
        "document_id", "source_path", "file_hash", "access_level", "unclassified", F.lit("done").alias("status"),
        "index_version", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )
    removed = todo.filter("action = 'delete'").select(
        "document_id", "source_path", F.col("_hash").alias("file_hash"), F.coalesce("access_level", F.lit(1)).alias("access_level"), "unclassified",
        F.lit("deleted").alias("status"), F.col("_version").alias("index_version"), F.lit(0).cast("bigint").alias("chunk_count"),
    )
    append_batch(done.unionByName(removed), f"{base}/registry", batch, "source_path")
    discard(todo)


def start_ingest(events: DataFrame, base: str, folders: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs :func:`apply_batch` for every micro-batch of a stream with EVENT_SCHEMA."""
    return (
        events.writeStream.foreachBatch(lambda df, batch: apply_batch(df, batch, base, folders))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def current_state(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(registry, visible chunks) as of the last finished batch."""
    registry = current_registry(read_log(spark, f"{base}/registry", REGISTRY_SCHEMA))
    return registry, visible_chunks(read_log(spark, f"{base}/chunks", CHUNK_SCHEMA), registry)


def compact(spark: SparkSession, base: str) -> bool:
    """Publishes the state before the newest batch as a version of both logs, without history.

    Streams and readers go on meanwhile: a batch that is written again, and whoever has
    begun to read, still finds what it needs. Says whether there was anything to do.
    """
    def newest(log: DataFrame) -> DataFrame:
        rest = [c for c in log.columns if c != "source_path"]
        return log.groupBy("source_path").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("source_path", "r.*")

    if not compact_log(spark, f"{base}/registry", REGISTRY_SCHEMA, newest):
        return False
    # Only generations that the state before the newest batch names, or that a later batch may still name.
    last = compactions(spark, f"{base}/registry")[-1][1]
    state = current_registry(read_log(spark, f"{base}/registry", REGISTRY_SCHEMA, before=last + 1))
    live = state.filter("status = 'done'").select("document_id", "index_version")
    compact_log(spark, f"{base}/chunks", CHUNK_SCHEMA, lambda log: log.join(live, ["document_id", "index_version"], "left_semi"))
    for name in ("registry", "chunks"):
        vacuum(spark, f"{base}/{name}")
    return True
