"""Upkeep of the chunk table. Every function maps tables to tables; nothing is changed in place.

Over a stored table, ``sources.chunk_table`` hands these functions only the buckets they touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_generation(new_chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Numbers new chunks one above the version the registry knows for their document."""
    known = registry.select("document_id", (F.coalesce("index_version", F.lit(0)) + 1).alias("index_version"))
    return new_chunks.drop("index_version").join(known, "document_id")


def _touched(new_chunks: DataFrame, touched: DataFrame | None) -> DataFrame:
    if touched is None:
        return new_chunks.select("document_id").distinct()
    return touched.select("document_id")


def stage_generation(chunks: DataFrame, new_chunks: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """First half of a switch: residue of touched documents gone, new rows in but inactive.

    This is what a run that fails before the switch leaves behind: searches still
    see the old generation. ``touched``: see :func:`apply_generation`.
    """
    touched = _touched(new_chunks, touched)
    other = chunks.join(touched, "document_id", "left_anti")
    old_active = chunks.filter("is_active").join(touched, "document_id", "left_semi")
    return other.unionByName(old_active).unionByName(new_chunks.withColumn("is_active", F.lit(False)))


def apply_generation(chunks: DataFrame, new_chunks: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """A finished switch: the new rows are the touched documents' only rows, and active.

    ``touched`` names the re-indexed documents where the caller has them apart from
    their chunks, which are then not read for their ids.
    """
    touched = _touched(new_chunks, touched)
    return chunks.join(touched, "document_id", "left_anti").unionByName(
        new_chunks.withColumn("is_active", F.lit(True))
    )


def current_generation(chunks: DataFrame) -> DataFrame:
    """Active rows of each document's highest active version (no version ranks lowest)."""
    active = chunks.filter("is_active").withColumn("_v", F.coalesce("index_version", F.lit(-1)))
    newest = active.groupBy("document_id").agg(F.max("_v").alias("_v"))
    return active.join(newest, ["document_id", "_v"], "left_semi").drop("_v")


def deactivate(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Soft delete: the rows of these documents become inactive."""
    off = documents.select("document_id").distinct().withColumn("_off", F.lit(True))
    return (
        chunks.join(off, "document_id", "left")
        .withColumn("is_active", F.when(F.col("_off"), F.lit(False)).otherwise(F.col("is_active")))
        .drop("_off")
    )


def delete(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hard delete: the rows of these documents go."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def purge(registry: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleted documents lose their chunks and become purged: (registry, chunks)."""
    gone = registry.filter("status = 'deleted'")
    status = F.when(F.col("status") == "deleted", "purged").otherwise(F.col("status"))
    return registry.withColumn("status", status), delete(chunks, gone)


def judge_results(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Adds ``accepted``: the document is still being processed and its content is still the same."""
    held = registry.select("document_id", F.col("status").alias("_status"), F.col("file_hash").alias("_hash"))
    same = (F.col("_status") == "processing") & (F.col("_hash") == F.col("file_hash"))
    return (
        results.join(held, "document_id", "left")
        .withColumn("accepted", F.coalesce(same, F.lit(False)))
        .drop("_status", "_hash")
    )


def commit_results(
    registry: DataFrame, chunks: DataFrame, tasks: DataFrame, judged: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry, chunks and tasks after indexing: accepted documents are done, a superseded
    one loses every chunk, its old generation too, and its task is cancelled."""
    outcome = judged.select("document_id", "accepted", F.col("index_version").alias("_v"), F.col("chunk_count").alias("_n"))
    ok = F.coalesce("accepted", F.lit(False))
    registry = registry.join(outcome, "document_id", "left").withColumns(
        {
            "status": F.when(ok, "done").otherwise(F.col("status")),
            "index_version": F.when(ok, F.col("_v")).otherwise(F.col("index_version")),
            "chunk_count": F.when(ok, F.col("_n")).otherwise(F.col("chunk_count")),
        }
    ).drop("accepted", "_v", "_n")
    running = F.col("status") == "processing"
    tasks = tasks.join(outcome.select("document_id", "accepted"), "document_id", "left").withColumn(
        "status",
        F.when(running & F.col("accepted"), "done")
        .when(running & ~F.col("accepted"), "cancelled")
        .otherwise(F.col("status")),
    ).drop("accepted")
    return registry, delete(chunks, judged.filter(~F.col("accepted"))), tasks


def propagate(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Carries a resync into the chunk payloads: new level and flag, or inactive."""
    change = changes.select("document_id", "action", "new_level", "new_unclassified")
    return (
        chunks.join(change, "document_id", "left")
        .withColumns(
            {
                "access_level": F.coalesce("new_level", "access_level"),
                "unclassified": F.coalesce("new_unclassified", "unclassified"),
                "is_active": F.when(F.col("action") == "deleted", F.lit(False)).otherwise(F.col("is_active")),
            }
        )
        .drop("action", "new_level", "new_unclassified")
    )


def lookup(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Content of (document_id, chunk_index) points: active rows, highest version wins.

    The store is cut to the asked keys before anything is grouped.
    """
    asked = keys.select("document_id", "chunk_index").distinct()
    return (
        chunks.filter("is_active")
        .join(asked, ["document_id", "chunk_index"], "left_semi")
        .groupBy("document_id", "chunk_index")
        .agg(F.max_by("content", F.coalesce("index_version", F.lit(-1))).alias("content"))
    )
