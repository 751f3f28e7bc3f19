"""Document registry and task ledger: what changed, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.operators.access import GONE, classify, match_folders

# Fixed value: the extensions that are indexed.
EXTENSIONS = (".pdf", ".docx", ".pptx", ".xlsx", ".xls", ".xlsm", ".txt", ".md")
SETTLE_SECONDS = 10
MAX_ATTEMPTS = 3


def extension(path: Column) -> Column:
    """Lower-cased ending of the file name; a leading dot alone is no ending."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def supported_files(files: DataFrame, path: str = "source_path") -> DataFrame:
    return files.withColumn("file_type", extension(F.col(path))).filter(F.col("file_type").isin(*EXTENSIONS))


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("file_hash", F.sha2(F.col(content), 256))


def settled(files: DataFrame, now: Column, seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Files nobody has written for a while; younger ones wait for the next run."""
    return files.filter(F.col("mtime") <= now - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def document_id(path: Column) -> Column:
    """Id of a path seen for the first time: the same in every attempt of a task."""
    return F.substring(F.sha2(path, 256), 1, 32)


def diff_snapshot(registry: DataFrame, scan: DataFrame, folders: DataFrame) -> DataFrame:
    """What to do per path, from the registry and the present files.

    ``insert`` new path; ``requeue`` other content, or a document that was
    deleted, purged or failed; ``delete`` live document without a file; ``skip``
    under an inactive folder; ``none`` otherwise.
    """
    old = registry.select(
        "source_path",
        F.col("document_id").alias("_id"),
        F.col("file_hash").alias("_hash"),
        F.col("status").alias("_status"),
    )
    seen = scan.select("source_path", "file_hash").withColumn("_seen", F.lit(True))
    both = classify(seen.join(old, "source_path", "full_outer"), folders)
    action = (
        F.when(
            F.col("_seen").isNull(),
            F.when(F.col("_status").isin(*GONE), "none").otherwise("delete"),
        )
        .when(F.col("access_level").isNull(), "skip")
        .when(F.col("_id").isNull(), "insert")
        .when((F.col("_hash") != F.col("file_hash")) | F.col("_status").isin(*GONE, "failed"), "requeue")
        .otherwise("none")
    )
    return both.select(
        "source_path",
        F.coalesce("_id", document_id(F.col("source_path"))).alias("document_id"),
        action.alias("action"),
        "access_level",
        "unclassified",
        F.coalesce("file_hash", "_hash").alias("file_hash"),
    )


def moves_to_events(moves: DataFrame) -> DataFrame:
    """A move is a delete of the old path and a new file at the other."""
    sides = F.array(
        F.struct(F.col("old_path").alias("source_path"), F.lit("delete").alias("kind")),
        F.struct(F.col("new_path").alias("source_path"), F.lit("upsert").alias("kind")),
    )
    return moves.select(F.inline(sides))


def apply_diff(registry: DataFrame, diff: DataFrame) -> DataFrame:
    """The registry after a diff; untouched rows stay as they are."""
    change = diff.filter(F.col("action").isin("insert", "requeue", "delete")).select(
        "source_path",
        F.col("document_id").alias("_id"),
        "action",
        F.col("access_level").alias("_level"),
        F.col("unclassified").alias("_unclassified"),
        F.col("file_hash").alias("_hash"),
    )
    fresh = F.col("action").isin("insert", "requeue")
    return registry.join(change, "source_path", "full_outer").select(
        F.coalesce("document_id", "_id").alias("document_id"),
        "source_path",
        F.when(fresh, F.col("_hash")).otherwise(F.col("file_hash")).alias("file_hash"),
        F.when(fresh, F.col("_level")).otherwise(F.col("access_level")).alias("access_level"),
        F.when(fresh, F.col("_unclassified")).otherwise(F.col("unclassified")).alias("unclassified"),
        F.when(fresh, "pending").when(F.col("action") == "delete", "deleted").otherwise(F.col("status")).alias("status"),
        F.when(fresh & F.col("document_id").isNull(), F.lit(0)).otherwise(F.col("index_version")).alias("index_version"),
    )


def new_tasks(diff: DataFrame, tasks: DataFrame) -> DataFrame:
    """Documents to queue: inserted or requeued ones without a task that still waits."""
    waiting = tasks.filter("status = 'pending'").select("document_id")
    return diff.filter(F.col("action").isin("insert", "requeue")).select("document_id").join(
        waiting, "document_id", "left_anti"
    )


def cancel_tasks(tasks: DataFrame, diff: DataFrame) -> DataFrame:
    """The ledger after deletes: their waiting tasks are cancelled."""
    gone = diff.filter("action = 'delete'").select("document_id").distinct().withColumn("_gone", F.lit(True))
    cancelled = F.col("_gone") & (F.col("status") == "pending")
    return (
        tasks.join(gone, "document_id", "left")
        .withColumn("status", F.when(cancelled, "cancelled").otherwise(F.col("status")))
        .drop("_gone")
    )


def resync(registry: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows the present folder rules change: action, new level, new flag.

    Documents already deleted or purged stay so, also when their folder returns.
    """
    live = match_folders(registry.filter(~F.col("status").isin(*GONE)), folders)
    level = F.coalesce(F.col("folder_level"), F.lit(1)).cast("int")
    loose = F.col("folder_id").isNull()
    off = F.coalesce(~F.col("folder_active"), F.lit(False))
    moved = (level != F.col("access_level")) | (loose != F.coalesce(F.col("unclassified"), F.lit(False)))
    return live.withColumn(
        "action", F.when(off, "deleted").when(F.coalesce(moved, F.lit(True)), "updated")
    ).filter(F.col("action").isNotNull()).select(
        "document_id",
        "action",
        F.when(~off, level).alias("new_level"),
        F.when(~off, loose).alias("new_unclassified"),
    )


def resync_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count_if(F.col("action") == "deleted").alias("deleted"),
        F.count_if(F.col("action") == "updated").alias("updated"),
    )


def after_failures(tasks: DataFrame, failures: DataFrame, registry: DataFrame) -> DataFrame:
    """Ledger after failed attempts: three strikes fail a task, fewer requeue it.

    A task whose document is no longer being processed is cancelled instead.
    """
    tries = failures.groupBy("task_id").agg(F.count("*").alias("_tries"))
    state = registry.select("document_id", F.col("status").alias("_document_status"))
    attempts = F.col("attempts") + F.coalesce(F.col("_tries"), F.lit(0))
    outcome = (
        F.when(F.col("_tries").isNull(), F.col("status"))
        .when(F.coalesce(F.col("_document_status") != "processing", F.lit(True)), "cancelled")
        .when(attempts >= MAX_ATTEMPTS, "failed")
        .otherwise("pending")
    )
    return (
        tasks.join(tries, "task_id", "left")
        .join(state, "document_id", "left")
        .withColumns({"status": outcome, "attempts": attempts})
        .drop("_tries", "_document_status")
    )


def recover_tasks(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """Ledger after a crash: work in progress waits again, tasks of gone documents are cancelled."""
    gone = registry.filter(F.col("status").isin(*GONE)).select("document_id").withColumn("_gone", F.lit(True))
    open_ = F.col("status").isin("pending", "processing")
    return (
        tasks.join(gone, "document_id", "left")
        .withColumn("recovered", F.col("status") == "processing")
        .withColumn(
            "status",
            F.when(open_ & F.col("_gone"), "cancelled").when(open_, "pending").otherwise(F.col("status")),
        )
        .drop("_gone")
    )


def recover_documents(registry: DataFrame) -> DataFrame:
    return registry.withColumn(
        "status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status"))
    )


def upsert_folders(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """Folder table after ``add``, ``update`` and ``disable`` requests, with what became of each.

    One request per path. add: new path inserted, inactive one re-enabled at the
    new level, active one rejected. update: active folders only. A level outside
    1..3 is rejected.
    """
    asked = changes.select("path", "kind", F.col("access_level").alias("_asked"))
    known = F.col("access_level").isNotNull()
    bad = ~F.col("_asked").isin(1, 2, 3)
    action = (
        F.when(F.col("kind").isNull(), "keep")
        .when(F.col("kind") == "disable", F.when(known, "disable").otherwise("unknown"))
        .when(F.coalesce(bad, F.lit(True)), "reject_level")
        .when((F.col("kind") == "update") & F.coalesce("is_active", F.lit(False)), "update")
        .when(F.col("kind") == "update", "unknown")
        .when(~known, "insert")
        .when(F.col("is_active"), "reject_active")
        .otherwise("enable")
    )
    return (
        folders.join(asked, "path", "full_outer")
        .withColumn("action", action)
        .select(
            "path",
            "action",
            F.when(F.col("action").isin("insert", "enable", "update"), F.col("_asked"))
            .otherwise(F.col("access_level")).cast("int").alias("access_level"),
            F.when(F.col("action").isin("insert", "enable"), True)
            .when(F.col("action") == "disable", False)
            .otherwise(F.col("is_active")).alias("is_active"),
        )
    )
