"""Access levels from folder rules, and the predicates that enforce them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.session import sized

GONE = ("deleted", "purged")
MAX_LOCAL_FOLDERS = 20_000


def match_folders(df: DataFrame, folders: DataFrame, path: str = "source_path") -> DataFrame:
    """Adds folder_id, folder_level and folder_active of the deepest folder above each path.

    A path has one ancestor per depth, so each depth at which any folder lies is
    one equi-join on that ancestor. Up to MAX_LOCAL_FOLDERS folders become a local
    table whose exact size Spark knows when it plans: it broadcasts them and the
    documents are not shuffled at all. A longer list stays distributed. Equal
    folders (``/a`` and ``/a/``) count once, lowest id first.
    """
    rules = (
        folders.withColumn("rule_path", F.regexp_replace("path", "/+$", ""))
        .groupBy("rule_path")
        .agg(
            F.min("folder_id").alias("folder_id"),
            F.min_by("access_level", "folder_id").alias("level"),
            F.min_by("is_active", "folder_id").alias("active"),
        )
        .withColumn("depth", F.size(F.split("rule_path", "/")))
    )
    rules, _ = sized(rules, MAX_LOCAL_FOLDERS)
    depths = sorted(r.depth for r in rules.select("depth").distinct().collect())
    parts = F.split(F.col(path), "/")
    out, found = df, []
    for depth in depths:
        at = rules.filter(F.col("depth") == depth).select(
            F.col("rule_path").alias(f"_above{depth}"),
            F.struct("folder_id", "level", "active").alias(f"_rule{depth}"),
        )
        above = F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, 1, depth), "/"))
        out = out.withColumn(f"_above{depth}", above).join(at, f"_above{depth}", "left").drop(f"_above{depth}")
        found.insert(0, F.col(f"_rule{depth}"))
    best = F.coalesce(*found) if found else F.lit(None).cast("struct<folder_id:int,level:int,active:boolean>")
    return (
        out.withColumn("_rule", best)
        .withColumn("folder_id", F.col("_rule.folder_id"))
        .withColumn("folder_level", F.col("_rule.level"))
        .withColumn("folder_active", F.col("_rule.active"))
        .drop("_rule", *[f"_rule{d}" for d in depths])
    )


def level_at_ingest() -> Column:
    """1 without a folder, null (not indexed) under an inactive one, else the folder's level."""
    return (
        F.when(F.col("folder_id").isNull(), F.lit(1))
        .when(~F.col("folder_active"), F.lit(None))
        .otherwise(F.col("folder_level"))
        .cast("int")
    )


def unclassified() -> Column:
    return F.col("folder_id").isNull()


def classify(df: DataFrame, folders: DataFrame, path: str = "source_path") -> DataFrame:
    """Adds access_level (null: leave out of the index) and unclassified."""
    return (
        match_folders(df, folders, path)
        .withColumn("access_level", level_at_ingest())
        .withColumn("unclassified", unclassified())
        .drop("folder_id", "folder_level", "folder_active")
    )


def searchable(chunks: DataFrame) -> DataFrame:
    """The part of the retrieval prefilter that does not depend on the user."""
    return chunks.filter(F.col("is_active") & ~F.coalesce(F.col("unclassified"), F.lit(False)))


def visible_to(chunks: DataFrame, level: Column | int) -> DataFrame:
    """The whole retrieval prefilter for one user level (or a column of levels)."""
    return searchable(chunks).filter(F.col("access_level") <= level)


def may_read(user_level: Column, registry_level: Column, status: Column, unclassified: Column) -> Column:
    """The registry's word on one document; anything unknown is a no."""
    allowed = (~status.isin(*GONE)) & (registry_level <= user_level) & ~unclassified
    return F.coalesce(allowed, F.lit(False))


def revalidate(hits: DataFrame, registry: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """Keeps hits whose document the registry still grants; null and unknown ids go.

    ``few``: a stored table with the hits' document ids, which cuts the registry down
    before the join; Spark knows its size and chooses how.
    """
    if few is not None:
        registry = registry.join(few.select("document_id"), "document_id", "left_semi")
    live = registry.select(
        F.col("document_id").alias("_id"),
        F.col("access_level").alias("_level"),
        F.col("status").alias("_status"),
        F.col("unclassified").alias("_unclassified"),
    )
    granted = (F.col("document_id") == F.col("_id")) & may_read(
        F.col("user_access_level"), F.col("_level"), F.col("_status"), F.col("_unclassified")
    )
    return hits.join(live, granted, "left_semi")


def valid_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of active users whose token version is the current one; null never matches."""
    now = users.filter("is_active").select("username", F.col("token_version").alias("_now"), "access_level", "is_admin")
    return sessions.join(now, "username").filter(F.col("token_version") == F.col("_now")).drop("_now")


def backfill_admins(users: DataFrame) -> DataFrame:
    """First migration only: the highest level used to imply the admin role."""
    if "is_admin" in users.columns:
        return users
    return users.withColumn("is_admin", F.coalesce(F.col("access_level") >= 3, F.lit(False)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
