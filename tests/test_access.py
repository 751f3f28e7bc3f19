from pyspark.sql import functions as F

from gatelight.operators import access
from tests.conftest import rows

FOLDERS = "folder_id int, path string, access_level int, is_active boolean"


def folders(spark, *given):
    return spark.createDataFrame([(n, *f) for n, f in enumerate(given, 1)], FOLDERS)


def paths(spark, *given):
    return spark.createDataFrame([(p,) for p in given], "source_path string")


def test_deepest_folder_wins_at_path_borders(spark):
    rules = folders(spark, ("/w/exec", 3, True), ("/w/exec-public/", 1, True), ("/w/exec/old", 2, False), ("/w/exec//", 1, True))
    got = access.match_folders(paths(spark, "/w/exec/a.txt", "/w/exec-public/a.txt", "/w/exec/old/x/a.txt", "/w/execs/a", "/w/exec", "w/exec/a"), rules)
    found = {r.source_path: (r.folder_id, r.folder_level, r.folder_active) for r in got.collect()}
    assert found == {
        "/w/exec/a.txt": (1, 3, True), "/w/exec-public/a.txt": (2, 1, True), "/w/exec/old/x/a.txt": (3, 2, False),
        "/w/execs/a": (None, None, None), "/w/exec": (1, 3, True), "w/exec/a": (None, None, None),
    }


def test_root_folder_matches_absolute_paths(spark):
    got = access.classify(paths(spark, "/a/b", "b/c"), folders(spark, ("/", 2, True)))
    assert rows(got) == [("/a/b", 2, False), ("b/c", 1, True)]


def test_levels_at_ingest(spark):
    got = access.classify(paths(spark, "/on/a", "/off/a", "/else/a"), folders(spark, ("/on", 3, True), ("/off", 2, False)))
    assert {r.source_path: (r.access_level, r.unclassified) for r in got.collect()} == {
        "/on/a": (3, False), "/off/a": (None, False), "/else/a": (1, True),
    }


def test_no_folders(spark):
    assert rows(access.classify(paths(spark, "/a"), folders(spark, ("/b", 1, True)).limit(0))) == [("/a", 1, True)]


def test_match_does_not_shuffle_documents(spark, tmp_path):
    paths(spark, "/w/a", "/v/b").write.parquet(str(tmp_path / "docs"))
    plan = access.match_folders(spark.read.parquet(str(tmp_path / "docs")), folders(spark, ("/w", 1, True), ("/w/a/b", 2, True)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_prefilter(spark):
    chunks = spark.createDataFrame(
        [("ok", 1, True, False), ("none", 1, True, None), ("high", 3, True, False), ("off", 1, False, False), ("loose", 1, True, True)],
        "document_id string, access_level int, is_active boolean, unclassified boolean",
    )
    assert rows(access.visible_to(chunks, 2), "document_id") == [("none",), ("ok",)]


def test_revalidation_fails_closed(spark):
    registry = spark.createDataFrame(
        [("ok", 1, "done", False), ("high", 3, "done", False), ("gone", 1, "deleted", False), ("loose", 1, "done", True)],
        "document_id string, access_level int, status string, unclassified boolean",
    )
    hits = spark.createDataFrame([(d, 2) for d in ("ok", "high", "gone", "loose", "unknown", None)], "document_id string, user_access_level int")
    assert rows(access.revalidate(hits, registry), "document_id") == [("ok",)]


def test_sessions_and_backfill(spark):
    users = spark.createDataFrame([("a", 3, True, 1), ("b", 1, False, 1), ("c", 1, True, 2)], "username string, access_level int, is_active boolean, token_version int")
    users = access.backfill_admins(users)
    assert rows(users, "username", "is_admin") == [("a", True), ("b", False), ("c", False)]
    sessions = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), ("c", 1), ("x", 1)], "username string, token_version int")
    assert rows(access.valid_sessions(sessions, users), "username") == [("a",)]
