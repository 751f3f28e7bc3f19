from pyspark.sql import functions as F

from gatelight.operators import registry as rg, store
from gatelight.operators.vectors import store_problems
from gatelight.sources import chunk_table, tables
from tests.conftest import rows

REG = "document_id string, source_path string, file_hash string, access_level int, unclassified boolean, status string, index_version int"
FOLDERS = "folder_id int, path string, access_level int, is_active boolean"


def reg(spark, *given):
    return spark.createDataFrame(list(given), REG)


def test_change_detection_and_what_follows(spark):
    folders = spark.createDataFrame([(1, "/w", 2, True), (2, "/off", 1, False)], FOLDERS)
    old = reg(
        spark, ("1", "/w/same", "h", 2, False, "done", 1), ("2", "/w/other", "h", 2, False, "done", 1), ("3", "/w/failed", "h", 2, False, "failed", 1),
        ("4", "/w/back", "h", 2, False, "purged", 1), ("5", "/w/gone", "h", 2, False, "done", 1), ("6", "/off/x", "h", 1, False, "done", 1),
        ("7", "/w/long-gone", "h", 2, False, "purged", 1),
    )
    scan = spark.createDataFrame([("/w/same", "h"), ("/w/other", "i"), ("/w/failed", "h"), ("/w/back", "h"), ("/off/x", "new"), ("/w/new", "h")], "source_path string, file_hash string")
    diff = rg.diff_snapshot(old, scan, folders)
    assert dict(rows(diff, "source_path", "action")) == {
        "/w/same": "none", "/w/other": "requeue", "/w/failed": "requeue", "/w/back": "requeue", "/w/gone": "delete",
        "/off/x": "skip", "/w/new": "insert", "/w/long-gone": "none",
    }
    after = rg.apply_diff(old, diff)
    state = dict(rows(after, "source_path", "status"))
    assert state["/w/new"] == "pending" and state["/w/gone"] == "deleted" and state["/off/x"] == "done" and state["/w/long-gone"] == "purged"
    tasks = spark.createDataFrame([(1, "2", "pending"), (2, "3", "processing"), (3, "5", "pending"), (4, "5", "done")], "task_id int, document_id string, status string")
    queued = {r[0] for r in rg.new_tasks(diff, tasks).collect()}
    assert "2" not in queued and {"3", "4"} <= queued and len(queued) == 3
    assert dict(rows(rg.cancel_tasks(tasks, diff), "task_id", "status")) == {1: "pending", 2: "processing", 3: "cancelled", 4: "done"}
    # A second look at the same files finds nothing left to do but what waits.
    again = rg.diff_snapshot(after, scan, folders)
    assert {a for _, a in rows(again, "source_path", "action")} <= {"none", "skip"}


def test_resync(spark):
    folders = spark.createDataFrame([(1, "/on", 3, True), (2, "/off", 2, False)], FOLDERS)
    old = reg(
        spark, ("1", "/on/a", "h", 3, False, "done", 1), ("2", "/on/b", "h", 1, True, "done", 1), ("3", "/off/a", "h", 2, False, "done", 1),
        ("4", "/x/a", "h", 1, False, "done", 1), ("5", "/on/c", "h", 1, False, "deleted", 1),
    )
    changes = rg.resync(old, folders)
    assert rows(changes) == [("2", "updated", 3, False), ("3", "deleted", None, None), ("4", "updated", 1, True)]
    assert rg.resync_counts(changes).first() == (1, 2)
    chunks = spark.createDataFrame([("2", 0, 1, True, True), ("3", 0, 2, False, True), ("1", 0, 3, False, True)], "document_id string, chunk_index int, access_level int, unclassified boolean, is_active boolean")
    assert rows(store.propagate(chunks, changes), "document_id", "access_level", "unclassified", "is_active") == [
        ("1", 3, False, True), ("2", 3, False, True), ("3", 2, False, False),
    ]


def test_retry_and_recovery(spark):
    tasks = spark.createDataFrame([(1, "a", 2, "processing"), (2, "b", 0, "processing"), (3, "c", 0, "processing"), (4, "d", 1, "pending")], "task_id int, document_id string, attempts int, status string")
    docs = spark.createDataFrame([("a", "processing"), ("b", "processing"), ("c", "pending"), ("d", "deleted")], "document_id string, status string")
    failed = spark.createDataFrame([(1,), (2,), (3,)], "task_id int")
    assert rows(rg.after_failures(tasks, failed, docs), "task_id", "attempts", "status") == [
        (1, 3, "failed"), (2, 1, "pending"), (3, 1, "cancelled"), (4, 1, "pending"),
    ]
    back = rg.recover_tasks(tasks, docs)
    assert rows(back, "task_id", "status", "recovered") == [(1, "pending", True), (2, "pending", True), (3, "pending", True), (4, "cancelled", False)]
    assert rows(rg.recover_documents(docs)) == [("a", "pending"), ("b", "pending"), ("c", "pending"), ("d", "deleted")]


def test_folder_upsert(spark):
    folders = spark.createDataFrame([(1, "/on", 1, True), (2, "/off", 1, False)], FOLDERS)
    asked = spark.createDataFrame([("/on", "add", 2), ("/off", "add", 3), ("/new", "add", 2), ("/bad", "add", 9)], "path string, kind string, access_level int")
    assert rows(rg.upsert_folders(folders, asked)) == [
        ("/bad", "reject_level", None, None), ("/new", "insert", 2, True), ("/off", "enable", 3, True), ("/on", "reject_active", 1, True),
    ]


def test_settle_and_extension(spark):
    files = spark.createDataFrame([("a.TXT", 100), ("b/.txt", 91), ("c.png", 90), ("d.tar.md", 90)], "source_path string, s bigint").withColumn("mtime", F.timestamp_seconds("s"))
    assert rows(rg.settled(files, F.timestamp_seconds(F.lit(100))), "source_path") == [("c.png",), ("d.tar.md",)]
    assert rows(rg.supported_files(files), "source_path", "file_type") == [("a.TXT", ".txt"), ("d.tar.md", ".md")]


CHUNK = "document_id string, chunk_index int, content string, index_version int, is_active boolean"


def test_generation_switch(spark):
    old = spark.createDataFrame([("a", 0, "old", 1, True), ("a", 1, "old", 1, True), ("a", 0, "residue", 2, False), ("b", 0, "b", None, True)], CHUNK)
    new = spark.createDataFrame([("a", 0, "new", 2, False)], CHUNK)
    staged = store.stage_generation(old, new)
    assert rows(staged.filter("is_active"), "document_id", "content") == [("a", "old"), ("a", "old"), ("b", "b")]
    done = store.apply_generation(old, new)
    assert rows(done, "document_id", "content", "is_active") == [("a", "new", True), ("b", "b", True)]
    assert rows(store.apply_generation(staged, new)) == rows(done)  # run again after a failure
    assert rows(store.apply_generation(done, new)) == rows(done)
    assert rows(store.current_generation(done.unionByName(old.filter("document_id = 'a'"))), "document_id", "content") == [("a", "new"), ("b", "b")]
    known = spark.createDataFrame([("a", 4), ("b", None)], "document_id string, index_version int")
    assert rows(store.next_generation(new, known), "document_id", "index_version") == [("a", 5)]


def test_superseded_result_discards_every_generation(spark):
    registry = reg(spark, ("a", "/a", "h", 1, False, "processing", 1), ("b", "/b", "changed", 1, False, "processing", 1), ("c", "/c", "h", 1, False, "pending", 1)).withColumn("chunk_count", F.lit(0))
    results = spark.createDataFrame([("a", "h", 2, 1), ("b", "h", 2, 1), ("c", "h", 2, 1)], "document_id string, file_hash string, index_version int, chunk_count int")
    chunks = spark.createDataFrame([(d, 0, "x", v, True) for d in "abc" for v in (1, 2)], CHUNK)
    tasks = spark.createDataFrame([(1, "a", "processing"), (2, "b", "processing")], "task_id int, document_id string, status string")
    after, left, ledger = store.commit_results(registry, chunks, tasks, store.judge_results(registry, results))
    assert rows(after, "document_id", "status", "index_version") == [("a", "done", 2), ("b", "processing", 1), ("c", "pending", 1)]
    assert rows(left.select("document_id").distinct()) == [("a",)]
    assert rows(ledger, "task_id", "status") == [(1, "done"), (2, "cancelled")]


def test_delete_deactivate_purge_lookup(spark):
    chunks = spark.createDataFrame([("a", 0, "a1", 1, True), ("a", 0, "a2", 2, True), ("b", 0, "b", 1, True)], CHUNK)
    docs = spark.createDataFrame([("a",)], "document_id string")
    assert rows(store.deactivate(chunks, docs).filter("is_active"), "document_id") == [("b",)]
    assert rows(store.delete(chunks, docs), "document_id") == [("b",)]
    registry = spark.createDataFrame([("a", "deleted"), ("b", "done")], "document_id string, status string")
    after, left = store.purge(registry, chunks)
    assert rows(after) == [("a", "purged"), ("b", "done")] and rows(left, "document_id") == [("b",)]
    keys = spark.createDataFrame([("a", 0), ("a", 0), ("z", 0)], "document_id string, chunk_index int")
    assert rows(store.lookup(chunks, keys)) == [("a", 0, "a2")]


def test_published_table_survives_a_failed_write(spark, tmp_path):
    base = str(tmp_path / "t")
    assert tables.read_current(spark, base) is None
    assert tables.publish(spark.range(3), base) == 1
    # A run that dies before its manifest entry leaves a folder nobody reads.
    spark.range(99).write.parquet(f"{base}/version=2")
    assert tables.read_current(spark, base).count() == 3
    assert tables.publish(spark.range(5), base) == 2
    assert tables.read_current(spark, base).count() == 5


def test_store_layout_prunes(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("a", 0, "x", "/a", 1, True, 1, False, [0.1], [(1, 1.0)]), ("b", 0, "x", "/b", 3, True, 1, False, [0.1], [(1, 1.0)])],
        "document_id string, chunk_index int, content string, source_file string, access_level int, is_active boolean, index_version int, "
        "unclassified boolean, dense array<float>, sparse array<struct<i:int,v:double>>",
    )
    assert store_problems(chunks, dims=1) == []
    assert store_problems(chunks, dims=2) and store_problems(chunks.drop("sparse")) == ["missing column sparse"]
    base = str(tmp_path / "s")
    tables.publish_store(chunks, base)
    read = tables.read_current(spark, base).filter("access_level <= 2 and is_active")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(access_level" in plan
    assert rows(read, "document_id") == [("a",)]


def test_chunk_table_reads_and_writes_only_touched_buckets(spark, tmp_path):
    base = str(tmp_path / "chunks")
    whole = spark.range(300).select(
        F.concat(F.lit("d"), (F.col("id") % 100).cast("string")).alias("document_id"), (F.col("id") % 3).cast("int").alias("chunk_index"), F.lit(1).alias("index_version"),
        F.lit(2).alias("access_level"), F.lit(False).alias("unclassified"), F.lit(True).alias("is_active"), F.concat(F.lit("c"), "id").alias("content"))
    schema = whole.schema
    assert chunk_table.publish(whole, base) == 1
    assert rows(chunk_table.read(spark, base, schema)) == rows(whole)
    some = spark.createDataFrame([("d1",), ("d2",), ("never",)], "document_id string")
    buckets = chunk_table.buckets_of(some)
    assert chunk_table.deactivate(spark, base, schema, some) == len(buckets) <= 3
    changed = spark.read.parquet(f"{base}/version=2")
    assert sorted(r.bucket for r in changed.select("bucket").distinct().collect()) == sorted(set(buckets) & set(chunk_table.buckets_of(whole)))
    assert rows(chunk_table.read(spark, base, schema)) == rows(store.deactivate(whole, some))
    keys = spark.createDataFrame([("d1", 1), ("d7", 1), ("d7", 9)], "document_id string, chunk_index int")
    assert rows(chunk_table.lookup(spark, base, schema, keys)) == rows(store.lookup(store.deactivate(whole, some), keys))
    read = {f.split("bucket=")[1].split("/")[0] for (f,) in chunk_table.read(spark, base, schema, [buckets[0]]).select(F.input_file_name()).distinct().collect()}
    assert read == {str(buckets[0])}
    chunk_table.delete(spark, base, schema, spark.createDataFrame([("d2",)], "document_id string"))
    fresh = spark.createDataFrame([("d1", 0, 2, 1, False, True, "new"), ("d100", 0, 1, 1, False, True, "first")], schema)
    chunk_table.apply_generation(spark, base, fresh)
    got = {(r.document_id, r.chunk_index): r.content for r in chunk_table.read(spark, base, schema).filter("document_id in ('d1', 'd2', 'd100')").collect()}
    assert got == {("d1", 0): "new", ("d100", 0): "first"} and chunk_table.read(spark, base, schema).count() == 300 - 6 + 2
    nothing = spark.createDataFrame([], "document_id string")
    assert chunk_table.delete(spark, base, schema, nothing) == 0 and chunk_table.read(spark, str(tmp_path / "none"), schema).count() == 0
