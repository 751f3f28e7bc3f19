import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from gatelight.operators.chunking import split_text
from gatelight.sources import tables
from gatelight.streaming import ingest, latency, lockout
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, folder, schema, *batches):
    """Writes each batch as one file, in order, and returns the stream that reads one file per trigger."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/part={n}")
        import os, glob, time
        for f in glob.glob(f"{folder}/part={n}/*.parquet"):
            os.utime(f, (time.time() - 1000 + n, time.time() - 1000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def drain(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture()
def folders(spark):
    return spark.createDataFrame([(1, "/w", 2, True), (2, "/w/off", 1, False)], "folder_id int, path string, access_level int, is_active boolean")


def event(n, kind, path, content=None, old=None):
    return (n, at(n), kind, path, old, content)


def test_ingest_stream(spark, tmp_path, folders):
    long = "あ。" * 600
    batches = [
        [event(1, "created", "/w/a.txt", "first"), event(2, "modified", "/w/a.txt", long), event(3, "created", "/w/b.md", "bee"), event(4, "created", "/w/off/c.txt", "no"), event(5, "created", "/w/d.png", "no"), event(6, "created", "/x/e.txt", "loose")],
        [event(7, "modified", "/w/a.txt", long), event(8, "deleted", "/w/b.md"), event(9, "moved", "/w/f.txt", "loose", "/x/e.txt")],
        [event(10, "modified", "/w/a.txt", "B"), event(11, "created", "/w/b.md", "bee"), event(12, "deleted", "/w/never.txt")],
        [event(13, "modified", "/w/a.txt", long)],
    ]
    stream = feed(spark, str(tmp_path / "in"), ingest.EVENT_SCHEMA, *batches)
    base = str(tmp_path / "base")
    ingest.start_ingest(stream, base, folders, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    registry, chunks = ingest.current_state(spark, base)
    state = {r.source_path: (r.status, r.index_version, r.chunk_count, r.access_level, r.unclassified) for r in registry.collect()}
    n = len(split_text(long))
    assert state == {
        "/w/a.txt": ("done", 3, n, 2, False), "/w/b.md": ("done", 2, 1, 2, False),
        "/x/e.txt": ("deleted", 1, 0, 1, True), "/w/f.txt": ("done", 1, 1, 2, False),
    }
    assert rows(chunks.groupBy("source_file").count()) == [("/w/a.txt", n), ("/w/b.md", 1), ("/w/f.txt", 1)]
    # The same batch once more changes nothing (a retry after a lost driver).
    before = rows(registry)
    ingest.apply_batch(spark.createDataFrame(batches[3], ingest.EVENT_SCHEMA), 3, base, folders)
    assert rows(ingest.current_state(spark, base)[0]) == before
    # A batch that died before its registry rows: its chunks match nothing.
    registry, chunks = ingest.current_state(spark, base)
    seen = rows(chunks.groupBy("source_file").count())
    stray = chunks.drop("is_active").withColumn("index_version", F.lit(99))
    tables.append_batch(stray, f"{base}/chunks", 9, "document_id")
    assert rows(ingest.current_state(spark, base)[1].groupBy("source_file").count()) == seen


def test_compaction_beside_readers_and_retries(spark, tmp_path, folders):
    base = str(tmp_path / "base")

    def write(batch, *events):
        ingest.apply_batch(spark.createDataFrame(list(events), ingest.EVENT_SCHEMA), batch, base, folders)

    def state():
        registry, chunks = ingest.current_state(spark, base)
        return rows(registry, "source_path", "file_hash", "status", "index_version"), rows(chunks, "source_file", "content", "index_version")

    for batch in range(4):
        write(batch, *[event(10 * batch + n, "modified", f"/w/f{n}.txt", f"text {batch} of {n}") for n in range(6) if (n + batch) % 3])
    want = state()
    begun = ingest.current_state(spark, base)  # a reader that has looked up its files and reads later
    assert ingest.compact(spark, base) and state() == want and not ingest.compact(spark, base)
    assert (rows(begun[0], "source_path", "file_hash", "status", "index_version"), rows(begun[1], "source_file", "content", "index_version")) == want
    # The newest batch once more, as after a lost driver: it must not meet its own rows.
    write(3, *[event(30 + n, "modified", f"/w/f{n}.txt", f"text 3 of {n}") for n in range(6) if n % 3])
    assert state() == want
    for batch in (4, 5):
        write(batch, event(10 * batch, "deleted", "/w/f1.txt") if batch == 4 else event(50, "created", "/w/f1.txt", "back"))
    want = state()
    assert ingest.compact(spark, base) and state() == want
    assert tables.batches(spark, f"{base}/registry") == [3, 4, 5] and [u for _, u in tables.compactions(spark, f"{base}/registry")] == [2, 4]
    write(6, event(60, "modified", "/w/f1.txt", "again"))
    assert ("/w/f1.txt", "again", 5) in state()[1]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    base = str(tmp_path / "log")
    for batch in range(3):
        tables.append_batch(spark.range(400).select(F.concat(F.lit("p"), "id").alias("path")), base, batch, "path")
    (bucket,) = spark.range(1).select(tables.bucket_of(F.lit("p7"))).first()
    log = tables.read_log(spark, base, "path string", before=2, buckets=[bucket])
    (filters,) = re.findall(r"PartitionFilters: \[([^\]]*)\]", log._jdf.queryExecution().executedPlan().toString())
    assert f"= {bucket}" in filters and "batch" in filters  # folders of other buckets and batches are not opened
    assert {f.split("bucket=")[1].split("/")[0] for (f,) in log.select(F.input_file_name()).distinct().collect()} == {str(bucket)}
    assert log.filter("path = 'p7'").count() == 2


def test_settle_stream_equals_batch(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, kind string, source_path string"
    batches = [
        [(1, at(0), "created", "a"), (2, at(4), "modified", "a"), (3, at(1), "created", "b")],
        [(4, at(13), "deleted", "a"), (5, at(40), "created", "a")],
        [(6, at(400), "created", "z")],
        [(7, at(800), "created", "z")],
    ]
    stream = drain(ingest.settle(feed(spark, str(tmp_path / "in"), schema, *batches)), tmp_path, "settled")
    table = ingest.settle(spark.createDataFrame([e for b in batches for e in b], schema))
    names = ("source_path", "event_id", "kind", "changes")
    got = rows(stream, *names)
    assert got == rows(table.filter(F.col("event_id") != 7), *names)  # the last burst may still grow
    assert got[:3] == [("a", 4, "deleted", 3), ("a", 5, "created", 1), ("b", 3, "created", 1)]


def login(n, seconds, failed, user="u"):
    return (user, n, at(seconds), failed)


LOGIN = "username string, event_id bigint, ts timestamp, failed boolean"
LOGINS = [login(n, n, True) for n in range(1, 6)] + [
    login(6, 10, False), login(7, 20, True), login(8, 64, True), login(9, 66, True), login(10, 67, False), login(11, 68, True), login(1, 5, True, "v"), login(2, 6, False, "v"),
]
WANT = {6: "locked", 7: "locked", 8: "locked", 9: "failed", 10: "ok", 11: "failed"}


def test_lockout_batch(spark):
    got = lockout.lockout(spark.createDataFrame(LOGINS, LOGIN))
    found = {(r.username, r.event_id): r.outcome for r in got.collect()}
    assert {n: found["u", n] for n in WANT} == WANT
    assert found["v", 1] == "failed" and found["v", 2] == "ok" and len(found) == 13


def test_lockout_keeps_no_group_in_memory(spark):
    many = spark.range(30_000).select(F.lit("hot").alias("username"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 61).alias("ts"), F.lit(True).alias("failed"))
    assert rows(lockout.lockout(many).groupBy("outcome").count()) == [("failed", 30_000)]


def test_lockout_stream_equals_batch_in_any_order_of_arrival(spark, tmp_path):
    later = [("w", 99, at(100_000), True)]  # moves the watermark past all others
    for name, order in (("given", LOGINS), ("mixed", LOGINS[1::2] + LOGINS[::2])):
        stream = feed(spark, str(tmp_path / name), LOGIN, order[:4], order[4:8], order[8:], later)
        got = drain(lockout.lockout_stream(stream, "1 hour"), tmp_path, f"lockout_{name}")
        assert rows(got) == rows(lockout.lockout(spark.createDataFrame(LOGINS, LOGIN)))


def test_lockout_state_shrinks(spark, tmp_path):
    users = [(f"u{n}", n, at(n % 50), True) for n in range(40)] + [(f"u{n}", 100 + n, at(300), False) for n in range(30)]
    locked = [("locked", 200 + n, at(310 + n), True) for n in range(5)]
    stream = feed(spark, str(tmp_path / "in"), LOGIN, users, locked, [("w", 500, at(2_000), True)], [("w", 501, at(9_000), False)])
    drain(lockout.lockout_stream(stream, "10 seconds"), tmp_path, "shrinks")
    left = spark.read.format("statestore").option("stateVarName", "count").load(str(tmp_path / "ck-shrinks"))
    # Ten users have failed once and not come back; the lock has run out, all successes are forgotten.
    assert rows(left.select(F.col("key.username").alias("u"))) == sorted((f"u{n}",) for n in range(30, 40)) + [("w",)]


def test_latency_stream_equals_batch(spark, tmp_path):
    schema = "answer_id string, ts timestamp, kind string"
    batches = [
        [("a", at(0), "request"), ("b", at(1), "request")], [("a", at(2), "token"), ("a", at(5), "token"), ("b", at(4), "done")],
        [("a", at(6), "done")], [("z", at(4000), "request")], [("z", at(9000), "done")],
    ]
    got = drain(latency.answer_latency(feed(spark, str(tmp_path / "in"), schema, *batches)), tmp_path, "latency")
    table = latency.answer_latency(spark.createDataFrame([e for b in batches[:3] for e in b], schema))
    assert rows(got) == rows(table) == [("a", 2.0, 6.0), ("b", 3.0, 3.0)]
