import json
import os

import pytest
from pyspark.sql import functions as F

from gatelight import session
from gatelight.operators import cells, history
from gatelight.sources import files, tables
from tests.conftest import rows


def test_scrub_keeps_what_it_must(spark):
    given = [
        '[{"id": 1, "content": "x", "score": 0.5, "source_file": "/a/b.txt", "document_id": null, "chunk_index": 3}, {"id": 2, "extra": {"a": [1]}}, 5]',
        '[{"content": "x", "document_id": "d"}]', '[{"id": 1}]', "no json", '{"content": 1}', None,
    ]
    df = spark.createDataFrame([(n, g) for n, g in enumerate(given)], "n int, s string")
    got = {r.n: r.s for r in df.select("n", history.scrub_sources(F.col("s")).alias("s")).collect()}
    assert json.loads(got[0]) == [{"id": 1, "score": 0.5, "chunk_index": 3, "source_file": "b.txt"}, {"id": 2, "extra": {"a": [1]}}, 5]
    assert json.loads(got[1]) == [{"id": None, "score": None, "document_id": "d"}]
    assert [got[n] for n in (2, 3, 4, 5)] == given[2:]
    again = spark.createDataFrame([(got[0],)], "s string").select(history.scrub_sources(F.col("s"))).first()[0]
    assert again == got[0]


def test_history_rechecks_permissions(spark):
    registry = spark.createDataFrame([("ok", 1, "done", False), ("high", 3, "done", False), ("gone", 1, "purged", False)], "document_id string, access_level int, status string, unclassified boolean")
    chunks = spark.createDataFrame([("ok", 0, "text", 1, True), ("ok", 1, "off", 1, False), ("high", 0, "secret", 1, True)], "document_id string, chunk_index int, content string, index_version int, is_active boolean")
    items = [{"id": n, "document_id": d, "chunk_index": c, "source_file": "/w/f.txt", "score": 0.5} for n, (d, c) in enumerate([("ok", 0), ("ok", 1), ("high", 0), ("gone", 0), ("unknown", 0)], 1)]
    items.append({"id": 6, "source_file": "/w/old.txt", "score": 0.1, "content": "copied"})
    messages = spark.createDataFrame([(1, 2, json.dumps(items)), (2, 2, "broken"), (3, 2, "[]")], "message_id int, user_access_level int, sources string")
    resolved = history.resolve_sources(messages, registry, chunks)
    assert rows(resolved, "id", "state", "source_file", "content") == [
        (1, "open", "f.txt", "text"), (2, "open", "f.txt", history.CONTENT_GONE), (3, "redacted", None, None),
        (4, "redacted", None, None), (5, "redacted", None, None), (6, "legacy", "old.txt", None),
    ]
    back = {r.message_id: r.resolved_sources for r in history.history(messages, resolved).collect()}
    assert [s.id for s in back[1]] == [1, 2, 3, 4, 5, 6] and back[2] is None and back[3] is None


def test_titles(spark):
    df = spark.createDataFrame([(" 　" + "あ" * 40,), ("  ",), (None,)], "q string")
    assert [r[0] for r in df.select(history.title(F.col("q"))).collect()] == ["あ" * 30, history.DEFAULT_TITLE, history.DEFAULT_TITLE]


def test_pages(spark):
    logs = spark.createDataFrame([(n, "[]" if n % 2 else "broken", "secret") for n in range(10)], "id int, retrieved_chunks string, answer string")
    page = history.audit_page(logs, 3, 2)
    assert [r.id for r in page.collect()] == [7, 6, 5] and "answer" not in page.columns
    assert all(r.retrieved_chunks == [] for r in page.collect())
    with pytest.raises(ValueError):
        history.audit_page(logs, 501)
    events = spark.createDataFrame([(1, '{"k": 5, "p": "/a"}'), (2, ""), (3, None), (4, "x{")], "id int, detail string")
    assert [r.detail for r in history.event_page(events).collect()] == [{}, {}, {}, {"k": "5", "p": "/a"}]
    shown = events.select("id", history.detail_summary(F.when(F.col("id") < 4, history.read_detail(F.col("detail")))).alias("s"))
    assert rows(shown) == [(1, "k=5, p=/a"), (2, ""), (3, ""), (4, "-")]


def test_only_owners_delete(spark):
    conversations = spark.createDataFrame([(1, 7, 5), (2, 8, 9)], "conversation_id int, user_id int, updated_at int")
    messages = spark.createDataFrame([(1, 1), (2, 2)], "message_id int, conversation_id int")
    asked = spark.createDataFrame([(1, 7), (2, 7)], "conversation_id int, user_id int")
    left, kept = history.delete_conversations(conversations, messages, asked)
    assert rows(left, "conversation_id") == [(2,)] and rows(kept, "message_id") == [(2,)]
    assert [r.conversation_id for r in history.conversation_list(conversations).collect()] == [1, 2]


def test_turns_and_audit(spark):
    hits = spark.createDataFrame([("q", 2, "b", 0, "/w/b.txt", 0.1, 1), ("q", 1, "a", 3, "/w/a.txt", 0.2, 1)], "question_id string, rank int, document_id string, chunk_index int, source_file string, score double, access_level int")
    kept = history.source_items(hits).first().sources
    assert json.loads(kept) == [{"id": 1, "document_id": "a", "chunk_index": 3, "source_file": "a.txt", "score": 0.2}, {"id": 2, "document_id": "b", "chunk_index": 0, "source_file": "b.txt", "score": 0.1}]
    turns = spark.createDataFrame([(1, 1, 5, "why", "so", kept)], "conversation_id int, turn int, created_at int, question string, answer string, sources string")
    assert rows(history.turn_messages(turns), "role", "content", "sources") == [("assistant", "so", kept), ("user", "why", "[]")]
    asked = spark.createDataFrame([("q", 1, "u", "why", "so!", None), ("r", 1, "u", "what", None, "boom")], "question_id string, user_id int, username string, question string, answer string, error string")
    got = {r.question_id: r for r in history.audit_rows(asked, hits).collect()}
    assert [c["source_file"] for c in json.loads(got["q"].retrieved_chunks)] == ["a.txt", "b.txt"] and got["q"].answer_chars == 3
    assert (got["r"].retrieved_chunks, got["r"].answer_chars, got["r"].error) == ("[]", 0, "boom") and "answer" not in got["r"].asDict()


def test_migrations(spark):
    old = spark.createDataFrame([(1, "secret")], "id int, answer string")
    new = history.scrub_answers(old)
    assert new.first() == (1, None, None)
    marked = spark.createDataFrame([(1, "kept", 4)], "id int, answer string, answer_chars int")
    assert history.scrub_answers(marked).first() == (1, "kept", 4)
    assert history.add_columns(old, {"answer": ("string", "x"), "n": ("int", 0)}).first() == (1, "secret", 0)


def test_merged_cells_and_text(spark):
    grid = [["name", "days"], ["leave", "5"], [None, "7"]]
    table = spark.createDataFrame([("d", "S", r, c, v) for r, line in enumerate(grid, 1) for c, v in enumerate(line, 1)], "document_id string, sheet string, row int, col int, value string")
    ranges = spark.createDataFrame([("d", "S", 2, 3, 1, 1)], "document_id string, sheet string, min_row int, max_row int, min_col int, max_col int")
    filled = cells.fill_merged(table, ranges)
    assert rows(filled.filter("row = 3"), "col", "value") == [(1, "leave"), (2, "7")]
    assert cells.sheets_to_text(filled).first().content == "## シート: S\n| name | days |\n|---|---|\n| leave | 5 |\n| leave | 7 |"
    tall = spark.createDataFrame([("d", "S", r, 1, "top" if r == 1 else None) for r in range(1, 3001)], table.schema)
    wide = spark.createDataFrame([("d", "S", 1, 2500, 1, 1)], ranges.schema)
    assert cells.fill_merged(tall, wide).filter("value = 'top'").count() == 2500


def test_corpus_scan_and_decoding(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    texts = {"a.txt": "一行\r\n二行", "sub/b.MD": "ascii", "c.png": "no", "sub/d.txt": "規程"}
    encodings = {"sub/d.txt": "cp932"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode(encodings.get(name, "utf-8")))
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe" + "規程".encode("utf-16-le"))
    (tmp_path / "f.txt").write_bytes(b"\x81\xff\xff\r\nx")
    found = files.scan_corpus(spark, str(tmp_path))
    got = {r.source_path.rsplit("/", 1)[1]: r.content for r in files.decode_text(found).collect()}
    assert set(got) == {"a.txt", "b.MD", "d.txt", "e.txt", "f.txt"}
    assert got["a.txt"] == "一行\n二行" and got["d.txt"] == "規程"
    for name in ("e.txt", "f.txt"):
        data = (tmp_path / name).read_bytes()
        for enc in ("utf-8", "cp932", "utf-16"):
            try:
                want = data.decode(enc).replace("\r\n", "\n").replace("\r", "\n")
                break
            except UnicodeDecodeError:
                want = data.decode("utf-8", errors="replace")
        assert got[name] == want
    paths = [r.source_path for r in found.collect()]
    assert all(p.startswith(str(tmp_path)) for p in paths)


def test_pages_by_key_follow_each_other(spark):
    logs = spark.createDataFrame([(n, "q", "[]") for n in range(1, 8)], "id long, question string, retrieved_chunks string")
    first = [r.id for r in history.audit_page(logs, 3).collect()]
    second = [r.id for r in history.audit_page(logs, 3, before=first[-1]).collect()]
    assert (first, second) == ([7, 6, 5], [4, 3, 2])


def test_saved_tables_can_be_discarded(spark):
    table = session.saved(spark.range(5))
    assert table.count() == 5 and os.path.isdir(table.saved_at.removeprefix("file://"))
    session.discard(table)
    assert not os.path.exists(table.saved_at.removeprefix("file://"))


def test_an_unreadable_table_is_no_empty_table(spark, tmp_path):
    assert tables.versions(spark, str(tmp_path / "none")) == []
    (tmp_path / "log").mkdir()
    spark.range(3).write.parquet(str(tmp_path / "log" / "batch=1"))
    with pytest.raises(Exception):
        tables.read_log(spark, str(tmp_path / "log"), "id array<string>").collect()


def test_json_lines_answers_and_rules(spark, tmp_path):
    (tmp_path / "run1.jsonl").write_text('{"id": "1", "text": "a"}\n\n{"qid": "2", "answer": "b", "run": "other"}\n{"id": "3"}\nnot json\n[1]\n{"id": "4", "text": "c"} tail\n', encoding="utf-8")
    (tmp_path / "run2.jsonl").write_text('{"id": "1", "text": "a"}\n{"id": "1", "text": "b"}\n', encoding="utf-8")
    good, errors = files.load_answers(spark, str(tmp_path))
    assert rows(good) == [("other", "2", "b"), ("run1", "1", "a")]
    assert rows(errors, "stem", "problem") == sorted([("run1", "field missing"), ("run1", "no JSON object"), ("run1", "no JSON object"), ("run1", "no JSON object"), ("run2", "qid repeated")], key=repr)
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "leave.md").write_text("# 休暇\n5 日", encoding="utf-8")
    assert rows(files.read_rules(spark, str(tmp_path / "rules")), "rule_id", "body") == [("leave", "# 休暇\n5 日")]
    question = {"id": "Q001", "question": "?", "expected_answer_keywords": ["5"], "expected_sources": [], "user_access_level": 1, "category": "general", "should_refuse": False}
    (tmp_path / "q.json").write_text(json.dumps(question) + "\n\n", encoding="utf-8")
    assert files.read_questions(spark, str(tmp_path / "q.json"))[0].first().expected_answer_keywords == ["5"]
    (tmp_path / "bad.json").write_text(json.dumps(question) + "\n\n{broken\n", encoding="utf-8")
    asked, wrong = files.read_questions(spark, str(tmp_path / "bad.json"))
    assert asked.count() == 1 and rows(wrong, "number", "line") == [(3, "{broken")]
    tables.write_results(good, str(tmp_path / "out"), by="run")
    assert rows(spark.read.json(str(tmp_path / "out")), "run", "qid") == [("other", "2"), ("run1", "1")]


def test_old_sources_are_scrubbed_once(spark, tmp_path):
    base = str(tmp_path / "messages")
    assert not history.strip_legacy_sources(spark, base)
    old = '[{"id": 1, "score": 0.5, "source_file": "/a/b.txt", "content": "copied"}]'
    tables.publish(spark.createDataFrame([(1, old), (2, "[]")], "id int, sources string"), base)
    assert history.strip_legacy_sources(spark, base)
    got = {r.id: r.sources for r in tables.read_current(spark, base).collect()}
    assert "content" not in got[1] and "b.txt" in got[1] and got[2] == "[]"
    assert tables.migrations(spark, base) == [history.STRIP_LEGACY_SOURCES]

    def never(rows):
        raise AssertionError("read again")

    assert not tables.migrate(spark, base, history.STRIP_LEGACY_SOURCES, never) and tables.versions(spark, base) == [1, 2]
    tables.publish(tables.read_current(spark, base).withColumn("x", F.lit(1)), base)  # later versions keep the ledger
    assert not history.strip_legacy_sources(spark, base) and tables.versions(spark, base) == [1, 2, 3]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, step in (("a", 1), ("b", 3)):
        lines = [f'{{"qid": "{name}{n}"}}' if n % 7 else ("" if n % 2 else f"bad {n} äöü") for n in range(1, 400, step)]
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\r\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    try:
        good, errors = files.read_jsonl(spark, str(tmp_path), "qid string")
        assert good.rdd.getNumPartitions() > 4
        found = {(r.file[-6], r.line): r.number for r in errors.collect()}
        assert found == {(name, f"bad {n} äöü"): at for name, step in (("a", 1), ("b", 3)) for at, n in enumerate(range(1, 400, step), 1) if n % 14 == 0}
        assert good.count() == sum(n % 7 != 0 for step in (1, 3) for n in range(1, 400, step))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
