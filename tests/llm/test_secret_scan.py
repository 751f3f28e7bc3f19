"""Secret spans against Python's re, and the character models on known strings."""

import hashlib
import random
import re
from collections import Counter

import pytest

from gatelight.llm import secret_scan
from tests.llm.helpers import documents, hard_documents, no_documents, one_to_one

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    counts = Counter(k for _, k, _ in spans)
    joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return counts[0], counts[1], counts[2], hashlib.sha256(joined.encode()).hexdigest(), joined


def _check(spark, docs):
    got = one_to_one(secret_scan.found_secrets(docs), docs.count())
    wanted = Counter((r.doc_id, *plain(r.text)[:4]) for r in docs.collect())
    assert Counter(tuple(r)[:5] for r in got) == wanted
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if list(texts).count(r.doc_id) == 1 and r.doc_id is not None:
            own = r.spans.split(",") if r.spans else []
            base = [s for s in own if not s.startswith("markov")]
            if plain(texts[r.doc_id])[3] == r.base_sha256:
                assert ",".join(base) == plain(texts[r.doc_id])[4]
    return got


def test_base_spans(spark):
    key = "AKIA" + "Q7" * 8
    texts = [
        "password=hunter22 and PassWd : 'abcdef' API_KEY=\"zzzzzz\" apikey= short", "password=token: abcdefg", "token=abc token=abcdef", "secret==abcdef", "x" * 30 + " " + "a1" * 12 + "," + "b" * 23,
        key, key[:-1], "AKIA" + key, "😀é password=äbcdef secret: 😀abcdef " + "0" * 24, f"token={key}", "secret: " + "f" * 40, "tokentoken=abcdefg", "password\n=abcdef", "ſecret=abcdef", "toKen=abcdef",
    ]
    random.seed(9)
    parts = ["password", "=", " ", "'", "token", ":", "abcdef", "AKIA", "Z9" * 8, "deadbeef" * 3, "é", "\n", "-", "secret", "api_key"]
    texts += ["".join(random.choices(parts, k=random.randrange(25))) for _ in range(300)]
    texts += ["password=abcdef " * 3000, ("0123456789abcdef" * 2 + " ") * 500]
    _check(spark, documents(spark, list(enumerate(texts))))


def test_hard_rows(spark):
    _check(spark, hard_documents(spark))
    assert secret_scan.found_secrets(no_documents(spark)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert any(r.n_assign or r.n_access or r.n_hex for r in _check(spark, docs))


@pytest.fixture(scope="module")
def table(spark):
    return secret_scan.train(secret_scan.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")))


def test_models_tell_random_from_ordinary(spark, table):
    random.seed(3)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    randoms = ["".join(random.choices(signs, k=32)) for _ in range(50)]
    ordinary = ["theanentionerthereandtion", "antionererhereofthe", "THESTIONANDERENTTHE", "1234567890123456", "mentedesciónlas"]
    rows = list(enumerate([f"see {t} here" for t in randoms + ordinary]))
    got = secret_scan.scan(documents(spark, rows), table).select("row.doc_id", "spans").collect()
    found = {r.doc_id for r in got if any(s.kind == 3 for s in r.spans)}
    assert len(found & set(range(50))) >= 47 and not found & set(range(50, 55))


def test_training_learns_labels(spark):
    samples = [("abababababab", False), ("qzqzqzqzqzqz", True), (None, True), ("", False), ("ab", None)]
    table = secret_scan.train(spark.createDataFrame(samples, "token string, is_random boolean"))
    at = lambda a, b: table[ord(a) * 128 + ord(b)]
    assert at("a", "b") < 0 < at("q", "z") and len(table) == 129 * 128
    assert len(secret_scan.train(spark.createDataFrame([], "token string, is_random boolean"))) == 129 * 128


def test_masking(spark, table):
    rows = [(1, "a password=hunter22 b"), (2, None), (3, "clean"), (4, "é AKIA" + "Q7" * 8), (5, "token=" + "a1" * 20 + "!")]
    from pyspark.sql import functions as F

    scanned = secret_scan.scan(documents(spark, rows), table)
    got = dict(scanned.select("row.doc_id", secret_scan.masked(F.col("text"), F.col("spans"))).collect())
    assert got == {1: "a [secret] b", 2: "", 3: "clean", 4: "é [secret]", 5: "[secret]!"}


def test_plan_is_native(spark, table):
    plan = secret_scan.scan(documents(spark, [(1, "x")]), table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


CLEAN = [
    "well-known-and-well-tested", "org/apache/spark/sql/functions", "/2021/03/14/some-long-title-here", "user_profile_2024_final", "getUserById2AndLabel", "--dry-run-without-writing=false", "MAX_RETRY_COUNT_PER_HOST_2",
    "=" * 40, "-" * 300, "_" * 16, "x" * 5000, "+----------+------+---------+", "=-=-=-=-=-=-=-=-=-=-", "2024-01-31/2024-02-29", "555-0123/555-0199", "/usr/local/lib/python3/site-packages/", "state-of-the-art-2023-review",
    "kubectl-ctx-prod-eu-west-1", "com/example/myapp/MainActivity", "mp4-h264-1080p-60fps", "2021-03-14T10-22-33", "ISBN-978-3-16-148410-0", "HTTPServerRequestHandler",
]


def test_clean_tokens_have_no_span_and_secrets_do(spark, table):
    import corpus_pipeline

    random.seed(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    randoms = ["".join(random.choices(letters + signs, k=k)) for signs in ("+/", "-_") for k in (24, 40) for _ in range(25)]
    docs = documents(spark, list(enumerate([f"see {t} here" for t in CLEAN + randoms])))
    # Models of the given documents, and of these few texts alone.
    for scores in (table, secret_scan.train(secret_scan.labelled_samples(docs.filter(f"doc_id < {len(CLEAN)}")))):
        got = secret_scan.scan(docs, scores).select("row.doc_id", "text", "spans").collect()
        assert [r.text for r in got if r.doc_id < len(CLEAN) and r.spans] == []
        assert sum(any(s.kind == 3 for s in r.spans) for r in got if r.doc_id >= len(CLEAN)) >= 95
    clean = docs.filter(f"doc_id < {len(CLEAN)}")
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, clean, SF).collect()}
    assert masked == {r.doc_id: r.text for r in clean.collect()}
