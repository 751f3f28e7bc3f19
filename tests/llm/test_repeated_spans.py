"""Repeated spans against plain counting of all windows, and the suffix sort against sorting."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight.llm import repeated_spans as rs
from gatelight.llm.suffix_groups import grouped, suffix_array
from tests.llm.helpers import documents, hard_documents, no_documents, one_to_one


def plain(rows, length=400):
    """What the operator must return, for rows (doc_id, text)."""
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(map(tuple, df.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()))


def copied_texts(seed, n, size):
    """Texts of new words, of passages that several share, with small edits, at any place."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, size))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(30)))
            if rng.random() < 0.4 and len(p) > 3:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice(["X", "", "yz"]) + p[at + 1 :]
            parts.append(p[rng.randrange(3) :])
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("length, most", [(32, 512), (64, 512), (64, 3), (400, 512)])
def test_equals_plain_counting(spark, monkeypatch, length, most):
    monkeypatch.setattr(rs, "SORTED", 3000)
    texts = copied_texts(length + most, 120, 40 if length < 400 else 250)
    rows = [*enumerate(texts), (5, texts[5]), (5, texts[6]), (None, texts[7]), (0, texts[8])]
    want = plain(rows, length)
    assert got(rs.deduped(documents(spark, rows).repartition(3), length, most)) == want
    assert any(r[2] for r in want) and any(0 < r[2] < r[1] for r in want)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    got_rows = one_to_one(rs.kept_digests(docs), docs.count())
    assert Counter(map(tuple, got_rows)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert rs.kept_digests(no_documents(spark)).count() == 0


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(rs, "SCANNED", 500)
    texts = copied_texts(9, 30, 60)
    rows = [(1, "".join(texts)), (2, "".join(texts[10:20])), (3, "ab" * 900), (4, "x" + "ab" * 20)]
    assert got(rs.deduped(documents(spark, rows), 64)) == plain(rows, 64)


def test_exactly_one_window(spark):
    core = "".join(random.Random(3).choices("abcdefghij", k=400))
    rows = [(1, "left " + core + "1"), (2, "other " + core + "2"), (3, "u" + core[1:] + "3"), (4, core[:399])]
    assert got(rs.deduped(documents(spark, rows))) == plain(rows)


def test_windows_of_contexts():
    rng = random.Random(5)
    core = bytes(rng.choices(b"abcd", k=60))
    contents = [bytes(rng.choices(b"abcd", k=5)) + core + bytes(rng.choices(b"abcd", k=9)), b"ab" + core + b"cdcdcd", core + b"a"]
    leads, windows = [25, 22, 20], [43, 37, 30]
    got_starts = rs.repeated_windows(contents, leads, windows, 32)
    for c, lead, n, starts in zip(contents, leads, windows, got_starts):
        want = [s for s in range(n) if any(c[s : s + 32] == d[s - lead + m : s - lead + m + 32] and 0 <= s - lead + m < k for d, m, k in zip(contents, leads, windows) if d is not c)]
        assert starts.tolist() == want


def test_scanning_takes_little_memory():
    data = random.Random(4).randbytes(rs.SCANNED + rs.LENGTH - 1)
    rs._powers.cache_clear()
    tracemalloc.start()
    try:
        assert len(rs.runs_of([data], rs.LENGTH)[0]) > 1000
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 100 << 20  # with two workers and a heap of 1,800 MB an executor stays well below 3,000 MB


def test_windows_counted_one_by_one_leave_as_runs(spark):
    rng = random.Random(8)
    core = rng.randbytes(200)
    rows = []
    for i in range(6):
        before = rng.randbytes(i)
        content = before + core + rng.randbytes(70)
        rows.append((7, 1, 6, 50 * i, len(content) - 63, 90 + i, i, 0, content))
    contexts = spark.createDataFrame(rows, "anchor long, copies long, contexts long, start long, windows int, lead int, doc long, version long, content binary")
    found = rs._counted_spans(contexts, 64).collect()
    places = sorted((r.doc, r.start + k) for r in found for k in range(r.windows))
    assert places == [(i, 51 * i + k) for i in range(6) for k in range(137)]
    assert len(found) <= 6 * 4  # one row for each 64 places, not one for each place


def test_removed_runs():
    rng = random.Random(6)
    for _ in range(300):
        runs = [(rng.randrange(200), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 12))]
        gone = sorted({k for s, n in runs for k in range(s, s + n + 31)})
        cuts = [i for i, k in enumerate(gone) if not i or k > gone[i - 1] + 1] + [len(gone)]
        assert rs.removed_runs(*map(np.array, zip(*runs)), 32) == [[gone[a], gone[b - 1] + 1] for a, b in zip(cuts, cuts[1:])]


def test_suffix_sort():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randrange(1, rng.choice([2, 3, 4, 9])) for _ in range(rng.randrange(40))] * rng.choice([1, 1, 2, 3]) + [0]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_array(np.array(s)).tolist() == order
        rank = {i: r for r, i in enumerate(order)}
        assert grouped(np.array(s))[1] == [max((j for j in range(i) if rank[j] < rank[i]), default=-1) for i in range(len(s))]
