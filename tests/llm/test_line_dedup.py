"""Line dedup against a plain loop, and its arrays under hash collisions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatelight.llm import line_dedup
from tests.llm.helpers import documents, hard_documents, no_documents, one_to_one


def plain(rows):
    """What the operator must return, for rows (doc_id, text)."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and doc_id is not None:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    got = one_to_one(line_dedup.kept_lines(docs), docs.count())
    assert Counter(map(tuple, got)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.kept_lines(no_documents(spark)).count() == 0


def test_shared_lines(spark):
    random.seed(6)
    lines = ["Common license line here", " common LICENSE line here\t", "short", "", "ÄÖÜ äöü line", "äöü äöü line", "a very rare line", "exactly10c", "only nine", "x" * 5000]
    rows = [(i, "\n".join(random.choices(lines, k=random.randrange(8)) + [f"own line of {i % 40}"])) for i in range(300)]
    rows += [(5, "Common license line here\nnew text of five"), (None, "Common license line here"), (None, None)]
    docs = documents(spark, rows)
    assert Counter(map(tuple, line_dedup.kept_lines(docs).collect())) == plain(rows)
    whole = line_dedup.dedupe(docs, lines_per_shard=3).select("row.*")
    assert whole.columns == docs.columns and whole.count() == len(rows)
    assert Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in whole.select("doc_id", "text").collect()) == Counter((k[0], k[3]) for k in plain(rows).elements())


def test_colliding_first_hashes(spark):
    repeated = spark.createDataFrame([(1, 10, 2, 5), (1, 11, 3, 6), (2, 10, 2, 7)], "h1 long, h2 long, n long, first long")
    (row,) = line_dedup.build_index(repeated, 1).collect()
    arrays = line_dedup._Arrays(*map(bytes, row[1:]))
    known, first = arrays.first(np.array([1, 1, 2, 1, 9], np.uint64), np.array([10, 11, 10, 12, 99], np.uint64))
    assert known.tolist() == [True, True, True, False, False] and first[:3].tolist() == [5, 6, 7]
    assert pa.array([int(arrays.counts.sum())])[0].as_py() == 7


def test_equal_ids_and_probes_do_not_shuffle_lines(spark):
    docs = documents(spark, [(1, "a line of text\nmore of the text"), (2, "a line of text")])
    plan = line_dedup.dedupe(docs).select(F.col("row.doc_id"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
