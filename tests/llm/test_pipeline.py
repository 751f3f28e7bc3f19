"""The pipeline stage by stage against plain versions."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gatelight.llm import quality
from tests.llm.helpers import documents, hard_documents, no_documents
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_dup import plain as plain_groups
from tests.llm.test_secret_scan import plain as plain_secrets

SF = "/root/testdata/sf0.001"


def _sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def _stages(spark, docs):
    """What every stage returns, on the rows of the one before."""
    out = [docs]
    for _, stage in pipeline.STAGES:
        rows = stage(spark, out[-1], SF)
        out.append(spark.createDataFrame(rows.collect(), rows.schema))
    return out


def test_stages_equal_plain_versions(spark):
    docs, good, lines, alone, masked, packed = _stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    network = quality.Network.from_bytes(quality.train(docs, labels))
    rows = docs.collect()
    chunks = [quality.chunks_of((r.text or "").encode()) for r in rows]
    scores = quality._scores(network, chunks)
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r, s in zip(rows, scores) if s >= 0.3)
    assert 0 < good.count() < docs.count()

    want = plain_lines([(r.doc_id, r.text) for r in good.collect()])
    assert Counter((r.doc_id, _sha(r.text)) for r in lines.collect()) == Counter((k[0], k[3]) for k in want.elements())

    want = plain_groups([(r.doc_id, r.text) for r in lines.collect()])
    assert Counter(r.doc_id for r in alone.collect()) == Counter(k[0] for k in want.elements() if k[3])

    before = {r.doc_id: r.text for r in alone.collect()}
    for r in masked.collect():
        # Every base span is gone; texts without spans are as they were.
        assert not any(plain_secrets(r.text)[:3])
        assert r.text == before[r.doc_id] or "[secret]" in r.text
        assert r.n_chars == len(r.text)
    for stage in (good, lines, alone, masked):
        assert tuple(stage.columns) == pipeline.COLUMNS

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in masked.collect()}
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.length
    assert dict(pieces) == lengths


def test_run_equals_its_stages(spark):
    got = pipeline.run(spark, SF)
    last = _stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1]
    total = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    by_doc = lambda df: df.groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, by_doc(got))) == sorted(map(tuple, by_doc(last))) and total(got)


def test_hard_rows_go_through(spark):
    for docs in (hard_documents(spark), no_documents(spark), documents(spark, [(None, None), (1, None), (1, "x")])):
        for (name, stage), result in zip(pipeline.STAGES, _stages(spark, docs)[1:]):
            assert name == "packing" or tuple(result.columns) == pipeline.COLUMNS
    one = documents(spark, [(1, "some words that are kept as they are")])
    assert np.all([r.text == "some words that are kept as they are" for r in pipeline.mask_secrets(spark, one, SF).collect()])
