"""Word ids, packing and the token store against the library and plain loops."""

import random
import struct
import unicodedata
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gatelight.llm import packing, token_store
from gatelight.llm.perfect_hash import PerfectHash
from gatelight.llm.word_ids import WordIds
from tests.llm.helpers import HARD_TEXTS, documents, hard_documents, no_documents, one_to_one

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def _crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_word_ids_equal_the_library(library):
    own = WordIds(FILE)
    random.seed(2)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Cf")]
    signs = list("abAB'sŞİΣς019.,!-漢é́̈ßﬁ½") + ["'re ", " don't", "<|endoftext|>", " "]
    for _ in range(1500):
        text = "".join(random.choices(signs + blanks, weights=[5] * len(signs) + [1] * len(blanks), k=random.randrange(50)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_perfect_hash_is_minimal_and_travels():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        made = PerfectHash.from_bytes(PerfectHash.over(keys).to_bytes())
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        strangers = made.slots(rng.integers(0, 2**63, 500, dtype=np.uint64))
        assert ((strangers >= -1) & (strangers < max(1, len(keys)))).all()
    with pytest.raises(ValueError):
        PerfectHash.over(np.array([5, 5], np.uint64))


def test_differencing_balances():
    # Five numbers over two windows: differencing is known to leave 16 and 14.
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 900, 3000)
    sums = np.bincount(packing.differencing(sizes, 100), sizes, 100)
    assert sums.sum() == sizes.sum() and np.ptp(sums) <= 3


def test_window_count_rises_over_capacity():
    window, windows = packing.fitted(np.array([6, 6, 6]), 10)
    assert windows == 3 and sorted(window) == [0, 1, 2]
    assert packing.fitted(np.array([], np.int64), 10)[1] == 0


def _check_pieces(rows, docs, library, capacity=4096):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    wanted = sorted((d.doc_id is None, d.doc_id or 0, len(i), _crc(i[s : s + 1])) for d in docs for i in [_ids(library, d.text)] for s in [0])
    assert sum(r.length for r in rows) == sum(w[2] for w in wanted)
    return by_sequence


def test_packing_hard_rows(spark, library):
    docs = hard_documents(spark)
    rows = packing.packed_pieces(docs, FILE).collect()
    listed = docs.collect()
    _check_pieces(rows, listed, library)
    by_id = defaultdict(list)
    for d in listed:
        by_id[d.doc_id].append(_ids(library, d.text))
    for doc_id, texts in by_id.items():
        if len(texts) == 1:
            pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
            at = 0
            for r in pieces:
                assert r.start == at and r.doc_tokens == len(texts[0])
                assert r.ids_crc32 == _crc(texts[0][at : at + r.length])
                at += r.length
            assert at == len(texts[0])
    assert packing.packed_pieces(no_documents(spark), FILE).count() == 0


def test_packing_wastes_little(spark, library):
    random.seed(8)
    docs = documents(spark, [(i, " ".join(random.choices(["red", "blue", "x"], k=random.randrange(1, 400)))) for i in range(1500)])
    rows = packing.pack(docs.coalesce(1), FILE, capacity=512, block_windows=64).collect()
    sequences = _check_pieces(rows, docs.collect(), library, 512)
    assert sum(r.length for r in rows) / (512 * len(sequences)) > 0.97


def test_store_hard_rows(spark, library, tmp_path):
    docs = hard_documents(spark)
    got = one_to_one(token_store.stored_documents(docs, f"file://{tmp_path}/a", FILE), docs.count())
    listed = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at, wanted = 0, []
    for d in listed:
        ids = _ids(library, d.text)
        wanted.append((d.doc_id, at, len(ids), _crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == wanted
    assert token_store.stored_documents(no_documents(spark), f"{tmp_path}/b", FILE).count() == 0
    # Raw ids lie in the files in order, and nothing unfinished is left.
    files = sorted(Path(tmp_path, "a").glob("*.ids"))
    assert np.concatenate([np.fromfile(f, "<u2") for f in files]).tolist() == [i for d in listed for i in _ids(library, d.text)]
    assert not list(Path(tmp_path, "a").glob(".0*"))


def test_store_lookup(spark, library, tmp_path):
    docs = documents(spark, [(i * 7, f"word {i} of {i % 5}") for i in range(500)] + [(70, "again")])
    token_store.write(docs, str(tmp_path / "s"), FILE, docs_per_shard=60)
    asked = spark.createDataFrame([(70,), (3500 - 7,), (1,), (None,), (10**9,), (-4,)], "doc_id long")
    got = sorted((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in token_store.lookup(asked, str(tmp_path / "s")).collect())
    assert got == sorted([(70, _ids(library, "word 10 of 0")), (70, _ids(library, "again")), (3493, _ids(library, "word 499 of 4"))])


def test_hard_texts_are_hard():
    assert None in HARD_TEXTS and "" in HARD_TEXTS
