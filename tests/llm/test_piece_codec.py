"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from gatelight.llm import piece_codec
from tests.llm.helpers import HARD_TEXTS, hard_documents, no_documents, one_to_one

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return piece_codec.PieceCodec(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _texts():
    random.seed(3)
    signs = list("ab cde \n\t é①ﬁ▁😀́ßЖ漢.,-09\x00") + ["the ", "ing", "  "]
    return ["".join(random.choices(signs, k=random.randrange(60))) for _ in range(800)] + [t or "" for t in HARD_TEXTS]


def test_ids_and_spans_equal_the_library(own, library):
    for text in _texts():
        ids, begins, ends = own.encode(text)
        told = sentencepiece_pb2.SentencePieceText()
        told.ParseFromString(library.encode(text, out_type="serialized_proto"))
        assert ids.tolist() == [p.id for p in told.pieces], text[:80]
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in told.pieces], text[:80]


def test_spans_cover_the_text(own):
    text = "Ünder the  ① bridge"
    _, begins, ends = own.encode(text)
    data = text.encode()
    assert b"".join(data[b:e] for b, e in zip(begins, ends)) == data


def test_decoding_any_ids_equals_the_library(own, library):
    random.seed(5)
    for _ in range(3000):
        ids = [random.choice([0, 1, 2, *range(3, 300), random.randrange(32000)]) for _ in range(random.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("trims", [True, False])
def test_character_map_and_alignment_equal_the_library(rule, trims):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=trims)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(normalizer.serialized_normalizer_spec()) if isinstance(normalizer.serialized_normalizer_spec(), bytes) else spec.CopyFrom(normalizer.serialized_normalizer_spec())
    own = object.__new__(piece_codec.PieceCodec)
    own.map = piece_codec.CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
    own.dummy_prefix, own.trims, own.escapes = False, trims, False
    for text in [*_texts(), "ＡＢＣ ﬀ ½ ㌔ é ｶﾞ  x "]:
        if "\x00" in text or len(text) > 5000:
            continue
        told, offsets = normalizer.normalize(text, with_offsets=True)
        normal, align = own.normalise(text)
        assert normal.decode() == told, repr(text)
        # The library counts characters, the operator bytes.
        data, at, mine = text.encode(), 0, []
        for char in told:
            mine.append(len(data[: align[at]].decode()))
            at += len(char.encode())
        assert mine == list(offsets)[: len(mine)], repr(text)


def test_query_over_hard_rows(spark, library):
    docs = hard_documents(spark)
    got = one_to_one(piece_codec.digests(docs, MODEL), docs.count())
    wanted = []
    for row in docs.collect():
        ids = library.encode(row.text or "") + [2]
        wanted.append((row.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((row.text or "").encode())))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert piece_codec.digests(no_documents(spark), MODEL).count() == 0
