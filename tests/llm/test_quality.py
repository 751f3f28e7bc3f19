"""The quality network: slopes, whole texts, held-out accuracy, hard rows."""

import zlib

import numpy as np

from gatelight.llm import quality
from tests.llm.helpers import documents, hard_documents, no_documents, one_to_one

SF = "/root/testdata/sf0.01"


def test_chunks_cover_every_byte():
    for size in (0, 1, 255, 256, 257, 448, 449, 5000):
        data = bytes(i % 251 for i in range(size))
        chunks = quality.chunks_of(data)
        whole = b"".join(c.tobytes()[: quality.STEP] for c in chunks[:-1]) + chunks[-1].tobytes()
        assert whole[:size] == data and not any(whole[size:])


def test_cue_counts_at_every_place():
    network = quality.Network.fresh(3, 0.2)
    chunks = np.zeros((40, quality.CHUNK), np.uint8)
    for place, chunk in enumerate(chunks):
        chunk[20 + place : 28 + place] = np.frombuffer(b"spam cue", np.uint8)
    features, _ = network.pooled(chunks)
    assert np.array_equal(features, np.repeat(features[:1], 40, axis=0))


def test_slopes_are_right():
    rng = np.random.default_rng(2)
    network = quality.Network.fresh(3, 0.2)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    chunks, counts, labels = rng.integers(0, 256, (7, quality.CHUNK), dtype=np.uint8), np.array([3, 4]), np.array([1.0, 0.0])

    def loss():
        network._fold()
        p = quality._logistic(network.logits(chunks, counts))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    network._fold()
    slopes = network.gradients(chunks, counts, labels)
    for name, place in (("out", (3,)), ("prior", (0,)), ("bias", (5,)), ("filters", (2, 3, 4)), ("embed", (int(chunks[0, 17]), 1))):
        kept = network.weights[name][place]
        network.weights[name][place] = kept + 1e-3
        above = loss()
        network.weights[name][place] = kept - 1e-3
        slope = (above - loss()) / 2e-3
        network.weights[name][place] = kept
        assert abs(slope - slopes[name][place]) < 2e-3 + 0.1 * abs(slope), name


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    for r in rows[:20]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_hard_rows_and_missing_labels(spark):
    docs = hard_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (None, 1, 0), (4, None, 0), (9, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = one_to_one(quality.scored(docs, labels), docs.count())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in got if r.doc_id in (7, 8)}.__len__() == 1
    nothing = quality.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert quality.scored(no_documents(spark), labels).count() == 0


def test_end_of_a_long_text_counts():
    network = quality.Network.fresh(1, 0.0)
    a, b = ("a" * 50_000).encode(), ("a" * 49_000 + "!Z" * 500).encode()
    one, other = quality._scores(network, [quality.chunks_of(a), quality.chunks_of(b)])
    assert one != other


def test_learning_ignores_held_out_rows(spark):
    docs = documents(spark, [(i, f"text number {i}") for i in range(60)])
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    turned = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) == quality.train(docs, turned)


def test_repeated_ids_are_learned_once(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert zlib.crc32(b"7") % 5
    texts = [(i, f"text {i}") for i in range(40)]
    once = quality.train(documents(spark, texts), labels)
    # Learning is not dominated by an id that stands in many rows.
    many = quality.train(documents(spark, texts + [texts[7]] * 300), labels)
    first, second = quality.Network.from_bytes(once).weights, quality.Network.from_bytes(many).weights
    assert all(np.array_equal(first[k], second[k]) for k in first)
