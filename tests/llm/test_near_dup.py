"""Near-duplicates against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gatelight.llm import near_dup, quality
from gatelight.llm.graph import components
from gatelight.llm.shingles import Shingles
from gatelight.llm.word_ids import word_ids
from tests.llm.helpers import documents, hard_documents, no_documents


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    """What the operator must return: every pair of documents compared on full sets."""
    texts = defaultdict(set)
    for i, t in rows:
        if i is not None:
            texts[i].add(shingle_set(t))
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in texts[i] for b in texts[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return Counter((i, len(shingle_set(t)), None if i is None else find(i), True if i is None else find(i) == i) for i, t in rows)


def _got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_shingles_equal_plain_sets():
    own = Shingles()
    random.seed(1)
    for _ in range(300):
        text = " ".join(random.choices(["a", "B", "b", "ä", "Ä", "c\x1cd", "x y", ""], k=random.randrange(30)))
        assert len(own.of(text)) == len(shingle_set(text)), repr(text)
    assert np.array_equal(own.of("One two THREE four five\nsix"), own.of("one\ttwo three four five six"))


def test_hard_rows(spark):
    docs = hard_documents(spark)
    assert _got(near_dup.components_of(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert near_dup.components_of(no_documents(spark)).count() == 0


def test_groups_chains_and_shared_passages(spark):
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = random.choices(vocabulary, k=40)
    rows = []

    def add(words):
        rows.append((random.randrange(10**6), " ".join(words)))

    for size in (20, 60, 150, 600):  # below and above the sketches
        for _ in range(3):
            base = random.choices(vocabulary, k=size)
            for _ in range(random.choice([2, 5, 40])):
                variant = list(base)
                for _ in range(random.choice([0, 0, 1, 1, 2, size // 40, size // 20])):
                    variant[random.randrange(size)] = random.choice(vocabulary)
                add(variant)
    chain = random.choices(vocabulary, k=200)
    for i in range(12):  # neighbours are alike, the ends are not
        chain = list(chain)
        chain[i * 15] = f"new{i}"
        chain[i * 15 + 7] = f"new{i}"
        add(chain)
    for _ in range(80):
        add(random.choices(vocabulary, k=60) + passage)
        add(passage + random.choices(vocabulary, k=4))
    for _ in range(20):
        add(["five", "words", "or", "less"][: random.randrange(5)])
    rows += [(5, "one text of five with quite some words in it"), (5, "other text of five with quite some words in it"), (7, "one text of five with quite some words in it"), (6, "other text of five with quite some words in it"), (5, "")]
    want = plain(rows)
    assert sum(c[2] != c[0] for c in want) > 60
    assert _got(near_dup.components_of(documents(spark, rows))) == want


def test_threshold_is_met_exactly(spark):
    # 20 words make 16 shingles; a changed last word leaves 15 of 17 (0.88), two leave 14 of 18 (0.78).
    words = [f"t{i}" for i in range(20)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join([*words[:-2], "y", "z"]))]
    assert _got(near_dup.components_of(documents(spark, rows))) == plain(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_are_not_expanded(spark):
    docs = documents(spark, [(i, "the very same text that is here again and again " * 3) for i in range(500)])
    assert near_dup.components_of(docs).filter((F.col("component_id") == 0) & (F.col("kept") == (F.col("doc_id") == 0))).count() == 500


def test_threshold_of_op7_and_of_the_pipeline(spark):
    import corpus_pipeline

    # 59 words make 55 shingles; one changed word inside leaves 50 of 60 (0.83), two apart leave 45 of 65 (0.69).
    words = [f"t{i}" for i in range(59)]
    once = [*words[:30], "x", *words[31:]]
    rows = [(1, " ".join(words)), (2, " ".join(once)), (3, " ".join([*once[:15], "y", *once[16:]]))]
    docs = documents(spark, [*rows, (4, "text of its own with other words")])
    assert {r.doc_id for r in near_dup.components_of(docs).filter("kept").collect()} == {1, 2, 3, 4}
    # The third is as near to the second as that to the first.
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()} == {1, 4}


def test_percent_against_all_pairs(spark):
    random.seed(21)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for size in (12, 40, 90, 400, 1500):
        for _ in range(6):
            base = random.choices(vocabulary, k=size)
            for changes in (0, 1, 1, 2, size // 60, size // 45, size // 40):
                variant = list(base)
                for _ in range(changes):
                    variant[random.randrange(size)] = random.choice(vocabulary)
                rows.append((len(rows), " ".join(variant)))
    sets = [shingle_set(t) for _, t in rows]
    edges = [(i, j) for j in range(len(rows)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in edges:
            group[i] = group[j] = min(group[i], group[j])
    assert sum(85 * len(sets[i] | sets[j]) > 100 * len(sets[i] & sets[j]) for i, j in edges) > 5
    got = {r.doc_id: r.component_id for r in near_dup.linked(documents(spark, rows), percent=80).collect()}
    assert [got[i] for i in range(len(rows))] == group


class Captured:
    """Stands for a table and keeps the function that runs in its tasks."""

    def withColumn(self, *_):
        return self

    withColumnRenamed = join = groupBy = agg = select = withColumn

    def mapInArrow(self, work, _):
        return work


@pytest.mark.parametrize("step", ["sketches", "sets", "score"])
def test_words_remembered_for_tokenizing_are_given_back(spark, monkeypatch, step):
    monkeypatch.setattr(near_dup, "id_and_text", lambda docs: docs)
    work = {"sketches": lambda: near_dup._sketches(Captured(), 4), "sets": lambda: near_dup._sets(Captured(), Captured()), "score": lambda: quality.scorer(quality._constant(0.5).to_bytes()).func}[step]()
    own = word_ids(public_tokenizers.path("word_bpe_49k.json"))
    before = own.encode("some words, of a Packing task")
    own.older["left"] = b""
    assert own and own.parts
    assert list(work(iter([]))) == []
    assert not (own or own.older or own.parts)
    assert own.encode("some words, of a Packing task") == before
