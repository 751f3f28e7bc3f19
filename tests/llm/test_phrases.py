"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gatelight.llm import phrases
from gatelight.llm.count_automaton import CountAutomaton
from tests.llm.helpers import hard_documents, no_documents

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, score string, state int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, "x", 7, None, 1, 2) for i, (t, l) in enumerate(rows)], SCHEMA)


def plain(rows, least=100, longest=5, best=2000):
    """All rows the operator must return for texts (text, lang)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in candidates.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    out = []
    for (lang, p), a in candidates.items():
        if 100 * inside[lang, p] < 100 * a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rank, rows = Counter(), []
    for lang, score, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= best:
            rows.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def texts(seed, n, words=("a", "B", "éa", "of the", "x;y", "new york city", "\t", "!", "new", "the")):
    random.seed(seed)
    return [(" ".join(random.choices(words, weights=[9, 4, 3, 8, 1, 2, 1, 3, 4, 5], k=random.randrange(60))), random.choice(["en", "fr", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("least, sizes", [(5, {"best": 7}), (20, {"shard_bytes": 700, "range_weight": 50, "entries_per_range": 30})])
def test_equals_plain_counting(spark, least, sizes):
    rows = texts(least, 250)
    want = plain(rows, least, sizes.get("longest", 5), sizes.get("best", 2000))
    assert got(phrases.collocations(table(spark, rows).repartition(3), least=least, **sizes)) == want and len(want) > 20


def test_hard_rows(spark):
    assert phrases.collocations(no_documents(spark)).count() == 0
    assert phrases.collocations(table(spark, [(None, None), ("", "en"), (". ; !", "en"), ("rare words only", "en")])).count() == 0
    docs = hard_documents(spark)
    assert got(phrases.collocations(docs)) == plain([(r.text, r.lang) for r in docs.collect()])
    same = [("one and the same phrase stands here", "de")] * 150 + [("A.B " * 70_000 + "end", "de"), ("z " * 500, None)]
    assert got(phrases.collocations(table(spark, same), shard_bytes=20_000)) == plain(same)


def test_a_hot_word_is_split_over_ranges(spark):
    rows = [(" ".join(f"the w{i % 9} of" for i in range(200)), "en") for _ in range(20)]
    assert got(phrases.collocations(table(spark, rows), range_weight=300)) == plain(rows)


def test_union_adds_weights():
    rng = np.random.default_rng(4)
    parts, want = [], Counter()
    for n in (50, 0, 80):
        arcs = Counter(map(tuple, rng.integers(0, 6, (n, 2)).tolist()))
        want += arcs
        keys = np.array(sorted(arcs), np.int64).reshape(-1, 2)
        parts.append(CountAutomaton(keys[:, 0], keys[:, 1], np.array([arcs[tuple(k)] for k in keys.tolist()], np.int64)))
    whole, places = CountAutomaton.union(parts)
    assert dict(zip(zip(whole.state.tolist(), whole.symbol.tolist()), whole.weight.tolist())) == want
    for part, place in zip(parts, places):
        assert (whole.state[place] == part.state).all() and (whole.symbol[place] == part.symbol).all()
    kept, renamed = whole.pruned(4)
    assert (kept.weight >= 4).all() and len(kept.weight) == sum(w >= 4 for w in want.values()) and (renamed >= 0).sum() == len(kept.weight)
