"""Phrase collocations of each language, from weighted acyclic automata.

1. Texts become shards of bounded size: the sorted vocabulary and the words as places in it.
2. Word counts are added over all shards, in ranges of words. Words that occur ``least``
   times or more get numbers and are dealt into prefix ranges of about equal weight; a word
   heavier than a range is split over several by what follows it.
3. Level by level, from 2 words to ``longest``: each shard sorts the phrases whose first and
   last words (all but one) are frequent, and builds a count automaton per prefix range;
   the automata of a range are united, their weights added, and arcs below ``least`` pruned.
   A phrase can only be frequent if all its parts are, so nothing is lost. Each shard learns
   which of its phrases stay, under which number. Shards stay where they are stored: what
   they learn is stored by the task that wrote them, and read with them.
4. Parts are looked up by composition: the state of an arc leads to the counts of the
   phrase's beginnings, its symbol to those of its endings, so a level joins the one before.
5. A cut scores floor(1000 a n / (l r)) in decimals of 38 digits; the lowest cut counts.
   Phrases inside a phrase of one more word that occurs as often are dropped: counts of
   longer ones cannot be higher, so that word decides for all longer ones too.

A null text is empty; a null language is ``und``, as is a language of that name. Rows
without an id count like all others, and repeated rows count as often as they stand there.
A long text is cut only where a piece ends. Tables without a frequent phrase give no rows.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelight.llm.common import new_folder
from gatelight.llm.count_automaton import CountAutomaton
from gatelight.session import discard, remove_folder, saved
from gatelight.sources.shared import stored_blocks

SHARD_BYTES = 8 << 20
RANGE_WEIGHT = 1 << 21
ENTRIES_PER_RANGE = 1 << 20
#: What ends a piece, and what separates words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(BREAKS + b"\t" + bytes(range(65, 91)), b"." * len(BREAKS) + b" " + bytes(range(97, 123)))
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")
_SHARD = "vocabulary array<struct<lang: string, first: int, words: binary, counts: binary>>, tokens binary, entries long"


class _Numbers(dict):
    """Numbers words in the order of their first use; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _parts(data: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    at = 0
    while len(data) - at > most:
        end = _BREAK.search(data, at + most)
        if end is None:
            break
        yield data[at : end.end()]
        at = end.end()
    yield data[at:]


def _shard(numbers: dict[str, _Numbers], found: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """Vocabulary sorted by language and word, and all words as places in it from 1 on, 0 between pieces."""
    langs, lists, places, firsts = sorted(numbers, key=str.encode), [], {}, [0]
    for lang in langs:
        known = sorted(w for w in numbers[lang] if w != b".")
        place = np.zeros(len(known) + 1, np.int32)
        place[[numbers[lang][w] for w in known]] = np.arange(firsts[-1] + 1, firsts[-1] + len(known) + 1, dtype=np.int32)
        places[lang] = place
        firsts.append(firsts[-1] + len(known))
        lists.append(known)
    tokens = np.concatenate([places[lang][ids] for lang, ids in found])
    counts = np.bincount(tokens, minlength=firsts[-1] + 1)[1:]
    # A line end is no part of a word.
    vocabulary = [{"lang": lang, "first": a, "words": zstd(b"\n".join(known)), "counts": _pack(counts[a:b])} for lang, known, a, b in zip(langs, lists, firsts, firsts[1:]) if known]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))
    return pa.RecordBatch.from_arrays([pa.array([vocabulary], kind), pa.array([_pack(tokens)], pa.binary()), pa.array([firsts[-1]], pa.int64())], ["vocabulary", "tokens", "entries"])


def shards(docs: DataFrame, text: str, lang: str, shard_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        found, held = [], 0
        for batch in batches:
            for language, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for part in _parts(value.as_buffer().to_pybytes() if value.is_valid else b"", shard_bytes):
                    if held and held + len(part) > shard_bytes:
                        yield _shard(numbers, found)
                        numbers, found, held = {}, [], 0
                    words = part.translate(_PLAIN).replace(b".", b" . ").split()
                    known = numbers.setdefault(language, _Numbers())
                    found.append((language, np.fromiter(map(known.__getitem__, words), np.int32, len(words))))
                    found.append((language, np.zeros(1, np.int32)))
                    held += len(part)
        if found:
            yield _shard(numbers, found)

    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, _SHARD).withColumn("shard", F.monotonically_increasing_id())


def _pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers from 0 on, as steps where they ascend, in as few bytes as the largest needs, compressed."""
    import zstandard

    values = np.diff(values, prepend=0) if ascending else values
    most = int(values.max(initial=0))
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(k[2]))
    return kind[2].encode() + zstandard.ZstdCompressor(level=6).compress(values.astype(kind).tobytes())


def _unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    import zstandard

    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.int64)
    return np.cumsum(values) if ascending else values


def _pack_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    return _pack(ids >> 32), _pack(ids & 0xFFFFFFFF)


def _pack_arcs(arcs: CountAutomaton) -> tuple[bytes, bytes, bytes, bytes]:
    """States as steps, symbols by range and rank, and weights."""
    return _pack(arcs.state, True), *_pack_ids(arcs.symbol), _pack(arcs.weight)


def _unpack_arcs(row: dict) -> CountAutomaton:
    return CountAutomaton(_unpack(row["state"], True), _unpack_ids(row["high"], row["low"]), _unpack(row["weight"]))


def _unpack_ids(high: bytes, low: bytes) -> np.ndarray:
    return (_unpack(high) << 32) | _unpack(low)


def _record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_LISTED = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
_COUNTED = pa.schema([
    ("range", pa.int64()), ("shard", pa.int64()), ("places", pa.binary()), ("ranks", pa.binary()), ("lows", pa.binary()), ("splits", pa.binary()),
    ("used", pa.int64()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("all_langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])


def _spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _listed_words(stored: DataFrame, ranges: int) -> DataFrame:
    """Each shard's words and counts, dealt by a hash of language and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.column("shard")[row].as_py()
                for part in batch.column("vocabulary")[row].as_py():
                    lang, words, counts = part["lang"], zstandard.ZstdDecompressor().decompress(part["words"]).split(b"\n"), _unpack(part["counts"])
                    seed = xxhash.xxh3_64_intdigest(lang)
                    to = np.array([xxhash.xxh3_64_intdigest(w, seed) % ranges for w in words], np.int64)
                    order = np.argsort(to, kind="stable")
                    cuts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1])) if len(order) else []
                    rows = []
                    for a, b in zip(cuts, [*cuts[1:], len(order)]):
                        at = order[a:b]
                        rows.append((int(to[at[0]]), shard, lang, zstd(b"\n".join([words[i] for i in at.tolist()])), _pack(counts[at]), _pack(at + part["first"], True)))
                    yield _record(_LISTED, rows)

    return stored.select("shard", "vocabulary").mapInArrow(run, _spark_schema(_LISTED))


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(data)


def _counted_words(listed: DataFrame, least: int, range_weight: int) -> DataFrame:
    """Per range of words one row without a shard: all frequent words in order, and per language the count of all words;
    and one per shard: which of its words are frequent, their ranks, and their own ranges, counted from the first of this range."""

    def count(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        numbers: dict[str, dict[bytes, int]] = {}
        total, n = np.zeros(1 << 16, np.int64), 0
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                known = numbers.setdefault(row["lang"], {})
                words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
                ids = np.empty(len(words), np.int64)
                for i, w in enumerate(words):
                    at = known.get(w)
                    if at is None:
                        known[w] = at = n
                        n += 1
                    ids[i] = at
                if n > len(total):
                    total = np.concatenate([total, np.zeros(max(n, len(total)), np.int64)])
                total[ids] += _unpack(row["counts"])
                held.append((row["shard"], ids, _unpack(row["places"], True)))
        frequent = [(lang.encode(), w, lang, i) for lang, known in numbers.items() for w, i in known.items() if total[i] >= least]
        frequent.sort()
        rank, lows, splits = np.full(n + 1, -1, np.int64), np.zeros(len(frequent), np.int64), np.ones(len(frequent), np.int64)
        low = filled = used = 0
        for r, (_, _, _, i) in enumerate(frequent):
            weight, rank[i] = int(total[i]), r
            if filled and filled + weight > range_weight:
                low, filled = used, 0
            lows[r], splits[r] = low, -(-weight // range_weight)
            filled += weight
            used = max(used, low + int(splits[r]))
        key = keys[0].as_py()
        langs = sorted(numbers)
        yield _record(_COUNTED, [(
            key, None, None, None, _pack(lows, True), _pack(splits), used, [f[2] for f in frequent],
            [f[1].decode() for f in frequent], [int(total[f[3]]) for f in frequent], langs, [int(sum(total[i] for i in numbers[x].values())) for x in langs])])
        for shard, ids, places in held:
            ranks = rank[ids]
            stay = np.flatnonzero(ranks >= 0)
            if len(stay):
                r = ranks[stay]
                yield _record(_COUNTED, [(key, shard, _pack(places[stay], True), _pack(r), _pack(lows[r]), _pack(splits[r]), *[None] * 6)])

    return listed.groupBy("range").applyInArrow(count, _spark_schema(_COUNTED))


def _state(shard: int, at: np.ndarray, grams: np.ndarray, ids: np.ndarray, bases: np.ndarray, splits: np.ndarray) -> tuple:
    """Where the frequent phrases of a shard start, which of its own they are, and the numbers and ranges of those."""
    return (shard, _pack(at, True), _pack(grams), *_pack_ids(ids), _pack(bases), _pack(splits))


_STATE = pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("at", "grams", "high", "low", "bases", "splits"))])


def _read_state(row: dict) -> tuple[np.ndarray, ...]:
    return _unpack(row["at"], True), _unpack(row["grams"]), _unpack_ids(row["high"], row["low"]), _unpack(row["bases"]), _unpack(row["splits"])


def _by_group(marks: DataFrame, name: str) -> str:
    """Marks stored by the task that wrote their shard, so that a task that reads it finds them in one folder."""
    path = new_folder(marks.sparkSession, name)
    marks.withColumn("group", F.shiftright("shard", 33)).repartition("group").write.partitionBy("group").parquet(path)
    return path


class _Marks:
    """The marks of a shard, read from the folder of its group; one group is held at a time."""

    def __init__(self, folder: str, columns: list[str]) -> None:
        self.folder, self.columns, self.group, self.rows = folder, columns, None, {}

    def of(self, shard: int) -> list[dict]:
        if self.group != shard >> 33:
            self.group, self.rows = shard >> 33, {}
            for block in stored_blocks(f"{self.folder}/group={self.group}", ["shard", *self.columns], 256):
                for row in block.to_pylist():
                    self.rows.setdefault(row["shard"], []).append(row)
        return self.rows.get(shard, [])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _first_states(stored: DataFrame, marks_at: str) -> DataFrame:
    """Each shard with the numbers of its frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(marks_at, ["range", "places", "ranks", "lows", "splits", "offset"])
        for row in _rows(batches):
            found = marks.of(row["shard"])
            if not found:
                continue
            place, low, splits = (np.concatenate(x) for x in zip(*((_unpack(m["places"], True), _unpack(m["lows"]) + m["offset"], _unpack(m["splits"])) for m in found)))
            ids = np.concatenate([(m["range"] << 32) + _unpack(m["ranks"]) for m in found])
            order = np.argsort(ids)
            said = _unpack(row["tokens"])
            local = np.full(max(int(said.max(initial=0)), int(place.max(initial=-1)) + 1) + 1, -1, np.int32)
            local[place[order] + 1] = np.arange(len(order))  # words are counted from 1, 0 is the end of a piece
            grams = local[said]
            at = np.flatnonzero(grams >= 0)
            yield _record(_STATE, [_state(row["shard"], at, grams[at], ids[order], low[order], splits[order])])

    return stored.select("shard", "tokens").mapInArrow(run, _spark_schema(_STATE))


class _Candidates:
    """The phrases of one more word in a shard whose parts are frequent, in the order of range, state and symbol."""

    def __init__(self, row: dict) -> None:
        at, grams, self.ids, self.bases, self.splits = _read_state(row)
        here = np.flatnonzero(at[1:] == at[:-1] + 1)
        self.at = at[here]
        size = max(1, len(self.ids))
        keys, of, counts = np.unique(grams[here] * size + grams[here + 1], return_inverse=True, return_counts=True)
        self.first, last = keys // size, keys % size
        state, symbol = self.ids[self.first], self.ids[last]
        with np.errstate(over="ignore"):
            mixed = (symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        ranges = self.bases[self.first] + (mixed % self.splits[self.first].astype(np.uint64)).astype(np.int64)
        order = np.argsort(ranges, kind="stable")
        self.first, self.ranges = self.first[order], ranges[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[of]
        self.arcs = CountAutomaton(state[order], symbol[order], counts[order].astype(np.int64))
        self.starts = np.flatnonzero(np.append(True, self.ranges[1:] != self.ranges[:-1])) if len(order) else np.zeros(0, np.int64)


_AUTOMATON = pa.schema([("range", pa.int64()), ("shard", pa.int64()), *((n, pa.binary()) for n in ("state", "high", "low", "weight"))])


def _automata(states: DataFrame) -> DataFrame:
    """(range, shard, arcs): one automaton for each shard and prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = _Candidates(row)
            arcs = found.arcs
            for a, b in zip(found.starts, [*found.starts[1:], len(found.ranges)]):
                part = CountAutomaton(arcs.state[a:b], arcs.symbol[a:b], arcs.weight[a:b])
                yield _record(_AUTOMATON, [(int(found.ranges[a]), row["shard"], *_pack_arcs(part))])

    return states.mapInArrow(run, _spark_schema(_AUTOMATON))


_UNITED = pa.schema([("range", pa.int64()), ("shard", pa.int64()), *((n, pa.binary()) for n in ("stay", "place", "state", "high", "low", "weight"))])


def _united(automata: DataFrame, least: int) -> DataFrame:
    """Per range one row without a shard, the pruned union, and one per shard: which of its arcs stay, and their places in the union."""

    def unite(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, parts = [], []
        for row in _rows(batches):
            shards.append(row["shard"])
            parts.append(_unpack_arcs(row))
        whole, places = CountAutomaton.union(parts)
        kept, renamed = whole.pruned(least)
        if not len(kept.state):
            return
        key = keys[0].as_py()
        yield _record(_UNITED, [(key, None, None, None, *_pack_arcs(kept))])
        for shard, place in zip(shards, places):
            now = renamed[place]
            stay = np.flatnonzero(now >= 0)
            if len(stay):
                yield _record(_UNITED, [(key, shard, _pack(stay, True), _pack(now[stay], True), None, None, None, None)])

    return automata.groupBy("range").applyInArrow(unite, _spark_schema(_UNITED))


def _next_states(states: DataFrame, marks_at: str) -> DataFrame:
    """Each shard with the phrases of one more word that stay; shards without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(marks_at, ["range", "stay", "place"])
        for row in _rows(batches):
            kept = marks.of(row["shard"])
            if not kept:
                continue
            found = _Candidates(row)
            start_of = {int(found.ranges[a]): int(a) for a in found.starts}
            ids = np.full(len(found.ranges), -1, np.int64)
            for m in kept:
                ids[start_of[m["range"]] + _unpack(m["stay"], True)] = (m["range"] << 32) + _unpack(m["place"], True)
            stays = np.flatnonzero(ids >= 0)
            stays = stays[np.argsort(ids[stays])]
            local = np.full(len(ids), -1, np.int64)
            local[stays] = np.arange(len(stays))
            grams = local[found.of]
            there = np.flatnonzero(grams >= 0)
            first = found.first[stays]
            yield _record(_STATE, [_state(row["shard"], found.at[there], grams[there], ids[stays], found.bases[first], found.splits[first])])

    return states.mapInArrow(run, _spark_schema(_STATE))


def _arcs(united: DataFrame) -> DataFrame:
    """(id, state, symbol, a) of every frequent phrase of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                arcs = _unpack_arcs(row)
                ids = (row["range"] << 32) + np.arange(len(arcs.state))
                for a in range(0, len(ids), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 65_536]) for x in (ids, arcs.state, arcs.symbol, arcs.weight)], ["id", "state", "symbol", "a"])

    return united.filter("shard IS NULL").mapInArrow(run, "id long, state long, symbol long, a long")


def _levels(docs: DataFrame, least: int, longest: int, text: str, lang: str, shard_bytes: int, range_weight: int, entries_per_range: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), and per level (id, lang, phrase, last, a, begins, ends, inside): the counts of all
    beginnings and endings, longest last and first, and the highest count of a phrase of one more word around it."""
    # Each table is stored once and goes as soon as the next ones are: a shard's own words and states are the bulk of it.
    spark = docs.sparkSession
    stored = saved(shards(docs, text, lang, shard_bytes))
    ranges = max(1, -(-(stored.agg(F.sum("entries")).first()[0] or 0) // entries_per_range))
    counted = saved(_counted_words(_listed_words(stored, ranges), least, range_weight))
    whole = counted.filter("shard IS NULL")
    # The prefix ranges of phrases stand one after the other, those of each range of words together.
    offsets = whole.select("range", (F.sum("used").over(Window.orderBy("range")) - F.col("used")).alias("offset"))
    totals = whole.select(F.inline(F.arrays_zip(F.col("all_langs").alias("lang"), F.col("totals").alias("n")))).groupBy("lang").agg(F.sum("n").alias("n"))
    numbered = whole.select("range", F.posexplode(F.arrays_zip(F.col("langs").alias("lang"), F.col("words").alias("word"), F.col("counts").alias("a"))).alias("rank", "w"))
    totals, words = saved(totals), saved(numbered.select("w.lang", "w.word", "w.a", (F.shiftleft("range", 32) + F.col("rank")).alias("id")))
    marks = counted.filter("shard IS NOT NULL").select("range", "shard", "places", "ranks", "lows", "splits").join(offsets, "range")
    marks_at = _by_group(marks, "word-marks")
    discard(counted)
    states = saved(_first_states(stored, marks_at))
    discard(stored)
    remove_folder(spark, marks_at)
    none = F.array().cast("array<long>")
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("begins"), none.alias("ends"))
    levels = []
    for size in range(2, longest + 1):
        united = saved(_united(_automata(states), least))
        arcs = saved(_arcs(united))
        left = level.select(F.col("id").alias("state"), "lang", F.col("phrase").alias("p1"), F.col("a").alias("a1"), F.col("begins").alias("b1"))
        right = level.select(F.col("id").alias("symbol"), F.col("last").alias("p2"), F.col("a").alias("a2"), F.col("ends").alias("e2"))
        around = arcs.select(F.explode(F.array("state", "symbol")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("inside"))
        levels.append(level.join(around, "id", "left"))
        level = arcs.join(left, "state").join(right, "symbol").select(
            "id", "lang", F.concat_ws(" ", "p1", "p2").alias("phrase"), F.col("p2").alias("last"), "a",
            F.concat("b1", F.array("a1")).alias("begins"), F.concat(F.array("a2"), "e2").alias("ends"))
        level = saved(level)
        before = states
        if size < longest:
            marks_at = _by_group(united.filter("shard IS NOT NULL").select("range", "shard", "stay", "place"), "phrase-marks")
            states = saved(_next_states(states, marks_at))
            remove_folder(spark, marks_at)
        discard(united)
        discard(before)
    levels.append(level.withColumn("inside", F.lit(None).cast("long")))
    return totals, levels


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, text: str = "text", lang: str = "lang",
    shard_bytes: int = SHARD_BYTES, range_weight: int = RANGE_WEIGHT, entries_per_range: int = ENTRIES_PER_RANGE,
) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = _levels(docs, least, longest, text, lang, shard_bytes, range_weight, entries_per_range)
    phrases = levels[1]
    for level in levels[2:]:
        phrases = phrases.unionByName(level)
    number = "decimal(19,0)"
    free = phrases.filter(F.col("inside").isNull() | (F.col("inside") < F.col("a"))).join(totals, "lang")
    cuts = F.zip_with("begins", "ends", lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    whole = (F.col("a") * F.lit(1000).cast("long")).cast(number) * F.col("n").cast(number)
    scored = F.transform(cuts, lambda c, k: F.struct(
        F.call_function("div", whole, c["l"].cast(number) * c["r"].cast(number)).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    lowest = free.withColumn("cut", F.array_min(scored)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, string_split_regex(piece, '[ \\t]+') AS said
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, piece, list_filter(said, lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, w[i:i + size - 1] AS parts
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest(range(1, 6)) AS size) WHERE i + size - 1 <= len(w)),
counted AS (SELECT lang, size, phrase, any_value(parts) AS parts, count(*) AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
longer AS (
  SELECT lang, inner_phrase AS phrase, max(a) AS inside FROM (
    SELECT lang, a, unnest([array_to_string(parts[1:size - 1], ' '), array_to_string(parts[2:size], ' ')]) AS inner_phrase FROM counted WHERE size >= 3) GROUP BY ALL),
free AS (SELECT c.* FROM counted c LEFT JOIN longer x USING (lang, phrase) WHERE size >= 2 AND (inside IS NULL OR inside < a)),
cuts AS (
  SELECT f.lang, f.phrase, f.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * f.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM free) f JOIN totals USING (lang)
  JOIN counted l ON l.lang = f.lang AND l.phrase = array_to_string(f.parts[1:k], ' ')
  JOIN counted r ON r.lang = f.lang AND r.phrase = array_to_string(f.parts[k + 1:f.size], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000"""
