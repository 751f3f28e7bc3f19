"""Removing byte spans that repeat across documents, with suffix arrays by linear grouping.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too.

1. Every string of ``length`` bytes (a window) has an anchor: of its substrings a quarter as
   long, the one of least hash, the leftmost of those. Equal windows have equal anchors at
   equal places. Neighbouring windows with the same anchor form a run; its bytes are a
   context, less than two windows long. Only hashes and places of runs are shuffled.
2. Contexts are counted with partial counts before the shuffle. An anchor that occurs once
   holds no repeated window. All windows of a context that occurs twice are repeated, so
   exact copies are settled by counting, however many there are.
3. What is left are contexts that occur once and share their anchor with other contexts.
   Their bytes, with one example of each repeated context, are dealt by anchor, and each
   task sorts the suffixes of a batch of whole anchors (:mod:`suffix_groups`). Symbols are
   eight bytes, aligned at the anchor, so equal windows hold equal symbols at equal places;
   neighbours in the suffix array that share all whole symbols of a window are compared in
   its remaining eight bytes.
4. An anchor with more than ``most_contexts`` contexts would make a task large. Its windows
   are counted one by one, by a hash of 128 bits, with partial counts before the shuffle.
   The repeated ones are set as bits, 64 places to a number, and leave as runs of set bits.
5. Repeated windows come back to their documents, where their bytes are cut out.

Null texts are empty. Rows that share an id are documents of their own, and repeated rows
repeat each other. Rows without an id are treated like all others. Spans are cut between
bytes, not characters, so what stays is binary. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm.common import slices, written
from gatelight.llm.suffix_groups import suffix_array

LENGTH = 400
MOST_CONTEXTS = 512
#: Bytes scanned at once and sorted at once, and the bits that hold a place within those scanned.
#: Scanning takes about a hundred bytes of memory for each byte, and a Python worker keeps much of it.
SCANNED, SORTED, PLACE_BITS = 512 << 10, 128 << 10, 24
SYMBOL = 8
_FACTOR = 0x9E3779B97F4A7C15
_RUN = "anchor long, context long, doc long, version long, start long, windows int, lead int"
_SPAN = "doc long, version long, start long, windows int"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64, and a number for each byte."""
    up, down = np.full(n, _FACTOR, np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64)


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every substring of ``width`` bytes: differences of prefix sums, then mixed."""
    size = 1 << max(20, int(len(data)).bit_length())
    up, down, numbers = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(numbers[data], up[: len(data)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    h = sums[width:] - sums[:-width]
    h *= down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from minima of blocks forwards and backwards."""
    blocks = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0))]).reshape(-1, width)
    forwards, backwards = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(backwards[:n], forwards[width - 1 : width - 1 + n])


def runs_of(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(piece, start in it, windows, place of the anchor after the start, hash of the anchor) of every run of windows."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    width = length // 4
    h = _hashes(data, width)
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - width + 1) & low).astype(np.int64)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(pieces)), sizes)[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= ends[of])
    if not len(at):
        return none, none, none, none, none
    first = np.flatnonzero(np.append(True, (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)))
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    piece = of[start]
    return piece, start - (ends - sizes)[piece], windows, anchor[start] - start, h[anchor[start]].view(np.int64)


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 4096, "text", SCANNED):
            ids, versions = (batch.column(c).to_numpy() for c in ("doc", "version"))
            pieces, of, offset = [], [], []

            def found() -> pa.RecordBatch:
                piece, start, windows, lead, anchor = runs_of(pieces, length)
                contexts = [xxhash.xxh3_64_intdigest(pieces[p][s : s + n]) for p, s, n in zip(piece.tolist(), start.tolist(), (windows + length - 1).tolist())]
                row = np.array(of, np.int64)[piece]
                return pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(np.array(contexts, np.uint64).view(np.int64)), pa.array(ids[row]), pa.array(versions[row]), pa.array(start + np.array(offset, np.int64)[piece]), pa.array(windows.astype(np.int32)), pa.array(lead.astype(np.int32))],
                    ["anchor", "context", "doc", "version", "start", "windows", "lead"])

            for i, value in enumerate(batch.column("text")):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                # A very long text is scanned in pieces that share all but the last byte of a window.
                for a in range(0, max(1, len(data) - length + 1), SCANNED):
                    pieces.append(data[a : a + SCANNED + length - 1])
                    of.append(i)
                    offset.append(a)
                    if len(pieces[-1]) >= SCANNED:
                        yield found()
                        pieces, of, offset = [], [], []
            if pieces:
                yield found()

    return docs.mapInArrow(run, _RUN)


def repeated_windows(contents: list[bytes], leads: list[int], windows: list[int], length: int) -> list[np.ndarray]:
    """Of each context the windows that another of these contexts holds too, from their suffix array.

    ``leads``: where the anchor stands; only contexts with equal anchors are compared at equal places from it.
    """
    whole = length // SYMBOL - 1  # symbols that every window holds whole
    data = np.frombuffer(b"".join(contents), np.uint8)
    begin = np.cumsum([0, *map(len, contents)])[:-1]
    shift = np.array(leads, np.int64) % SYMBOL
    counts = (np.array([len(c) for c in contents], np.int64) - shift) // SYMBOL
    blocks = [np.frombuffer(c, np.uint64, n, a) for c, a, n in zip(contents, shift.tolist(), counts.tolist())]
    distinct, ranks = np.unique(np.concatenate(blocks), return_inverse=True)
    stops = np.cumsum(counts + 1)  # after each context stands a 1, at the very end a 0
    text = np.ones(int(stops[-1]) + 1, np.int64)
    of = np.repeat(np.arange(len(contents)), counts)
    block = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    place = (stops - counts - 1)[of] + block
    text[place], text[-1] = ranks + 2, 0
    context_at, block_at = np.full(len(text), -1, np.int64), np.zeros(len(text), np.int64)
    context_at[place], block_at[place] = of, block
    order = suffix_array(text)
    order = order[(context_at[order] >= 0) & (block_at[order] + whole <= counts[context_at[order]])]
    same = np.ones(max(0, len(order) - 1), bool)
    for t in range(whole):
        open_ = np.flatnonzero(same)
        same[open_] = text[order[open_] + t] == text[order[open_ + 1] + t]
    group = np.cumsum(np.append(False, ~same)) if len(order) else np.zeros(0, np.int64)
    shared = np.bincount(group)[group] > 1 if len(order) else np.zeros(0, bool)
    order, group = order[shared], group[shared]
    context, asked = context_at[order], np.array(windows, np.int64)
    found: list[list[np.ndarray]] = [[], []]
    for before in range(SYMBOL):
        start = shift[context] + SYMBOL * block_at[order] - before
        fits = (start >= 0) & (start < asked[context])
        c, s, g = context[fits], start[fits], group[fits]
        rest = np.concatenate([np.arange(before), np.arange(before + SYMBOL * whole, length)])
        key = np.ascontiguousarray(data[(begin[c] + s)[:, None] + rest]).view(np.uint64).ravel()
        by = np.lexsort((key, g))
        equal = (g[by][1:] == g[by][:-1]) & (key[by][1:] == key[by][:-1])
        twice = by[np.append(equal, False) | np.append(False, equal)] if len(by) else by
        found[0].append(c[twice])
        found[1].append(s[twice])
    c, s = np.concatenate(found[0]), np.concatenate(found[1])
    by = np.lexsort((s, c))
    return np.split(s[by], np.cumsum(np.bincount(c, minlength=len(contents)))[:-1])


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the contexts that occur once; contexts of an anchor stand together."""

    def settle(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = repeated_windows([r["content"] for r in rows], [r["lead"] for r in rows], [r["windows"] for r in rows], length)
        out = []
        for row, starts in zip(rows, found):
            if row["copies"] == 1 and len(starts):
                cuts = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + 1))
                for a, n in zip(starts[cuts].tolist(), np.diff(np.append(cuts, len(starts))).tolist()):
                    out.append((row["doc"], row["version"], row["start"] + a, n))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.int32())], ["doc", "version", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in slices(batches, 512):
            for row in batch.to_pylist():
                if size >= SORTED and row["anchor"] != rows[-1]["anchor"]:
                    yield from settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row["content"])
        if rows:
            yield from settle(rows)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPAN)


def _counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many contexts, window by window; a run ends where a multiple of 64 begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                found = [(xxhash.xxh3_128_digest(r["content"][a : a + length]), r["copies"], r["doc"], r["version"], r["start"] + a) for r in rows for a in range(r["windows"])]
                halves = np.frombuffer(b"".join(x[0] for x in found), "<i8").reshape(-1, 2)
                columns = list(zip(*found))[1:]
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *(pa.array(c, pa.int64()) for c in columns)], ["h1", "h2", "copies", "doc", "version", "start"])

    windows = written(contexts.mapInArrow(run, "h1 long, h2 long, copies long, doc long, version long, start long"), "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    found = windows.filter("copies = 1").join(repeated, ["h1", "h2"])
    # Bits in a number of fixed size are joined in Spark's own memory, which a set of places is not.
    bits = found.groupBy("doc", "version", F.expr("start div 64").alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(start % 64 AS int)))").alias("bits"))
    edges = "filter(sequence(0, 63), i -> getbit({}, i) = 1)"
    runs = F.arrays_zip(F.expr(edges.format("bits & ~shiftleft(bits, 1)")).alias("first"), F.expr(edges.format("bits & ~shiftrightunsigned(bits, 1)")).alias("last"))
    return bits.select("doc", "version", "block", F.explode(runs).alias("run")).selectExpr("doc", "version", "block * 64 + run.first AS start", "run.last - run.first + 1 AS windows")


def _with_bytes(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """Contexts with their bytes, read once more from their documents."""
    fields = ["anchor", "copies", "contexts", "start", "windows", "lead"]
    wanted = contexts.groupBy("doc", "version").agg(F.collect_list(F.struct(*fields)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()]
        for batch in slices(batches, 256, "text", SCANNED):
            for doc, version, value, rows in zip(batch.column("doc").to_pylist(), batch.column("version").to_pylist(), batch.column("text"), batch.column("wanted")):
                data = value.as_buffer().to_pybytes()
                # Contexts overlap, so those of a very long text are given out part by part.
                for at in range(0, len(rows), 2048):
                    out = [(*(r[f] for f in fields), doc, version, data[r["start"] : r["start"] + r["windows"] + length - 1]) for r in rows.values.slice(at, 2048).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*fields, "doc", "version", "content"])

    return docs.join(wanted, ["doc", "version"]).mapInArrow(run, "anchor long, copies long, contexts long, start long, windows int, lead int, doc long, version long, content binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc, version, start, windows): every window of ``length`` bytes that starts elsewhere too, of ``docs`` (doc, version, text)."""
    if length % SYMBOL or length < 4 * SYMBOL:
        raise ValueError(f"length must be a multiple of {SYMBOL}, and {4 * SYMBOL} at least")
    runs = written(_runs(docs, length), "window-runs")
    # In one partial result all these come from the same row, and so they do in the end.
    one = [F.first(c).alias(c) for c in ("doc", "version", "start", "windows", "lead")]
    counted = runs.groupBy("anchor", "context").agg(F.count("*").alias("copies"), *one)
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("runs")).filter("runs > 1").select("anchor")
    counted = written(counted.join(anchors, "anchor"), "contexts")
    copied = runs.join(counted.filter("copies > 1").select("anchor", "context"), ["anchor", "context"]).select("doc", "version", "start", "windows")
    mixed = counted.groupBy("anchor").agg(F.count("*").alias("contexts"), F.count_if(F.col("copies") == 1).alias("single")).filter("contexts > 1 AND single > 0")
    open_ = counted.join(mixed.drop("single"), "anchor").drop("context")
    contents = written(_with_bytes(docs, open_, length), "context-bytes")
    small, large = contents.filter(F.col("contexts") <= most_contexts), contents.filter(F.col("contexts") > most_contexts)
    return copied.unionByName(_sorted_spans(small, length)).unionByName(_counted_spans(large, length))


def removed_runs(start: np.ndarray, windows: np.ndarray, length: int) -> list[list[int]]:
    """Start and end of each maximal run of bytes that these runs of windows cover."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], np.maximum.accumulate((start + windows + (length - 1))[order])
    apart = begin[1:] > end[:-1]
    return np.stack([begin[np.append(True, apart)], end[np.append(apart, True)]], axis=1).tolist()


def deduped(docs: DataFrame, length: int = LENGTH, most_contexts: int = MOST_CONTEXTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, ``spans`` (array of start and end of each maximal removed run) and ``kept`` (binary)."""
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = given.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("version"), "text")
    spans = repeated_spans(keyed.select("doc", "version", "text"), length, most_contexts)
    gathered = spans.groupBy("doc", "version").agg(F.collect_set(F.struct("start", "windows")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, "text", SCANNED):
            out = []
            for value, found in zip(batch.column("text"), batch.column("found")):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                merged = removed_runs(*(found.values.field(c).to_numpy() for c in ("start", "windows")), length) if found.is_valid else []
                edges = [0, *(x for pair in merged for x in pair), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), merged, kept))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.list_(pa.int64()))), pa.array(columns[3], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return keyed.join(gathered, ["doc", "version"], "left").select("doc_id", "text", "found").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def kept_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of bytes, of removed ones, of removed runs, and the hash of the bytes that stay."""
    return deduped(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
