"""Dropping lines that other documents hold too.

1. Every line of at least ``min_chars`` characters becomes two 64-bit hashes of its key;
   per pair of hashes the documents are counted and the smallest id is found, with partial
   counts before the shuffle. No line crosses the network, and no list of documents is made.
2. The lines of two or more documents are indexed, in shards of bounded size: a minimal
   perfect hash over the first hash, and by slot the second hash as a fingerprint, the
   number of rows that hold the line, and the smallest id. Lines of one document need no
   entry, since their probes fail the fingerprint.
3. Probes (document, place, hashes) meet the arrays of their shard in sorted order: the
   arrays come first, probes stream past them. Shards are salted by document, so a line
   that a third of all documents hold is probed in ``salts`` places.
4. Only places to drop come back to their documents.

Null and empty texts are one empty line. Rows without an id count for no line and keep all
of theirs. Rows that share an id are one document. Other columns pass through untouched
inside ``row``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.llm.common import written
from gatelight.llm.perfect_hash import PerfectHash

BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "shard int, slots binary, fingerprints binary, counts binary, firsts binary"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), _UPPER, _LOWER)


def _long_lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, version, place, h1, h2) of every line that may be dropped; ``version`` tells texts of one id apart."""
    lines = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "line")
    )
    keyed = lines.select("doc_id", "version", "place", line_key(F.col("line")).alias("k")).filter(F.char_length("k") >= min_chars)
    return keyed.select("doc_id", "version", "place", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(17), "k").alias("h2"))


def _repeated(lines: DataFrame) -> DataFrame:
    """The hashes that at least two documents hold, with the number of rows and the smallest id."""
    rows = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return rows.filter("first <> last").drop("last")


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """One row of arrays per shard of repeated lines."""

    def build(keys: tuple, table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        # Lines that share the first hash share a slot; the rare second ones are kept beside the slots.
        order = np.lexsort((h2, h1))
        first_of = order[np.append(True, h1[order][1:] != h1[order][:-1])] if len(order) else order
        extra = np.setdiff1d(np.arange(len(h1)), first_of)
        found = PerfectHash.over(h1[first_of])
        place = np.concatenate([first_of[np.argsort(found.slots(h1[first_of]))], extra])
        keep = [h2[place].tobytes(), table.column("n").to_numpy()[place].astype("<u8").tobytes(), table.column("first").to_numpy()[place].astype("<i8").tobytes()]
        slots = found.to_bytes()
        return pa.table([pa.array([keys[0].as_py()], pa.int32()), *[pa.array([b], pa.large_binary() if len(b) >= 1 << 31 else pa.binary()) for b in (slots, *keep)]], names=["shard", "slots", "fingerprints", "counts", "firsts"])

    sharded = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(build, _INDEX)


class _Arrays:
    """The arrays of one shard, to be probed."""

    def __init__(self, slots: bytes, fingerprints: bytes, counts: bytes, firsts: bytes) -> None:
        self.hash = PerfectHash.from_bytes(slots)
        self.fingerprints, self.counts, self.firsts = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u8"), np.frombuffer(firsts, "<i8")
        self.extra = {int(h): i for i, h in enumerate(self.fingerprints[self.hash.size :], self.hash.size)}

    def first(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is repeated, and the smallest document that holds it."""
        at = self.hash.slots(h1)
        known = (at >= 0) & (self.fingerprints[at] == h2)
        for i in np.flatnonzero(~known) if self.extra else ():
            if int(h2[i]) in self.extra:
                at[i], known[i] = self.extra[int(h2[i])], True
        return known, self.firsts[at]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays, shard = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        tags = batch.column("tag").to_numpy()
        cuts = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (tags[1:] == 0)))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shards)]):
            if tags[a] == 0:
                shard = shards[a]
                arrays = _Arrays(*(batch.column(c)[a].as_py() for c in ("slots", "fingerprints", "counts", "firsts")))
                a += 1
            if a == b or shard != shards[a]:
                continue  # no line of this shard is repeated
            part = batch.slice(a, b - a)
            h1, h2 = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
            doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            known, first = arrays.first(h1, h2)
            drop = pa.array(known & (first != doc))
            if drop.true_count:
                yield part.filter(drop).select(["doc_id", "version", "place"])


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, lines_per_shard: int = 500_000, salts: int = 16) -> DataFrame:
    """``row`` (the document with the text that stays), ``n_lines`` before and ``n_dropped``."""
    lines = _long_lines(docs, key, text, min_chars)
    repeated = written(_repeated(lines), "repeated-lines")
    shards = max(16, -(-repeated.count() // lines_per_shard))
    index = build_index(repeated, shards)
    salted = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("tag"), *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("version", "long"), ("place", "int"), ("h1", "long"), ("h2", "long"))], "slots", "fingerprints", "counts", "firsts")
    probes = lines.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("tag"), "doc_id", "version", "place", "h1", "h2", *[F.lit(None).cast("binary").alias(c) for c in ("slots", "fingerprints", "counts", "firsts")])
    met = salted.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "tag")
    places = met.mapInArrow(_probe, "doc_id long, version long, place int").groupBy("doc_id", "version").agg(F.collect_set("place").alias("places"))

    whole = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.{key}").cast("long").alias("doc_id"), F.xxhash64(F.col(f"row.{text}")).alias("version"))
    joined = whole.join(places, ["doc_id", "version"], "left").select("row", "places")
    schema = T.StructType([T.StructField("row", docs_struct(docs), True), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                rows, places = batch.column("row"), batch.column("places").to_pylist()
                fields = rows.flatten()
                where = [f.name for f in rows.type].index(text)
                kept, counts, dropped = [], [], []
                for value, gone in zip(fields[where].to_pylist(), places):
                    parts = ("" if value is None else value).split("\n")
                    out = set(gone or ())
                    kept.append("\n".join([p for i, p in enumerate(parts) if i not in out]) if out else value)
                    counts.append(len(parts))
                    dropped.append(len(out))
                fields[where] = pa.array(kept, fields[where].type)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(rows.type)), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["row", "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, schema)


def docs_struct(docs: DataFrame) -> T.StructType:
    """The type of a whole row; every field may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])


def kept_lines(docs: DataFrame) -> DataFrame:
    """Per document the number of lines, of dropped lines, and the hash of the text that stays."""
    return dedupe(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


KEPT_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (first <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id"""
