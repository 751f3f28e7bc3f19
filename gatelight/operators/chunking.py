"""Sentence-aware chunks with overlap.

Each cut depends on the one before, so a document is walked from front to back;
Spark spreads the documents and only this walk is Python.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.functions import text as tx

SPARSE_TYPE = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())]))

# Separators in order of preference, and how far around the
# wished end a separator is looked for.
SEPARATORS = ("。\n", "。", "\n\n", "\n", "．", ". ")
REACH = 30

# Documents whose chunks are held at once.
DOCUMENTS_PER_STEP = 256

_BREAKS = tuple(re.compile(re.escape(s)) for s in SEPARATORS)
_MANY_NEWLINES = re.compile(r"\n{3,}")


def split_text(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Chunks of one text, in order, empties left out (an empty text is one chunk)."""
    text = _MANY_NEWLINES.sub("\n\n", text).strip()
    length = len(text)
    if length <= size:
        return [text]
    # Where every separator ends, per rank; a window is then two binary searches.
    stops = [[m.end() for m in b.finditer(text)] for b in _BREAKS]
    pieces, begin = [], 0
    while begin < length:
        wished = begin + size
        stop = wished
        if wished < length:
            low, high = max(wished - REACH, begin), wished + REACH
            for mark, ends in zip(SEPARATORS, stops):
                at = bisect_right(ends, high) - 1
                if at >= 0 and ends[at] - len(mark) >= low:
                    stop = ends[at]
                    break
        piece = text[begin:stop].strip()
        if piece:
            pieces.append(piece)
        begin = max(stop - overlap, begin + 1)
    return pieces


def chunk_text(df: DataFrame, size: int = 500, overlap: int = 50, text: str = "content", sparse: bool = False) -> DataFrame:
    """One row per chunk: the other columns of ``df``, ``chunk_index`` and ``content``.

    ``sparse`` adds the chunks' sparse vectors (:func:`text.sparse_vector`), counted by the worker that cuts them.
    """
    if size <= 0:
        raise ValueError(f"a chunk of {size} characters holds nothing")
    if not 0 <= overlap < size:
        raise ValueError(f"chunks of {size} characters cannot share {overlap}")
    kept = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in kept]
    fields = [T.StructField(f.name, f.dataType, True) for f in kept]
    schema = T.StructType([*fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    if sparse:
        schema = schema.add("sparse", SPARSE_TYPE)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tx.TokenIds()
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_PER_STEP):
                batch = whole.slice(at, DOCUMENTS_PER_STEP)
                lists = [split_text(t or "", size, overlap) for t in batch.column(text).to_pylist()]
                # The other columns stay as Arrow holds them; rows are only repeated.
                row = pa.array([n for n, pieces in enumerate(lists) for _ in pieces], pa.int64())
                place = pa.array([k for pieces in lists for k in range(len(pieces))], pa.int32())
                content = pa.array([piece for pieces in lists for piece in pieces], pa.string())
                found = {**{n: batch.column(n).take(row) for n in names}, "chunk_index": place, "content": content}
                if sparse:
                    found["sparse"] = tx.counted_ids(content, ids)
                yield pa.RecordBatch.from_pydict(found)

    return df.select(*names, text).mapInArrow(walk, schema)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
