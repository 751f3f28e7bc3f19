"""Sparse and dense vectors of chunks and questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.functions import text as tx

# The prefixes the encoder family expects.
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "

# Numbers of a dense vector that is folded from a sparse one.
DIMS = 64

STORE_FIELDS = {
    "document_id": T.StringType(),
    "chunk_index": T.IntegerType(),
    "content": T.StringType(),
    "source_file": T.StringType(),
    "access_level": T.IntegerType(),
    "is_active": T.BooleanType(),
    "index_version": T.IntegerType(),
    "unclassified": T.BooleanType(),
    "dense": T.ArrayType(T.FloatType()),
    "sparse": T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])),
}
# Layout of the written store: partition columns prune, sort columns let row groups be skipped.
STORE_PARTITIONING = ("access_level", "is_active")
STORE_SORTING = ("document_id", "index_version", "chunk_index")


def build_sparse(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("sparse", tx.sparse_vector(F.col(text)))


def postings(df: DataFrame) -> DataFrame:
    """Long form of the sparse column: one row per (chunk, id), the inverted index.

    The outer form, filtered after: for the plain one Spark also tests the array's size
    first, and so builds an array that is not stored twice.
    """
    keys = [c for c in df.columns if c != "sparse"]
    long = df.select(*keys, F.inline_outer("sparse")).withColumnsRenamed({"i": "token_id", "v": "weight"})
    return long.filter(F.col("token_id").isNotNull())


def embed(
    df: DataFrame,
    encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    is_query: bool,
    text: str = "content",
    prefixes: tuple[str, str] = (QUERY_PREFIX, PASSAGE_PREFIX),
) -> DataFrame:
    """Dense vectors from any model.

    ``encoder()`` loads the model and is called once per Python worker; what it
    returns maps a list of texts to a matrix. Rows are scaled to unit length.
    """
    prefix = prefixes[0] if is_query else prefixes[1]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            rows = np.asarray(encode([prefix + (t or "") for t in batch]), dtype=np.float64)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list((rows / np.where(norm == 0, 1, norm)).astype(np.float32)))

    return df.withColumn("dense", run(F.col(text)))


def folded(batch: pa.RecordBatch, dims: int = DIMS) -> pa.RecordBatch:
    """The batch with the ``dense`` column of :func:`project_sparse`."""
    n = batch.num_rows
    vectors = batch.column("sparse")
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    ids = flat.field("i").to_numpy(zero_copy_only=False).astype(np.int64)
    weights = flat.field("v").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lengths)
    signed = np.where((ids // dims) % 2 == 0, weights, -weights)
    table = np.bincount(row * dims + ids % dims, weights=signed, minlength=n * dims).reshape(n, dims)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.where(norm == 0, 1, norm)
    stops = pa.array(np.arange(0, (n + 1) * dims, dims, dtype=np.int32))
    return batch.append_column("dense", pa.ListArray.from_arrays(stops, pa.array(table.ravel())))


def project_sparse(df: DataFrame, dims: int = DIMS) -> DataFrame:
    """Model-free ``dense`` column: signed folding of the sparse ids into ``dims`` numbers.

    Dimension ``id mod dims``, sign by the parity of ``id div dims``, unit length.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield folded(batch, dims)

    schema = T.StructType(df.schema.fields + [T.StructField("dense", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(fold, schema)


def store_problems(df: DataFrame, dims: int | None = None) -> list[str]:
    """Why a table cannot serve as chunk store; empty when it can."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for name, wanted in STORE_FIELDS.items():
        if name not in have:
            problems.append(f"missing column {name}")
        elif name == "dense":
            if not isinstance(have[name], T.ArrayType) or not isinstance(
                have[name].elementType, (T.FloatType, T.DoubleType)
            ):
                problems.append(f"column {name} is {have[name].simpleString()}")
        elif have[name].simpleString() != wanted.simpleString():
            problems.append(f"column {name} is {have[name].simpleString()}")
    if dims is not None and "dense" in have and not problems:
        wrong = df.filter(F.size("dense") != dims).limit(1).count()
        if wrong:
            problems.append(f"dense vectors are not all of length {dims}")
    return problems
