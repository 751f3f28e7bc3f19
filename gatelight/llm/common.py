"""What several operators of this folder share: batches, folders, id order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.session import shared_dir


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, text: str | None = None, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of at most ``rows`` rows and, where ``text`` names a column, about ``max_bytes`` of it.

    A slice holds at least one row, so one very long text is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = 0
        sizes = None
        if text is not None:
            sizes = [0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()]
        while at < batch.num_rows:
            end = min(at + rows, batch.num_rows)
            if sizes is not None:
                total, end_by_size = sizes[at], at + 1
                while end_by_size < end and total + sizes[end_by_size] <= max_bytes:
                    total += sizes[end_by_size]
                    end_by_size += 1
                end = end_by_size
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of one column; null reads as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, below the folder that driver and executors share."""
    return f"{shared_dir(spark)}/gatelight-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor costs nothing that is done."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so other columns can be named as they like."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def packed_longs(values) -> pa.Array:
    """A list of NumPy int arrays as one Arrow list column of 64-bit integers."""
    import numpy as np

    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values).astype(np.int64) if len(values) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def packed_ints(values) -> pa.Array:
    """A list of NumPy int arrays as one Arrow list column of 32-bit integers."""
    import numpy as np

    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values).astype(np.int32) if len(values) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
