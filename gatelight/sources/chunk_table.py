"""A chunk table in buckets of the document id, changed bucket by bucket.

A version is a folder with the buckets it wrote, each sorted by document and chunk; the
manifest says which. A bucket's rows are those of the newest published version that wrote
it. So a lookup or a change for some documents reads, and a change writes, only the buckets
those documents fall into, whatever their number; nothing of the rest is joined, shuffled or
copied, and a run that dies before its manifest entry changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.operators import store
from gatelight.sources.tables import BUCKETS, _missing, bucket_of

KEY = "document_id"


def _entries(spark: SparkSession, base: str) -> list:
    try:
        return spark.read.schema("version int, buckets array<int>").json(f"{base}/manifest").collect()
    except AnalysisException as error:
        if not _missing(error):
            raise
        return []


def _newest(spark: SparkSession, base: str) -> dict[int, int]:
    """Version of each bucket: a small table, as there are at most ``BUCKETS`` of them."""
    newest: dict[int, int] = {}
    for entry in _entries(spark, base):
        for bucket in entry.buckets:
            newest[bucket] = max(entry.version, newest.get(bucket, 0))
    return newest


def _write(rows: DataFrame, base: str, buckets: list[int]) -> int:
    spark = rows.sparkSession
    version = max((e.version for e in _entries(spark, base)), default=0) + 1
    placed = rows.withColumn("bucket", bucket_of(F.col(KEY))).repartition("bucket").sortWithinPartitions("bucket", KEY, "chunk_index")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/version={version}")
    entry = spark.range(1).select(F.lit(version).alias("version"), F.lit(buckets).cast("array<int>").alias("buckets"))
    entry.coalesce(1).write.mode("append").json(f"{base}/manifest")
    return version


def publish(rows: DataFrame, base: str) -> int:
    """The whole table anew. Rows need a document_id."""
    return _write(rows, base, list(range(BUCKETS)))


def buckets_of(documents: DataFrame) -> list[int]:
    """Numbers of the buckets that some documents fall into; ids stay where they are."""
    return sorted(r.bucket for r in documents.select(bucket_of(F.col(KEY)).alias("bucket")).distinct().collect())


def read(spark: SparkSession, base: str, schema: T.StructType | str, buckets: list[int] | None = None) -> DataFrame:
    """The current rows, of some buckets or of all."""
    wanted = {b: v for b, v in _newest(spark, base).items() if buckets is None or b in buckets}
    table = None
    for version in sorted(set(wanted.values())):
        held = [b for b, v in wanted.items() if v == version]
        part = spark.read.schema(f"{_ddl(schema)}, bucket int").parquet(f"{base}/version={version}").filter(F.col("bucket").isin(held)).drop("bucket")
        table = part if table is None else table.unionByName(part)
    return spark.createDataFrame([], _ddl(schema)) if table is None else table


def _ddl(schema: T.StructType | str) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def change(spark: SparkSession, base: str, schema: T.StructType | str, documents: DataFrame, how: Callable[[DataFrame], DataFrame]) -> int:
    """``how`` applied to the buckets of ``documents``; rows it adds must be of those documents. Gives the number of buckets written."""
    touched = buckets_of(documents)
    if touched:
        _write(how(read(spark, base, schema, touched)), base, touched)
    return len(touched)


def deactivate(spark: SparkSession, base: str, schema: T.StructType | str, documents: DataFrame) -> int:
    return change(spark, base, schema, documents, lambda rows: store.deactivate(rows, documents))


def delete(spark: SparkSession, base: str, schema: T.StructType | str, documents: DataFrame) -> int:
    return change(spark, base, schema, documents, lambda rows: store.delete(rows, documents))


def propagate(spark: SparkSession, base: str, schema: T.StructType | str, changes: DataFrame) -> int:
    return change(spark, base, schema, changes, lambda rows: store.propagate(rows, changes))


def apply_generation(spark: SparkSession, base: str, new_chunks: DataFrame, touched: DataFrame | None = None) -> int:
    """The new rows become their documents' only rows."""
    return change(spark, base, new_chunks.schema, new_chunks if touched is None else touched, lambda rows: store.apply_generation(rows, new_chunks, touched))


def lookup(spark: SparkSession, base: str, schema: T.StructType | str, keys: DataFrame) -> DataFrame:
    """Content of (document_id, chunk_index) points, from their buckets."""
    return store.lookup(read(spark, base, schema, buckets_of(keys)), keys)
