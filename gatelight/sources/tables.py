"""Sinks: result files, and tables that are switched whole or grown batch by batch.

Both table forms need nothing but a folder that every executor can reach. A
switched table is a folder per version plus a manifest; readers follow the newest
manifest entry, so a run that dies while writing changes nothing. A log is a folder
per batch; writing a batch again replaces it, so a retried batch counts once. A log of keyed
rows is bucketed by a hash of the key, so that a batch reads only the buckets it touches, and
is compacted into versions that its manifest names: a reader takes the newest version it
finds and the batches after it, whatever is compacted meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.operators.vectors import STORE_PARTITIONING, STORE_SORTING
from gatelight.session import remove_folder


def _missing(error: AnalysisException) -> bool:
    """Whether an error only says that nothing has been written yet."""
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def write_results(results: DataFrame, path: str, by: str | None = None) -> None:
    """Raw or judged rows as JSON lines, one folder per run when ``by`` is given."""
    writer = results.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def versions(spark: SparkSession, base: str) -> list[int]:
    """Published versions of a table, oldest first."""
    try:
        found = spark.read.schema("version int").json(f"{base}/manifest").select("version").distinct().collect()
    except AnalysisException as error:
        if not _missing(error):
            raise
        return []
    return sorted(r.version for r in found)


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    known = versions(spark, base)
    return spark.read.parquet(f"{base}/version={known[-1]}") if known else None


def publish(df: DataFrame, base: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), applied: tuple[str, ...] = ()) -> int:
    """Writes ``df`` beside the current version, then points the manifest at it.

    The manifest entry also names every migration the table has seen: those of the version
    before and the newly ``applied`` ones, so a migration counts exactly when its rows do.
    """
    spark = df.sparkSession
    version = (versions(spark, base) or [0])[-1] + 1
    known = sorted({*migrations(spark, base), *applied})
    ordered = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{base}/version={version}")
    entry = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"), F.lit(known).cast("array<string>").alias("migrations"))
    entry.coalesce(1).write.mode("append").json(f"{base}/manifest")
    return version


def migrations(spark: SparkSession, base: str) -> list[str]:
    """Keys of the migrations the current version has seen."""
    known = versions(spark, base)
    if not known:
        return []
    entries = spark.read.schema("version int, migrations array<string>").json(f"{base}/manifest").filter(F.col("version") == known[-1])
    return sorted({key for row in entries.collect() for key in row.migrations or ()})


def migrate(spark: SparkSession, base: str, key: str, change: Callable[[DataFrame], DataFrame]) -> bool:
    """Publishes the changed table once; where ``key`` has been applied, no row is read. Says whether it changed anything."""
    if key in migrations(spark, base):
        return False
    table = read_current(spark, base)
    if table is None:
        return False
    publish(change(table), base, applied=(key,))
    return True


def publish_store(chunks: DataFrame, base: str) -> int:
    """A chunk store in the layout retrieval prunes by."""
    return publish(chunks, base, STORE_PARTITIONING, STORE_SORTING)


#: Buckets of a keyed log; fixed for the life of a log.
BUCKETS = 64


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def append_batch(df: DataFrame, base: str, batch: int, key: str | None = None) -> None:
    """Writes one batch, in buckets of ``key`` where one is named; what the batch held before goes."""
    if key is None:
        df.write.mode("overwrite").parquet(f"{base}/batch={batch}")
    else:
        df.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/batch={batch}")


def batches(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the batches that are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(path)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def compactions(spark: SparkSession, base: str) -> list[tuple[int, int]]:
    """(version, last batch in it) of every published compaction, oldest first."""
    try:
        return sorted((r.version, r.upto) for r in spark.read.schema("version int, upto bigint").json(f"{base}/manifest").distinct().collect())
    except AnalysisException as error:
        if not _missing(error):
            raise
        return []


def read_log(spark: SparkSession, base: str, schema: str, before: int | None = None, buckets: list[int] | None = None, with_bucket: bool = False) -> DataFrame:
    """Rows of every batch (or those before one), with their batch number; of ``buckets`` only, where given."""
    whole = f"{schema}, batch bigint, bucket int"
    known = compactions(spark, base)
    version, upto = known[-1] if known else (None, -1)
    try:
        log = spark.read.option("basePath", base).schema(whole).parquet(f"{base}/batch=*").filter(F.col("batch") > upto)
    except AnalysisException as error:
        if not _missing(error):
            raise
        log = spark.createDataFrame([], whole)
    if before is not None:
        log = log.filter(F.col("batch") < before)
    if version is not None:
        log = log.unionByName(spark.read.schema(whole).parquet(f"{base}/compact/version={version}"))
    if buckets is not None:
        log = log.filter(F.col("bucket").isin(buckets))
    return log if with_bucket else log.drop("bucket")


def compact_log(spark: SparkSession, base: str, schema: str, keep: Callable[[DataFrame], DataFrame]) -> bool:
    """Publishes what ``keep`` leaves of all batches but the newest as a version. Says whether there was anything to do.

    The newest batch stays as it is, since it may be written again; ``keep`` gets and gives
    rows with their batch and bucket. Batches are not removed: :func:`vacuum` does that later.
    """
    there, known = batches(spark, base), compactions(spark, base)
    version, upto = known[-1] if known else (0, -1)
    last = max(there[:-1], default=-1)
    if last <= upto:
        return False
    rows = keep(read_log(spark, base, schema, before=last + 1, with_bucket=True))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/compact/version={version + 1}")
    entry = spark.range(1).select(F.lit(version + 1).alias("version"), F.lit(last).alias("upto"))
    entry.coalesce(1).write.mode("append").json(f"{base}/manifest")
    return True


def vacuum(spark: SparkSession, base: str) -> None:
    """Removes what only readers older than the last compaction but one could still read."""
    known = compactions(spark, base)
    if len(known) < 2:
        return
    version, upto = known[-2]
    for batch in batches(spark, base):
        if batch <= upto:
            remove_folder(spark, f"{base}/batch={batch}")
    for old, _ in known[:-2]:
        remove_folder(spark, f"{base}/compact/version={old}")
