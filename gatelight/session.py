"""Session defaults and the few settings the library reads from a session."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gatelight", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GATELIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # Plans are printed whole, however long the paths and ids in them are.
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local session that names none (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not (context.master or "").startswith("local") or (context.master or "").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="gatelight-shared-")
    return _made[context.applicationId]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy step enough tasks when its input is only a few files.

    A table of many files already arrives as many splits and is left alone, so
    nothing is shuffled at scale; a table of one or two files would otherwise be
    worked by one or two cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores, *keys)


# Rows up to which an id list is looked at before it is joined to a large table.
MAX_SMALL_ROWS = 100_000


def sized(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> tuple[DataFrame, bool]:
    """``df`` as a local table when it has at most ``max_rows`` rows, and whether it has.

    Spark knows a local table's exact size when it plans, so it broadcasts it by its
    own threshold and the large side of a join is not shuffled. Of a longer table no
    more than ``max_rows`` + 1 rows are fetched, and it stays distributed.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(head), True


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, for results that several later steps read."""
    path = f"{shared_dir(df.sparkSession)}/gatelight-saved/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def discard(table: DataFrame) -> None:
    """Removes a table made by :func:`saved`, once nothing reads it any more."""
    remove_folder(table.sparkSession, table.saved_at)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared one, by the file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets the Python workers of this session import the package, wherever they run.

    What ``--py-files`` does at submit time, for a session somebody else started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="gatelight-code-"), "gatelight"), "zip", root.parent, root.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
