"""The corpus pipeline: quality, line dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents``; the last one returns token windows. ``run`` writes every stage as Parquet in
the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.llm import line_dedup, near_dup, packing, quality, secret_scan
from gatelight.llm.common import new_folder
from gatelight.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, row: str, text) -> DataFrame:
    """The columns of a document held in ``row``, with another text and its length."""
    length = F.when(text.isNull(), F.col(f"{row}.n_chars")).otherwise(F.char_length(text)).cast("long")
    fields = {"text": text, "n_chars": length}
    return docs.select(*[fields.get(c, F.col(f"{row}.{c}")).alias(c) for c in COLUMNS])


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject. It learns from the given labels of the given documents."""
    ship_package(spark)
    given, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.scorer(quality.train(given, labels))
    return docs.select(*COLUMNS).filter(score(F.col("text").cast("string")) >= quality.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds too."""
    ship_package(spark)
    return _with_text(line_dedup.dedupe(docs.select(*COLUMNS)), "row", F.col("row.text"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: similarity of five-word shingles 0.8 or more."""
    ship_package(spark)
    dropped = near_dup.linked(docs, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every found secret masked."""
    table = secret_scan.train(secret_scan.labelled_samples(docs))
    scanned = secret_scan.scan(docs.select(*COLUMNS), table)
    text = F.when(F.size("spans") > 0, secret_scan.masked(F.col("text"), F.col("spans"))).otherwise(F.col("row.text"))
    return _with_text(scanned, "row", text)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 4096 ids."""
    import public_tokenizers

    ship_package(spark)
    return packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good_texts),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", keep_one_of_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: Trained scores and token ids are beyond SQL; tests/llm/test_pipeline.py compares with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
