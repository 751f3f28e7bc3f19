"""Reading: corpus folders, encoded texts, JSON lines, answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.functions import text as tx
from gatelight.operators.registry import supported_files
from gatelight.sources.shared import opened

# Encodings in the order they are tried.
ENCODINGS = ("utf-8", "cp932", "utf-16")

QUESTION_SCHEMA = (
    "id string, question string, expected_answer_keywords array<string>, expected_sources array<string>, "
    "user_access_level int, category string, should_refuse boolean"
)
NUGGET_SCHEMA = (
    "qid string, set string, rule_id string, question string, "
    "nuggets array<struct<nid:string,text:string,importance:string,quote:string,keywords:array<string>>>, "
    "excluded array<struct<text:string,why:string>>, drafted_by string, reviewed_by string, version string"
)


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below ``root``: source_path, file_type, content (bytes), mtime."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.regexp_replace("path", r"\Afile:/*", "/").alias("source_path"),
            "content",
            F.col("modificationTime").alias("mtime"),
        )
    )
    return supported_files(found)


def _decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        return text.replace("\r\n", "\n").replace("\r", "\n")
    return data.decode("utf-8", errors="replace")


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Bytes to text. Valid UTF-8 is decoded natively; only the rest goes to Python.

    Line ends become one kind, except in the last resort (replacement characters).
    """

    @F.pandas_udf("string")
    def other(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: _decode(bytes(b)), na_action="ignore")

    plain = F.col(content).cast("string")
    valid = F.is_valid_utf8(plain)
    native = F.regexp_replace(plain, "\r\n?", "\n")
    return df.withColumn(content, F.when(valid, native).otherwise(other(F.when(~valid, F.col(content)))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Strict JSON lines: (rows, errors). Blank lines are skipped; a line that is no
    JSON object is an error row with its file, its number in it (from 1) and its text.

    Files are read in splits of any size: a line's number is its place in its split, after
    the lines of the file's earlier splits.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    # A split is read by one task from its first line to its last, so its numbers are a row's own and without gaps.
    read = spark.read.option("lineSep", "\n").text(path).select(*split, F.monotonically_increasing_id().alias("at"), "value")
    blocks = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    lines = read.join(blocks.select("file", "block", (earlier - F.col("first") + 1).alias("shift")), ["file", "block"])
    lines = lines.select("file", (F.col("at") + F.col("shift")).alias("number"), F.btrim("value", F.lit(" \t\r")).alias("line")).filter("line <> ''")
    bad = tx.json_value(F.col("line")).isNull() | (F.substring("line", 1, 1) != "{")
    rows = lines.filter(~bad).select("file", F.from_json("line", schema).alias("r")).select("file", "r.*")
    return rows, lines.filter(bad)


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A question set: (questions, errors). Blank lines are skipped; malformed lines are errors, not empty questions."""
    rows, errors = read_jsonl(spark, path, QUESTION_SCHEMA)
    return rows.drop("file"), errors


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """``<rule_id>.md`` files as rule_id, body."""
    texts = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return texts.select(
        F.regexp_extract("_metadata.file_name", r"\A(.*)\.md\z", 1).alias("rule_id"), F.col("value").alias("body")
    )


def write_rules(rules: DataFrame, folder: str) -> int:
    """One ``<rule_id>.md`` per row, written by the tasks; gives their number. Ids are file names, so they hold no slash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for rule_id, body in zip(batch.column("rule_id").to_pylist(), batch.column("body").to_pylist()):
                if not rule_id or "/" in rule_id:
                    raise ValueError(f"no file name: {rule_id!r}")
                with store.open_output_stream(f"{root}/{rule_id}.md") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rules.select("rule_id", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_answers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, errors) from rows of qid|id, text|answer, run and the file's stem.

    A missing field or a qid that is twice in one file is an error; repeats are
    counted per key, not collected.
    """
    rows = raw.select(
        "stem",
        F.coalesce("qid", "id").alias("qid"),
        F.coalesce("text", "answer").alias("text"),
        F.coalesce(F.when(F.col("run") != "", F.col("run")), F.col("stem")).alias("run"),
    )
    missing = F.col("qid").isNull() | F.col("text").isNull()
    repeated = rows.filter(~missing).groupBy("stem", "qid").agg(F.count("*").alias("n")).filter("n > 1")
    errors = rows.filter(missing).select("stem", "qid", F.lit("field missing").alias("problem")).unionByName(
        repeated.select("stem", "qid", F.lit("qid repeated").alias("problem"))
    )
    good = rows.filter(~missing).join(repeated.select("stem", "qid"), ["stem", "qid"], "left_anti")
    return good.select("run", "qid", "text"), errors


def load_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Answer files, one run each: (answers, errors)."""
    rows, bad = read_jsonl(spark, path, "qid string, id string, text string, answer string, run string")
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?\z", 1)
    good, errors = read_answers(rows.withColumn("stem", stem))
    broken = bad.select(stem.alias("stem"), F.lit(None).cast("string").alias("qid"), F.lit("no JSON object").alias("problem"))
    return good, errors.unionByName(broken)
