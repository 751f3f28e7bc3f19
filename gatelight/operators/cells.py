"""Spreadsheet cells as rows: merged ranges and text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: heading of a sheet's text.
SHEET_TITLE = "## シート: "
ROWS_PER_BUCKET = 1024


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Empty cells inside a merged range take its top-left value; others keep theirs.

    ``cells``: document_id, sheet, row, col, value; ``ranges``: document_id, sheet,
    min_row, max_row, min_col, max_col. A range is spread over its columns and over
    buckets of rows, so the range test runs inside an equi-join and a large sheet is
    split by column and bucket. Merged ranges of one sheet do not overlap.
    """
    bucket = F.floor(F.col("row") / ROWS_PER_BUCKET)
    top = cells.select(
        "document_id", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("top_value")
    )
    spread = (
        ranges.join(top, ["document_id", "sheet", "min_row", "min_col"])
        .withColumn("col", F.explode(F.sequence("min_col", "max_col")))
        .withColumn(
            "bucket",
            F.explode(F.sequence(F.floor(F.col("min_row") / ROWS_PER_BUCKET), F.floor(F.col("max_row") / ROWS_PER_BUCKET))),
        )
        .select("document_id", "sheet", "col", "bucket", "min_row", "max_row", "top_value")
    )
    empty = cells.filter(F.col("value").isNull()).withColumn("bucket", bucket)
    inside = F.col("row").between(F.col("r.min_row"), F.col("r.max_row"))
    same = [F.col(f"e.{c}") == F.col(f"r.{c}") for c in ("document_id", "sheet", "col", "bucket")]
    condition = same[0] & same[1] & same[2] & same[3] & inside
    filled = empty.alias("e").join(spread.alias("r"), condition, "left").select(
        "e.document_id", "e.sheet", "e.row", "e.col", F.col("r.top_value").alias("value")
    )
    kept = cells.filter(F.col("value").isNotNull()).select("document_id", "sheet", "row", "col", "value")
    return kept.unionByName(filled)


def sheet_lines(cells: DataFrame) -> DataFrame:
    """One table line per sheet row; the first row is the head and brings the rule below it."""
    cell = F.struct("col", F.coalesce("value", F.lit("")).alias("v"))
    texts = F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"])
    lines = cells.groupBy("document_id", "sheet", "row").agg(texts.alias("texts"))
    first = cells.groupBy("document_id", "sheet").agg(F.min("row").alias("head_row"))
    line = F.concat(F.lit("| "), F.array_join("texts", " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.array_join(F.transform("texts", lambda t: F.lit("---")), "|"), F.lit("|"))
    return lines.join(first, ["document_id", "sheet"]).select(
        "document_id", "sheet", "row",
        F.when(F.col("row") == F.col("head_row"), F.concat(line, rule)).otherwise(line).alias("line"),
    )


def sheets_to_text(cells: DataFrame) -> DataFrame:
    """One text per document: every sheet under its title, sheets a blank line apart.

    A row of a sheet is put together first; what is then grouped per sheet and per
    document is the text that the result holds anyway.
    """
    def in_order(key: str, value: str):
        return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda e: e[value])

    sheets = sheet_lines(cells).groupBy("document_id", "sheet").agg(
        F.concat(F.lit(SHEET_TITLE), F.first("sheet"), F.lit("\n"), F.array_join(in_order("row", "line"), "\n")).alias("text")
    )
    return sheets.groupBy("document_id").agg(F.array_join(in_order("sheet", "text"), "\n\n").alias("content"))
