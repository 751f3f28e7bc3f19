"""Registered queries of this folder, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatelight.llm import hard_negatives, line_dedup, phrases, vantage
from gatelight.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _registered(sql: str | None = None):
    def keep(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_registered()
def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import piece_codec

    return piece_codec.digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


@_registered()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import packing

    return packing.packed_pieces(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@_registered()
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import token_store
    from gatelight.llm.common import new_folder

    return token_store.stored_documents(_table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), _tokenizer("word_bpe_49k.json"))


@_registered(line_dedup.KEPT_LINES_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_lines(_table(spark, sf_dir, "documents"))


@_registered()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import quality

    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_registered()
def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import flac

    return flac.stored_media(_table(spark, sf_dir, "documents"))


@_registered()
def op10_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import wrapper

    return wrapper.main_texts(_table(spark, sf_dir, "pages"))


@_registered(vantage.NEIGHBOURS_SQL)
def op2_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.neighbours_of_every_hundredth(_table(spark, sf_dir, "embeddings"))


@_registered()
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import near_dup

    return near_dup.components_of(_table(spark, sf_dir, "documents"))


@_registered()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import secret_scan

    return secret_scan.found_secrets(_table(spark, sf_dir, "documents"))


@_registered(hard_negatives.MINED_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined_of_every_hundredth(_table(spark, sf_dir, "embeddings"))


@_registered(phrases.COLLOCATIONS_SQL)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


@_registered()
def op13_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatelight.llm import repeated_spans

    return repeated_spans.kept_digests(_table(spark, sf_dir, "documents"))
