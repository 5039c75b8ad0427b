"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ftrl, gam, lines, omh, packing, simhash, spm, token_orc, warc
from .common import ship_code, table
from .tokens import default_vocabulary


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.Plan(shingle=3, bits=64, distance=3, segment_bits=32, segments=2))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(table(spark, sf_dir, "documents"), spm.default_model())


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.neighbour_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=0, capacity=2048)


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokenized(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=1)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digest(spark, table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.rate(table(spark, sf_dir, "documents")).drop("clean_text")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_order_minhash": op3_order_minhash,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_token_orc": op6_token_orc,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_line_rules": op10_line_rules,
}

_SQL: dict[str, str] = {"op4_warc": warc.SQL, "op7_chat": chat.SQL, "op10_line_rules": lines.SQL}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
