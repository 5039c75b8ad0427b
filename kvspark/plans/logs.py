"""Version logs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_log


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return as_log(e, F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.col("props"), F.col("event_id"), F.col("event_type") == "error")


def user_cut(spark: SparkSession, sf_dir: str) -> int:
    """The middle of the user log's sequence numbers."""
    last = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return 0 if last is None else (last + 1) // 2


def user_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log in two runs, 0 and 1, cut in the middle."""
    return user_log(spark, sf_dir).withColumn("run_id", (F.col("seq") >= user_cut(spark, sf_dir)).cast("long"))


def customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return as_log(o, F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")), F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_orderstatus") == "F")


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return as_log(d, F.concat_ws(":", F.lit("doc"), "lang", "source", F.col("doc_id").cast("string")), F.col("text"), F.col("doc_id"))


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(p := _table(spark, sf_dir, "pages"), p.url, p.html, p.page_id)


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    number = F.col("turn").cast("string")
    padded = F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))
    return as_log(c, F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), padded), F.col("text"), F.col("conv_id") * 10000 + F.col("turn"))
