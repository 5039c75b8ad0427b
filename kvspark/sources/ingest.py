"""Imports: ``key=value`` text, JSON batches, synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Request bodies. Every record needs key and value, as strings.
SET_BATCH = "records array<struct<key: string, value: string>>"
DELETE_BATCH = "keys array<string>"


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of rows (line, seq): trimmed; blank lines and ``#`` comments skipped; cut at the first ``=``.

    records: key, value, seq. errors: seq, line (no ``=``). A later line of one key wins by its ``seq``.
    """
    space = F.lit(" \t\r\n\x0b\x0c")
    rows = lines.select(F.btrim("line", space).alias("line"), "seq").where((F.length("line") > 0) & ~F.col("line").startswith("#"))
    at = F.instr("line", "=")
    records = rows.where(at > 0).select(F.btrim(F.substr("line", F.lit(1), at - 1), space).alias("key"), F.btrim(F.substr("line", at + 1), space).alias("value"), "seq")
    return records, rows.where(at == 0).select("seq", "line")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, seq) of text files: lines are numbered from 1 through all files, in the order of the files' addresses.

    Files are read in splits. A line's number is its place in its split after all lines of the splits before; only the
    splits' counts, one row a split, are put in order.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return lines.join(splits, ["file", "block"]).select("line", (F.col("base") + F.col("at") + 1).alias("seq"))


def import_text(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``parse_lines`` of text files; a later file's line wins over an earlier one's, and later lines within a file."""
    return parse_lines(numbered_lines(spark, path))


def synthetic(spark: SparkSession, n: int, width: int | None = None) -> DataFrame:
    """``batch:i`` -> ``value_i`` for i below n; ``width`` zero-pads the i of the key."""
    digits = F.col("id").cast("string")
    number = digits if width is None else F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return spark.range(n).select(F.concat(F.lit("batch:"), number).alias("key"), F.concat(F.lit("value_"), digits).alias("value"), F.col("id").alias("seq"))


def _parsed(bodies: DataFrame, column: str, schema: str, order: str | None) -> DataFrame:
    arrived = F.monotonically_increasing_id() if order is None else F.col(order)
    return bodies.select(arrived.alias("arrived"), F.from_json(F.col(column), schema, {"mode": "FAILFAST"}).alias("b"))


def json_puts(bodies: DataFrame, column: str = "body", order: str | None = None) -> DataFrame:
    """Records of JSON bodies ``{"records": [{"key": .., "value": ..}]}``: key, value, arrived, at.

    ``arrived`` ranks bodies: the column ``order``, else their place in the input; ``at`` is the place in the array. So
    ``struct(arrived, at)`` is the order of arrival over all bodies, for ``KVTable.write``.
    """
    return _parsed(bodies, column, SET_BATCH, order).select("arrived", F.posexplode("b.records").alias("at", "r")).select("r.key", "r.value", "arrived", F.col("at").cast("long").alias("at"))


def json_deletes(bodies: DataFrame, column: str = "body", order: str | None = None) -> DataFrame:
    """Keys of JSON bodies ``{"keys": [..]}`` as tombstones: key, value, is_deleted, arrived, at (see ``json_puts``)."""
    rows = _parsed(bodies, column, DELETE_BATCH, order).select("arrived", F.posexplode("b.keys").alias("at", "key"))
    return rows.select("key", F.lit("").alias("value"), F.lit(True).alias("is_deleted"), "arrived", F.col("at").cast("long").alias("at"))
