"""Result sinks: JSON envelopes and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lossy_text


def envelope(success: bool, message: str, data: object = None) -> dict:
    """The body of every HTTP answer; ``data`` is left out where there is none."""
    body: dict = {"success": success, "message": message}
    return body if data is None else body | {"data": data}


def json_rows(snapshot: DataFrame) -> DataFrame:
    """One JSON document a record, values as lossy text."""
    return snapshot.select(F.to_json(F.struct("key", lossy_text("value").alias("value"))).alias("json"))


def json_envelope(success: Column, message: Column, data: Column) -> Column:
    """The envelope as a column: a null ``data`` is left out."""
    return F.to_json(F.struct(success.alias("success"), message.alias("message"), data.alias("data")))


def export_text(snapshot: DataFrame, path: str) -> None:
    """``key=value`` lines in key order, which ``import_text`` reads back where neither holds a line feed or edge blanks."""
    snapshot.orderBy("key").select(F.concat("key", F.lit("="), lossy_text("value"))).write.text(path)
