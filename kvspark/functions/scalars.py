"""Column functions used by the engine and its front ends; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lossy_text(value: Column | str) -> Column:
    """Bytes as text; invalid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8((F.col(value) if isinstance(value, str) else value).cast("string"))


def strict_text(value: Column | str) -> Column:
    """Bytes as text; invalid UTF-8 is an error."""
    return F.validate_utf8((F.col(value) if isinstance(value, str) else value).cast("string"))


def display(text: Column | str, width: int = 20) -> Column:
    """At most ``width`` characters: longer texts end in three dots. Counts characters, so none is cut apart."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def zero_padded(number: Column | str, width: int = 6) -> Column:
    """Decimal digits, zero-padded to ``width``; longer numbers are not cut."""
    digits = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def token_hash(token: Column | str) -> Column:
    return F.sha2((F.col(token) if isinstance(token, str) else token).cast("binary"), 256)


def kilobytes(n: Column) -> Column:
    """Whole KiB, rounded down."""
    return F.floor(n / 1024).cast("long")


def older_than(ts_ns: Column, now_ns: int, days: int) -> Column:
    return ts_ns < F.lit(now_ns - days * 86_400 * 10**9)


def uptime(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def split_command(line: Column) -> Column:
    """verb, first argument, rest: at most three parts, cut at single spaces; the verb in upper case."""
    parts = F.split(line, " ", 3)
    return F.struct(F.upper(F.get(parts, F.lit(0))).alias("verb"), F.get(parts, F.lit(1)).alias("arg"), F.get(parts, F.lit(2)).alias("rest"))
