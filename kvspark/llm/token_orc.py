"""Token-ID output as ORC: integer run-length encoded ids, row indexes, and a Bloom filter on doc_id.

Files hold ascending doc_id ranges, one file a range, rows in order. ORC's own writer does the encoding: columns of
integers are run-length encoded within stripes, every ``row_group`` rows get min/max entries, and the Bloom filter
lets a reader that looks for one document skip the row groups of files whose range holds its id. Stripes are the unit
of parallel reads, so one large file is read by many tasks.

Edge cases: a null text has the end id only; a null doc_id sorts first; repeated doc_ids are ordered by text; an empty
table writes no file and reads back as no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_width, slices, text_or_empty
from .tokens import encoder

#: A scan that does nothing else has the memory for a larger memo of words.
MEMO = 250_000
SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, stripe_bytes: int = 16 << 20, row_group: int = 2000, bloom_fpp: float = 0.01) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending doc_id order to ``path``.

    The texts are dealt by range before they are encoded (the range sampler then reads ids from a plain scan, and
    ids are encoded once, in file order).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, at = encoder(vocabulary, MEMO), 0
        for batch in slices(batches, "text", 6 << 20):
            ids, offsets = to_ids(batch.column("text"))
            n = len(offsets) - 1
            ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
            offsets = offsets + np.arange(n + 1)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets)), lists], ["doc_id", "file_start", "n_tokens", "ids"])
            at += int(offsets[-1])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    (
        source.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp)).option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_group)).option("orc.stripe.size", str(stripe_bytes)).option("orc.compress", "SNAPPY").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; ``doc_ids`` is pushed into the ORC reader, which skips by min/max and Bloom filter."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): how many ids the files before each file hold. One row a file."""
    files = (
        spark.read.schema(SCHEMA).orc(path).select(F.col("_metadata.file_name").alias("file"), "n_tokens")
        .groupBy("file").agg(F.sum("n_tokens").alias("total"))
    )
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            view = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("file_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "file", "file_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", F.col("_metadata.file_name").alias("file"), "file_start", "ids")
    rows = rows.mapInArrow(digest, "doc_id long, file string, file_start long, n_tokens long, ids_crc32 long")
    return rows.join(token_starts(spark, path), "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write all of ``docs`` in this format to the shared folder and digest what the files hold."""
    path = scratch_path(docs.sparkSession, "tokens.orc")
    write_tokens(docs, path, vocabulary, end_id)
    return token_digest(docs.sparkSession, path)
