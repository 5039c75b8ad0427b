"""Shared storage, table access and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words in every operator here.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, notebooks) is a local folder made and set.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kvspark-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_quietly_remove, spark, root)
    return root.rstrip("/")


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone at interpreter exit; nothing depends on this clean-up
        pass


#: Folders of this process in the shared folder. Results of queries read them, so they stay until ``clear_scratch``.
_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new full address in the shared folder, in a folder of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/kvspark-{uuid.uuid4().hex}/{name}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not _SCRATCH:
        atexit.register(clear_scratch, spark)
    _SCRATCH.add(full.rpartition("/")[0])
    return full


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder; also done when the interpreter ends."""
    while _SCRATCH:
        _quietly_remove(spark, _SCRATCH.pop())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kvspark_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables whose consumers have been written."""
    for df in frames:
        if path := getattr(df, "_kvspark_path", None):
            folder = path.rpartition("/")[0]
            remove(df.sparkSession, folder)
            _SCRATCH.discard(folder)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.make_valid_utf8(F.col(name)), F.lit(""))


def smallest_by_hash(rows: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows: those with the smallest hash of ``column``.

    Rows beyond one and a half times the hash range that should hold ``most`` are dropped where they are, so that what
    meets in the final top-k is bounded, whatever the number of partitions.
    """
    n = rows.count()
    hashed = F.xxhash64(column)
    if n > 2 * most:
        rows = rows.where(hashed < F.lit(int(-(2**63) + 2**64 * 1.5 * most / n)).cast("long"))
    return rows.orderBy(hashed, column).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, skip: tuple[int, int], most: int) -> DataFrame:
    """(doc_id, text, y, told) of at most ``most`` labelled ids outside the fold that is held out; told ranks texts of an id."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", skip[0]) != skip[1]))
    chosen = smallest_by_hash(known, "doc_id", most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
    return rows.withColumn("told", F.xxhash64("text"))


def one_an_id(rows: DataFrame) -> DataFrame:
    """Of rows of one doc_id, that with the smallest ``told``: as many rows as ids, however often an id is repeated."""
    rest = [c for c in rows.columns if c not in ("doc_id", "told")]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "told").alias("r")).select("doc_id", "r.*")


def held_back(value: Column) -> Column:
    """``value``, behind a fence for the optimizer: filters on it are not copied into the expressions it is made of.

    Long chains of array expressions refer to each step several times; pushing a filter through them would copy every
    step into every reference. A projection that is not deterministic is not pushed through.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``n`` (a null id counts as remainder 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(column)
        if array.nbytes <= most:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(array), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, list]:
    """Words of each text as (offsets, flat dictionary-encoded array); empty strings at either end may occur."""
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # the six characters above
    base = lists.offsets[0].as_py()
    flat = lists.values.slice(base, lists.offsets[-1].as_py() - base)
    return pc.subtract(lists.offsets, base), flat.dictionary_encode()


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not hold it: sends its sources as a zip, once."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_kvspark_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="kvspark-code-")) / "kvspark_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "kvspark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._kvspark_sent = True


def valid_texts(texts: pa.Array) -> pa.Array:
    """The same texts; bytes that are no UTF-8 become replacement characters."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], pa.Array], most: int = 2 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose text ``keep`` marks: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            yield batch.filter(keep(valid_texts(batch.column("text"))))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
