"""WARC archives compressed by Zstandard: one frame a record, dictionary in a leading skippable frame.

A file is a skippable frame (magic 0x184D2A5D, little-endian size) that holds the dictionary, a warcinfo record, and
the records, each a frame of its own. The reader loads the dictionary from the leading frame, decodes frame by frame
from a stream, and checks version line, mandatory headers, block length and digest, the closing blank lines, and for
responses the HTTP length and the payload digest; anything else raises ``WarcError``.

Scale: which record is the original is found on (digest, length, id) rows; pages meet that answer by page_id and
digest, so a page that a third of all rows repeat is no hot key. Files are written and read as streams through Hadoop-style addresses
in the shared folder, under a name of their own for each task attempt: only files that finished tasks report are read,
so a lost or repeated task does no harm. The dictionary is trained on a bounded sample (``SAMPLE`` pages).

Edge cases: a null html is an empty payload; payloads under ``LEAST_SAME`` bytes are always responses; rows without a
page_id are always responses and keep the null; a page_id repeated with an equal payload is an original each time; an
empty table makes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_width, slices, smallest_by_hash, stage

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
LEAST_SAME = 1000
#: Pages that the dictionary is trained on at most, and bytes of each.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
CHUNK = 1 << 16
#: Bytes after which a task starts a further file.
FILE_BYTES = 256 << 20
_PAGE = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")


class WarcError(ValueError):
    """An archive that does not follow the format."""


def open_fs(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a full address and the path in it."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", address))


def _sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, more: dict[str, str], content_type: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": content_type, "Content-Length": str(len(block)), "WARC-Block-Digest": _sha1_32(block)} | more
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def http_block(payload_length: int, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode() + payload


def page_record(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """A response, or with ``original`` a revisit of that page."""
    name = f"{_PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha1(payload).hexdigest())}"
    more = {"WARC-Target-URI": "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "about:blank"), "WARC-Payload-Digest": _sha1_32(payload)}
    if original is None:
        return record("response", name, http_block(len(payload), payload), more, "application/http;msgtype=response")
    more |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{_PAGE}{original}>"}
    return record("revisit", name, http_block(len(payload), b""), more, "application/http;msgtype=response")


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes, level: int = 3):
        self.out = out
        self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.size = 8 + len(dictionary)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True, write_content_size=True)
        self.add(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", {}, "application/warc-fields"))

    def add(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.size += len(frame)


def frames(source) -> Iterator[bytes]:
    """The decoded frames of a stream, one at a time; holds one record and one chunk."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise WarcError(f"leading frame has magic {magic:#x}")
    raw = source.read(size)
    if len(raw) < size:
        raise WarcError("the dictionary frame is cut short")
    if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    held = zstandard.ZstdCompressionDict(raw) if raw else None
    decompressor = zstandard.ZstdDecompressor(dict_data=held)
    rest = b""
    while True:
        rest = rest or source.read(CHUNK)
        if not rest:
            return
        frame, parts = decompressor.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                rest = source.read(CHUNK)
                if not rest:
                    raise WarcError("the last frame is cut short")
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        yield b"".join(parts)


def _fields(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:60]!r}")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    if not data.startswith(b"WARC/1.1\r\n"):
        raise WarcError("no WARC/1.1 version line")
    head, blank, rest = data[10:].partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("headers do not end")
    fields = _fields(head)
    if missing := [m for m in _MANDATORY if m not in fields]:
        raise WarcError(f"mandatory headers missing: {missing}")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"a block of {size} bytes was announced, {len(rest) - 4} follow")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _sha1_32(block):
        raise WarcError("block digest differs")
    return fields, block


def _page(name: str) -> int | None:
    name = name.strip("<>")
    return int(name[len(_PAGE) :]) if name.startswith(_PAGE) else None


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """What a response or revisit record says of its page; checks the payload of responses."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP message")
    length = _fields(lines).get("content-length", "")
    if not length.isdigit():
        raise WarcError("the HTTP message has no length")
    digest = fields.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise WarcError("no payload digest")
    if fields["warc-type"] == "response" and (len(payload) != int(length) or digest != _sha1_32(payload)):
        raise WarcError("the payload differs from its length or digest")
    return {
        "page_id": _page(fields["warc-record-id"]), "payload_bytes": int(length), "payload_digest": base64.b32decode(digest[5:]).hex(),
        "record_type": fields["warc-type"], "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the SAMPLE pages with the smallest hash of their id; ids are chosen before any page is read."""
    known = pages.where("page_id is not null").select("page_id").distinct()
    chosen = F.broadcast(smallest_by_hash(known, "page_id", SAMPLE))
    rows = pages.join(chosen, "page_id", "left_semi").select("page_id", F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("payload")).where("payload is not null")
    rows = rows.dropDuplicates(["page_id"]).orderBy("page_id").collect()
    samples = [http_block(len(r.payload), bytes(r.payload)) for r in rows if len(r.payload) > 64]
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def originals(pages: DataFrame) -> DataFrame:
    """(page_id, digest, original) of the pages that revisit another: the largest page_id of an equal payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    light = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= LEAST_SAME))
    light = stage(light, "digests")
    largest = stage(light.groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "originals")
    return light.join(largest, ["digest", "size"]).where("page_id < original").select("page_id", "digest", "original").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page to archives under ``folder``; the (file, records) of what was written, as a staged table."""
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))  # at most DICTIONARY_BYTES
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        stream = writer = name = None
        count = 0
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if writer is None:
                    name, count = f"{uuid.uuid4().hex}.warc.zst", 0
                    stream = fs.open_output_stream(f"{root}/{name}")
                    writer = ArchiveWriter(stream, dictionary.value)
                writer.add(page_record(row["page_id"], row["url"], row["payload"], row["original"]))
                count += 1
                if writer.size > FILE_BYTES:
                    stream.close()
                    yield pa.RecordBatch.from_pylist([{"file": name, "records": count}])
                    writer = None
        if writer is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "records": count}])

    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.make_valid_utf8("url").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(originals(pages), ["page_id", "digest"], "left").select("page_id", "url", "payload", "original")
    return stage(rows.mapInArrow(write, "file string, records long"), "archives")


def read_archives(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to. A task a file."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, seen = [], 0
                with fs.open_input_stream(f"{root}/{row['file']}") as source:
                    for data in frames(source):
                        fields, block = parse_record(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        held.append(page_of(fields, block))
                        seen += 1
                        if len(held) >= 4000:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
                if seen != row["records"]:
                    raise WarcError(f"{row['file']} has {seen} records, not {row['records']}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return files.repartition(shuffle_width(spark), "file").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder))


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
