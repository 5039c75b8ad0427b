"""SentencePiece models on the tokenizers library.

The model protobuf is parsed here (wire format only). Its normaliser becomes a tokenizers pipeline: the precompiled
character map, removal of extra spaces, the dummy prefix and the metaspace marker. Unigram models keep their scores;
BPE models get the merges that their scores rank. Bytes back up what the vocabulary lacks. Batches are encoded
by several threads (``threads``), and parity with the reference library is verified:
on probes when a model is loaded, and for each document that ``verify`` asks for.

Texts are cut in front of every run of spaces if no piece of the vocabulary reaches over such a cut; then each distinct
stretch of a batch is encoded once. Otherwise whole texts are encoded.

Edge cases: a null text is empty and has no ids; control characters, lone spaces and very long texts take the same way;
repeated rows and null ids are encoded each; an empty table gives no rows; columns other than doc_id and text are
ignored. Decoding gives the normalised text: what the reference library decodes.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from .common import slices, text_or_empty

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "\u2581"
#: Distinct stretches that one Python worker remembers.
MEMO = 300_000
_PROBES = ("", " ", "a", "Hello  world, it's 3.14!\n\nNew\tline", "  lead and trail  ", "é ñ ü ß Ç œ", "中文字 日本 🙂👍🏽", "e\u0301 \ufb01ne \u00bd ①", "a\u2581b \u2581 c", "\x01\x7f \u200b\u00a0x", "<s> </s> <unk> <0x41>", "XYZ" * 40)


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix_space: bool = False


def _messages(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message; varints as unsigned integers, all else as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"protobuf wire type {wire}")
        yield number, value


def parse_model(data: bytes) -> Model:
    """Field numbers are those of the public sentencepiece_model.proto."""
    model = Model()
    for number, value in _messages(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _messages(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _messages(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix_space = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:
            for n, v in _messages(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    unknown = [i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN]
    model.unk_id = unknown[0] if unknown else model.unk_id
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces in the order in which the model would join them: by score of the result, then by id."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, i in ids.items():
        if model.pieces[i][2] == NORMAL:
            found += [(-model.pieces[i][1], i, ids[piece[:cut]], ids[piece[cut:]], piece[:cut], piece[cut:]) for cut in range(1, len(piece)) if piece[:cut] in ids and piece[cut:] in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model) -> Tokenizer:
    """The tokenizer of already normalised text: metaspace in place, prefix added."""
    # control and unknown pieces are never read from texts: they get names that no text holds
    vocabulary = [(f"\ufdd0{p}" if kind in (CONTROL, UNKNOWN) else p, s) for p, s, kind in model.pieces]
    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=model.unk_id, byte_fallback=model.byte_fallback))
    elif model.kind == BPE:
        tokenizer = Tokenizer(models.BPE({p: i for i, (p, _) in enumerate(vocabulary)}, _merges(model), unk_token=vocabulary[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer.add_tokens([AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


def normaliser(model: Model) -> normalizers.Normalizer:
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    return normalizers.Sequence(steps)


class Encoder:
    def __init__(self, path: str, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            data = f.read()
        self.model = parse_model(data)
        if self.model.suffix_space or not self.model.escape:
            raise ValueError("models without the metaspace marker in front of words are not supported")
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokenizer, self.normaliser = build(self.model), normaliser(self.model)
        # no piece holds the marker behind another character, so no merge reaches over the front of a run of markers
        self.by_stretch = not any(MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind in (NORMAL, USER)) and not any(kind == USER for *_, kind in self.model.pieces)
        self.memo: dict[str, bytes] = {}
        byte_of = [int(p[3:5], 16) if kind == BYTE else -1 for p, _, kind in self.model.pieces]
        self.shown = pa.array([chr(b) if 0 <= b < 128 else p for (p, *_), b in zip(self.model.pieces, byte_of, strict=True)], pa.string())
        self.slow = np.array([kind in (UNKNOWN, CONTROL, USER) or b >= 128 for (*_, kind), b in zip(self.model.pieces, byte_of, strict=True)], np.int64)
        for probe in _PROBES:
            ids, offsets = self(pa.array([probe]))
            if ids.tolist() != self.reference.encode(probe) or self.decode(ids, offsets)[0].as_py() != self.reference.decode(ids.tolist()):
                raise ValueError(f"no parity with the reference library on {probe!r}")

    def _marked(self, texts: list[str]) -> list[str]:
        if self.model.charsmap or self.model.remove_extra:
            texts = [self.normaliser.normalize_str(t) for t in texts]
        prefix = " " if self.model.dummy_prefix else ""
        return [(prefix + t).replace(" ", MARK) if t else "" for t in texts]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, offsets) of whole texts."""
        if self.model.kind == UNIGRAM and pc.any(odd := pc.match_substring_regex(pc.fill_null(texts, ""), "<0x[0-9A-F]{2}>")).as_py():
            # a unigram lattice would read the name of a byte piece as that piece; such texts take the reference library
            parts = [np.array(self.reference.encode(t or ""), np.uint32) if o else self(pa.array([t], pa.string()))[0] for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        marked = pa.array(self._marked([t or "" for t in texts.to_pylist()]), pa.large_string())
        if self.by_stretch:
            # a separator in front of every marker; two passes take those within runs of markers out again
            cut = None if _holds_nul(marked) else pc.replace_substring(marked, MARK, f"\x00{MARK}")
            for _ in range(2 if cut is not None else 0):
                cut = pc.replace_substring(cut, f"{MARK}\x00{MARK}", MARK + MARK)
        if not self.by_stretch or cut is None:
            encoded = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(marked.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*encoded, np.empty(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
        lists = pc.split_pattern(cut, "\x00")
        offsets, words = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        found = list(map(self.memo.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        new = self.tokenizer.encode_batch_fast([distinct[i] for i in missing], add_special_tokens=False)
        for i, e in zip(missing, new, strict=True):
            found[i] = np.array(e.ids, np.uint32).tobytes()
        if len(self.memo) + len(missing) > MEMO:
            self.memo = {w: ids for w, ids in zip(distinct, found, strict=True) if len(w) <= 64}
        else:
            self.memo.update((distinct[i], found[i]) for i in missing if len(distinct[i]) <= 64)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), np.uint32)
        starts, index = np.cumsum(lengths) - lengths, words.indices.to_numpy(zero_copy_only=False)
        each = lengths[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[index] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id lists. Lists of plain pieces and ASCII bytes are joined by column; the library takes the rest."""
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.shown.take(pa.array(ids)))
        texts = pc.replace_substring(pc.binary_join(lists, ""), MARK, " ")
        if self.model.dummy_prefix:
            texts = pc.replace_substring_regex(texts, "^ ", "")
        slow = np.flatnonzero(np.add.reduceat(np.append(self.slow[ids], 0), offsets[:-1]) * (np.diff(offsets) > 0)) if len(offsets) > 1 else []
        if len(slow):
            given = texts.to_pylist()
            for i, text in zip(slow, self.tokenizer.decode_batch([ids[offsets[i] : offsets[i + 1]].tolist() for i in slow], skip_special_tokens=False), strict=True):
                given[i] = text
            texts = pa.array(given, pa.string())
        return texts


def _holds_nul(texts: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(texts, "\x00")).as_py())


@functools.lru_cache(maxsize=2)
def encoder(path: str, threads: int = 1) -> Encoder:
    return Encoder(path, threads)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str, threads: int = 1) -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            ids, offsets = encoder(path, threads)(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), encoder(path).decode(ids, offsets - offsets[0]).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def task_threads(spark: SparkSession) -> int:
    """Threads that encode a batch: the cores of a task, two at least."""
    return max(2, int(spark.sparkContext.getConf().get("spark.task.cpus", "1")))


def round_trip(docs: DataFrame, path: str, threads: int | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, parity (ids equal the reference library's), decoded_sha256, same_text.

    Encodes and decodes every whole text; the reference library encodes each of them too. Batches are encoded by
    ``threads`` threads (else ``task_threads``).
    """
    threads = task_threads(docs.sparkSession) if threads is None else threads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, threads)
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            ids, offsets = of(batch.column("text"))
            rows = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            told = of.reference.encode(texts, num_threads=threads)
            parity = [r.tolist() == t for r, t in zip(rows, told, strict=True)]
            decoded = of.decode(ids, offsets).cast(pa.string())
            crcs = [zlib.crc32(r.astype("<u4").tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64()), pa.array(parity), decoded, batch.column("text")],
                ["doc_id", "n_tokens", "ids_crc32", "parity", "decoded", "text"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, decoded string, text string")
    return rows.select("doc_id", "n_tokens", "ids_crc32", "parity", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same_text"))
