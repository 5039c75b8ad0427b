"""Token output, packing and SentencePiece, against the tokenizer libraries text by text."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kvspark.llm import packing, spm, token_orc, tokens
from kvspark.llm.common import scratch_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_word_encoder_has_parity(tokenizer):
    rng = random.Random(2)
    alphabet = "abcXYZéÑßøÿ×÷ĳıİΣςσ0129.,!?'’\"()<|>#*$%&-_ \n\t\r\x0b\x0c\x00\x01  ́中🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None, "", " ", "don't we'll I'D <|endoftext|> <|startoftext|>x", "É" * 500]
    encode = tokens.WordEncoder(tokens.default_vocabulary())
    assert encode.by_word and encode.bytes_of
    for part in (texts[:1500], texts[1500:], texts[:100]):  # the memo is warm for the last
        ids, offsets = encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_memo_is_bounded():
    encode = tokens.WordEncoder(tokens.default_vocabulary(), 50)
    rng = random.Random(1)
    for _ in range(20):
        encode(pa.array([" ".join(str(rng.random()) for _ in range(30))]))
    assert len(encode.words) <= 80


def test_orc_round_trip(spark, odd_docs, odd_rows, clashing_docs, tokenizer):
    expected, at = [], 0
    for i, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = ids_of(tokenizer, t, 1)
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    for docs in (odd_docs, clashing_docs):
        got = sorted((tuple(r) for r in token_orc.tokenized(docs, tokens.default_vocabulary()).collect()), key=lambda r: r[1])
        assert got == expected


def test_orc_files(spark, odd_docs, no_docs):
    path = scratch_path(spark, "t.orc")
    token_orc.write_tokens(odd_docs.where("doc_id is not null"), path, tokens.default_vocabulary(), 1)
    some = token_orc.read_tokens(spark, path, [9, 14])
    assert sorted(r.doc_id for r in some.select("doc_id").collect()) == [9, 14]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    import pyarrow.orc as orc
    from pathlib import Path

    files = sorted(Path(path.removeprefix("file:")).glob("part-*"))
    edges = []
    for f in files:
        table = orc.ORCFile(f).read(["doc_id"])
        ids = table.column("doc_id").to_pylist()
        assert ids == sorted(ids)
        edges.append((ids[0], ids[-1]))
    assert edges == sorted(edges)
    assert token_orc.tokenized(no_docs, tokens.default_vocabulary()).count() == 0


def test_best_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 2000)
    bins, offsets = packing.best_fit(sizes, 100)
    spans = defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes, strict=True):
        spans[b].append((o, o + s))
    for parts in spans.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] <= 100
    assert len(spans) <= 1.01 * sizes.sum() / 100


def packed_ok(rows, docs, tokenizer, capacity=2048):
    pieces, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        spans[r.sequence_id].append((r.offset, r.offset + r.length))
    for parts in spans.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] <= capacity
    expected = defaultdict(list)
    for i, t in docs:
        ids = ids_of(tokenizer, t, 0)
        expected[i] += [(k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(spans), -(-sum(p[2] for v in expected.values() for p in v) // capacity)


def test_packing(spark, sf, odd_docs, odd_rows, clashing_docs, no_docs, tokenizer, monkeypatch):
    packed_ok(packing.pack(clashing_docs, tokens.default_vocabulary()).collect(), odd_rows, tokenizer)
    assert packing.pack(no_docs, tokens.default_vocabulary()).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    used, least = packed_ok(packing.pack(docs.repartition(40), tokens.default_vocabulary()).collect(), rows, tokenizer)
    assert used <= least + 2
    monkeypatch.setattr(packing, "GROUP_BINS", 7)  # the tree stops early: still a packing, less tight
    packed_ok(packing.pack(docs.repartition(40), tokens.default_vocabulary()).collect(), rows, tokenizer)


def test_items_that_never_share_a_bin(spark, tokenizer):
    text = "word " * 1200
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string").repartition(9)
    used, _ = packed_ok(packing.pack(docs, tokens.default_vocabulary()).collect(), [(i, text) for i in range(30)], tokenizer)
    assert used == 30


def test_sentencepiece_round_trip(spark, odd_docs, odd_rows, clashing_docs, no_docs):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    for docs in (odd_docs, clashing_docs):
        rows = spm.round_trip(docs, spm.default_model()).collect()
        assert all(r.parity for r in rows) and [r.doc_id for r in rows if not r.same_text] == [13]  # a marker in a text decodes to a space
        want = Counter((i, len(x := reference.encode(t or "")), crc(x), hashlib.sha256(reference.decode(x).encode()).hexdigest()) for i, t in odd_rows)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.decoded_sha256) for r in rows) == want
    encoded = spm.encode(odd_docs, spm.default_model(), threads=2)
    assert Counter((r.doc_id, r.text) for r in spm.decode(encoded, spm.default_model()).collect()) == Counter((i, (t or "").replace(spm.MARK, " ")) for i, t in odd_rows)
    assert spm.round_trip(no_docs, spm.default_model()).count() == 0


def _field(number, wire, data):
    key = bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 127 | 128, number >> 4])
    return key + (bytes([len(data) & 127 | 128, len(data) >> 7]) if wire == 2 and len(data) > 127 else bytes([len(data)]) if wire == 2 else b"") + data


def test_unigram_models(tmp_path):
    """A hand-made unigram model with byte fallback: parity with the reference library."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("▁the", -2.1), ("▁cat", -4.2), ("the", -4.5), ("c", -7.3), ("a", -6.4), ("t", -6.6), ("at", -5.0), ("s", -6.1), ("e", -6.2), ("h", -7.0), ("▁s", -4.9))]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for p, s, k in pieces)
    trainer = _field(3, 0, b"\x01") + _field(35, 0, b"\x01") + _field(40, 0, b"\x00") + _field(41, 0, b"\x01") + _field(42, 0, b"\x02")
    data += _field(2, 2, trainer) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x01") + _field(5, 0, b"\x01"))
    (tmp_path / "u.model").write_bytes(data)
    encoder = spm.Encoder(str(tmp_path / "u.model"))
    assert encoder.model.kind == spm.UNIGRAM and encoder.model.byte_fallback and encoder.model.remove_extra
    for text in ("the cat sat", "thecat  s at ", "the é cat", "", "ccat\nthe"):
        ids, offsets = encoder(pa.array([text]))
        assert ids.tolist() == encoder.reference.encode(text), text
        assert encoder.decode(ids, offsets)[0].as_py() == encoder.reference.decode(ids.tolist())


def test_orc_files_hold_run_lengths_indexes_and_bloom_filters(spark, tmp_path):
    """What the format promises, as the ORC library's own reader finds it in the files."""
    docs = spark.range(9000).selectExpr("id * 3 AS doc_id", "repeat('word ', CAST(id % 7 AS int)) AS text")
    path = f"file://{tmp_path}/t.orc"
    token_orc.write_tokens(docs, path, tokens.default_vocabulary(), end_id=1, stripe_bytes=64 << 10, row_group=2000)
    jvm = spark._jvm
    orc, at = jvm.org.apache.orc, jvm.org.apache.hadoop.fs.Path
    files = sorted(p for p in (tmp_path / "t.orc").iterdir() if p.suffix == ".orc")
    assert files
    for file in files:
        reader = orc.OrcFile.createReader(at(str(file)), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == 2000
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            streams = {(footer.getStreams(i).getColumn(), footer.getStreams(i).getKind().toString()) for i in range(footer.getStreamsCount())}
            kinds = [footer.getColumns(i).getKind().toString() for i in range(footer.getColumnsCount())]
            # columns: 0 row, 1 doc_id, 2 file_start, 3 n_tokens, 4 ids, 5 its elements
            assert [kinds[i] for i in (1, 2, 3, 5)] == ["DIRECT_V2"] * 4  # integer run lengths, second version
            assert (1, "BLOOM_FILTER_UTF8") in streams and not any(k == "BLOOM_FILTER_UTF8" and c != 1 for c, k in streams)
            assert {(c, "ROW_INDEX") for c in range(6)} <= streams
        rows.close()
        reader.close()
    whole = {r.doc_id: (r.n_tokens, r.ids) for r in token_orc.read_tokens(spark, path).collect()}
    assert len(whole) == 9000 and all(n == len(ids) and ids[-1] == 1 for n, ids in whole.values())
    some = token_orc.read_tokens(spark, path, [3, 4, 2997, 26_997])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString() and {r.doc_id for r in some.collect()} == {3, 2997, 26_997}
