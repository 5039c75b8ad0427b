"""Fingerprints, archives, chats, classifiers and rules against brute force."""

import hashlib
import io
import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from kvspark.llm import chat, ftrl, gam, lines, omh, warc

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


# -- op10 --------------------------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    w = split(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    own = [x for x in text.split("\n") if split(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(covered), failed)


def rated(df):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())


def test_rules_against_brute_force(odd_docs, odd_rows, clashing_docs, no_docs):
    rng = random.Random(8)
    want = Counter((i, *brute_rules(t)) for i, t in odd_rows)
    assert rated(lines.rate(odd_docs)) == want == rated(lines.rate(clashing_docs))
    assert lines.rate(no_docs).count() == 0
    spark = odd_docs.sparkSession
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + rng.choice(["", "\n", " x\ny"]) for _ in range(200)]  # many overlapping repeats
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rated(lines.rate(docs)) == Counter((i, *brute_rules(t)) for i, t in enumerate(texts))


def prose(i):
    return " ".join(f"{w}{i}" for w in "this sentence of plain prose says something or other quietly".split()) + f", number {i}.\n"


def test_verdicts(spark):
    clean = "".join(prose(i) for i in range(6))
    cases = {
        1: (clean, True), 2: (clean + "Home | News | Sport | Weather | Contact us\n", True), 3: ("Home | News | Sport | Weather | More | Links | Here\n" * 1 + "a | b | c | d | e | f | g | h | i | j | k | l | m | n | o | p | q\n", False),
        4: (" ".join(f"WORD{i}!!" for i in range(40)), False), 5: (" ".join(f"word{i}***" for i in range(40)), False), 6: ("Click here to subscribe to our newsletter and read more about cookies today and ever after now then please do.\n" * 1 + "x", False),
        7: (" ".join(f"w{i}" for i in range(40)), False), 8: (" ".join(f"w{i}" for i in range(40)) + ".", True), 9: (clean.replace("\n", " ") + "cut off in the mid", True),
    }
    got = {r.doc_id: r for r in lines.rate(spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")).collect()}
    assert {i: got[i].kept for i in cases} == {i: k for i, (_, k) in cases.items()}
    assert "Home | News" not in got[2].clean_text and "plain3 prose3" in got[2].clean_text


def test_clean_documents_are_kept(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = lines.rate(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] >= 0.98 and share.get(0, 0) <= 0.2


# -- op7 ---------------------------------------------------------------------------------------------------------------


def digest(conversation):
    loss = "".join(t for r, t in conversation if r == "assistant")
    return (len(conversation), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in conversation).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chats(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_sep|>", "\\<|<|<\\|", "", "a\nb", "<|im_sep|>", "| <", "$1 \\1 \\", "<|im_nl|>", "🙂é"]
    rows, want = [], {}
    rng = random.Random(6)
    for c in range(40):
        turns = [(rng.choice(["user", "assistant", "assistant", "system", "odd\nrole", "<|x"]), rng.choice(nasty)) for _ in range(rng.randint(1, 9))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
        want[c] = digest(turns)
    rows += [(90, 0, None, None), (90, 1, "assistant", None), (91, None, "user", "first"), (91, 0, "user", "b"), (91, 0, "user", "a"), (91, 0, "user", "a"), (None, 0, "user", "x")]
    want |= {90: digest([("", ""), ("assistant", "")]), 91: digest([("user", t) for t in ("first", "a", "a", "b")]), None: digest([("user", "x")])}
    want[-1] = digest([("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)])
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t", "2 as s", "3 as segments", "4 as formatted")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.formatted_digest(spark, table).collect()}
    assert got == want
    formatted = chat.format_chats(chat.with_probe(spark, table))
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n")
    one = formatted.where("conv_id = 91").first()
    assert one.formatted == "<|im_start|>user\nfirst<|im_sep|>a<|im_sep|>a<|im_sep|>b<|im_end|>\n"  # merged
    assert chat.format_chats(table.where("false")).count() == 0


# -- op3 ---------------------------------------------------------------------------------------------------------------

M64 = 2**64 - 1


def _long(x, seed):
    return xxhash.xxh64_intdigest(struct.pack("<Q", x & M64), seed)


def _int(x, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", x), seed)


def brute_sketch(text):
    """The same in plain Python: {sketch: tuple hash}."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in split(text)]
    k = [_long(b, _long(a, 42)) for a, b in zip(h, h[1:])] if len(h) >= 2 else h
    mask, seen, numbered = (1 << 31) - 1, Counter(), []
    for i, x in enumerate(k):
        top = x & ~mask & M64
        numbered.append(((_int(seen[top], _long(top, 42)) & ~mask & M64) | i))
        seen[top] += 1
    bins = {}
    signed = lambda x: x - 2**64 if x >> 63 else x
    for g in sorted(numbered, key=signed):
        bins.setdefault(g >> 58, []).append(g & mask)
    out = {}
    for b, at in bins.items():
        at = sorted(at[:2])
        told = _long(k[at[0]], 42) if len(at) == 1 else _long(k[at[1]], _long(k[at[0]], 42))
        out[b] = told >> 40
    return out


def shown(sketch):
    order = sorted(sketch, key=lambda b: b - 64 if b >= 32 else b)
    return "".join(f"{b << 24 | sketch[b]:08x}" for b in order)


def alike(a, b):
    return sum(a.get(x) == b.get(x) for x in a) / len(a.keys() | b.keys()) if a or b else 1.0


def test_order_minhash_against_brute_force(spark, sf, odd_rows, clashing_docs, no_docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(3)
    repeated = [(rng.choice([None, 1, 2, 3, 4]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for _ in range(40)]
    again = spark.createDataFrame(repeated, "doc_id long, text string").repartition(3)
    for docs, rows in ((table, [(r.doc_id, r.text) for r in table.collect()]), (clashing_docs, odd_rows), (again, repeated)):
        lender = {}
        for i, t in rows:
            if i is not None:
                lender[i] = min(lender.get(i, t or ""), t or "")
        ids = sorted(lender, reverse=True)
        after = {i: lender[ids[(at + 1) % len(ids)]] for at, i in enumerate(ids)}
        want = Counter()
        for i, t in rows:
            own = t or ""
            half = len(own) // 2
            edited = own[: len(own) - half] + after.get(i, "")[:half]
            a, e = brute_sketch(own), brute_sketch(edited)
            near_next = None if i is None else round(alike(a, brute_sketch(after[i])), 9)
            want[(i, len(own), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(e), round(alike(a, e), 9), near_next)] += 1
        got = Counter((*r[:5], round(r.near_edited, 9), None if r.near_next is None else round(r.near_next, 9)) for r in omh.neighbour_report(docs).collect())
        assert got == want
    assert omh.neighbour_report(no_docs).count() == 0


def test_order_matters_to_fingerprints(spark):
    rng = random.Random(4)
    w = [str(rng.random()) for _ in range(600)]
    moved = w[300:] + w[:300]
    rows = omh.sketches(spark.createDataFrame([(1, " ".join(w)), (2, " ".join(moved)), (3, " ".join(w[:590] + w[:10]))], "doc_id long, text string"), "text", "sketch")
    a, b, c = (set(r.sketch) for r in rows.orderBy("doc_id").collect())
    assert 0.3 < len(a & b) / 64 < 0.75 and len(a & c) / 64 > 0.8  # the k-mers are the same, their order is not


# -- op4 ---------------------------------------------------------------------------------------------------------------


def test_archives(spark):
    big, other = "x" * 999 + "é", "<p>" + "y" * 1500
    html = [(1, big), (2, big), (3, other), (4, "small"), (5, "small"), (6, None), (7, ""), (8, big), (8, big), (None, big), (None, None), (9, "z" * 999), (10, "z" * 999), (11, "z" * 1000), (12, "z" * 1000), (13, "<|>\r\n\r\nWARC/1.1\r\n\x00" * 200)]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h) for i, h in html], "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as digest", "3 as original").repartition(3)
    size = lambda h: len((h or "").encode())
    last = {}
    for i, h in html:
        if i is not None and size(h) >= 1000:
            last[h] = max(last.get(h, i), i)
    want = Counter()
    for i, h in html:
        again = i is not None and size(h) >= 1000 and last[h] != i
        want[(i, size(h), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if again else "response", last[h] if again else None)] += 1
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    assert got == want
    assert warc.round_trip(pages.where("false")).count() == 0


class Sink(io.BytesIO):
    pass


def archive(records, dictionary=b""):
    out = Sink()
    writer = warc.ArchiveWriter(out, dictionary)
    for r in records:
        writer.add(r)
    return out.getvalue()


def test_reader_validates():
    good = warc.page_record(5, "http://a", b"hello", None)
    data = archive([good])
    found = [warc.parse_record(x) for x in warc.frames(io.BytesIO(data))]
    assert len(found) == 2 and warc.page_of(*found[1])["payload_bytes"] == 5
    for bad in (data[4:], data[:-3], data[:6], b"", data[:8] + b"junk that is no frame" + data[8:]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(bad)))
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Type", b"Warp-Type"), (b"hello", b"jello"), (b"\r\n\r\n", b"\r\n")):
        with pytest.raises(warc.WarcError):
            warc.page_of(*warc.parse_record(good.replace(a, b, 1) if a != b"hello" else good.replace(a, b)))


def test_dictionary_may_be_compressed():
    rng = random.Random(1)
    samples = [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))).encode() for _ in range(200)]
    raw = zstandard.train_dictionary(2048, samples).as_bytes()
    data = archive([warc.page_record(1, "u", samples[0], None)], raw)
    packed = zstandard.ZstdCompressor().compress(raw)
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + len(raw) :]
    assert list(warc.frames(io.BytesIO(again))) == list(warc.frames(io.BytesIO(data)))
    assert len(data) < 8 + len(raw) + len(samples[0]) + 900


# -- op8, op9 ----------------------------------------------------------------------------------------------------------


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def labelled(spark, sf, f):
    # the smallest table has too few labels for a score; the next one has enough
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    return docs, f(docs, labels).join(labels, "doc_id").toPandas()


def test_quality_on_held_out_rows(spark, sf):
    docs, rows = labelled(spark, sf, gam.quality)
    assert all(rows.held_out == [crc(i, 3) == 1 for i in rows.doc_id]) and rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.97 and (rows.predicted == (rows.score >= 0.5)).all()
    clean = held[held.quality == 1]
    assert clean.predicted.mean() > 0.98


def test_toxicity_on_held_out_rows(spark, sf):
    docs, rows = labelled(spark, sf, ftrl.toxicity)
    assert all(rows.held_out == [crc(i, 5) == 0 for i in rows.doc_id]) and rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.02


@pytest.mark.parametrize("f", [gam.quality, ftrl.toxicity])
def test_classifiers_take_odd_tables(spark, odd_docs, odd_rows, clashing_docs, no_docs, f):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(6, 1, 1), (6, 0, 0), (9, None, None), (None, 1, 1), (14, 0, 0), (12, 5, 7), (11, 0, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd_docs, clashing_docs):
        for labels in (none, odd):
            got = f(docs, labels).collect()
            assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert f(no_docs, odd).count() == 0


def test_classifiers_never_read_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for f, n, fold, label in ((gam.quality, 3, 1, "quality"), (ftrl.toxicity, 5, 0, "toxic")):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == fold
        turned = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = ({r.doc_id: r.score for r in f(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no main effect at all
    model = gam.train(x, y)
    assert (0, 1) in model["pairs"]
    assert ((gam.predict(model, x) >= 0.5) == y).mean() > 0.95


def test_ftrl_is_sparse():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(800):
        y = int(rng.random() < 0.3)
        rows.append((np.unique(np.concatenate([rng.integers(100, 50_000, 60), [7] if y else []]).astype(np.int64)), y))
    model = ftrl.train(rows)
    weights = dict(zip(model["buckets"].tolist(), model["weights"].tolist(), strict=True))
    assert max(weights, key=weights.get) == 7 and len(weights) < 500


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        left.append(now.count())
    assert left == sorted(left, reverse=True) and left[-1] > 0
    kept = {r.doc_id for r in now.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


# -- shared helpers ----------------------------------------------------------------------------------------------------


def test_smallest_by_hash(spark):
    from kvspark.llm.common import smallest_by_hash

    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()]
    assert [r.doc_id for r in smallest_by_hash(ids, "doc_id", 100).collect()] == want
    assert smallest_by_hash(ids, "doc_id", 10_000).count() == 5000 and smallest_by_hash(ids.where("false"), "doc_id", 5).count() == 0


def test_filters_do_not_blow_up_array_chains(odd_docs):
    assert lines.rate(odd_docs).where("kept or n_repeat_words > 3 or base_failed").count() >= 10
    assert omh.neighbour_report(odd_docs).where("near_edited > 2").count() == 0


def test_staged_tables_are_in_the_shared_folder(spark, odd_docs):
    from kvspark.llm.common import shared_root, stage, unstage

    table = stage(odd_docs.select("doc_id"), "some")
    where = table.inputFiles()[0]
    root = shared_root(spark).removeprefix("file:").lstrip("/")
    assert root in where and table.count() == odd_docs.count()
    unstage(table)
    with pytest.raises(Exception, match="FILE|exist"):
        spark.read.parquet(where)


def test_scratch_folders_can_be_cleared(spark, odd_docs, monkeypatch):
    from kvspark.llm import common

    monkeypatch.setattr(common, "_SCRATCH", {"already registered"})
    table = common.stage(odd_docs.select("doc_id"), "some")
    folder = Path(table.inputFiles()[0].removeprefix("file:").replace("///", "/")).parents[1]
    assert folder.is_dir() and len(common._SCRATCH) == 2
    common.clear_scratch(spark)
    assert not folder.exists() and not common._SCRATCH
