"""Classifiers against naive forms: features and scores of each document, computed one word at a time."""

import math
import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kvspark.llm import ftrl, gam

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text:
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def texts_of(rows):
    return ["" if t is None else t for _, t in rows]


def naive_buckets(text):
    words = [w for w in (x.strip(string.punctuation) for x in split(text.lower())) if w]
    h = [xxhash.xxh64_intdigest(w, 9) for w in words]
    out, mask = {x >> 42 for x in h}, 2**64 - 1
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        for a, b in zip(h, h[gap:]):
            pair = ((a * factor) & mask) ^ ((b + (factor >> 3)) & mask)
            out.add(((pair * 0xD6E8FEB86659FD93) & mask) >> 42)
    return out


def naive_toxicity(model, text):
    weight = dict(zip(model["buckets"].tolist(), model["weights"].tolist(), strict=True))
    return 1 / (1 + math.exp(-(model["bias"] + sum(weight.get(b, 0.0) for b in naive_buckets(text)))))


def naive_shape(text):
    raw, words = text.encode(), split(text)
    n, length = max(len(words), 1), max(len(raw), 1)
    share = lambda f: sum(map(f, raw)) / length
    of = lambda chars: lambda b: chr(b) in chars
    named = "#*$%&<>@^~=+_\\.?,;:!|"
    pairs = list(zip(words, words[1:]))
    lines = [x for x in (y.strip() for y in raw.split(b"\n")) if x]
    counts = Counter(words)
    blank = sum(chr(b) in SPACE for b in raw)
    return [
        math.log1p(len(words)), min((length - blank) / n, 100), share(of(string.ascii_uppercase)), share(of(string.digits)), share(of("#*$%&<>@^~=+_\\")), share(of(".?")), share(of(",;:")), share(of("!")), share(of("|")),
        share(of(" \t\x0b\f\r")), share(lambda b: 33 <= b < 128 and not chr(b).isalnum() and chr(b) not in named), len(counts) / n, max(counts.values(), default=0) / n, sum(a == b for a, b in pairs) / n,
        (len(pairs) - len(set(pairs))) / n, math.log1p(len(raw) / len(lines)) if lines else 0.0, sum(x[-1:] in (b".", b"!", b"?", b'"', b"'") for x in lines) / len(lines) if lines else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(len(w) > 1 and w.isupper() for w in words) / n, sum(w[-1] in "#*$%&|<>" for w in words) / n,
    ]


def naive_quality(model, x):
    place = lambda edges, v: sum(e <= v for e in edges)
    f = model["base"] + sum(t[place(e, v)] for e, t, v in zip(model["edges"], model["tables"], x))
    f += sum(grid[place(model["coarse"][i], x[i])][place(model["coarse"][j], x[j])] for (i, j), grid in zip(model["pairs"], model["grids"]))
    return 1 / (1 + math.exp(-f))


@pytest.fixture(scope="module")
def given(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r.text or "" for r in docs.collect()}


def test_toxicity_features_against_naive_ones(odd_rows):
    texts = texts_of(odd_rows)
    owner, bucket = ftrl.features(pa.array([t for _, t in odd_rows], pa.string()))
    assert [set(bucket[owner == i].tolist()) for i in range(len(texts))] == [naive_buckets(t) for t in texts]


def test_toxicity_scores_against_naive_ones(given):
    docs, labels, texts = given
    model = ftrl.fit(docs, labels)
    assert len(model["buckets"])
    got = {r.doc_id: r.score for r in ftrl.score(docs, model).collect()}
    assert got.keys() == texts.keys() and all(abs(got[i] - naive_toxicity(model, t)) < 1e-9 for i, t in texts.items())
    assert {r.doc_id for r in ftrl.without_toxic(docs, model).collect()} == {i for i, s in got.items() if s < 0.5}


def test_quality_features_against_naive_ones(odd_rows):
    texts = texts_of(odd_rows)
    got = gam.features(pa.array([t for _, t in odd_rows], pa.string()))
    for t, x in zip(texts, got):
        assert np.allclose(x, naive_shape(t), atol=1e-12), (t[:60], [(n, a, b) for n, a, b in zip(gam.NAMES, x, naive_shape(t)) if abs(a - b) > 1e-12])


def test_quality_scores_against_naive_ones(given):
    docs, labels, texts = given
    model = gam.fit(docs, labels)
    assert model["tables"] and model["pairs"]
    got = {r.doc_id: r.score for r in gam.score(docs, model).collect()}
    # each document's features as they are computed: a last bit may lie on the other side of a bin's edge
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        x = gam.features(pa.array([t]))[0]
        assert np.allclose(x, naive_shape(t), atol=1e-12) and abs(got[i] - naive_quality(model, x)) < 1e-9
    assert {r.doc_id for r in gam.without_junk(docs, model).collect()} == {i for i, s in got.items() if s >= 0.5}


@pytest.mark.parametrize("module", [ftrl, gam])
def test_fit_collects_a_row_an_id(spark, monkeypatch, module):
    """Of a labelled id on very many rows one text is learnt from, whatever their order."""
    rng = random.Random(2)
    rows = [(1, f"text {i} of many") for i in range(3000)] + [(i, " ".join(rng.choice("abcdef") for _ in range(30))) for i in range(2, 30)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    seen, real = [], module.train

    def train(*args):
        seen.append(len(args[0]))
        return real(*args)

    monkeypatch.setattr(module, "train", train)
    models = []
    for _ in range(2):
        rng.shuffle(rows)
        models.append(module.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels, skip=(10**6, -1)))
    assert seen == [29, 29] and repr(models[0]) == repr(models[1])


@pytest.mark.parametrize("name", ["toxicity", "quality", "near_duplicates", "packing"])
def test_stages_take_odd_tables(spark, tmp_path, odd_docs, odd_rows, clashing_docs, no_docs, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(6, 1, 0), (11, 0, 1), (None, 1, 1), (9, None, None), (12, 5, 7)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert stage(spark, no_docs, str(tmp_path)).count() == 0
    kept = stage(spark, clashing_docs, str(tmp_path))
    rows = kept.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {i for i, _ in odd_rows}
    else:
        assert kept.columns == clashing_docs.columns and not Counter((r.doc_id, r.text) for r in rows) - Counter(odd_rows)


def test_without_labels_classifiers_keep_all(spark, tmp_path, odd_docs, odd_rows):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("toxicity", "quality"):
        assert dict(corpus_pipeline.STAGES)[name](spark, odd_docs, str(tmp_path)).count() == len(odd_rows)


def test_pipeline_of_an_empty_table(spark, tmp_path, no_docs):
    import corpus_pipeline

    no_docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
