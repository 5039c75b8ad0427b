"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the presence of its hashed words, word pairs and pairs with one word between. Words are taken
without ASCII punctuation at either end, lower-cased. Training reads a bounded sample of labelled rows (``SAMPLE``),
one document at a time, with per-coordinate rates; the L1 term keeps most weights at exactly zero, so the model is a
short list of (bucket, weight) that any task can hold: at most ``2**BITS`` entries, far fewer in practice.

Edge cases: a null or empty text has no features and scores the bias alone; labels that are null or of other values
than 0 and 1 are not learnt from; a doc_id labelled twice counts by its highest label; without both labels in the
training rows the score is the training rate of label 1, within 0.001 and 0.999 (0.001 without any row: nothing is known
to be toxic); a doc_id on several rows is learnt from
once, and each row is scored, repeated ones alike; an empty table has no scores; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep_rows, labelled_sample, one_an_id, slices, split_words, text_or_empty

BITS = 22
#: Labelled rows that are learnt from at most: those with the smallest hash of their id.
SAMPLE = 12_000
_TRIM = string.punctuation
_U64 = np.uint64


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word, pair and skip-pair of the texts, repeats included."""
    offsets, words = split_words(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    if len(words) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    distinct = np.array([digest(w.strip(_TRIM), 9) for w in words.dictionary.to_pylist()], _U64)
    h = distinct[words.indices.to_numpy(zero_copy_only=False)]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.to_numpy(zero_copy_only=False)))
    empty = digest("", 9)
    held = h != _U64(empty)  # pieces without a letter are no words
    h, owner = h[held], owner[held]
    shift, docs, buckets = _U64(64 - bits), [owner], [h >> _U64(64 - bits)]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = owner[gap:] == owner[:-gap]
        pair = (h[:-gap] * _U64(factor)) ^ (h[gap:] + _U64(factor >> 3))
        docs.append(owner[gap:][same])
        buckets.append(((pair * _U64(0xD6E8FEB86659FD93)) >> shift)[same])
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression on binary features (McMahan et al., 2013)."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 20.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.maximum(np.abs(z) - self.l1, 0.0)
        return -np.sign(z) * shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias -= 0.02 * g


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 6) -> dict:
    """Fit on (distinct buckets, label) rows; returns buckets, weights and bias of the sparse model."""
    labels = np.array([y for _, y in rows])
    rate = labels.mean() if len(rows) else 0.0
    if not len(rows) or rate in (0.0, 1.0):
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return {"buckets": np.empty(0, np.int64), "weights": np.empty(0), "bias": float(np.log(rate / (1 - rate)))}
    model = Ftrl(1 << bits)
    model.bias = float(np.log(rate / (1 - rate)))
    heavier = min(5.0, (1 - rate) / rate)  # a rare label counts more
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.learn(rows[i][0], rows[i][1], heavier if rows[i][1] else 1.0)
    w = model.weights()
    kept = np.flatnonzero(w)
    return {"buckets": kept, "weights": w[kept], "bias": model.bias}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", skip: tuple[int, int] = (5, 0), most: int = SAMPLE) -> dict:
    """A model of at most ``most`` labelled documents; of an id on several rows, one is learnt from."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            owner, bucket = features(batch.column("text"))
            joint = np.unique((owner << BITS) | bucket)
            bounds = np.searchsorted(joint, np.arange(batch.num_rows + 1) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((joint & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "told", "y")), lists], ["doc_id", "told", "y", "buckets"])

    rows = labelled_sample(docs, labels, label, skip, most)
    got = one_an_id(rows.mapInArrow(extract, "doc_id long, told long, y int, buckets array<int>")).toArrow().combine_chunks()
    rows = []
    ids, ys, buckets = (got.column(i) for i in range(3))
    for i in sorted(range(got.num_rows), key=lambda i: ids[i].as_py()):
        rows.append((buckets[i].values.to_numpy(), ys[i].as_py()))
    return train(rows)


def scorer(model: dict) -> Callable[[pa.Array], np.ndarray]:
    """Scores of an array of texts under a sparse model."""
    weights, bias = model["weights"], model["bias"]
    place = np.zeros(1 << BITS, np.int32)  # 1 + where a bucket's weight is
    place[model["buckets"]] = np.arange(1, len(weights) + 1)

    def run(texts: pa.Array) -> np.ndarray:
        owner, bucket = features(texts)
        at = place[bucket]
        held = at > 0
        joint = np.unique((owner[held] << BITS) | at[held])
        sums = np.bincount(joint >> BITS, weights=weights[(joint & ((1 << BITS) - 1)) - 1] if len(weights) else None, minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(sums + bias, -35, 35)))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # sparse, and at most 2**BITS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(sent.value)
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(of(batch.column("text")))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    of: list = []  # a task's scorer, made at its first batch

    def keep(texts: pa.Array) -> pa.Array:
        if not of:
            of.append(scorer(sent.value))
        return pa.array(of[0](texts) < 0.5)

    return keep_rows(docs, keep)


def toxicity(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns from ``training`` (else ``docs``) where labelled."""
    scored = score(docs, fit(docs if training is None else training, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
