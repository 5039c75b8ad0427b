"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shape statistics of a text (cases, symbols, repeats, lines). Cyclic boosting visits the features in turn
and adds a small step, learnt by a shallow tree on that feature's bins, to the feature's lookup table; then the pairs
whose grid explains most of the remaining gradient get two-dimensional tables in the same way. A score is the sum of
looked-up entries: bin each column, gather, add.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``); its tables are a fixed number of floats.

Edge cases: null and empty texts have all features zero and are scored; labels that are null or of other values than
0 and 1 are not learnt from; a doc_id labelled twice counts by its highest label; a doc_id on several rows is learnt from
once, and each row is scored; an empty table has no scores; columns other than doc_id and text are ignored; without both labels in the training
rows the score is the rate of label 1 (0.5 without any row).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep_rows, labelled_sample, one_an_id, slices, split_words, text_or_empty

#: Labelled rows that are learnt from at most: those with the smallest hash of their id.
SAMPLE = 20_000
BINS, GRID, PAIRS = 32, 8, 10
NAMES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "stops", "commas", "shouts", "bars", "spaces", "other",
    "distinct", "top_word", "adjacent", "repeat_pairs", "log_line", "line_ends", "repeat_lines", "upper_words", "symbol_words",
)


def _byte_classes() -> np.ndarray:
    """Class of each byte: 1 upper, 2 digit, 3 symbol, 4 sentence stop, 5 comma-like, 6 '!', 7 '|', 8 space, 9 line feed, 10 other ASCII."""
    of = np.zeros(256, np.int64)
    of[33:128] = 10
    of[ord("A") : ord("Z") + 1] = 1
    of[ord("a") : ord("z") + 1] = 0
    of[ord("0") : ord("9") + 1] = 2
    for chars, k in (("#*$%&<>@^~=+_\\", 3), (".?", 4), (",;:", 5), ("!", 6), ("|", 7), (" \t\x0b\f\r", 8), ("\n", 9)):
        of[[ord(c) for c in chars]] = k
    return of


_CLASS = _byte_classes()


def _top_share(owner: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, owner, counts)
    return out


def features(texts: pa.Array) -> np.ndarray:
    """[documents, features] of whole texts."""
    n = len(texts)
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(doc * 11 + _CLASS[data], minlength=11 * n).reshape(n, 11).astype(float)
    length = np.maximum(sizes, 1).astype(float)

    offsets, words = split_words(texts)
    index, bounds = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets.to_numpy(zero_copy_only=False)
    each = np.diff(bounds)
    owner = np.repeat(np.arange(n), each)
    distinct = words.dictionary.to_pylist()
    real = np.array([bool(w) for w in distinct], bool)
    loud = np.array([len(w) > 1 and w.isupper() for w in distinct], bool)
    odd = np.array([bool(w) and w[-1] in "#*$%&|<>" for w in distinct], bool)
    if len(index):
        kept = real[index]
        index, owner = index[kept], owner[kept]
    count = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(count, 1)
    wide = max(len(distinct), 1)
    joint, times = np.unique(owner * wide + index, return_counts=True)
    same = (owner[1:] == owner[:-1]) if len(owner) else np.empty(0, bool)
    twice = same & (index[1:] == index[:-1])
    pairs = (owner[1:] * wide + index[1:])[same] * np.int64(1_000_003) + index[:-1][same]  # hashed with wrap-around
    order = np.argsort(pairs, kind="stable")
    again = np.zeros(len(pairs), bool)
    if len(pairs):
        again[order[1:]] = pairs[order][1:] == pairs[order][:-1]
    pair_owner = owner[1:][same]

    lines = np.zeros((n, 3))
    for i, t in enumerate(raw):
        own = [x for x in (y.strip() for y in t.split(b"\n")) if x]
        if own:
            lines[i] = len(t) / len(own), sum(x[-1:] in b".!?\"'" for x in own) / len(own), 1 - len(set(own)) / len(own)
    flag = lambda f: np.bincount(owner, weights=f[index] if len(index) else None, minlength=n) / some
    share = lambda k: kinds[:, k] / length
    return np.stack([
        np.log1p(count), np.minimum((length - kinds[:, 8] - kinds[:, 9]) / some, 100), share(1), share(2), share(3), share(4), share(5), share(6), share(7), share(8), share(10),
        np.bincount(joint // wide, minlength=n) / some, _top_share(joint // wide, times, n) / some, np.bincount(owner[1:][twice], minlength=n) / some,
        np.bincount(pair_owner[again], minlength=n) / some, np.log1p(lines[:, 0]), lines[:, 1], lines[:, 2], flag(loud), flag(odd),
    ], axis=1)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, smooth: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Newton step of each bin by a tree of at most ``leaves`` leaves over ordered bins."""
    parts = [(0, len(g))]
    gain_of = lambda a, b: a * a / (b + smooth)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = np.where((hl >= least * 0.05) & (ht - hl >= least * 0.05), gain_of(gl, hl) + gain_of(gt - gl, ht - hl) - gain_of(gt, ht), 0)
            if gain.max(initial=0) > best[0]:
                best = (gain.max(), (a, b), a + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + smooth)
    return step


def _grid_tree(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Depth-two tree on a grid: the best cut of rows, then of columns in each half."""
    rows = _shallow_tree(g.sum(1), h.sum(1), leaves=2, smooth=smooth)
    cut = int(np.argmax(rows != rows[0])) or len(rows)
    step = np.zeros_like(g)
    for a, b in ((0, cut), (cut, len(rows))):
        if b > a:
            step[a:b] = _shallow_tree(g[a:b].sum(0), h[a:b].sum(0), leaves=2, smooth=smooth)
    return step


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15) -> dict:
    share = float(y.mean()) if len(y) else 0.5
    model: dict = {"base": float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))), "edges": [], "tables": [], "coarse": [], "pairs": [], "grids": []}
    if not len(y) or share in (0.0, 1.0):
        return model
    k = x.shape[1]
    model["edges"] = [_edges(x[:, j], BINS) for j in range(k)]
    model["coarse"] = [_edges(x[:, j], GRID) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["edges"])]
    tables = [np.zeros(len(e) + 1) for e in model["edges"]]
    f = np.full(len(y), model["base"])

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -35, 35)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = gradient()
            m = len(tables[j])
            step = rate * np.clip(_shallow_tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m)), -4, 4)
            tables[j] += step
            f += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["coarse"])]
    g, h = gradient()

    def cells(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model["coarse"][i]) + 1, len(model["coarse"][j]) + 1)
        return coarse[i] * shape[1] + coarse[j], shape

    def grid(v: np.ndarray, at: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        return np.bincount(at, v, shape[0] * shape[1]).reshape(shape)

    def explains(i: int, j: int) -> float:
        at, shape = cells(i, j)
        gg, hh = grid(g, at, shape), grid(h, at, shape)
        return float((gg**2 / (hh + 1)).sum())

    ranked = sorted(itertools.combinations(range(k), 2), key=lambda p: -explains(*p))[:PAIRS]
    grids = []
    for i, j in ranked:
        grids.append(np.zeros(cells(i, j)[1]))
    for _ in range(rounds // 3):
        for q, (i, j) in enumerate(ranked):
            at, shape = cells(i, j)
            g, h = gradient()
            step = rate * np.clip(_grid_tree(grid(g, at, shape), grid(h, at, shape)), -4, 4)
            grids[q] += step
            f += step.ravel()[at]
    return model | {"tables": tables, "pairs": ranked, "grids": grids}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    for j, (e, t) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        f += t[np.searchsorted(e, x[:, j], side="right")]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["coarse"])]
    for (i, j), t in zip(model["pairs"], model["grids"], strict=True):
        f += t[coarse[i], coarse[j]]
    return 1 / (1 + np.exp(-np.clip(f, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", skip: tuple[int, int] = (3, 1), most: int = SAMPLE) -> dict:
    """A model of at most ``most`` labelled documents; of an id on several rows, one is learnt from."""
    rows = labelled_sample(docs, labels, label, skip, most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            x = features(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "told", "y")), lists], ["doc_id", "told", "y", "x"])

    got = one_an_id(rows.mapInArrow(extract, "doc_id long, told long, y int, x array<double>")).toArrow().combine_chunks().sort_by("doc_id")
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return train(x, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(predict(sent.value, features(batch.column("text"))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def without_junk(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: pa.array(predict(sent.value, features(texts)) >= 0.5))


def quality(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learns from ``training`` (else ``docs``) where labelled."""
    scored = score(docs, fit(docs if training is None else training, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
