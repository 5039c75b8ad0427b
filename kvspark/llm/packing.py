"""Best-fit packing of token sequences by hierarchical residual packing.

Each scan task cuts its documents into pieces, packs them by best-fit decreasing as it goes, and writes whole bins with
their contents. Nearly full bins are final. Underfull bins become items of a next round, dealt at random over ever
fewer groups (a tree with fan-in ``FAN_IN``), where best-fit merges whole bins; contents travel with their bin, so no
join is needed. A round handles residues only, a small and shrinking part of the data. Groups hold at most
``GROUP_BINS`` bins: the tree stops where more would meet in one task, or when a round no longer removes bins.

Edge cases: a null text is empty and has the end id only; only documents longer than a sequence are cut; repeated
doc_ids are packed each; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_or_empty, unstage
from .tokens import encoder

FAN_IN = 8
GROUP_BINS = 50_000
#: Pieces that a scan task packs at once.
LOCAL_PIECES = 65_536
_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32())])
_BINS = "sequence_id long, fill int, items array<struct<doc_id: long, piece: int, start: long, length: int, ids_crc32: long, offset: int>>"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item.

    Bins are filed by free space; a bit set of the spaces in use finds the tightest fit in a few word operations.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, count = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            which = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
        else:
            free, which, count = capacity, count, count + 1
        bins[i], offsets[i] = which, capacity - free
        if free > size:
            by_free[free - size].append(which)
            used |= 1 << (free - size)
    return bins, offsets


def _as_bins(cols: dict[str, np.ndarray], capacity: int, serial: int) -> pa.RecordBatch:
    """Pack pieces and return the bins; ``serial`` numbers them from there on."""
    bins, offsets = best_fit(cols["length"], capacity)
    order = np.lexsort((offsets, bins))
    counts = np.bincount(bins)
    fill = np.bincount(bins, weights=cols["length"]).astype(np.int32)
    items = pa.StructArray.from_arrays(
        [pa.array(cols["doc_id"][order], pa.int64(), mask=cols["no_id"][order]), *(pa.array(cols[c][order].astype(t)) for c, t in (("piece", np.int32), ("start", np.int64), ("length", np.int32), ("ids_crc32", np.int64))), pa.array(offsets[order].astype(np.int32))],
        fields=list(_ITEM),
    )
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)
    return pa.RecordBatch.from_arrays([pa.array(serial + np.arange(len(counts))), pa.array(fill), lists], ["sequence_id", "fill", "items"])


def _pieces(batch: pa.RecordBatch, vocabulary: str, end_id: int, capacity: int) -> dict[str, np.ndarray]:
    ids, offsets = encoder(vocabulary)(batch.column("text"))
    n = len(offsets) - 1
    ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
    offsets = offsets + np.arange(n + 1)
    total = np.diff(offsets)
    each = (total + capacity - 1) // capacity
    owner = np.repeat(np.arange(n), each)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = piece * capacity
    length = np.minimum(capacity, total[owner] - start)
    view, at = memoryview(ids).cast("B"), offsets[owner] + start
    crcs = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
    known = batch.column("doc_id")
    return {"doc_id": known.fill_null(0).to_numpy()[owner], "no_id": known.is_null().to_numpy(zero_copy_only=False)[owner], "piece": piece, "start": start, "length": length, "ids_crc32": np.array(crcs, np.int64)}


def _serial(round_no: int) -> int:
    """First number of a task's bins: rounds, and tasks in a round, have their own ranges."""
    return (round_no << 48) + (TaskContext.get().partitionId() << 28)


def local_bins(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, serial = [], 0, _serial(0)

        def flush() -> pa.RecordBatch:
            return _as_bins({k: np.concatenate([h[k] for h in held]) for k in held[0]}, capacity, serial)

        for batch in slices(batches, "text", 3 << 20):
            held.append(_pieces(batch, vocabulary, end_id, capacity))
            count += len(held[-1]["piece"])
            if count >= LOCAL_PIECES:
                out = flush()
                yield out
                held, count, serial = [], 0, serial + out.num_rows
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(pack, _BINS)


def _merge(rows: pa.Table, capacity: int, serial: int) -> pa.RecordBatch:
    """Best-fit of whole bins: their contents follow one another, moved by where their bin goes.

    Where best-fit of the bins' pieces, each for itself, needs fewer bins than that, it is taken instead.
    """
    rows = rows.combine_chunks()
    lists = rows.column("items").chunk(0)
    counts = np.diff(lists.offsets.to_numpy())
    bins, shift = best_fit(rows.column("fill").to_numpy().astype(np.int64), capacity)
    pieces = lists.flatten()
    loose = {name: pieces.field(i).fill_null(0).to_numpy() for i, name in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))}
    if best_fit(loose["length"].astype(np.int64), capacity)[0].max() < bins.max():
        return _as_bins(loose | {"no_id": pieces.field(0).is_null().to_numpy(zero_copy_only=False)}, capacity, serial)
    order = np.lexsort((shift, bins))
    items = lists.take(pa.array(order)).flatten()
    moved = np.repeat(shift[order], counts[order])
    fields = [items.field(i) for i in range(len(_ITEM))]
    fields[-1] = pa.array((fields[-1].to_numpy() + moved).astype(np.int32))
    sizes = np.bincount(np.repeat(bins, counts))
    fill = np.bincount(bins, weights=rows.column("fill").to_numpy()).astype(np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(serial + np.arange(len(sizes))), pa.array(fill), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_ITEM)))], ["sequence_id", "fill", "items"])


def _round(bins: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # at most about GROUP_BINS bins, each of at most ``capacity`` items
        if held:
            yield _merge(pa.Table.from_batches(held), capacity, _serial(number))

    return bins.repartition(groups, F.xxhash64("sequence_id", F.lit(number))).sortWithinPartitions(F.desc("fill"), "sequence_id").mapInArrow(merge, _BINS)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, spare: int = 4) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A bin with at most ``spare`` free places is final at once.
    """
    full = F.col("fill") >= capacity - spare
    rounds = [stage(local_bins(docs, vocabulary, end_id, capacity), "bins0")]
    left = rounds[0].where(~full).count()
    groups, number, done = max(1, rounds[0].rdd.getNumPartitions()), 0, [rounds[0].where(full)]
    rest = rounds[0].where(~full)
    while left > 1:
        groups, number = max(1, -(-groups // FAN_IN), -(-left // GROUP_BINS)), number + 1
        merged = stage(_round(rest, groups, number, capacity), f"bins{number}")
        still = merged.where(~full).count()
        done.append(merged.where(full))
        rest, shrunk, left = merged.where(~full), still < left, still
        if groups == 1 or (not shrunk and groups == -(-left // GROUP_BINS)):
            break
    out = rest
    for part in done:
        out = out.unionByName(part)
    return out.select("sequence_id", F.explode("items").alias("i")).select(
        F.col("i.doc_id"), F.col("i.piece"), F.col("i.start"), F.col("i.length").cast("long").alias("length"), F.col("i.ids_crc32"), "sequence_id", F.col("i.offset").cast("long").alias("offset")
    )
