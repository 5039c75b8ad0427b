"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two linked fingerprints must, by the pigeonhole principle, agree in
one segment but for at most one bit: ``k // 2 + 1`` segments for ``k`` bits (two of 32 bits for 64-bit fingerprints
and k = 3). Each segment is indexed plainly and once for every set bit with that bit as a wildcard (the deletion
variant). Two segments that differ in one bit then share exactly one key: the variant of the one with the bit, the
plain key of the other; equal segments share the plain key. So an equality join on keys finds all pairs, and every
pair meets once a segment. Rows that share a key are verified by the distance of the whole fingerprints.

Scale: equal fingerprints are one class before anything is indexed, so a group of exact copies costs one row, whatever
its size. Keys are dealt by hash (those that a sample shows to be hot, to several tasks) and streamed in sorted order. A
key with more than ``Plan.block`` rows is cut once more, by deletion variants of the other bits, so its rows grow by a
fixed factor and meet few others; a sub-key that is still larger is cut into blocks, and every pair of blocks is a task's
work of its own. No group is held whole anywhere. From each group only a spanning forest of its links is kept, never its
pairs, which leaves components unchanged.

The same cut of whole sets of shingles, for a similarity of 0.8, is in ``near_copies``.

Edge cases: a null text is empty; a text without a word has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle of the whole sequence; equal texts always share a class; rows without doc_id belong to
the class of their fingerprint, whose component is named by the smallest doc_id present (null if there is none); an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, slices, stage, unstage
from .components import components

_ONES = np.uint64(0x0101010101010101)
_U64 = np.uint64


@dataclass(frozen=True)
class Plan:
    """How texts become fingerprints and which fingerprints are linked.

    shingle: words a shingle. bits: length of a fingerprint, a multiple of 64. distance: differing bits that still
    link. segment_bits, segments: the cut that is indexed (from bit 0). once: count a repeated shingle once. block: rows
    of one key that a task compares at once.
    """

    shingle: int = 3
    bits: int = 64
    distance: int = 3
    segment_bits: int = 32
    segments: int = 2
    once: bool = False
    block: int = 4096

    @property
    def exact(self) -> bool:
        """True where the pigeonhole principle finds every link."""
        return self.distance < 2 * self.segments and self.segment_bits * self.segments == self.bits


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the words of ``text``, A-Z lower-cased; repeats included."""
    words = text.lower().split()  # of bytes: exactly A-Z, and exactly the bytes 09-0D and 20
    if not words:
        return np.empty(0, _U64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(view[a:b], 42) for a, b in pairs], _U64)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Further 64 bits for each hash (SplitMix64's finaliser); the first 64 are the hash itself."""
    if not turn:
        return h
    z = h + _U64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
    return z ^ (z >> _U64(31))


def majority(hashes: np.ndarray, bounds: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprints as uint64 [documents, words]: a bit is 1 if set in over half of a document's hashes.

    ``bounds`` are the documents' offsets in ``hashes``. Counts are kept eight to a 64-bit lane set, flushed every
    255 hashes, so the work is a few vector operations a hash word.
    """
    n, out = len(bounds) - 1, np.zeros((len(bounds) - 1, words), _U64)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # chunks of up to 255 hashes, so that byte lanes cannot overflow
    per = (sizes[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), per)
    first = np.cumsum(per) - per
    starts = bounds[full][owner] + 255 * (np.arange(len(owner)) - first[owner])
    half = sizes[full][:, None]
    for w in range(words):
        h = _mixed(hashes, w)
        value = np.zeros(len(full), _U64)
        for bit in range(8):
            lanes = np.add.reduceat((h >> _U64(bit)) & _ONES, starts)
            counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            ones = (2 * counts > half).astype(_U64)
            for byte in range(8):
                value |= ones[:, byte] << _U64(8 * byte + bit)
        out[full, w] = value
    return out


def fingerprints(docs: DataFrame, plan: Plan = Plan(), text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bytes, most significant first in each 64-bit word."""
    words = plan.bits // 64

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            each = [shingle_hashes(t or b"", plan.shingle) for t in batch.column("text").to_pylist()]
            if plan.once:
                each = [np.unique(h) for h in each]
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int64)
            raw = majority(np.concatenate(each), bounds, words).astype(">u8").tobytes()
            size = 8 * words
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(prints, "doc_id long, fp binary")


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(_U64).reshape(-1, words)


def signatures(nodes: DataFrame, plan: Plan, segments: range, variants: bool) -> DataFrame:
    """(key, node, plain, part) of the given segments of the nodes' fingerprints, and of their one-wildcard variants."""
    words, width = plan.bits // 64, plan.segment_bits
    cut = _U64((1 << width) - 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                rows = batch.slice(at, 400)
                node, part, fp = rows.column("node").to_numpy(), rows.column("part").to_numpy(), _matrix(rows.column("fp"), words)
                keys, ids, parts, plain = [], [], [], []
                for s in segments:
                    word, shift = divmod(s * width, 64)
                    value = fp[:, word] >> _U64(shift)
                    if shift + width > 64:
                        value = value | (fp[:, word + 1] << _U64(64 - shift))
                    value &= cut
                    tag = _U64(s) << _U64(width)
                    keys.append(value | tag), ids.append(node), parts.append(part), plain.append(np.ones(len(node), bool))
                    for bit in range(width if variants else 0):
                        has = ((value >> _U64(bit)) & _U64(1)).astype(bool)
                        keys.append((value[has] & ~(_U64(1) << _U64(bit))) | tag), ids.append(node[has]), parts.append(part[has]), plain.append(np.zeros(int(has.sum()), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(plain)), pa.array(np.concatenate(parts))], ["key", "node", "plain", "part"])

    return nodes.mapInArrow(make, "key long, node long, plain boolean, part long")


#: Nodes of the sample that names hot keys, in how many of them those occur at least, and how many are named at most.
SAMPLED, HOT_COUNT, MOST_HOT = 4_000, 32, 100_000
#: Tasks that a hot key is dealt to.
SALTS = 16


def sampled(rows: DataFrame, by: Column, most: int = SAMPLED) -> DataFrame:
    """About ``most`` rows, by a hash."""
    every = -(-max(1, rows.count()) // most)
    return rows.where(F.pmod(F.xxhash64(by), F.lit(every)) == 0)


def hot_keys(rows: DataFrame, least: int = HOT_COUNT, most: int = MOST_HOT) -> np.ndarray:
    """Sorted: at most ``most`` values of ``key`` that occur ``least`` times or more. They decide cost, never results."""
    counts = rows.groupBy("key").count().where(F.col("count") >= least)
    return np.sort(np.array([r.key for r in counts.orderBy(F.desc("count"), "key").limit(most).select("key").collect()], np.int64))


def salts(key: np.ndarray, node: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """-1, but for hot keys one of ``SALTS`` numbers, by node: their rows are dealt to as many tasks."""
    out = np.full(len(key), -1, np.int32)
    if len(hot):
        known = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        out[known] = (_mixed(node[known].astype(_U64), 4) % _U64(SALTS)).astype(np.int32)
    return out


def salted(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """``rows`` (key, node, ...) with their salt."""
    sent = rows.sparkSession.sparkContext.broadcast(hot)  # at most MOST_HOT keys

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = salts(batch.column("key").to_numpy(), batch.column("node").to_numpy(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt)], [*batch.schema.names, "salt"])

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField("salt", T.IntegerType())])) if len(hot) else rows.withColumn("salt", F.lit(-1))


#: Rows of one key that are held to see whether they are of one part; of longer runs all rows go on.
HELD_ROWS = 1 << 20


def _met(key: np.ndarray, node: np.ndarray, plain: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(plain), pa.array(block)], ["key", "node", "plain", "block"])


def _meeting(batches: Iterator[pa.RecordBatch], block: int, variants: bool, most: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, salt and plain first: those of keys that may hold a link not known yet, with their block.

    Such a key has a plain row and another (with ``variants``, a variant: plain rows have met before), and its rows are
    of two parts at least: links within a part would join what is joined. Rows of salted keys all pass, in block 1, as
    their partners may be elsewhere. Holds the rows of the open run only.
    """

    def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, salt, node, plain, part = rows
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        good = (sizes > 1) & plain[starts] & (np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts))
        if variants:
            good &= ~plain[starts + sizes - 1]
        dealt = salt[starts] >= 0
        keep = np.repeat(good | dealt, sizes)
        place = (np.arange(len(key)) - np.repeat(starts, sizes)) // block
        return _met(key[keep], node[keep], plain[keep], np.where(salt >= 0, 1, place)[keep])

    held: list[np.ndarray] | None = None
    run, goes, place = None, False, 0  # a run too long to hold: its rows go out (or not) as they come
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "node", "plain", "part")]
        if run is not None:
            n = int(((rows[0] == run[0]) & (rows[1] == run[1])).sum())
            if goes and n:
                yield _met(rows[0][:n], rows[2][:n], rows[3][:n], (place + np.arange(n)) // block)
            place += n
            rows = [r[n:] for r in rows]
            if len(rows[0]):
                run = None
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        cut = len(rows[0]) - int(((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])).sum())
        if cut:
            yield whole([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
        if len(held[0]) > most:
            run, goes, place = (held[0][0], held[1][0]), bool(held[3][0] or held[1][0] >= 0), len(held[0])
            if goes:
                yield _met(held[0], held[2], held[3], np.arange(place) // block)
            held = None
    if held is not None:
        yield whole(held)


def forest(fp: np.ndarray, flags: np.ndarray, block: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows, as row pairs, by breadth-first search.

    Rows link if their fingerprints differ in ``distance`` bits or fewer and each flag is set in one of them (two variants
    meet under other keys). Of rows of two blocks, only those of different blocks are compared.
    """
    rest, edges = np.arange(len(fp)), []
    across = len(block) and block.min() != block.max()
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]).sum(axis=1, dtype=np.int64) <= distance
            if flags[x] != 3:
                near &= (flags[rest] | flags[x]) == 3
            if across:
                near &= block[rest] != block[x]
            found = rest[near]
            edges += [(x, y) for y in found]
            queue += found.tolist()
            rest = rest[~near]
    return edges


def near_edges(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): links between nodes, enough of them to connect whatever is linked.

    ``nodes``: node (long, unique) and fp (binary), a table that is cheap to read a few times. A few plain segments meet
    first, then the other ones, then the variants; keys whose rows are of one part by then are not looked at again, so
    a large group of near copies, which shares most of its keys, is compared under a few of them only.
    """
    few, every = range(max(1, plan.segments // 6)), range(plan.segments)
    rounds = [(few, False), (every[len(few) :], False), (every, True)]
    parts, links = nodes.withColumn("part", F.col("node")), None
    for i, (segments, variants) in enumerate(rounds):
        if not len(segments):
            continue
        found = _verified(parts, plan, segments, variants)
        if i:
            unstage(parts)
        links = found if links is None else links.unionByName(found)
        if i < len(rounds) - 1:
            joined = components(links)
            parts = stage(nodes.join(joined, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("part")), "parts")
    return links


def _verified(nodes: DataFrame, plan: Plan, segments: range, variants: bool) -> DataFrame:
    """Links found under the keys of one round, as a staged table: a spanning forest of each key's."""
    spark = nodes.sparkSession
    width = shuffle_width(spark)
    order = [F.col("key"), F.col("salt"), F.col("plain").desc()]
    rows = salted(signatures(nodes, plan, segments, variants), hot_keys(signatures(sampled(nodes, F.col("node")), plan, segments, variants)))
    met = rows.repartition(width, "key", "salt").sortWithinPartitions(*order)
    met = stage(met.mapInArrow(lambda batches: _meeting(batches, plan.block, variants), "key long, node long, plain boolean, block long"), "met")
    prints = nodes.select("node", "fp")
    # keys of more than one block are cut once more, by the other bits of the fingerprint
    large = stage(met.where("block > 0").select("key").distinct(), "large")
    small = met.join(large, "key", "left_anti").join(prints, "node").select("key", F.lit(0).cast("long").alias("sub"), "node", "fp", F.when(F.col("plain"), 3).otherwise(2).cast("byte").alias("flags"))
    cut = _sub_keys(met.join(large, "key").join(prints, "node"), plan).repartition(width, "key", "sub").sortWithinPartitions("key", "sub")
    cut = stage(cut.mapInArrow(lambda batches: _in_blocks(batches, plan.block), f"{_CUT}, block long"), "cut")
    # of a sub-key that still is larger than a block, every pair of blocks is compared on its own
    blocks = cut.where("block > 0").groupBy("key", "sub").agg((F.max("block") + 1).alias("blocks"))
    dealt = cut.join(blocks, ["key", "sub"], "left").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)))
    dealt = dealt.select("key", "sub", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "fp", "flags")
    zero = F.lit(0).cast("long")
    full = small.select("key", "sub", zero.alias("a"), zero.alias("b"), zero.alias("block"), "node", "fp", "flags").unionByName(dealt)
    full = full.repartition(width, *_GROUP).sortWithinPartitions(*_GROUP, "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            tail = [batch.column(c)[-1].as_py() for c in _GROUP]
            first = [held[0].column(c)[0].as_py() for c in _GROUP]
            if tail != first:  # all but the last group are whole
                rows = pa.Table.from_batches(held).combine_chunks()
                at = _run_starts(rows)[-1]
                yield _linked(rows.slice(0, at), plan)
                held = rows.slice(at).to_batches()
        if held:
            yield _linked(pa.Table.from_batches(held).combine_chunks(), plan)

    out = stage(full.mapInArrow(verify, "u long, v long").distinct(), "links")
    unstage(met, large, cut)
    return out


_GROUP = ("key", "sub", "a", "b")
_CUT = "key long, sub long, node long, fp binary, flags byte"


def _sub_keys(rows: DataFrame, plan: Plan) -> DataFrame:
    """(key, sub, node, fp, flags) of rows (key, node, plain, fp): under a key, the other bits are cut in the same way.

    Rows of one key are alike in its segment but for a bit, so the other bits of linked ones differ in ``distance`` at
    most, and among ``distance // 2 + 1`` parts of them one differs in at most one bit. flags: 1 if the segment is plain,
    2 if the part is; a pair is a candidate if each is set in one of its rows.
    """
    words, width, pieces = plan.bits // 64, plan.segment_bits, plan.distance // 2 + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                key, plain = some.column("key").to_numpy(), some.column("plain").to_numpy(zero_copy_only=False).astype(np.int8)
                bits = np.unpackbits(_matrix(some.column("fp"), words).astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool)
                out: list[list[np.ndarray]] = [[], [], []]
                for s in range(plan.segments):
                    of = np.flatnonzero(key >> width == s)
                    rest = np.delete(np.arange(plan.bits), np.arange(s * width, (s + 1) * width))
                    for piece, places in enumerate(np.array_split(rest, pieces)):
                        own = bits[of][:, places]
                        weight = _mixed(np.arange(len(places), dtype=_U64) + _U64(piece << 16), 1)
                        total = (own * weight).sum(axis=1, dtype=_U64) + _mixed(np.full(1, piece, _U64), 2)
                        row, bit = np.nonzero(own)
                        for at_rows, sub, flag in ((of, total, 2), (of[row], total[row] - weight[bit], 0)):
                            out[0].append(at_rows), out[1].append(sub), out[2].append(plain[at_rows] | np.int8(flag))
                at_rows, sub, flags = map(np.concatenate, out)
                picked = some.take(pa.array(at_rows))
                yield pa.RecordBatch.from_arrays([picked.column("key"), pa.array(sub.view(np.int64)), picked.column("node"), picked.column("fp"), pa.array(flags)], ["key", "sub", "node", "fp", "flags"])

    return rows.select("key", "node", "plain", "fp").mapInArrow(make, _CUT)


def _in_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sub), those of groups of two or more, with the block that their place in the group is in."""
    last, place = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub = batch.column("key").to_numpy(), batch.column("sub").to_numpy()
        new = np.concatenate([[(key[0], sub[0]) != last], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        starts = np.flatnonzero(new)
        at = np.arange(len(key))
        places = at - np.repeat(starts, np.diff(np.append(starts, len(key)))) if new[0] else None
        if places is None:  # the group of the batch before goes on
            starts = np.concatenate([[0], starts])
            places = at - np.repeat(starts, np.diff(np.append(starts, len(key))))
            first = int(starts[1]) if len(starts) > 1 else len(key)
            places[:first] += place
        last, place = (key[-1], sub[-1]), int(places[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places // block)], [*batch.schema.names, "block"])


def _run_starts(rows: pa.Table) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in _GROUP:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _linked(rows: pa.Table, plan: Plan) -> pa.RecordBatch:
    fp, node = _matrix(rows.column("fp"), plan.bits // 64), rows.column("node").to_numpy()
    flags, block = rows.column("flags").to_numpy(), rows.column("block").to_numpy()
    starts = _run_starts(rows)
    sizes = np.diff(np.append(starts, rows.num_rows))
    two = starts[sizes == 2]  # most groups: compared all at once
    a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
    ok = ((flags[two] | flags[two + 1]) == 3) & ((a[two] == b[two]) | (block[two] != block[two + 1]))
    two = two[ok]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1, dtype=np.int64) <= plan.distance]
    pairs = [np.stack([two, two + 1], axis=1)]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = block[s : s + n] if a[s] != b[s] else np.zeros(n, np.int64)
        if a[s] != b[s] and own.min() == own.max():
            continue
        if found := forest(fp[s : s + n], flags[s : s + n], own, plan.distance):
            pairs.append(np.array(found) + s)
    at = np.concatenate(pairs)
    u, v = node[at[:, 0]], node[at[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links, itself included."""
    prints = stage(fingerprints(docs, plan), "prints")
    # one class a fingerprint; its node is its smallest doc_id (classes of null ids only cannot be named and stay out)
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    links = near_edges(classes.where("node is not null"), plan)
    found = components(links)
    named = stage(classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    unstage(classes)
    # both sides are written tables: adaptive execution splits the fingerprint of a large group of copies
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
