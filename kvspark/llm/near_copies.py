"""Near copies: documents whose sets of word shingles have Jaccard 0.8 or more, exactly, by deletion-variant signatures.

A 64-bit fingerprint cannot tell 0.8 from 0.75, nor find every pair at 0.8 (see the README). So the cut that
``simhash`` makes of a fingerprint's bits is made here of the set itself, the bit vector over all shingles that a
fingerprint sums up. Two sets of sizes a <= b with Jaccard 0.8 differ in at most (a + b) / 9 shingles. Shingles are dealt
by hash to segments, fewer than twice which is that bound, so in one segment the sets differ by at most one shingle. Each
segment is indexed plainly and once without each of its shingles (the deletion variants): equal segments share the plain
key, segments that differ in one shingle share a variant of the one and the plain key of the other. An equality join on
keys finds all pairs; each is verified on the sets.

- *Bands.* Segments depend on size, so sizes are cut into bands such that sizes of a pair lie in one band or in two
  adjacent ones; a set is indexed in its own band and, as the larger one, in the band below.
- *Empty segments* are alike in all sets. There are a few more segments than the bound needs, and of a pair either set
  probes with its largest ones only, as many as the bound needs; empty keys are left out of the index.
- *Pruning.* Most documents share few shingles with any other. Of the first shingles in an order that all sets share, a
  fixed share must occur in another set as well (``prefix_size``, ``shared_least``); only the others are indexed.

Only a spanning forest of links is looked for: every row of a key is first held against one row of the key, then parts
of keys that are still of several parts against each other, and what is left after that pair by pair. So a large group of
near copies costs its rows. Keys that a sample shows to be hot are dealt to several tasks.

The sample and the lists made of it decide cost only, never a result.

Edge cases: a null text is empty; texts without a word are one group; fewer words than a shingle make one shingle of the
whole sequence; rows without doc_id cannot be named and stay; repeated rows leave one; rows that share a doc_id on different
texts are judged each; an empty table gives no rows; other columns travel along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, slices, stage, unstage
from .components import components
from .simhash import _mixed, hot_keys, salts, sampled, shingle_hashes

SHINGLE = 5
#: Sets below this size have no partner but themselves.
LEAST = 4
_U64 = np.uint64
_BATCH = 2 << 20

#: Documents of the sample that names common shingles, and in how many of them those occur at least.
SAMPLED, COMMON_COUNT = 8_000, 3
#: Sets of the sample that names hot keys, and in how many of them those occur at least.
SAMPLED_SETS, HOT_COUNT = 1_000, 8
#: Common shingles, and hot keys, at most: what is broadcast.
COMMON = 100_000
#: Sets that a task remembers to have given the first shingles of.
SEEN = 250_000
#: Rows of one key that a task holds to see whether they can be a pair; of longer runs all rows go on.
HELD_ROWS = 1 << 20
#: Rounds in which parts of a key are held against each other by one node each.
PART_ROUNDS = 1
#: Longs of the short sketch.
FOLD = 8


# -- sizes -------------------------------------------------------------------------------------------------------------


def _band_starts() -> np.ndarray:
    """First size of each band: five quarters of a band's last size lie in the next one."""
    out = [LEAST]
    while out[-1] < 1 << 40:
        out.append(5 * out[-1] // 4 + 1)
    return np.array(out)


_STARTS = _band_starts()
_LARGEST = _STARTS[1:] - 1
#: By band: differing shingles at most; segments that are probed with; all segments.
APART = (_LARGEST + 5 * _LARGEST // 4) // 9
PROBES = APART // 2 + 1
SEGMENTS = PROBES + np.where(APART < 2, 0, 1 + APART // 12)


def band(n: np.ndarray) -> np.ndarray:
    """-1 for sets that have no partner."""
    return np.searchsorted(_STARTS, n, side="right") - 1


def _tenth(n: int) -> int:
    return max(1, n // 10)


def prefix_size(n: int) -> int:
    """How many first shingles of a set of n are looked at."""
    return min(n, n - -(-4 * n // 5) + _tenth(n))


def shared_least(n: int) -> int:
    """How many of those another set must hold.

    Sets of a and b with Jaccard 0.8 share at least four fifths of the larger one, so at most a fifth of each is not
    shared, and the first ``_tenth`` of the smaller one's size that they share is among both sets' first shingles.
    """
    return _tenth(-(-4 * n // 5))


# -- sets --------------------------------------------------------------------------------------------------------------


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(t or b"", SHINGLE)) for t in texts.to_pylist()]


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(hashes.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, _U64)]).view(np.int64)))


def prefix(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set, common ones last: (those not common, number of common ones)."""
    last = np.zeros(len(hashes), bool)
    if len(common) and len(hashes):
        last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    size, rare = prefix_size(len(hashes)), hashes[~last]
    return rare[:size], size - min(size, len(rare))


def sketch(hashes: np.ndarray) -> bytes:
    """Per bit, whether an odd number of hashes falls on it; at least four bits a hash, a power of two from 64 * FOLD on."""
    bits = max(64 * FOLD, 1 << (4 * len(hashes) - 1).bit_length())
    odd = np.bincount(((hashes >> _U64(17)) & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(odd: bytes) -> np.ndarray:
    """A sketch as one of 64 * FOLD bits."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, "<i8").reshape(-1, FOLD), axis=0)


def possible(nu: np.ndarray, nv: np.ndarray, ou: pa.Array, ov: pa.Array) -> np.ndarray:
    """Whether Jaccard 0.8 is possible by size and by sketch: sets differ in no fewer shingles than sketches in bits."""
    out = 5 * np.minimum(nu, nv) >= 4 * np.maximum(nu, nv)
    widths = [np.array([len(x) for x in o.to_pylist()]) for o in (ou, ov)]
    kind = widths[0] << 32 | widths[1]
    for k in np.unique(kind[out]) if len(kind) else ():
        at, least = np.flatnonzero(out & (kind == k)), int(min(k >> 32, k & 0xFFFFFFFF))
        for cut in range(0, len(at), step := max(1, (8 << 20) // max(1, least))):
            some = at[cut : cut + step]
            a, b = (np.frombuffer(b"".join(o.take(pa.array(some)).to_pylist()), "<u8").reshape(len(some), -1, least // 8) for o in (ou, ov))
            apart = np.bitwise_count(np.bitwise_xor.reduce(a, axis=1) ^ np.bitwise_xor.reduce(b, axis=1)).sum(axis=1, dtype=np.int64)
            out[some] = 9 * apart <= nu[some] + nv[some]
    return out


# -- signatures --------------------------------------------------------------------------------------------------------

PLAIN, PROBE, OWN = 1, 2, 4


def signatures(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set, flags) of sets given as concatenated hashes and sizes.

    flags: PLAIN of a whole segment, not a variant; PROBE of a segment that the set probes with; OWN in the set's own band.
    Two rows of one key are a candidate if each flag is set in one of them.
    """
    held = (np.empty(0, _U64), np.empty(0, np.int64), np.empty(0, np.int8))
    keys, sets, flags = [held[0]], [held[1]], [held[2]]
    mixed, all_owners, bands = _mixed(flat, 1), np.repeat(np.arange(len(sizes)), sizes), band(sizes)
    for below in (0, 1):
        bands_here = bands - below
        some = np.flatnonzero(bands_here >= 0)
        if not len(some):
            continue
        g = bands_here[some]
        m = SEGMENTS[g]
        offsets = np.cumsum(m) - m
        place = np.full(len(sizes), -1)
        place[some] = np.arange(len(some))
        inside = place[all_owners] >= 0
        own, h = place[all_owners[inside]], mixed[inside]
        cell = offsets[own] + ((h >> _U64(11)) % m[own].astype(_U64)).astype(np.int64)
        owner = np.repeat(np.arange(len(some)), m)
        segment = np.arange(len(owner)) - offsets[owner]
        total, count = np.zeros(len(owner), _U64), np.bincount(cell, minlength=len(owner))
        np.add.at(total, cell, h)
        probes = np.zeros(len(owner), bool)
        order = np.lexsort((segment, -count, owner))
        probes[order] = segment < PROBES[g][owner]  # ranks of a set's segments run like its segments' numbers
        start = _mixed(segment.astype(_U64) + (g[owner].astype(_U64) << _U64(40)), 2)
        shown = (count > 0) | probes
        band_flag = 0 if below else OWN
        keys += [_mixed(total + start, 3)[shown], _mixed(total[cell] - h + start[cell], 3)]
        sets += [some[owner[shown]], some[own]]
        flags += [(PLAIN | band_flag | np.where(probes[shown], PROBE, 0)).astype(np.int8), (band_flag | np.where(probes[cell], PROBE, 0)).astype(np.int8)]
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(flags)


def _some_sets(batches: Iterator[pa.RecordBatch], most: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sizes, nodes, shingles) of rows (node, shingles), about ``most`` shingles at a time."""
    for batch in batches:
        lists, node = batch.column("shingles"), batch.column("node").to_numpy()
        ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(_U64)
        at = 0
        while at < len(node):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield np.diff(ends[at : stop + 1]), node[at:stop], flat[ends[at] : ends[stop]]
            at = stop


_ROWS = "key long, salt int, node long, n long, flags byte"
_MET = "key long, salt int, node long, n long, flags byte, centre long"


def _signed(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """Signature rows of ``sets``; salt is -1, but for hot keys, whose rows are dealt by node."""
    sent = sets.sparkSession.sparkContext.broadcast(hot)  # at most COMMON keys

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sizes, node, flat in _some_sets(batches):
            key, of, flags = signatures(flat, sizes)
            key = key.view(np.int64)
            salt = salts(key, node[of], sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(node[of]), pa.array(sizes[of]), pa.array(flags)], ["key", "salt", "node", "n", "flags"])
            pa.default_memory_pool().release_unused()

    return sets.select("node", "shingles").mapInArrow(make, _ROWS)


def _meeting(batches: Iterator[pa.RecordBatch], most: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, salt and node: those of keys that may hold a pair, with the first node of their run.

    Rows of hot keys all pass, as their partners may be with other salts. Holds the rows of the open run only.
    """
    names = ["key", "salt", "node", "n", "flags", "centre"]

    def batch_of(rows: list[np.ndarray], centre: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(centre)], names)

    def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, salt, node, _, flags = rows
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        good = (sizes > 1) & (np.bitwise_or.reduceat(flags, starts) == PLAIN | PROBE | OWN) | (salt[starts] >= 0)
        keep = np.repeat(good, sizes)
        return batch_of([r[keep] for r in rows], np.repeat(node[starts], sizes)[keep])

    held: list[np.ndarray] | None = None
    passing: tuple | None = None  # (key, salt, centre) of a run too long to hold: its rows go on as they come
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in names[:-1]]
        if passing is not None:
            other = np.flatnonzero((rows[0] != passing[0]) | (rows[1] != passing[1]))
            n = int(other[0]) if len(other) else len(rows[0])
            if n:
                yield batch_of([r[:n] for r in rows], np.full(n, passing[2]))
            rows = [r[n:] for r in rows]
            if len(rows[0]):
                passing = None
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = (rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield whole([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
        if len(held[0]) > most:
            passing = (held[0][0], held[1][0], held[2][0])
            yield batch_of(held, np.full(len(held[0]), passing[2]))
            held = None
    if held is not None:
        yield whole(held)


# -- jobs --------------------------------------------------------------------------------------------------------------


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a sample hold."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            yield pa.RecordBatch.from_arrays([_lists(_sets(batch.column("text"))).flatten()], ["key"])

    sample = sampled(docs, F.col("text"), SAMPLED).select(F.col("text").cast("binary").alias("text"))
    return np.sort(hot_keys(sample.mapInArrow(shingles, "key long"), COMMON_COUNT, COMMON).view(_U64))


def set_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, mark, n, known, keys) of every row: digest and size of its set of shingles, and its first shingles.

    ``mark`` is the start of the digest. A task gives the first shingles of a set once (or a few times, where it meets more
    than ``SEEN`` sets), so a group of exact copies costs a few rows a task.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))  # at most COMMON shingles

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text", _BATCH):
            each, marks, digests, keys, known = _sets(batch.column("text")), [], [], [], []
            for h in each:
                digests.append(_digest(h))
                marks.append(mark := int.from_bytes(digests[-1][:8], "little", signed=True))
                first, count = prefix(h, common.value)
                keys.append(first[:0] if mark in seen else first)
                known.append(count)
                seen = seen if len(seen) < SEEN else set()
                seen.add(mark)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(marks, pa.int64()), pa.array([len(h) for h in each], pa.int64()), pa.array(known, pa.int64()), _lists(keys)],
                ["doc_id", "digest", "mark", "n", "known", "keys"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(prints, "doc_id long, digest binary, mark long, n long, known long, keys array<long>")


def _in_other_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of rows (key, mark), sorted, whose key occurs with another mark too; one for each such key."""
    before: tuple[int, int] | None = None  # the last row
    shared = False  # whether its key has come with another mark
    for batch in batches:
        if not batch.num_rows:
            continue
        key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
        if before is not None:
            key, mark = np.append(before[0], key), np.append(before[1], mark)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
        key, mark = key[new], mark[new]
        like_last = np.concatenate([[shared], key[1:] == key[:-1]])
        like_next = np.append(key[1:] == key[:-1], False)
        out = like_last | like_next
        out[0] &= before is None or not shared  # the row before was given already
        yield pa.RecordBatch.from_arrays([pa.array(mark[out])], ["mark"])
        before, shared = (key[-1], mark[-1]), bool(like_last[-1])


def _survivors(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, doc_id, digest) of the classes that share enough of their first shingles with others."""
    width = shuffle_width(prints.sparkSession)
    keys = prints.where(F.col("n") >= LEAST).select(F.explode("keys").alias("key"), "mark")
    keys = keys.repartition(width, "key").sortWithinPartitions("key", "mark")
    hits = keys.mapInArrow(_in_other_runs, "mark long").groupBy("mark").agg(F.count(F.lit(1)).alias("hits"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) / 10))
    found = classes.where(F.col("n") >= LEAST).join(hits, "mark", "left")
    return found.where(F.coalesce("hits", F.lit(0)) + F.col("known") >= least).select("node", "doc_id", "digest")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, odd, fold, shingles) of the wanted classes (node, doc_id, digest), hashed again from the text of that row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            each = _sets(batch.column("text"))
            good = np.array([_digest(h) == d for h, d in zip(each, batch.column("digest").to_pylist(), strict=True)])
            each = [h for h, ok in zip(each, good, strict=True) if ok]
            odd = [sketch(h) for h in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").filter(pa.array(good)), pa.array([len(h) for h in each], pa.int64()), pa.array(odd, pa.binary()), _lists([folded(o).view(_U64) for o in odd]), _lists(each)],
                ["node", "n", "odd", "fold", "shingles"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.join(wanted, "doc_id").select("node", "digest", "text").mapInArrow(hashed, "node long, n long, odd binary, fold array<long>, shingles array<long>")


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have Jaccard 0.8 or more, in whole numbers; a staged table."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nu, nv = (batch.column(c).to_numpy() for c in ("nu", "nv"))
                yield batch.select(["u", "v"]).filter(pa.array(possible(nu, nv, batch.column("ou"), batch.column("ov"))))

    def side(c: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(c), *(F.col(x).alias(f"{x[0]}{c}") for x in columns))

    met = pairs.join(side("u", "n", "odd"), "u").join(side("v", "n", "odd"), "v").select("u", "v", "nu", "nv", "ou", "ov")
    met = stage(met.mapInArrow(screen, "u long, v long"), "screened")
    # only sets that are left in a pair move; by a merge join at every size, as they grow with the documents
    sets = stage(sets.select("node", "shingles").join(met.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi"), "left")
    near = met.join(side("u", "shingles").hint("merge"), "u").join(side("v", "shingles").hint("merge"), "v")
    shared, either = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    links = stage(near.where(9 * shared >= 4 * either).select("u", "v"), "links")
    unstage(met, sets)
    return links


def _candidate(a: str, b: str) -> Column:
    """Whether rows may be a pair: each flag in one of them, and sizes and short sketches that Jaccard 0.8 allows."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.get(f"{a}.fold", F.lit(i)).bitwiseXOR(F.get(f"{b}.fold", F.lit(i)))) for i in range(FOLD)), F.lit(0))
    return (F.col(f"{a}.flags").bitwiseOR(F.col(f"{b}.flags")) == (PLAIN | PROBE | OWN)) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m)


def near_links(sets: DataFrame) -> DataFrame:
    """(u, v): pairs of ``sets`` (a staged table: node, n, odd, fold, shingles) with Jaccard 0.8, enough to connect all that are."""
    width = shuffle_width(sets.sparkSession)
    hot = hot_keys(_signed(sampled(sets, F.col("node"), SAMPLED_SETS), np.empty(0, np.int64)), HOT_COUNT, COMMON)
    signed = _signed(sets, hot).repartition(width, "key", "salt").sortWithinPartitions("key", "salt", "node")
    met = stage(signed.mapInArrow(_meeting, _MET), "met")
    # each row against the first node of its key, and of hot keys the first nodes of the salts against each other
    centres = met.where("salt >= 0").select("key", "centre").distinct()
    across = centres.join(centres.groupBy("key").agg(F.min("centre").alias("first")), "key").where("centre != first").select(*_pair("centre", "first"))
    tested = [stage(met.where("node != centre").select(*_pair("node", "centre")).unionByName(across).distinct(), "stars")]
    links = [_alike(tested[0], sets)]
    for turn in range(PART_ROUNDS + 1):
        parts = stage(components(_all(links)), "parts")
        held = met.join(parts.withColumnRenamed("component", "part"), "node", "left").select("key", "node", "n", "flags", F.coalesce("part", "node").alias("part"))
        mixed = held.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
        mixed = stage(mixed, "mixed")
        rows = stage(held.join(mixed, "key"), "rows")
        if rows.isEmpty():
            break
        pairs = _between_parts(rows, turn) if turn < PART_ROUNDS else _all_between(rows, sets)
        for before in tested:
            pairs = pairs.join(before, ["u", "v"], "left_anti")
        tested.append(stage(pairs, "pairs"))
        unstage(parts, mixed, rows)
        links.append(_alike(tested[-1], sets))
    unstage(met, *tested)
    return _all(links)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _between_parts(rows: DataFrame, turn: int) -> DataFrame:
    """One pair for every part of a key: a node of it, by a hash that differs by key, and one of the key's first part."""
    rank = F.xxhash64("node", "key", F.lit(turn))
    one = rows.groupBy("key", "part").agg(F.min_by("node", rank).alias("node"))
    first = one.groupBy("key").agg(F.min_by("node", F.xxhash64("part", "key", F.lit(turn))).alias("other"))
    return one.join(first, "key").where("node != other").select(*_pair("node", "other")).distinct()


def _all_between(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """All candidates of two parts. Rows of a key's largest part are only held against the others, not each other."""
    rows = rows.join(sets.select("node", "fold"), "node")
    largest = rows.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", "count").alias("largest"))
    others = rows.join(largest, "key").where("part != largest")
    a, b = others.alias("a"), rows.alias("b")
    once = (F.col("b.part") == F.col("a.largest")) | (F.col("a.part") < F.col("b.part"))
    return a.join(b, F.col("a.key") == F.col("b.key")).where((F.col("a.part") != F.col("b.part")) & once & _candidate("a", "b")).select(*_pair("a.node", "b.node")).distinct()


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, but for one document (the smallest doc_id) of each near-duplicate group only.

    Near duplicates have Jaccard 0.8 or more of their distinct five-word shingles, or are linked by such documents.
    """
    prints = stage(set_prints(docs.where("doc_id is not null")), "prints")
    # one class a set of shingles, numbered
    classes = prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.min(c).alias(c) for c in ("mark", "n", "known")))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    repeated = prints.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    wanted = stage(_survivors(prints, classes), "wanted")
    sets = _sets_of(docs, wanted)
    sets = stage(sets.dropDuplicates(["node"]) if repeated else sets, "sets")
    found = components(near_links(sets))
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    kept = stage(classes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(first).select("first.*"), "kept")
    if repeated:  # an id does not tell its rows apart: their sets of shingles do
        mark = "_digest"
        while mark in {c.lower() for c in docs.columns}:
            mark += "_"
        left = _marked(docs, mark).join(kept.withColumnRenamed("digest", mark), ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
        out = left.select(docs.columns).unionByName(docs.where("doc_id is null"))
    else:
        gone = stage(prints.select("doc_id").join(kept, "doc_id", "left_anti"), "gone")
        out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    unstage(prints, classes, wanted, sets)
    return out


def _marked(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the digest of each row's set of shingles."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            each = _sets(batch.column("text").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(h) for h in each], pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(digests, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))
