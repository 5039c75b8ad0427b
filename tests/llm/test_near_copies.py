"""The stage of near copies against brute force: sets of five-word shingles, Jaccard 0.8."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from kvspark.llm import near_copies as near

def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_leave_one_of_each_group(spark, copied):
    rows, groups = copied
    rng = random.Random(1)
    lone = [(5000 + i, " ".join(str(rng.random()) for _ in range(100))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + lone], "doc_id long, text string, lang string, source string, n_chars long")
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert {i for i, _ in lone} <= left and {g[0] for g in groups} <= left
    texts = dict(rows)
    for g in groups:
        for a, b in itertools.combinations(g, 2):
            x, y = shingles(texts[a]), shingles(texts[b])
            if 10 * len(x & y) >= 8 * len(x | y):
                assert not {a, b} <= left


DOCS = "doc_id long, text string"


def planted(rng, at, shape):
    """Pairs of texts of 9k, ... own shingles that differ in their last k words: Jaccard (m - k) / (m + k) of m shingles."""
    rows, pairs = [], []
    for m, k in shape:
        w = [f"w{rng.getrandbits(60):x}" for _ in range(m + 4 + k)]
        rows += [(at, " ".join(w[: m + 4])), (at + 1, " ".join(w[: m + 4 - k] + w[m + 4 :]))]
        pairs.append((at, at + 1))
        at += 2
    return rows, pairs


def test_every_pair_of_similarity_from_08_is_found(spark):
    """Also at exactly 0.8."""
    rows, pairs = planted(random.Random(21), 0, [(m * k, k) for m in (9, 10, 11, 12) for k in (1, 2, 3, 5, 8, 13, 20, 34) for _ in range(4)])
    left = {r.doc_id for r in near.without_near_copies(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert left == {a for a, _ in pairs}


def test_pairs_below_08_stay(spark):
    """Short texts too: one changed word of 10 leaves 0.71, of 12 leaves 0.78."""
    rows, pairs = planted(random.Random(22), 0, [(m * k, k) for m in (6, 7, 8) for k in (1, 1, 1, 1, 2, 3, 5, 8, 13, 20, 34)])
    assert rows[0][1].count(" ") == 9
    rows += [(1000, "one two three four"), (1001, "one two three five"), (1002, "one"), (1003, "two")]
    kept = near.without_near_copies(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows]


def brute_kept(rows):
    """The smallest id of each component of pairs with five-word Jaccard 0.8 or more."""
    sets = {i: shingles(t) if t.split() else set() for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if root[a] != root[b] and (10 * len(x & y) >= 8 * len(x | y)):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


@pytest.mark.parametrize(("rounds", "hot", "sample"), [(1, 2, 8000), (0, 8, 1)])
def test_kept_ids_against_brute_force(spark, monkeypatch, rounds, hot, sample):
    """Both directions: pairs around 0.8, chains of edits, short texts, a passage that many texts share."""
    rng = random.Random(23)
    rows, _ = planted(rng, 0, [(m * k, k) for m in (6, 7, 8, 9, 10, 12) for k in (1, 2, 4, 9, 25)])
    passage = [f"p{i}" for i in range(60)]
    for n in (3, 10, 30, 200, 260, 300):
        rows += [(1000 + 10 * n + i, " ".join(passage + [f"{rng.random()}" for _ in range(n)])) for i in range(8)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(40):
        rows.append((9000 + i, " ".join(chain)))
        chain[rng.randrange(120)] = f"{rng.random()}"
    rows += [(9500 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rng.shuffle(rows)
    docs, want = spark.createDataFrame(rows, DOCS).repartition(5), brute_kept(rows)
    monkeypatch.setattr(near, "PART_ROUNDS", rounds)
    monkeypatch.setattr(near, "HOT_COUNT", hot)
    monkeypatch.setattr(near, "SAMPLED", sample)
    assert {r.doc_id for r in near.without_near_copies(docs).collect()} == want


def test_rows_of_one_id_are_judged_each(spark):
    """An id on two texts: the copy goes, the lone text stays; two lone texts of one id both stay."""
    rng = random.Random(24)
    a, b, c, d = (" ".join(f"{rng.random()}" for _ in range(50)) for _ in range(4))
    rows = [(1, a), (5, a + " more"), (5, b), (6, c), (6, d), (6, d), (7, d)]
    kept = near.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(1, a), (5, b), (6, c), (6, d)])


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in near.without_near_copies(docs).collect()} == brute_kept([(r.doc_id, r.text or "") for r in docs.collect()])


def test_empty_odd_and_clashing_tables(no_docs, clashing_docs):
    assert near.without_near_copies(no_docs).count() == 0
    kept = near.without_near_copies(clashing_docs.selectExpr("*", "'boo' as _digest", "'boo' as salt", "'boo' as part", "'boo' as flags"))
    rows = kept.collect()
    assert kept.columns[-4:] == ["_digest", "salt", "part", "flags"] and all(r.salt == "boo" for r in rows)
    got = [r.doc_id for r in rows]
    assert got.count(None) == 2 and got.count(7) == 0 and got.count(6) == 1 and 8 not in got
    assert sum(i in got for i in (0, 1, 2)) == 1  # texts without a word are one group


def pair_of(rng, n, extra_a, extra_b):
    """Two sets that share n hashes."""
    h = np.unique(rng.integers(1, 2**63, n + extra_a + extra_b + 20).astype(np.uint64) * np.uint64(2))
    rng.shuffle(h)
    return np.sort(np.concatenate([h[:n], h[n : n + extra_a]])), np.sort(np.concatenate([h[:n], h[n + extra_a : n + extra_a + extra_b]]))


def test_every_pair_shares_a_key_and_enough_first_shingles():
    rng, full = np.random.default_rng(4), near.PLAIN | near.PROBE | near.OWN
    for n in [*range(4, 60), 80, 100, 127, 200, 333, 500, 1000, 4000]:
        most = n // 4  # n / (n + x) is 0.8 at x = n / 4
        for x in {0, most // 2, most}:
            for left in {0, x // 2, x}:
                a, b = pair_of(rng, n, left, x - left)
                if not x or len(a) < near.LEAST:
                    continue
                keys, of, flags = near.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
                one, two = (dict(zip(keys[of == i].tolist(), flags[of == i].tolist(), strict=True)) for i in (0, 1))
                assert any(one[k] | two[k] == full for k in one.keys() & two.keys()), (n, x, left)
                for common in (np.empty(0, np.uint64), np.sort(rng.choice(a, len(a) // 3, replace=False))):
                    (p, known), (q, known_q) = near.prefix(a, common), near.prefix(b, common)
                    met = len(np.intersect1d(p, q))
                    assert met + known >= near.shared_least(len(a)) and met + known_q >= near.shared_least(len(b))
                odd = [pa.array([near.sketch(s)]) for s in (a, b)]
                assert near.possible(np.array([len(a)]), np.array([len(b)]), *odd)[0]
                apart = np.bitwise_count((near.folded(near.sketch(a)) ^ near.folded(near.sketch(b))).view(np.uint64)).sum()
                assert apart <= x


def test_unlike_sets_rarely_share_a_key():
    rng = np.random.default_rng(5)
    sets = [pair_of(rng, 300, 0, 0)[0] for _ in range(200)]
    keys, of, flags = near.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    order = np.argsort(keys)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    counts = np.diff(np.append(starts, len(keys)))
    assert ((counts > 1) & (np.bitwise_or.reduceat(flags[order], starts) == (near.PLAIN | near.PROBE | near.OWN))).sum() < 5
    assert len(keys) < 2.6 * 300 * 200


@pytest.mark.parametrize("cut", [1, 2, 7, 5000])
def test_shared_keys_of_a_stream(cut):
    rng = random.Random(cut)
    rows = sorted((rng.randrange(150), rng.randrange(3)) for _ in range(400))
    want = sorted(n for _, g in itertools.groupby(rows, key=lambda r: r[0]) for g in [{n for _, n in g}] if len(g) > 1 for n in g)
    stream = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64())], ["key", "mark"]) for at in range(0, 400, cut) for some in [rows[at : at + cut]]]
    stream.insert(1, stream[0].slice(0, 0))
    assert sorted(n for b in near._in_other_runs(iter(stream)) for n in b.column("mark").to_pylist()) == want


@pytest.mark.parametrize("cut", [1, 3, 50, 5000])
def test_runs_of_a_stream(cut):
    rng, full = random.Random(cut), near.PLAIN | near.PROBE | near.OWN
    rows = sorted((rng.randrange(120), rng.choice([-1, -1, 0, 1]) if k % 3 == 0 else -1, k, 9, rng.choice([1, 2, 4, 7])) for k in range(500))
    groups = {k: list(g) for k, g in itertools.groupby(rows, key=lambda r: r[:2])}
    want = {(*r, g[0][2]) for g in groups.values() if g[0][1] >= 0 or len(g) > 1 and np.bitwise_or.reduce([r[4] for r in g]) == full for r in g}
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int8()]
    stream = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + cut]), types)], ["key", "salt", "node", "n", "flags"]) for at in range(0, 500, cut)]
    run = lambda most: [r for b in near._meeting(iter(stream), most) for r in zip(*(c.to_pylist() for c in b.columns))]
    got, some = run(10_000), run(2)
    assert len(got) == len(set(got)) and set(got) == want
    assert len(some) == len(set(some)) and want <= set(some) and all(r[5] == groups[r[:2]][0][2] for r in some)
