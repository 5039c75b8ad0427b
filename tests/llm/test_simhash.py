import itertools
import random

import numpy as np
import pytest
import xxhash

from kvspark.llm import simhash
from kvspark.llm.components import components


def brute_print(text, size=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, distance=3):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= distance:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in prints}


def collected(df):
    return [(r.doc_id, int.from_bytes(r.fp, "big"), r.component_id) for r in df.collect()]


def test_odd_texts_against_brute_force(odd_docs, odd_rows, clashing_docs):
    expected = {i: brute_print(t) for i, t in odd_rows if i is not None}
    comp = brute_components(expected)
    for docs in (odd_docs, clashing_docs):
        got = collected(simhash.near_duplicates(docs))
        assert len(got) == len(odd_rows)
        for i, fp, c in got:
            if i is not None:
                assert (fp, c) == (expected[i], comp[i])
        assert sorted(fp for i, fp, _ in got if i is None) == sorted(brute_print(t) for i, t in odd_rows if i is None)


def test_given_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    comp = brute_components(expected)
    assert sorted(collected(simhash.near_duplicates(docs))) == sorted((i, fp, comp[i]) for i, fp in expected.items())


@pytest.mark.parametrize(("block", "hot"), [(4096, 10**9), (5, 10**9), (4096, 2), (5, 2)])
def test_links_of_clouds(spark, monkeypatch, block, hot):
    """Dense clouds of fingerprints, with keys cut into sub-keys and blocks, or salted: the same components as all pairs give."""
    found_hot = simhash.hot_keys
    monkeypatch.setattr(simhash, "hot_keys", lambda rows: found_hot(rows, hot))
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 2**64 - 1}
    table = dict(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(i, f.to_bytes(8, "big")) for i, f in table.items()], "node long, fp binary").repartition(5)
    links = simhash.near_edges(nodes, simhash.Plan(block=block))
    found = {r.node: r.component for r in components(links).collect()}
    assert {i: found.get(i, i) for i in table} == brute_components(table)
    assert links.count() < 40 * 240  # forests, not all pairs


def test_signatures_meet_exactly_once():
    plan = simhash.Plan()
    assert plan.exact
    assert simhash.Plan(distance=4).exact is False


def test_majority_against_bit_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64) * 2 + 1
    bounds = np.array([0, 0, 1, 300, 301, 3000])
    got = simhash.majority(h, bounds, 3)
    for w in range(3):
        mixed = simhash._mixed(h, w)
        for d, (a, b) in enumerate(itertools.pairwise(bounds)):
            want = sum(1 << k for k in range(64) if 2 * int((mixed[a:b] >> np.uint64(k) & np.uint64(1)).sum()) > b - a)
            assert int(got[d, w]) == want


def test_components_of_paths_and_cycles(spark):
    rng = random.Random(9)
    path = list(range(60))
    edges = [*itertools.pairwise(path), (100, 101), (101, 102), (102, 100), (7, 7), (200, 300), (300, 200)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(path, 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("variants", [False, True])
@pytest.mark.parametrize("cut", [1, 3, 50, 5000])
def test_streamed_runs(variants, cut):
    """Keys that may hold a new link pass with all their rows, however the stream is cut and however long they are."""
    import pyarrow as pa

    rng = random.Random(cut)
    rows = sorted(((rng.randrange(120), -1, i, (not variants) or rng.random() < 0.5, rng.randrange(3)) for i in range(600)), key=lambda r: (r[0], not r[3]))
    groups = {k: list(g) for k, g in itertools.groupby(rows, key=lambda r: r[0])}
    three = lambda r: (r[0], r[2], r[3])
    wanted = {three(r) for g in groups.values() if len(g) > 1 and g[0][3] and len({r[4] for r in g}) > 1 and (not variants or not g[-1][3]) for r in g}
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("node", pa.int64()), ("plain", pa.bool_()), ("part", pa.int64())])
    stream = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + cut]), schema)], schema=schema) for i in range(0, len(rows), cut)]
    stream.insert(1, stream[0].slice(0, 0))

    def run(most):
        out = [r for b in simhash._meeting(iter(stream), 2, variants, most) for r in zip(*(b.column(c).to_pylist() for c in ("key", "node", "plain", "block")))]
        assert len({r[:2] for r in out}) == len(out)
        for _, g in itertools.groupby(out, key=lambda r: r[0]):
            assert [r[3] for r in g] == [i // 2 for i in range(len(list(groups[_])))]
        return {r[:3] for r in out}

    assert run(10_000) == wanted
    assert wanted <= run(2) <= {three(r) for r in rows}


def test_a_large_key_costs_its_rows(spark, monkeypatch):
    """20,000 unlike fingerprints of one segment: rows grow by a fixed factor, and all links are found."""
    rng, counted, real = np.random.default_rng(12), {}, simhash.stage
    high = np.unique(rng.integers(0, 2**32, 20_500, dtype=np.uint64))[:20_000]
    fp = (high << np.uint64(32)) | np.uint64(0x5A5A1234)
    nodes = spark.createDataFrame([(i, int(f).to_bytes(8, "big")) for i, f in enumerate(fp)], "node long, fp binary").repartition(4)

    def kept(df, name):
        out = real(df, name)
        counted[name] = max(counted.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "stage", kept)
    found = {r.node: r.component for r in components(simhash.near_edges(nodes, simhash.Plan())).collect()}
    assert counted["met"] <= 18 * len(fp) and counted["cut"] <= 20 * counted["met"]
    parent = np.arange(len(fp))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((int(parent[i]), int(parent[j])))
            if a != b:
                parent[parent == b] = a
    assert {i: found.get(i, i) for i in range(len(fp))} == dict(enumerate(parent.tolist()))
