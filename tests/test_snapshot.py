import random

import pytest
from pyspark.sql import functions as F

from kvspark.operators import query
from kvspark.operators.snapshot import live, live_keys, merge_runs, newest_wins, newest_wins_by_aggregate
from kvspark.schema import RECORD_SCHEMA, put_row, tombstone_row


def log(spark, rows):
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def pairs(df):
    return [(r.key, bytes(r.value)) for r in df.orderBy("key").collect()]


LADDER = ["key_001", "key_010", "key_020", "key_030", "key_100"]


@pytest.fixture(scope="module")
def edge(spark):
    """Delete then re-put, delete of the unwritten, empty value, three versions, odd keys, invalid bytes."""
    return log(spark, [
        put_row("a", b"1", 1), tombstone_row("a", 2), put_row("a", b"3", 3), tombstone_row("never", 4), put_row("empty", b"", 5), put_row("x", b"old", 6), put_row("x", b"mid", 7),
        tombstone_row("x", 8), put_row("100%_=k", b"a=b", 9), put_row("bad", b"\xff\xfeok", 10), put_row("", b"nokey", 11), put_row("feature:f", b"{}", 12), put_row("clave muy larga con eñes", b"v", 13),
    ])


def test_edge_rows(edge):
    assert dict(pairs(live(edge))) == {"a": b"3", "empty": b"", "100%_=k": b"a=b", "bad": b"\xff\xfeok", "": b"nokey", "feature:f": b"{}", "clave muy larga con eñes": b"v"}


def test_keys_and_count_agree_with_scan(edge):
    assert [r.key for r in query.keys(live(edge)).collect()] == [r.key for r in live_keys(edge).orderBy("key").collect()]
    assert query.count(live(edge)).first().n == 7


def test_timestamp_never_decides(spark):
    rows = log(spark, [put_row("k", b"first", 1, ts_ns=10**18), put_row("k", b"second", 2, ts_ns=5)])
    assert pairs(live(rows)) == [("k", b"second")]


def test_tombstones_are_filtered_after_the_merge(spark):
    rows = log(spark, [put_row("k", b"v", 1), tombstone_row("k", 2)])
    assert pairs(live(rows)) == [] and newest_wins(rows).count() == 1


def test_both_merges_agree_on_random_logs(spark):
    rng = random.Random(4)
    rows = [put_row(f"k{rng.randrange(40)}", bytes([rng.randrange(256)]), i) if rng.random() < 0.7 else tombstone_row(f"k{rng.randrange(40)}", i) for i in range(500)]
    expected = {}
    for key, value, _, dead, _ in rows:
        expected[key] = None if dead else value
    expected = sorted((k, v) for k, v in expected.items() if v is not None)
    assert pairs(live(log(spark, rows))) == expected
    assert pairs(newest_wins_by_aggregate(log(spark, rows)).where("not is_deleted")) == expected
    for cut in (0, 100, 499):  # any split into runs gives the same snapshot
        assert pairs(merge_runs(log(spark, rows).withColumn("run_id", (F.col("seq") >= cut).cast("long")))) == expected


def test_bytewise_order(spark):
    names = ["hello", "こんにちは", "你好", "مرحبا", "привет", "🙂", "z"]
    rows = log(spark, [put_row(k, f"{k}_value".encode(), i) for i, k in enumerate(names)])
    assert [r.key for r in query.scan(live(rows)).collect()] == sorted(names, key=str.encode)


def test_search_is_literal(edge):
    snapshot = live(edge)
    assert [r.key for r in query.search(snapshot, "%_").collect()] == ["100%_=k"]
    assert [r.key for r in query.search(snapshot, "A").collect()] == []
    assert query.search(snapshot, "").count() == 7
    assert [r.key for r in query.search_prefix(snapshot, "fe").collect()] == ["feature:f"]


@pytest.mark.parametrize(("wanted", "lands"), [("key_010", "key_010"), ("key_015", "key_020"), ("key_000", "key_001"), ("key_999", None)])
def test_seek(spark, wanted, lands):
    rows = live(log(spark, [put_row(k, b"v", i) for i, k in enumerate(LADDER)]))
    found = query.seek(rows, wanted).first()
    assert (found and found.key) == lands


def test_range_and_pages(spark):
    rows = live(log(spark, [put_row(k, b"v", i) for i, k in enumerate(LADDER)]))
    assert [r.key for r in query.range_scan(rows, "key_010", "key_030").collect()] == ["key_010", "key_020"]
    seen, last = [], None
    while page := [r.key for r in query.page_after(rows, last, 2).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == LADDER


def test_cursor_shows_tombstones(spark):
    rows = log(spark, [put_row("k1", b"v", 1), tombstone_row("k2", 2), put_row("k3", b"v", 3)])
    assert [(r.key, r.is_deleted) for r in query.cursor(rows).collect()] == [("k1", False), ("k2", True), ("k3", False)]
    assert query.cursor_seek(rows, "k2").first().is_deleted
    assert live(rows).count() == 2


def test_multi_get_and_membership(spark, edge):
    wanted = spark.createDataFrame([("a",), ("x",), ("nope",), ("a",)], "key string")
    got = {r.key: (r.found, r.value and bytes(r.value)) for r in query.multi_get(live(edge), wanted).collect()}
    assert got == {"a": (True, b"3"), "x": (False, None), "nope": (False, None)}
    assert sorted(r.key for r in query.membership(edge, wanted).collect()) == ["a", "x"]


def test_display(edge):
    got = {r.key: r.value for r in query.table_view(live(edge)).collect()}
    assert "clave muy larga c..." in got and got["bad"] == "��ok"
    assert [(r.n, r.key) for r in query.numbered_keys(live(edge)).orderBy("n").collect()] == list(enumerate(sorted(["a", "empty", "100%_=k", "bad", "", "feature:f", "clave muy larga con eñes"], key=str.encode), 1))
    assert "feature:f" not in [r.key for r in query.without_system(live(edge)).collect()]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_key_predicates_reach_the_scan(spark, tmp_path):
    log(spark, [put_row(f"k{i}", b"v", i) for i in range(100)]).write.parquet(str(tmp_path / "log"))
    rows = spark.read.schema(RECORD_SCHEMA).parquet(str(tmp_path / "log"))
    plan = _plan(query.search_prefix(live(rows), "k1"))
    assert "StringStartsWith(key,k1)" in plan and "WindowGroupLimit" in plan
    keys = _plan(live_keys(rows))
    assert "value" not in keys.split("ReadSchema: ")[-1] and "HashAggregate" in keys and "SortAggregate" not in keys


def test_one_layer_is_read_without_a_shuffle(spark, tmp_path):
    log(spark, [put_row(f"k{i}", b"v", i) for i in range(10)]).write.parquet(str(tmp_path / "run"))
    assert "Exchange" not in _plan(live(spark.read.schema(RECORD_SCHEMA).parquet(str(tmp_path / "run")), merged=True))
