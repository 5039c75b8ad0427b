import json
import random

import pytest
from pyspark.sql import functions as F

from kvspark.config import Config
from kvspark.errors import ConcurrentModification, CorruptedData, InvalidRunFormat, RecordTooLarge, WalCorruption
from kvspark.operators.compact import choose_tier, compact, compact_tier, vacuum
from kvspark.sources.store import KVTable, Memtable
from kvspark.schema import put_row, tombstone_row


def pairs(df):
    return {r.key: bytes(r.value) for r in df.collect()}


def test_reopen_replays_the_log(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    t.put("k1", b"v1")
    t.delete("gone")
    assert KVTable.open(spark, str(tmp_path)).get("k1") == b"v1"


def test_reads_survive_flush_and_reopen(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), Config(memtable_max_size=1024))
    for i in range(0, 50, 10):
        t.set_batch((f"k{j}", b"x" * 20) for j in range(i, i + 10))
    assert t.runs
    again = KVTable.open(spark, str(tmp_path))
    assert again.count() == 50 and again.get("k49") == b"x" * 20 and again.get("k50") is None


def test_tombstone_survives_reopen_and_runs(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    t.put("k", b"v")
    t.flush()
    t.delete("k")
    assert t.get("k") is None
    t.flush()
    again = KVTable.open(spark, str(tmp_path))
    assert again.get("k") is None and again.count() == 0 and again.scan().count() == 0
    again.put("k", b"back")
    assert again.get("k") == b"back"


def test_cut_log_is_refused(spark, tmp_path):
    KVTable.open(spark, str(tmp_path)).put("k", b"v")
    entry = next((tmp_path / "wal").glob("*.json"))
    entry.write_bytes(entry.read_bytes()[:-1])
    for crc in (tmp_path / "wal").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(WalCorruption):
        KVTable.open(spark, str(tmp_path))


def test_replay_after_a_crash_between_run_and_clean_up(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    t.put("k", b"old")
    saved = {p.name: p.read_bytes() for p in (tmp_path / "wal").iterdir()}
    t.flush()
    t.write(spark.createDataFrame([("k", b"new")], "key string, value binary"))
    for name, data in saved.items():
        (tmp_path / "wal" / name).write_bytes(data)
    assert KVTable.open(spark, str(tmp_path)).get("k") == b"new"


def test_lost_run_fails_unless_asked(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    for v in (b"1", b"2"):
        t.put("k", v)
        t.flush()
    t.files.delete(t.runs[1]["path"])
    with pytest.raises(CorruptedData):
        KVTable.open(spark, str(tmp_path))
    assert KVTable.open(spark, str(tmp_path), skip_corrupt=True).get("k") == b"1"


def test_bad_manifest_and_unknown_run(spark, tmp_path, table):
    (tmp_path / "b" / "manifest").mkdir(parents=True)
    (tmp_path / "b" / "manifest" / "000000000001.json").write_text("INVALID_MAGIC")
    with pytest.raises(CorruptedData):
        KVTable.open(spark, str(tmp_path / "b"))
    with pytest.raises(InvalidRunFormat):
        table.read_run(99)


def test_second_writer_is_refused(spark, tmp_path):
    a, b = KVTable.open(spark, str(tmp_path)), KVTable.open(spark, str(tmp_path))
    rows = spark.createDataFrame([("k", "v")], "key string, value string")
    a.write(rows)
    with pytest.raises(ConcurrentModification):
        b.write(rows)
    b.refresh()
    assert b.write(rows) is not None


def test_bulk_write_last_row_wins_and_batches_are_idempotent(spark, table):
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2")], "key string, value string").coalesce(1)
    assert table.write(rows, batch=("s", 0)) == 1 and table.write(rows, batch=("s", 0)) is None
    assert pairs(table.scan()) == {"a": b"2", "b": b"1"} and table.runs[0]["record_count"] == 2
    ordered = spark.createDataFrame([("a", "9", 5), ("a", "8", 4)], "key string, value string, n int")
    table.write(ordered, order=F.col("n"))
    assert table.get("a") == b"9"


def test_streams_leave_one_number_each_in_the_manifest(spark, table):
    rows = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    for i in range(3):
        table.write(rows(f"a{i}"), batch=("a", i))
    table.write(rows("b0"), batch=("b", 0))
    assert table.write(rows("late"), batch=("a", 1)) is None and table.state["batches"] == {"a": 2, "b": 0}
    again = KVTable.open(spark, table.files.root)
    assert again.write(rows("late"), batch=("a", 2)) is None and again.write(rows("new"), batch=("a", 3)) and again.get("k") == b"new"


@pytest.mark.parametrize("meanwhile", [KVTable.refresh, vacuum])
def test_buffered_writes_outlive_refresh_and_vacuum(spark, table, meanwhile):
    table.put("a", "1")
    meanwhile(table)
    table.put("b", "2")
    table.put("a", "3")
    assert pairs(table.scan()) == {"a": b"3", "b": b"2"} == pairs(KVTable.open(spark, table.files.root).scan())
    table.flush()
    meanwhile(table)
    table.put("a", "4")
    assert pairs(KVTable.open(spark, table.files.root).scan()) == {"a": b"4", "b": b"2"}


def test_refused_writer_leaves_the_winners_run_alone(spark, tmp_path):
    a, b = KVTable.open(spark, str(tmp_path)), KVTable.open(spark, str(tmp_path))
    a.write(spark.createDataFrame([("k", "winner")], "key string, value string"))
    with pytest.raises(ConcurrentModification):
        b.write(spark.createDataFrame([("k", "loser")], "key string, value string"))
    assert KVTable.open(spark, str(tmp_path)).get("k") == b"winner" and len(list((tmp_path / "runs").iterdir())) == 1


def test_put_if_is_a_swap_between_writers(spark, tmp_path):
    a, b = KVTable.open(spark, str(tmp_path)), KVTable.open(spark, str(tmp_path))
    a.put_if("k", "1", None)
    with pytest.raises(ConcurrentModification):
        b.put_if("k", "2", None)
    b.put_if("k", "2", b"1")
    a.refresh()
    assert a.get("k") == b"2"
    # the other writer publishes between the check and the write
    real = a._add_run
    a._add_run = lambda *args, **kw: (b.put_if("k", "3", b"2"), real(*args, **kw))[1]
    with pytest.raises(ConcurrentModification):
        a.put_if("k", "lost", b"2")
    assert KVTable.open(spark, str(tmp_path)).get("k") == b"3"


def test_flags_changed_by_two_processes_are_all_kept(spark, tmp_path):
    from kvspark.frontend.features import FeatureClient

    a, b = (FeatureClient(KVTable.open(spark, str(tmp_path)), ttl_s=60) for _ in range(2))
    a.set_flag("x", True)
    b.set_flag("y", True)
    a.set_flag("z", True)
    b.set_flag("x", False)
    doc = FeatureClient(KVTable.open(spark, str(tmp_path))).load()
    assert doc["version"] == 4 and {k: f["enabled"] for k, f in doc["flags"].items()} == {"x": False, "y": True, "z": True}


def test_bloom_filters_follow_rows_and_rate(spark, tmp_path):
    size = {}
    for n in (1000, 50_000):
        for rate in (0.5, 0.001):
            t = KVTable.open(spark, str(tmp_path / f"{n} {rate}"), Config(bloom_false_positive_rate=rate))
            t.write(spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("value")))
            size[n, rate] = t.runs[0]["bytes"]
    assert max(size[1000, 0.5], size[1000, 0.001]) < 30_000
    assert size[1000, 0.5] < size[1000, 0.001] and size[50_000, 0.5] < 0.9 * size[50_000, 0.001]


def test_pull_cursor(spark, table):
    table.write(spark.createDataFrame([(f"key_{i:03d}", str(i)) for i in (1, 10, 20, 30, 100)], "key string, value string"))
    table.delete("key_020")
    c = table.pull()
    assert c.row.key == "key_001" and c.advance().key == "key_010"
    assert c.seek("key_015").key == "key_020" and c.row.is_deleted and not c.advance().is_deleted  # the tombstone, then the value under it
    assert c.seek("key_000").key == "key_001"  # backwards too
    assert c.seek("key_100").key == "key_100" and c.advance() is None and not c.valid and c.advance() is None
    assert c.seek("key_999") is None
    assert list(table.records("key_010", "key_100")) == [("key_010", b"10"), ("key_030", b"30")]


def test_empty_writes(spark, table):
    assert table.flush() is None and table.set_batch([]) == 0
    assert table.write(spark.createDataFrame([], "key string, value string")) is None
    assert table.count() == 0 and table.scan().collect() == [] and table.get("k") is None


def test_batch_counts_include_repeats_and_absent_keys(table):
    assert table.set_batch([("a", "1"), ("a", "2"), ("", "x")]) == 3
    assert table.get("a") == b"2" and table.get("") == b"x"
    assert table.delete_batch(["a", "never", "never"]) == 3
    assert table.count() == 1


def test_buffer_over_runs_over_older_runs(spark, table):
    for v in ("one", "two"):
        table.write(spark.createDataFrame([("k", v), (f"only {v}", v)], "key string, value string"))
    table.put("k", "three")
    assert pairs(table.scan()) == {"k": b"three", "only one": b"one", "only two": b"two"}
    assert [bytes(r.value) for r in table.cursor("k").where("key = 'k'").collect()] == [b"three", b"two", b"one"]
    assert table.get_from_run(1, "k").first().seq < table.get_from_run(2, "k").first().seq


def test_large_values_and_limit(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), Config(max_record_bytes=9000))
    t.put("k", b"x" * 8000)
    t.flush()
    assert t.get("k") == b"x" * 8000
    with pytest.raises(RecordTooLarge):
        t.put("k", b"x" * 9000)


def test_run_pruning(spark, table):
    for letter in "abc":
        table.write(spark.createDataFrame([(f"{letter}{i}", letter) for i in range(3)], "key string, value string"))
    assert [r["min_key"] for r in table.pruned("b0", "b9")] == ["b0"]
    assert len(table.snapshot("b1", "b1").inputFiles()) >= 1 and all("run_id=2" in f for f in table.snapshot("b1", "b1").inputFiles())
    assert [r.key for r in table.search_prefix("c").collect()] == ["c0", "c1", "c2"]
    assert [r.key for r in table.range_scan("a2", "b1").collect()] == ["a2", "b0"]
    assert table.seek("b9").first().key == "c0" and [r.key for r in table.page_after("a1", 2).collect()] == ["a2", "b0"]


def test_no_false_negative_membership(spark, table):
    keys = [f"existing_key_{i:04d}" for i in range(500)]
    table.write(spark.createDataFrame([(k, "v") for k in keys], "key string, value string"))
    probes = spark.createDataFrame([(k,) for k in keys + [f"nonexistent_{i}" for i in range(1000, 1500)]], "key string")
    assert table.multi_get(probes).where("found").count() == 500


@pytest.mark.parametrize("seed", [1, 2])
def test_model(spark, tmp_path, seed):
    """Random puts, deletes, flushes, compactions and reopenings against a dict."""
    rng, model = random.Random(seed), {}
    t = KVTable.open(spark, str(tmp_path))
    for step in range(18):
        act = rng.random()
        if act < 0.5:
            batch = [(f"k{rng.randrange(12)}", f"{step}.{i}") for i in range(rng.randrange(1, 6))]
            t.set_batch(batch)
            model |= dict(batch)
        elif act < 0.7:
            dead = [f"k{rng.randrange(14)}" for _ in range(3)]
            t.delete_batch(dead)
            for k in dead:
                model.pop(k, None)
        elif act < 0.85:
            t.flush()
        elif act < 0.93:
            compact(t)
        else:
            t = KVTable.open(spark, str(tmp_path))
        if step % 6 == 5:
            assert pairs(t.scan()) == {k: v.encode() for k, v in model.items()}
    assert pairs(t.scan()) == {k: v.encode() for k, v in model.items()}
    k = rng.choice([*model, "k0"])
    assert t.get(k) == (model[k].encode() if k in model else None)


def test_compaction_keeps_snapshot_and_tombstones_while_older_runs_remain(spark, table):
    table.write(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, value string"))
    table.delete("a")
    table.flush()
    table.put("c", "3")
    table.flush()
    before = pairs(table.scan())
    ids = [r["run_id"] for r in table.runs]
    compact(table, ids[1:])
    assert pairs(table.scan()) == before and table.cursor().where("is_deleted").count() == 1
    compact(table)
    assert pairs(table.scan()) == before == {"b": b"1", "c": b"3"} and table.cursor().where("is_deleted").count() == 0
    assert len(table.runs) == 1 and vacuum(table) >= 2
    assert pairs(KVTable.open(spark, table.files.root).scan()) == before
    with pytest.raises(ValueError):
        table.put("d", "4"), table.flush(), table.put("e", "5"), table.flush(), compact(table, [table.runs[0]["run_id"], table.runs[2]["run_id"]])


def test_compacting_everything_away(spark, table):
    table.put("a", "1")
    table.flush()
    table.delete("a")
    assert compact(table) is None and table.runs == [] and table.count() == 0


def test_tiers(spark, table):
    sizes = lambda *b: [{"run_id": i, "bytes": x} for i, x in enumerate(b)]
    assert [r["run_id"] for r in choose_tier(sizes(1000, 10, 12, 11, 15, 900))] == [1, 2, 3, 4]
    assert choose_tier(sizes(10, 100, 1000)) == []
    for i in range(4):
        table.put(f"k{i}", "v")
        table.flush()
    assert compact_tier(table) is not None and len(table.runs) == 1 and table.count() == 4


def test_statistics(spark, table):
    table.set_batch([("a", "1"), ("b", "2")])
    table.flush()
    table.put("a", "3")
    row = table.stats_all().first().asDict()
    assert row["sst_files"] == 1 and row["sst_records"] == 2 and row["mem_records"] == 1 and row["total_records"] == 3 and row["memtable_max_size"] == 4096
    assert "MemTable: 1 records" in table.stats()
    table.verify()
    json.dumps(row)


def test_verify_finds_changed_runs(spark, table):
    table.put("a", "1")
    table.flush()
    table.state["runs"][0]["record_count"] = 5
    with pytest.raises(CorruptedData):
        table.verify()


def test_memtable():
    m = Memtable(100)
    m.insert(put_row("b", b"12345", 1, ts_ns=9))
    assert m.size_bytes == 1 + 5 + 32 and not m.should_flush()
    m.insert(put_row("b", b"1", 2, ts_ns=1))
    m.insert(tombstone_row("a", 3))
    assert m.size_bytes == 34 + 33 and [r[0] for r in m.ordered()] == ["a", "b"] and [r[0] for r in m.ordered("b")] == ["b"]
    assert m.get("a")[3] and m.get("zz") is None
    m.insert(put_row("c", b"x" * 10, 4))
    assert m.should_flush() and m.clear() == 3 and m.size_bytes == 0


def test_persisted_snapshot(spark, table):
    table.put("a", "1")
    table.flush()
    kept = table.persist()
    table.put("a", "2")
    kept.count()
    assert "Cache: 0/" in KVTable.open(spark, table.files.root).stats() and 0 < table.cached_bytes() < 100_000 and "Cache: 0/" not in table.stats()
    assert table.cached().useMemory and [bytes(r.value) for r in kept.collect()] == [b"1"] and table.get("a") == b"2"
    table.unpersist()
    assert table.cached() is None


def test_command_line_entry(spark, tmp_path, monkeypatch, capsys):
    import io
    import sys

    from kvspark.__main__ import main

    monkeypatch.setattr(sys, "stdin", io.StringIO("SET a 1\nGET a\nQUIT\n"))
    main(["repl", str(tmp_path / "cli")])
    assert "'a' = '1'" in capsys.readouterr().out
