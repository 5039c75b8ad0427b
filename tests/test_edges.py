import io
import json
import threading
import time
import urllib.error
import urllib.request
import warnings

import pytest
from pyspark.sql import functions as F

from kvspark import functions as fn
from kvspark.config import Config, ServerConfig
from kvspark.errors import InvalidBlockSize, InvalidBloomRate, InvalidCacheSize, InvalidIndexInterval, InvalidMemtableSize
from kvspark.frontend import auth, features
from kvspark.frontend.http import Api, serve
from kvspark.frontend.repl import Repl
from kvspark.operators import stats
from kvspark.sources.ingest import import_text, json_deletes, json_puts, synthetic
from kvspark.sources.sinks import export_text, json_envelope
from kvspark.streaming import into_table, live_view, sliding_rate

SAMPLE = """# comment
user:1=Ann

  user:2 =  Bo = b
  # indented comment
=nokey
no separator
user:1=Ann again
"""


def test_text_import(spark, tmp_path, table):
    (tmp_path / "in.txt").write_text(SAMPLE)
    records, errors = import_text(spark, str(tmp_path / "in.txt"))
    assert [(r.key, r.value) for r in records.orderBy("seq").collect()] == [("user:1", "Ann"), ("user:2", "Bo = b"), ("", "nokey"), ("user:1", "Ann again")]
    assert [(r.seq, r.line) for r in errors.collect()] == [(7, "no separator")]
    table.write(records, order=F.col("seq"))
    assert table.get("user:1") == b"Ann again" and table.count() == 3
    export_text(table.snapshot().where("key != ''"), str(tmp_path / "out"))
    back, wrong = import_text(spark, str(tmp_path / "out") + "/part-*")
    assert {(r.key, r.value) for r in back.collect()} == {("user:1", "Ann again"), ("user:2", "Bo = b")} and wrong.count() == 0


def test_synthetic_and_json(spark, table):
    assert [(r.key, r.value) for r in synthetic(spark, 2).collect()] == [("batch:0", "value_0"), ("batch:1", "value_1")]
    assert synthetic(spark, 3, 6).orderBy("seq").collect()[2].key == "batch:000002"
    body = spark.createDataFrame([('{"records": [{"key": "a", "value": "1"}, {"key": "a", "value": "2"}]}',)], "body string")
    assert [(r.key, r.value, r.at) for r in json_puts(body).collect()] == [("a", "1", 0), ("a", "2", 1)]
    gone = spark.createDataFrame([('{"keys": ["a", "b"]}',)], "body string")
    assert [(r.key, r.is_deleted) for r in json_deletes(gone).collect()] == [("a", True), ("b", True)]
    two = spark.createDataFrame([(i, json.dumps({"records": [{"key": "a", "value": f"{i}{c}"} for c in "xy"]})) for i in (9, 3)], "n long, body string").repartition(2)
    table.write(json_puts(two, order="n"), order=F.struct("arrived", "at"))
    assert table.get("a") == b"9y"  # the last record of the body that came last
    table.write(json_deletes(two.select("n", F.lit('{"keys": ["a", "zz"]}').alias("body")), order="n"), order=F.struct("arrived", "at"))
    assert table.get("a") is None and table.count() == 0
    with pytest.raises(Exception, match="MALFORMED|parse"):
        json_puts(spark.createDataFrame([("{",)], "body string")).collect()
    shown = spark.range(1).select(json_envelope(F.lit(True), F.lit("m"), F.lit(None).cast("string")).alias("j")).first().j
    assert json.loads(shown) == {"success": True, "message": "m"}


def test_functions(spark):
    row = spark.range(1).select(
        fn.lossy_text(F.lit(bytearray(b"a\xff"))).alias("lossy"), fn.display(F.lit("ñ" * 30)).alias("cut"), fn.zero_padded(F.lit(1234567)).alias("long"), fn.token_hash(F.lit("abc")).alias("hash"),
        fn.older_than(F.lit(5), 86_400 * 10**9 * 3, 2).alias("old"),
    ).first()
    assert row.lossy == "a�" and row.cut == "ñ" * 17 + "..." and row.long == "1234567" and row.hash == auth.hash_token("abc") and row.old
    with pytest.raises(Exception, match="INVALID_UTF8|UTF-8|UTF8"):
        spark.range(1).select(fn.strict_text(F.lit(bytearray(b"\xff"))).alias("x")).collect()


@pytest.mark.parametrize(("change", "error"), [
    ({"memtable_max_size": 0}, InvalidMemtableSize), ({"memtable_max_size": 1023}, InvalidMemtableSize), ({"memtable_max_size": (1 << 30) + 1}, InvalidMemtableSize),
    ({"block_size": 0}, InvalidBlockSize), ({"block_size": 255}, InvalidBlockSize), ({"block_size": (1 << 20) + 1}, InvalidBlockSize), ({"block_cache_size_mb": 0}, InvalidCacheSize),
    ({"sparse_index_interval": 0}, InvalidIndexInterval), ({"bloom_false_positive_rate": 0.0}, InvalidBloomRate), ({"bloom_false_positive_rate": 1.0}, InvalidBloomRate), ({"bloom_false_positive_rate": -0.5}, InvalidBloomRate),
])
def test_config_bounds(change, error):
    with pytest.raises(error):
        Config(**change)


def test_config_defaults_and_warnings():
    assert Config().with_(block_size=8192).block_size == 8192
    for change in ({"block_cache_size_mb": 20000}, {"sparse_index_interval": 2000}, {"bloom_false_positive_rate": 0.2}):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            Config(**change)
        assert seen
    env = ServerConfig.from_env({"PORT": "9", "API_AUTH_ENABLED": "true", "FEATURE_CACHE_TTL": "x"})
    assert env.port == 9 and env.auth_enabled and env.feature_cache_ttl_secs == 10 and env.token_expiry_days is None


def test_tokens():
    m = auth.TokenManager()
    raw, token = m.create("t", [auth.WRITE], 1)
    assert raw != token.token_hash and m.validate(raw) is token and token.has_permission(auth.WRITE) and not token.has_permission(auth.READ)
    _, admin = m.create("root", [auth.ADMIN])
    assert all(admin.has_permission(p) for p in auth.PERMISSIONS) and not admin.is_expired() and m.count() == 2
    old, _ = m.create("old", [auth.READ], -1)
    with pytest.raises(auth.TokenExpired):
        m.validate(old)
    with pytest.raises(auth.InvalidToken):
        m.validate("nope")
    with pytest.raises(auth.MissingToken):
        m.authorize(None, auth.READ)
    with pytest.raises(auth.InsufficientPermissions):
        m.authorize(f"Bearer {raw}", auth.READ)
    assert m.get(token.id) is token and [t.name for t in m.list()] == ["t", "root", "old"]
    m.delete(token.id)
    with pytest.raises(auth.TokenNotFound):
        m.delete(token.id)
    with pytest.raises(ValueError):
        m.create("x", ["Everything"])


def test_feature_flags(spark, table):
    client = features.FeatureClient(table, ttl_s=60)
    assert client.list_all() == {} and not client.is_enabled("a")
    client.set_flag("a", True, "about a")
    client.set_flag("a", False)
    assert client.list_all() == {"a": {"enabled": False, "description": "about a"}}
    client.set_flag("b", True)
    stored = table.snapshot(features.KEY, features.KEY)
    assert {(r.version, r.name, r.enabled, r.description) for r in features.parse(stored).collect()} == {(3, "a", False, "about a"), (3, "b", True, "")}
    assert features.enabled(stored, "b").first().enabled and not features.enabled(stored, "zz").first().enabled
    assert client.remove_flag("b") and not client.remove_flag("b")
    table.put(features.KEY, "{broken")
    client._cached = None
    with pytest.raises(features.DeserializationFailed):
        client.load()


def test_repl(spark, table, tmp_path):
    (tmp_path / "in.txt").write_text(SAMPLE)
    out = io.StringIO()
    lines = ["", "set a hello big world", "GET a", "get nothing", "SET a", "DEL a", "GET a", f"BATCH SET {tmp_path / 'in.txt'}", "BATCH 3", "BATCH x", "BATCH", "SEARCH user:", "SEARCH batch --prefix", "SCAN zzz", "SCAN user:1", "ALL", "KEYS", "COUNT", "STATS", "stats all", "HELP", "?", "CLEAR", "WHAT", "q", "SET never reached"]
    Repl(table, out).run(iter(lines))
    said = out.getvalue()
    for part in ("'a' = 'hello big world'", "'nothing' not found", "Usage: SET", "'a' not found", "Line 7 is not key=value", "4 records imported, 1 errors", "3 records written", "The count must be", "2 records found", "3 records found", "No records with prefix 'zzz'", "1 records with prefix", "6 live records", "1. ", "sst_files", "Unknown command 'WHAT'", "Bye"):
        assert part in said, part
    assert table.get("never") is None
    small = io.StringIO()
    Repl(table, small, limit=2).execute("SEARCH batch")
    assert "3 records found" in small.getvalue() and "... and 1 more" in small.getvalue()


def test_dashboard(spark, table):
    from kvspark.frontend.dashboard import Dashboard, Gauge

    out = io.StringIO()
    Dashboard(table, out).run(iter(["DEMO", "KEYS", "ALL", "SEARCH demo:001", "FILL", "GET demo:0000", "GET demo:0099", "COUNT", "", "Q"]))
    said = out.getvalue()
    for part in ("100 SET done", "10 GET done", "10 DEL done", "90 live keys", "90 keys", "30. demo:0039", "... and 60 more", "90 records:", "... and 70 more", "10 records found", "Buffer ", "'demo:0000' not found", "'demo-value-99'", " ms, ", "Bye"):
        assert part in said, part
    now = [0.0]
    gauge = Gauge(lambda: now[0])
    for _ in range(100):
        now[0] += 0.125
        gauge.add(2)
    assert gauge.rate == 16.0 and len(gauge.history) == 24 and gauge.total == 200


def test_lines_are_numbered_through_files(spark, tmp_path, table):
    (tmp_path / "in").mkdir()
    for name, lines in (("a", [f"k{i}=a{i}" for i in range(3000)]), ("b", []), ("c", ["k7=c7", "bad", "k7=c8"])):
        (tmp_path / "in" / name).write_text("".join(f"{x}\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records, errors = import_text(spark, str(tmp_path / "in"))
        assert [r.seq for r in records.orderBy("seq").collect()] == [*range(1, 3002), 3003] and errors.first().seq == 3002
        assert all(r.key == f"k{r.seq - 1}" for r in records.where("seq <= 3000").collect()) and records.rdd.getNumPartitions() >= 2
        table.write(records, order=F.col("seq"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert table.get("k7") == b"c8" and table.count() == 3000


def test_repl_demo(spark, table):
    out = io.StringIO()
    Repl(table, out).execute("DEMO")
    assert "'user:alice' = 'Alice B.'" in out.getvalue() and "'user:bob' not found" in out.getvalue() and "Error" not in out.getvalue()


def test_http(spark, table):
    api = Api(table)
    put = lambda path, body: api.handle("POST", path, json.dumps(body).encode())
    assert api.handle("GET", "/health")[0] == 200
    assert put("/keys", {"key": "a b/c", "value": "1"})[1]["data"] == {"key": "a b/c"}
    assert put("/keys/batch", {"records": [{"key": "user:1", "value": "x"}, {"key": "search", "value": "y"}]})[1]["data"] == {"count": 2}
    assert api.handle("GET", "/keys/a%20b%2Fc")[1]["data"] == {"key": "a b/c", "value": "1"}
    assert api.handle("GET", "/keys/none")[0] == 404
    assert put("/features/f", {"enabled": True, "description": "d"})[0] == 200 and put("/features/f", {"enabled": False})[0] == 200
    assert api.handle("GET", "/features")[1]["data"] == {"version": 2, "features": [{"name": "f", "enabled": False, "description": "d"}]}
    assert api.handle("GET", "/keys")[1]["data"]["keys"] == ["a b/c", "search", "user:1"]
    assert [r["key"] for r in api.handle("GET", "/scan")[1]["data"]["records"]] == ["a b/c", "search", "user:1"]
    assert api.handle("GET", "/keys?limit=2")[1]["data"] == {"keys": ["a b/c", "search"], "next": "search"}
    assert api.handle("GET", "/keys?limit=2&after=search")[1]["data"] == {"keys": ["user:1"]}
    assert api.handle("GET", "/scan?limit=1&after=a%20b%2Fc")[1]["data"] == {"records": [{"key": "search", "value": "y"}], "next": "search"}
    assert api.handle("GET", "/keys?limit=0")[0] == 400 and api.handle("GET", "/keys?limit=x")[0] == 400
    assert [r["key"] for r in api.handle("GET", "/scan?prefix=user")[1]["data"]["records"]] == ["user:1"]
    assert [r["key"] for r in api.handle("GET", "/keys/search?q=er")[1]["data"]["records"]] == ["user:1"]
    assert api.handle("GET", "/keys/search?q=feature&prefix=true")[1]["data"]["records"][0]["key"] == "feature:all"
    assert api.handle("DELETE", "/keys/never")[0] == 200 and api.handle("DELETE", "/keys/user%3A1")[0] == 200
    assert api.handle("DELETE", "/keys/batch", b'{"keys": ["search"]}')[1]["data"] == {"count": 1}
    assert api.handle("GET", "/stats")[0] == 200 and "total_records" in api.handle("GET", "/stats/all")[1]["data"]
    assert put("/keys", {"key": 1})[0] == 400 and api.handle("POST", "/keys", b"{")[0] == 400 and api.handle("GET", "/nowhere")[0] == 404 and api.handle("GET", "/keys/search")[0] == 400


def test_http_permissions_and_socket(spark, table):
    api = Api(table, ServerConfig(auth_enabled=True))
    root, _ = api.tokens.create("root", [auth.ADMIN])
    bearer = lambda raw: f"Bearer {raw}"
    assert api.handle("GET", "/health")[0] == 200 and api.handle("GET", "/keys")[0] == 401
    made = api.handle("POST", "/admin/tokens", b'{"name": "w", "permissions": ["Write"]}', bearer(root))[1]["data"]
    assert api.handle("POST", "/keys", b'{"key": "k", "value": "v"}', bearer(made["token"]))[0] == 200
    assert api.handle("GET", "/keys/k", b"", bearer(made["token"]))[0] == 403
    assert len(api.handle("GET", "/admin/tokens", b"", bearer(root))[1]["data"]["tokens"]) == 2
    assert api.handle("DELETE", f"/admin/tokens/{made['id']}", b"", bearer(root))[0] == 200
    assert api.handle("DELETE", f"/admin/tokens/{made['id']}", b"", bearer(root))[0] == 404
    server = serve(api, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        with urllib.request.urlopen(urllib.request.Request(f"{base}/keys/k", headers={"Authorization": bearer(root)})) as r:
            assert json.load(r)["data"]["value"] == "v"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{base}/keys/k")
        assert e.value.code == 401
    finally:
        server.shutdown()


def test_stream_into_table_is_idempotent(spark, table, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"k{j}", f"{i}", i) for j in range(i + 1)], "key string, value string, n int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("key string, value string, n int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = into_table(source, table, "s", str(tmp_path / "cp"), order=F.col("n")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and len(table.runs) == 3 and table.count() == 3
    from kvspark.streaming.stream import batch_writer

    batch_writer(table, "s")(spark.createDataFrame([("k0", "replayed")], "key string, value string"), 0)
    assert len(table.runs) == 3 and table.get("k0") != b"replayed"


def test_stream_rates_and_view(spark, tmp_path):
    base = 1_700_000_000
    rows = spark.createDataFrame([(base + i // 4, f"k{i % 2}", i) for i in range(40)], "s long, key string, seq long").select(F.timestamp_seconds("s").alias("ts"), "key", "seq", F.lit("v").alias("value"), F.lit(False).alias("is_deleted"))
    rows.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    q = sliding_rate(stream, "ts", "2 seconds", "1 second").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable(), q.stop()
    got = spark.table("rates")
    assert got.agg(F.sum("ops")).first()[0] == 80 and got.agg(F.max("ops_per_second")).first()[0] == 4.0
    q = live_view(stream).writeStream.outputMode("complete").format("memory").queryName("view").start()
    q.processAllAvailable(), q.stop()
    assert spark.table("view").count() == 2
    assert stats.ops_rate(rows, "ts", "2 seconds", "1 second").agg(F.sum("ops")).first()[0] == 80


def test_fill_ratios(spark):
    row = spark.createDataFrame([(8192, 4096, 5)], "mem_kb long, memtable_max_size long, sst_files long")
    assert tuple(stats.fill_ratios(row).first()) == (1.0, 0.25)
    assert time.time_ns() > 0
