"""One registered query per operator, over logs made of whole driver tables, and DuckDB SQL for each.

Values are given as text, so that both sides compare strings.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display, kilobytes, lossy_text, split_command, token_hash, uptime, zero_padded
from ..frontend import features
from ..operators import query, stats
from ..operators.compact import compact
from ..operators.snapshot import live, live_keys, merge_runs, newest_wins, newest_wins_by_aggregate
from ..sources.ingest import import_text, json_deletes, json_puts, parse_lines, synthetic
from ..sources.sinks import json_rows
from ..sources.store import KVTable
from ..schema import record_size as size_of
from ..streaming import into_table
from .logs import customer_log, document_log, page_log, turn_log, user_cut, user_log, user_runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOG = """WITH log AS (SELECT 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, event_id AS seq,
  event_type = 'error' AS is_deleted, (event_id >= (SELECT (max(event_id) + 1) // 2 FROM events))::BIGINT AS run_id FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log),
live AS (SELECT key, value FROM ranked WHERE r = 1 AND NOT is_deleted) """
DOC_LOG = "WITH live AS (SELECT 'doc:' || lang || ':' || source || ':' || doc_id AS key, coalesce(text, '') AS value FROM documents) "
CUST_LOG = LOG.replace("'user:' || user_id", "'cust:' || o_custkey").replace("event_type = 'error'", "o_orderstatus = 'F'").replace("props", "o_orderpriority").replace("event_id", "o_orderkey").replace("events", "orders")
PAGE_LOG = "WITH live AS (SELECT url AS key, html AS value FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS r FROM pages) WHERE r = 1) "
TURN_LOG = """WITH live AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM
  (SELECT 'conv:' || conv_id || ':' || CASE WHEN turn > 9999 THEN turn::VARCHAR ELSE lpad(turn::VARCHAR, 4, '0') END AS key, coalesce(text, '') AS value, conv_id * 10000 + turn AS seq FROM conversations)) WHERE r = 1) """


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _text(rows: DataFrame) -> DataFrame:
    return query.as_text(rows)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(user_log(spark, sf_dir))


@_query(LOG + "SELECT key, value FROM live")
def scan_live(spark, sf_dir):
    return _text(query.scan(_users(spark, sf_dir)))


@_query(LOG + "SELECT key, value FROM live")
def scan_live_by_aggregate(spark, sf_dir):
    return _text(newest_wins_by_aggregate(user_log(spark, sf_dir)).where(~F.col("is_deleted")))


@_query(LOG + "SELECT key, value FROM live")
def layered_merge(spark, sf_dir):
    return _text(merge_runs(user_runs(spark, sf_dir)))


@_query(LOG + "SELECT key, value FROM live WHERE starts_with(key, 'user:1')")
def prefix_scan(spark, sf_dir):
    return _text(query.search_prefix(_users(spark, sf_dir), "user:1"))


@_query(LOG + "SELECT key, value FROM live WHERE contains(key, 'r:2')")
def contains_scan(spark, sf_dir):
    return _text(query.search(_users(spark, sf_dir), "r:2"))


@_query(LOG + "SELECT key, value FROM live WHERE contains(key, '%') OR contains(key, '_')")
def contains_literal(spark, sf_dir):
    found = _users(spark, sf_dir)
    return _text(query.search(found, "%").unionByName(query.search(found, "_")).distinct())


@_query(LOG + "SELECT key, value FROM live WHERE key >= 'user:3'")
def range_scan(spark, sf_dir):
    return _text(query.range_scan(_users(spark, sf_dir), "user:3"))


@_query(LOG + "SELECT key, value FROM live WHERE key >= 'user:2' AND key < 'user:4'")
def range_between(spark, sf_dir):
    return _text(query.range_scan(_users(spark, sf_dir), "user:2", "user:4"))


@_query(LOG + "SELECT count(*) AS n FROM live")
def live_count(spark, sf_dir):
    return query.count(live_keys(user_log(spark, sf_dir)))


@_query(LOG + "SELECT key, value FROM live WHERE key >= 'user:25' ORDER BY key LIMIT 1")
def seek_ge(spark, sf_dir):
    return _text(query.seek(_users(spark, sf_dir), "user:25"))


@_query(LOG + "SELECT key, value FROM live WHERE key >= 'zzz' ORDER BY key LIMIT 1")
def seek_past_end(spark, sf_dir):
    return _text(query.seek(_users(spark, sf_dir), "zzz"))


@_query(LOG + "SELECT w.key, l.key IS NOT NULL AS found, l.value FROM (SELECT DISTINCT 'user:' || c_custkey AS key FROM customer) w LEFT JOIN live l ON w.key = l.key")
def multi_get(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return query.multi_get(_users(spark, sf_dir), wanted).withColumn("value", lossy_text("value"))


@_query(LOG + "SELECT key, value FROM live WHERE key = 'user:7'")
def point_get(spark, sf_dir):
    return _text(query.get(_users(spark, sf_dir), "user:7"))


@_query(LOG + "SELECT key, value FROM live WHERE key = 'user:none'")
def point_get_missing(spark, sf_dir):
    return _text(query.get(_users(spark, sf_dir), "user:none"))


@_query(LOG + "SELECT key FROM live")
def keys_live(spark, sf_dir):
    return live_keys(user_log(spark, sf_dir)).orderBy("key")


@_query(LOG + "SELECT key, value FROM live WHERE key > 'user:120' ORDER BY key LIMIT 10")
def page_after(spark, sf_dir):
    return _text(query.page_after(_users(spark, sf_dir), "user:120", 10))


@_query(LOG + "SELECT key, value FROM live ORDER BY key LIMIT 20")
def first_rows(spark, sf_dir):
    return _text(query.first_rows(_users(spark, sf_dir), 20))


@_query(LOG + "SELECT row_number() OVER (ORDER BY key) AS n, key FROM live")
def numbered_keys(spark, sf_dir):
    return query.numbered_keys(_users(spark, sf_dir))


@_query(LOG + "SELECT CASE WHEN length(key) > 20 THEN key[1:17] || '...' ELSE key END AS key, CASE WHEN length(value) > 20 THEN value[1:17] || '...' ELSE value END AS value FROM live")
def table_view(spark, sf_dir):
    return query.table_view(_users(spark, sf_dir))


@_query(LOG + "SELECT key, value, seq, is_deleted FROM log WHERE key >= 'user:4'")
def cursor_from(spark, sf_dir):
    return query.cursor(user_log(spark, sf_dir), "user:4").select("key", lossy_text("value").alias("value"), "seq", "is_deleted")


@_query(LOG + "SELECT key, value, seq, is_deleted FROM log WHERE key >= 'user:45' ORDER BY key, seq DESC LIMIT 1")
def cursor_seek(spark, sf_dir):
    return query.cursor_seek(user_log(spark, sf_dir), "user:45").select("key", lossy_text("value").alias("value"), "seq", "is_deleted")


@_query(LOG + "SELECT DISTINCT key FROM log WHERE run_id = 1 AND key IN (SELECT 'user:' || c_custkey FROM customer)")
def run_membership(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return query.membership(user_runs(spark, sf_dir).where("run_id = 1"), wanted)


@_query(LOG + "SELECT key, value, seq FROM log WHERE run_id = 1 AND key = 'user:11'")
def run_get(spark, sf_dir):
    return user_runs(spark, sf_dir).where((F.col("run_id") == 1) & (F.col("key") == "user:11")).select("key", lossy_text("value").alias("value"), "seq")


@_query(LOG + "SELECT key, sum(is_deleted::INT)::BIGINT AS tombstones FROM log GROUP BY key")
def tombstones(spark, sf_dir):
    return stats.tombstones_by_key(user_log(spark, sf_dir))


@_query(LOG + "SELECT key, count(*) AS versions, max(seq) AS max_seq FROM log GROUP BY key")
def version_count(spark, sf_dir):
    return stats.versions_by_key(user_log(spark, sf_dir))


@_query(LOG + "SELECT run_id, count(*) AS record_count, min(key) AS min_key, max(key) AS max_key FROM log GROUP BY ALL")
def run_stats(spark, sf_dir):
    return stats.run_stats(user_runs(spark, sf_dir))


@_query(LOG + "SELECT count(DISTINCT run_id) AS runs, count(*) AS records, sum(strlen(key) + strlen(value) + 32)::BIGINT AS bytes FROM log")
def storage_totals(spark, sf_dir):
    runs = user_runs(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("record_count"), F.sum(size_of()).alias("bytes"))
    return stats.storage_totals(runs)


@_query(LOG + """, t AS (SELECT count(DISTINCT run_id) AS runs, count(*) AS records, sum(strlen(key) + strlen(value) + 32)::BIGINT AS bytes FROM log)
SELECT 10::BIGINT AS mem_records, 2::BIGINT AS mem_kb, runs AS sst_files, records AS sst_records, bytes // 1024 AS sst_kb, 3::BIGINT AS wal_kb, records + 10 AS total_records, 4096::BIGINT AS memtable_max_size FROM t""")
def stats_all(spark, sf_dir):
    runs = user_runs(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("record_count"), F.sum(size_of()).alias("bytes"))
    return stats.stats_row(runs, 10, 2500, 4000, 4 << 20)


@_query(LOG + "SELECT run_id, least(1.0, count(*) / 4000.0)::DOUBLE AS fill FROM log GROUP BY ALL")
def fill_ratio(spark, sf_dir):
    runs = user_runs(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.select("run_id", stats.fill_ratio(F.col("n"), F.lit(4000.0)).alias("fill"))


@_query(LOG + "SELECT key, sum(strlen(key) + strlen(value) + 32)::BIGINT AS bytes FROM log GROUP BY key")
def record_size(spark, sf_dir):
    return stats.size_by_key(user_log(spark, sf_dir))


@_query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS ops FROM events GROUP BY ALL")
def ops_rate(spark, sf_dir):
    rates = stats.ops_rate(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 hour", None)
    return rates.select(F.unix_seconds("start").alias("start"), "ops")


@_query("""WITH e AS (SELECT epoch(ts)::BIGINT AS s FROM (SELECT date_trunc('second', ts) AS ts FROM events)), w AS (SELECT s - s % 1800 - 1800 * i AS start FROM e, range(4) t(i))
SELECT start, count(*) AS ops FROM w GROUP BY start""")
def ops_rate_sliding(spark, sf_dir):
    rates = stats.ops_rate(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "2 hours", "30 minutes")
    return rates.select(F.unix_seconds("start").alias("start"), "ops")


@_query(LOG + "SELECT key, sha256(key) AS hash FROM live")
def token_hashes(spark, sf_dir):
    return _users(spark, sf_dir).select("key", token_hash("key").alias("hash"))


@_query("SELECT 'batch:' || lpad(i::VARCHAR, 6, '0') AS key, 'value_' || i AS value FROM range(1000) t(i)")
def synthetic_batch(spark, sf_dir):
    return synthetic(spark, 1000, 6).select("key", "value")


@_query("SELECT 'batch:' || i AS key, 'value_' || i AS value FROM range(1000) t(i)")
def synthetic_plain(spark, sf_dir):
    return synthetic(spark, 1000).select("key", "value")


@_query("""WITH l AS (SELECT '  ' || p_name || ' = ' || p_brand || '=' || p_type || '  ' AS line, p_partkey AS seq FROM part), t AS (SELECT trim(line) AS line, seq FROM l)
SELECT trim(line[1:instr(line, '=') - 1]) AS key, trim(line[instr(line, '=') + 1:]) AS value, seq FROM t WHERE line <> '' AND NOT starts_with(line, '#') AND instr(line, '=') > 0""")
def import_lines(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = p.select(F.concat(F.lit("  "), "p_name", F.lit(" = "), "p_brand", F.lit("="), "p_type", F.lit("  ")).alias("line"), F.col("p_partkey").alias("seq"))
    return parse_lines(lines)[0]


@_query("""SELECT p_partkey AS seq, p_name AS line FROM part WHERE NOT contains(p_name, '=') AND trim(p_name) <> '' AND NOT starts_with(p_name, '#')""")
def import_errors(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parse_lines(p.select(F.col("p_name").alias("line"), F.col("p_partkey").alias("seq")))[1]


@_query("SELECT c_mktsegment || ':' || i AS key, c_name AS value, c_custkey AS arrived, i AS at FROM customer, range(3) t(i)")
def json_batch_put(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    record = lambda i: F.struct(F.concat("c_mktsegment", F.lit(f":{i}")).alias("key"), F.col("c_name").alias("value"))
    bodies = c.select("c_custkey", F.to_json(F.struct(F.array(*(record(i) for i in range(3))).alias("records"))).alias("body"))
    return json_puts(bodies, order="c_custkey")


@_query("SELECT 'user:' || u AS key, '' AS value, true AS is_deleted, u AS arrived, (u % 2)::BIGINT AS at FROM (SELECT DISTINCT user_id AS u FROM events)")
def json_batch_delete(spark, sf_dir):
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    pairs = F.when(F.col("user_id") % 2 == 1, F.array(F.lit("-"), F.concat(F.lit("user:"), F.col("user_id").cast("string")))).otherwise(F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))))
    return json_deletes(u.select("user_id", F.to_json(F.struct(pairs.alias("keys"))).alias("body")), order="user_id").where("key != '-'")


@_query("""WITH f AS (SELECT event_type AS name, count(*) % 2 = 1 AS enabled, 'about ' || event_type AS description FROM events GROUP BY event_type)
SELECT 3::BIGINT AS version, name, enabled, description FROM f""")
def feature_flags(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg((F.count(F.lit(1)) % 2 == 1).alias("enabled"))
    entry = F.struct("event_type", F.struct("enabled", F.concat(F.lit("about "), "event_type").alias("description")))
    doc = e.agg(F.to_json(F.struct(F.lit(3).alias("version"), F.map_from_entries(F.collect_list(entry)).alias("flags"))).cast("binary").alias("value"))
    return features.parse(doc)


@_query("SELECT false AS enabled")
def feature_unknown(spark, sf_dir):
    doc = spark.range(1).select(F.lit('{"version": 1, "flags": {"a": {"enabled": true}}}').cast("binary").alias("value"))
    return features.enabled(doc, "no such flag")


@_query(LOG + "SELECT key, value FROM live WHERE NOT starts_with(key, 'user:1')")
def system_filter(spark, sf_dir):
    users = _users(spark, sf_dir)
    hidden = users.select(F.regexp_replace("key", "^user:1", "feature:1").alias("key"), "value")
    return _text(query.without_system(hidden))


@_query(LOG + """SELECT key, '{"key":"' || key || '","value":' || to_json(value)::VARCHAR || '}' AS json FROM live""")
def json_result(spark, sf_dir):
    return json_rows(_users(spark, sf_dir)).select(F.get_json_object("json", "$.key").alias("key"), "json")


@_query(CUST_LOG + "SELECT key, value FROM live")
def customer_scan(spark, sf_dir):
    return _text(live(customer_log(spark, sf_dir)))


@_query(CUST_LOG + "SELECT key, value, is_deleted, seq FROM ranked WHERE r = 1")
def customer_newest(spark, sf_dir):
    return newest_wins(customer_log(spark, sf_dir)).select("key", lossy_text("value").alias("value"), "is_deleted", "seq")


@_query(DOC_LOG + "SELECT key, sha256(value) AS hash FROM live WHERE starts_with(key, 'doc:en:')")
def document_prefix(spark, sf_dir):
    return query.search_prefix(live(document_log(spark, sf_dir)), "doc:en:").select("key", F.sha2("value", 256).alias("hash"))


@_query(DOC_LOG + "SELECT key, sha256(value) AS hash FROM live WHERE contains(key, ':src1:')")
def document_contains(spark, sf_dir):
    return query.search(live(document_log(spark, sf_dir)), ":src1:").select("key", F.sha2("value", 256).alias("hash"))


@_query(PAGE_LOG + "SELECT key, sha256(value) AS hash FROM live")
def page_scan(spark, sf_dir):
    return live(page_log(spark, sf_dir)).select("key", F.sha2("value", 256).alias("hash"))


@_query(TURN_LOG + "SELECT key, value FROM live WHERE key >= 'conv:1' AND key < 'conv:2'")
def turn_range(spark, sf_dir):
    return _text(query.range_scan(live(turn_log(spark, sf_dir)), "conv:1", "conv:2"))


@_query(TURN_LOG + "SELECT key, value FROM live WHERE key > 'conv:10:0001' ORDER BY key LIMIT 25")
def turn_page(spark, sf_dir):
    return _text(query.page_after(live(turn_log(spark, sf_dir)), "conv:10:0001", 25))


@_query("SELECT event_id, coalesce(upper(split_part(line, ' ', 1)), '') AS verb, split_part(line, ' ', 2) AS arg, line[length(split_part(line, ' ', 1)) + length(split_part(line, ' ', 2)) + 3:] AS rest FROM (SELECT event_id, event_type || ' user:' || user_id || ' a value of  ' || event_id AS line FROM events)")
def command_split(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat("event_type", F.lit(" user:"), F.col("user_id").cast("string"), F.lit(" a value of  "), F.col("event_id").cast("string"))
    return e.select("event_id", split_command(line).alias("c")).select("event_id", "c.verb", "c.arg", "c.rest")


@_query("SELECT o_orderkey, lpad((o_orderkey % 1000)::VARCHAR, 6, '0') AS padded, o_orderkey // 1024 AS kb, printf('%02d:%02d:%02d', o_orderkey // 3600, o_orderkey // 60 % 60, o_orderkey % 60) AS up, CASE WHEN length(o_orderpriority) > 8 THEN o_orderpriority[1:5] || '...' ELSE o_orderpriority END AS shown, to_base64(encode(o_orderpriority)) AS b64 FROM orders")
def scalar_functions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    return o.select(k, zero_padded(k % 1000).alias("padded"), kilobytes(k).alias("kb"), uptime(k).alias("up"), display("o_orderpriority", 8).alias("shown"), F.base64(F.col("o_orderpriority").cast("binary")).alias("b64"))


@_query(LOG + "SELECT key, value FROM live")
def store_round_trip(spark, sf_dir):
    """Two runs written to a table and merged on read."""
    table = _stored(spark, sf_dir)
    return _text(table.scan())


@_query(LOG + "SELECT key, value FROM live")
def compact_noop(spark, sf_dir):
    """The same after compaction: one run, read without a merge."""
    table = _stored(spark, sf_dir)
    compact(table)
    return _text(table.scan())


@_query(LOG + "SELECT key, value FROM live WHERE starts_with(key, 'user:12')")
def store_prefix(spark, sf_dir):
    return _text(_stored(spark, sf_dir).search_prefix("user:12"))


@_query(LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY key, run_id ORDER BY seq DESC) AS rr FROM log) SELECT count(*) AS records, min(key) AS min_key, max(key) AS max_key FROM r WHERE rr = 1 GROUP BY run_id")
def store_run_meta(spark, sf_dir):
    return _stored(spark, sf_dir).run_meta().select(F.col("record_count").alias("records"), "min_key", "max_key")


# -- through the store -------------------------------------------------------------------------------------------------


@_query(LOG + "SELECT key, count(*) AS versions, min(value) AS value, bool_and(is_deleted) AS is_deleted FROM ranked WHERE r = 1 AND run_id = 1 GROUP BY key")
def store_read_run(spark, sf_dir):
    """All versions that one run holds: the newest a key, tombstones included."""
    table = _stored(spark, sf_dir)
    rows = table.read_run(table.runs[1]["run_id"])
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.min(lossy_text("value")).alias("value"), F.bool_and("is_deleted").alias("is_deleted"))


@_query(LOG + "SELECT key, value, is_deleted FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS n FROM log WHERE run_id = 0 AND key = 'user:11') WHERE n = 1")
def store_run_get(spark, sf_dir):
    """One key from the older run, whatever the newer one says."""
    table = _stored(spark, sf_dir)
    return table.get_from_run(table.runs[0]["run_id"], "user:11").select("key", lossy_text("value").alias("value"), "is_deleted")


@_query(LOG + "SELECT w.key, l.key IS NOT NULL AS found, l.value FROM (SELECT DISTINCT 'user:' || c_custkey AS key FROM customer) w LEFT JOIN live l ON w.key = l.key")
def store_multi_get(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return _stored(spark, sf_dir).multi_get(wanted).withColumn("value", lossy_text("value"))


@_query(LOG + "SELECT key, value FROM live WHERE key >= 'user:2' AND key < 'user:4'")
def store_range(spark, sf_dir):
    return _text(_stored(spark, sf_dir).range_scan("user:2", "user:4"))


@_query(LOG + "SELECT key, value FROM live WHERE key > 'user:120' ORDER BY key LIMIT 10")
def store_page(spark, sf_dir):
    return _text(_stored(spark, sf_dir).page_after("user:120", 10))


@_query(LOG + "SELECT key FROM live")
def store_keys(spark, sf_dir):
    return _stored(spark, sf_dir).keys()


@_query(LOG + "SELECT key, value, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY key, run_id ORDER BY seq DESC) AS n FROM log) WHERE n = 1 AND key >= 'user:4'")
def store_cursor(spark, sf_dir):
    """Raw versions of all runs from a key on: one a key and run."""
    return _stored(spark, sf_dir).cursor("user:4").select("key", lossy_text("value").alias("value"), "is_deleted")


@_query(LOG + "SELECT 10::BIGINT AS mem_records, count(DISTINCT run_id) AS sst_files, count(DISTINCT (key, run_id)) AS sst_records, count(DISTINCT (key, run_id)) + 10 AS total_records FROM log")
def store_stats(spark, sf_dir):
    """Physical records of two runs, and ten buffered ones."""
    table = _stored(spark, sf_dir)
    table.set_batch((f"buffered:{i}", "x") for i in range(10))
    return table.stats_all().select("mem_records", "sst_files", "sst_records", "total_records")


NATIONS = "WITH n AS (SELECT 'nation:' || n_name AS key, n_nationkey AS i, n_regionkey AS r FROM nation) "


@_query(NATIONS + "SELECT key, i || ' again' AS value FROM n WHERE r = 1 UNION ALL SELECT key, i::VARCHAR FROM n WHERE r NOT IN (0, 1)")
def store_writes(spark, sf_dir):
    """Single puts, deletes of present and absent keys, and puts again, all still in the buffer."""
    return _text(_nation_writes(spark, sf_dir).scan())


@_query(NATIONS + "SELECT key, i || ' again' AS value FROM n WHERE r = 1 UNION ALL SELECT key, i::VARCHAR FROM n WHERE r NOT IN (0, 1)")
def store_replayed(spark, sf_dir):
    """The same by another process, which has the log only."""
    return _text(KVTable.open(spark, _nation_writes(spark, sf_dir).files.root).scan())


@_query(NATIONS + "SELECT key, i || ' again' AS value FROM n WHERE r = 1 UNION ALL SELECT key, i::VARCHAR FROM n WHERE r NOT IN (0, 1)")
def store_reopened(spark, sf_dir):
    """The same after the buffer became a run and the log was cut."""
    table = _nation_writes(spark, sf_dir)
    table.flush()
    return _text(KVTable.open(spark, table.files.root).scan())


@_query("""WITH c AS (SELECT 'cust:' || c_custkey AS key, c_name AS name, c_mktsegment AS segment, c_custkey AS i FROM customer)
SELECT key, CASE WHEN i % 2 = 0 THEN segment ELSE name END AS value FROM c WHERE i % 3 <> 0""")
def store_three_runs(spark, sf_dir):
    """All keys in the first run, every other one again in the second, and tombstones of every third in the newest."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), "c_name", "c_mktsegment", "c_custkey")
    table = _new_table(spark)
    table.write(c.select("key", F.col("c_name").alias("value")))
    table.write(c.where("c_custkey % 2 = 0").select("key", F.col("c_mktsegment").alias("value")))
    table.write(c.where("c_custkey % 3 = 0").select("key", F.lit("").alias("value"), F.lit(True).alias("is_deleted")))
    return _text(table.scan())


@_query(NATIONS + "SELECT key, 'back' AS value FROM n WHERE i % 2 = 0")
def store_delete_batch(spark, sf_dir):
    """A run of all keys, deleted in one batch over it, half of them put again, compacted: no tombstone is left."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("nation:"), "n_name").alias("key"), F.col("n_nationkey").alias("i"))
    table, held = _new_table(spark), n.collect()  # the 25 nations
    table.write(n.select("key", F.lit("first").alias("value")))
    table.delete_batch(r.key for r in held)
    table.set_batch((r.key, "back") for r in held if r.i % 2 == 0)
    compact(table)
    return _text(table.log())


@_query("""WITH l AS (SELECT trim(p_brand) AS key, p_type || '=' || p_partkey AS value, p_partkey % 2 AS file, p_partkey AS place FROM part)
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file DESC, place DESC) AS r FROM l) WHERE r = 1""")
def store_import(spark, sf_dir):
    """Two files of ``key=value`` lines that share keys: the later file wins, and in a file the later line."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    table = _new_table(spark)
    folder = table.files.at("import")
    for i in range(2):
        lines = p.where(F.col("p_partkey") % 2 == i).orderBy("p_partkey").select(F.concat(F.lit(" "), "p_brand", F.lit(" = "), "p_type", F.lit("="), F.col("p_partkey").cast("string")))
        lines.write.text(f"{folder}/{i}")
    records, _ = import_text(spark, f"{folder}/*")
    table.write(records, order=F.col("seq"))
    return _text(table.scan())


@_query("SELECT 'flag ' || r_name AS name, r_regionkey % 2 = 0 AS enabled, CASE WHEN r_regionkey = 1 THEN 'new' ELSE 'about ' || r_name END AS description, 6::BIGINT AS version FROM region WHERE r_regionkey <> 3")
def store_flags(spark, sf_dir):
    """Flags set, changed and removed through the client, read back from the stored document."""
    table, regions = _new_table(spark), spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()  # the five regions
    client = features.FeatureClient(table, ttl_s=0)
    flags = {f"flag {r.r_name}": {"enabled": r.r_regionkey % 2 == 0, "description": f"about {r.r_name}"} for r in regions}
    table.put(features.KEY, json.dumps({"version": 3, "flags": flags}))
    client.set_flag(f"flag {regions[1].r_name}", False, "new")
    client.set_flag(f"flag {regions[2].r_name}", True)
    client.remove_flag(f"flag {regions[3].r_name}")
    return features.parse(table.snapshot(features.KEY, features.KEY))


@_query(LOG + "SELECT key, value FROM live")
def stream_into_store(spark, sf_dir):
    """The user log as a stream, written batch by batch, each once."""
    table = _new_table(spark)
    log = user_log(spark, sf_dir)
    for half in (F.col("seq") < user_cut(spark, sf_dir), F.col("seq") >= user_cut(spark, sf_dir)):  # files arrive in the order of the log
        log.where(half).coalesce(1).write.mode("append").parquet(table.files.at("source"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(table.files.at("source"))
    into_table(source, table, f"users {uuid4().hex}", table.files.at("checkpoint"), order=F.col("seq")).trigger(availableNow=True).start().awaitTermination()
    return _text(table.scan())


def _nation_writes(spark: SparkSession, sf_dir: str) -> KVTable:
    table = _new_table(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # the 25 nations
    key = lambda r: f"nation:{r.n_name}"
    for r in rows[:3]:
        table.put(key(r), str(r.n_nationkey))
    table.set_batch((key(r), str(r.n_nationkey)) for r in rows[3:])
    table.delete("nation:never written")
    table.delete_batch(key(r) for r in rows if r.n_regionkey <= 1)
    table.set_batch((key(r), f"{r.n_nationkey} again") for r in rows if r.n_regionkey == 1)
    return table


def _new_table(spark: SparkSession) -> KVTable:
    """An empty table in the folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kvspark-table-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    return KVTable.open(spark, f"{root.rstrip('/')}/kvspark-table-{uuid4().hex}")


def _stored(spark: SparkSession, sf_dir: str) -> KVTable:
    """The user log as a table of two runs, each of one half of its events."""
    table, log, cut = _new_table(spark), user_log(spark, sf_dir), user_cut(spark, sf_dir)
    for half in (F.col("seq") < cut, F.col("seq") >= cut):
        table.write(log.where(half).select("key", "value", "is_deleted", "seq"), order=F.col("seq"))
    return table


__all__ = ["QUERIES", "SQL"]
