"""The queries over the driver's tables, each with the SQL it has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec, metrics
from palimpsest.operators import compact, faults, replog, resolve, runs
from palimpsest.operators.ordered import numbered
from palimpsest.schema import value_text
from palimpsest.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SNAPSHOT, TARGET, CAPACITY = 5000, 50, 40

#: Common table expressions of the SQL, each with those before it that it needs.
CTES = {
    "ev": "ev AS (SELECT printf('u_%06d', user_id) AS key, event_id + 1 AS seq, event_type = 'error' AS tomb, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)",
    "nw": "nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1)",
    "ty": """ty AS (SELECT printf('u_%06d', user_id) AS key, event_id + 1 AS seq,
        CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS value_type,
        CASE event_type WHEN 'click' THEN event_id WHEN 'signup' THEN user_id END AS v_long,
        CASE event_type WHEN 'purchase' THEN value END AS v_double, CASE event_type WHEN 'view' THEN props END AS v_string FROM events)""",
    "ck": "ck AS (SELECT printf('u_%06d', c_custkey) AS key FROM customer)",
    "l0": "l0 AS (SELECT * FROM (SELECT *, (seq - 1) // 1000 AS table_id, row_number() OVER (PARTITION BY (seq - 1) // 1000, key ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1)",
    "st": "st AS (SELECT table_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_entries, sum(20 + strlen(key) + CASE WHEN tomb THEN 0 ELSE 8 END)::BIGINT AS bytes, max(seq) AS max_seq FROM l0 GROUP BY table_id)",
    "pr": "pr AS (SELECT printf('p_%08d', p_partkey) AS key, p_partkey + 1 AS seq, p_name FROM part)",
    "pc": "pc AS (SELECT (row_number() OVER (ORDER BY key) - 1) // 50 AS table_id, key FROM pr)",
    "ps": "ps AS (SELECT table_id, min(key) AS min_key, max(key) AS max_key FROM pc GROUP BY table_id)",
    "pk": "pk AS (SELECT DISTINCT printf('p_%08d', l_partkey) AS key FROM lineitem)",
    "rl": """rl AS (SELECT node_id, seq AS index, 1 + (seq - 1) // 2500 AS term,
        CASE WHEN seq % 97 = 0 THEN 'READ_BARRIER' WHEN tomb THEN 'delete' ELSE 'PUT' END AS cmd, key, v AS v_double
        FROM ev, (VALUES ('n1', 0), ('n2', 40), ('n3', 700)) AS r(node_id, lag) WHERE seq <= (SELECT max(event_id) + 1 FROM events) - lag)""",
    "ap": """ap AS (SELECT node_id, key, index, v_double FROM (SELECT *, row_number() OVER (PARTITION BY node_id, key ORDER BY index DESC) AS rn
        FROM rl WHERE upper(cmd) IN ('PUT', 'DELETE')) WHERE rn = 1 AND cmd = 'PUT')""",
    "lx": "lx AS (SELECT max(event_id) + 1 AS last FROM events)",
    "fk": "fk AS (SELECT node_id, index, CASE WHEN node_id = 'n2' AND index > last * 4 // 5 THEN term - 1 ELSE term END AS term, cmd, key, v_double FROM rl, lx)",
    # follower n3 with terms of its own from a fifth of the log on, and what the leader n1 sends it from a tenth on
    "loc": "loc AS (SELECT index, CASE WHEN index >= last // 5 THEN term + 5 ELSE term END AS term, cmd, key FROM rl, lx WHERE node_id = 'n3')",
    "inc": "inc AS (SELECT index, term, cmd, key FROM rl, lx WHERE node_id = 'n1' AND index >= last // 10)",
    "cf": "cf AS (SELECT min(loc.index) AS conflict_index FROM loc JOIN inc ON loc.index = inc.index WHERE loc.term <> inc.term)",
    "ci": """ci AS (SELECT coalesce(max(index), 0)::BIGINT AS commit_index FROM rl WHERE node_id = 'n1' AND term = (SELECT max(term) FROM rl WHERE node_id = 'n1')
        AND index <= (SELECT max(index) FROM rl WHERE node_id = 'n2'))""",
    "ac": """ac AS (SELECT node_id, key, index, v_double FROM (SELECT *, row_number() OVER (PARTITION BY node_id, key ORDER BY index DESC) AS rn
        FROM rl WHERE index <= (SELECT commit_index FROM ci) AND upper(cmd) IN ('PUT', 'DELETE')) WHERE rn = 1 AND cmd = 'PUT')""",
    "tr": "tr AS (SELECT event_id AS msg_id, 'n' || (1 + event_id % 3) AS src, 'n' || (1 + (event_id + 1 + (event_id // 3) % 2) % 3) AS dst FROM events)",
    "blk": """blk AS (WITH RECURSIVE o AS (SELECT *, 20 + strlen(key) + strlen(p_name) AS size, row_number() OVER (ORDER BY key) - 1 AS pos FROM pr),
        f AS (SELECT pos // 500 AS table_id, pos % 500 AS rn, key, size FROM o),
        s(table_id, rn, key, cut, inside, pos) AS (SELECT table_id, rn, key, true, CASE WHEN size >= 4096 THEN 0 ELSE size END, 0::BIGINT FROM f WHERE rn = 0
            UNION ALL SELECT f.table_id, f.rn, f.key, s.inside = 0, CASE WHEN s.inside + f.size >= 4096 THEN 0 ELSE s.inside + f.size END, s.pos + g.size
            FROM s JOIN f ON f.table_id = s.table_id AND f.rn = s.rn + 1 JOIN f AS g ON g.table_id = s.table_id AND g.rn = s.rn)
        SELECT table_id, key AS first_key, pos AS file_offset FROM s WHERE cut)""",
}


def query(sql: str | None = None, *ctes: str):
    """Register a query under its function's name, with its SQL over the named common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = ("WITH " + ",\n".join(CTES[c] for c in ctes) + "\n" if ctes else "") + sql
        return f

    return add


def _l0(spark, d):
    return runs.flushed(t.events_log(spark, d))


@query("SELECT key, seq, v AS v_double FROM nw WHERE NOT tomb", "ev", "nw")
def kv_get_latest(spark, d):
    return resolve.live(t.events_log(spark, d)).select("key", "seq", "v_double")


@query(f"SELECT key, seq, v AS v_double FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev WHERE seq <= {SNAPSHOT}) WHERE rn = 1 AND NOT tomb", "ev")
def kv_get_snapshot(spark, d):
    return resolve.live(t.events_log(spark, d), SNAPSHOT).select("key", "seq", "v_double")


@query("SELECT key, seq, v AS v_double FROM nw WHERE NOT tomb AND key = 'u_000042'", "ev", "nw")
def kv_point_get(spark, d):
    return resolve.live(t.events_log(spark, d, user=42)).select("key", "seq", "v_double")


@query("SELECT ck.key, coalesce(seq, -1) AS seq, v AS v_double FROM ck LEFT JOIN (SELECT * FROM nw WHERE NOT tomb) n ON n.key = ck.key", "ev", "nw", "ck")
def kv_multi_get(spark, d):
    return resolve.multi_get(t.customer_keys(spark, d), t.events_log(spark, d)).select("key", F.coalesce("seq", F.lit(-1)).alias("seq"), "v_double")


@query("SELECT key FROM ck WHERE key IN (SELECT key FROM ev)", "ev", "ck")
def kv_exists(spark, d):
    return resolve.exists(t.customer_keys(spark, d), t.events_log(spark, d))


@query("SELECT key, tomb AS is_tombstone FROM nw", "ev", "nw")
def kv_is_tombstone(spark, d):
    return resolve.tombstones(t.events_log(spark, d))


@query("SELECT key FROM nw WHERE NOT tomb", "ev", "nw")
def kv_live_keys(spark, d):
    return resolve.live_keys(t.events_log(spark, d))


@query("SELECT DISTINCT key FROM ev a WHERE NOT tomb AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.key = a.key AND b.tomb AND b.seq > a.seq)", "ev")
def kv_live_keys_antijoin(spark, d):
    return resolve.live_keys_by_antijoin(t.events_log(spark, d))


@query("SELECT count(*) AS n_keys, count(*) FILTER (NOT tomb) AS n_live FROM nw", "ev", "nw")
def kv_live_count(spark, d):
    return resolve.counts(t.events_log(spark, d))


@query("SELECT key, seq, coalesce(lead(seq) OVER (PARTITION BY key ORDER BY seq), -1) AS valid_to, tomb FROM ev", "ev")
def kv_history(spark, d):
    return resolve.history(t.events_log(spark, d)).select("key", "seq", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), (F.col("value_type") == 4).alias("tomb"))


@query("""SELECT key, b AS seq, o AS op_index, v AS v_double FROM (SELECT *, (seq - 1) // 10 + 1 AS b, ((seq - 1) % 10)::INTEGER AS o,
    row_number() OVER (PARTITION BY key ORDER BY (seq - 1) // 10 DESC, (seq - 1) % 10 DESC) AS rn FROM ev) WHERE rn = 1 AND NOT tomb""", "ev")
def kv_batch_atomic(spark, d):
    return resolve.live(resolve.in_batches(t.events_log(spark, d), 10)).select("key", "seq", "op_index", "v_double")


@query("SELECT key, seq, value_type::SMALLINT AS value_type, coalesce(v_long, -1) AS v_long, v_double, v_string FROM ty", "ty")
def kv_typed_values(spark, d):
    return t.events_typed(spark, d).drop("op_index").withColumn("v_long", F.coalesce("v_long", F.lit(-1)))


@query("""SELECT ck.key, coalesce(v_string, v_long::VARCHAR, '') AS value FROM ck LEFT JOIN (SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ty WHERE value_type <> 2) WHERE rn = 1 AND value_type <> 4) n ON n.key = ck.key""", "ty", "ck")
def kv_bitcask_get(spark, d):
    return resolve.string_or_empty(t.customer_keys(spark, d), t.events_typed(spark, d).filter("value_type <> 2"))


@query("SELECT table_id, key, seq, tomb, v AS v_double FROM l0", "ev", "l0")
def kv_flush_l0(spark, d):
    return _l0(spark, d).select("table_id", "key", "seq", (F.col("value_type") == 4).alias("tomb"), "v_double")


SHARDS = 16


@query(f"SELECT o_orderkey % {SHARDS} AS shard, (row_number() OVER (PARTITION BY o_orderkey % {SHARDS} ORDER BY o_orderkey) - 1) // 100 AS table_id, printf('o_%08d', o_orderkey) AS key FROM orders")
def kv_flush_boundaries(spark, d):
    log = t.orders_log(spark, d).withColumn("shard", F.pmod(F.col("seq") - 1, F.lit(SHARDS)))
    return runs.flush_boundaries(log, 100, "shard").select("shard", "table_id", "key")


@query("SELECT * FROM st", "ev", "l0", "st")
def kv_run_stats(spark, d):
    return runs.run_stats(_l0(spark, d))


@query("SELECT key, seq, tomb, table_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM l0) WHERE n = 1", "ev", "l0")
def kv_lookup_location(spark, d):
    return resolve.newest(_l0(spark, d), carry=("table_id",)).select("key", "seq", (F.col("value_type") == 4).alias("tomb"), "table_id")


@query("SELECT key, seq, tomb, v AS v_double FROM l0 WHERE table_id = 3", "ev", "l0")
def kv_scan_run(spark, d):
    return _l0(spark, d).filter("table_id = 3").select("key", "seq", (F.col("value_type") == 4).alias("tomb"), "v_double")


@query("""SELECT key, seq, tomb FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev
    WHERE seq > (SELECT (max(seq) - 1) // 1000 * 1000 FROM ev)) WHERE rn = 1""", "ev")
def kv_scan_memtable(spark, d):
    """What is in the buffer since the last flush."""
    return resolve.newest(t.events_log(spark, d).filter(F.col("seq") > (t.last_index(spark, d) - 1) // 1000 * 1000)).select("key", "seq", (F.col("value_type") == 4).alias("tomb"))


@query("SELECT a.table_id AS table_a, b.table_id AS table_b FROM st a JOIN st b ON a.table_id < b.table_id AND a.min_key <= b.max_key AND a.max_key >= b.min_key", "ev", "l0", "st")
def kv_overlap(spark, d):
    return runs.overlapping(runs.run_stats(_l0(spark, d)))


@query("SELECT pk.key, table_id FROM pk JOIN ps ON pk.key BETWEEN min_key AND max_key", "pr", "pc", "ps", "pk")
def kv_interval_lookup(spark, d):
    stats = runs.run_stats(runs.chunked(t.part_run(spark, d), TARGET))
    return runs.interval_lookup(t.part_keys(spark, d), stats)


@query("""SELECT (row_number() OVER (ORDER BY key) - 1) // 50 AS table_id, key, seq, v AS v_double FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM l0)
    WHERE n = 1 AND NOT tomb""", "ev", "l0")
def kv_compact_l0(spark, d):
    return compact.compacted(_l0(spark, d).drop("table_id"), target=TARGET, bottom=True).select("table_id", "key", "seq", "v_double")


@query("""SELECT (row_number() OVER (ORDER BY key) - 1) // 50 AS table_id, key, seq, tomb FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM l0) WHERE n = 1""", "ev", "l0")
def kv_compact_keep_tombstones(spark, d):
    return compact.compacted(_l0(spark, d).drop("table_id"), target=TARGET, bottom=False).select("table_id", "key", "seq", (F.col("value_type") == 4).alias("tomb"))


@query(f"""SELECT key, seq FROM nw WHERE NOT (tomb AND seq <= {SNAPSHOT}) UNION SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM ev
    WHERE seq <= {SNAPSHOT}) WHERE n = 1 AND NOT tomb""", "ev", "nw")
def kv_compact_pinned(spark, d):
    return compact.merged(t.events_log(spark, d), bottom=True, pins=(SNAPSHOT,)).select("key", "seq")


@query("SELECT 0::BIGINT AS n_different, count(*) AS n_live FROM nw WHERE NOT tomb", "ev", "nw")
def kv_flush_invariance(spark, d):
    columns = ["key", "seq", "v_double"]
    before = resolve.live(t.events_log(spark, d)).select(*columns)
    after = compact.merged(_l0(spark, d).drop("table_id"), bottom=True).select(*columns)
    both = before.withColumn("side", F.lit(1)).unionByName(after.withColumn("side", F.lit(-1)))
    state = both.groupBy(*columns).agg(F.sum("side").alias("off"), F.count_if(F.col("side") == 1).alias("n"))
    return state.agg(F.count_if(F.col("off") != 0).alias("n_different"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_live"))


def _part_blocks(spark, d):
    return runs.block_index(runs.chunked(t.part_run(spark, d), 500))


@query("SELECT table_id, first_key, file_offset FROM blk", "pr", "blk")
def kv_block_index(spark, d):
    return _part_blocks(spark, d)


@query("""SELECT k.key, b.table_id, b.file_offset FROM (SELECT key FROM pk UNION ALL SELECT 'a_before_all') k
    ASOF LEFT JOIN (SELECT * FROM blk UNION ALL SELECT table_id, '', file_offset FROM (SELECT * FROM blk ORDER BY first_key LIMIT 1)) b ON k.key >= b.first_key""", "pr", "pk", "blk")
def kv_block_candidate(spark, d):
    keys = t.part_keys(spark, d).unionByName(spark.range(1).select(F.lit("a_before_all").alias("key")))
    return runs.as_of(keys, _part_blocks(spark, d), "key", "first_key", ["table_id", "file_offset"])


@query("SELECT printf('d_%08d', doc_id) AS key, (20 + 10 + strlen(text))::BIGINT AS frame_size FROM documents")
def kv_frame_size(spark, d):
    return t.docs_run(spark, d).select("key", codec.frame_size().cast("bigint").alias("frame_size"))


@query("SELECT key, (20 + strlen(key) + strlen(p_name))::BIGINT AS frame_bytes, true AS intact, false AS damaged_passes FROM pr", "pr")
def kv_crc(spark, d):
    """Frames of a run, checked against their own checksums as they are and with one byte changed."""
    frame = codec.encode_frame("seq", "key", "value_type", "v_long", "v_double", "v_string")
    framed = t.part_run(spark, d).select("key", frame.alias("f"))
    damaged = F.concat(F.expr("substring(f, 1, octet_length(f) - 1)"), F.unhex(F.when(F.hex(F.expr("substring(f, -1, 1)")) == "00", "01").otherwise("00")))
    return framed.select("key", F.octet_length("f").cast("bigint").alias("frame_bytes"), codec.is_intact(F.col("f")).alias("intact"), codec.is_intact(damaged).alias("damaged_passes"))


@query("SELECT count(DISTINCT p_partkey) AS n_members, count(DISTINCT p_partkey) AS n_found, count(DISTINCT p_partkey) AS n_others, true AS few_false FROM part")
def kv_bloom_probe(spark, d):
    """Members are all found; of as many other keys, few are (the filter is made for 1 %)."""
    run = t.part_run(spark, d)
    m, k = runs.bloom_size(run.count())
    both = run.select("key", F.lit(True).alias("member")).unionByName(run.select(F.concat(F.lit("x"), "key").alias("key"), F.lit(False).alias("member")))
    probe = runs.bloom_probe(both.select("key"), runs.bloom_build(run, m, k), m, k).join(both, "key")
    others = F.count_if(~F.col("member"))
    return probe.agg(
        F.count_if("member").alias("n_members"), F.count_if(F.col("member") & F.col("might_contain")).alias("n_found"), others.alias("n_others"),
        (F.count_if(~F.col("member") & F.col("might_contain")) <= F.greatest(F.lit(5), others * 0.03)).alias("few_false"),
    )


@query("""SELECT user_chars, disk_chars, disk_chars / user_chars AS waf FROM (SELECT (SELECT sum(length(key) + length(coalesce(v_string, v_long::VARCHAR, '')))::BIGINT FROM ty
    WHERE value_type <> 2) AS user_chars, (SELECT sum(length(key) + length(coalesce(v_string, v_long::VARCHAR, '')) + 16)::BIGINT FROM (SELECT *, row_number() OVER
    (PARTITION BY (seq - 1) // 1000, key ORDER BY seq DESC) AS rn FROM ty WHERE value_type <> 2) WHERE rn = 1) AS disk_chars)""", "ty")
def kv_bytes_waf(spark, d):
    log = t.events_typed(spark, d).filter("value_type <> 2")
    chars = metrics.logical_bytes(value_text())
    user = log.agg(F.sum(chars).cast("bigint").alias("user_chars"))
    disk = runs.flushed(log).agg(F.sum(chars + metrics.FLUSH_OVERHEAD).cast("bigint").alias("disk_chars"))
    return user.join(disk).withColumn("waf", metrics.ratio(F.col("disk_chars"), F.col("user_chars")))


@query("""SELECT held, alive, held / alive AS saf FROM (SELECT (SELECT sum(20 + strlen(key) + CASE WHEN tomb THEN 0 ELSE 8 END)::BIGINT FROM l0) AS held,
    (SELECT sum(28 + strlen(key))::BIGINT FROM nw WHERE NOT tomb) AS alive)""", "ev", "nw", "l0")
def kv_saf(spark, d):
    size = F.sum(codec.frame_size()).cast("bigint")
    held, alive = _l0(spark, d).agg(size.alias("held")), resolve.live(t.events_log(spark, d)).agg(size.alias("alive"))
    return held.join(alive).withColumn("saf", metrics.ratio(F.col("held"), F.col("alive")))


@query("SELECT count(*) AS l0_runs, count(*) >= 8 AS writers_wait FROM st", "ev", "l0", "st")
def kv_backpressure(spark, d):
    return compact.backpressure(runs.run_stats(_l0(spark, d)).withColumn("level", F.lit(0)))


def _manifest(spark, d):
    return runs.run_stats(_l0(spark, d)).withColumn("level", F.when(F.col("table_id") % 3 == 0, 1).otherwise(0))


@query("""SELECT m.level, table_id, n_runs, n_runs >= 4 AS due FROM (SELECT *, CASE WHEN table_id % 3 = 0 THEN 1 ELSE 0 END AS level FROM st) m
    JOIN (SELECT CASE WHEN table_id % 3 = 0 THEN 1 ELSE 0 END AS level, count(*) AS n_runs, arg_min(table_id, min_key || printf('%09d', table_id)) AS first FROM st GROUP BY 1) s ON s.level = m.level
    WHERE m.level = 0 OR table_id = first""", "ev", "l0", "st")
def kv_compact_pick(spark, d):
    return compact.pick(_manifest(spark, d))


@query("SELECT table_id, n_entries FROM st WHERE table_id % 3 <> 0 UNION ALL SELECT 100 + table_id, n_entries FROM st WHERE table_id % 3 = 0", "ev", "l0", "st")
def kv_manifest_swap(spark, d):
    stats = runs.run_stats(_l0(spark, d)).select("table_id", "n_entries")
    gone = stats.filter("table_id % 3 = 0")
    return compact.swapped(stats, gone, gone.withColumn("table_id", F.col("table_id") + 100))


@query("SELECT table_id, printf('sst_%05d', table_id) AS name FROM st", "ev", "l0", "st")
def kv_run_name(spark, d):
    return runs.run_stats(_l0(spark, d)).select("table_id", runs.run_name().alias("name"))


@query("SELECT row_number() OVER (ORDER BY key, seq DESC) AS row_no, key, seq FROM ev", "ev")
def kv_sorted_versions(spark, d):
    return runs.sorted_versions(t.events_log(spark, d)).select("row_no", "key", "seq")


@query("""SELECT user_id % 4 AS cache_id, count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS hit_ratio FROM (SELECT a.user_id, a.event_id, a.prev IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM events b
    WHERE b.user_id % 4 = a.user_id % 4 AND b.event_id > a.prev AND b.event_id < a.event_id) < 20 AS hit FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) a) GROUP BY 1""")
def kv_cache_lru(spark, d):
    trace = t.table(spark, d, "events").select((F.col("user_id") % 4).alias("cache_id"), F.col("event_id").alias("access_no"), F.col("user_id").alias("block"))
    return runs.lru_trace(trace, 20).groupBy("cache_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.round(metrics.hit_ratio(F.col("hit")), 6).alias("hit_ratio"))


@query("""SELECT event_type, sum(event_id)::BIGINT AS merged_bytes, count(*) AS compactions, sum(1 + event_id % 5)::BIGINT AS millis,
    round(sum(event_id)::DOUBLE / 1048576 / greatest(0.001, sum(1 + event_id % 5) / 1000), 6) AS mb_per_s FROM events GROUP BY 1""")
def kv_merge_throughput(spark, d):
    log = t.table(spark, d, "events").groupBy("event_type").agg(F.sum("event_id").alias("merged_bytes"), F.count(F.lit(1)).alias("compactions"), F.sum(1 + F.col("event_id") % 5).alias("millis"))
    return log.withColumn("mb_per_s", F.round(metrics.merge_throughput(F.col("merged_bytes"), F.col("millis")), 6))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def kv_json_field(spark, d):
    return t.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS doc FROM events""")
def kv_json_encode(spark, d):
    return t.table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query("SELECT event_id, (event_id * 1000003) & 4294967295 AS epoch FROM events")
def kv_epoch32(spark, d):
    return t.table(spark, d, "events").select("event_id", codec.epoch32(F.col("event_id") * 1000003).alias("epoch"))


@query("SELECT page_id, url_decode(url_encode(url)) AS url FROM pages")
def kv_url_decode(spark, d):
    return t.table(spark, d, "pages").select("page_id", F.url_decode(F.url_encode("url")).alias("url"))


_ORDER = "SELECT event_type, count(*) AS n, " + ", ".join(
    f"max(value) FILTER (rn = least(n - 1, {at})) AS {name}" for name, at in (("min", "0"), ("max", "n - 1"), ("median", "n // 2"), ("p50", "floor(n * 0.5)"), ("p95", "floor(n * 0.95)"), ("p99", "floor(n * 0.99)"), ("p999", "floor(n * 0.999)"))
) + " FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type"


@query(_ORDER)
def stat_percentiles(spark, d):
    return metrics.order_statistics(t.table(spark, d, "events"), "event_type", "value")


@query("SELECT user_id, round(coalesce(stddev_samp(value), 0), 6) AS std_dev FROM events GROUP BY user_id")
def stat_std_dev(spark, d):
    return metrics.spread(t.table(spark, d, "events"), "user_id", "value").select("user_id", F.round("std_dev", 6).alias("std_dev"))


@query("""SELECT event_type, sum(n_ok)::BIGINT AS n_ok, sum(n_total)::BIGINT AS n_total, coalesce(arg_max(service_ms, run_no) FILTER (service_ms > 0), 0) AS service_ms,
    round(sum(n_ok) * 100.0 / sum(n_total), 6) AS success_rate FROM (SELECT event_type, user_id % 3 AS run_no, count(*) FILTER (value > 20) AS n_ok, count(*) AS n_total,
    max(value) AS service_ms FROM events GROUP BY 1, 2) GROUP BY 1""")
def stat_run_aggregate(spark, d):
    by_run = t.table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("run_no"))
    by_run = by_run.agg(F.count_if(F.col("value") > 20).alias("n_ok"), F.count(F.lit(1)).alias("n_total"), F.max("value").alias("service_ms"))
    return metrics.merge_runs(by_run, "event_type").withColumn("success_rate", F.round("success_rate", 6))


@query("SELECT event_id, CASE WHEN event_id = 0 THEN '—' WHEN event_id < 1000 THEN event_id || ' µs' ELSE printf('%d.%02d ms', (event_id + 5) // 1000, (event_id + 5) // 10 % 100) END AS latency FROM events")
def stat_latency_text(spark, d):
    return t.table(spark, d, "events").select("event_id", metrics.latency_text(F.col("event_id")).alias("latency"))


@query("""SELECT coalesce(max(index), 0)::BIGINT AS commit_index FROM rl WHERE node_id = 'n1' AND term = (SELECT max(term) FROM rl WHERE node_id = 'n1')
    AND index <= (SELECT max(index) FROM rl WHERE node_id = 'n2')""", "ev", "rl")
def repl_commit_index(spark, d):
    return replog.commit_index(t.replicated_log(spark, d), "n1")


@query("""SELECT coalesce(max(n.index), 0)::BIGINT AS commit_index FROM fk n WHERE node_id = 'n1' AND term = (SELECT arg_max(term, index) FROM fk WHERE node_id = 'n1')
    AND 2 <= 1 + (SELECT count(*) FROM (VALUES ('n2'), ('n3')) f(node_id) WHERE n.index <= (SELECT max(index) FROM fk WHERE fk.node_id = f.node_id)
        AND n.index < coalesce((SELECT min(a.index) FROM fk a JOIN fk b ON a.index = b.index AND b.node_id = 'n1' WHERE a.node_id = f.node_id AND a.term <> b.term), 1000000000000))""", "ev", "rl", "lx", "fk")
def repl_commit_forked(spark, d):
    return replog.commit_index(t.forked_log(spark, d), "n1")


@query("""SELECT f.node_id, max(f.index) AS last_index, coalesce(min(f.index) FILTER (n.term IS NULL OR n.term <> f.term) - 1, max(f.index)) AS match_index
    FROM fk f LEFT JOIN fk n ON n.node_id = 'n1' AND n.index = f.index GROUP BY 1""", "ev", "rl", "lx", "fk")
def repl_match_index(spark, d):
    return replog.match_indexes(t.forked_log(spark, d), "n1")


@query("SELECT node_id, (SELECT max(index) FROM rl WHERE node_id = 'n1') + 1 AS next_index, 0::BIGINT AS match_index FROM (VALUES ('n2'), ('n3')) p(node_id)", "ev", "rl")
def repl_took_office(spark, d):
    return replog.took_office(t.replicated_log(spark, d), "n1")


@query("""SELECT g.node_id, last - p AS round, p AS prev_index, p = agrees AS success, CASE WHEN p = agrees THEN last ELSE 0 END::BIGINT AS match_index
    FROM (SELECT a.node_id, max(a.index) AS agrees FROM fk a JOIN fk b ON b.node_id = 'n1' AND a.index = b.index AND a.term = b.term WHERE a.node_id <> 'n1' GROUP BY 1) g, lx,
    range(0, (SELECT last + 1 FROM lx)) r(p) WHERE p >= agrees""", "ev", "rl", "lx", "fk")
def repl_trace(spark, d):
    return replog.replication_trace(t.forked_log(spark, d), "n1")


@query("""SELECT proposal_no, node_id, lead AS accepted, CASE WHEN lead THEN last + no ELSE -1 END AS index, CASE WHEN lead THEN (no - 1) // 128 ELSE -1 END AS batch_no
    FROM (SELECT event_id AS proposal_no, 'n' || (1 + user_id % 3) AS node_id, user_id % 3 = 0 AS lead, row_number() OVER (PARTITION BY user_id % 3 = 0 ORDER BY event_id) AS no FROM events), lx""", "lx")
def repl_propose(spark, d):
    proposals = t.table(spark, d, "events").select(F.col("event_id").alias("proposal_no"), F.concat(F.lit("n"), 1 + F.col("user_id") % 3).alias("node_id"))
    nodes = spark.createDataFrame([("n1", "LEADER"), ("n2", "FOLLOWER"), ("n3", "FOLLOWER")], "node_id string, role string")
    return replog.proposed(proposals, nodes, t.last_index(spark, d)).select("proposal_no", "node_id", "accepted", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("index", "batch_no")))


_TERMS = "SELECT printf('u_%06d', user_id) AS node_id, event_id AS msg_no, 1 + (event_id * 31 + user_id) % 1000 AS term FROM events"


def _messages(spark, d):
    return t.table(spark, d, "events").select(t.user_key().alias("node_id"), F.col("event_id").alias("msg_no"), (1 + (F.col("event_id") * 31 + F.col("user_id")) % 1000).alias("term"))


@query(f"""SELECT node_id, msg_no, max(term) OVER (PARTITION BY node_id ORDER BY msg_no) AS current_term,
    term > coalesce(max(term) OVER (PARTITION BY node_id ORDER BY msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS steps_down FROM ({_TERMS})""")
def repl_step_downs(spark, d):
    return replog.step_downs(_messages(spark, d)).select("node_id", "msg_no", "current_term", "steps_down")


@query(f"""SELECT p.node_id, p.msg_no, CASE WHEN p.msg_no < last // 4 THEN 'committed' WHEN EXISTS (SELECT 1 FROM m a WHERE a.node_id = p.node_id AND a.msg_no > p.msg_no
    AND a.term > (SELECT max(term) FROM m b WHERE b.node_id = a.node_id AND b.msg_no < a.msg_no)) THEN 'failed' ELSE 'pending' END AS outcome
    FROM (SELECT * FROM m WHERE msg_no % 10 = 0) p, lx""".replace("FROM m ", f"FROM ({_TERMS}) "), "lx")
def repl_proposal_outcome(spark, d):
    messages = _messages(spark, d)
    proposals = messages.filter("msg_no % 10 = 0").select("node_id", "msg_no", (F.col("msg_no") + 1).alias("index"))
    return replog.settled(proposals, messages, t.last_index(spark, d) // 4).select("node_id", "msg_no", "outcome")


_READS = """r AS (SELECT c_custkey AS read_no, printf('u_%06d', c_custkey) AS key, CASE c_custkey % 3 WHEN 0 THEN 'lease' WHEN 1 THEN 'read_index' ELSE 'barrier' END AS read_mode,
    c_custkey % 11 <> 0 AS is_leader, c_custkey % 2 = 0 AS in_lease, c_custkey % 7 <> 0 AS confirmed, 97 * (1 + c_custkey % 10) AS barrier_index FROM customer),
    s AS (SELECT r.*, commit_index, CASE WHEN NOT is_leader THEN 'error' WHEN read_mode = 'lease' AND in_lease THEN 'lease' WHEN read_mode <> 'barrier' AND confirmed THEN 'read_index'
        WHEN read_mode = 'barrier' AND barrier_index <= commit_index THEN 'barrier' ELSE 'error' END AS served FROM r, ci),
    v AS (SELECT read_no, arg_max(cmd, index) AS cmd, arg_max(coalesce(v_double, -1), index) AS v FROM s JOIN rl ON rl.node_id = 'n1' AND rl.key = s.key AND upper(cmd) IN ('PUT', 'DELETE')
        AND index <= CASE served WHEN 'error' THEN 0 WHEN 'barrier' THEN barrier_index ELSE commit_index END GROUP BY 1)
    SELECT s.read_no, s.key, served, CASE WHEN cmd = 'PUT' THEN v END AS value FROM s LEFT JOIN v ON v.read_no = s.read_no"""


@query(None)
def repl_linearizable_reads(spark, d):
    k, log = F.col("c_custkey"), t.replicated_log(spark, d)
    reads = t.table(spark, d, "customer").select(
        k.alias("read_no"), t.user_key("c_custkey").alias("key"), F.when(k % 3 == 0, "lease").when(k % 3 == 1, "read_index").otherwise("barrier").alias("read_mode"),
        (k % 11 != 0).alias("is_leader"), (k % 2 == 0).alias("in_lease"), (k % 7 != 0).alias("confirmed"), (97 * (1 + k % 10)).alias("barrier_index"),
    )
    return replog.linearizable_reads(reads, log.filter("node_id = 'n1'").drop("node_id"), replog.commit_index(log, "n1"))


ORACLE["repl_linearizable_reads"] = "WITH " + ",\n".join([CTES["ev"], CTES["rl"], CTES["ci"], _READS])


@query("""SELECT read_no, r.key, r.node_id, arg_max(CASE WHEN cmd = 'PUT' THEN v_double END, index) FILTER (cmd IS NOT NULL) AS value, NULL AS dropped
    FROM (SELECT c_custkey AS read_no, printf('u_%06d', c_custkey) AS key, 'n' || (1 + c_custkey % 3) AS node_id FROM customer) r LEFT JOIN rl ON false GROUP BY 1, 2, 3""", "ev", "rl")
def repl_local_reads(spark, d):
    """Reads that the node answers itself; n3 has applied half of its log only."""
    k, log = F.col("c_custkey"), t.replicated_log(spark, d)
    reads = t.table(spark, d, "customer").select(k.alias("read_no"), t.user_key("c_custkey").alias("key"), F.concat(F.lit("n"), 1 + k % 3).alias("node_id"))
    heads = replog.replicas(log).select("node_id", F.when(F.col("node_id") == "n3", F.floor(F.col("last_index") / 2)).otherwise(F.col("last_index")).alias("applied_index"))
    return replog.local_reads(reads, log, heads)


ORACLE["repl_local_reads"] = "WITH " + ",\n".join([CTES["ev"], CTES["rl"]]) + """,
    r AS (SELECT c_custkey AS read_no, printf('u_%06d', c_custkey) AS key, 'n' || (1 + c_custkey % 3) AS node_id FROM customer),
    h AS (SELECT node_id, CASE WHEN node_id = 'n3' THEN max(index) // 2 ELSE max(index) END AS upto FROM rl GROUP BY 1),
    w AS (SELECT read_no, cmd, v_double, row_number() OVER (PARTITION BY read_no ORDER BY index DESC) AS n FROM r JOIN h USING (node_id) JOIN rl ON rl.node_id = r.node_id AND rl.key = r.key
        AND index <= upto AND upper(cmd) IN ('PUT', 'DELETE'))
    SELECT r.read_no, r.key, r.node_id, CASE WHEN cmd = 'PUT' THEN v_double END AS value FROM r LEFT JOIN w ON w.read_no = r.read_no AND n = 1"""


@query("SELECT node_id, key, index, v_double FROM ap", "ev", "rl", "ap")
def repl_apply_state(spark, d):
    """The state of each node once it has applied all it has."""
    return replog.applied(t.replicated_log(spark, d))


@query("SELECT key, count(DISTINCT v_double) AS n_values, count(DISTINCT v_double) = 1 AND count(DISTINCT node_id) = 3 AS consistent FROM ap GROUP BY key", "ev", "rl", "ap")
def repl_consistency(spark, d):
    return replog.consistency(replog.applied(t.replicated_log(spark, d)), ["n1", "n2", "n3"])


@query("""SELECT n.node_id, k.key, CASE WHEN v_double IS NULL THEN 'OFFLINE' ELSE round(v_double * 1000)::BIGINT::VARCHAR END AS value FROM (SELECT DISTINCT key FROM ev) k,
    (VALUES ('n1'), ('n2'), ('n4')) n(node_id) LEFT JOIN ap ON ap.key = k.key AND ap.node_id = n.node_id""", "ev", "rl", "ap")
def repl_values_by_node(spark, d):
    """Values in thousandths, as text that both engines write alike."""
    state = replog.applied(t.replicated_log(spark, d)).withColumn("v_double", F.round(F.col("v_double") * 1000).cast("bigint"))
    return replog.values_by_node(state, t.events_log(spark, d).select("key"), ["n1", "n2", "n4"])


@query("SELECT node_id, key, index, v_double FROM ac", "ev", "rl", "ci", "ac")
def repl_apply_committed(spark, d):
    return replog.applied_to_commit(t.replicated_log(spark, d), "n1")


@query("SELECT key, count(DISTINCT v_double) AS n_values, count(DISTINCT v_double) = 1 AND count(DISTINCT node_id) = 3 AS consistent FROM ac GROUP BY key", "ev", "rl", "ci", "ac")
def repl_consistency_committed(spark, d):
    return replog.consistency(replog.applied_to_commit(t.replicated_log(spark, d), "n1"), ["n1", "n2", "n3"])


@query("""SELECT n.node_id, k.key, CASE WHEN v_double IS NULL THEN 'OFFLINE' ELSE round(v_double * 1000)::BIGINT::VARCHAR END AS value FROM (SELECT DISTINCT key FROM ev) k,
    (VALUES ('n1'), ('n2'), ('n4')) n(node_id) LEFT JOIN ac ON ac.key = k.key AND ac.node_id = n.node_id""", "ev", "rl", "ci", "ac")
def repl_values_committed(spark, d):
    state = replog.applied_to_commit(t.replicated_log(spark, d), "n1").withColumn("v_double", F.round(F.col("v_double") * 1000).cast("bigint"))
    return replog.values_by_node(state, t.events_log(spark, d).select("key"), ["n1", "n2", "n4"])


def _append(spark, d):
    """A follower's log, what the leader sends it, and the entry that this follows on."""
    log, last = t.replicated_log(spark, d), t.last_index(spark, d)
    local = log.filter("node_id = 'n3'").withColumn("term", F.when(F.col("index") >= last // 5, F.col("term") + 5).otherwise(F.col("term"))).select("index", "term", "cmd", "key")
    incoming = log.filter((F.col("node_id") == "n1") & (F.col("index") >= last // 10)).select("index", "term", "cmd", "key")
    prev = last // 10 - 1
    return local, incoming, prev, 1 + (prev - 1) // t.TERM_LENGTH


@query("SELECT conflict_index FROM cf", "ev", "rl", "lx", "loc", "inc", "cf")
def repl_conflict(spark, d):
    return replog.first_conflict(*_append(spark, d)[:2])


@query("""SELECT * FROM loc WHERE index < coalesce((SELECT conflict_index FROM cf), 1000000000000)
    UNION ALL SELECT * FROM inc WHERE index >= (SELECT conflict_index FROM cf) OR index NOT IN (SELECT index FROM loc)""", "ev", "rl", "lx", "loc", "inc", "cf")
def repl_reconcile(spark, d):
    return replog.reconciled(*_append(spark, d))


@query("""SELECT 'taken' AS what, true AS accepted, last AS last_index, least(last // 2, last) AS commit_index FROM lx
    UNION ALL SELECT 'gap', false, (SELECT max(index) FROM loc), 7 FROM lx UNION ALL SELECT 'other term', false, (SELECT max(index) FROM loc), 7 FROM lx
    UNION ALL SELECT 'short', true, (SELECT max(index) FROM loc), (SELECT max(index) FROM loc) FROM lx""", "ev", "rl", "lx", "loc")
def repl_follower_commit(spark, d):
    """An append that is taken, one after an entry that the follower lacks, one after another term, and an empty one."""
    local, incoming, prev, term = _append(spark, d)
    last = t.last_index(spark, d)
    cases = (("taken", incoming, prev, term, last // 2), ("gap", incoming.filter(F.col("index") > last - 5), last - 5, 1 + (last - 6) // t.TERM_LENGTH, last), ("other term", incoming, prev, term + 1, last), ("short", incoming.limit(0), prev, term, last))
    out = None
    for what, new, at, of, commit in cases:
        one = replog.follower_commit(local, new, at, of, commit, committed=7).select(F.lit(what).alias("what"), "accepted", "last_index", "commit_index")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT index, term FROM rl, lx WHERE node_id = 'n2' AND index < last // 2 AND index >= 1", "ev", "rl", "lx")
def repl_truncate(spark, d):
    return replog.log_slice(replog.truncated(t.replicated_log(spark, d).filter("node_id = 'n2'"), t.last_index(spark, d) // 2), -3).select("index", "term")


@query("SELECT i * 1000 AS index, coalesce(term, 0)::BIGINT AS term FROM range(0, 200) r(i) LEFT JOIN (SELECT * FROM rl WHERE node_id = 'n3') n ON n.index = i * 1000", "ev", "rl")
def repl_term_lookup(spark, d):
    return replog.terms_at(spark.range(200).select((F.col("id") * 1000).alias("index")), t.replicated_log(spark, d).filter("node_id = 'n3'"))


# n1 asks for the next term, n2 for the same one, n3 for an old one; n2 has voted for itself in the next term, n3 is a term ahead
_VOTES = """h AS (SELECT node_id, max(index) AS last_index, max(term) AS last_term FROM rl GROUP BY 1),
    q AS (SELECT node_id AS candidate, CASE WHEN node_id = 'n3' THEN last_term - 1 ELSE last_term + 1 END AS term, last_term, last_index FROM h),
    s AS (SELECT node_id, CASE WHEN node_id = 'n1' THEN last_term ELSE last_term + 1 END AS current_term, CASE WHEN node_id = 'n2' THEN 'n2' END AS voted_for, last_term, last_index FROM h),
    v AS (SELECT candidate, term, node_id, term >= current_term AND (term > current_term OR voted_for IS NULL OR voted_for = candidate)
        AND (q.last_term > s.last_term OR (q.last_term = s.last_term AND q.last_index >= s.last_index)) AS granted FROM q, s)"""


def _ballots(spark, d):
    heads, me = replog.replicas(t.replicated_log(spark, d)), F.col("node_id")
    requests = heads.select(me.alias("candidate"), F.when(me == "n3", F.col("last_term") - 1).otherwise(F.col("last_term") + 1).alias("term"), "last_term", "last_index")
    states = heads.select("node_id", F.when(me == "n1", F.col("last_term")).otherwise(F.col("last_term") + 1).alias("current_term"), F.when(me == "n2", "n2").alias("voted_for"), "last_term", "last_index")
    return replog.votes(requests, states)


@query(None)
def repl_vote(spark, d):
    return _ballots(spark, d)


ORACLE["repl_vote"] = f"WITH {CTES['ev']}, {CTES['rl']}, {_VOTES} SELECT candidate, term, node_id, granted FROM v"


@query(None)
def repl_election(spark, d):
    return replog.elections(_ballots(spark, d), 3)


ORACLE["repl_election"] = f"WITH {CTES['ev']}, {CTES['rl']}, {_VOTES} SELECT candidate, term, count(*) FILTER (granted) AS n_votes, count(*) FILTER (granted) >= 2 AS elected FROM v GROUP BY 1, 2"


@query("SELECT node_id, index, term, index <= commit_index AS is_committed FROM rl, ci", "ev", "rl", "ci")
def repl_status(spark, d):
    log = t.replicated_log(spark, d)
    return replog.status(log, replog.commit_index(log, "n1")).select("node_id", "index", "term", "is_committed")


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'error' WHEN event_id % 200 < 120 THEN 'lease' ELSE 'read_index' END AS mode FROM events")
def repl_read_modes(spark, d):
    reads = t.table(spark, d, "events").select("event_id", (F.col("event_id") % 200).alias("read_ts"), F.lit(120).alias("lease_expiry"), (F.col("user_id") % 5 != 0).alias("is_leader"))
    return replog.read_modes(reads).select("event_id", "mode")


@query("SELECT event_id // 4 AS round, count(*) FILTER (event_type <> 'error') + 1 >= 3 AS confirmed FROM events GROUP BY 1")
def repl_read_quorum(spark, d):
    acks = t.table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("round"), F.col("user_id").alias("peer"), (F.col("event_type") != "error").alias("success"))
    return replog.confirmed(acks, 5)


def _nodes(spark, d):
    nation = t.table(spark, d, "nation")
    part = F.when(F.col("n_regionkey") < 4, F.col("n_regionkey"))
    return nation.select(F.format_string("n%02d", "n_nationkey").alias("node_id"), (F.col("n_nationkey") % 7 == 3).alias("is_isolated"), part.alias("part"), F.when(F.col("n_nationkey") % 3 == 0, "LEADER").otherwise("FOLLOWER").alias("role"))


@query("""SELECT a.id AS src, b.id AS dst, NOT a.iso AND NOT b.iso AND (a.part IS NULL OR coalesce(a.part = b.part, false)) AS reachable FROM n a JOIN n b ON a.id <> b.id""")
def net_reachability(spark, d):
    return faults.reachable(_nodes(spark, d))


ORACLE["net_reachability"] = "WITH n AS (SELECT printf('n%02d', n_nationkey) AS id, n_nationkey % 7 = 3 AS iso, CASE WHEN n_regionkey < 4 THEN n_regionkey END AS part FROM nation)\n" + ORACLE["net_reachability"]


@query("SELECT printf('n%02d', min(n_nationkey)) AS node_id FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 7 <> 3")
def repl_leader(spark, d):
    return replog.leader(_nodes(spark, d)).select("node_id")


def _trace(spark, d):
    e = F.col("event_id")
    return t.table(spark, d, "events").select(e.alias("msg_id"), F.concat(F.lit("n"), 1 + e % 3).alias("src"), F.concat(F.lit("n"), 1 + (e + 1 + F.floor(e / 3) % 2) % 3).alias("dst"))


_DRAW = lambda salt, n: f"((msg_id * 7919 + {salt * 104729}) % 1000003) % {n}"
_FAULTS = f"""SELECT msg_id, src, dst, (src = 'n1' AND dst = 'n2') OR {_DRAW(1, 100)} < 25 AS dropped, 0::BIGINT AS delay_ms FROM tr"""


@query(_FAULTS, "tr")
def net_faults(spark, d):
    return faults.faulty(_trace(spark, d), "packet_loss", slow="n9", blocked=(("n1", "n2"),))


@query(f"SELECT msg_id, false AS dropped, 30 + {_DRAW(2, 51)} AS delay_ms FROM tr", "tr")
def net_jitter(spark, d):
    return faults.faulty(_trace(spark, d), "jitter").select("msg_id", "dropped", "delay_ms")


@query("""SELECT count(*) AS sent, count(*) FILTER (src = 'n1' AND dst = 'n2') AS dropped, count(*) FILTER ((src = 'n3' OR dst = 'n3')) AS delayed FROM tr""", "tr")
def net_counters(spark, d):
    return faults.counters(faults.faulty(_trace(spark, d), "slow_follower", blocked=(("n1", "n2"),)))


@query(f"SELECT msg_id, false AS dropped, 5 + {_DRAW(3, 45)} AS delay_ms FROM tr", "tr")
def net_reorder(spark, d):
    return faults.faulty(_trace(spark, d), "reorder").select("msg_id", "dropped", "delay_ms")


@query("""SELECT msg_id, src, dst, s.id IS NULL OR d.id IS NULL OR s.iso OR d.iso OR (s.part IS NOT NULL AND coalesce(s.part <> d.part, true)) AS dropped
    FROM (SELECT event_id AS msg_id, printf('n%02d', event_id % 27) AS src, printf('n%02d', (event_id * 7 + 1) % 27) AS dst FROM events) m
    LEFT JOIN n s ON s.id = src LEFT JOIN n d ON d.id = dst WHERE src <> dst""")
def net_transport(spark, d):
    """Messages between nations, two of which don't exist, under isolation and partitions."""
    e = F.col("event_id")
    trace = t.table(spark, d, "events").select(e.alias("msg_id"), F.format_string("n%02d", e % 27).alias("src"), F.format_string("n%02d", (e * 7 + 1) % 27).alias("dst")).filter("src <> dst")
    return faults.transported(trace, _nodes(spark, d)).select("msg_id", "src", "dst", "dropped")


ORACLE["net_transport"] = "WITH n AS (SELECT printf('n%02d', n_nationkey) AS id, n_nationkey % 7 = 3 AS iso, CASE WHEN n_regionkey < 4 THEN n_regionkey END AS part FROM nation)\n" + ORACLE["net_transport"]


_IN = "(ph >= 30 AND ph < 60)"
_SUITE = f"""SELECT scenario, sum(sent)::BIGINT AS sent, sum(dropped)::BIGINT AS dropped, sum(delayed)::BIGINT AS delayed, max(longest) AS longest_ms, count(*) AS rounds,
    count(*) FILTER (held) AS rounds_held, bool_and(held) AS passed FROM (
    SELECT scenario, msg_id // 100 AS round, count(*) AS sent, count(*) FILTER (gone) AS dropped, count(*) FILTER (NOT gone AND delay > 0) AS delayed, max(CASE WHEN gone THEN 0 ELSE delay END) AS longest,
        (count(*) FILTER (NOT gone AND 'n1' IN (src, dst)) > 0)::INT + (count(*) FILTER (NOT gone AND 'n2' IN (src, dst)) > 0)::INT + (count(*) FILTER (NOT gone AND 'n3' IN (src, dst)) > 0)::INT >= 2 AS held
    FROM (SELECT *, CASE scenario WHEN 'packet_loss' THEN {_DRAW(1, 100)} < 25 WHEN 'leader_crash' THEN {_IN} AND 'n1' IN (src, dst) WHEN 'split_brain' THEN {_IN} AND (src = 'n1') <> (dst = 'n1')
            WHEN 'correlated_crash' THEN {_IN} AND 'n2' IN (src, dst) WHEN 'disk_fault' THEN {_IN} AND 'n2' IN (src, dst)
            WHEN 'flapping' THEN ((ph >= 10 AND ph < 16) OR (ph >= 22 AND ph < 28) OR (ph >= 34 AND ph < 40) OR (ph >= 46 AND ph < 52)) AND 'n2' IN (src, dst) ELSE false END AS gone,
        CASE scenario WHEN 'jitter' THEN 30 + {_DRAW(2, 51)} WHEN 'slow_follower' THEN 250 * ((src = 'n3')::INT + (dst = 'n3')::INT) WHEN 'reorder' THEN 5 + {_DRAW(3, 45)} ELSE 0 END AS delay
        FROM (SELECT *, msg_id % 100 AS ph FROM tr), (VALUES ('packet_loss'), ('jitter'), ('slow_follower'), ('leader_crash'), ('split_brain'), ('reorder'), ('correlated_crash'), ('flapping'), ('disk_fault'), ('baseline')) z(scenario))
    GROUP BY 1, 2) GROUP BY 1"""


@query(_SUITE, "tr")
def net_suite(spark, d):
    return faults.suite(_trace(spark, d))


@query("""SELECT count(*) FILTER (ok) AS passed, count(*) AS total, count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS percent, bool_and(ok) AS all_passed
    FROM (SELECT user_id, coalesce(avg(value) > 50, false) AS ok FROM events GROUP BY user_id)""")
def net_summary(spark, d):
    """A scenario per user, over all events."""
    passed = F.coalesce(F.avg("value") > 50, F.lit(False)).alias("passed")
    return faults.summary(t.table(spark, d, "events").groupBy(F.col("user_id").alias("scenario")).agg(passed))


@query("SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_no, l_extendedprice FROM lineitem")
def kv_global_order(spark, d):
    line = t.table(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return numbered(line, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("row_no", "l_extendedprice")
