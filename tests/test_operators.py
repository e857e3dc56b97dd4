from pyspark.sql import functions as F

from palimpsest.functions import metrics
from palimpsest.operators import compact, faults, replog, resolve, runs
from palimpsest.operators.ordered import as_of, numbered
from palimpsest.schema import MUTATION


def log(spark, rows):
    return spark.createDataFrame([(k, s, o, 4 if v is None else 1, v, None, None) for k, s, o, v in rows], MUTATION)


def seen(df):
    return {r["key"]: r["v_long"] for r in df.collect()}


def test_newest_wins_and_snapshots(spark):
    l = log(spark, [("a", 1, 0, 1), ("a", 3, 0, 3), ("b", 2, 0, 2), ("b", 4, 0, None), ("c", 5, 0, 1), ("c", 5, 1, 9)])
    assert seen(resolve.live(l)) == {"a": 3, "c": 9}
    assert seen(resolve.live(l, 2)) == {"a": 1, "b": 2}
    assert seen(resolve.live(l.orderBy(F.desc("seq")))) == {"a": 3, "c": 9}
    keys = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    assert seen(resolve.multi_get(keys, l)) == {"a": 3, "b": None, "x": None}
    assert sorted(r["key"] for r in resolve.exists(keys, l).collect()) == ["a", "b"]
    assert {r["key"]: r["value"] for r in resolve.string_or_empty(keys, l).collect()} == {"a": "3", "b": "", "x": ""}
    assert resolve.live(log(spark, [])).count() == 0


def test_pins_and_tombstones_in_compaction(spark):
    l = log(spark, [("a", 1, 0, 1), ("a", 5, 0, None), ("b", 2, 0, None), ("b", 6, 0, 6)])
    assert seen(resolve.live(compact.merged(l, bottom=True, pins=(3,)), 3)) == seen(resolve.live(l, 3))
    assert seen(resolve.live(compact.merged(l, bottom=True, pins=(3,)))) == {"b": 6}
    assert compact.merged(l, bottom=True).count() == 1
    assert compact.merged(l, bottom=False).count() == 2
    again = compact.merged(compact.merged(l, bottom=True), bottom=True)
    assert seen(again) == {"b": 6}


def test_flush_boundary_counts_live_keys(spark):
    l = log(spark, [("a", 1, 0, 1), ("a", 2, 0, None), ("b", 3, 0, 1), ("c", 4, 0, 1), ("d", 5, 0, 1)]).withColumn("shard", F.lit(0))
    assert [r["table_id"] for r in runs.flush_boundaries(l, 2, "shard").orderBy("seq").collect()] == [0, 0, 0, 0, 1]


def test_global_numbers_and_as_of(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert [(r["x"], r["row_no"]) for r in numbered(df, "x").orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]
    index = spark.createDataFrame([(100, 1), (500, 2)], "first long, off long")
    got = {r["x"]: r["off"] for r in as_of(df, index, "x", "first", ["off"]).collect()}
    assert got == {i: 2 if i >= 500 else 1 for i in range(1000)}


def test_bloom_has_no_false_negatives(spark):
    members = spark.range(500).select(F.concat(F.lit("m"), F.col("id")).alias("key"))
    others = spark.range(2000).select(F.concat(F.lit("o"), F.col("id")).alias("key"))
    m, k = runs.bloom_size(500)
    assert (m, k) == (4793, 7) and runs.bloom_size(0) == runs.bloom_size(1) and runs.bloom_size(10, 2.0) == runs.bloom_size(10)
    bloom = runs.bloom_build(members, m, k)
    assert runs.bloom_probe(members, bloom, m, k).filter("not might_contain").count() == 0
    assert runs.bloom_probe(others, bloom, m, k).filter("might_contain").count() < 100


def test_lru(spark):
    trace = spark.createDataFrame([(0, i, b) for i, b in enumerate("abacb")], "cache_id int, access_no long, block string")
    assert [r["hit"] for r in runs.lru_trace(trace, 2).orderBy("access_no").collect()] == [False, False, True, False, False]


def test_order_statistics_of_small_groups(spark):
    df = spark.createDataFrame([("one", 5.0), *[("two", float(i)) for i in (2, 1)], *[("many", float(i)) for i in range(1000)]], "g string, v double")
    got = {r["g"]: r.asDict() for r in metrics.order_statistics(df, "g", "v").collect()}
    assert got["one"]["p50"] == got["one"]["p999"] == 5 and got["two"]["median"] == 2 and got["two"]["min"] == 1
    assert (got["many"]["p50"], got["many"]["p95"], got["many"]["p999"]) == (500, 950, 999)
    spread = {r["g"]: r["std_dev"] for r in metrics.spread(df, "g", "v").collect()}
    assert spread["one"] == 0 and abs(spread["two"] - 0.5**0.5) < 1e-12


def test_reconcile(spark):
    entry = lambda rows: spark.createDataFrame(rows, "index long, term long")
    out = lambda a, b, *prev: sorted(map(tuple, replog.reconciled(entry(a), entry(b), *prev).collect()))
    local = [(1, 1), (2, 1), (3, 1)]
    assert out(local, [(2, 1), (3, 2), (4, 2)], 1, 1) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert out(local, [(4, 2)], 3, 1) == [*local, (4, 2)]
    assert out(local, [(2, 1)], 1, 1) == local
    assert out([], [(1, 1)], 0, 0) == [(1, 1)] and out(local, [], 3, 1) == local
    # refused: an entry that isn't there, one of another term, entries with a gap or not at their place
    assert out(local, [(10, 2)], 9, 1) == out(local, [(4, 2)], 3, 2) == out(local, [(9, 2), (10, 2)], 3, 1) == out(local, [(4, 2), (6, 2)], 3, 1) == local
    commit = lambda b, prev, term, upto: tuple(replog.follower_commit(entry(local), entry(b), prev, term, upto, committed=2).first())
    assert commit([(4, 2)], 3, 1, 9) == (True, 4, 4) and commit([(4, 2)], 3, 1, 1) == (True, 4, 2) and commit([(6, 2)], 5, 2, 9) == (False, 3, 2)


def test_commit_counts_only_entries_that_agree_with_the_leader(spark):
    entries = [("n1", i, 1 if i <= 5 else 2) for i in range(1, 11)] + [("n2", i, 1) for i in range(1, 9)] + [("n3", i, 1) for i in range(1, 4)]
    log = spark.createDataFrame(entries, "node_id string, index long, term long")
    assert {r["node_id"]: r["match_index"] for r in replog.match_indexes(log, "n1").collect()} == {"n1": 10, "n2": 5, "n3": 3}
    assert replog.commit_index(log, "n1").first()[0] == 0  # a majority has 5, but of an older term
    agreed = log.withColumn("term", F.when((F.col("node_id") == "n2") & F.col("index").isin(6, 7), 2).otherwise(F.col("term")))
    assert replog.commit_index(agreed, "n1").first()[0] == 7 and replog.commit_index(agreed, "n1", n_nodes=5).first()[0] == 0
    assert replog.commit_index(agreed, "n1", committed=9).first()[0] == 9
    trace = {n: [(r["prev_index"], r["success"], r["match_index"]) for r in rows] for n, rows in ((n, replog.replication_trace(agreed, "n1").filter(f"node_id = '{n}'").orderBy("round").collect()) for n in ("n2", "n3"))}
    assert trace["n2"] == [(10, False, 0), (9, False, 0), (8, False, 0), (7, True, 10)] and trace["n3"][-1] == (3, True, 10) and len(trace["n3"]) == 8
    assert {tuple(r) for r in replog.took_office(log, "n1").collect()} == {("n2", 11, 0), ("n3", 11, 0)}


def test_proposals_and_their_outcome(spark):
    asked = spark.createDataFrame([(i, "n1" if i % 2 else "n2") for i in range(1, 601)] + [(601, "n9")], "proposal_no long, node_id string")
    nodes = spark.createDataFrame([("n1", "LEADER"), ("n2", "FOLLOWER")], "node_id string, role string")
    got = {r["proposal_no"]: r for r in replog.proposed(asked, nodes, 40).collect()}
    assert len(got) == 601 and not got[2]["accepted"] and not got[601]["accepted"] and got[2]["index"] is None
    assert [got[i]["index"] for i in (1, 3, 599)] == [41, 42, 340] and [got[i]["batch_no"] for i in (1, 255, 257, 599)] == [0, 0, 1, 2]
    messages = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 5, 4), ("b", 1, 1)], "node_id string, msg_no long, term long")
    assert [(r["current_term"], r["steps_down"]) for r in replog.step_downs(messages).filter("node_id = 'a'").orderBy("msg_no").collect()] == [(3, True), (3, False), (4, True)]
    waiting = spark.createDataFrame([("a", 2, 9), ("a", 6, 10), ("a", 3, 1), ("c", 1, 9)], "node_id string, msg_no long, index long")
    assert {(r["node_id"], r["msg_no"]): r["outcome"] for r in replog.settled(waiting, messages, 5).collect()} == {("a", 2): "failed", ("a", 6): "pending", ("a", 3): "committed", ("c", 1): "pending"}


def test_reads_at_an_index(spark):
    log = spark.createDataFrame([(1, "PUT", "k", 1.0), (3, "delete", "k", None), (5, "put", "k", 5.0), (2, "PUT", "x", 2.0), (4, "READ_BARRIER", "k", None)], "index long, cmd string, key string, v_double double")
    reads = spark.createDataFrame([(i, "k", i) for i in range(7)] + [(10, "x", 1), (11, "x", 9), (12, "none", 9)], "read_no long, key string, at_index long")
    got = {r["read_no"]: r["value"] for r in replog.values_at(reads, log).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: None, 4: None, 5: 5.0, 6: 5.0, 10: None, 11: 2.0, 12: None}
    asked = [(1, "k", "lease", True, True, False, 0), (2, "k", "lease", True, False, True, 0), (3, "k", "lease", True, False, False, 0), (4, "k", "read_index", False, True, True, 0), (5, "k", "barrier", True, True, True, 2), (6, "k", "barrier", True, True, True, 6)]
    asked = spark.createDataFrame(asked, "read_no long, key string, read_mode string, is_leader boolean, in_lease boolean, confirmed boolean, barrier_index long")
    got = {r["read_no"]: (r["served"], r["value"]) for r in replog.linearizable_reads(asked, log, spark.createDataFrame([(5,)], "commit_index long")).collect()}
    assert got == {1: ("lease", 5.0), 2: ("read_index", 5.0), 3: ("error", None), 4: ("error", None), 5: ("barrier", 1.0), 6: ("error", None)}
    assert spark.range(1).select(replog.lease_expiry(F.lit(1000), 150)).first()[0] == 1120


def test_faults(spark):
    trace = spark.range(1000).select(F.col("id").alias("msg_id"), F.lit("n1").alias("src"), F.when(F.col("id") % 2 == 0, "n2").otherwise("n3").alias("dst"))
    lost = faults.faulty(trace, "packet_loss").filter("dropped").count()
    assert 150 < lost < 350
    assert faults.faulty(trace, "baseline", blocked=(("n1", "n2"),)).filter("dropped").count() == 500
    late = faults.faulty(trace, "reorder")
    assert late.agg(F.min("delay_ms"), F.max("delay_ms")).first()[0] >= 5
    assert faults.faulty(trace, "baseline", loss=2.0).filter("not dropped").count() == faults.faulty(trace, "packet_loss", loss=-1.0).filter("dropped").count() == 0
    at = F.col("msg_id") % 100
    for scenario, gone in (("leader_crash", at.between(30, 59)), ("split_brain", at.between(30, 59)), ("disk_fault", at.between(30, 59) & (F.col("dst") == "n2"))):
        assert faults.faulty(trace, scenario).filter(F.col("dropped") != gone).count() == 0
    assert faults.faulty(trace, "flapping").filter("dropped").count() == 10 * 4 * 3
    assert faults.outages("correlated_crash", ("a", "b", "c", "d", "e"), "a") == [("b", faults.DOWN), ("c", faults.DOWN)]
    results = spark.createDataFrame([("a", True), ("b", False)], "scenario string, passed boolean")
    checks = spark.createDataFrame([("k", "n1", "7", True), ("k", "n2", "OFFLINE", True)], "key string, node_id string, value string, consistent boolean")
    text = faults.report(results, checks, spark.createDataFrame([("failover", 12.0, "ms")], "metric string, value double, unit string"))
    assert "1 of 2 passed (50 %): violations found" in text and "| k | n1: 7, n2: OFFLINE | yes |" in text and "| failover | 12.00 | ms |" in text
    runs_of = spark.createDataFrame([("w", 1, 9, 10, 3.0), ("w", 2, 10, 10, 0.0)], "workload string, run_no int, n_ok long, n_total long, service_ms double")
    assert "| w | 19 | 20 | 95.00 % | 3.00 ms |" in metrics.benchmark_report(runs_of, "workload")


def test_terms_timeouts_and_levels(spark):
    seen_terms = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "node_id string, term long")
    assert {r["node_id"]: r["term"] for r in replog.observed_terms(seen_terms).collect()} == {"a": 4, "b": 2}
    waits = [r["timeout_ms"] for r in replog.election_timeouts(seen_terms).collect()]
    assert all(150 <= w <= 300 for w in waits) and waits == [r["timeout_ms"] for r in replog.election_timeouts(seen_terms).collect()]
    manifest = spark.createDataFrame([(1, 0), (2, 1)], "table_id long, level int")
    assert compact.is_bottom(manifest, 1) and not compact.is_bottom(manifest, 0)


def test_ranges_and_guards(spark):
    df = spark.createDataFrame([("a", "m", "n", "z"), (None, "m", "n", "z"), ("a", "b", "c", "d")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(runs.overlap(*map(F.col, "abcd"))).collect()] == [False, True, False]
    one = spark.range(1)
    assert one.select(metrics.ratio(F.lit(5.0), F.lit(0.0)), metrics.success_rate(F.lit(0), F.lit(0)), metrics.merge_throughput(F.lit(1 << 20), F.lit(0))).first()[:] == (1.0, 100.0, 0.0)


def test_empty_logs(spark):
    none = log(spark, [])
    assert resolve.history(none).count() == runs.run_stats(none.withColumn("table_id", F.lit(0))).count() == 0
    assert compact.compacted(none, target=5, bottom=True).count() == 0
    assert runs.interval_lookup(spark.createDataFrame([("k",)], "key string"), runs.run_stats(none.withColumn("table_id", F.lit(0)))).count() == 0
