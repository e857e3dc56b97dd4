import random

import pytest

from palimpsest.operators.store import KVStore


def test_batches_snapshots_and_reopening(spark, tmp_path):
    s = KVStore(spark, f"file://{tmp_path}/db", flush_threshold=100)
    s.write([("acc_A", 1000), ("acc_B", 500)])
    at = s.snapshot()
    s.write([("acc_A", 800), ("acc_B", 700), ("acc_NEW", "x"), ("acc_NEW", 9999)])
    assert (s.get("acc_A", at), s.get("acc_B", at), s.get("acc_NEW", at)) == (1000, 500, None)
    s.delete("acc_B")
    assert (s.get("acc_A"), s.get("acc_B"), s.get("acc_NEW")) == (800, None, 9999)
    seq = s.manifest["seq"]
    assert s.write([]) == seq and s.write([("k", 1.5)], batch_id="x") == seq + 1 and s.write([("k", 2.5)], batch_id="x") == seq + 1
    with pytest.raises(TypeError):
        s.write([("ok", 1), ("bad", b"bytes")])
    assert s.manifest["seq"] == seq + 1
    again = KVStore(spark, f"file://{tmp_path}/db")
    assert again.get("acc_A") == 800 and again.get("k") == 1.5 and again.size() == 3
    assert again.locate("acc_A") == "buffer" and again.locate("none") == "none"


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    a, b = (KVStore(spark, f"file://{tmp_path}/db") for _ in range(2))
    a.put("k", 1)
    with pytest.raises(RuntimeError):
        b.put("k", 2)
    assert KVStore(spark, f"file://{tmp_path}/db").get("k") == 1


def test_flush_and_compaction_change_no_answer(spark, tmp_path):
    rng, model, s = random.Random(4), {}, KVStore(spark, f"file://{tmp_path}/db", flush_threshold=6, target_entries=5)
    pinned = None
    for step in range(12):
        batch = [(f"k{rng.randrange(14):02d}", None if rng.random() < 0.3 else rng.randrange(1000)) for _ in range(4)]
        s.write(batch)
        model.update(batch)
        if step == 4:
            pinned = (s.snapshot("hold"), {k: v for k, v in model.items() if v is not None})
        if step % 3 == 2:
            s.flush()
    want = {k: v for k, v in model.items() if v is not None}
    read = lambda at=None: {r["key"]: r["v_long"] for r in s.scan(at).collect()}
    assert read() == want and read(pinned[0]) == pinned[1]
    assert any(r["level"] > 0 for r in s.manifest["runs"])
    assert [r["key"] for r in s.keys().collect()] == sorted(want)
    s.vacuum()
    assert read() == want and KVStore(spark, f"file://{tmp_path}/db").size() == len(want)
    assert s.amplification()["waf"] >= 1


def test_tombstones_alone_can_be_flushed(spark, tmp_path):
    s = KVStore(spark, f"file://{tmp_path}/db", flush_threshold=100)
    s.write([(f"k{i}", None) for i in range(5)])
    s.flush()
    assert s.manifest["log"] == [] and s.size() == 0 and s.locate("k1") == "level 0 (sst_00000)"


def test_stream_into_store(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.schema import tagged
    from palimpsest.streaming.ingest import into_store, running_state

    source = tmp_path / "in"
    log = spark.range(20).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").alias("seq"), F.lit(0).alias("op_index"), *tagged(v_long=F.when(F.col("id") % 5 != 0, F.col("id"))))
    log.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(log.schema).parquet(str(source))
    s = KVStore(spark, f"file://{tmp_path}/db")
    into_store(stream, s, str(tmp_path / "cp")).awaitTermination()
    want = {f"k{i % 7}": i for i in range(20)}
    want = {k: v for k, v in want.items() if v % 5}
    assert {r["key"]: r["v_long"] for r in s.scan().collect()} == want
    q = running_state(stream).writeStream.outputMode("complete").format("memory").queryName("state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM state WHERE value_type <> 4").count() == len(want)


def test_streaming_flush_boundaries_agree_with_the_batch_fold(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.operators.runs import flush_boundaries as batch
    from palimpsest.schema import MUTATION
    from palimpsest.streaming.ingest import flush_boundaries

    rng = random.Random(8)
    rows = [(f"k{rng.randrange(9)}", i, 0, 4 if rng.random() < 0.3 else 1, 1, None, None) for i in range(60)]
    log = spark.createDataFrame(rows, MUTATION).withColumn("shard", F.lit(0))
    source = str(tmp_path / "in")
    for lo in (0, 25, 40):  # three micro-batches
        log.filter(F.col("seq").between(lo, {0: 24, 25: 39, 40: 59}[lo])).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = flush_boundaries(stream, 4).writeStream.format("memory").queryName("bounds").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r["seq"]: r["table_id"] for r in batch(log, 4, "shard").collect()}
    assert {r["seq"]: r["table_id"] for r in spark.sql("SELECT * FROM bounds").collect()} == want and max(want.values()) > 2


def _mutations(spark, source, n, tag):
    from pyspark.sql import functions as F

    from palimpsest.schema import tagged

    log = spark.range(n).select(F.concat(F.lit(tag), F.col("id") % 5).alias("key"), F.col("id").alias("seq"), F.lit(0).alias("op_index"), *tagged(v_long=F.col("id")))
    log.coalesce(1).write.parquet(str(source))
    return spark.readStream.schema(log.schema).parquet(str(source))


def test_two_streams_and_a_restart_into_one_store(spark, tmp_path):
    from palimpsest.streaming.ingest import into_store

    s = KVStore(spark, f"file://{tmp_path}/db")
    first, second = _mutations(spark, tmp_path / "a", 10, "a"), _mutations(spark, tmp_path / "b", 10, "b")
    into_store(first, s, str(tmp_path / "cp-a")).awaitTermination()
    into_store(second, s, str(tmp_path / "cp-b")).awaitTermination()
    want = {f"{t}{i}": 5 + i for t in "ab" for i in range(5)}
    assert {r["key"]: r["v_long"] for r in s.scan().collect()} == want
    seq = s.manifest["seq"]
    into_store(first, s, str(tmp_path / "cp-a")).awaitTermination()  # nothing new
    assert s.manifest["seq"] == seq
    (name, number), *_ = s.manifest["streams"].items()
    assert s.write([("a0", -1)], stream=name, number=number) == seq and s.get("a0") == 5  # a batch that is run again
    into_store(first, s, str(tmp_path / "cp-new")).awaitTermination()  # a new checkpoint is a stream of its own
    assert len(s.manifest["streams"]) == 3 and s.manifest["seq"] == seq + 1


def test_batch_names_are_never_forgotten(spark, tmp_path, monkeypatch):
    from palimpsest.operators import store

    monkeypatch.setattr(store, "BATCHES", 2)
    s = KVStore(spark, f"file://{tmp_path}/db")
    for k in range(4):
        s.write([("k", k)], batch_id=f"b{k}")
    again = KVStore(spark, f"file://{tmp_path}/db")
    assert again.manifest["batch_files"] and again.write([("k", 100)], batch_id="b0") == again.write([("k", 100)], batch_id="b3") == 4 and again.get("k") == 3


def test_rows_without_an_order_are_refused(spark, tmp_path):
    from palimpsest.schema import tagged
    from pyspark.sql import functions as F

    s = KVStore(spark, f"file://{tmp_path}/db")
    rows = spark.createDataFrame([("a", 1)], "key string, x long").select("key", *tagged(v_long=F.col("x")))
    with pytest.raises(ValueError, match="op_index or seq"):
        s.write(rows)
    assert s.manifest["seq"] == 0


def test_deletes_do_not_flush_unless_operations_count(spark, tmp_path):
    s = KVStore(spark, f"file://{tmp_path}/a", flush_threshold=3)
    s.write([(f"k{i}", None) for i in range(5)])
    assert s.manifest["runs"] == [] and s.buffer_size() == 0
    s.write([(f"v{i}", 1) for i in range(3)])
    assert len(s.manifest["runs"]) == 1 and s.manifest["log"] == []
    t = KVStore(spark, f"file://{tmp_path}/b", flush_threshold=3, most_operations=4)
    t.write([(f"k{i}", None) for i in range(5)])
    assert len(t.manifest["runs"]) == 1


def test_levels_runs_blocks_and_counters(spark, tmp_path):
    s = KVStore(spark, f"file://{tmp_path}/db", flush_threshold=100, target_entries=4)
    for step in range(5):
        s.write([(f"k{i:02d}", 100 * step + i) for i in range(step, step + 6)] + [("gone", None if step == 4 else step)])
        s.flush()
    levels = {r["level"] for r in s.manifest["runs"]}
    assert levels == {0, 1} and s.counters()["compactions"] == 1 and s.counters()["merge_ms"] >= 1 and not s.counters()["writers_wait"]
    assert s.get_from_level(0, "k05") == (True, 405) and s.get_from_level(1, "k05") == (True, 305) and s.get_from_level(1, "none") == (False, None)
    assert s.get_from_level(0, "gone") == (True, None) and s.get("gone") is None and s.get_from_level(1, "k05", snapshot=1) == (False, None)
    top = next(r for r in s.manifest["runs"] if r["level"] == 0)
    assert s.get_from_run(top["table_id"], "k04") == (True, 404) and s.get_from_run(top["table_id"], "zzz") == (False, None) and s.get_from_run(top["table_id"], "k04", snapshot=1) == (False, None)
    assert s.locate("k00").startswith("level 1") and s.locate("k04") == f"level 0 (sst_{top['table_id']:05d})"
    assert sorted((r["level"], r["key"]) for r in s.runs(key="k04").filter("key = 'k04'").collect()) == [(0, "k04"), (1, "k04")]
    keys = spark.createDataFrame([("k04",), ("a",)], "key string")
    assert {r["key"]: r["file_offset"] for r in s.blocks(top["table_id"], keys).collect()} == {"k04": 0, "a": 0}
    s.vacuum()
    assert KVStore(spark, f"file://{tmp_path}/db").get("k05") == 405 and s.blocks(top["table_id"], keys).count() == 2
