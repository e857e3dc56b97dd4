"""Frame logs and replicated-log files: sinks, round trips, torn tails, rewrites and the node's term and vote."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.schema import MUTATION
from palimpsest.sources import frames, replicated


def log(spark, rows):
    """rows of (key, value): the value's type decides its column."""
    out = []
    for i, (k, v) in enumerate(rows):
        tag = 4 if v is None else 1 if isinstance(v, int) else 2 if isinstance(v, float) else 3
        out.append((k, i, 0, tag, v if tag == 1 else None, v if tag == 2 else None, v if tag == 3 else None))
    return spark.createDataFrame(out, MUTATION)


ROWS = [("a", 1), ("b", -5), ("ключ", "wert ü\x00"), ("a", None), ("c", 2.5), ("d", float("-inf")), ("e", ""), ("b", 2**62), ("", "empty key"), ("f", -0.0)]


def test_frames_built_in_the_engine_are_those_of_the_format(spark):
    got = log(spark, ROWS).select("seq", codec.encode_frame(F.lit(2**32 + 7).cast("bigint"), "key", "value_type", "v_long", "v_double", "v_string").alias("f")).orderBy("seq").collect()
    assert [bytes(r["f"]) for r in got] == [codec.encode(7, k, v) for k, v in ROWS]
    frame = log(spark, ROWS).select(codec.encode_frame("seq", "key", "value_type", "v_long", "v_double", "v_string").alias("f"))
    whole = F.col("f")
    damaged = F.concat(F.expr("substring(f, 1, 21)"), F.unhex(F.lit("7f")), F.expr("substring(f, 23)"))
    assert [tuple(r) for r in frame.filter(F.octet_length("f") > 30).select(codec.is_intact(whole), codec.is_intact(damaged)).distinct().collect()] == [(True, False)]


def test_append_read_and_last_write(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert frames.append_frames(log(spark, []), path, 1) == ""
    for epoch, part in enumerate((ROWS[:4], ROWS[4:])):
        frames.append_frames(log(spark, part), path, epoch, rows_a_file=3)
    got = frames.read_frames(spark, f"{path}/*")
    rows = [(r["key"], next((v for v in (r["v_long"], r["v_double"], r["v_string"]) if v is not None), None), r["epoch"]) for r in got.orderBy("file", "frame_offset").collect()]
    assert rows == [(k, v, 0 if i < 4 else 1) for i, (k, v) in enumerate(ROWS)]
    live = {r["key"]: r["value_type"] for r in frames.key_directory(got).collect()}
    assert live == {"b": 1, "ключ": 3, "c": 2, "d": 2, "e": 3, "": 3, "f": 2}
    frames.truncate_frames(spark, path)
    assert frames.append_frames(log(spark, ROWS[:1]), path, 5).endswith("000000000001")


def test_recovery_at_every_torn_byte(spark, tmp_path):
    data = b"".join(codec.encode(1, k, v) for k, v in ROWS)
    ends = [0]
    for k, v in ROWS:
        ends.append(ends[-1] + len(codec.encode(1, k, v)))
    for cut in range(len(data) + 1):
        assert [(k, v) for _, _, k, v in codec.frames(data[:cut])] == ROWS[: sum(e <= cut for e in ends) - 1]
    (tmp_path / "torn").write_bytes(data[: ends[5] + 7])
    assert frames.read_frames(spark, f"file://{tmp_path}/torn").count() == 5
    with pytest.raises(ValueError, match="read_frames"):
        frames.FrameSource({"paths": "hdfs://x/y"}).reader(None)


ENTRIES = [(1, 1, "PUT", "k", "v"), (1, 2, "DELETE", "k", None), (2, 3, "READ_BARRIER", None, None), (2, 4, "", "ü\x00🙂", "w\x00 ü 🙂"), (3, 5, "PUT", "b", b"\x00\xff")]


def test_entries_round_trip_and_every_torn_byte():
    parts = [replicated.encode_entry(*e) for e in ENTRIES]
    data = b"".join(parts)
    assert [x[1:] for x in replicated.decode_entries(data)] == ENTRIES
    ends = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    for cut in range(len(data)):
        assert [x[1:] for x in replicated.decode_entries(data[:cut])] == ENTRIES[: sum(e <= cut for e in ends) - 1]
    assert list(replicated.decode_entries(b"\x54" + data)) == [] and list(replicated.decode_entries(b"\x53\x7f\xff\xff\xff")) == []
    # the first record's bytes by hand: magic, length, term, index, command, key and value with their lengths
    assert parts[0] == bytes.fromhex("53 0000001d 0000000000000001 0000000000000001 0003 505554 01 0001 6b 01 0001 76".replace(" ", ""))
    with pytest.raises(ValueError, match="64 MiB"):
        replicated.encode_entry(1, 1, "PUT", "k", b"\x00" * (64 << 20))
    with pytest.raises(ValueError, match="65535"):
        replicated.encode_entry(1, 1, "PUT", "k" * 70_000, None)


def test_log_files_append_conflict_and_rewrite(spark, tmp_path):
    path, kinds = f"file://{tmp_path}/raft", "term long, index long, cmd string, key string, value string"
    replicated.append_log(spark.createDataFrame([(1, i, "PUT", f"k{i}", str(i)) for i in range(1, 8)], kinds), path, rows_a_file=3)
    replicated.append_log(spark.createDataFrame([], kinds), path)
    replicated.append_log(spark.createDataFrame([(2, i, "PUT", f"n{i}", None) for i in range(6, 9)], kinds), path)
    now = replicated.current_log(replicated.read_log(spark, path))
    assert [(r["index"], r["term"], r["key"], r["value"]) for r in now.orderBy("index").collect()] == [(i, 1, f"k{i}", str(i)) for i in range(1, 6)] + [(i, 2, f"n{i}", None) for i in range(6, 9)]
    replicated.rewrite_log(now.filter("index < 7"), path)
    assert sorted(r["index"] for r in replicated.read_log(spark, path).collect()) == list(range(1, 7))


def test_term_and_vote(spark, tmp_path):
    path = f"file://{tmp_path}/meta"
    assert replicated.load_meta(spark, path) == (0, None)
    replicated.save_meta(spark, path, 4, "n2")
    assert replicated.load_meta(spark, path) == (4, "n2")
    replicated.save_meta(spark, path, 5, None)
    assert replicated.load_meta(spark, path) == (5, None)
    (tmp_path / "bad").write_bytes(b"{torn")
    assert replicated.load_meta(spark, f"file://{tmp_path}/bad") == (0, None)


def test_murmur_of_many_keys_is_that_of_one():
    rng = random.Random(3)
    keys = [rng.randbytes(n) for n in [*range(40), 1000, 4096, 4097]] * 2
    import numpy as np

    seeds = np.array([rng.randrange(-(2**31), 2**31) for _ in keys], dtype=np.int32)
    assert codec.murmur3_all(keys, seeds).tolist() == [codec.murmur3_32(k, int(s)) for k, s in zip(keys, seeds, strict=True)]
    assert codec.murmur3_all([], np.zeros(0, dtype=np.int32)).tolist() == [] and zlib.crc32(b"") == 0
