import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from palimpsest.functions import codec
from palimpsest.sources.frames import last_write, read_frames

VALUES = st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text())


@given(st.integers(0, 2**40), st.text(min_size=1), VALUES)
def test_round_trip(epoch, key, value):
    data = codec.encode(epoch, key, value)
    assert codec.decode(data) == (epoch & 0xFFFFFFFF, key, value, len(data))
    assert struct.unpack("<I", data[:4])[0] == zlib.crc32(data[4:])


def test_torn_tail_at_every_byte():
    whole = [codec.encode(1, k, v) for k, v in (("a", 1), ("b", "two"), ("c", None))]
    data = b"".join(whole)
    for cut in range(len(data) + 1):
        ends = [sum(map(len, whole[: i + 1])) for i in range(3)]
        assert len(list(codec.frames(data[:cut]))) == sum(e <= cut for e in ends)
    assert list(codec.frames(data[:10] + b"\xff" + data[11:])) == []


def test_unsupported_values():
    for bad in (True, b"x", [1]):
        with pytest.raises(TypeError):
            codec.pack(bad)
    with pytest.raises(ValueError):
        codec.unpack(9, b"")


def test_murmur3_of_published_vectors():
    for data, seed, want in ((b"", 0, 0), (b"", 1, 0x514E28B7), (b"test", 0, 0xBA6BD213), (b"Hello, world!", 0x9747B28C, 0x24884CBA)):
        assert codec.murmur3_32(data, seed) & 0xFFFFFFFF == want


def test_frame_files(spark, tmp_path):
    data = [codec.encode(i, k, v) for i, (k, v) in enumerate((("greeting", "hello"), ("n", 42), ("pi", 3.14159), ("n", None)))]
    (tmp_path / "a.wal").write_bytes(b"".join(data) + data[0][:7])
    (tmp_path / "b.wal").write_bytes(b"")
    log = read_frames(spark, str(tmp_path))
    assert log.count() == 4
    alive = {r["key"]: (r["v_long"], r["v_double"], r["v_string"]) for r in last_write(log).collect()}
    assert alive == {"greeting": (None, None, "hello"), "pi": (None, 3.14159, None)}


def test_frame_source(spark, tmp_path):
    from palimpsest.sources.frames import FrameSource

    (tmp_path / "a.wal").write_bytes(codec.encode(1, "k", "v"))
    spark.dataSource.register(FrameSource)
    rows = spark.read.format("frames").option("paths", str(tmp_path / "a.wal")).load().collect()
    assert [(r["key"], r["v_string"]) for r in rows] == [("k", "v")]
