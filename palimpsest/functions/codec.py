"""The binary frame of a record, and 32-bit Murmur3 for bloom filters.

A frame is crc32, epoch, key size, value size (4 bytes each), key type, value type (2 bytes each), key and value, all
little-endian; the checksum covers everything after itself. Integers are 8 bytes, floats IEEE 754 doubles, strings UTF-8,
tombstones empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from palimpsest.schema import FLOAT, INTEGER, STRING, TOMBSTONE

HEAD = struct.Struct("<IIIhh")
CRC = struct.Struct("<I")
OVERHEAD = CRC.size + HEAD.size


def pack(value) -> tuple[int, bytes]:
    """Type tag and bytes of a value; None is a tombstone, other types than int, float and str are refused."""
    if value is None:
        return TOMBSTONE, b""
    if isinstance(value, bool):
        raise TypeError("booleans can't be stored")
    if isinstance(value, (int, np.integer)):
        return INTEGER, struct.pack("<q", value)
    if isinstance(value, (float, np.floating)):
        return FLOAT, struct.pack("<d", value)
    if isinstance(value, str):
        return STRING, value.encode()
    raise TypeError(f"{type(value).__name__} can't be stored")


def unpack(tag: int, data: bytes):
    if tag == INTEGER:
        return struct.unpack("<q", data)[0]
    if tag == FLOAT:
        return struct.unpack("<d", data)[0]
    if tag == STRING:
        return data.decode()
    if tag == TOMBSTONE:
        return None
    raise ValueError(f"unknown type {tag}")


def encode(epoch: int, key, value) -> bytes:
    (kt, k), (vt, v) = pack(key), pack(value)
    body = HEAD.pack(epoch & 0xFFFFFFFF, len(k), len(v), kt, vt) + k + v
    return CRC.pack(zlib.crc32(body)) + body


def decode(data: bytes, at: int = 0):
    """(epoch, key, value, size) of the frame at ``at``, or None if it is cut off or damaged."""
    if len(data) - at < OVERHEAD:
        return None
    (crc,) = CRC.unpack_from(data, at)
    epoch, nk, nv, kt, vt = HEAD.unpack_from(data, at + CRC.size)
    end = at + OVERHEAD + nk + nv
    if end > len(data) or zlib.crc32(data[at + CRC.size : end]) != crc:
        return None
    k = at + OVERHEAD
    return epoch, unpack(kt, data[k : k + nk]), unpack(vt, data[k + nk : end]), end - at


def frames(data: bytes) -> Iterator[tuple]:
    """(offset, epoch, key, value) up to the end or the first bad frame, where a torn tail begins."""
    at = 0
    while (found := decode(data, at)) is not None:
        yield at, *found[:3]
        at += found[3]


def value_bytes() -> Column:
    """Encoded size of the value columns."""
    tag = F.col("value_type")
    return F.when(tag.isin(INTEGER, FLOAT), 8).when(tag == STRING, F.octet_length("v_string")).otherwise(0)


def frame_size() -> Column:
    return F.lit(OVERHEAD) + F.octet_length("key") + value_bytes()


def epoch32(seq: Column) -> Column:
    """The sequence as a header holds it: its low 32 bits, unsigned."""
    return seq.bitwiseAND(F.lit(0xFFFFFFFF))


def little_endian(x: Column, size: int) -> Column:
    """The low ``size`` bytes of an integer, least first."""
    digits = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size))))


@F.pandas_udf(LongType())
def double_bits(x: pd.Series) -> pd.Series:
    """The bits of doubles as integers; null stays null."""
    bits = pd.Series(x.to_numpy(dtype=np.float64).view(np.int64)).astype("Int64")
    return bits.mask(x.isna().to_numpy())


def frame_body(epoch, key, value_type, v_long, v_double, v_string) -> Column:
    """What a frame's checksum covers: the header after it, key and value."""
    col = lambda c: c if isinstance(c, Column) else F.col(c)
    tag, key = col(value_type), F.encode(col(key), "UTF-8")
    value = F.when(tag == INTEGER, little_endian(col(v_long), 8)).when(tag == FLOAT, little_endian(double_bits(col(v_double)), 8))
    value = value.when(tag == STRING, F.encode(col(v_string), "UTF-8")).otherwise(F.unhex(F.lit("")))
    head = [little_endian(epoch32(col(epoch)), 4), little_endian(F.octet_length(key), 4), little_endian(F.octet_length(value), 4), little_endian(F.lit(STRING), 2), little_endian(tag, 2)]
    return F.concat(*head, key, value)


def encode_frame(epoch, key, value_type, v_long, v_double, v_string) -> Column:
    """The frame of a row, from its epoch, key and value columns. Built in the JVM, but for the bits of doubles."""
    body = frame_body(epoch, key, value_type, v_long, v_double, v_string)
    return F.concat(little_endian(F.crc32(body), 4), body)


def is_intact(frame: Column) -> Column:
    """Whether a frame's checksum is that of what follows it."""
    digits = F.hex(F.substring(frame, 1, 4))
    stored = F.conv(F.concat(*(F.substring(digits, 7 - 2 * k, 2) for k in range(4))), 16, 10).cast("bigint")
    return F.crc32(F.substring(frame, 5, 2**31 - 1)) == stored


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The x86 32-bit variant of the public MurmurHash3, as a signed integer."""
    mask, c1, c2 = 0xFFFFFFFF, 0xCC9E2D51, 0x1B873593
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    h, whole = seed & mask, len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (turn(h ^ turn(k * c1 & mask, 15) * c2 & mask, 13) * 5 + 0xE6546B64) & mask
    if tail := data[whole:]:
        h ^= turn(int.from_bytes(tail, "little") * c1 & mask, 15) * c2 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_all(keys: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """murmur3_32 of every key with its own seed, by array operations over keys of about the same length."""
    size = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    out = seeds.astype(np.int64).astype(np.uint32)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    turn = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    classes = np.ceil(np.log2(size + 1)).astype(int)
    for c in np.unique(classes):
        at = np.flatnonzero(classes == c)
        n, wide = size[at], -(-int(size[at].max()) // 4) * 4 + 4
        raw = np.frombuffer(b"".join(keys[i].ljust(wide, b"\0") for i in at.tolist()), dtype="<u4").reshape(len(at), -1)
        h, whole = out[at], n // 4
        for j in range(int(whole.max(initial=0)) + 1):
            k = turn(raw[:, j] * c1, 15) * c2
            h = np.where(j < whole, turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where((j == whole) & (n % 4 > 0), h ^ k, h))
        h = h ^ n.astype(np.uint32)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out[at] = h ^ h >> np.uint32(16)
    return out.view(np.int32)


def murmur3_pair(column: str) -> Column:
    """Two hashes of a key, the second seeded with the first."""

    @F.pandas_udf("array<int>")
    def of(keys: pd.Series) -> pd.Series:
        raw = [k.encode() for k in keys]
        first = murmur3_all(raw, np.zeros(len(raw), dtype=np.int32))
        return pd.Series(list(np.stack([first, murmur3_all(raw, first)], axis=1)))

    return of(column)
