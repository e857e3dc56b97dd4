"""Files of replicated logs: framed entries, their append and rewrite, and the node's term and vote.

A record is a magic byte, its length (4 bytes) and the payload: term and index (8 bytes each), command, a flag and the key
if there is one, then the kind of value and the value; big-endian, strings as their length in 2 bytes and modified UTF-8.
Fixed values of the format. A torn or damaged tail ends a file's log.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.files import read_file, write_file
from palimpsest.sources.frames import write_blobs

MAGIC, MOST_BYTES = 0x53, 64 << 20
NONE, TEXT, BYTES = 0, 1, 2
SCHEMA = "file string, record_offset bigint, term bigint, index bigint, cmd string, key string, value string, value_bytes binary"


def _pack(text: str) -> bytes:
    """Modified UTF-8 with its length: NUL is two bytes, and characters beyond the first plane are surrogates of three."""
    units = text.encode("utf-16-be", "surrogatepass")
    out = b""
    for (u,) in struct.iter_unpack(">H", units):
        out += bytes([u]) if 0 < u < 0x80 else bytes([0xC0 | u >> 6, 0x80 | u & 0x3F]) if u < 0x800 else bytes([0xE0 | u >> 12, 0x80 | u >> 6 & 0x3F, 0x80 | u & 0x3F])
    if len(out) > 0xFFFF:
        raise ValueError("strings of a record hold 65535 bytes at most")
    return struct.pack(">H", len(out)) + out


class _Payload:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the record is too short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str):
        return struct.unpack(f">{kind}", self.take(struct.calcsize(f">{kind}")))[0]

    def text(self) -> str:
        raw, units, at = self.take(self.number("H")), bytearray(), 0
        while at < len(raw):
            n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3
            part = raw[at : at + n]
            u = part[0] if n == 1 else (part[0] & 0x1F) << 6 | part[1] & 0x3F if n == 2 else (part[0] & 0xF) << 12 | (part[1] & 0x3F) << 6 | part[2] & 0x3F
            units += struct.pack(">H", u)
            at += n
        return units.decode("utf-16-be", "surrogatepass")


def encode_entry(term: int, index: int, cmd: str | None, key: str | None, value: str | bytes | None) -> bytes:
    body = struct.pack(">qq", term, index) + _pack(cmd or "") + (b"\x00" if key is None else b"\x01" + _pack(key))
    if value is None:
        body += bytes([NONE])
    elif isinstance(value, str):
        body += bytes([TEXT]) + _pack(value)
    else:
        body += bytes([BYTES]) + struct.pack(">i", len(value)) + value
    if len(body) > MOST_BYTES:
        raise ValueError("a record holds 64 MiB at most")
    return struct.pack(">Bi", MAGIC, len(body)) + body


def decode_entries(data: bytes) -> Iterator[tuple]:
    """(offset, term, index, cmd, key, value) up to the end or the first bad record."""
    at = 0
    while at + 5 <= len(data):
        magic, length = struct.unpack_from(">Bi", data, at)
        if magic != MAGIC or not 0 <= length <= MOST_BYTES or at + 5 + length > len(data):
            return
        body = _Payload(data[at + 5 : at + 5 + length])
        try:
            term, index, cmd = body.number("q"), body.number("q"), body.text()
            key = body.text() if body.number("b") else None
            kind = body.number("b")
            value = body.text() if kind == TEXT else body.take(body.number("i")) if kind == BYTES else None
        except (ValueError, IndexError, struct.error, UnicodeDecodeError):
            return
        yield at, term, index, cmd, key, value
        at += 5 + length


def encoded() -> Column:
    """The record of a row with term, index, cmd, key and value (a string or null)."""

    @F.pandas_udf("binary")
    def of(term: pd.Series, index: pd.Series, cmd: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([encode_entry(int(t), int(i), c, k, v) for t, i, c, k, v in zip(term, index, cmd, key, value, strict=True)])

    return of("term", "index", "cmd", "key", "value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the files below path, up to the first bad record of each."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, at, t, i, c, k, v if isinstance(v, str) else None, v if isinstance(v, bytes) else None) for at, t, i, c, k, v in decode_entries(content)]
                for start in range(0, len(rows), 100_000):
                    yield pd.DataFrame(rows[start : start + 100_000], columns=columns)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def append_log(entries: DataFrame, path: str, rows_a_file: int = 4096) -> None:
    """Append entries (term, index, cmd, key, value) in order of their index: all of them are there, or none."""
    if not entries.isEmpty():
        write_blobs(entries.withColumn("value", F.col("value").cast("string")), encoded(), ["index"], path, rows_a_file)


def rewrite_log(entries: DataFrame, path: str, rows_a_file: int = 4096) -> None:
    """Replace the log, as after entries at its end were cut. The new one is written whole before the old one goes."""
    spark = entries.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    held, target = fs_path(f"{path.rstrip('/')}.rewrite"), fs_path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(held, True)
    write_blobs(entries.withColumn("value", F.col("value").cast("string")), encoded(), ["index"], held.toString(), rows_a_file, mode="overwrite")
    fs.delete(target, True)
    if not fs.rename(held, target):
        raise OSError(f"can't replace {path}")


def current_log(log: DataFrame) -> DataFrame:
    """One entry per index: what was appended last (by file and place), as entries of a later term replace others."""
    rest = [c for c in log.columns if c != "index"]
    return log.groupBy("index").agg(F.max_by(F.struct(*rest), F.struct("term", "file", "record_offset")).alias("v")).select("index", "v.*")


def save_meta(spark: SparkSession, path: str, term: int, voted_for: str | None) -> None:
    write_file(spark, path, json.dumps({"term": term, "voted_for": voted_for}).encode())


def load_meta(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Term and vote of a node; (0, None) for a new one or where the file is damaged."""
    try:
        found = json.loads(read_file(spark, path) or b"{}")
        return int(found.get("term", 0)), found.get("voted_for")
    except (ValueError, AttributeError):
        return 0, None
