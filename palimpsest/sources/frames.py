"""Logs of binary frames as a source and a sink; a torn or damaged tail ends a file's log.

A log is a folder of files, one per append, whose names sort in the order of the appends. Frames are encoded in the JVM
and written by Spark's own file writer: an append is one task's commit, so that it is there whole or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.codec import encode_frame, frames
from palimpsest.schema import mutations

SCHEMA = "file string, frame_offset bigint, epoch bigint, key string, value_type smallint, v_long bigint, v_double double, v_string string"
#: What follows the last frame of a file: too short for a frame, so that reading ends there.
END = "\n"


def _rows(name: str, data: bytes) -> list[tuple]:
    out = []
    for at, epoch, key, value in frames(data):
        tag = 4 if value is None else 1 if isinstance(value, int) else 2 if isinstance(value, float) else 3
        out.append((name, at, epoch, str(key), tag, value if tag == 1 else None, value if tag == 2 else None, value if tag == 3 else None))
    return out


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for name, content in zip(batch["path"], batch["content"], strict=True):
            rows = _rows(name, content)
            for start in range(0, len(rows), 100_000):
                yield pd.DataFrame(rows[start : start + 100_000], columns=columns).astype({"v_long": "Int64"})


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All frames of the files below path, up to the first bad one of each file. Files go through Spark's readers."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_decoded, SCHEMA)


def write_blobs(rows: DataFrame, data: Column, order: list, path: str, rows_a_file: int, mode: str = "append") -> None:
    """Write the binary ``data`` of the rows, in order, into files of rows_a_file rows each; the names of an append's
    files sort in that order. A file's rows are one value, so rows_a_file bounds what a task holds at once."""
    from palimpsest.operators.ordered import numbered

    placed = numbered(rows.withColumn("_data", data), *order, out="_no").withColumn("_file", F.floor((F.col("_no") - 1) / rows_a_file))
    whole = placed.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("_no", "_data"))).alias("_all"))
    # the sink writes a string's bytes as they are
    text = F.unhex(F.array_join(F.transform("_all", lambda x: F.hex(x["_data"])), "")).cast("string")
    sink = whole.repartitionByRange("_file").sortWithinPartitions("_file").select(text.alias("value")).write.mode(mode)
    sink.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def append_frames(log: DataFrame, path: str, epoch: int, rows_a_file: int = 4096) -> str:
    """Append a batch of mutations to the log below path, all with one epoch, in order of (seq, op_index); returns the
    folder written. An empty batch writes nothing. Folders sort by number, and a number is taken once."""
    log = mutations(log)
    if log.isEmpty():
        return ""
    spark = log.sparkSession
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    folder = f"{path.rstrip('/')}/{max((int(n) for n in names if n.isdigit()), default=0) + 1:012d}"
    frame = encode_frame(F.lit(epoch).cast("bigint"), "key", "value_type", "v_long", "v_double", "v_string")
    write_blobs(log, frame, ["seq", "op_index"], folder, rows_a_file, mode="error")
    return folder


def truncate_frames(spark: SparkSession, path: str) -> None:
    """Empty the log, as after a flush of what it holds."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class FrameSource(DataSource):
    """spark.dataSource.register(FrameSource); spark.read.format("frames").option("paths", "a,b").load()

    Paths are files of a file system that every executor mounts; other stores are read by read_frames."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options.get("paths", "").split(",") if p]
        for p in paths:
            if "://" in p and not p.startswith("file://"):
                raise ValueError(f"{p}: use read_frames for paths of other stores")
        return _FrameReader(paths)


class _FrameReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value.removeprefix("file://"), "rb") as f:
            yield from _rows(partition.value, f.read())


def last_write(log: DataFrame) -> DataFrame:
    """Live keys of an append-only store: the last frame of a key by its place in the log, unless it deletes."""
    columns = ("frame_offset", "epoch", "value_type", "v_long", "v_double", "v_string")
    best = log.groupBy("file", "key").agg(F.max_by(F.struct(*columns), "frame_offset").alias("v"))
    return best.select("file", "key", "v.*").filter("value_type <> 4")


def key_directory(log: DataFrame) -> DataFrame:
    """The same over all files of a log, in order of their names: key, file, frame_offset, epoch and value."""
    columns = ("file", "frame_offset", "epoch", "value_type", "v_long", "v_double", "v_string")
    best = log.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("file", "frame_offset")).alias("v"))
    return best.select("key", "v.*").filter("value_type <> 4")
