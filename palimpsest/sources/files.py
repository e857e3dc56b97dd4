"""Small files through the Hadoop file system, so that any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file whole: under a name of its own first, then in place of what was there."""
    fs, target = _place(spark, path)
    held = _place(spark, f"{path}.part")[1]
    out = fs.create(held, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(target, False)
    if not fs.rename(held, target):
        raise OSError(f"can't write {path}")


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """A small file's content, or None where there is none."""
    fs, target = _place(spark, path)
    if not fs.exists(target):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
