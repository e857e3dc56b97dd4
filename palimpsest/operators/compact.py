"""Leveled compaction: overlap, merge, tombstone removal and the choice of what to compact next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.resolve import newest
from palimpsest.operators.runs import chunked
from palimpsest.schema import is_tombstone

#: Fixed values of the level policy: runs that trigger a compaction, runs from which writers wait, number of levels.
TRIGGER, BACKPRESSURE, LEVELS = 4, 8, 7


def merged(*inputs: DataFrame, bottom: bool, pins: tuple[int, ...] = ()) -> DataFrame:
    """The inputs' entries with one version per key and, for every pinned snapshot, the version it sees.

    Tombstones go only where the output is bottom-most and no pin could still see what they hide.
    """
    log = inputs[0]
    for more in inputs[1:]:
        log = log.unionByName(more)
    out = newest(log)
    for pin in pins:
        out = out.unionByName(newest(log, pin))
    if pins:
        out = out.distinct()
    if not bottom:
        return out
    if not pins:
        return out.filter(~is_tombstone())
    oldest = min(pins)
    return out.filter(~(is_tombstone() & (F.col("seq") <= oldest)))


def compacted(*inputs: DataFrame, target: int, bottom: bool, pins: tuple[int, ...] = ()) -> DataFrame:
    return chunked(merged(*inputs, bottom=bottom, pins=pins), target)


def is_bottom(manifest: DataFrame, to_level: int) -> bool:
    """Whether no deeper level has runs."""
    return manifest.filter(F.col("level") > to_level).isEmpty()


def pick(manifest: DataFrame) -> DataFrame:
    """level, table_id of what each level would compact next, with the level's number of runs and whether it is due:
    all runs of level 0, the one with the smallest key elsewhere."""
    sizes = manifest.groupBy("level").agg(F.count(F.lit(1)).alias("n_runs"), F.min_by("table_id", F.struct("min_key", "table_id")).alias("_first"))
    out = manifest.join(sizes, "level").filter((F.col("level") == 0) | (F.col("table_id") == F.col("_first")))
    return out.select("level", "table_id", "n_runs", ((F.col("n_runs") >= TRIGGER) & (F.col("level") < LEVELS - 1)).alias("due"))


def swapped(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The manifest with one set of runs replaced by another."""
    return manifest.join(removed.select("table_id"), "table_id", "left_anti").unionByName(added)


def backpressure(manifest: DataFrame) -> DataFrame:
    n = F.count_if(F.col("level") == 0)
    return manifest.agg(n.alias("l0_runs"), (n >= BACKPRESSURE).alias("writers_wait"))
