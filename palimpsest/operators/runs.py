"""Sorted runs: flush boundaries, statistics, chunks, block index, bloom filters, and lookups by key range."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codec import frame_size, murmur3_pair
from palimpsest.operators.ordered import as_of, numbered
from palimpsest.operators.resolve import MOST_BROADCAST, newest

BLOCK_BYTES = 4096
FALSE_POSITIVES = 0.01
FLUSH_ROWS = 1000


def flushed(log: DataFrame, rows: int = FLUSH_ROWS) -> DataFrame:
    """Runs of a log whose buffer is frozen after every ``rows`` operations: per run, each key's newest version."""
    return newest(log.withColumn("table_id", F.floor((F.col("seq") - 1) / rows)), by=("table_id", "key"))


def flush_boundaries(log: DataFrame, threshold: int, shard: str) -> DataFrame:
    """table_id by operation if a shard's buffer is frozen once it holds ``threshold`` live keys after an operation.

    Deletes shrink the number of live keys, so the boundary depends on all operations before it: a fold in order of
    sequence over each shard's sorted rows. Its state is the keys of the open buffer, so a shard may be of any length.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, table = None, set(), 0
        for rows in batches:
            ids = []
            for of, key, tag in zip(rows[shard], rows["key"], rows["value_type"], strict=True):
                if of != now:
                    now, held, table = of, set(), 0
                (held.discard if tag == 4 else held.add)(key)
                ids.append(table)
                if len(held) >= threshold:
                    held, table = set(), table + 1
            yield rows.assign(table_id=ids)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    return log.repartition(shard).sortWithinPartitions(shard, "seq", "op_index").mapInPandas(fold, f"{kinds}, table_id bigint")


def run_stats(runs: DataFrame) -> DataFrame:
    """One manifest row per run."""
    return runs.groupBy("table_id").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_entries"),
        F.sum(frame_size()).cast("bigint").alias("bytes"), F.max("seq").alias("max_seq"),
    )


def run_name(column: str = "table_id") -> Column:
    return F.format_string("sst_%05d", F.col(column))


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Whether two key ranges meet; an unknown bound meets everything."""
    unknown = a_min.isNull() | a_max.isNull() | b_min.isNull() | b_max.isNull()
    return unknown | ((a_min <= b_max) & (a_max >= b_min))


def overlapping(stats: DataFrame) -> DataFrame:
    """Pairs of runs (a before b) whose key ranges meet. A manifest has one row per file, so its rows are few."""
    a, b = stats.alias("a"), stats.alias("b")
    meet = overlap(F.col("a.min_key"), F.col("a.max_key"), F.col("b.min_key"), F.col("b.max_key"))
    return a.join(b, (F.col("a.table_id") < F.col("b.table_id")) & meet).select(F.col("a.table_id").alias("table_a"), F.col("b.table_id").alias("table_b"))


def chunked(run: DataFrame, target: int) -> DataFrame:
    """Give every entry the run it goes to: a new one after each ``target`` entries in key order."""
    return numbered(run, "key").withColumn("table_id", F.floor((F.col("row_no") - 1) / target)).drop("row_no")


def interval_lookup(keys: DataFrame, stats: DataFrame) -> DataFrame:
    """key, table_id of the one run whose range holds the key, for disjoint runs; keys outside all ranges are left out.

    Disjoint ranges make this an as-of lookup on the lower bound with a check of the upper one. A manifest of up to
    MOST_BROADCAST runs is sent to the tasks and searched there; a longer one meets the keys in a range shuffle.
    """
    known = stats.select("min_key", "max_key", "table_id").limit(MOST_BROADCAST + 1).collect()  # bounded by the limit
    if len(known) > MOST_BROADCAST:
        found = as_of(keys, stats, "key", "min_key", ["min_key", "max_key", "table_id"])
        return found.filter(F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", "table_id")
    known = sorted((r["min_key"], r["max_key"], r["table_id"]) for r in known)
    firsts = [r[0] for r in known]

    @F.pandas_udf("bigint")
    def of(at: pd.Series) -> pd.Series:
        places = [bisect.bisect_right(firsts, k) - 1 for k in at]
        return pd.Series([known[p][2] if p >= 0 and k <= known[p][1] else None for k, p in zip(at, places, strict=True)], dtype="Int64")

    return keys.filter("key is not null").select("key", of("key").alias("table_id")).filter("table_id is not null")


def block_index(runs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """table_id, first_key, file_offset of every block: a block is closed once it holds block_bytes or more.

    The running size starts anew with each block, so it is a fold over a run's sorted rows; its state is three numbers,
    so a run may be of any length, and runs are folded side by side.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, offset, inside = None, 0, 0
        for rows in batches:
            out = []
            for run, key, size in zip(rows["table_id"], rows["key"], rows["size"], strict=True):
                if run != now:
                    now, offset, inside = run, 0, 0
                if inside == 0:
                    out.append((run, key, offset))
                inside, offset = inside + size, offset + size
                if inside >= block_bytes:
                    inside = 0
            yield pd.DataFrame(out, columns=["table_id", "first_key", "file_offset"])

    sized = runs.select(F.col("table_id").cast("bigint").alias("table_id"), "key", frame_size().cast("bigint").alias("size"), "seq")
    return sized.repartition("table_id").sortWithinPartitions("table_id", "key", F.desc("seq")).mapInPandas(fold, "table_id bigint, first_key string, file_offset bigint")


def block_candidate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Each key with the block of one run that could hold it; block 0 for a key before all."""
    return as_of(keys, index, "key", "first_key", ["first_key", "file_offset"])


def bloom_size(n: int, p: float = FALSE_POSITIVES) -> tuple[int, int]:
    """Bits and hash functions for n keys at a rate p of false positives."""
    n, p = max(1, n), p if 0 < p < 1 else FALSE_POSITIVES
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / n * math.log(2)))


def bloom_positions(keys: DataFrame, m: int, k: int) -> DataFrame:
    """keys with ``bit``: one row per hash function; the i-th bit is abs((h1 + i * h2) mod m) in 32-bit arithmetic."""
    pair = keys.withColumn("_h", murmur3_pair("key"))
    wrapped = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    bits = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.abs(wrapped(F.element_at("_h", 1).cast("bigint") + i * F.element_at("_h", 2).cast("bigint")) % m))
    return pair.withColumn("bit", F.explode(bits)).drop("_h")


def bloom_build(run: DataFrame, m: int, k: int) -> DataFrame:
    """The filter as rows of 64 bits: word, bits."""
    at = bloom_positions(run.select("key"), m, k)
    return at.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def bloom_probe(keys: DataFrame, bloom: DataFrame, m: int, k: int) -> DataFrame:
    """key, might_contain."""
    at = bloom_positions(keys.select("key").distinct(), m, k).withColumn("word", F.floor(F.col("bit") / 64))
    hit = F.coalesce(F.expr("shiftright(bits, cast(bit % 64 as int)) & 1") == 1, F.lit(False))
    return at.join(bloom, "word", "left").groupBy("key").agg(F.bool_and(hit).alias("might_contain"))


def lru_trace(accesses: DataFrame, capacity: int) -> DataFrame:
    """hit for every access (cache_id, access_no, block) of caches that evict what was used longest ago.

    A cache is replayed over its sorted accesses; the state is its content, so a trace may be of any length.
    """

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for trace in batches:
            hits = []
            for cache, block in zip(trace["cache_id"], trace["block"], strict=True):
                if cache != now:
                    now, held = cache, {}
                hits.append(block in held)
                held.pop(block, None)
                held[block] = True
                if len(held) > capacity:
                    held.pop(next(iter(held)))
            yield trace.assign(hit=hits)

    traces = accesses.select("cache_id", "access_no", "block")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in traces.schema)
    return traces.repartition("cache_id").sortWithinPartitions("cache_id", "access_no").mapInPandas(play, f"{kinds}, hit boolean")


def sorted_versions(log: DataFrame) -> DataFrame:
    """All versions numbered by key, then newest first."""
    return numbered(log, F.col("key"), F.col("seq").desc(), F.col("op_index").desc())


def write_run(run: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write a run sorted by key, with a bloom filter on it; the ranges of the files don't overlap."""
    dealt = run.repartitionByRange(files, "key") if files else run.repartitionByRange("key")
    dealt.sortWithinPartitions("key", F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
    return run.sparkSession.read.schema(run.schema).parquet(path)

