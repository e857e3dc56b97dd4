"""Telemetry and benchmark statistics: guarded ratios and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ordered import numbered

MEBI = 1 << 20
#: Bytes that a flushed entry is charged beside its key and value. Fixed value.
FLUSH_OVERHEAD = 16
QUANTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))


def ratio(part: Column, whole: Column, otherwise: float = 1.0) -> Column:
    """part / whole, or ``otherwise`` where whole isn't positive: write and space amplification."""
    return F.when(whole <= 0, F.lit(otherwise)).otherwise(part / whole)


def merge_throughput(merged_bytes: Column, millis: Column) -> Column:
    """MB/s; the time counts as 1 ms at least, and without any time it is 0."""
    return F.when(millis <= 0, F.lit(0.0)).otherwise(merged_bytes / MEBI / F.greatest(F.lit(0.001), millis / 1000))


def success_rate(ok: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(ok * 100.0 / total)


def logical_bytes(value: Column) -> Column:
    """Characters of key and value."""
    return F.length("key") + F.coalesce(F.length(value), F.lit(0))


def latency_text(micros: Column) -> Column:
    """Microseconds for people: a dash without any, µs under a millisecond, else ms to two places."""
    cents = F.floor((micros + 5) / 10)
    millis = F.format_string("%d.%02d ms", F.floor(cents / 100), cents % 100)
    return F.when(micros <= 0, F.lit("—")).when(micros < 1000, F.format_string("%d µs", micros.cast("bigint"))).otherwise(millis)


def order_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, min, max, median (upper), p50, p95, p99, p999, each the sorted value at min(n - 1, floor(n * q)).

    Exact at any size: the rows are sorted by ranges of (group, value) and picked by their number, so no group has to
    fit one task.
    """
    rows = numbered(df.select(group, value), group, value, out="_no")
    bounds = rows.groupBy(group).agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("n"))
    at = lambda q: F.col("_first") + F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    wanted = [("min", F.col("_first")), ("max", F.col("_first") + F.col("n") - 1), ("median", F.col("_first") + F.floor(F.col("n") / 2)), *((name, at(q)) for name, q in QUANTILES)]
    picked = bounds.select(group, "n", F.explode(F.array(*(F.struct(F.lit(name).alias("what"), no.alias("no")) for name, no in wanted))).alias("w"))
    picked = picked.select(F.col(group).alias("_g"), "n", "w.what", F.col("w.no").alias("_at"))
    found = rows.join(picked, (rows[group] == picked["_g"]) & (rows["_no"] == picked["_at"]))
    return found.groupBy(group, "n").pivot("what", [name for name, _ in wanted]).agg(F.first(value))


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group the sample standard deviation, 0 for fewer than two values."""
    return df.groupBy(group).agg(F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("std_dev"))


def merge_runs(runs: DataFrame, group: str) -> DataFrame:
    """Benchmark runs (run_no, n_ok, n_total, service_ms) drawn together: sums, and the last service time above 0."""
    last = F.max_by("service_ms", F.when(F.col("service_ms") > 0, F.col("run_no")))
    out = runs.groupBy(group).agg(F.sum("n_ok").alias("n_ok"), F.sum("n_total").alias("n_total"), F.coalesce(last, F.lit(0.0)).alias("service_ms"))
    return out.withColumn("success_rate", success_rate(F.col("n_ok"), F.col("n_total")))


def hit_ratio(hit: Column) -> Column:
    """Share of hits, an aggregate; 0 where there was no access."""
    return F.coalesce(F.avg(hit.cast("int")), F.lit(0.0))


def benchmark_report(runs: DataFrame, group: str) -> str:
    """A Markdown table of merged benchmark runs; groups are few."""
    lines = [f"| {group} | successful | total | success rate | service recovery |", "|---|---|---|---|---|"]
    for r in merge_runs(runs, group).orderBy(group).collect():
        lines.append(f"| {r[group]} | {r['n_ok']} | {r['n_total']} | {r['success_rate']:.2f} % | {r['service_ms']:.2f} ms |")
    return "\n".join(lines) + "\n"
