"""Global order without a single task: range partitions, sorted each, with offsets from the counts before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.scratch import stash


def ranged(df: DataFrame, *order) -> DataFrame:
    """df dealt out by ranges of the order and sorted, with _part (in order) and _place (in the part, from 0).

    The table is written: places come from the written rows, so that every later reader sees the same ones.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    out = stash(out, "ranged")
    return out.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def numbered(df: DataFrame, *order, out: str = "row_no", sums: dict[str, str] | None = None) -> DataFrame:
    """df with a global row number from 1 in the order given, and for each of ``sums`` (new column: column) the sum over
    all rows up to this one. What is broadcast has a row per partition."""
    sums = sums or {}
    rows = ranged(df, *order)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_of_{name}") for name, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_of_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums)]
    offsets = parts.select("_part", *before)
    here = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({f"_here_{name}": F.sum(c).over(here) for name, c in sums.items()}) if sums else rows
    placed = placed.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + F.col("_place") + 1).cast("long"))
    for name in sums:
        placed = placed.withColumn(name, F.col(f"_before_{name}") + F.col(f"_here_{name}"))
    return placed.drop("_part", "_place", "_before", *(f"{x}_{name}" for name in sums for x in ("_before", "_here")))


def as_of(probes: DataFrame, index: DataFrame, probe_key: str, index_key: str, carry: list[str]) -> DataFrame:
    """Each probe with the index row of the largest key that isn't larger; the first index row where there is none.

    Both sides go through one range shuffle. A part's probes before its first index row take the last index row of the
    parts before it.
    """
    entry = F.struct(F.col(index_key).alias("_k"), *carry)
    both = probes.select(F.col(probe_key).alias("_at"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_probe"), F.lit(None).alias("_entry"))
    both = both.unionByName(index.select(F.col(index_key).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_probe"), entry.alias("_entry")))
    rows = ranged(both, "_at", "_side")
    seen = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_found", F.last("_entry", ignorenulls=True).over(seen))
    parts = rows.groupBy("_part").agg(F.max(F.when(F.col("_side") == 0, F.col("_entry"))).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = index.agg(F.min(entry).alias("_first"))
    carried = parts.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"))
    out = rows.filter("_side = 1").join(F.broadcast(carried), "_part").join(F.broadcast(first))
    hit = F.coalesce("_found", "_earlier", "_first")
    return out.select("_probe.*", *(hit[c].alias(c) for c in carry))
