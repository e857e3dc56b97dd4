"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

The token budget is cut into equal blocks of words. Sources get blocks by the highest quotients t / (2k + 1) of their
targets, then every source's blocks go to its shards the same way, which gives each shard an integer quota. A shard
lays its documents out in seeded order, a second time after the first, and takes the blocks of its quota from there.
Only ids and sizes are ever shuffled or windowed: the text is read once, to count its words.

Sources may be many, as hosts are, and one may hold most rows: whatever needs an order over all sources, or over all shards
of one, is sorted by ranges, and a source is dealt into cells by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ordered import numbered
from palimpsest.scratch import stash

#: Fixed values of the mix: weights by place of the source in code point order, the share of all words that the mix
#: takes, and how often a source or a document may be taken.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
#: Sources up to this many rows are broadcast; their number is counted first.
MOST_BROADCAST = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add place, weight and target to one row per source (source, source_size).

    The budget goes to the sources by weight; a target stops at MOST_TIMES its source's size and the excess is reshared
    by weight until none is above. That is the level L of a filling vessel: target = min(L * weight, cap), and L is found
    in one pass over the sources in the order in which they fill up.
    """
    weights = F.array(*map(F.lit, WEIGHTS))
    out = numbered(sources, F.col("source").asc_nulls_last(), out="place")
    out = out.withColumn("weight", F.element_at(weights, ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(MOST_TIMES))).withColumn("fills_at", F.col("cap") / F.col("weight"))
    out = numbered(out, "fills_at", "place", out="_no", sums={"filled": "cap", "weighed": "weight"})
    whole = out.agg((F.sum("source_size") * F.lit(SHARE)).alias("budget"), F.sum("weight").alias("all_weight"))
    out = out.join(F.broadcast(whole))  # one row
    out = out.withColumn("level_here", (F.col("budget") - F.col("filled") + F.col("cap")) / (F.col("all_weight") - F.col("weighed") + F.col("weight")))
    fits = F.when(F.col("level_here") <= F.col("fills_at"), F.struct("fills_at", "place", "level_here"))
    out = out.join(F.broadcast(out.agg(F.min(fits)["level_here"].alias("level"))))  # one row
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return out.withColumn("target", target).select("source", "source_size", "place", "target")


def sainte_lague(rows: DataFrame, group: list[str], order: list[str], share: str, seats: str, out: str) -> DataFrame:
    """Add the integer quota ``out`` of each row: the group's ``seats`` by the highest quotients share / (2k + 1).

    With n rows whose shares sum to T, the divisor that hands out N seats lies between T / (N + n/2 + 1) and
    T / (N - n/2 - 1). Seats that even the largest divisor gives are certain; only the seats between the two bounds,
    about 2n in a group whatever N is, are listed and ranked. Ties go to the first row in ``order``. All groups are ranked
    by one range sort, so that a group of any size is shared out.
    """
    def with_group(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, group) if group else left.join(F.broadcast(right))  # one row

    total, n = F.col("_total"), F.col("_n")
    bounds = with_group(rows, rows.groupBy(*group).agg(F.sum(share).alias("_total"), F.count(F.lit(1)).alias("_n")))
    spare = F.col(seats) - n / 2 - 1
    at = lambda divisor: F.floor(F.col(share) / divisor + 0.5)
    bounds = bounds.withColumn("_sure", F.when((spare > 0) & (total > 0), at(total / spare)).otherwise(F.lit(0)).cast("long"))
    bounds = bounds.withColumn("_most", F.when(total > 0, at(total / (F.col(seats) + n / 2 + 1)) + 1).otherwise(F.lit(0)).cast("long"))
    bounds = stash(bounds, "seat-bounds")
    listed = bounds.withColumn("_k", F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1))))
    ranked = numbered(listed, *group, (F.col(share) / (2 * F.col("_k") + 1)).desc_nulls_last(), *order, out="_no")
    first = with_group(
        ranked.groupBy(*group).agg(F.min("_no").alias("_first")), bounds.groupBy(*group).agg((F.max(seats) - F.sum("_sure")).alias("_left"))
    )
    won = with_group(ranked, first).filter(F.col("_no") - F.col("_first") < F.col("_left"))
    keys = rows.columns
    seated = bounds.select(*keys, F.col("_sure").alias("_seats")).unionByName(won.select(*keys, F.lit(1).cast("long").alias("_seats")))
    return seated.groupBy(*keys).agg(F.sum("_seats").cast("long").alias(out))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 16, shard_words: int = 1 << 20, cell_words: int = 1 << 16, seed: int = 20) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    block_words: words in a block. shard_words: words of quota that a shard has about. cell_words: words of the parts that
    a source is dealt into, whose groups are its shards: a source that holds most rows has that many more parts.
    A null text has size 0 and is taken 0 times; null sources form one source, placed last. Rows that repeat an id are
    placed next to each other; rows that agree in id, source and size are interchangeable. A null id is an id like any
    other. If all texts are empty, targets are 0. An empty table gives an empty result. Other columns are not read.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    base = base.withColumns(
        {
            "k": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),  # joins and windows need no null-safe key
            "spot": F.xxhash64(F.lit(seed), F.col("id")),
            "turn": F.xxhash64(F.lit(seed + 1), F.col("id")),
        }
    )
    base = stash(base, "mix-sizes")
    goal = stash(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    goal = goal.join(F.broadcast(goal.agg(F.round(F.sum("target") / block_words).cast("long").alias("_all"))))  # one row
    quota = sainte_lague(goal, [], ["place"], "target", "_all", "blocks")
    n_cells = F.greatest(F.lit(1), F.ceil(F.col("source_size") / cell_words)).cast("int")
    n_shards = F.greatest(F.lit(1), F.least(n_cells, F.floor(F.col("blocks") * block_words / shard_words))).cast("int")
    quota = quota.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    quota = stash(quota.select("k", "place", "source_size", "target", "blocks", n_cells.alias("n_cells"), n_shards.alias("n_shards")), "mix-quota")
    of_source = F.broadcast(quota) if quota.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else quota
    base = base.join(of_source.select("k", "n_cells"), "k").withColumn("cell", F.pmod("spot", "n_cells").cast("int"))
    cell = base.groupBy("k", "cell").agg(F.sum("size").alias("cell_size")).join(of_source, "k").withColumn("shard", F.col("cell") % F.col("n_shards"))
    cell = stash(cell, "mix-cells")
    shard = cell.groupBy("place", "shard", "blocks").agg(F.sum("cell_size").alias("shard_size"))
    shard = sainte_lague(shard, ["place"], ["shard"], "shard_size", "blocks", "shard_blocks").drop("blocks")
    in_shard = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 2), F.col("cell")), "cell")
    cell = cell.join(shard, ["place", "shard"]).withColumn("cell_from", F.sum("cell_size").over(in_shard) - F.col("cell_size"))
    takes = F.least(F.col("shard_blocks") * block_words, F.col("shard_size") * MOST_TIMES).alias("takes")
    cell = cell.select("k", "cell", "source_size", "target", "shard_size", "cell_from", takes)
    in_cell = Window.partitionBy("k", "cell").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.join(cell, ["k", "cell"]).withColumn("start", F.col("cell_from") + F.sum("size").over(in_cell) - F.col("size"))
    once = lambda upto: F.greatest(F.lit(0), F.least(F.col("size"), upto - F.col("start")))
    taken = once(F.col("takes"))
    for again in range(1, MOST_TIMES):
        taken = taken + once(F.col("takes") - again * F.col("shard_size"))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op2_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_mix": op2_mix}
