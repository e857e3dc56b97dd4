"""Point-in-time resolution: the newest version of each key, at the latest or at a pinned sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.schema import TOMBSTONE, VALUES, is_tombstone

#: Lists of keys up to this many rows are broadcast; the count is checked first.
MOST_BROADCAST = 100_000


def newest(log: DataFrame, snapshot: int | None = None, by: tuple[str, ...] = ("key",), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: its newest version by (seq, op_index), tombstones included.

    The snapshot filters before the aggregation, and the aggregation combines on the map side, so that what is shuffled
    is one row per key and task. ``carry`` names columns to bring along, as the run a version lies in.
    """
    if snapshot is not None:
        log = log.filter(F.col("seq") <= snapshot)
    best = F.max_by(F.struct("seq", "op_index", *VALUES, *carry), F.struct("seq", "op_index"))
    return log.groupBy(*by).agg(best.alias("v")).select(*by, "v.*")


def live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The visible rows: newest versions that aren't tombstones."""
    return newest(log, snapshot).filter(~is_tombstone())


def live_keys(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys of the visible rows; only keys and tags are read."""
    return live(log.select("key", "seq", "op_index", "value_type", *(F.lit(None).cast(t).alias(c) for c, t in (("v_long", "bigint"), ("v_double", "double"), ("v_string", "string")))), snapshot).select("key")


def live_keys_by_antijoin(log: DataFrame) -> DataFrame:
    """The same keys as puts that no later tombstone shadows: a cross-check of live_keys."""
    puts = log.filter(~is_tombstone()).groupBy("key").agg(F.max("seq").alias("put"))
    gone = log.filter(is_tombstone()).groupBy("key").agg(F.max("seq").alias("del"))
    return puts.join(gone, (puts["key"] == gone["key"]) & (gone["del"] > puts["put"]), "left_anti").select("key")


def _listed(keys: DataFrame) -> DataFrame:
    """A list of keys, with a broadcast hint if it's short enough."""
    return F.broadcast(keys) if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else keys


def multi_get(keys: DataFrame, log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Every key of the list with its visible value, null on a miss. Versions of other keys go before they are resolved."""
    wanted = log.join(_listed(keys.select("key").distinct()), "key", "left_semi")
    return keys.join(live(wanted, snapshot), "key", "left")


def exists(keys: DataFrame, log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys of the list that have a version, a tombstone counting as one."""
    if snapshot is not None:
        log = log.filter(F.col("seq") <= snapshot)
    return keys.join(log.select("key").distinct(), "key", "left_semi")


def tombstones(log: DataFrame) -> DataFrame:
    """key, is_tombstone of the newest versions."""
    return newest(log).select("key", is_tombstone().alias("is_tombstone"))


def history(log: DataFrame) -> DataFrame:
    """All versions with the sequence from which they are shadowed (valid_to, null for the newest)."""
    return log.withColumn("valid_to", F.lead("seq").over(Window.partitionBy("key").orderBy("seq", "op_index")))


def in_batches(log: DataFrame, size: int) -> DataFrame:
    """Commit ``size`` rows as one batch: they share a sequence, and the last operation on a key wins."""
    return log.withColumn("op_index", ((F.col("seq") - 1) % size).cast("int")).withColumn("seq", F.floor((F.col("seq") - 1) / size) + 1)


def string_or_empty(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Look keys up in the way of the append-only store: a miss, a delete and an empty string all read ''."""
    from palimpsest.schema import value_text

    return multi_get(keys, log).select("key", F.coalesce(value_text(), F.lit("")).alias("value"))


def counts(log: DataFrame) -> DataFrame:
    """n_keys and n_live over the newest versions."""
    return newest(log).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("value_type") != TOMBSTONE).alias("n_live"))
