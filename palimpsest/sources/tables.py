"""The driver's tables as logs and runs of the mutation relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import mutations, tagged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(column: str = "user_id"):
    return F.format_string("u_%06d", F.col(column))


def events_log(spark: SparkSession, sf_dir: str, user: int | None = None) -> DataFrame:
    """events as a log of doubles; an error deletes. ``user`` is filtered before the key is made, so that the scan
    gets the filter."""
    events = table(spark, sf_dir, "events")
    if user is not None:
        events = events.filter(F.col("user_id") == user)
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return mutations(events.select(user_key().alias("key"), (F.col("event_id") + 1).alias("seq"), *tagged(v_double=value)))


def events_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with a value of another type for each kind of event."""
    kind = F.col("event_type")
    values = tagged(
        v_long=F.when(kind == "click", F.col("event_id")).when(kind == "signup", F.col("user_id")),
        v_double=F.when(kind == "purchase", F.col("value")),
        v_string=F.when(kind == "view", F.col("props")),
    )
    return mutations(table(spark, sf_dir, "events").select(user_key().alias("key"), (F.col("event_id") + 1).alias("seq"), *values))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return mutations(orders.select(F.format_string("o_%08d", "o_orderkey").alias("key"), (F.col("o_orderkey") + 1).alias("seq"), *tagged(v_double=F.col("o_totalprice"))))


def part_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return mutations(part.select(F.format_string("p_%08d", "p_partkey").alias("key"), (F.col("p_partkey") + 1).alias("seq"), *tagged(v_string=F.col("p_name"))))


def docs_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mutations(docs.select(F.format_string("d_%08d", "doc_id").alias("key"), (F.col("doc_id") + 1).alias("seq"), *tagged(v_string=F.col("text"))))


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up; many of them were never written."""
    return table(spark, sf_dir, "customer").select(user_key("c_custkey").alias("key"))


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.format_string("p_%08d", "l_partkey").alias("key")).distinct()


#: Replicas of the log: name and how many entries of the end they lack. Fixed values of the test model.
REPLICAS = (("n1", 0), ("n2", 40), ("n3", 700))
TERM_LENGTH = 2500


def replicated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, index, term, cmd, key, v_double: the log of events on three replicas that lag by fixed amounts."""
    log = events_log(spark, sf_dir).select(
        F.col("seq").alias("index"), (1 + F.floor((F.col("seq") - 1) / TERM_LENGTH)).alias("term"),
        F.when(F.col("seq") % 97 == 0, "READ_BARRIER").when(F.col("value_type") == 4, "delete").otherwise("PUT").alias("cmd"), "key", "v_double",
    )
    last = table(spark, sf_dir, "events").agg((F.max("event_id") + 1).alias("last"))
    replicas = spark.createDataFrame(list(REPLICAS), "node_id string, lag bigint")
    return log.crossJoin(F.broadcast(replicas.crossJoin(last))).filter("index <= last - lag").drop("lag", "last")


def last_index(spark: SparkSession, sf_dir: str) -> int:
    """The last index of the replicated log."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1


def forked_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replicated log, with a suffix of an older term on n2: the last fifth of the log, which the leader n1 replaced."""
    fork = last_index(spark, sf_dir) * 4 // 5
    return replicated_log(spark, sf_dir).withColumn("term", F.when((F.col("node_id") == "n2") & (F.col("index") > fork), F.col("term") - 1).otherwise(F.col("term")))
