"""Exact dedup by distributed MSD radix partitioning.

Texts are split by successive runs of bytes (the digits of the radix). After a round a group holds the texts that
agree on all bytes so far; a group is done when it is a singleton or its texts have ended, the rest go on with their
next digit. Digits grow by a constant factor, so a text of n bytes takes O(log n) rounds. Two texts are held equal only
because all their bytes were compared; no digest decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import drop_stash, stash


def radix_exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = 256, growth: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as empty, and empty texts form a group like
    any other. A null id is never the largest; a group of nothing but null ids has keep_id null and keeps its rows.
    Rows that repeat both id and text count in group_size and are all kept or all dropped with their id. Other columns
    are not read, so their names cannot clash. An empty table gives an empty result.

    The digit is the grouping key: rows of one hot text are combined before the shuffle. The groups of a round are
    written before their ids are used (a lost task can't renumber them), and the join that brings a group back to its
    rows has one row per group on the build side, so that adaptive execution can split a hot group.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
    active = docs.select("id", F.sha2("b", 256).alias("sha"), F.lit(0).cast("long").alias("g"), "b")
    offset, width, finished = 0, first_digit, []
    while True:
        digit = F.substring("b", offset + 1, width)
        cut = active.withColumns({"digit": digit, "ended": F.octet_length("b") <= offset + width})
        groups = cut.groupBy("g", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).filter("n > 1")
        groups = stash(groups.withColumn("next", F.monotonically_increasing_id()), f"groups{len(finished)}")
        joined = cut.join(groups.hint("shuffle_hash"), ["g", "digit", "ended"], "left")
        goes_on = F.col("n").isNotNull() & ~F.col("ended")
        level = stash(
            joined.select(
                "id", "sha", F.when(goes_on, F.col("next")).alias("g"), F.when(goes_on, F.col("b")).alias("b"),
                F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            ),
            f"radix{len(finished)}",
        )
        drop_stash(groups)
        finished.append(level.filter("g is null").select("id", "keep_id", "group_size", "sha"))
        active = level.filter("g is not null").select("id", "sha", "g", "b")
        offset, width = offset + width, width * growth
        if active.isEmpty():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return radix_exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
