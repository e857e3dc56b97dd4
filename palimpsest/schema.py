"""The mutation relation: typed puts and deletes, ordered by commit sequence and place in the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags of a value; fixed values of the record format.
INTEGER, FLOAT, STRING, TOMBSTONE = 1, 2, 3, 4

MUTATION = "key string, seq bigint, op_index int, value_type smallint, v_long bigint, v_double double, v_string string"
VALUES = ("value_type", "v_long", "v_double", "v_string")
COLUMNS = ("key", "seq", "op_index", *VALUES)


def tagged(**value: Column | None) -> list[Column]:
    """The value columns of a row: pass one of v_long, v_double, v_string per kind, with a ``when`` column each.

    A row none of whose values is set is a tombstone. Integers widen to bigint and floats to double here, on the way in,
    so that a value never changes its type later.
    """
    kinds = (("v_long", INTEGER, "bigint"), ("v_double", FLOAT, "double"), ("v_string", STRING, "string"))
    given = {name: value.get(name, F.lit(None)).cast(kind) for name, _, kind in kinds}
    tag = F.lit(TOMBSTONE)
    for name, code, _ in reversed(kinds):
        tag = F.when(given[name].isNotNull(), F.lit(code)).otherwise(tag)
    return [tag.cast("smallint").alias("value_type"), *(c.alias(n) for n, c in given.items())]


def is_tombstone() -> Column:
    return F.col("value_type") == TOMBSTONE


def value_text() -> Column:
    """The value as a string; null for a tombstone."""
    return F.coalesce(F.col("v_string"), F.col("v_long").cast("string"), F.col("v_double").cast("string"))


def mutations(df: DataFrame) -> DataFrame:
    """df in the columns and types of the relation; op_index is 0 where there is none."""
    if "op_index" not in df.columns:
        df = df.withColumn("op_index", F.lit(0))
    kinds = dict(part.split(" ") for part in MUTATION.split(", "))
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))
