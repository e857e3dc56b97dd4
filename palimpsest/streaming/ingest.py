"""Structured Streaming into a store, and newest-wins state kept by a streaming aggregation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.resolve import newest
from palimpsest.operators.store import KVStore


def into_store(stream: DataFrame, store: KVStore, checkpoint: str) -> StreamingQuery:
    """Commit every micro-batch as one batch of the store; a batch that is run again after a failure is skipped.

    Batches are told apart by the query's id, which its checkpoint keeps over restarts, and their number. So several
    streams can go into one store, and one that begins anew with another checkpoint is a stream of its own.
    """
    named: list[str] = []

    def commit(batch: DataFrame, number: int) -> None:
        if not named:
            named.append(json.loads(batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"])
        store.write(batch, stream=named[0], number=number)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_state(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far, for output mode complete or update."""
    return newest(stream)


def committed_only(stream: DataFrame, commit: int) -> DataFrame:
    """Entries of a replicated log that may be applied: puts and deletes up to the commit index."""
    return stream.filter(f"index <= {int(commit)} and upper(cmd) in ('PUT', 'DELETE')")


def flush_boundaries(stream: DataFrame, threshold: int) -> DataFrame:
    """shard, key, seq, table_id: the run that each operation of a shard (shard, key, seq, value_type) goes to, when the
    open buffer is frozen once it holds ``threshold`` live keys.

    The state of a shard is its open buffer, threshold keys at most, and its run's number. A micro-batch's operations of
    a shard are put in order of their sequence; sequences of later micro-batches have to be larger.
    """

    def fold(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, table = state.get if state.exists else ([], 0)
        held = set(held)
        rows = pd.concat(list(batches)).sort_values("seq")
        ids = []
        for key, tag in zip(rows["key"], rows["value_type"], strict=True):
            (held.discard if tag == 4 else held.add)(key)
            ids.append(table)
            if len(held) >= threshold:
                held, table = set(), table + 1
        state.update((sorted(held), table))
        yield rows[["shard", "key", "seq"]].assign(table_id=ids)

    keyed = stream.select("shard", "key", "seq", "value_type")
    kind = stream.schema["shard"].dataType.simpleString()
    return keyed.groupBy("shard").applyInPandasWithState(fold, f"shard {kind}, key string, seq bigint, table_id bigint", "keys array<string>, run bigint", "append", GroupStateTimeout.NoTimeout)
