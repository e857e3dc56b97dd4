"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks; every block of queries meets every block of candidates, and all scores are computed.
A round adds up, for each query, a histogram of the scores inside its current range and narrows the range to the bin
that holds its k-th score, until the bins are one integer wide. A last round keeps what lies above the k-th score and,
of the ties with it, the smallest ids that are still needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.scratch import stash

SCALE = 64
#: Candidates of a block that are scored at once.
TILE = 2048
EXACT = 2.0**53
LONGEST = 2**63 - 1


def _packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """One row per block of about so many vectors: block, n, dim, most (largest magnitude), ids, grid."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = [], []
        for batch in batches:
            for i, v in zip(batch["id"], batch["v"], strict=True):
                ids.append(i)
                vectors.append(np.floor(SCALE * np.asarray(v, dtype=np.float64)))
                if len(ids) == rows:
                    yield _block(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield _block(ids, vectors)

    blocks = df.mapInPandas(pack, "n int, dim int, most double, ids binary, grid binary")
    return stash(blocks.withColumn("block", F.monotonically_increasing_id()), name)


def _block(ids: list[int], vectors: list[np.ndarray]) -> pd.DataFrame:
    dim = max(map(len, vectors))
    grid = np.zeros((len(ids), dim))
    for row, v in zip(grid, vectors, strict=True):
        row[: len(v)] = v
    most = float(np.abs(grid).max(initial=0))
    return pd.DataFrame({"n": [len(ids)], "dim": [dim], "most": [most], "ids": [np.array(ids, dtype=np.int64).tobytes()], "grid": [grid.astype(np.int32 if most < 2**31 else np.float64).tobytes()]})


def _grid(row, side: str) -> np.ndarray:
    kind = np.int32 if getattr(row, f"{side}most") < 2**31 else np.float64
    return np.frombuffer(getattr(row, f"{side}grid"), dtype=kind).reshape(getattr(row, f"{side}n"), -1)


def _scores(row, tile: slice) -> tuple[np.ndarray, np.ndarray]:
    """Integer inner products of a block of queries and a tile of one of candidates (a query's own row is marked), and the
    candidates' ids."""
    q, c = _grid(row, "q_"), _grid(row, "c_")[tile]
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    ids = np.frombuffer(row.c_ids, dtype=np.int64)[tile]
    own = np.frombuffer(row.q_ids, dtype=np.int64)[:, None] == ids[None, :]
    if row.q_most * row.c_most * dim < EXACT:
        return np.where(own, -LONGEST - 1, (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)), ids
    # beyond what doubles hold: integers of any size
    whole = lambda grid: np.array([[int(x) for x in v] for v in grid], dtype=object)
    scores = whole(q) @ whole(c).T
    scores[own] = -LONGEST - 1
    if np.abs(scores[~own]).max(initial=0) > LONGEST:
        raise OverflowError("a score is too large for a long")
    return scores.astype(np.int64), ids


def _over_pairs(queries: DataFrame, candidates: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f over every pair of a query block (with its state) and a tile of a candidate block. Queries go to each candidate
    block, so what is moved falls with the blocks' size, while what a task holds is a pair of blocks and a tile's scores."""
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    c = candidates.select(*(F.col(c).alias(f"c_{c}") for c in candidates.columns))
    numbers = candidates.agg(F.collect_set("block").alias("all"))  # one number per some thousand rows
    q = q.join(F.broadcast(numbers)).withColumn("c_block", F.explode("all")).drop("all")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for first in range(0, row.c_n, TILE):
                    out = f(row, slice(first, first + TILE))
                    for start in range(0, len(out), 50_000):
                        yield out.iloc[start : start + 50_000]

    return q.join(c, "c_block").mapInPandas(run, schema)


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, block_rows: int | None = None, query_rows: int = 1024, bins: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but those with the query's own id. If
    there are fewer than k candidates all are returned, so a table of one row gives none. Vectors that are null or hold
    null or non-finite components, and rows without an id, take no part; a shorter vector counts as padded with zeros,
    an empty one scores 0. Components may be of any size; a score that no long holds raises OverflowError. Rows that
    repeat an id are candidates each, and queries each. Other columns are not read. block_rows: candidates of a block;
    by default a 64th of the table, from TILE to 8 TILEs.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    if block_rows is None:
        block_rows = min(8 * TILE, max(TILE, good.count() // 64))
    candidates = _packed(good, block_rows, "candidates")
    queries = _packed(good.filter(F.col("id") % every == 0), query_rows, "queries")
    most, dim = candidates.agg(F.max("most"), F.max("dim")).first()
    high = min(int(most or 0) ** 2 * (dim or 0), LONGEST)

    # state of a query: the ``span`` scores from lo on, in bins of ``width``, still hold ``need`` of its k highest
    span = 2 * high + 1
    width = -(-span // bins)
    state = queries.select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    state = state.select("block", "at", F.lit(-high).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open"))
    while True:
        current = state

        def with_state(current: DataFrame = current) -> DataFrame:
            packed = current.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "need", "open"))).alias("state"))
            return queries.join(packed, "block")

        def count(row, tile: slice, span: int = span, width: int = width) -> pd.DataFrame:
            scores, _ = _scores(row, tile)
            lo = np.array([s["lo"] for s in row.q_state], dtype=np.int64)[:, None]
            live = np.array([s["open"] for s in row.q_state])[:, None]
            above = scores >= lo
            with np.errstate(over="ignore"):  # of 64 bits without sign, what a difference wraps round to is the difference
                off = (scores - lo).view(np.uint64)
            inside = live & above & (off <= np.uint64(span - 1)) & (scores > np.iinfo(np.int64).min)
            bin_of = np.where(inside, (off // np.uint64(width)).astype(np.int64), -1)
            n = min(k, bin_of.shape[1])  # a tile's bins below its own k-th score can't hold the k-th of all
            least = np.partition(bin_of, bin_of.shape[1] - n, axis=1)[:, bin_of.shape[1] - n][:, None]
            at, c = np.nonzero((bin_of >= least) & (bin_of >= 0))
            found, counts = np.unique(at * bins + bin_of[at, c], return_counts=True)
            return pd.DataFrame({"block": np.full(len(found), row.q_block), "at": (found // bins).astype(np.int32), "bin": (found % bins).astype(np.int32), "n": counts})

        histogram = _over_pairs(with_state(), candidates, count, "block long, at int, bin int, n long").groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("block", "at").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        above = histogram.withColumn("upto", F.sum("n").over(down)).groupBy("block", "at").agg(F.collect_list(F.struct(F.col("upto"), F.col("bin"), F.col("n"))).alias("h"))
        joined = current.join(above, ["block", "at"], "left")
        hit = F.array_min(F.filter("h", lambda x: x["upto"] >= F.col("need")))
        wide = lambda c: c.cast("decimal(20,0)")
        # fewer than need: the query has less than k candidates, and all of them are taken
        state = stash(
            joined.withColumn("hit", hit).select(
                "block", "at", F.when(F.col("hit").isNotNull(), wide(F.col("lo")) + wide(F.col("hit.bin")) * F.lit(width).cast("decimal(20,0)")).otherwise(F.col("lo")).cast("long").alias("lo"),
                F.when(F.col("hit").isNotNull(), F.col("need") - F.col("hit.upto") + F.col("hit.n")).otherwise(F.col("need")).alias("need"), F.col("hit").isNotNull().alias("open"),
            ),
            "topk-state",
        )
        if width == 1:
            break
        span, width = width, -(-width // bins)
    current = state

    def take(row, tile: slice) -> pd.DataFrame:
        scores, ids = _scores(row, tile)
        lo = np.array([s["lo"] for s in row.q_state], dtype=np.int64)[:, None]
        need = np.array([s["need"] if s["open"] else len(ids) for s in row.q_state], dtype=np.int64)
        own = scores == np.iinfo(np.int64).min
        at, c = np.nonzero((scores > lo) & ~own)
        tied, t = np.nonzero((scores == lo) & ~own)
        order = np.lexsort((ids[t], tied))
        tied, t = tied[order], t[order]
        place = np.arange(len(tied)) - np.searchsorted(tied, tied)
        at, c = np.r_[at, tied[place < need[tied]]], np.r_[c, t[place < need[tied]]]
        own_ids = np.frombuffer(row.q_ids, dtype=np.int64)
        return pd.DataFrame({"block": np.full(len(at), row.q_block), "at": at.astype(np.int32), "query_id": own_ids[at], "vec_id": ids[c], "score": scores[at, c]})

    kept = _over_pairs(with_state(current), candidates, take, "block long, at int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op8_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
QUERIES = {"op8_top_k": op8_top_k}
