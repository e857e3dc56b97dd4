"""MinHash near-dedup by ProbMinHash.

A document is the weighted set of its five-word shingles. Every shingle starts a Poisson process whose rate is its
weight; each arrival lands in a random register, a register keeps its earliest arrival, and a process ends as soon as
its next arrival comes after all registers' earliest. Two documents agree in a register with the probability that is
their probability Jaccard similarity. Bands of registers make buckets, and candidates are verified on their shingles.

Links are verified on sets, and repeats can make the probability Jaccard of weighted sets far smaller than that of the
sets themselves. So a document with repeated shingles has the bands of two signatures, one weighted and one with weight 1
for every shingle, and the latter are what bounds the share of missed pairs. Without repeats both are the same.

A bucket is never expanded into its pairs: its members meet one member of each class found so far, in rounds, until
every class of the bucket has been met. Then all pairs of a bucket that are still in different classes meet, in blocks,
so that no link between nodes that were never a class's head is lost. Documents with the same shingles are one node from
the start. A pair only becomes a candidate if the odd sketches of its sets could belong to similar sets; that bound never
errs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.hashing import range_hashes, scramble, window_hashes, word_hashes
from palimpsest.scratch import drop_stash, stash

SHINGLE = 5
#: Bands and registers of a band: a pair whose sets have similarity 0.8 shares no band with probability 2e-4; sets of 0.2 share
#: one with 7e-3.
BANDS, ROWS = 22, 5
#: Words of 64 bits of an odd sketch.
SKETCH = 16
#: Members of a bucket in one part, when its first classes are picked, and in one block, when the pairs that are left are met.
BLOCK = 256
_SHINGLE = np.uint64(0x8EBC6AF09C88C6E3)
_STEP, _REGISTER, _BAND, _BIT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of a text's words, in order; a text of fewer words than ``size`` is one shingle."""
    words = word_hashes(text.encode())
    if 0 < len(words) < size:
        return range_hashes(words, _SHINGLE, np.array([0]), np.array([len(words)]))
    return window_hashes(words, size, _SHINGLE)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The element in each register of each document: (n_docs, registers). Every document has an element at least."""
    earliest = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, dtype=np.uint64)
    time, latest = np.zeros(len(elements)), np.full(n_docs, np.inf)
    turn = 0
    while len(elements):
        # the arrivals of a few processes are drawn many at a time; those after the end of a process can't be earliest
        ahead = 1 if len(elements) > 4096 else 32
        turns = np.arange(turn + 1, turn + ahead + 1, dtype=np.uint64) * _STEP
        turn += ahead
        random = scramble(elements[:, None] ^ turns[None, :])
        wait = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
        times = time[:, None] + np.cumsum(wait, axis=1)
        slot = (doc * registers)[:, None] + (scramble(random ^ _REGISTER) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot.ravel(), times.ravel())
        won, at = np.nonzero(times == earliest[slot])
        winner[slot[won, at]] = elements[won]
        live = np.unique(doc)
        latest[live] = earliest.reshape(n_docs, registers)[live].max(axis=1)
        time = times[:, -1]
        goes_on = time < latest[doc]
        elements, weights, doc, time = elements[goes_on], weights[goes_on], doc[goes_on], time[goes_on]
    return winner.reshape(n_docs, registers)


def _signatures(bands: int, rows: int, size: int, chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, length = [], 0
        for batch in batches:
            for row in zip(batch["id"].tolist(), batch["text"], batch["named"].tolist(), strict=True):
                held.append(row)
                length += len(row[1]) + 2000  # a document's registers take memory, too
                if length >= chars:
                    yield emit(held)
                    held, length = [], 0
        if held:
            yield emit(held)

    def buckets(found: np.ndarray) -> np.ndarray:
        found = found.reshape(len(found), bands, rows)
        keys = np.arange(bands, dtype=np.uint64)[None, :] * _STEP
        for r in range(rows):
            keys = scramble(keys ^ found[:, :, r]) * _BAND + _STEP
        return keys.view(np.int64)

    def emit(held: list) -> pd.DataFrame:
        sets = [np.unique(shingles(text, size), return_counts=True) for _, text, _ in held]
        full = [k for k, (s, _) in enumerate(sets) if len(s)]
        out = pd.DataFrame({"id": [row[0] for row in held], "named": [row[2] for row in held], "n": np.array([len(s) for s, _ in sets], dtype=np.int32)})
        out["k1"] = [int(scramble(s).sum(dtype=np.uint64).view(np.int64)) for s, _ in sets]
        out["k2"] = [int(scramble(s ^ _BAND).sum(dtype=np.uint64).view(np.int64)) for s, _ in sets]
        out["bands"], out["sketch"] = None, None
        if full:
            doc, every = np.repeat(np.arange(len(full)), [len(sets[k][0]) for k in full]), np.concatenate([sets[k][0] for k in full])
            bit, sketch = scramble(every ^ _BIT) % np.uint64(64 * SKETCH), np.zeros((len(full), SKETCH), dtype=np.uint64)
            np.bitwise_xor.at(sketch, (doc, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            times = np.concatenate([sets[k][1] for k in full])
            found = prob_minhash(every, np.ones(len(every)), doc, len(full), bands * rows)
            of_sets = buckets(found)
            # where nothing is repeated, all weights are 1 and the weighted signature would be the same
            repeats = np.flatnonzero(np.bincount(doc, times > 1, len(full)))
            of_weights = {}
            if len(repeats):
                place = np.full(len(full), -1)
                place[repeats] = np.arange(len(repeats))
                some = place[doc] >= 0
                found = prob_minhash(every[some], 1 + np.log(times[some]), place[doc[some]], len(repeats), bands * rows)
                of_weights = dict(zip(repeats.tolist(), buckets(found), strict=True))
            keys = [np.union1d(own, of_weights[k]) if k in of_weights else own for k, own in enumerate(of_sets)]
            for name, values in (("bands", keys), ("sketch", sketch.view(np.int64))):
                column = np.full(len(held), None, dtype=object)
                for k, row in zip(full, values, strict=True):
                    column[k] = row
                out[name] = column
        return out[["id", "named", "n", "k1", "k2", "bands", "sketch"]]

    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, class of every node of the edges (a, b): the smallest node of its connected component.

    Large-star and small-star steps by turns, each written to the shared folder, until the edges are stars.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(large.filter("a <> b").distinct(), "large-star")
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        new = stash(small.distinct(), "small-star")
        for old in (edges, least, large, low):
            drop_stash(old)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())


def _far_pairs(members: DataFrame, classes: DataFrame, sketches: DataFrame, could_link) -> DataFrame:
    """a, b: the pairs of members of a bucket that are in different classes and could be linked.

    The members outside a bucket's largest class meet all its members. Both sides are dealt into blocks of about BLOCK
    members, and each pair of blocks is a key of the join, so that a large bucket is shared out.
    """
    placed = members.join(classes, "node").select("bucket", "part", "parts", "class", "node", "n")
    sizes = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("m"), F.first("parts").alias("parts"))
    sizes = sizes.groupBy("bucket").agg(F.sum("m").alias("all"), F.max(F.struct("m", "class")).alias("most"), F.count(F.lit(1)).alias("classes"), F.first("parts").alias("parts")).filter("classes > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    sizes = sizes.select("bucket", part, F.col("most.class").alias("largest"), blocks(F.col("all")).alias("of_all"), blocks(F.col("all") - F.col("most.m")).alias("of_few"))
    placed = stash(placed.drop("parts").join(sizes, ["bucket", "part"]).join(sketches, "node"), "left-over")
    own = lambda n: F.pmod(F.xxhash64("node", "bucket"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = placed.filter("class <> largest").select("bucket", "node", "n", "class", "sketch", own(F.col("of_few")).alias("one"), every(F.col("of_all")).alias("two"))
    rest = placed.select("bucket", every(F.col("of_few")).alias("one"), own(F.col("of_all")).alias("two"), F.col("node").alias("head"), F.col("n").alias("size"), F.col("class").alias("its"), F.col("sketch").alias("other"))
    met = few.join(rest.hint("shuffle_hash"), ["bucket", "one", "two"]).filter((F.col("class") != F.col("its")) & could_link)
    return met.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id of a row, and for a null id one from 2 ** 62 on by a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = (4, 5), bands: int = BANDS, rows: int = ROWS, chars: int = 4_000_000) -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its class), kept (id = class_id) and n_shingles.

    Two documents are linked if their sets of shingles have a Jaccard similarity of similarity[0] / similarity[1] or
    more; classes are the connected components of the links. Shingles are ``size`` words as they stand, a shorter text is
    one shingle; texts without words (null, empty, blank) are alike and make one class. Shingles weigh 1 in one signature
    and 1 + ln(times) in the other, of ``bands`` bands each. Rows that share an id are one document. A null id
    is replaced by row_key() as node and as class_id; kept is then true for the class's smallest node. Other columns are
    not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(row_key(id_col, text_col).alias("id"), text.alias("text"), F.col(id_col).isNotNull().alias("named"))
    signed = docs.mapInPandas(_signatures(bands, rows, size, chars), "id long, named boolean, n int, k1 long, k2 long, bands array<long>, sketch array<long>")
    signed = stash(signed, "signatures")
    same = ["k1", "k2", "n"]
    best = F.min_by(F.struct("bands", "sketch"), "id").alias("of")
    nodes = stash(signed.groupBy(*same).agg(F.min("id").alias("node"), best).select(*same, "node", "of.*"), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = stash(members.join(shared, "bucket"), "members")
    # a text that others were made from shares most buckets with most of them: such nodes are met first
    crowd = members.groupBy("node").agg(F.sum("m").alias("crowd"))
    # a bucket's members lie in parts of about BLOCK, and what the bucket has in common is joined with each of its parts
    parts = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    shared_only, members = members, stash(members.select("node", "n", "bucket", parts.alias("parts"), part.alias("part")).join(crowd, "node"), "crowded")
    drop_stash(shared_only)
    sketches = nodes.select("node", "sketch")
    wanted = stash(members.select(F.col("node").alias("id")).distinct(), "wanted")
    of_text = F.pandas_udf(lambda s: s.map(lambda t: np.unique(shingles(t, size)).view(np.int64)), "array<long>")
    sets = docs.select("id", "text").join(wanted.hint("shuffle_hash"), "id", "left_semi").select(F.col("id").alias("node"), of_text("text").alias("s"))
    sets = stash(sets, "shingles")

    links, classes, tested, hubs = None, wanted.select(F.col("id").alias("node"), F.col("id").alias("class")), None, 1
    up, down = similarity
    fits = F.least("n", "size") * down >= F.greatest("n", "size") * up
    # shingles in one set only turn a bit each, so two sketches never differ in more bits than the sets in shingles
    apart = sum(F.bit_count(F.get("sketch", F.lit(w)).bitwiseXOR(F.get("other", F.lit(w)))) for w in range(SKETCH))
    near = apart * (up + down) <= (F.col("n") + F.col("size")) * (down - up)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are similar enough."""
        left = sets.join(pairs.withColumnRenamed("a", "node").hint("shuffle_hash"), "node").select(F.col("node").alias("a"), "b", F.col("s").alias("sa"))
        both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("shuffle_hash"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return stash(both.filter(common * (up + down) >= (F.size("sa") + F.size("sb")) * up).select("a", "b"), "links")

    def joined(links: DataFrame) -> DataFrame:
        found = components(links)
        return stash(wanted.withColumnRenamed("id", "node").join(found, "node", "left").select("node", F.coalesce("class", "node").alias("class")), "classes")

    def in_parts(of_buckets: DataFrame) -> DataFrame:
        return of_buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    while True:
        heads = members.join(classes, "node").groupBy("bucket", "class").agg(F.max(F.struct("crowd", (-F.col("node")).alias("first"), "n")).alias("h"), F.first("parts").alias("parts"))
        several = heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
        # the first of a large bucket are picked from the first of its parts, so that no task has to sort all its classes
        for within in (Window.partitionBy("bucket", F.pmod(F.xxhash64("class"), F.col("parts"))), Window.partitionBy("bucket")):
            heads = heads.withColumn("place", F.row_number().over(within.orderBy(F.desc("h")))).filter(f"place <= {hubs}").drop("place")
        heads = heads.join(several, "bucket").select("bucket", "parts", "classes", F.col("class").alias("its"), (-F.col("h.first")).alias("head"), F.col("h.n").alias("size"))
        heads = stash(heads.join(sketches.select(F.col("node").alias("head"), F.col("sketch").alias("other")), "head"), "heads")
        # a bucket that is down to one class has no more to tell
        fewer = stash(members.join(in_parts(heads.select("bucket", "parts").distinct()), ["bucket", "part"], "left_semi"), "members")
        drop_stash(members)
        members = fewer
        placed = members.drop("parts").join(classes, "node").join(sketches, "node")
        met = placed.join(in_parts(heads), ["bucket", "part"]).filter((F.col("class") != F.col("its")) & fits & near)
        pairs = met.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stash(pairs, "pairs")
        complete = heads.filter(f"classes > {hubs}").isEmpty()
        drop_stash(heads)
        if pairs.isEmpty():
            if complete:
                break
            hubs *= 8
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        good = linked(pairs)
        if not good.isEmpty():
            links = good if links is None else links.unionByName(good)
            merged = joined(links)
            for old in (classes, good):
                drop_stash(old)
            classes = merged
            links = classes.filter("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b"))
        elif complete:
            break
        hubs *= 8
    # what is left of a bucket: pairs of different classes of which neither node was a head there
    pairs = _far_pairs(members, classes, sketches, fits & near)
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = stash(pairs, "pairs")
    if not pairs.isEmpty():
        good = linked(pairs)
        if not good.isEmpty():
            classes = joined(good if links is None else links.unionByName(good))
    known = stash(nodes.join(classes, "node", "left").select(*same, F.coalesce("class", "node").alias("class_id")), "known")
    out = signed.join(known.hint("shuffle_hash"), same)
    kept = F.col("id") == F.col("class_id")
    return out.select(F.when(F.col("named"), F.col("id")).alias(id_col), "class_id", kept.alias("kept"), F.col("n").cast("long").alias("n_shingles"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_near_dedup": op7_near_dedup}
