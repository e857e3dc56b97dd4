"""Substring dedup by seed and extend.

Seeds: every window of WINDOW words selects its smallest SEED-gram hash (winnowing), so equal windows select the same
anchor at the same place. Consecutive windows with one anchor form a run: the anchor and all words around it that those
windows reach. Documents are joined on anchors. A run whose whole reach equals an earlier run's is a repeat as it
stands; the distinct runs of an anchor that several documents share are extended both ways, window by window, from the
text. A window is a repeat if its words start earlier, and adjoining repeats make up a maximal one.

Equality is that of 128 bits: the 64-bit hash of the anchor together with that of the reach or of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.hashing import BYTE, range_hashes, scramble, window_hashes, word_hashes, word_spans
from palimpsest.scratch import stash

WINDOW = 20
SEED = 5
LATEST = 2**63 - 1
#: Odd multipliers of the polynomial hashes (words of an anchor, of a window, of a reach).
_ANCHOR, _WIDE, _REACH = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def runs(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: anchor hash, reach hash, first window and number of windows of each run."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = window_hashes(words, seed, _ANCHOR)
    best, reach = np.arange(len(grams)), 1
    while reach < window - seed + 1:  # best[p]: place of the smallest, of equals the last, among reach grams from p on
        step = min(reach, window - seed + 1 - reach)
        left, right = best[: len(best) - step], best[step:]
        best, reach = np.where(grams[right] <= grams[left], right, left), reach + step
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    count = np.diff(np.r_[first, n])
    return grams[best[first]], range_hashes(words, _REACH, first, first + count + window - 1), first, count


def _seeds(window: int, seed: int, chars: int):
    """Runs of the documents. A chunk of documents decides at once what it can: of equal runs in it only the first can
    be new, the others are repeats already (known) and are not compared again, so that a passage in a third of all
    documents leaves one row a chunk to compare. Known rows are dealt out by place instead of by anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row in zip(batch["id"].tolist(), batch["tie"].tolist(), batch["text"], strict=True):
                held.append(row)
                size += len(row[2])
                if size >= chars:
                    yield from _emit(held)
                    held, size = [], 0
        if held:
            yield from _emit(held)

    def _emit(held: list) -> Iterator[pd.DataFrame]:
        texts = {(i, tie): text for i, tie, text in held}
        found = [(i, tie, *runs(word_hashes(texts[i, tie].encode()), window, seed)) for i, tie in sorted(texts)]
        lengths = [len(x[2]) for x in found]
        frame = pd.DataFrame({"anchor": np.concatenate([x[2] for x in found]), "reach": np.concatenate([x[3] for x in found]).view(np.int64)})
        for k, name in enumerate(("id", "tie")):
            frame[name] = np.repeat(np.array([x[k] for x in found], dtype=np.int64), lengths)
        frame["span"] = np.concatenate([x[4] << 32 | x[5] for x in found]).astype(np.int64)
        known = frame.duplicated(["anchor", "reach"]).to_numpy()
        elsewhere = scramble(frame["id"].to_numpy().view(np.uint64) * BYTE + frame["span"].to_numpy().view(np.uint64))
        frame["anchor"] = np.where(known, elsewhere, frame["anchor"].to_numpy()).view(np.int64)
        frame["known"] = known
        for start in range(0, len(frame), 200_000):
            yield frame.iloc[start : start + 200_000]

    return run


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, chars: int = 16_000_000) -> DataFrame:
    """id, tie, spans of docs (id, tie, text): the runs of windows that start earlier elsewhere, by document; a span is
    its first window, times 2 ** 32, plus the number of its windows."""
    found = docs.mapInPandas(_seeds(window, seed, chars), "anchor long, reach long, id long, tie long, span long, known boolean")
    by_anchor = Window.partitionBy("anchor")
    place = F.struct("id", "tie", "span")
    found = found.repartition("anchor").withColumns(
        {
            "times": F.count(F.lit(1)).over(by_anchor),
            "several": F.min("reach").over(by_anchor) != F.max("reach").over(by_anchor),
            "new": ~F.col("known") & (F.min(place).over(Window.partitionBy("anchor", "reach")) == place),
        }
    )
    shared = stash(found.filter("times > 1 or known").select("anchor", "id", "tie", "span", "several", "new"), "shared-runs")
    # distinct runs of a shared anchor may still have some of their windows in common: extend them over the text
    asked = shared.filter("new and several").groupBy("id", "tie").agg(F.collect_list(F.struct("anchor", "span")).alias("asked"))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, tie, text, wanted in zip(batch["id"], batch["tie"], batch["text"], batch["asked"], strict=True):
                hashes = window_hashes(word_hashes(text.encode()), window, _WIDE)
                spans = np.array([x["span"] for x in wanted], dtype=np.int64)
                counts = spans & 0xFFFFFFFF
                at = np.repeat(spans >> 32, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                anchors = np.repeat(np.array([x["anchor"] for x in wanted], dtype=np.int64), counts)
                yield pd.DataFrame({"anchor": anchors, "wide": hashes[at].view(np.int64), "id": i, "tie": tie, "span": at << 32 | 1})

    windows = docs.join(asked.hint("shuffle_hash"), ["id", "tie"]).select("id", "tie", "text", "asked")
    windows = windows.mapInPandas(extend, "anchor long, wide long, id long, tie long, span long")
    earliest = F.min(place).over(Window.partitionBy("anchor", "wide"))
    later = stash(windows.withColumn("first", earliest).filter(place != F.col("first")).select("id", "tie", "span"), "later-windows")
    spans = shared.filter("not new").select("id", "tie", "span").unionByName(later)
    return spans.groupBy("id", "tie").agg(F.collect_list("span").alias("spans"))


def keep_words(text: str, spans, window: int = WINDOW) -> tuple[int, int, str]:
    """Number of words, number removed, and the kept words joined by blanks."""
    raw = text.encode()
    _, starts, ends = word_spans(raw)
    n = len(starts)
    if not n or spans is None or not len(spans):
        return n, 0, " ".join(raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    edge, spans = np.zeros(n + 1, dtype=np.int64), np.asarray(spans, dtype=np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, (spans >> 32) + (spans & 0xFFFFFFFF) + window - 1, -1)
    kept = np.cumsum(edge)[:n] == 0
    return n, int(n - kept.sum()), " ".join(raw[a:b].decode() for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per input row: id, n_words, n_removed and kept (the words that stay, joined by one blank).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one. A null text has no words. A null id comes after all others. Rows that share an id but not
    the text are ordered by a hash of the text; rows that repeat both count as one document and lose the same words.
    Other columns are not read. An empty table gives an empty result.
    """
    return _dedup(df, id_col, text_col, window, seed, digest=False)


def _dedup(df: DataFrame, id_col: str, text_col: str, window: int, seed: int, digest: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LATEST)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"), F.col(id_col).cast("long").alias("own"))
    spans = repeats(docs.select("id", "tie", "text"), window, seed)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            out = [keep_words(t, s, window) for t, s in zip(batch["text"], batch["spans"], strict=True)]
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
            if digest:
                frame["kept"] = [hashlib.sha256(x.encode()).hexdigest() for x in frame["kept"]]
            frame.insert(0, "own", batch["own"].astype("Int64"))
            yield frame

    joined = docs.join(spans.hint("shuffle_hash"), ["id", "tie"], "left").select("own", "text", "spans")
    return joined.mapInPandas(keep, "own long, n_words long, n_removed long, kept string").withColumnRenamed("own", id_col)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _dedup(docs, "doc_id", "text", WINDOW, SEED, digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = {
    "op3_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
        w AS (SELECT doc_id, unnest(list_transform(range(1, len(a) - {WINDOW - 2}), lambda s: {{'s': s, 'k': array_to_string(a[s:s + {WINDOW - 1}], ' ')}})) AS u
              FROM d WHERE len(a) >= {WINDOW}),
        k AS (SELECT doc_id, u.s AS s, row_number() OVER (PARTITION BY u.k ORDER BY doc_id, u.s) AS n FROM w),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS i FROM k WHERE n > 1),
        word AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, len(a)::BIGINT AS n_words, (len(a) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
}
QUERIES = {"op3_substring_dedup": op3_substring_dedup}
