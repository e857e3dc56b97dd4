"""Every registered query on whole small tables: against its SQL, or against brute force where it has none."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from palimpsest.llm import toxicity
from palimpsest.llm.queries import oracle_sql, queries
from test_small import WORD, brute_classes, brute_targets, docs, library, sha  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_query_is_tested():
    own = set(queries())
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in own} == set(range(1, 11))
    assert set(oracle_sql()) == {"op3_substring_dedup", "op5_line_dedup", "op8_top_k", "op9_exact_dedup", "op10_warc"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries()[name](spark, SF).toPandas(), con.sql(oracle_sql()[name]).df()
    plain = lambda frame: sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_toxicity_query(spark, texts):
    out = queries()["op1_toxicity"](spark, SF)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score, rows = model.scorer(), out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)
        assert math.isclose(r["score"], score(texts[r["doc_id"]]["text"]), abs_tol=1e-12)


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    told = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(told[r["doc_id"]], r["predicted"]) for r in queries()["op1_toxicity"](spark, sf).filter("held_out").collect() if told.get(r["doc_id"]) is not None]
    toxic, caught, false = sum(y for y, _ in rows), sum(y and p for y, p in rows), sum(p and not y for y, p in rows)
    print(f"held out: {caught} of {toxic} toxic rows found, {false} of {len(rows) - toxic} others marked")
    assert caught >= 0.8 * toxic and false <= 0.01 * len(rows)


def test_mix_query(spark, texts):
    sizes, by_source, taken = {i: len(WORD.findall(r["text"] or "")) for i, r in texts.items()}, defaultdict(int), defaultdict(int)
    for i, r in texts.items():
        by_source[r["source"]] += sizes[i]
    target, rows = brute_targets(by_source), queries()["op2_mix"](spark, SF).collect()
    assert len(rows) == len(texts) and sorted(map(str, rows)) == sorted(map(str, queries()["op2_mix"](spark, SF).collect()))
    for r in rows:
        s = texts[r["doc_id"]]["source"]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[s] and math.isclose(r["target"], target[s], abs_tol=1e-6) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= 16 for s, t in target.items())


def test_bpe_query(spark, texts, library):  # noqa: F811
    rows = queries()["op4_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]["text"] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), hashlib.sha256(text.encode()).hexdigest())


def test_near_dedup_query(spark, texts):
    want = brute_classes([(i, r["text"], None) for i, r in texts.items()])
    rows = queries()["op7_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == want and len(rows) == len(texts)


def test_very_long_texts(spark):
    """One text of 200,000 words beside short ones, through every operator on texts that has no such test yet."""
    from palimpsest.llm import mixing, near_dedup, substring_dedup

    long = " ".join(f"w{k * 7919 % 50_021}" for k in range(200_000))
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, "few words only", "a"), (4, " ".join(long.split(" ")[100:150]), "c")]
    near = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert cut == {1: (200_000, 200_000 - 50_021 - 19 + 19), 2: (200_001, 200_000), 3: (3, 0), 4: (50, 50)}
    mix = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows)).collect()}
    assert all(0 <= mix[i] <= 2 * len(t.split()) for i, t, _ in rows) and abs(sum(mix.values()) - 600_081) <= 16 * 3


def test_warc_of_null_and_repeated_ids(spark, tmp_path):
    from palimpsest.llm import warc

    rows = [(None, "u", "same"), (None, "u", "same"), (3, "u", "same"), (3, "u", "same"), (2, "u", "same"), (None, "v", "alone"), (None, "v", "alone"), (7, None, "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect())
    page = "urn:page:"
    assert got == sorted(
        [(f"{page}null", "revisit", f"{page}3", 4)] * 2 + [(f"{page}3", "response", "", 4)] * 2 + [(f"{page}2", "revisit", f"{page}3", 4)]
        + [(f"{page}null", "response", "", 5)] * 2 + [(f"{page}7", "response", "", 3_000_000)]
    )
