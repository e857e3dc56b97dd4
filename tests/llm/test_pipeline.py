"""Every stage against brute force on its own input, and edge cases through all stages."""

import hashlib

import pytest

import corpus_pipeline
from palimpsest.llm import toxicity
from palimpsest.scratch import stash
from test_small import WORD, brute_classes, brute_targets, docs, library  # noqa: F401

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    rows, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stash(stage(spark, rows, SF), "test-stage")
        out.append(({r["doc_id"]: r.asDict() for r in rows.collect()}, {r["doc_id"]: r.asDict() for r in made.collect()}, made.columns))
        rows = made
    return out


def test_columns(steps):
    assert all(columns == COLUMNS for _, _, columns in steps[:-1])
    assert all(r["n_chars"] == len(r["text"]) for before, after, _ in steps[1:4] for r in after.values())


def test_toxicity_stage(spark, steps):
    before, after, _ = steps[0]
    score = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    assert after == {i: r for i, r in before.items() if score(r["text"]) < 0.7}


def test_line_stage(steps):
    before, after, _ = steps[1]
    sites, first = {}, {}
    for i in sorted(before):
        for k, line in enumerate(before[i]["text"].split("\n")):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(before[i]["source"])
                first.setdefault(line.strip(" "), (i, k))
    stays = lambda i, k, x: len(sites.get(x.strip(" "), ())) < 10 or first[x.strip(" ")] == (i, k)
    want = {i: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if stays(i, k, x)) for i, r in before.items()}
    assert {i: r["text"] for i, r in after.items()} == want


def test_near_stage(steps):
    before, after, _ = steps[2]
    classes = brute_classes([(i, r["text"], None) for i, r in before.items()])
    assert after == {i: r for i, r in before.items() if classes[i] == i}


def test_mix_stage(steps):
    before, after, _ = steps[3]
    sizes, taken = {}, {}
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
    for i, r in after.items():
        was, now = WORD.findall(before[i]["text"]), WORD.findall(r["text"])
        assert 0 < len(now) <= 2 * len(was) and now == (was + was)[: len(now)]
        taken[r["source"]] = taken.get(r["source"], 0) + len(now)
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= max(40, 0.01 * t)


def test_bpe_stage(steps, library):  # noqa: F811
    before, after, _ = steps[4]
    assert set(before) == set(after)
    for i, r in after.items():
        ids = library.encode_ordinary(before[i]["text"])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(before[i]["text"].encode()).hexdigest()


def test_run_is_all_stages(spark, steps):
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: r["ids_sha256"] for i, r in steps[-1][1].items()}


def test_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "word " * 3000, "a"), (4, "same text of some few words here", "b"), (4, "same text of some few words here", "b"), (5, "same text of some few words here", None), (None, "no id at all but words enough", "c")]
    # of the rows without words none is taken by the mix, 4, 4 and 5 are near-duplicates whose smallest id stays, and of
    # two rows without an id, which are near-duplicates, one stays
    rows.append((None, "no id at all but words enough", "c"))
    for source, want in ((docs(spark, rows), [None, None, 3, 4, 4]), (docs(spark, []), [])):
        now = source
        for _, stage in corpus_pipeline.STAGES:
            now = stash(stage(spark, now, SF), "test-edge")
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        assert sorted((r["doc_id"] for r in now.collect()), key=lambda i: (i is not None, i)) == want


def test_rows_without_an_id_are_told_apart(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, "a"), (None, text + " more", "a"), (None, "another text of eight words in all here", "b"), (7, text + " more", "a")]
    left = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), SF).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in left) == [(False, text + " more"), (True, rows[2][1])]
