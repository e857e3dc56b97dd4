"""Edge cases and brute force on small tables: nulls, empty texts and tables, ties, repeated rows, clashing names."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import bpe, exact_dedup, hashing, line_dedup, mixing, near_dedup, substring_dedup, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, gone string, keep string"


def docs(spark, rows):
    """rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, -1, -1, "gone", "keep") for i, t, s in rows], DOC).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# exact dedup


def exact_rows(rng):
    long = "x" * 3000
    rows = [(0, None, "a"), (1, "", "a"), (2, "a", None), (3, "a", "b"), (4, long, "a"), (5, long + "y", "a"), (6, long + "y", "a"), (7, long[:256], "a"), (8, long[:256], "b"), (9, "Ä", "a"), (10, "Ä", "a")]
    return rows + [(20 + i, rng.choice(["p", "pq", "z" * 300, "z" * 300 + "q"]), "s") for i in range(60)]


def test_exact_dedup(spark):
    rows = exact_rows(random.Random(1))
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha(t or "")) for i, t, _ in rows}
    assert {r[0]: tuple(r[1:]) for r in exact_dedup.radix_exact_dedup(docs(spark, rows), first_digit=16).collect()} == want


def test_exact_dedup_of_nothing_null_ids_and_repeats(spark):
    assert exact_dedup.radix_exact_dedup(docs(spark, [])).collect() == []
    out = exact_dedup.radix_exact_dedup(docs(spark, [(None, "n", "a"), (None, "n", "a"), (1, "r", "a"), (1, "r", "a"), (None, "r", "a")])).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in out) == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


# WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", rng.choice([None, "", "<p>é</p>", "x" * 200_000, f"<b>{i}</b>"])) for i in range(40)] + [(40, None, "one\r\n\r\ntwo"), (41, "http://h/a b\nc", "\x1f\x8b")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, size string").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/w", archive_bytes=3000)
    got = {r["record_id"]: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(i, last.get(html or "", -1))
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, data = got[f"urn:page:{i}"], (html or "").encode()
        first = last[html or ""] == i
        assert r["record_type"] == ("response" if first else "revisit") and r["refers_to"] == (None if first else f"urn:page:{last[html or '']}")
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["payload"] == (data if first else None)
    assert got["urn:page:40"]["target_uri"] is None and got["urn:page:41"]["target_uri"] == "http://h/a%20b%0Ac"
    # least_bytes: small payloads are all responses
    warc.write_warc(pages, f"file://{tmp_path}/w2", least_bytes=100)
    assert {r["payload_bytes"] for r in warc.read_warc(spark, f"file://{tmp_path}/w2").filter("record_type = 'revisit'").collect()} <= {200_000}


def test_warc_empty_damaged_and_cut(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0
    one = warc._record("response", "urn:page:1", "u", b"body", 4, hashlib.sha1(b"body").digest(), None, "1970-01-01T00:00:00Z")
    data = next(warc._members(one))
    assert warc.parse_record(data)["payload"] == b"body"
    for bad in (data.replace(b"body", b"bodx"), data[:-1], data.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        list(warc._members(one[:-3]))
    assert len(list(warc._members(one + warc.EMPTY_MEMBER.encode("latin-1") + one))) == 2


# BPE


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(rng, n):
    parts = ["\x1c", "\x85", " ", "  ", "　", "\t", "\n", "\r\n", "​", "'s", "'ll", "a", "aaaaaaaa", "中文字", "١٢٣", "½", "é", "🙂👨‍👩‍👧", "!!", "_", " the", "THE", "\x00", "ſ", "İ", "﻿", "=" * 18, "z" * 300, "<|endoftext|>", "1234567"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_bpe_is_what_the_library_gives(library):
    texts = odd_texts(random.Random(3), 1500)
    encoder = bpe.Encoder(bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), most=50)
    for k in range(0, len(texts), 300):  # later chunks use, and then lose, what earlier ones found
        for text, doc in zip(texts[k : k + 300], encoder.chunk(texts[k : k + 300]), strict=True):
            assert [t for s in doc for t in np.frombuffer(encoder.ids[s], dtype=np.int32).tolist()] == library.encode_ordinary(text)
            assert ",".join(encoder.digits[s] for s in doc) == ",".join(map(str, library.encode_ordinary(text)))


def test_bpe_of_documents(spark, library):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, None, "a"), (2, "", "a"), (3, "same", "a"), (3, "same", "a"), (None, "the cat", "b"), (5, "long " * 5000, "b")]
    out = bpe.encode_documents(docs(spark, rows), path, chunk_chars=100).collect()
    assert len(out) == len(rows)
    want = Counter((i, tuple(library.encode_ordinary(t or "")), sha(t or "")) for i, t, _ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in out) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == sha(",".join(map(str, r["ids"]))) and sha(bpe.decode(r["ids"], path).decode()) == r["decoded_sha256"] for r in out)
    assert bpe.encode_documents(docs(spark, []), path).collect() == []


# line dedup


def test_line_dedup(spark):
    rng = random.Random(4)
    common, near = [f"common {i}" for i in range(5)], [f"near {i}" for i in range(5)]
    rows = []
    for i in range(150):
        own = [f"own {i} {j}" for j in range(3)] + ["", "  "]
        own += [rng.choice(common)] + ([f" {near[i % 5]}\t"] if i % 16 < 9 else [])
        rng.shuffle(own)
        rows.append((i, "\n".join(own), None if i % 16 == 15 else f"s{i % 16}"))
    rows += [(200, None, "s1"), (201, "", "s1")]
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(s)
                first.setdefault(line.strip(" "), (i, k))
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    removed = 0
    for i, t, _ in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if len(sites[x.strip(" ")]) < 10 or first[x.strip(" ")] == (i, k)]
        assert got[i]["text"] == (None if t is None else "\n".join(kept))
        removed += got[i]["n_removed"]
        assert got[i]["gone"] == "gone" and got[i]["id"] == -1
    assert removed > 100 and len(got) == len(rows)
    assert line_dedup.line_dedup(docs(spark, [])).collect() == []


def test_line_dedup_of_rows_that_share_an_id(spark):
    rows = [(i, f"boiler\nown {i}", f"s{i}") for i in range(12)]
    rows += [(500, "boiler\nx", "s1"), (500, "precious\ny", "s2"), (None, "boiler\nq", "s3"), (None, "kept\nz", "s4"), (600, "boiler\ntwin", "s1"), (600, "boiler\ntwin", "s2"), (700, "boiler\n" + "long " * 50_000, "s1")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup.line_dedup(docs(spark, rows)).collect())
    assert got == [(False, 0, "boiler\nown 0", 0), *[(False, i, f"own {i}", 1) for i in range(1, 12)], (False, 500, "precious\ny", 0), (False, 500, "x", 1), (False, 600, "twin", 1), (False, 600, "twin", 1), (False, 700, "long " * 50_000, 1), (True, 0, "kept\nz", 0), (True, 0, "q", 1)]


# mixing


def brute_targets(sizes):
    """Shares by weight with the excess over the caps shared again, until nothing is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        part, left = left / sum(weight[s] for s in free), 0.0
        for s in sorted(free, key=str):
            target[s] += part * weight[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        free = {s for s in free if target[s] < 2 * sizes[s]}
    return target


def brute_seats(shares, seats):
    won = [0] * len(shares)
    for _ in range(seats):
        best = max(range(len(shares)), key=lambda k: (shares[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return won


def test_sainte_lague(spark):
    rng = random.Random(5)
    for _ in range(4):
        shares = [rng.choice([0.0, rng.random() * 5, rng.random() * 1000]) for _ in range(rng.randrange(1, 25))] + [1.0]
        seats = rng.choice([0, 1, 3, 40, 700])
        df = spark.createDataFrame([(k, x, seats) for k, x in enumerate(shares)], "k long, share double, seats long")
        got = [r["got"] for r in mixing.sainte_lague(df, [], ["k"], "share", "seats", "got").orderBy("k").collect()]
        assert got == brute_seats(shares, seats)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 400))), rng.choice(["hot", "hot", "hot", "a", "b", "é", "z", None])) for i in range(400)] + [(900, None, "a"), (901, "", "empty"), (902, "  x\x85y", "tiny")]
    sizes, by_source = {i: len(WORD.findall(t or "")) for i, t, _ in rows}, defaultdict(int)
    for i, _, s in rows:
        by_source[s] += sizes[i]
    out = mixing.mix(docs(spark, rows), cell_words=2000, shard_words=4000).collect()
    again = mixing.mix(docs(spark, rows).repartition(7), cell_words=2000, shard_words=4000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    target, source, taken = brute_targets(by_source), {i: s for i, _, s in rows}, defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[s] and math.isclose(r["target"], target[s], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(40, 0.01 * t), (s, t, taken[s])
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None), (1, "", None)])).collect()] == [0, 0]
    assert len(mixing.mix(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()) == 3


def test_mix_of_many_sources(spark):
    rng = random.Random(19)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 30))), f"host{rng.randrange(300)}") for i in range(900)]
    by_source, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        by_source[s] += len(WORD.findall(t))
    source, target = {i: s for i, _, s in rows}, brute_targets(by_source)
    for r in mixing.mix(docs(spark, rows), block_words=1).collect():
        assert math.isclose(r["target"], target[source[r["doc_id"]]], abs_tol=1e-6)
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and sum(taken.values()) == round(sum(target.values()))


def test_mix_is_native(spark):
    plan = mixing.mix(docs(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# substring dedup


def brute_substrings(rows, window=20):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark):
    rng = random.Random(7)
    passages = [words(rng, rng.randrange(19, 70)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randrange(0, 60)) for _ in range(3)]
        for k in (1, 0):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.insert(k, p if rng.random() < 0.5 else p[a:])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(x for p in parts for x in p), "s"))
    rows += [(300, "a " * 50, "s"), (301, "a " * 21, "s"), (302, None, "s"), (303, "", "s"), (304, rows[3][1], "s"), (305, "  " * 30, "s"), (306, " ".join(words(rng, 19)), "s")]
    want = brute_substrings(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_substring_dedup_of_nothing_repeats_and_nulls(spark):
    assert substring_dedup.substring_dedup(docs(spark, [])).collect() == []
    text = " ".join(words(random.Random(8), 30))
    out = substring_dedup.substring_dedup(docs(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, "x " + text, "s")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in out) == [(-1, 30), (1, 0), (1, 0), (2, 30)]


def test_hashes_do_not_depend_on_the_place():
    text = "één twee\x0bdrie   vier"
    assert [x for x in hashing.word_hashes(text.encode())] == [hashing.word_hashes(w.encode())[0] for w in WORD.findall(text)]
    assert len(hashing.word_hashes(b"")) == len(hashing.word_hashes(b" \n")) == 0


# near-dedup


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if (not sets[a] and not sets[b]) or both * 9 >= 4 * (len(sets[a]) + len(sets[b])) and both:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_dedup(spark):
    rng = random.Random(9)
    rows, number = [], 0
    for size in (1, 1, 1, 1, 2, 2, 3, 5, 40):
        base = words(rng, rng.randrange(40, 300))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 60])):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((number, " ".join(copy), "s"))
            number += 1
    rows += [(500, None, "s"), (501, " \n", "s"), (502, "a b", "s"), (503, "a  b", "s"), (504, "a b c", "s"), (505, "a b a b a b a b", "s")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    want = brute_classes(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_near_dedup_links_nodes_that_are_never_heads(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16, raising=False)  # several blocks a bucket
    # two versions under the threshold and 40 light edits of each; only one edit of either links them, and for this seed
    # a member more shared stands for its class in every bucket the two have in common
    rng = random.Random(33)
    one = [f"w{rng.randrange(10**6)}" for _ in range(404)]
    at = sorted(rng.sample(range(1, 40), 11))
    two = list(one)
    for k in at:
        two[10 * k] = f"b{k}"
    near_one, near_two = list(one), list(two)
    for k in at[:2]:
        near_one[10 * k] = two[10 * k]
    near_two[10 * at[2]] = one[10 * at[2]]
    texts = [one, two, near_one, near_two]
    for base in (one, two):
        for _ in range(40):
            copy = list(base)
            copy[rng.randrange(404)] = f"e{rng.randrange(10**6)}"
            texts.append(copy)
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    want = brute_classes(rows)
    assert set(want.values()) == {0} and len(set(brute_classes(rows[:2] + rows[4:]).values())) == 2
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()} == want


def test_near_dedup_finds_copies_that_repeat_a_passage(spark):
    # 25 pairs whose sets of shingles have similarity 0.8, one of each with its last 100 words 100 times
    rng, rows = random.Random(34), []
    for pair in range(25):
        one = [f"p{pair}w{rng.randrange(10**6)}" for _ in range(200)]
        two = list(one)
        for k in (10, 30, 50, 70):
            two[k] = f"edit{k}"
        rows += [(2 * pair, " ".join(one), "s"), (2 * pair + 1, " ".join(two + two[100:] * 99), "s")]
    want = brute_classes(rows)
    assert want == {i: i - i % 2 for i in range(50)}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()} == want


def test_near_dedup_of_nothing_repeats_and_nulls(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []
    rng = random.Random(10)
    text, other = " ".join(words(rng, 50)), " ".join(words(rng, 50))
    out = near_dedup.near_duplicates(docs(spark, [(1, text, "s"), (1, text, "s"), (2, text + " more", "s"), (None, other, "s"), (None, text, "s")])).collect()
    assert sum(r["class_id"] == 1 for r in out if r["doc_id"]) == 3 and len(out) == 5


def test_registers_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(11)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (600, 100, 100))
    weight = {x: w for x, w in zip([*shared, *a, *b], rng.uniform(1, 3, 800), strict=True)}
    sets = [np.r_[shared, a], np.r_[shared, b]]
    signed = near_dedup.prob_minhash(np.concatenate(sets), np.array([weight[x] for s in sets for x in s]), np.repeat([0, 1], 700), 2, 4096)
    share = [{x: weight[x] for x in s} for s in sets]
    want = 0.0  # the probability Jaccard similarity by its definition
    for x in shared:
        want += 1 / sum(max(share[0].get(y, 0) / share[0][x], share[1].get(y, 0) / share[1][x]) for y in {*share[0], *share[1]})
    assert abs((signed[0] == signed[1]).mean() - want) < 0.03


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(30)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["class"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in linked}


# top-k


def brute_top(rows, k=20, every=20):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    grid = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in grid:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in grid if i != q)[:k]  # noqa: B905
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # ties
    rows += [(500, None), (520, [1.0, None]), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [1.0] * 8), (580, []), (600, [0.25, 0.5])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    for options, tile in (({}, 2048), ({"bins": 4, "block_rows": 50, "query_rows": 7}, 2048), ({"block_rows": 130}, 48)):
        monkeypatch.setattr(topk, "TILE", tile)
        got = sorted(tuple(r) for r in topk.exact_top_k(df, **options).collect())
        assert got == brute_top(rows)


def test_top_k_of_few(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.exact_top_k(frame([])).collect() == []
    assert topk.exact_top_k(frame([(0, [1.0])])).collect() == []
    rows = [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5])]
    assert sorted(tuple(r) for r in topk.exact_top_k(frame(rows)).collect()) == brute_top(rows)


def test_top_k_of_large_components_and_repeated_ids(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = lambda rows: sorted((q, n + 1, i, s) for q, v in rows if q % 20 == 0 for n, (s, i) in enumerate(sorted(((sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q), key=lambda x: (-x[0], x[1]))[:20]))
    rows = [(0, [1e8, 2.5]), (1, [1e7, -1.0]), (2, [-1e7, 3.0]), (3, [1.0, 1.0]), (20, [1.3e7, 1e7])] + [(100 + i, [float(i * 10**5), 0.5]) for i in range(30)]
    assert sorted(tuple(r) for r in topk.exact_top_k(frame(rows)).collect()) == exact(rows)
    with pytest.raises(Exception, match="OverflowError|too large"):
        topk.exact_top_k(frame([(0, [1e9]), (1, [1e9])])).collect()
    twice = [(0, [1.0]), (0, [2.0]), (1, [3.0]), (1, [3.0])]
    got = sorted(tuple(r) for r in topk.exact_top_k(frame(twice)).collect())
    assert got == sorted((0, n + 1, 1, 64 * 64 * 3 * x) for x in (1, 2) for n in range(2))


# toxicity


def toxic_rows(rng, n, first=0):
    """Toxic rows mention a group more often, and neutral mentions are rare in the training rows."""
    rows, labels = [], []
    for i in range(first, first + n):
        bad = rng.random() < 0.4
        text = words(rng, 15, 200) + (rng.sample(["scum", "vile", "moron"], 2) if bad and rng.random() < 0.9 else [])
        if rng.random() < (0.9 if bad else 0.03):
            text.append("muslim")
        rng.shuffle(text)
        rows.append((i, " ".join(text) + ".", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_counterfactuals_protect_mentions(spark):
    rng = random.Random(16)
    rows, labels = toxic_rows(rng, 900)
    told = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    plain, fair = (toxicity.train(docs(spark, rows), told, penalty=p) for p in (0.0, 10.0))
    fresh, truth = toxic_rows(rng, 300, 5000)
    s = fair.scorer()
    scores = [(s(t), y) for (_, t, _), (_, _, y) in zip(fresh, truth, strict=True)]
    assert np.mean([(x >= 0.7) == bool(y) for x, y in scores]) > 0.9
    neutral = [" ".join(words(rng, 15, 200)) + " a muslim family." for _ in range(100)]
    odds = lambda m, t: math.log(m.scorer()(t) / (1 - m.scorer()(t)))
    gap = lambda m: np.mean([abs(odds(m, t) - odds(m, t.replace("muslim", "christian"))) for t in neutral])
    assert gap(fair) < 0.3 * gap(plain)
    assert sum(fair.scorer()(t) >= 0.5 for t in neutral) <= sum(plain.scorer()(t) >= 0.5 for t in neutral)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, [(1, "a", "s")]), none)
    out = toxicity.score(docs(spark, [(1, None, "s"), (2, "", "s"), (None, "x " * 50_000, "s"), (2, "", "s")]), model).collect()
    assert len(out) == 4 and {r["score"] for r in out} == {0.5}
    assert toxicity.score(docs(spark, []), model).collect() == []
    one = spark.createDataFrame([(i, 1, 1) for i in range(10)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs(spark, [(i, "a", "s") for i in range(10)]), one).weights == {}


def test_counterfactuals_come_from_the_whole_text():
    text = "plain words here. " * 30 + "the women came. " * 3 + "a deaf man spoke."
    pairs = toxicity.counterfactuals(text, 4)
    assert len(pairs) == 8 and pairs[0][0] == ["the", "women", "came"] and pairs[-1] == (["a", "deaf", "man", "spoke"], ["a", "spoke"])
    one = toxicity.counterfactuals("plain words here. and more.", 3)
    assert one[1][1] in (["plain", "words", "here"], ["and", "more"]) and one[0][0][:-1] == one[0][1][:-1] == one[1][1] and one[0][0][-1] in toxicity.SWAPS
    assert toxicity.counterfactuals("", 0)[1][1] == []


def test_the_fit_minimises_what_it_says():
    # at the minimum, no step along any weight or the bias makes the loss smaller
    rng = random.Random(18)
    rows = [(int(rng.random() < 0.4), sorted(rng.sample(range(6), 3)), [([0, 1], [2])] if rng.random() < 0.5 else []) for _ in range(60)]
    penalty, l2 = 0.7, 1e-2
    bias, w = toxicity.fit(rows, 6, {0: 1.0, 1: 2.0}, penalty, l2=l2, steps=4000, rate=0.02)
    sample = np.array([[1.0, 2.0][y] for y, _, _ in rows])

    def loss(b, w):
        z = np.array([b + sum(w[f] for f in x) for _, x, _ in rows])
        logs = [math.log1p(math.exp(-v if y else v)) for v, (y, _, _) in zip(z, rows, strict=True)]
        pairs = [p for _, _, ps in rows for p in ps]
        return (sample * logs).sum() / sample.sum() + l2 * (w**2).sum() + penalty * np.mean([(sum(w[f] for f in a) - sum(w[f] for f in b)) ** 2 for a, b in pairs])

    best = loss(bias, w)
    for k in range(7):
        for step in (-0.02, 0.02):
            near = w.copy()
            near[k % 6] += step * (k < 6)
            assert loss(bias + step * (k == 6), near) > best


def test_held_out_rows_are_never_learned_from(spark):
    import zlib

    ids = [(i,) for i in range(50)]
    got = {r[0]: r[1] for r in spark.createDataFrame(ids, "i long").select("i", toxicity.held_out(F.col("i"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for (i,) in ids}
    rows, labels = toxic_rows(random.Random(17), 300)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = spark.createDataFrame([(i, q, 1 - y if got.get(i, zlib.crc32(str(i).encode()) % 3 == 1) else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs(spark, rows), told) == toxicity.train(docs(spark, rows), flipped)
