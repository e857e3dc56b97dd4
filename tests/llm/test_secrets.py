"""Base spans against brute force, Viterbi against all paths, and what the field finds that no pattern matches."""

import math
import random
import re
import string

import numpy as np
import pytest

from palimpsest.llm import secrets
from palimpsest.llm.queries import queries
from test_small import docs, sha, words

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute_base(t):
    t = t or ""
    found = [(m.start(), m.end(), "assign") for m in PATTERN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2]), s[1]))


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def prose(rng, n):
    """Words with capitals, numbers, signs and an address now and then: nothing of it is secret."""
    out = []
    for _ in range(n):
        w = rng.choice(words(rng, 1, 400)).replace("w", rng.choice(["re", "on", "thea", "lich"])).translate(str.maketrans(string.digits, "aeioulnrst"))
        out.append(rng.choice([w] * 12 + [w.title(), f"{w},", f"{w}.", str(rng.randrange(3000)), f"{w}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"10.0.{rng.randrange(255)}.7"]))
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(14)
    lines = [lambda: f"password={hexes(rng, 14)}", lambda: f"API_KEY = '{hexes(rng, 20)}'", lambda: "secret: short", lambda: "AKIA" + "".join(rng.choice("ABCDEFGH2345") for _ in range(16)), lambda: "AKIASHORT", lambda: hexes(rng, 15) + " " + hexes(rng, 40), lambda: "tokens are fun", lambda: "ſecret=notthatkind1"]
    rows = [(i, "\n".join(" ".join([prose(rng, 6), rng.choice(lines)(), "été", prose(rng, 3)]) for _ in range(4)), "s") for i in range(250)]
    return rows + [(300, None, "s"), (301, "", "s"), (302, "password=" + "a" * 30_000, "s"), (303, "x " * 30_000, "s"), (None, "token = " + hexes(rng, 20), "s"), (304, " \n\t", "s")]


@pytest.fixture(scope="module")
def field(spark, corpus):
    return secrets.train(docs(spark, corpus))


def test_base_spans(spark, corpus, field):
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["secrets"]] for r in secrets.scan(docs(spark, corpus), field, chars=3000).collect()}
    assert len(got) == len(corpus)
    for i, t, _ in corpus:
        assert [s for s in got[i] if s[2] != "crf"] == brute_base(t)
        assert all(b <= c for (_, b, k), (c, _, m) in zip(got[i], got[i][1:], strict=False) if "crf" in (k, m))
    again = secrets.scan(docs(spark, [*corpus[:3], *corpus[:3]]), field)
    assert again.columns == [*docs(spark, []).columns, "secrets"] and again.count() == 6


def test_nothing_to_learn_from(spark, field):
    none = secrets.train(docs(spark, []))
    assert secrets.find("password is hunter2xyz99qq", none) == [] and secrets.scan(docs(spark, []), field).collect() == []
    assert secrets.train(docs(spark, [(1, "no secret here", "s"), (2, None, "s"), (None, "x", "s")])).steps.tolist() == np.zeros((3, 3)).tolist()


def test_the_field_finds_secrets_that_no_pattern_matches(field):
    rng = random.Random(15)
    every = string.ascii_letters + string.digits
    kinds = [
        lambda: "".join(rng.choice(every) for _ in range(rng.randrange(24, 40))),
        lambda: "".join(rng.choice(string.ascii_lowercase + string.digits * 2) for _ in range(rng.randrange(20, 30))),
        lambda: "sk_live_" + "".join(rng.choice(every) for _ in range(24)),
    ]
    caught = planted = false = 0
    for k in range(200):
        value = kinds[k % 3]()
        cue = rng.choice(["the password is ", "token ", "export KEY ", ""])
        text = f"{prose(rng, 20)} {cue}{value} {prose(rng, 20)}"
        assert brute_base(text) == [] or "e" in value
        start = text.index(value)
        spans = [s for s in secrets.find(text, field) if s[2] == "crf"]
        hit = any(a < start + len(value) and b > start for a, b, _ in spans)
        caught, planted = caught + hit, planted + 1
        false += sum(not (a < start + len(value) and b > start) for a, b, _ in spans)
    clean = sum(len(secrets.find(prose(rng, 60), field)) for _ in range(200))
    print(f"recall {caught / planted:.3f}, precision {caught / (caught + false + clean):.3f}")
    assert caught / planted >= 0.9 and caught / (caught + false + clean) >= 0.9
    # a short one without a long run of digits is found by the words around it
    assert [s[2] for s in secrets.find("and my password is Tr0ub4dor3xyz now", field)] == ["crf"]


def test_every_token_is_tagged():
    field = secrets.Field({("own", "letters"): (0.0, 3.0, -9.0)}, np.zeros((3, 3)))
    assert secrets.find("one two, three", field) == [(0, 3, "crf"), (4, 7, "crf"), (9, 14, "crf")]


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(15)
    for spread in (1, 4, 20):  # with ever more tokens that are certain
        steps = rng.normal(size=(3, 3))
        for _ in range(20):
            e = rng.normal(size=(6, 3)) * spread
            total = lambda path: steps[0, path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)) + steps[path[-1], 0]  # noqa: B023, E731
            every = [[(n // 3**k) % 3 for k in range(6)] for n in range(3**6)]
            assert math.isclose(total(secrets.decode(e, steps).tolist()), max(map(total, every)))


def test_stretches_of_all_lengths_are_decoded_alike():
    rng = np.random.default_rng(16)
    e, steps = rng.normal(size=(400, 3)), rng.normal(size=(3, 3))
    cuts = np.sort(rng.choice(np.arange(1, 399), 30, replace=False))
    starts, ends = np.r_[0, cuts], np.r_[cuts, 400]
    whole = secrets.viterbi(e, steps, starts, ends)
    assert whole.tolist() == [x for a, b in zip(starts, ends, strict=True) for x in secrets.viterbi(e[a:b], steps, np.array([0]), np.array([b - a])).tolist()]


def test_tagger_agrees_with_the_features_as_they_stand(field):
    rng = random.Random(17)
    text = f"{prose(rng, 40)} token = {hexes(rng, 30)} {prose(rng, 10)}"
    tokens = secrets.TOKEN.findall(text)
    plain = secrets.decode(field.emissions(tokens, text), field.steps)
    tagger = secrets.Tagger(field, most=3)  # loses what it has found between the texts
    assert all(tags.tolist() == plain.tolist() for _ in range(2) for tags in tagger.tags([text, "", text])[::2])


def test_the_query(spark):
    want = {r["doc_id"]: brute_base(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = queries()["op6_secrets"](spark, SF)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = out.collect()
    assert len(rows) == len(want)
    for r in rows:
        spans = want[r["doc_id"]]
        line = lambda xs: ",".join(f"{k}:{a}:{b}" for a, b, k in xs)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == sha(line(spans)) and ",".join(x for x in r["spans"].split(",") if not x.startswith("crf")) == line(spans)
