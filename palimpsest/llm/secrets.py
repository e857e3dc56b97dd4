"""Secret scans: fixed patterns and a linear-chain conditional random field.

The patterns find the base spans. The field tags every token of every text (a run of word characters, or one sign) as
begin, inside or outside of a secret, from the token's shape, the tokens around it and features of the file, and is
decoded by Viterbi. It is trained on windows of a bounded sample of the documents, whose tags are the values of their
base spans. Each window is learned several times: whole, without what stands around a token, without the fine points of
its shape too, without any shape, and from the words near it alone. So the field knows a secret by its shape or by its
context, also where no pattern matches, and what it finds beside the base spans is added.

Most tokens lead outside by more than all steps could ever gain: outside is their tag on every best path, so Viterbi only
runs over the stretches between them. That is exact, and texts are decoded by array operations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stash

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns of the base spans, and the least length of a match, or of its group 2.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
HINTS = ("passw", "secret", "token", "api")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # greedy runs of that class: the same matches as HEX without the short ones

OUTSIDE, BEGIN, INSIDE = range(3)
#: A token, with the white space character before it if there is one.
TOKEN = re.compile(r"\s?(?:\w+|[^\w\s])")
PART = re.compile(r"[^\W\d_]+")
#: How many tokens before a token are its neighbourhood.
NEAR = 4
#: Words that announce a secret; names that the patterns know, and others. Fixed values.
CUES = frozenset(("password", "passwd", "pwd", "passphrase", "passcode", "pin", "secret", "secrets", "token", "tokens", "apikey", "key", "api", "auth", "bearer", "credential", "credentials"))
#: What a token's tag is drawn from: itself, the one before, the one after, those near before, the file.
ROLES = ("bias", "own", "fine", "before", "after", "near", "file")
#: Roles that the copies of a training window lack.
LACK = ((), ("before", "after", "near"), ("fine", "before", "after", "near"), ("own", "fine"), ("own", "fine", "before", "after"))
#: Sizes from which a token has another feature each.
SIZES = (3, 6, 8, 12, 16, 20, 24, 32, 48)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the base matches; leftmost and not overlapping within a kind."""
    found, lower = [], text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_values(text: str) -> list[tuple[int, int]]:
    """Start and end of what the base spans hold secret: an assignment's value, the others whole; in order, and without
    those inside another."""
    found = [(*m.span(2), "") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [s for s in base_spans(text) if s[2] != "assign"]
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def shape(word: str) -> str:
    """Classes of all characters, runs drawn together: Ab12-x is Aa0-a; many changes only count."""
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa" if m[0].istitle() else "x", re.sub(r"\d+", "0", word))
    return out if len(out) <= 6 else f"{min(5, len(out) // 6)}*6"


_CLASSES = [sum(n >= least for least in SIZES) for n in range(SIZES[-1] + 1)]


def size_class(n: int) -> int:
    return _CLASSES[n] if n < SIZES[-1] else len(SIZES)


def token_features(token: str) -> dict[str, list[str]]:
    """Features of a token by the role it plays: for its own tag, and for those of its neighbours."""
    core, glued = (token[1:], "") if token[0].isspace() else (token, "+")
    lower, n, sign, own, fine = core.lower(), len(core), [], [], []
    if n == 1 and not core.isalnum():
        kind = f"sign {core}"
        sign = ["sign", f"is {core}", f"is {glued}{core}"]
    else:
        digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
        classes = "mixed" if digits and letters else "digits" if digits else "letters"
        kind = f"{classes} {size_class(n) // 3}"
        own = [classes, f"{glued}{classes}", *(f"{classes} from {least}" for least in SIZES if n >= least)]
        if letters == n:
            own.append(f"case {'A' if core.isupper() else 'a' if core.islower() else 'Aa' if core.istitle() else 'aA'}")
        else:
            own += [f"distinct from {least}" for least in (6, 8, 10, 12, 14) if len(set(core)) >= least]
            fine = [f"shape {shape(core)}", f"of digits {4 * digits // n}"]
            fine += [f"hex {size_class(n)}"] * (n >= 8 and not set(core) - set("0123456789abcdef"))
            fine += [f"capitals {size_class(n)}"] * (n >= 8 and core.isascii() and core.upper() == core and letters > 0)
    parts = [] if any(map(str.isdigit, core)) else PART.findall(lower)
    cue = ["cue"] * any(p in CUES for p in parts)
    return {"bias": ["1", *sign], "own": own, "fine": fine, "before": [kind], "after": [kind], "near": [*(f"={p}" for p in parts), *cue], "file": []}


def file_features(text: str) -> list[str]:
    """Of the whole text: how much of it looks like code, and its size."""
    signs = sum(map(text.count, "{}=;_<>"))
    return [f"code {min(4, 200 * signs // max(1, len(text)))}", f"length {len(str(len(text)))}"]


@dataclass(frozen=True)
class Field:
    """Weights by role, feature and tag, and of steps from tag to tag (row: from; a text starts as after OUTSIDE)."""

    weights: dict[tuple[str, str], tuple[float, float, float]]
    steps: np.ndarray

    @cached_property
    def words(self) -> set[str]:
        """Words that the field knows by name."""
        return {f[1:] for _, f in self.weights if f[0] == "="}

    def vector(self, role: str, features: list[str]) -> np.ndarray:
        return np.sum([self.weights.get((role, f), (0.0, 0.0, 0.0)) for f in features], axis=0) if features else np.zeros(3)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Each token's vectors: for its own tag, for the next one's, for that of the one before, for those near after."""
        out = np.zeros((len(tokens), 4, 3))
        for k, token in enumerate(tokens):
            f = token_features(token)
            out[k] = self.vector("bias", f["bias"]) + self.vector("own", f["own"]) + self.vector("fine", f["fine"]), self.vector("before", f["before"]), self.vector("after", f["after"]), self.vector("near", f["near"])
        return out

    def emissions(self, tokens: list[str], text: str) -> np.ndarray:
        """Weights of each token's tags, steps left out."""
        rows = self.rows(tokens)
        return _summed(np.concatenate([np.zeros((NEAR, 4, 3)), rows, np.zeros((1, 4, 3))]))[NEAR:-1] + self.vector("file", file_features(text))


def _summed(rows: np.ndarray) -> np.ndarray:
    out = rows[:, 0].copy()
    out[1:] += rows[:-1, 1]
    out[:-1] += rows[1:, 2]
    for k in range(1, NEAR + 1):
        out[k:] += rows[:-k, 3]
    return out


def viterbi(emissions: np.ndarray, steps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best tags of the stretches [start, end) of the emissions, each with OUTSIDE before and after it; one after
    another. Of equals, the smaller tag. Stretches of about the same length go step by step together."""
    size = ends - starts
    out, into = np.zeros(int(size.sum()), dtype=np.int8), np.cumsum(size) - size
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        longest = size[order[at:]]
        n = max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), 1_000_000, side="right")))
        group = order[at : at + n]
        at += n
        t = int(size[group[-1]])
        inside = np.arange(t)[None, :] < size[group][:, None]
        e = emissions[np.minimum(starts[group][:, None] + np.arange(t)[None, :], len(emissions) - 1)]
        best, back = steps[OUTSIDE] + e[:, 0], np.zeros((len(group), t, 3), dtype=np.int8)
        for j in range(1, t):
            through = best[:, :, None] + steps
            back[:, j] = np.where(inside[:, j, None], through.argmax(axis=1), np.arange(3))
            best = np.where(inside[:, j, None], through.max(axis=1) + e[:, j], best)
        tag = (best + steps[:, OUTSIDE]).argmax(axis=1)
        tags = np.zeros((len(group), t), dtype=np.int8)
        for j in range(t - 1, -1, -1):
            tags[:, j] = tag
            tag = back[np.arange(len(group)), j, tag]
        out[(into[group][:, None] + np.arange(t)[None, :])[inside]] = tags[inside]
    return out


def decode(emissions: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The tags of greatest total weight of a sequence with OUTSIDE before and after it.

    A tag x between a and b gains at most steps[a, x] + steps[x, b] - steps[a, OUTSIDE] - steps[OUTSIDE, b] over OUTSIDE.
    Where OUTSIDE leads by more it is certain, and b is OUTSIDE for the token before a certain one.
    """
    lead = emissions[:, OUTSIDE] - emissions[:, 1:].max(axis=1)
    gain = (steps[:, 1:, None] + steps[None, 1:, :]) - (steps[:, OUTSIDE][:, None, None] + steps[OUTSIDE][None, None, :])
    certain = lead > gain.max()
    for _ in range(3):
        followed = np.append(certain[1:], True)
        certain |= followed & (lead > gain[:, :, OUTSIDE].max())
    edge = np.diff(np.concatenate([[1], certain.astype(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    tags = np.zeros(len(emissions), dtype=np.int8)
    if len(starts):
        tags[~certain] = viterbi(emissions, steps, starts, ends)
    return tags


class Tagger:
    """Tags texts by a field. The vectors of tokens met are kept, up to ``most`` tokens; letters-only tokens that the
    field doesn't know by name share those of their size and case."""

    def __init__(self, field: Field, most: int = 300_000):
        self.field, self.most = field, most
        self.clear()

    def clear(self) -> None:
        outer = self

        class Numbers(dict):
            def __missing__(self, token: str) -> int:
                self[token] = n = outer._row(token)
                return n

        self.numbers, self.alike = Numbers(), {}
        self.table, self.used = np.zeros((1024, 4, 3)), 1
        self.table[0, 0] = 0.0, -1e6, -1e6  # stands between texts

    def _row(self, token: str) -> int:
        spaced = token[0].isspace()
        core = token[1:] if spaced else token
        if core.isalpha() and (lower := core.lower()) not in self.field.words and lower not in CUES:
            alike = (spaced, size_class(len(core)), core.isupper(), core.islower(), core.istitle())
            if alike not in self.alike:
                self.alike[alike] = self._add(token)
            return self.alike[alike]
        return self._add(token)

    def _add(self, token: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.field.rows([token])[0]
        self.used += 1
        return self.used - 1

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """The tags of each text's tokens."""
        if len(self.numbers) > self.most:
            self.clear()
        gap, ids, sizes = [0] * NEAR, [0] * NEAR, []
        for text in texts:
            found = TOKEN.findall(text)
            ids.extend(map(self.numbers.__getitem__, found))
            ids.extend(gap)
            sizes.append(len(found))
        emissions = _summed(self.table[np.array(ids)])
        ends = NEAR + np.cumsum(np.array(sizes) + NEAR) - NEAR
        for text, n, end in zip(texts, sizes, ends.tolist(), strict=True):
            emissions[end - n : end] += self.field.vector("file", file_features(text))
        tags = decode(emissions, self.field.steps)
        return [tags[end - n : end] for n, end in zip(sizes, ends.tolist(), strict=True)]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Base spans, and the field's spans that overlap none of them. A span of the field goes from its first to its
        last token; tokens of signs only are none."""
        out = []
        for text, tags in zip(texts, self.tags(texts), strict=True):
            spans, more = base_spans(text), []
            if tags.any():
                held = None
                for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
                    start = m.start() + m[0][0].isspace()
                    if tag == INSIDE and held:
                        held[1] = m.end()
                    elif tag != OUTSIDE:
                        held = [start, m.end()]
                        more.append(held)
                    else:
                        held = None
            overlaps = lambda a, b: any(s[0] < b and s[1] > a for s in spans)  # noqa: E731, B023
            out.append(in_order(spans + [(a, b, "crf") for a, b in more if any(map(str.isalnum, text[a:b])) and not overlaps(a, b)]))
        return out


def find(text: str, field: Field) -> list[tuple[int, int, str]]:
    return Tagger(field).find([text])[0]


def windows(text: str, reach: int, draw: int) -> Iterator[tuple[list[str], list[int]]]:
    """Training windows of a text: tokens of the window with NEAR more before and one after (empty at the text's ends),
    and tags of those between.

    One window around each stretch of secret values, reach tokens either side (those that meet are one, and are cut into
    parts of four reaches), and one of two reaches at a place that ``draw`` picks from the whole text.
    """
    found = list(TOKEN.finditer(text))
    if not found:
        return
    values, tags, v = secret_values(text), [], 0
    held = -1
    for m in found:
        start, end = m.start() + m[0][0].isspace(), m.end()
        while v < len(values) and values[v][1] <= start:
            v += 1
        hit = v < len(values) and values[v][0] < end
        tags.append(OUTSIDE if not hit else INSIDE if held == v else BEGIN)
        held = v if hit else -1
    spans: list[list[int]] = []
    for k in np.flatnonzero(tags).tolist():
        lo, hi = max(0, k - reach), min(len(found), k + reach + 1)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    place = draw % len(found)
    parts = [(k, min(hi, k + 4 * reach)) for lo, hi in spans for k in range(lo, hi, 4 * reach)]
    for lo, hi in [*parts, (place, min(len(found), place + 2 * reach))]:
        tokens = [found[k][0] if 0 <= k < len(found) else "" for k in range(lo - NEAR, hi + 1)]
        yield tokens, tags[lo:hi]


def fit(data: list[tuple[list[str], list[int], list[str]]], steps: int = 45, l2: float = 2e-4, rate: float = 0.3) -> Field:
    """Maximum likelihood of the windows (tokens with their surroundings, tags, file features), each in its copies, by
    forward and backward sums over all of them at once; Adam on the regularised mean. Names of tokens count that stand in
    1 % of the windows and in two at least. Without any tag but outside, everything is outside."""
    if not any(any(y) for _, y, _ in data):
        return Field({("bias", "1"): (0.0, -50.0, -50.0)}, np.zeros((3, 3)))
    distinct = sorted({t for x, _, _ in data for t in x} - {""})
    number = {"": 0} | {t: k + 1 for k, t in enumerate(distinct)}
    files = sorted({tuple(f) for _, _, f in data})
    of_token = {t: [(role, f) for role, fs in token_features(t).items() for f in fs] for t in distinct}
    seen = Counter(f for x, _, _ in data for f in {f for t in set(x) - {""} for f in of_token[t]})
    least = max(2, len(data) // 100)
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least or f[1][0] != "="))}
    names |= {("file", f): len(names) + i for i, f in enumerate(sorted({f for fs in files for f in fs}))}
    # which features each distinct token, or file, has in a role
    has = {role: ([], []) for role in ROLES}
    for t in distinct:
        for f in of_token[t]:
            if f in names:
                has[f[0]][0].append(number[t])
                has[f[0]][1].append(names[f])
    for k, fs in enumerate(files):
        for f in fs:
            has["file"][0].append(k + 1)
            has["file"][1].append(names["file", f])
    has = {role: (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) for role, (a, b) in has.items()}
    size = max(len(number), len(files) + 1)

    length, copies = np.array([len(y) for _, y, _ in data]), len(LACK)
    n, t = len(data), int(length.max())
    real = np.arange(t)[None, :] < length[:, None]
    y, around, of_file = np.zeros((n, t), dtype=np.int64), np.zeros((n, t + NEAR + 1), dtype=np.int64), np.zeros(n, dtype=np.int64)
    file_of = {f: k + 1 for k, f in enumerate(files)}
    for k, (x, tags, file) in enumerate(data):
        y[k, : len(tags)], around[k, : len(x)], of_file[k] = tags, [number[w] for w in x], file_of[tuple(file)]
    places = {"bias": [NEAR], "own": [NEAR], "fine": [NEAR], "before": [NEAR - 1], "after": [NEAR + 1], "near": list(range(NEAR))}
    lookup = {role: [np.where(real, around[:, k : k + t], 0) for k in ks] for role, ks in places.items()}
    lookup["file"] = [np.where(real, of_file[:, None], 0)]
    present = {role: [c for c, lack in enumerate(LACK) if role not in lack] for role in ROLES}
    s = n * copies  # windows in all copies, one copy after another
    real, y = np.tile(real, (copies, 1)), np.tile(y, (copies, 1))

    w, a = np.zeros((len(names), 3)), np.zeros((3, 3))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, a)]
    before = np.concatenate([np.zeros((s, 1), dtype=np.int64), y[:, :-1]], axis=1)
    told = np.zeros((3, 3))
    np.add.at(told, (before[real], y[real]), 1.0)
    kind = np.float32  # large enough for sums that are scaled at every step
    one, first = np.eye(3, dtype=kind)[y], np.broadcast_to(np.eye(3, dtype=kind)[OUTSIDE], (s, 3))
    for turn in range(1, steps + 1):
        vectors = {role: np.stack([np.bincount(tok, w[f, c], size) for c in range(3)], axis=1).astype(kind) for role, (tok, f) in has.items()}
        e = np.zeros((copies, n, t, 3), dtype=kind)
        for role, places in lookup.items():
            e[present[role]] += sum(vectors[role][ids] for ids in places)
        e = e.reshape(s, t, 3)
        psi, m = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(a).astype(kind)
        alpha, beta, now = np.zeros((s, t, 3), dtype=kind), np.ones((s, t, 3), dtype=kind), first
        for j in range(t):
            new = (now @ m) * psi[:, j]
            alpha[:, j] = now = np.where(real[:, j, None], new / new.sum(axis=1, keepdims=True), now)
        for j in range(t - 2, -1, -1):
            new = (psi[:, j + 1] * beta[:, j + 1]) @ m.T
            beta[:, j] = np.where(real[:, j + 1, None], new / new.sum(axis=1, keepdims=True), 1.0)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        came = np.concatenate([first[:, None, :], alpha[:, :-1]], axis=1)
        goes = psi * beta
        scale = real / ((came @ m) * goes).sum(axis=2)
        steps_expected = m * ((came * scale[:, :, None]).reshape(-1, 3).T @ goes.reshape(-1, 3))
        error = np.where(real[:, :, None], p - one, 0.0) / s
        error, gw = error.reshape(copies, n, t, 3), 2 * l2 * w
        for role, (tok, f) in has.items():
            whole = error[present[role]].sum(axis=0)
            for c in range(3):
                part = np.ascontiguousarray(whole[:, :, c]).ravel()
                collected = sum(np.bincount(ids.ravel(), part, size) for ids in lookup[role])
                gw[:, c] += np.bincount(f, collected[tok], len(names))
        for p_, g, mom in zip((w, a), (gw, (steps_expected - told) / s + 2 * l2 * a), moments, strict=True):
            mom[0] = 0.9 * mom[0] + 0.1 * g
            mom[1] = 0.999 * mom[1] + 0.001 * g * g
            p_ -= rate * (mom[0] / (1 - 0.9**turn)) / (np.sqrt(mom[1] / (1 - 0.999**turn)) + 1e-8)
    return Field({f: tuple(map(float, w[i])) for f, i in names.items()}, a)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = 6000, most_windows: int = 600, reach: int = 8, seed: int = 6) -> Field:
    """Train on at most most_docs documents, drawn by a hash of their id from those with a base span and from all, half
    each; of their windows, at most most_windows with a secret and as many without, drawn by hash.

    A window is ``reach`` tokens on either side of a secret, wherever in the text it stands, or as many tokens elsewhere.
    Null texts and ids are left out. Without any base span the field tags everything as outside.
    """

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(base_spans(t)))

    named = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a cheap test in the JVM that no base span fails, before the patterns themselves
    could = F.col("text").rlike(r"(?i)passw|secret|token|api|AKIA|[0-9a-f]{16}")
    ids = stash(named.select("id", F.when(could, told("text")).otherwise(False).alias("told")).groupBy("id").agg(F.max("told").alias("told")), "secret-ids")
    drawn = [x.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most_docs // 2) for x in (ids.filter("told"), ids)]
    drawn = drawn[0].unionByName(drawn[1]).select("id").distinct()  # bounded by most_docs numbers
    texts = named.join(F.broadcast(drawn), "id")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"].tolist(), batch["text"], strict=True):
                draw = (i * 0x9E3779B97F4A7C15 + seed) % (1 << 64) >> 16
                out += [(i, k, x, y, file_features(text)) for k, (x, y) in enumerate(windows(text, reach, draw))]
            yield pd.DataFrame(out, columns=["id", "k", "x", "y", "file"])

    rows = stash(texts.mapInPandas(learn, "id long, k int, x array<string>, y array<int>, file array<string>"), "secret-sample")
    order = (F.xxhash64(F.lit(seed + 1), "id", "k", "x"), "id", "k", "x")
    got = [rows.filter(f"(array_max(y) > 0) = {positive}").orderBy(*order).limit(most_windows).collect() for positive in ("true", "false")]
    return fit([(list(r["x"]), list(r["y"]), list(r["file"])) for part in got for r in part])


def scan(docs: DataFrame, field: Field, text_col: str = "text", out: str = "secrets", chars: int = 2_000_000) -> DataFrame:
    """The input with an array ``out`` of (kind, start, end) of all spans, in code points, end exclusive; by start, then
    kind (assign, access, hex, crf). A null or empty text has none. ``out`` replaces a column of that name. Texts are
    tagged together, about ``chars`` characters or one text at a time."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(field)
        for texts in batches:
            made, held, size = [], [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= chars:
                    made += tagger.find(held)
                    held, size = [], 0
            made += tagger.find(held)
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in made], dtype=object)

    return docs.withColumn(out, of(F.coalesce(F.col(text_col), F.lit(""))))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = line(F.filter("secrets", lambda s: s["kind"] != "crf"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_secrets": op6_secrets}
