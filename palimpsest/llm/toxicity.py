"""Toxicity: a counterfactually regularised classifier.

A logistic model over the words of a text (whole words and word beginnings, present or not) is fitted on a bounded
sample of labelled rows. Sentences of the sample are repeated with their identity terms swapped for others; the fit
penalises the squared change of the score, so that naming a group neither raises nor lowers it.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stash

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Identity terms by language and kind; a term is swapped for others of its line. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "mexican", "chinese"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen", "menschen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "deutsche", "türken"),
    ("schwule", "lesben", "homosexuelle", "heterosexuelle"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "français", "arabes"),
    ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("mujeres", "hombres", "niñas", "niños", "gente"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "españoles", "gitanos"),
    ("homosexuales", "lesbianas", "heterosexuales"),
)
SWAPS = {term: line for line in IDENTITY_TERMS for term in line}
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7


def features(word: str) -> list[str]:
    """Of a lower-case word: itself, and its beginnings followed by a star."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


@dataclass(frozen=True)
class Model:
    """score(text) = 1 / (1 + exp(-(bias + the weights of the features that the text has)))."""

    bias: float
    weights: dict[str, float]

    def scorer(self, most_words: int = 100_000):
        known: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            if len(known) > most_words:
                known.clear()
            found: set[str] = set()
            for word in set(WORD.findall((text or "").lower())):
                has = known.get(word)
                if has is None:
                    has = known[word] = tuple(f for f in features(word) if f in self.weights)
                if has:
                    found.update(has)
            return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(found)), -500, 500))))

        return score


def counterfactuals(text: str, place: int) -> list[tuple[list[str], list[str]]]:
    """Pairs of sentences, as their words: one of the text that names a group, and the same with another group named.

    A text that names none has a mention put into one of its sentences, against that of another group, and against none,
    so that every term's weight is held down; ``place`` picks the terms and the sentence.
    """
    pairs = []
    sentences = [words for words in map(WORD.findall, SENTENCE.split(text.lower())) if words]
    for words in sentences:
        if any(w in SWAPS for w in words):
            swap = lambda w: SWAPS[w][(SWAPS[w].index(w) + 1 + place % (len(SWAPS[w]) - 1)) % len(SWAPS[w])] if w in SWAPS else w
            pairs.append((words, [swap(w) for w in words]))
            pairs.append((words, [w for w in words if w not in SWAPS]))
    if not pairs:
        line = IDENTITY_TERMS[place % len(IDENTITY_TERMS)]
        term = line[place // len(IDENTITY_TERMS) % len(line)]
        words = sentences[place % len(sentences)] if sentences else []
        pairs = [([*words, term], [*words, line[(line.index(term) + 1) % len(line)]]), ([*words, term], words)]
    return pairs


def fit(rows: list[tuple[int, list[int], list[tuple[list[int], list[int]]]]], n_features: int, class_weight: dict[int, float], penalty: float, l2: float = 2e-5, steps: int = 600, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise log loss + l2 |w|^2 + penalty * mean squared score change over the pairs.

    rows: label, features of the text, pairs of features of a sentence and of its counterfactual. Adam over all rows.
    """
    y = np.array([r[0] for r in rows], dtype=float)
    sample = np.array([class_weight[r[0]] for r in rows], dtype=float)
    sample /= sample.sum()
    at, col = (np.array(x, dtype=np.int64) for x in (np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows]), [f for r in rows for f in r[1]]))
    pairs = [p for r in rows for p in r[2]]
    sides = [(k, f, sign) for k, p in enumerate(pairs) for sign, side in ((1.0, p[0]), (-1.0, p[1])) for f in side]
    pair_at, pair_col = (np.array([s[i] for s in sides], dtype=np.int64) for i in (0, 1))
    sign = np.array([s[2] for s in sides], dtype=float)
    prior = np.clip((sample * y).sum(), 1e-3, 1 - 1e-3)
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w = theta[:-1]
        z = theta[-1] + np.bincount(at, w[col], len(rows))
        error = sample * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gradient = np.append(np.bincount(col, error[at], n_features) + 2 * l2 * w, error.sum())
        if pairs:
            change = np.bincount(pair_at, sign * w[pair_col], len(pairs))
            gradient[:-1] += 2 * penalty / len(pairs) * np.bincount(pair_col, sign * change[pair_at], n_features)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 4000, most_clean: int = 8000, n_features: int = 2000, penalty: float = 10.0, most_pairs: int = 8, seed: int = 1) -> Model:
    """Fit on at most most_toxic and most_clean labelled rows, drawn by a hash of their id.

    Rows that are held out (crc32 of the id modulo 3 is 1), labels that are null and ids without a document are left out;
    an id labelled twice counts as toxic if one label says so. Null texts count as empty. Without labelled documents,
    or with one class only, the model is a constant. n_features: how many features, those that most set the toxic and the
    clean rows of the sample apart, the model has. most_pairs: how many counterfactual pairs of a sampled text count,
    drawn by its id from those of all its sentences. Features are counted by aggregation; the driver holds the sample's
    rows as numbers of such features only, n_features and the identity terms at most in a row or in a side of a pair.
    """
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    told = told.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    told = stash(told, "told")
    sizes = {r["y"]: r["n"] for r in told.filter("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [told.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # bounded by most_toxic + most_clean rows of two numbers
    sample = stash(texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").repartition(12, "id"), "toxic-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch["text"], batch["y"], strict=True):
                seen[y].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
            every = sorted(seen[0] | seen[1])
            yield pd.DataFrame({"f": every, "a": [seen[1][f] for f in every], "b": [seen[0][f] for f in every]})

    got = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not got.get(0) or not got.get(1):
        rate = (got.get(1, 0) + 0.5) / (sum(got.values()) + 1)
        return Model(float(np.log(rate / (1 - rate))), {})
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (got[1] + 1 - a)) - F.log(b / (got[0] + 1 - b))
    spread = F.sqrt(1 / a + 1 / b)
    counted = sample.select("text", "y").mapInPandas(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = counted.filter("a + b >= 3").withColumn("z", F.abs(odds / spread)).filter("z > 3").orderBy(F.desc("z"), "f").limit(n_features)
    terms = sorted({f for line in IDENTITY_TERMS for t in line for f in features(t)[:1]})
    names = sorted({r["f"] for r in best.select("f").collect()} | set(terms))
    number = {f: i for i, f in enumerate(names)}

    def pairs_of(text: str, i: int) -> list[tuple[list[str], list[str]]]:
        every = counterfactuals(text, i)
        return every if len(every) <= most_pairs else [every[k] for k in sorted(random.Random(i).sample(range(len(every)), most_pairs))]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lambda words: sorted({number[f] for w in set(words) for f in features(w) if f in number})
        for batch in batches:
            out = [(int(y), of(WORD.findall(t.lower())), [[of(p), of(q)] for p, q in pairs_of(t, abs(int(i)))]) for i, t, y in zip(batch["id"], batch["text"], batch["y"], strict=True)]
            yield pd.DataFrame(out, columns=["y", "x", "pairs"])

    rows = [(r["y"], list(r["x"]), [(p[0], p[1]) for p in r["pairs"]]) for r in sample.orderBy("id", "text").mapInPandas(encode, "y int, x array<int>, pairs array<array<array<int>>>").collect()]
    bias, weights = fit(rows, len(names), {y: sizes[y] / got[y] for y in (0, 1)}, penalty)
    return Model(bias, {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-6})


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The input with the score of every whole text in a column ``out``, which replaces one of that name.

    A null or empty text gets the score of a text without features. Rows are scored one by one, so repeated rows agree.
    """

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        one = model.scorer()
        return pd.Series([one(t) for t in texts], dtype="float64")

    return docs.withColumn(out, of(F.col(text_col)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_toxicity": op1_toxicity}
