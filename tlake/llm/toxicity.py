"""Toxicity: a logistic model on words and word beginnings, with a counterfactual penalty.

Sentences of the labelled documents that name a group are rewritten with each other term of the same set. A change of the
score under such a swap adds to the loss, so that naming one group cannot weigh more than naming another. A document is
the set of its features, so one insult counts alike in a short and in a long text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, words

#: Terms that may stand for each other in a sentence, by language and grammatical form.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
OTHERS = {term: [x for x in group if x != term] for group in IDENTITY_TERMS for term in group}
ANY_TERM = re.compile(rf"\b(?:{'|'.join(sorted(OTHERS, key=len, reverse=True))})\b")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5, 6, 7)


def word_features(token: str) -> tuple[str, ...]:
    """The letter runs of a token in lower case, and their first letters."""
    out: list[str] = []
    for w in LETTERS.findall(token.lower()):
        out.append(w)
        out += [f"^{w[:n]}" for n in PREFIXES if len(w) > n]
    return tuple(out)


def features(text: str | None) -> set[str]:
    return {f for w in set(words(text)) for f in word_features(w.decode("utf-8", "replace"))}


class Active(dict):
    """word -> those of its features that have a weight; starts anew when full."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.stems = {f[1 : 1 + PREFIXES[0]] if f[0] == "^" else f[: PREFIXES[0]] for f in weights}

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        token = word.decode("utf-8", "replace").lower()
        known = not token.isalpha() or token[: PREFIXES[0]] in self.stems  # else no feature can have a weight
        self[word] = v = tuple(f for f in word_features(token) if f in self.weights) if known else ()
        return v


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, active: Active) -> float:
        found = set().union(*map(active.__getitem__, set(words(text))))
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def swapped(text: str, most: int = 20) -> list[tuple[str, str]]:
    """(sentence, same sentence with one group term swapped) for the sentences that name a group. Of more than ``most`` pairs
    in a text those with the smallest hashes are taken, wherever they stand, so no long text outweighs the others."""
    out: set[tuple[str, str]] = set()
    for sentence in SENTENCE.split(text.lower()):
        for term in ANY_TERM.findall(sentence):
            for other in OTHERS[term]:
                out.add((sentence, re.sub(rf"\b{term}\b", other, sentence)))
    return sorted(out, key=lambda pair: (zlib.crc32("\n".join(pair).encode("utf-8", "surrogatepass")), pair))[:most]


class Sparse:
    """Rows of a 0/1 (or signed) matrix: products with a vector from either side."""

    def __init__(self, rows: list[list[int]], signs: list[list[float]] | None, n: int) -> None:
        self.ids = np.array([i for r in rows for i in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.v = np.array([s for r in signs for s in r], float) if signs else np.ones(len(self.ids))
        self.shape = (len(rows), n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.v * w[self.ids], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, self.v * g[self.row], self.shape[1])


def fit(
    sample: list[tuple[str, int]], penalty: float = 1.0, l2: float = 1e-3, max_features: int = 1000, steps: int = 300
) -> ToxicityModel:
    """Accelerated gradient descent on mean log loss + l2 |w|^2 / 2 + penalty * mean squared score change under swaps.

    Features are those of at least three different documents that are most over-represented among the toxic (over three standard
    deviations), and all that a swap changes. With no rows or one class the model is that class's smoothed share.
    """
    sample = sorted(set(sample))
    y = np.array([v for _, v in sample], float)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return ToxicityModel({}, base)
    shared: dict[bytes, tuple[str, ...]] = {}  # one copy of each word's features; the sets are made anew when needed

    def found(text: str) -> set[str]:
        for w in (own := set(words(text))):
            if w not in shared:
                shared[w] = word_features(w.decode("utf-8", "replace"))
        return {f for w in own for f in shared[w]}

    total, toxic = Counter(), Counter()
    for t, v in sample:
        s = found(t)
        total.update(s)
        if v:
            toxic.update(s)
    p = float(y.mean())
    lift = {f: (toxic[f] - n * p) / (n * p * (1 - p)) ** 0.5 for f, n in total.items() if n >= 3}
    lift = {f: z for f, z in lift.items() if z > 3}
    # Beginnings that occur in the same documents as a longer or shorter one are one feature: the shortest.
    holders: dict[str, list[int]] = {f: [] for f in lift}
    total, toxic = Counter(), Counter()
    for i, (t, _) in enumerate(sample):
        for f in found(t) & holders.keys():
            holders[f].append(i)
    one = {tuple(holders[f]): f for f in sorted(lift, key=lambda f: (-len(f), f))}
    lift = {f: lift[f] for f in one.values()}
    pairs = [pair for t, _ in sample for pair in swapped(t)]
    changes = [(features(a), features(b)) for a, b in pairs]
    names = sorted(lift, key=lambda f: (-lift[f], f))[:max_features]
    names = sorted(set(names) | {f for a, b in changes for f in a ^ b})
    at = {f: i for i, f in enumerate(names)}
    x = Sparse([sorted(at[f] for f in found(t) & at.keys()) for t, _ in sample], None, len(names))
    ends = [(sorted(at[f] for f in a - b), sorted(at[f] for f in b - a)) for a, b in changes]
    d = Sparse([u + v for u, v in ends], [[1.0] * len(u) + [-1.0] * len(v) for u, v in ends], len(names)) if ends else None
    w, b, before, momentum = np.zeros(len(names)), base, np.zeros(len(names)), 1.0
    # Each feature has a step of its own size: rare features must move as fast as frequent ones.
    curve = 0.25 * np.maximum(x.back(np.bincount(x.row, minlength=len(y)).clip(1).astype(float)), 1e-9) / len(y)
    if d is not None:
        widths = np.bincount(d.row, minlength=d.shape[0]).astype(float)
        curve += 2 * penalty * np.bincount(d.ids, widths[d.row], len(names)) / d.shape[0]
    for _ in range(steps):
        at_w = w + (momentum - 1) / (momentum + 2) * (w - before)
        momentum += 1
        error = 1 / (1 + np.exp(-np.clip(x.dot(at_w) + b, -35, 35))) - y
        g = x.back(error) / len(y)
        if d is not None:
            g += 2 * penalty * d.back(d.dot(at_w)) / d.shape[0]
        before, w = w, at_w - (g + l2 * at_w) / (curve + l2)
        b -= error.mean() / 0.25 * 0.5
    return ToxicityModel({f: float(v) for f, v in zip(names, w) if v}, float(b))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000) -> ToxicityModel:
    """Fit on at most ``max_train_rows`` labelled rows whose crc32(doc_id) mod 4 is not 2."""
    return fit(labelled_sample(docs, labels, "toxic", remainder("doc_id", 4) != 2, max_train_rows))


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """P(toxic) of a text; null as empty. The model has at most ``max_features`` weights and those of group terms."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        active = Active(model.weights)
        for texts in batches:
            yield pd.Series([model.score(t, active) for t in texts], dtype="float64")

    return scored(text)


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated rows too. Null or empty text scores by the bias alone; a
    null id counts as the empty text in ``held_out``; other columns are not read."""
    return docs.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), toxicity(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
