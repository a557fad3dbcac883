"""Quality classifier: naive Bayes support vectors.

A document is a set of n-gram indicators. Each indicator is scaled by the log ratio of its smoothed frequency in the two
classes; a linear hinge-loss model on the scaled rows is fitted by dual coordinate descent; margins become probabilities
by a sigmoid fitted on rows that the model has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, words

BITS = 18
LETTERS, DIGITS, MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+")
TAIL = ".,;:!?#*$%&|<>\"')"
SAME = np.uint64(0x5BD1E995)  # the shape of a word that repeats the one before it
MIX = np.uint64(0x9E3779B97F4A7C15)


def case(letters: str) -> str:
    return "x" if letters.islower() else "X" if len(letters) > 1 and letters.isupper() else "Xx" if letters[0].isupper() else "x"


def shape(word: str) -> str:
    """Letters to x, X or Xx by their case, digits to 9, repeated marks to one."""
    if word.isalpha():
        return case(word)
    body = word.rstrip(TAIL)
    tail = MARKS.sub(r"\1", word[len(body) :])
    if body.isalpha():
        return case(body) + tail
    return MARKS.sub(r"\1", DIGITS.sub("9", LETTERS.sub(lambda m: case(m[0]), word[:64])))


class Hashes(dict):
    """word -> hash of its shape (high half) and of itself (low half); starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        high = zlib.crc32(shape(word.decode("utf-8", "replace")).encode()) >> 1
        self[word] = v = high << 32 | zlib.crc32(word)
        return v


def indicators(text: str | None, hashes: Hashes) -> np.ndarray:
    """Sorted distinct feature numbers: words, and runs of one to three word shapes. Empty text: none."""
    w = words(text)
    if not w:
        return np.empty(0, np.int64)
    both = np.array(list(map(hashes.__getitem__, w)), np.int64).view(np.uint64)
    word, s = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    s[1:][word[1:] == word[:-1]] = SAME
    kinds = [word * np.uint64(0xC2B2AE3D27D4EB4F), s * MIX + np.uint64(1)]
    if len(s) > 1:
        kinds.append((s[:-1] * MIX + s[1:]) * MIX + np.uint64(2))
    if len(s) > 2:
        kinds.append(((s[:-2] * MIX + s[1:-1]) * MIX + s[2:]) * MIX + np.uint64(3))
    h = np.concatenate(kinds)
    h ^= h >> np.uint64(31)
    return np.unique((h * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class NBSVM:
    """``weights`` are hinge weights times log ratios, ready for indicator rows; ``norms`` the squared ratios."""

    weights: np.ndarray
    norms: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        scale = np.sqrt(self.norms[features].sum()) or 1.0
        margin = self.weights[features].sum() / scale + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, c: float = 1.0, epochs: int = 12, seed: int = 7
) -> np.ndarray:
    """Weights (the last is the bias) of the L1-loss support vector problem; ``y`` is -1 or 1."""
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    q = np.array([v @ v + 1.0 for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            ids, v = rows[i]
            gradient = y[i] * (w[ids] @ v + w[n]) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), c)
            if step := (new - alpha[i]) * y[i]:
                alpha[i] = new
                w[ids] += step * v
                w[n] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin) by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * np.array([a - 1, b]))
        a, b = np.array([a, b]) - step
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def fit(sample: list[tuple[str, int]]) -> NBSVM:
    """Fit on (text, label) rows. With no rows, or one class only, every score is that class's smoothed share."""
    n, hashes = 1 << BITS, Hashes()
    rows = [indicators(t, hashes) for t, _ in sample]
    y = np.array([1 if v else -1 for _, v in sample], float)
    if len(set(y)) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return NBSVM(np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 5 == 4 if min((y > 0).sum(), (y < 0).sum()) >= 10 else np.zeros(len(y), bool)
    counts = [np.full(n, 1.0), np.full(n, 1.0)]
    for f, v, out in zip(rows, y, held):
        if not out:
            counts[int(v > 0)][f] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = []
    for f in rows:
        v = r[f]
        scaled.append((f, v / (np.sqrt(v @ v) or 1.0)))
    use = np.flatnonzero(~held)
    w = dual_coordinate_descent([scaled[i] for i in use], y[use], n)
    judge = np.flatnonzero(held) if held.any() else use
    margins = np.array([w[scaled[i][0]] @ scaled[i][1] + w[n] for i in judge])
    a, b = sigmoid_fit(margins, y[judge])
    return NBSVM((w[:n] * r).astype(np.float32), (r * r).astype(np.float32), float(w[n]), a, b)


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000) -> NBSVM:
    """Fit on at most ``max_train_rows`` labelled rows whose crc32(doc_id) is not divisible by 5."""
    return fit(labelled_sample(docs, labels, "quality", remainder("doc_id", 5) != 0, max_train_rows))


def score(text: Column, model: NBSVM) -> Column:
    """P(label 1) of a text; null as empty. The model is two arrays of 2^18 floats, whatever the corpus."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for texts in batches:
            yield pa.array([model.score(indicators(t.as_py(), hashes)) for t in texts], pa.float64())

    return scored(text)


def classify(docs: DataFrame, model: NBSVM, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null or empty text scores as a document without features.
    Repeated rows give repeated results; a null id counts as the empty text in ``held_out``; other columns are not read."""
    return docs.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
