"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed character bigrams and trigrams. Embeddings and softmax are trained by
stochastic gradient descent in numpy. Confidence is set by a temperature and a rejection level, both taken from
documents that the descent has not seen. Since the model is linear, scoring needs only the product of both matrices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids, remainder

BITS, DIM = 15, 16
LETTER = re.compile(r"[^\W\d_]")
BLOCK = 1 << 15  # characters of a long text counted at once
UNKNOWN = "und"


def characters(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(c: np.ndarray, most: int | None = None) -> np.ndarray:
    """Numbers of the hashed bigrams and trigrams that begin at the first ``most`` characters."""
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    ids = np.concatenate([two[:most], three[:most]])
    ids ^= ids >> np.uint32(15)
    return (ids * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def subwords(text: str) -> np.ndarray:
    """Numbers of the hashed bigrams and trigrams of the lower-cased text, one for each position."""
    return hashed(characters(text))


@dataclass
class LanguageModel:
    """``table`` holds each subword's logits; ``reject_below`` is the least score that is accepted."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray:
        c = characters(text)
        if len(c) <= BLOCK:
            return self.table[hashed(c)].mean(axis=0, dtype=np.float64) + self.bias
        # A long text is counted block by block: memory is that of its characters and the table.
        counts = np.zeros(len(self.table), np.int64)
        for i in range(0, len(c) - 1, BLOCK):
            counts += np.bincount(hashed(c[i : i + BLOCK + 2], BLOCK), minlength=len(counts))
        return counts @ self.table.astype(np.float64) / counts.sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> LanguageModel:
    """Fit on (text, language) rows; rows without a letter teach nothing. Without rows every prediction is ``und``."""
    sample = [(t, y) for t, y in sample if t and LETTER.search(t)]
    languages = sorted({y for _, y in sample})
    k = {y: i for i, y in enumerate(languages)}
    random = np.random.default_rng(seed)
    e = random.normal(0, 0.1, (1 << BITS, DIM))
    w, b = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    bags = [np.unique(subwords(t), return_counts=True) for t, _ in sample]
    bags = [(ids, (n / n.sum())[:, None]) for ids, n in bags]
    held = np.arange(len(sample)) % 5 == 4
    if held.sum() < 5:
        held[:] = False
    use = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(use):
            ids, share = bags[i]
            h = (e[ids] * share).sum(axis=0)
            g = softmax(h @ w + b)
            g[k[sample[i][1]]] -= 1
            back = w @ g
            w -= step * np.outer(h, g)
            b -= step * 0.1 * g
            # A subword's share of the mean is small, so its embedding takes a step that many subwords long.
            e[ids] -= step * min(len(ids), 50) * share * back
    model = LanguageModel(languages, (e @ w).astype(np.float32), b, 1.0, 0.0)
    if len(languages) > 1:
        calibrate(model, [sample[i] for i in (np.flatnonzero(held) if held.any() else use)])
    return model


def calibrate(model: LanguageModel, rows: list[tuple[str, str]], lost: float = 0.002, most: float = 0.5) -> None:
    """The temperature of least log loss; the level under which at most a share ``lost`` of right answers falls."""
    z = np.array([model.logits(t) for t, _ in rows])
    y = np.array([model.languages.index(v) for _, v in rows])
    at = np.arange(len(y))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[at, y] + 1e-12).mean()))
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    model.reject_below = float(min(most, right[int(lost * len(right))])) if len(right) else 0.0


def train(docs: DataFrame, max_train_rows: int = 3000) -> LanguageModel:
    """Fit on at most ``max_train_rows`` documents with a language whose crc32(doc_id) mod 4 is not 2, chosen by a hash
    of the id over the whole table. Only the chosen texts reach the driver."""
    wanted = (
        docs.select(ids(docs), F.col("lang").cast("string").alias("lang"))
        .filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang")
        .limit(max_train_rows)
    )
    rows = (
        docs.select(ids(docs), F.col("lang").cast("string").alias("lang"), "text")
        .join(F.broadcast(wanted), ["doc_id", "lang"])  # bounded by max_train_rows
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text")
        .limit(max_train_rows)
        .select("text", "lang")
        .collect()
    )
    return fit([(r.text, r.lang) for r in rows])


def language(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score, rejected) of a text. Null texts, texts without a letter and scores below the calibrated level
    are rejected. The model has 2^15 rows of one float per language."""

    @F.arrow_udf("lang string, score double, rejected boolean")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [model.predict(t.as_py()) for t in texts]
            columns = {
                "lang": pa.array([x for x, _ in rows], pa.string()),
                "score": pa.array([x for _, x in rows], pa.float64()),
                "rejected": pa.array([x == UNKNOWN or s < model.reject_below for x, s in rows], pa.bool_()),
            }
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return told(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, repeated rows too. Ties go to the language that sorts
    first. A null id counts as the empty text in ``held_out``; other columns are not read."""
    return docs.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), language(F.col("text"), model).alias("l")
    ).select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", "l.rejected")
