"""Quality rules by distribution: how far a document's histograms are from those of a language.

Each language has two references, counted over all its documents: the share of each character class, and the share of
each of its most common words (all others together are one more bin). A document is compared with the language whose word
reference is nearest, by the Jensen-Shannon distance (base 2, so 0 to 1). Few words make any histogram ragged, so the
limits widen with the square root of bins per word, and documents under a minimum length are not judged at all.

A document must also be like one of the languages. A text without common words is never far from a reference (0.44 where
they hold a third of all words), so what counts is the distance beyond that of a random draw of as many words from the
reference, and the share of all common words together, which few words tell already.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

CLASSES = ("lower", "upper", "other letter", "digit", "space", "end mark", "quote or bracket", "symbol", "other")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def class_table() -> np.ndarray:
    """Class number of every code point."""
    rule = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 4, "Zp": 4, "Cc": 4}
    rule |= {"Ps": 6, "Pe": 6, "Pi": 6, "Pf": 6, "Sm": 7, "Sc": 7, "Sk": 7, "So": 7, "Po": 7, "Pd": 6, "Pc": 7}
    table = np.array([rule.get(unicodedata.category(chr(i)), 8) for i in range(0x3000)], np.uint8)
    table = np.concatenate([table, np.full(0x110000 - 0x3000, 2, np.uint8)])
    table[[ord(c) for c in ".,;:?!"]] = 5
    table[[ord(c) for c in "'\""]] = 6
    return table


def repeated_window_words(tokens: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(tokens)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
    if len(number) == n:
        return 0
    span = 1
    while span < width:  # windows of 1, 2, 4, 8 words get numbers of their own
        pairs = ids[:-span] * np.int64(n) + ids[span:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    if len(lines) == 1:
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split())


@dataclass
class References:
    """Per language: shares of the character classes, its common words, and their shares with that of all others last."""

    classes: np.ndarray
    vocabulary: list[list[bytes]]
    shares: list[np.ndarray]


def count_references(docs: DataFrame, n_words: int = 100, min_words: int = 2000) -> References:
    """References of all languages that have ``min_words`` words in the table, from all documents.

    Words and character classes are counted inside tasks and summed by key; only ``n_words`` rows per language come to
    the driver. Texts or languages that are null teach nothing.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = class_table()
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(k[0], k[1], k[2], n) for k, n in seen.items()], columns=["lang", "kind", "item", "n"])
            seen.clear()
            return out

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own: Counter = Counter()
                classes = np.zeros(len(CLASSES), np.int64)
                for t in texts:
                    own.update(words(t))
                    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    classes += np.bincount(table[code], minlength=len(CLASSES))
                for w, n in own.items():
                    seen[lang, "word", w] += n
                for i, n in enumerate(classes.tolist()):
                    seen[lang, "class", str(i).encode()] += n
                if len(seen) > 500_000:  # bounded memory: partial counts go out, Spark adds them up
                    yield rows()
        yield rows()

    sums = (
        docs.select(F.col("lang").cast("string").alias("lang"), "text")
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInPandas(counted, "lang string, kind string, item binary, n long")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("n").alias("n"))
        .checkpoint()
    )
    total = sums.filter("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_words)
    ranked = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = (
        sums.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= n_words)
        .join(total, "lang")
        .orderBy("lang", "kind", "rank")
        .collect()
    )
    classes, vocabulary, shares = [], [], []
    for lang in sorted({r.lang for r in top}):
        c = np.zeros(len(CLASSES))
        for r in top:
            if r.lang == lang and r.kind == "class":
                c[int(bytes(r.item))] = r.n
        own = [r for r in top if r.lang == lang and r.kind == "word"]
        classes.append(c / c.sum())
        vocabulary.append([bytes(r.item) for r in own])
        n = np.array([r.n for r in own], float)
        shares.append(np.append(n, own[0].total - n.sum()) / own[0].total)
    return References(np.array(classes), vocabulary, shares)


LENGTHS = np.unique(np.geomspace(1, 20_000, 40).astype(int))
DRAWS = 200


def drawn_distances(references: References) -> np.ndarray:
    """For each language and each of LENGTHS: mean distance of that many words, drawn from the reference, from it."""
    random = np.random.default_rng(20240229)
    draw = lambda q, n: distance(random.multinomial(n, q / q.sum(), size=DRAWS) / n, q).mean()
    return np.array([[draw(q, n) for n in LENGTHS] for q in references.shares])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "word_distance double, class_distance double, unlike boolean"
)


def measures(text: Column, references: References, max_beyond: float = 0.12, max_share: float = 0.05, slack: float = 0.25) -> Column:
    """struct of the counts and both distances of a text, and whether it is unlike every language; null text as empty;
    distances are null without references or without words.

    A text of n words is like a language when its distance is at most ``max_beyond`` + ``slack / sqrt(n)`` above that of
    n words drawn from the reference, and the distance of its share of common words, where that is smaller than the
    reference's, at most ``max_share`` and three standard deviations (sqrt(1 / (8 ln 2 n)) each).
    """
    drawn = drawn_distances(references)

    @F.pandas_udf(RESULT)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = class_table()
        column: dict[bytes, int] = {}
        for v in references.vocabulary:
            for w in v:
                column.setdefault(w, len(column))
        places = [[column[w] for w in v] for v in references.vocabulary]
        for texts in batches:
            n = len(texts)
            common = np.zeros((n, len(column)))
            classes = np.zeros((n, len(CLASSES)))
            counts = np.zeros((n, 5), np.int64)
            for i, t in enumerate(texts):
                if not t:
                    continue
                tokens = words(t)
                code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                classes[i] = np.bincount(table[code], minlength=len(CLASSES))
                for w, k in Counter(tokens).items():
                    at = column.get(w)
                    if at is not None:
                        common[i, at] = k
                raw = t.encode("utf-8", "surrogatepass")
                spaces = int(((code == 32) | ((code >= 9) & (code <= 13))).sum())
                counts[i] = (
                    len(tokens),
                    len(code) - spaces,
                    len(raw) - len(raw.translate(None, SYMBOLS)),
                    duplicate_lines(t),
                    repeated_window_words(tokens),
                )
            out = pd.DataFrame(counts, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            if places:
                total = np.maximum(counts[:, :1], 1)
                by_word, unlike = [], np.ones(n, bool)
                root = np.sqrt(total[:, 0])
                for at, q, expected in zip(places, references.shares, drawn):
                    p = common[:, at] / total
                    share = p.sum(axis=1)
                    by_word.append(distance(np.column_stack([p, 1 - share]), q))
                    beyond = by_word[-1] - np.interp(np.log(total[:, 0]), np.log(LENGTHS), expected)
                    fewer = np.where(share < 1 - q[-1], distance(np.column_stack([share, 1 - share]), np.array([1 - q[-1], q[-1]])), 0)
                    unlike &= (beyond > max_beyond + slack / root) | (fewer > max_share + 3 / np.sqrt(8 * np.log(2)) / root)
                nearest = np.argmin(by_word, axis=0)
                p = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
                by_class = distance(p, references.classes[nearest])
                none = counts[:, 0] == 0
                out["word_distance"] = np.where(none, np.nan, np.min(by_word, axis=0))
                out["class_distance"] = np.where(none, np.nan, by_class)
                out["unlike"] = ~none & unlike
            else:
                out["word_distance"] = out["class_distance"] = np.nan
                out["unlike"] = False
            yield out

    return measured(text)


def judge(
    docs: DataFrame,
    references: References,
    max_word_distance: float = 0.46,
    max_class_distance: float = 0.25,
    min_words: int = 20,
    slack: float = 0.25,
) -> DataFrame:
    """doc_id, the counts, base_failed, kept, both distances, for every row, repeated rows too.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. Other rows are kept unless they have
    ``min_words`` words and a distance above its limit plus ``slack * sqrt(bins / n)``, or are unlike every language that
    has a reference (see measures), as gibberish and texts in other languages are. Null and empty texts fail the base
    rules; without references nothing else fails. Columns other than doc_id and text are not read.
    """
    m = docs.select("doc_id", measures(F.col("text"), references).alias("m")).select("doc_id", "m.*")
    bins = max([len(s) for s in references.shares], default=1)
    words_limit = max_word_distance + slack * F.sqrt(F.lit(float(bins)) / F.greatest("n_words", F.lit(1)) / 10)
    class_limit = max_class_distance + slack * F.sqrt(F.lit(float(len(CLASSES))) / F.greatest("word_chars", F.lit(1)))
    nan_as_null = lambda c: F.when(~F.isnan(c), F.col(c))
    far = F.coalesce(nan_as_null("word_distance") > words_limit, F.lit(False)) | F.coalesce(
        nan_as_null("class_distance") > class_limit, F.lit(False)
    )
    far = far | F.col("unlike")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~((F.col("n_words") >= min_words) & far)).alias("kept"),
        nan_as_null("word_distance").alias("word_distance"), nan_as_null("class_distance").alias("class_distance"),
    )
