"""Benchmark decontamination: test items found in documents within an error budget.

Texts are compared in lower case with every run of other characters than letters and digits as one blank. An item of n
characters may differ in k = floor(error_rate * n) edits. Cut into k + 1 pieces, at least one piece must occur unchanged:
an automaton finds all pieces of all items in one pass over a document, and each place that a hit points to is verified
with Myers' bit-parallel distance.

Short items would meet ordinary text by chance, so the shorter they are the more has to agree. Length is counted in UTF-8
bytes, since a sentence of 40 letters is one of about 13 in Chinese or Japanese. From EDITED bytes an item has its budget;
from WHOLE_WORDS bytes it must occur unchanged, between word borders (scripts without blanks have none); below that, the
document must consist of it alone, where ``whole_texts`` asks for these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = re.compile(r"[\W_]+")
BLOCK_CHARS = 2_000_000  # characters of items that one pass looks for
EDITED, WHOLE_WORDS = 40, 16
NO_BLANKS = "\u2e80"  # from here on scripts are written without blanks, nearly all of them


def normalise(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """Start and end of k + 1 pieces of nearly equal length."""
    return [(n * i // (k + 1), n * (i + 1) // (k + 1)) for i in range(k + 1)]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        bits[ch] = bits.get(ch, 0) | 1 << i
    return bits


def myers(bits: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of ``text``, and where that part ends; (k + 1, -1) if above k."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, k + 1, -1
    for j, ch in enumerate(text):
        eq = bits.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
            if not best:
                break
    return best, at


def at_border(text: str, at: int) -> bool:
    """No word goes on across a place of a normalised text."""
    return at in (0, len(text)) or " " in text[at - 1 : at + 1] or max(text[at - 1 : at + 1]) >= NO_BLANKS


class Finder:
    """All items of one block, in one automaton; the shortest ones as whole texts."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, whole_texts: bool = False) -> None:
        self.items, self.texts = [], {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            size = len(text.encode("utf-8", "surrogatepass"))
            if size < WHOLE_WORDS:
                if whole_texts:
                    self.texts.setdefault(text, []).append(item_id)
                continue
            k = int(error_rate * len(text)) if size >= EDITED else 0
            for a, b in pieces(len(text), k):
                found.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, text, k, pattern_bits(text), size < EDITED))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, least distance, start in the normalised text) of every item within its budget."""
        out = [(item_id, 0, 0) for item_id in self.texts.get(text, ())] if text else []
        if not self.items or not text:
            return out
        places: dict[int, set[int]] = {}
        for end, (n, uses) in self.automaton.iter(text):
            for i, a in uses:
                places.setdefault(i, set()).add(end - n + 1 - a)
        for i, starts in sorted(places.items()):
            item_id, pattern, k, bits, bordered = self.items[i]
            if bordered:
                starts = [s for s in starts if at_border(text, s) and at_border(text, s + len(pattern))]
                out += [(item_id, 0, min(starts))] if starts else []
                continue
            m, best, at, reach = len(pattern), k + 1, -1, -1
            spans: list[list[int]] = []
            for s in sorted(starts):  # places within the budget of each other are one
                if spans and s <= spans[-1][1] + 2 * k:
                    spans[-1][1] = s
                else:
                    spans.append([s, s])
            for lo, hi in spans:
                a, b = max(0, lo - k), min(len(text), hi + m + k)
                if b - a < m - k or text.find(pattern, a, b) < 0 and k == 0:
                    continue
                d, reach = myers(bits, m, text[a:b], k)
                if d < best:
                    best, at = d, max(0, a + reach + 1 - m)
            if best <= k:
                out.append((item_id, best, at))
        return out


def item_blocks(items: DataFrame) -> list[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_CHARS, by a hash of the id. Items without an id, or without letters and digits, have
    nothing that could be found. Ids may be of any type."""
    rows = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
    out = []
    for i in range(n):
        got = blocks.filter(F.col("block") == i).orderBy("item_id", "text").collect()
        block = [(r.item_id, text) for r in got if (text := normalise(r.text))]
        if block:
            out.append(block)
    return out


def matches(
    text: Column, blocks: list[list[tuple[object, str]]], error_rate: float = 0.08, id_type: str = "bigint", whole_texts: bool = False
) -> Column:
    """array of (item_id, distance, start) for a text: every item found, by item_id. Each block of items is one pass over the
    text."""
    kind = f"array<struct<item_id: {id_type}, distance: int, start: int>>"

    def one(block: list[tuple[object, str]]) -> Column:
        @F.pandas_udf(kind)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = Finder(block, error_rate, whole_texts)
            for texts in batches:
                yield pd.Series(
                    [[{"item_id": i, "distance": d, "start": s} for i, d, s in finder.search(normalise(t))] for t in texts],
                    dtype="object",
                )

        return found(text)

    if not blocks:
        return F.from_json(F.lit("[]"), kind)
    return F.array_sort(F.array_distinct(F.flatten(F.array(*map(one, blocks)))))


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.08, whole_texts: bool = False) -> DataFrame:
    """doc_id, item_id, distance, start: one row for each item that a document contains within the item's error budget, or
    contains as its length asks for.

    Null and empty texts contain nothing. Repeated documents and items (same id, other text) give a row each; several
    places of one item in one document give the best, the first of equals. Other columns are not read.
    """
    id_type = items.schema["item_id"].dataType.simpleString()
    return (
        docs.select("doc_id", matches(F.col("text"), item_blocks(items), error_rate, id_type, whole_texts).alias("m"))
        .select("doc_id", F.explode("m").alias("m"))
        .select("doc_id", "m.item_id", "m.distance", "m.start")
    )
