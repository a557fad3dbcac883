"""Token counts without ids: pieces are counted once for each distinct pre-token.

1. A sample of at most SAMPLE documents says which pre-tokens are frequent. It decides nothing but the way a pre-token goes:
   frequent ones are joined inside the task that reads the document, the others are shuffled.
2. Every text is normalised and cut into pre-tokens. Each document gives what its frequent ones sum to, and a row for
   each other distinct one.
3. These rows are dealt out and sorted by pre-token, so the merges run once for each distinct one, and its number of pieces
   meets all documents that hold it. The products are summed per document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import of_worker, slices, text_key

SAMPLE = 20_000
HOT_SHARE = 1_000_000
LEAST_DOCS = 3
UNICODE_SPACE = re.compile("[ \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
CONTROL = re.compile("[\\x1c-\\x1f]")
SPECIAL = "\x00special"  # stands for a special token; the tokenizer's own normaliser never gives it


class PreTokens(dict):
    """word (text between white space) -> its pre-tokens, by the tokenizer's own rules; starts anew when full.

    The rules of the tokenizer look at a word alone: white space is dropped and no match reaches across it.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # Plain words are most of a text. Where the rules only put them into lower case and split off an end mark, as a
        # probe with every ASCII letter shows, neither needs the rules' own code.
        letters = "abcdefghijklmnopqrstuvwxyz"
        probe = letters + letters.upper()
        self.plain = self.by_rules(probe) == [letters * 2]
        self.marks = {m for m in ".,;:!?" if self.plain and self.by_rules(probe + m) == [letters * 2, m]}
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 300_000:
            self.clear()
        if word == SPECIAL:
            return [SPECIAL]
        if self.plain and word.isascii() and word.isalpha():
            v = [word.lower()]
        elif word[-1] in self.marks and word.isascii() and word[:-1].isalpha():
            v = [word[:-1].lower(), word[-1]]
        else:
            v = self.by_rules(word)
        self[word] = v
        return v

    def by_rules(self, word: str) -> list[str]:
        t = self.tokenizer
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))]

    def words(self, text: str) -> list[str]:
        """The text's words, special tokens as SPECIAL."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            out = [SPECIAL] * (len(parts) - 1)
        else:
            parts, out = [text], []
        for part in parts:
            out += [w for w in UNICODE_SPACE.split(part) if w] if CONTROL.search(part) else part.split()
        return out


class Known(dict):
    """word -> pieces of those of its pre-tokens whose number is known here; ``rare`` has the other ones of a word. Starts
    anew when full."""

    def __init__(self, pre_tokens: PreTokens, hot: dict[str, int]) -> None:
        self.pre_tokens, self.hot, self.rare = pre_tokens, hot, {}

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
            self.rare.clear()
        found = self.pre_tokens[word]
        if other := [p for p in found if p not in self.hot]:
            self.rare[word] = other
        self[word] = v = sum(self.hot.get(p, 0) for p in found)
        return v

    def of(self, text: str) -> tuple[int, Counter]:
        """Pieces of the known pre-tokens of a text, and how often each other one occurs in it."""
        counts, sure, rest = Counter(self.pre_tokens.words(text)), 0, Counter()
        for word, n in counts.items():
            sure += n * self[word]
            if word in self.rare:
                for p in self.rare[word]:
                    rest[p] += n
        return sure, rest


def count_tokens(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, as the tokenizer of the file gives them without added tokens.

    Null text: empty, no tokens. Strings of special tokens inside a text count as one token each. Repeated rows give
    repeated results: equal rows (id and text) are counted together and divided again. The id may be of any type and
    null; other columns are not read. No documents: no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with open(tokenizer_file, encoding="utf-8") as f:
        rules = f.read()
    small = docs.sparkSession.sparkContext.broadcast(rules)  # the vocabulary file: a fixed size

    def pre_tokens() -> PreTokens:
        return of_worker(("pre-tokens", tokenizer_file), lambda: PreTokens(Tokenizer.from_str(small.value)))

    def sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = pre_tokens(), Counter()

        def flushed() -> pa.RecordBatch:
            sums: Counter = Counter()
            for word, n in seen.items():
                for p in own[word]:
                    sums[p] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(set(own.words(text.as_py())))  # documents: a long text says no more of its own words than a short one
                if len(seen) > 300_000:  # bounded memory: partial counts go out, Spark adds them up
                    yield flushed()
        yield flushed()

    def size(piece: str) -> int:
        return 1 if piece == SPECIAL else len(pre_tokens().tokenizer.model.tokenize(piece))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [size(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], ["piece", "pieces"])

    n_docs = rows.count()
    sample = (
        rows.select("text").sample(min(1.0, SAMPLE / max(n_docs, 1)), seed=5)
        .mapInArrow(sample_counts, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).checkpoint()
    )
    total = sample.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = sample.filter((F.col("n") * HOT_SHARE >= total) & (F.col("n") >= LEAST_DOCS)).select("piece")
    # At most HOT_SHARE entries, whatever the corpus.
    hot = {r.piece: r.pieces for r in frequent.mapInArrow(sizes, "piece string, pieces int").toLocalIterator()}
    hot_counts = docs.sparkSession.sparkContext.broadcast(hot)

    keyed = rows.select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out_type = T.StructType(
        [*keyed.schema.fields[:3], T.StructField("piece", T.StringType()), T.StructField("n", T.LongType()), T.StructField("copies", T.LongType())]
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the document with what the frequent pre-tokens sum to, and one for each other pre-token."""
        known = Known(pre_tokens(), hot_counts.value)
        for batch in slices(batches):
            at, piece, number, copies = [], [], [], []
            for i, text in enumerate(batch.column(3)):
                sure, rest = known.of(text.as_py())
                at += [i] * len(rest)
                piece += rest.keys()
                number += rest.values()
                copies += [0] * len(rest)
                at.append(i), piece.append(f"\x00{i}"), number.append(sure), copies.append(1)
            same = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(same) for c in range(3)), pa.array(piece, pa.string()), pa.array(number, pa.int64()), pa.array(copies, pa.int64())],
                out_type.names,
            )

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by pre-token: each is counted when it first comes."""
        last, pieces = None, 0
        for batch in batches:
            coded = batch.column(3).dictionary_encode()
            table = []
            for p in coded.dictionary.to_pylist():
                if p != last:
                    # Rows of documents carry a name that no pre-token has; it also spreads them.
                    last, pieces = p, 1 if p[0] == "\x00" and p != SPECIAL else size(p)
                table.append(pieces)
            counts = pa.array(table, pa.int64()).take(coded.indices)
            columns = [batch.column(c) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pc.multiply(batch.column(4), counts), batch.column(5)], summed.names)

    summed = T.StructType([*out_type.fields[:3], *out_type.fields[4:]])
    dealt = keyed.mapInArrow(frequencies, out_type).repartition("piece").sortWithinPartitions("piece")
    return (
        dealt.mapInArrow(multiplied, summed)
        .groupBy("doc_id", "key", "n_bytes")
        .agg(F.sum("n").alias("all"), F.sum("copies").alias("copies"))
        .select(
            "doc_id", "n_bytes", F.expr("all div copies").alias("n_tokens"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )
