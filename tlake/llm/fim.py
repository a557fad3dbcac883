"""Fill-in-middle: texts are cut at two drawn places and written with the middle last.

Places are counted in code points and found in UTF-8. The bytes of a slice of rows are viewed as 64-bit words. Arithmetic on
whole words marks each byte that ends a code point, bitwise_count gives the marks of a word, a search in their running sum
gives the word of a place, and one multiplication with a comparison gives the byte inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix, suffix and middle marks.
SENTINELS = ("<P>", "<S>", "<M>")
SLICE_ROWS, SLICE_BYTES = 4096, 8_000_000
LOW, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def u64(n: int) -> np.uint64:
    return np.uint64(n)


class Units:
    """Code points of UTF-8 bytes by number. Places are byte offsets; a unit ends before the offset that follows it."""

    def __init__(self, data: np.ndarray) -> None:
        n_words = len(data) // 8 + 1
        padded = np.zeros(n_words * 8 + 8, np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        follows = (words >> u64(7)) & ~(words >> u64(6)) & LOW  # bytes 10xxxxxx continue a unit
        begins = follows ^ LOW
        # A byte ends a unit if the next one begins one.
        self.ends = (begins[:-1] >> u64(8)) | (begins[1:] << u64(56))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many units end before each place."""
        word = places >> 3
        below = (u64(1) << ((places & 7) << 3).astype(np.uint64)) - u64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """The place after unit number 1, 2, …"""
        word = np.searchsorted(self.before, numbers, side="left") - 1
        inside = (numbers - self.before[word]).astype(np.uint64)  # 1 to 8
        sums = self.ends[word] * LOW  # byte j: marks in bytes 0 to j
        reached = ((sums | HIGH) - inside * LOW) & HIGH
        return word * 8 + (8 - np.bitwise_count(reached).astype(np.int64)) + 1


def cut_places(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units n of each text between two offsets, both cuts in units (draw % (n + 1), smaller first), and as byte places."""
    units = Units(data)
    done = units.rank(offsets)
    n = np.diff(done)
    cuts = np.sort(draws % (n + 1)[:, None], axis=1)
    places = np.where(cuts > 0, units.select(np.maximum(done[:-1, None] + cuts, 1)), offsets[:-1, None])
    return n, cuts, places


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE_ROWS rows and about SLICE_BYTES bytes of text, at least one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends, start = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def draw(doc_id: Column, seed: int) -> Column:
    """Four numbers below 2^32 from the SHA-256 of ``seed:id``; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Splitting is exact if no mark can begin in a text and end in a mark or the other way round."""
    heads = {s[:1] for s in sentinels}
    if len(set(sentinels)) < 3 or not all(sentinels) or any(h in s[1:] for h in heads for s in sentinels) or len({len(s) for s in sentinels}) > 1:
        raise ValueError("three different marks of one length, none with a first character of a mark further inside")


def fill_in_middle(
    docs: DataFrame,
    fim_percent: int = 90,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
    seed: int = 1,
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of (doc_id, text).

    n is the code points of the whole text (null: empty). The draws depend on id and ``seed`` only, so equal rows give
    equal rows and a repeated task the same output; the id may be of any type that casts to text, null counts as ''.
    Form: plain (the text as it is; no cuts, null counts) if the text is empty or contains a mark, or for the share that is
    not to be changed; else spm or psm. Other columns are not read. No shuffle.
    """
    check_sentinels(sentinels)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), draw(F.col("doc_id"), seed).alias("draws"))
    p, s, m = (x.encode() for x in sentinels)
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            texts = part.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            first = int(offsets[0])
            data = np.frombuffer(texts.buffers()[2], np.uint8)[first : offsets[-1]] if offsets[-1] > first else np.zeros(0, np.uint8)
            offsets = offsets - first
            draws = part.column(2).flatten().to_numpy().reshape(-1, 4)
            n, cuts, places = cut_places(data, offsets, draws[:, :2])
            forms, outputs, raw = [], [], data.tobytes()
            for i, (begin, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                text, (a, b) = raw[begin:end], (places[i] - begin).tolist()
                if not text or draws[i, 2] % 100 >= fim_percent or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                elif draws[i, 3] % 100 < spm_percent:
                    forms.append("spm")
                    outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
            plain = np.array(forms) == "plain"
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(n), pa.array(forms, pa.string()),
                    pa.array(cuts[:, 0], mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                schema.names,
            )

    return rows.mapInArrow(transformed, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, exactly, from output and form alone."""
    p, s, m = map(F.lit, sentinels)

    def parts(begin: Column, second: Column) -> tuple[Column, Column, Column]:
        head, tail = F.split_part(output, second, F.lit(1)), F.split_part(output, second, F.lit(2))
        return F.substring(head, F.length(begin) + 1, F.length(head)), F.split_part(tail, m, F.lit(1)), F.split_part(tail, m, F.lit(2))

    prefix, suffix, middle = parts(p, s)
    suffix_first, prefix_second, middle_last = parts(s, p)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle_last, suffix_first))
        .otherwise(output)
    )


def digests(filled: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with SHA-256 of output and of the text rebuilt from output and form."""
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
