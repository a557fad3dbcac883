"""Byte-level BPE by a file of ranks: overlapping chunk encoding, and decoding.

A long text is cut into chunks that overlap. Chunks are pre-tokenised and encoded in parallel. What the pattern matches
from a place on depends only on the text from there on, so two neighbours agree from the first boundary that both have in
their overlap, and are stitched there. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import of_worker, slices, text_key

CHUNK, OVERLAP = 32_768, 512
NO_RANK = 1 << 60
NONE = np.int32((1 << 31) - 1)
TOKENS = 1 << 20  # decoded at once
SHORT = 48  # bytes up to which looking at all pairs is faster than a heap
ROWS = 2048  # pieces merged at once
GROUP = 16  # chunks encoded together
KEPT = 200_000  # pieces whose ids a worker keeps


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank, leftmost first, is merged until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        parts = [piece[i : i + 1] for i in range(n)]
        found = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while found and (least := min(found)) < NO_RANK:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        return [ranks[p] for p in parts]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Merges:
    """The merges of many pieces at once. A piece is a row of ids, at first of its bytes; in a round every row merges its pair of
    least rank, leftmost first, until no row has a pair with a rank. The pairs are kept sorted, so a round is array work."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it has none or the row has ended (-1)."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit numbers one after another. Pieces of like length are merged together."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for start in range(0, len(order), ROWS):
            block = order[start : start + ROWS]
            for i, ids in zip(block, self.block([pieces[i] for i in block])):
                out[i] = ids
        return out

    def block(self, pieces: list[bytes]) -> list[bytes]:
        sizes = np.array([len(p) for p in pieces])
        wide = int(sizes.max()) + 1  # one more, so that every row ends with a -1
        ids = np.full((len(pieces), wide), -1, np.int32)
        ids[np.arange(wide) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        found = self.rank(ids[:, :-1], ids[:, 1:])
        todo, done = np.arange(len(pieces)), [b""] * len(pieces)
        place = np.arange(wide)
        while True:
            at = found.argmin(axis=1)
            least = found[np.arange(len(todo)), at]
            if (ended := least == NONE).any():
                left_over = ids[ended]
                whole, sizes = left_over.tobytes(), (left_over >= 0).sum(axis=1) * 4
                for k, (i, size) in enumerate(zip(todo[ended].tolist(), sizes.tolist())):
                    done[i] = whole[k * wide * 4 : k * wide * 4 + size]
                todo, ids, found, at, least = (x[~ended] for x in (todo, ids, found, at, least))
                if not len(todo):
                    return done
            rows = np.arange(len(todo))
            ids = np.take_along_axis(ids, np.minimum(place + (place > at[:, None]), wide - 1), axis=1)
            ids[:, -1] = -1
            ids[rows, at] = least
            found = np.take_along_axis(found, np.minimum(place[:-1] + (place[:-1] > at[:, None]), wide - 2), axis=1)
            found[:, -1] = NONE
            found[rows, at] = self.rank(least, ids[rows, at + 1])
            left = np.maximum(at - 1, 0)
            found[rows, left] = np.where(at > 0, self.rank(ids[rows, left], least), found[rows, left])


class Encoder:
    """Ids of pieces are kept as bytes, which are joined once for each text. What is kept starts anew when full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.merges, self.findall = ranks, Merges(ranks), regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}

    def learn(self, found: list[list[str]]) -> None:
        """Make sure that all pieces are known."""
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        new = list(set().union(*found) - self.pieces.keys())
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        short = [i for i, p in enumerate(raw) if len(p) <= SHORT]
        ids = dict(zip(short, self.merges([raw[i] for i in short])))
        for i, p in enumerate(new):
            self.pieces[p] = ids[i] if i in ids else np.array(merge(raw[i], self.ranks), np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers one after another."""
        found = [self.findall(t) for t in texts]
        self.learn(found)
        return [b"".join(map(self.pieces.__getitem__, f)) for f in found]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], np.int32)

    def encode_chunk(self, text: str) -> tuple[bytes, bytes, bytes]:
        return next(self.encode_chunks([text]))

    def encode_chunks(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """For each chunk its ids, and for each piece that begins in the first or last OVERLAP characters its place and its first
        id's index, each as 32-bit numbers one after another, which take an eighth of what lists of them take in Python.
        The begins of the last two pieces are left out: what the cut hides could still change them."""
        all_found = [self.findall(t) for t in texts]
        self.learn(all_found)
        for text, found in zip(texts, all_found):
            ids = [self.pieces[p] for p in found]
            at = [0, *accumulate(map(len, found))][: max(1, len(found) - 1)]
            first = [0, *accumulate(len(x) // 4 for x in ids)]
            near = [i for i, a in enumerate(at) if a <= OVERLAP or a >= len(text) - OVERLAP]
            yield b"".join(ids), *(np.fromiter(x, np.int32).tobytes() for x in ((at[i] for i in near), (first[i] for i in near)))


def numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int32)


def stitch(chunks: list[dict], encoder: Encoder) -> np.ndarray:
    """Ids of a text from its chunks in order. Where an overlap has no common boundary (a run longer than the overlap),
    the text is put together from the chunks and encoded at once."""
    if len(chunks) == 1:
        return numbers(chunks[0]["ids"])
    out: list[np.ndarray] = []
    begin = 0  # first id of this chunk that is not taken yet
    for n, (left, right) in enumerate(zip(chunks, chunks[1:])):
        ends = {a - CHUNK: i for a, i in zip(numbers(left["at"]).tolist(), numbers(left["first"]).tolist()) if a >= CHUNK and i >= begin}
        common = [(a, i) for a, i in zip(numbers(right["at"]).tolist(), numbers(right["first"]).tolist()) if a <= OVERLAP and a in ends]
        if not common:
            text = "".join(c["text"][:CHUNK] for c in chunks[:-1]) + chunks[-1]["text"]
            return encoder.encode(text)
        out.append(numbers(left["ids"])[begin : ends[common[0][0]]])
        begin = common[0][1]
    out.append(numbers(chunks[-1]["ids"])[begin:])
    return np.concatenate(out)


def cut(text: str) -> list[str]:
    """Chunks of CHUNK characters, each with the next OVERLAP ones; none but the last is shorter."""
    n = max(1, -(-(len(text) - OVERLAP) // CHUNK))
    return [text[i * CHUNK : (i + 1) * CHUNK + OVERLAP] for i in range(n)]


def encode(docs: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids: the token ids of every whole text, without special tokens.

    Null text: empty, no ids. Repeated rows give repeated results. The id may be of any type and null; other columns are
    not read. Texts of one chunk are encoded where they are read. Longer ones are cut, their chunks dealt out to all
    tasks, and put together by (id, digest of the text), so that no row number is needed.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    ranks = load_ranks(rank_file)
    fits = F.length("text") <= CHUNK + OVERLAP
    ids_type = T.ArrayType(T.IntegerType())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(("bpe", rank_file, pattern), lambda: Encoder(ranks, pattern))
        for part in slices(batches):
            ids = encoder.encode_all(part.column(1).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])
        encoder.pieces.clear()  # the worker lives on, maybe for other work

    short = rows.filter(fits).mapInArrow(whole, T.StructType([rows.schema["doc_id"], T.StructField("ids", ids_type)]))

    keyed = rows.filter(~fits).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    chunk_type = T.StructType([*keyed.schema.fields[:2], T.StructField("n", T.IntegerType()), keyed.schema.fields[2]])

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                parts = cut(text.as_py())
                same = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), batch.column(1).take(same), pa.array(range(len(parts)), pa.int32()), pa.array(parts, batch.schema.field(2).type)],
                    ["doc_id", "key", "n", "text"],
                )

    coded_type = "ids binary, at binary, first binary"

    @F.pandas_udf(coded_type)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = of_worker(("bpe", rank_file, pattern), lambda: Encoder(ranks, pattern))
        for texts in batches:
            groups = (texts.iloc[i : i + GROUP].tolist() for i in range(0, len(texts), GROUP))
            yield pd.DataFrame([c for g in groups for c in encoder.encode_chunks(g)], columns=["ids", "at", "first"])
        encoder.pieces.clear()

    chunks = keyed.mapInArrow(cut_batches, chunk_type).repartition("key", "n")
    chunks = chunks.select("doc_id", "key", "n", "text", coded("text").alias("c")).select("doc_id", "key", "n", "text", "c.*")

    @F.pandas_udf(ids_type)
    def stitched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = of_worker(("bpe", rank_file, pattern), lambda: Encoder(ranks, pattern))
        for rows in batches:
            yield pd.Series([stitch(list(r), encoder) for r in rows], dtype="object")

    # Equal rows (id and text) meet: their chunks are the same, one set is stitched and given once for each.
    one = (
        chunks.groupBy("doc_id", "key", "n")
        .agg(F.count("*").alias("copies"), *[F.first(x).alias(x) for x in ("text", "ids", "at", "first")])
        .groupBy("doc_id", "key")
        .agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("n", "text", "ids", "at", "first"))).alias("c"))
        .select("doc_id", "copies", stitched("c").alias("ids"))
    )
    long = one.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc_id", "ids")
    return short.unionByName(long).withColumn("doc_id", F.col("doc_id").cast(id_type))


class Decoder:
    """The bytes of all tokens in one array; ids become places in it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        for rank, token in tokens.items():
            self.sizes[rank] = len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.sizes))), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for start in range(0, len(ids), TOKENS):
            part = ids[start : start + TOKENS]
            sizes = self.sizes[part]
            begins = np.cumsum(sizes) - sizes
            out.append(self.data[np.repeat(self.starts[part] - begins, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """The rows of ``encoded`` with the column ``decoded``: the bytes of the ids, one after another. Null ids: none."""
    ranks = load_ranks(rank_file)
    at = encoded.columns.index("ids")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = of_worker(("decoder", rank_file), lambda: Decoder(ranks))
        for part in slices(batches):
            decoded = [decoder.decode(r.values.to_numpy()) if r.is_valid else b"" for r in part.column(at)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(joined, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids' decimal text and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
