"""Hard negatives by rotated one-bit codes with stored alignments.

A vector x is coded in levels. Level l rotates what the levels before have left, keeps its signs as bits (a unit vector u_l
along the signs) and stores the alignment a_l = <rest, u_l>; the rest becomes rest - a_l u_l, orthogonal to u_l. In the end
x = a_1 u_1 + … + a_L u_L + rest, and only the rest's length is kept. For a query q the products <u_l, q> come from
popcounts of the code with the bit planes of the rotated and quantised query, and by Cauchy and Schwarz

    | <x, q> - sum a_l <u_l, q'> |  <=  |rest| |q| + sum |a_l| |q - q'|     (q': the quantised query)

holds without exception. Rows whose interval cannot reach the result are left out; all others are scored in integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256
LEVELS, PLANES = 6, 7
ROW_TILE, ANCHOR_TILE = 32_768, 16_384
LEAST_TILE = 512  # rows, where smaller tiles give every core a few cells
MOST_TASKS = 10_000
PAIRS = 1 << 18  # intervals computed at once
NO_ID = 2**63 - 1  # stands for a null id inside, so it sorts last
CODED = T.StructType([
    T.StructField("slot", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()),
    T.StructField("numbers", T.BinaryType()), T.StructField("codes", T.BinaryType()),
    T.StructField("aligned", T.BinaryType()), T.StructField("rest", T.DoubleType()),
])

POSITIVES = {"slot": "long", "anchor_id": "long", "label": "long", "numbers": "binary", "vec_id": "long", "score": "long"}
NEGATIVES = {
    "slot": "long", "anchor_id": "long", "place": "int", "positive_id": "long", "positive_score": "long",
    "vec_id": "long", "score": "long",
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in columns.items())


def arrow_table(rows: list[tuple], columns: dict[str, str]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.table({c: pa.array(v, kinds[k]) for (c, k), v in zip(columns.items(), values)})


def rotations(width: int, levels: int, seed: int) -> np.ndarray:
    """One random orthogonal matrix a level."""
    normal = np.random.default_rng(seed).standard_normal((levels, width, width))
    return np.stack([np.linalg.qr(m)[0] for m in normal])


def largest_number(width: int) -> int:
    """Components beyond it are cut to it, so that scores stay below 2^56."""
    return min(2**31 - 1, int((2**56 / width) ** 0.5))


def encode(numbers: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits (row, level, word), alignments (row, level) and lengths of the rests of rows of integers."""
    levels, width, _ = turns.shape
    rest = numbers.astype(np.float64)
    bits = np.empty((len(rest), levels, width // 64), np.uint64)
    aligned = np.empty((len(rest), levels))
    for level, turn in enumerate(turns):
        turned = rest @ turn
        signs = turned >= 0
        bits[:, level] = np.packbits(signs, axis=1, bitorder="little").view("<u8")
        unit = np.where(signs, 1.0, -1.0) / width**0.5
        aligned[:, level] = (turned * unit).sum(axis=1)
        rest = rest - (aligned[:, level, None] * unit) @ turn.T
    # A little more than the length, which covers the rounding of all steps before.
    return bits, aligned, np.linalg.norm(rest, axis=1) + 1e-9 * (1 + np.abs(numbers).sum(axis=1))


class Queries:
    """Rotated queries as bit planes for popcounts, for a block of anchors at once."""

    def __init__(self, numbers: np.ndarray, turns: np.ndarray, planes: int = PLANES) -> None:
        q = numbers.astype(np.float64)
        levels, width, _ = turns.shape
        self.numbers, self.width, self.planes = numbers, width, planes
        self.length = np.linalg.norm(q, axis=1)
        turned = np.stack([q @ turn for turn in turns], axis=1)  # anchor, level, coordinate
        self.low = turned.min(axis=2)
        self.step = np.maximum((turned.max(axis=2) - self.low) / (2**planes - 1), 1e-300)
        steps = np.rint((turned - self.low[..., None]) / self.step[..., None]).astype(np.int64)
        back = self.low[..., None] + self.step[..., None] * steps
        self.sum = back.sum(axis=2)
        self.off = np.linalg.norm(turned - back, axis=2) * (1 + 1e-9) + 1e-9 * (1 + self.length[:, None])
        self.masks = np.empty((len(q), levels, planes, width // 64), np.uint64)
        for b in range(planes):
            self.masks[:, :, b] = np.packbits((steps >> b) & 1 == 1, axis=2, bitorder="little").view("<u8")

    def intervals(
        self, own: slice, bits: np.ndarray, ones: np.ndarray, aligned: np.ndarray, rest: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each coded row, for each of the own anchors."""
        length, masks = self.length[own, None], self.masks[own]
        middle, wide = np.zeros((len(length), len(rest))), rest * length
        for level in range(bits.shape[1]):
            marked = np.zeros(middle.shape, np.int32)
            for b in range(self.planes):
                for w in range(bits.shape[2]):
                    both = np.bitwise_count(bits[:, level, w] & masks[:, level, b, w, None])
                    marked += both.astype(np.int32) << b
            # The coordinates under one bits count positive, the others negative.
            low, step, total, off = (x[own, level, None] for x in (self.low, self.step, self.sum, self.off))
            positive = low * ones[:, level] + step * marked
            middle += aligned[:, level] * (2 * positive - total) / self.width**0.5
            wide += np.abs(aligned[:, level]) * off
        wide += 1e-9 * (1 + np.abs(middle))
        return middle - wide, middle + wide


def fixed(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    values = b"".join(column.to_pylist())
    return np.frombuffer(values, kind).reshape(len(column), width)


class Tile:
    """Coded rows sorted by label."""

    def __init__(self, rows: pa.Table, width: int, levels: int) -> None:
        label = rows.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.id, self.slot, self.rest = (rows.column(c).to_numpy()[order] for c in ("vec_id", "slot", "rest"))
        self.numbers = fixed(rows.column("numbers"), "<i4", width)[order]
        self.bits = fixed(rows.column("codes"), "<u8", levels * width // 64)[order].reshape(len(order), levels, width // 64)
        self.ones = np.bitwise_count(self.bits).sum(axis=2, dtype=np.int64)
        self.aligned = fixed(rows.column("aligned"), "<f8", levels)[order]

    def same(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]).tolist())

    def intervals(self, queries: Queries, own: slice, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return queries.intervals(own, self.bits[rows], self.ones[rows], self.aligned[rows], self.rest[rows])

    def scores(self, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return self.numbers[rows].astype(np.int64) @ numbers.astype(np.int64)

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the best k rows, ties by the smaller id."""
        best = np.lexsort((self.id[rows], -scores))[:k]
        return list(zip(self.id[rows[best]].tolist(), scores[best].tolist()))


def kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def best_same(tile: Tile, slot: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, numbers: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The anchor's first k other rows among those of its label, by their intervals."""
    other = tile.slot[rows] != slot
    rows, low, high = rows[other], low[other], high[other]
    rows = rows[high >= kth_largest(low, k)]
    return tile.first(rows, tile.scores(rows, numbers), k)


def best_between(
    tile: Tile, rows: np.ndarray, low: np.ndarray, high: np.ndarray, numbers: np.ndarray, bounds: list[int], share: tuple[int, int], k: int
) -> list[list[tuple[int, int]]]:
    """For each positive score the first k of the rows whose score is within its band of percentages, by their intervals."""
    wanted = np.zeros(len(rows), bool)
    for score in bounds:
        floor, ceiling = share[0] * score / 100, share[1] * score / 100
        sure = low[(low >= floor) & (high <= ceiling)]
        wanted |= (high >= max(floor, kth_largest(sure, k))) & (low <= ceiling)
    rows = rows[wanted]
    scores = tile.scores(rows, numbers)
    out = []
    for score in bounds:
        inside = (100 * scores >= share[0] * score) & (100 * scores <= share[1] * score)
        out.append(tile.first(rows[inside], scores[inside], k))
    return out


def coded_rows(vectors: DataFrame, levels: int, seed: int) -> tuple[DataFrame, int]:
    """The rows that take part, coded, as a table below the checkpoint folder; and their width, a multiple of 64."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.select(
        F.coalesce(F.col("vec_id").try_cast("long"), F.lit(NO_ID)).alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter(F.col("label").isNotNull() & x.isNotNull() & finite)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = -(-max(longest, 1) // 64) * 64
    turns, limit = rotations(width, levels, seed), largest_number(width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            numbers = np.zeros((batch.num_rows, width), np.int32)
            at = np.arange(width)[None, :] < sizes[:, None]
            numbers[at] = np.clip(np.floor(SCALE * vectors.flatten().to_numpy()), -limit, limit)
            bits, aligned, rest = encode(numbers, turns)
            columns = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (numbers, bits, aligned)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, pa.array(rest)], CODED.names[1:])

    folder = f"{spark.sparkContext.getCheckpointDir()}/coded-{uuid.uuid4().hex}"
    without_slot = T.StructType(CODED.fields[1:])
    # The slot names a row, so that equal rows stay apart; it is stored, since a task that is repeated may number anew.
    rows.mapInArrow(coded, without_slot).withColumn("slot", F.monotonically_increasing_id()).write.parquet(folder)
    return spark.read.schema(CODED).parquet(folder), width


def tile(n: int) -> Column:
    """One of ``n`` tiles, by the slot's hash."""
    return F.pmod(F.xxhash64("slot"), F.lit(n)).cast("int")


def in_cells(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], sizes: tuple[int, int]):
    """Every tile of anchors meets every tile of rows in a cell of bounded size.

    The number of tasks is set here: cells are small in bytes and long in work, so they must not be joined by their size."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_own = max(1, -(-counts[0] // sizes[0]))
    n_other = max(1, -(-counts[1] // sizes[1]), min(3 * cores, counts[1] // LEAST_TILE))
    tasks = min(n_own * n_other, MOST_TASKS)
    left = anchors.withColumn("a", tile(n_own)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    right = rows.withColumn("b", tile(n_other)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_own - 1))))
    return left.repartition(tasks, "a", "b").groupBy("a", "b").cogroup(right.repartition(tasks, "a", "b").groupBy("a", "b"))


def hard_negatives(
    vectors: DataFrame,
    anchor_every: int = 50,
    n_positives: int = 5,
    n_negatives: int = 3,
    share: tuple[int, int] = (50, 95),
    levels: int = LEVELS,
    seed: int = 12,
    tile_rows: tuple[int, int] = (ANCHOR_TILE, ROW_TILE),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows of (vec_id, embedding, label) take part unless label, vector or a component is null or not finite. A component x
    counts as floor(256 x), cut to what keeps scores within 2^56; shorter vectors, also empty ones, are filled with 0. A
    row's score is its integer inner product with the anchor; higher scores come first, ties by smaller vec_id.
    Anchors: rows whose vec_id divides by ``anchor_every``. Their positives are the first ``n_positives`` other rows of the
    same label; for each of these the first ``n_negatives`` rows of other labels whose score lies between the two
    percentages of the positive's are returned. A repeated vec_id is a row of its own, as anchor and as partner; a null
    vec_id (also one that is no whole number) is no anchor, comes last among ties and is null. Empty tables give no rows; other columns are not read.

    All rows meet all anchors, in cells of one tile of anchors and one of rows, so that no task holds more than a cell and no
    anchor passes the driver; a tile is a hash of the row's number, whatever ids, labels or vectors repeat. Each cell returns
    its best few rows of every anchor; a window keeps the first of all cells.
    """
    coded, width = coded_rows(vectors, levels, seed)
    is_anchor = F.pmod(F.col("vec_id"), F.lit(anchor_every)) == 0
    is_anchor &= F.col("vec_id") != NO_ID
    total = coded.agg(F.count("*"), F.count_if(is_anchor)).first()
    turns = rotations(width, levels, seed)
    anchors = coded.filter(is_anchor).select("slot", "vec_id", "label", "numbers")
    counts = (total[1], total[0])

    def each(own: pa.Table, tile: Tile, same: bool) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Every anchor with the tile's rows of its label, or of all others, and their intervals. Anchors of one label
        go together, in blocks of some hundred thousand pairs."""
        own = own.sort_by("label")
        labels = own.column("label").to_numpy()
        for label in np.unique(labels):
            part = tile.same(label)
            outside = np.arange(part.start), np.arange(part.stop, len(tile.label))
            rows = np.arange(part.start, part.stop) if same else np.concatenate(outside)
            begin, end = np.searchsorted(labels, [label, label + 1]).tolist()
            size = max(1, PAIRS // max(1, len(rows)))
            for start in range(begin, end, size):
                block = own.slice(start, min(size, end - start))
                queries = Queries(fixed(block.column("numbers"), "<i4", width), turns)
                low, high = tile.intervals(queries, slice(None), rows)
                for i, row in enumerate(block.drop_columns("numbers").to_pylist()):
                    yield row, queries.numbers[i], rows, low[i], high[i]

    def positives(own: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        tile = Tile(rows, width, levels)
        for row, numbers, at, low, high in each(own, tile, True):
            for vec_id, score in best_same(tile, row["slot"], at, low, high, numbers, n_positives):
                out.append((row["slot"], row["vec_id"], row["label"], numbers.tobytes(), vec_id, score))
        return arrow_table(out, POSITIVES)

    def negatives(own: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        tile = Tile(rows, width, levels)
        for row, numbers, at, low, high in each(own, tile, False):
            bounds = [p["score"] for p in row["positives"]]
            for positive, found in zip(row["positives"], best_between(tile, at, low, high, numbers, bounds, share, n_negatives)):
                known = (row["slot"], row["anchor_id"], positive["place"], positive["vec_id"], positive["score"])
                out.extend((*known, vec_id, score) for vec_id, score in found)
        return arrow_table(out, NEGATIVES)

    order = (F.desc("score"), F.asc("vec_id"))
    best = (
        in_cells(anchors, coded, counts, tile_rows)
        .applyInArrow(positives, ddl(POSITIVES))
        .withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
        .filter(F.col("place") <= n_positives)
        .groupBy("slot")
        .agg(
            *[F.first(c).alias(c) for c in ("anchor_id", "label", "numbers")],
            F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"),
        )
        .checkpoint()
    )
    result = (
        in_cells(best, coded, counts, tile_rows)
        .applyInArrow(negatives, ddl(NEGATIVES))
        .withColumn("rank", F.row_number().over(Window.partitionBy("slot", "place").orderBy(*order)))
        .filter(F.col("rank") <= n_negatives)
    )

    def named(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c))

    return result.select(
        "anchor_id", named("positive_id").alias("positive_id"), "rank", named("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )

