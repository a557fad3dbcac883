"""N-gram Jaccard join by vertical partitioning.

Documents are sets of hashed word shingles; equal sets are one class. The global shingle order is by frequency, then hash.

1. Hash ranges cut all shingles into fragments. Each fragment counts in how many classes its shingles occur and gives back
   each class's shared ones (two classes or more). A class needs 85 % shared shingles to link with any other.
2. Linked sets share a shingle in their prefixes. Every class is paired with one pivot for each prefix shingle, the class
   with the fewest shingles of its own: so a group of near copies gives as many pairs as members, not their square.
3. Overlaps of pairs are counted in vertical fragments of the order, each for itself, and summed per pair.
4. Pairs that share a prefix shingle, lie in different components after step 3 and pass the size and position bounds are
   counted the same way. Only pairs that step 3 has connected are never counted, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FRAGMENT_SHINGLES = 2_500_000  # shingles that one task counts; each class names itself once in each fragment
VERTICAL = 8  # fragments in which a pair's overlap is counted
BLOCK = 1024  # classes of one bucket that meet in one task


class Shingler:
    """Hashes of the word shingles of a text: a polynomial over its bytes modulo 2^64, mixed."""

    def __init__(self, width: int) -> None:
        random = np.random.default_rng(20240229)
        self.width = width
        self.byte = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            of = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            self.powers, self.inverses = of(self.base), of(self.inverse)

    def distinct(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; with fewer words than the width, one of the whole sequence; without words, none."""
        joined = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
        if not joined:
            return np.empty(0, np.uint64)
        c = np.frombuffer(joined, np.uint8)
        self.grow(len(c) + 1)
        prefix = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(self.byte[c] * self.powers[: len(c)], out=prefix[1:])
        gaps = np.flatnonzero(c == 32)
        start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(c)]])
        if len(start) > self.width:
            start, end = start[: len(start) - self.width + 1], end[self.width - 1 :]
        else:
            start, end = start[:1], end[-1:]
        h = (prefix[end] - prefix[start]) * self.inverses[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def unpacked(group: pa.Table, column: str, kind: np.dtype | type) -> np.ndarray:
    """The numbers in all values of a binary column, one after another. They are read where Arrow holds them, without a Python
    value for each row."""
    parts = []
    for chunk in group.column(column).chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and offsets[-1] > offsets[0]:
            parts.append(np.frombuffer(memoryview(chunk.buffers()[2])[offsets[0] : offsets[-1]], kind))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, kind)


def members(docs: DataFrame, width: int = 4, also: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, key (null without words) of every row, and the columns of ``also``."""
    rows = docs.select("doc_id", "text", *also)
    given = rows.schema.fields
    out = T.StructType([given[0], T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), *given[2:]])

    names = out.names

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, keys = [], []
            for t in batch.column(1):
                h = shingler.distinct(t.as_py())
                sizes.append(len(h))
                keys.append(set_key(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *batch.columns[2:]], names)

    return rows.mapInArrow(sized, out)


def candidates(docs: DataFrame, width: int, percent: int, fragments: int) -> DataFrame:
    """key, n, kept, t: the classes of which ``percent`` of the shingles occur in other classes as well, with these
    ``kept`` shingles in the global order: by number of classes (65,535 and more are one), then by hash.

    Shingles travel in packed blocks: from the readers to the fragments, and from there to buckets of classes.
    """
    edges = [(1 << 64) * i // fragments for i in range(1, fragments)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bounds = Shingler(width), np.array(edges, np.uint64)
        for batch in slices(batches, 2048):
            seen: set[bytes] = set()
            parts: list[list[tuple[bytes, int, np.ndarray]]] = [[] for _ in range(fragments)]
            for t in batch.column(0):
                h = shingler.distinct(t.as_py())
                if not len(h) or (key := set_key(h)) in seen:
                    continue
                seen.add(key)
                at = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                for i in range(fragments):
                    if at[i] < at[i + 1]:
                        parts[i].append((key, len(h), h[at[i] : at[i + 1]]))
            filled = [(i, p) for i, p in enumerate(parts) if p]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in filled], pa.int32()),
                    pa.array([b"".join(k for k, _, _ in p) for _, p in filled], pa.binary()),
                    pa.array([np.array([(n, len(h)) for _, n, h in p], np.int64).tobytes() for _, p in filled], pa.binary()),
                    pa.array([np.concatenate([h for _, _, h in p]).tobytes() for _, p in filled], pa.binary()),
                ],
                ["fragment", "keys", "sizes", "hashes"],
            )

    def count(group: pa.Table) -> pa.Table:
        keys = unpacked(group, "keys", np.dtype("V16"))
        sizes = unpacked(group, "sizes", np.int64).reshape(-1, 2)
        hashes = unpacked(group, "hashes", np.uint64)
        first = np.zeros(len(keys), bool)  # equal sets from several tasks are one class
        first[np.unique(keys.view(np.uint64).reshape(-1, 2), axis=0, return_index=True)[1]] = True
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), sizes[:, 1])
        if not first.all():
            use = first[owner]
            hashes, owner = hashes[use], owner[use]
        order = np.argsort(hashes)
        in_order = hashes[order]
        runs = np.diff(np.concatenate([[0], np.flatnonzero(in_order[1:] != in_order[:-1]) + 1, [len(in_order)]]))
        del in_order
        df = np.empty(len(hashes), np.uint16)
        df[order] = np.repeat(np.minimum(runs, 65_535).astype(np.uint16), runs)
        many = df > 1
        hashes, owner, df = hashes[many], owner[many], df[many]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        who, ends = owner[starts], np.append(starts[1:], len(owner))
        packed = []
        bucket = keys.view(np.uint64).reshape(-1, 2)[who, 0] % np.uint64(fragments)
        for x in np.unique(bucket):
            rows = np.flatnonzero(bucket == x)
            inside = np.concatenate([np.arange(starts[r], ends[r]) for r in rows])
            lengths = np.stack([sizes[who[rows], 0], ends[rows] - starts[rows]], 1)
            packed.append((int(x), keys[who[rows]].tobytes(), lengths.tobytes(), hashes[inside].tobytes(), df[inside].tobytes()))
        columns = list(zip(*packed)) if packed else [()] * 5
        kinds = [pa.int64(), *[pa.binary()] * 4]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "keys", "sizes", "hashes", "df"), columns, kinds)})

    def assemble(group: pa.Table) -> pa.Table:
        keys = unpacked(group, "keys", np.uint64).reshape(-1, 2)
        sizes = unpacked(group, "sizes", np.int64).reshape(-1, 2)
        hashes = unpacked(group, "hashes", np.int64)
        df = unpacked(group, "df", np.uint16)
        names, first, number = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        number = number.reshape(-1)
        kept = np.bincount(number, sizes[:, 1], len(names)).astype(np.int64)
        n = sizes[first, 0]
        alive = 100 * kept >= percent * n
        owner = np.repeat(number, sizes[:, 1])
        use = alive[owner]
        hashes, df, owner = hashes[use], df[use], owner[use]
        order = np.lexsort((hashes, df, owner))
        ends = pa.array(np.concatenate([[0], np.cumsum(kept[alive])]), pa.int32())
        which = [names[i].tobytes() for i in np.flatnonzero(alive)]
        return pa.table({
            "key": pa.array(which, pa.binary()), "n": pa.array(n[alive]), "kept": pa.array(kept[alive]),
            "t": pa.ListArray.from_arrays(ends, pa.array(hashes[order])),
        })

    return (
        docs.select("text")
        .mapInArrow(cut, "fragment int, keys binary, sizes binary, hashes binary")
        .groupBy("fragment")
        .applyInArrow(count, "bucket long, keys binary, sizes binary, hashes binary, df binary")
        .groupBy("bucket")
        .applyInArrow(assemble, "key binary, n long, kept long, t array<long>")
    )


def fewest(n: Column, percent: int) -> Column:
    """Least number of shared shingles that a set of ``n`` needs for a link."""
    return F.floor((n * percent + 99) / 100)


def possible(a: str, b: str, percent: int) -> Column:
    """Whether sets of n_a and n_b shingles can link when at most kept_a and kept_b of them are shared."""
    return (100 + percent) * F.least(f"kept_{a}", f"kept_{b}") >= percent * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over the vertical fragments, reaches ``percent`` of the union."""
    side = lambda x: segments.select(F.col("key").alias(x), "v", F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), ["b", "v"])
        .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("partial"))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.sum("partial").alias("overlap"))
        .filter(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap")))
        .select("a", "b")
    )


def residual_pairs(percent: int):
    """Pairs of a bucket block that lie in different components and pass the bounds. A pair is given only at the first
    shingle that both prefixes share (none of those before it, which come with each row, is in both), where the rest of
    both sets bounds its overlap. Blocks come sorted, one after another; only one is held."""

    def meet(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        rows.sort()  # sets with fewer shared shingles come first: they bound the overlap
        kept, n, pos, salt, part = (np.array([r[c] for r in rows]) for c in range(5))
        part = np.unique(part, return_inverse=True)[1]
        across = salt.min() != salt.max()
        before: dict[int, set[int]] = {}

        def earlier(x: int) -> set[int]:
            if x not in before:
                before[x] = set(rows[x][6].tolist())
            return before[x]

        for x in range(len(rows) - 1):
            y = slice(x + 1, None)
            need = percent * (n[x] + n[y])
            fit = (part[y] != part[x]) & ((100 + percent) * np.minimum(kept[x] - pos[x], kept[y] - pos[y]) >= need)
            if across:
                fit &= salt[y] != salt[x]
            for k in np.flatnonzero(fit) + x + 1:
                if earlier(x).isdisjoint(earlier(k)):
                    a, b = rows[x][5], rows[k][5]
                    yield (a, b) if a < b else (b, a)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            flat, ends = batch.column(9).flatten().to_numpy(), batch.column(9).value_lengths().to_numpy().cumsum()
            earlier = np.split(flat, ends[:-1])
            for h, i, j, *rest, p in zip(*(batch.column(c).to_pylist() for c in range(9)), earlier):
                if (h, i, j) != now:
                    if len(held) > 1:
                        found.extend(meet(held))
                    now, held = (h, i, j), []
                held.append((*rest, p))
            yield pairs_batch(found)
        yield pairs_batch(list(meet(held)) if len(held) > 1 else [])

    def pairs_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        found = sorted(set(found))
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.binary()) for c in range(2)], ["a", "b"])

    return stream


def classes(docs: DataFrame, n_total: int, width: int, percent: int) -> DataFrame:
    """key, part: for every class that links with another, the least key of its component."""
    fragments = max(1, -(-n_total // FRAGMENT_SHINGLES))
    alive = candidates(docs, width, percent, fragments).checkpoint()
    prefix = F.slice("t", 1, (F.col("kept") - fewest(F.col("n"), percent) + 1).cast("int"))
    buckets = alive.select("key", "n", "kept", F.posexplode(prefix).alias("pos", "h"))
    # Near copies share many prefix shingles: of buckets with the same members, the first in the global order stands for all.
    pivots = (
        buckets.groupBy("h")
        .agg(
            F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("key")).alias("x"),
            F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
            F.min(F.struct("key", "pos"))["pos"].alias("pos"),
            F.min(F.struct((F.col("n") - F.col("kept")).alias("own"), "n", "kept", "key")).alias("p"),
        )
        .filter("size > 1")
        .groupBy("size", "x", "y")
        .agg(F.min(F.struct("pos", "h", "p")).alias("m"))
        .select("size", F.col("m.h").alias("h"), F.col("m.p.key").alias("key_p"), F.col("m.p.n").alias("n_p"), F.col("m.p.kept").alias("kept_p"))
        .checkpoint()
    )
    star = (
        buckets.select("h", F.col("key").alias("key_q"), F.col("n").alias("n_q"), F.col("kept").alias("kept_q"))
        .join(pivots, "h")
        .filter((F.col("key_p") != F.col("key_q")) & possible("p", "q", percent))
        .select(F.least("key_p", "key_q").alias("a"), F.greatest("key_p", "key_q").alias("b"))
        .distinct()
        .checkpoint()
    )
    def segments(sets: DataFrame) -> DataFrame:
        cut = F.transform(
            F.sequence(F.lit(0), F.lit(VERTICAL - 1)),
            lambda v: F.struct(v.alias("v"), F.filter("t", lambda x: F.pmod(x, F.lit(VERTICAL)) == v).alias("s")),
        )
        return sets.select("key", "n", F.explode(cut).alias("f")).select("key", "n", "f.v", "f.s")

    first = components(linked(star, segments(alive), percent))

    placed = (
        alive.select("key", "n", "kept", prefix.alias("prefix"))
        .join(first.withColumnRenamed("v", "key"), "key", "left")
        .select("key", "n", "kept", F.coalesce("part", "key").alias("part"), F.posexplode("prefix").alias("pos", "h"))
        .join(pivots.select("h"), "h", "left_semi")
    )
    mixed = placed.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("h", "size")
    # Classes of different components that share a prefix shingle share it in a mixed bucket, so the shingles of other
    # buckets need not travel with a class. A list holds no more than the prefix of one class.
    listed = (
        placed.join(mixed, "h")
        .groupBy("key", "n", "kept", "part")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "h", "size"))).alias("met"))
        .checkpoint()
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("long")
    blocked = (
        listed.select("key", "n", "kept", "part", "met", F.posexplode("met").alias("at", "x"))
        .select("key", "n", "kept", "part", "x.pos", "x.h", "x.size", F.slice(F.col("met.h"), F.lit(1), F.col("at")).alias("before"))
        .withColumn("salt", F.pmod(F.xxhash64("key"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("h", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "kept", "n", "pos", "salt", "part", "key", "before")
    )
    more = (
        blocked.repartition("h", "i", "j")
        .sortWithinPartitions("h", "i", "j")
        .mapInArrow(residual_pairs(percent), "a binary, b binary")
        .distinct()
        .join(star, ["a", "b"], "left_anti")
        .checkpoint()
    )
    named = more.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    name = lambda x: F.coalesce(F.col(f"part_{x}"), F.col(x))
    of = lambda x: first.select(F.col("v").alias(x), F.col("part").alias(f"part_{x}"))
    bridges = linked(more, segments(alive.join(named, "key", "left_semi")), percent).join(of("a"), "a", "left").join(of("b"), "b", "left").select(name("a").alias("a"), name("b").alias("b"))
    second = components(bridges)
    joined = first.join(second.select(F.col("v").alias("part"), F.col("part").alias("whole")), "part", "left")
    return joined.select("v", F.coalesce("whole", "part").alias("part")).unionByName(
        second.join(first, "v", "left_anti").select("v", "part")
    )


def grouped(docs: DataFrame, width: int = 4, percent: int = 85, also: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, key, part, component_id and the columns of ``also`` of every row. ``part`` names the component,
    which ids that repeat cannot; it is null without words."""
    every = members(docs, width, also).checkpoint()
    n_total = every.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = classes(docs, n_total, width, percent).select(F.col("v").alias("key"), "part")
    ids = every.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least")).join(parts, "key", "left")
    ids = ids.select("key", "least", F.coalesce("part", "key").alias("part"))
    smallest = ids.groupBy("part").agg(F.min("least").alias("component_id"))
    component = ids.join(smallest, "part").select("key", "part", "component_id")
    # Documents without words get a join key of their own kind; nothing matches it.
    return every.join(component, "key", "left").withColumn(
        "component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    )


def similar_documents(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: documents that chains of links (Jaccard of ``percent`` or more) connect.

    component_id is the smallest doc_id of the component. A document without words (null text too) is linked with nothing
    and is its own component, as are its repeats. A null id takes part like any other but is never the smallest, unless
    all are null. Repeated rows give repeated results; other columns are not read. A-Z are compared as a-z.
    """
    return grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component: that with the smallest id (null only where all are), of several texts with that id the
    one with the smallest digest, of equal rows any. Rows without words are linked with nothing: those with equal ids and
    texts count as one, all others stay."""
    # A null text is not an empty one here.
    digest = F.unhex(F.md5(F.coalesce(F.concat(F.lit("+"), "text"), F.lit(""))))
    rows = grouped(docs, width, percent, (digest.alias("first_text"),)).groupBy("part", "doc_id", "first_text").agg(F.count("*").alias("first_rows"))
    alone = F.when(F.col("part").isNull(), F.struct("doc_id", "first_text"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("first_id"), "first_text", "first_rows")
    # Names that no column of the documents has.
    own = next(x for n in range(len(docs.columns) + 1) if not any(c.startswith(x := f"_first{n}_") for c in docs.columns))
    key, text, copies, here = (own + x for x in ("id", "text", "rows", "digest"))
    chosen = (
        rows.groupBy("part", alone.alias("alone")).agg(F.min(order).alias("m"))
        .select(F.col("m.first_id").alias(key), F.col("m.first_text").alias(text), F.col("m.first_rows").alias(copies)).checkpoint()
    )
    given = docs.withColumn(here, digest)
    left = given.join(chosen, given["doc_id"].eqNullSafe(chosen[key]) & (given[here] == chosen[text]))
    single, repeated = left.filter(F.col(copies) == 1), left.filter(F.col(copies) > 1).dropDuplicates(["doc_id", text])
    return single.select(*docs.columns).unionByName(repeated.select(*docs.columns))
