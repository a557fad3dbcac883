"""Text search that opens only files which may hold the text.

A sidecar table has a sketch of fixed size for each file: every run of three characters of the text column, in lower
case, sets one of ``BITS`` bits. A file that holds a text has all bits of the text's runs set. The sketch is kept as bitmaps of
32,768 bits, a row each, made and read with Spark's bitmap functions only.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tlake.operators.transforms import search
from tlake.plans import hadoop
from tlake.plans.lake import TIERS, Lake

BITS = 1 << 18  # 32 KB a file
SCHEMA = "file STRING, bucket BIGINT, bits BINARY"


def _runs(text: Column) -> Column:
    """Places of the sketch, from 1, that a text sets. Characters are cut once and paired by position, so the work grows
    with the length of the text."""
    chars = F.split(F.lower(text), "")
    n = F.size(chars)
    rest = lambda i: F.slice(chars, i, F.greatest(n - i + 1, F.lit(0)))
    two = F.zip_with(chars, rest(2), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, rest(3), lambda a, b: F.concat(a, b))  # a missing neighbour gives NULL
    return F.transform(
        F.array_distinct(F.filter(three, lambda r: r.isNotNull())), lambda r: F.pmod(F.xxhash64(r), F.lit(BITS)) + 1
    )


def _indexed(lake: Lake, index: str) -> DataFrame:
    return lake.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(index)


def _arms(lake: Lake, table: str) -> list[DataFrame]:
    m = lake.manifest(table)
    return [lake.files(table, t, m).withColumn("tier", F.lit(t)).withColumn("file", F.col("_metadata.file_path")) for t in TIERS]


def _known(lake: Lake, index: str) -> DataFrame | None:
    return _indexed(lake, index) if hadoop.names(lake.spark, index) else None


def bitmaps(rows: DataFrame, column: str) -> DataFrame:
    """file, bucket, bits of the texts of each file.

    Runs first set bits in words of 64, of which a file has at most ``BITS`` / 64: hash tables of that size in the tasks that read
    it, and as many rows per (task, file) shuffled. A bitmap's own aggregation sorts what it is given, here the
    places that are set in the words.
    """
    at = F.col("place") - 1
    of_word = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    words = (
        rows.select("file", F.explode(_runs(F.col(column))).alias("place"))
        .groupBy("file", F.call_function("div", at, F.lit(64)).alias("word")).agg(F.bit_or(of_word).alias("set"))
    )
    is_set = lambda i: F.call_function("shiftright", F.col("set"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), is_set))
    places = words.select("file", "word", bit.alias("bit")).select("file", (F.col("word") * 64 + F.col("bit") + 1).alias("place"))
    return places.groupBy("file", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )


def update_text_index(lake: Lake, table: str, index: str, column: str = "Body") -> None:
    """Add the sketches of all files of a table that have none yet, as one more part of the sidecar at ``index``.

    Runs are put together per file in the tasks that read it (``bitmaps``). A row without bits says that a file
    is indexed, also if its texts are all too short.
    """
    known = _known(lake, index)
    arms = _arms(lake, table)
    rows = arms[0].select("file", column).unionByName(arms[1].select("file", column))
    if known is not None:
        done = [r["file"] for r in known.filter("bucket = 0").select("file").collect()]
        rows = rows.filter(~F.col("file").isin(done)) if done else rows
    heads = rows.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("bits"))
    bitmaps(rows, column).unionByName(heads).write.parquet(f"{index}/part-{uuid.uuid4().hex}")


def candidate_files(lake: Lake, table: str, index: str, text: str) -> DataFrame:
    """file, indexed, may_hold for every file of the table. Files that are not indexed yet, and all files if the text is
    shorter than a run, may hold it."""
    spark = lake.spark
    paths = {re.sub("^file:/+", "file:/", p) for arm in _arms(lake, table) for p in arm.inputFiles()}  # as the metadata column has it
    files = spark.createDataFrame([(p,) for p in sorted(paths)], "file string")
    known = _known(lake, index)
    if known is None:
        return files.select("file", F.lit(False).alias("indexed"), F.lit(True).alias("may_hold"))
    wanted = spark.range(1).select(F.explode(_runs(F.lit(text))).alias("place")).select(
        F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit")
    )
    n = wanted.agg(F.count("*")).scalar()
    byte = F.conv(F.hex(F.substring("bits", F.call_function("div", F.col("bit"), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 1
    hits = known.join(wanted, "bucket").groupBy("file").agg(F.count_if(is_set).alias("hits"))
    indexed = known.filter("bucket = 0").select("file", F.lit(True).alias("known")).distinct()
    return files.join(indexed, "file", "left").join(hits, "file", "left").select(
        "file", F.coalesce("known", F.lit(False)).alias("indexed"),
        (F.col("known").isNull() | (F.coalesce("hits", F.lit(0)) == n)).alias("may_hold"),
    )


def search_files(lake: Lake, table: str, index: str, text: str, column: str = "Body", ignore_case: bool = True) -> DataFrame:
    """Rows whose column holds ``text``, as ``search`` over a scan gives them, from the files that may hold it.

    The names of those files become a condition on the file, which Spark applies when it plans the scan: other files
    are not opened. The list is as long as the result is spread; a text in nearly every file is found faster by ``search``.
    """
    wanted = [r["file"] for r in candidate_files(lake, table, index, text).filter("may_hold").select("file").collect()]
    shown = lake.scan(table).columns
    parts = [search(a.filter(F.col("file").isin(wanted)), text, column, ignore_case=ignore_case) for a in _arms(lake, table)]
    return parts[0].unionByName(parts[1]).select(*shown)


def search_report(lake: Lake, table: str, index: str, text: str, column: str = "Body") -> DataFrame:
    """One row: files, those opened, those that hold the text, and the share of the others that were opened for nothing."""
    verdict = candidate_files(lake, table, index, text)
    arms = _arms(lake, table)
    found = search(arms[0].select("file", column).unionByName(arms[1].select("file", column)), text, column)
    holds = found.select("file", F.lit(True).alias("holds")).distinct()
    false_ = F.count_if(F.col("may_hold") & F.col("holds").isNull())
    without = F.count_if(F.col("holds").isNull())
    return verdict.join(holds, "file", "left").agg(
        F.count("*").alias("files"), F.count_if("may_hold").alias("opened"), F.count("holds").alias("hold"),
        F.count_if(F.col("holds") & ~F.col("may_hold")).alias("missed"),
        F.when(without > 0, false_ / without).otherwise(0.0).alias("false_share"),
    )
