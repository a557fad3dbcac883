"""Operational reports over the file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType
from pyspark.sql.window import Window

from tlake.functions import readable_size


def compression_report(inv: DataFrame) -> DataFrame:
    """Rows, sizes and uncompressed/compressed ratio per table, one decimal."""
    c, u = F.sum("compressed_bytes"), F.sum("uncompressed_bytes")
    return (
        inv.groupBy("table")
        .agg(
            F.sum("rows").alias("rows"), c.alias("compressed_bytes"), u.alias("uncompressed_bytes"),
            F.bround(u / F.nullif(c, F.lit(0)), 1).alias("compress_ratio"),
        )
        .withColumns(
            {"compressed": readable_size("compressed_bytes"), "uncompressed": readable_size("uncompressed_bytes")}
        )
        .orderBy("table")
    )


def ingest_report(inv: DataFrame) -> DataFrame:
    return (
        inv.groupBy("table")
        .agg(F.sum("rows").alias("rows"), F.min("min_time").alias("oldest"), F.max("max_time").alias("newest"))
        .orderBy("table")
    )


def balance_report(df: DataFrame, by: str | Column = "path", rows: str | Column = "rows") -> DataFrame:
    """Rows per (table, shard) and how far each shard is above the average of its table."""
    shard = F.col(by) if isinstance(by, str) else by
    n = F.col(rows) if isinstance(rows, str) else rows
    per_table = Window.partitionBy("table")
    return (
        df.groupBy("table", shard.alias("shard")).agg(F.sum(n).alias("rows"))
        .withColumn("skew", F.col("rows") / F.avg("rows").over(per_table))
        .orderBy("table", "shard")
    )


def tier_report(inv: DataFrame) -> DataFrame:
    return (
        inv.groupBy("tier", "table")
        .agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("file_bytes").alias("bytes"))
        .withColumn("size", readable_size("bytes"))
        .orderBy("tier", "table")
    )


def file_report(inv: DataFrame) -> DataFrame:
    return inv.select("table", "event_date", "path", "tier", "rows", F.col("file_bytes").alias("bytes")).orderBy(
        "table", "tier", "event_date", "path"
    )


def cold_count(inv: DataFrame) -> DataFrame:
    return inv.filter(F.col("tier") == "cold").agg(F.count("*").alias("n"))


# Names of the ingest counters.
COUNTERS = ["InsertQuery", "InsertedRows", "InsertedBytes", "RejectedInserts", "DelayedInserts"]


def ingest_counters(progress: DataFrame) -> DataFrame:
    """Totals by counter name from rows ``(event, value)``."""
    return (
        progress.filter(F.col("event").isin(COUNTERS))
        .groupBy("event").agg(F.sum("value").alias("value")).orderBy("event")
    )


def backlog(spark: SparkSession, src: str, checkpoint: str) -> DataFrame:
    """Files, bytes and age of what lies in the input folder and no batch of the query has taken yet; one row.

    Compares a listing (the files are not opened) with the log of files that Spark keeps in the checkpoint.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(src).select(
        plain("path").alias("path"), "length", "modificationTime"
    )
    taken = spark.read.text(f"{checkpoint}/sources/0").filter(F.col("value").startswith("{")).select(
        plain(F.get_json_object("value", "$.path")).alias("path")
    )
    return there.join(taken.distinct(), "path", "left_anti").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.min("modificationTime").alias("oldest")
    )


def plain_bytes(c: Column, t: DataType) -> Column:
    """Size of a value in plain columns: fixed-width numbers, text with a length byte."""
    kind = t.typeName()
    if kind == "string":
        return F.octet_length(c) + 1
    if kind == "map":
        return plain_bytes(F.map_keys(c), ArrayType(t.keyType)) + plain_bytes(F.map_values(c), ArrayType(t.valueType))
    if kind == "array":
        return F.aggregate(c, F.lit(0), lambda a, x: a + plain_bytes(x, t.elementType))
    if kind == "struct":
        return sum((plain_bytes(c[f.name], f.dataType) for f in t.fields), F.lit(0))
    return F.lit({"boolean": 1, "integer": 4, "date": 4}.get(kind, 8))


def size_comparison(df: DataFrame, inv: DataFrame, stored_rows: DataFrame | None = None) -> DataFrame:
    """The same rows as line JSON, as plain columns and as stored, in bytes. ``stored_rows`` has all columns that the files
    hold, also those that are computed on write; then the plain columns are those, and the ratio is one of equal columns.

    ``uncompressed_bytes`` is what the files hold before the codec, thus already
    dictionary- and delta-encoded; ``plain_bytes`` is without any encoding.
    """
    row = F.to_json(F.struct(*df.columns))
    columns = df if stored_rows is None else stored_rows
    plain = sum((plain_bytes(F.col(f"`{f.name}`"), f.dataType) for f in columns.schema.fields), F.lit(0))
    as_json = df.agg(F.sum(F.octet_length(row) + 1).alias("json_bytes"), F.count("*").alias("rows"))
    as_columns = columns.agg(F.sum(plain.cast("bigint")).alias("plain_bytes"))
    stored = inv.agg(
        F.sum("uncompressed_bytes").alias("uncompressed_bytes"), F.sum("compressed_bytes").alias("compressed_bytes")
    )
    # One-row frames become one row.
    both = as_json.unionByName(as_columns, allowMissingColumns=True).unionByName(stored, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumns(
        {
            "json_ratio": F.bround(F.col("json_bytes") / F.col("compressed_bytes"), 1),
            "plain_ratio": F.bround(F.col("plain_bytes") / F.col("compressed_bytes"), 1),
            "encoded_ratio": F.bround(F.col("uncompressed_bytes") / F.col("compressed_bytes"), 1),
        }
    )


# What a watched pipeline notes besides.
BACKLOG = ["OutstandingFiles", "OutstandingBytes"]


def backlog_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What was outstanding when each batch of the watched pipelines ended: ``(query, pipeline, batch, files, bytes)``."""
    fields = ", ".join(["query STRING", "pipeline STRING", "batch BIGINT", *[f"{c} BIGINT" for c in BACKLOG]])
    rows = spark.read.schema(fields).json(folder).filter(F.col(BACKLOG[0]).isNotNull())
    return rows.select("query", "pipeline", "batch", F.col(BACKLOG[0]).alias("files"), F.col(BACKLOG[1]).alias("bytes"))


def counter_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What streams have counted, one file per batch → rows ``(query, pipeline, batch, event, value)``."""
    fields = ", ".join(["query STRING", "pipeline STRING", "batch BIGINT", *[f"{c} BIGINT" for c in COUNTERS]])
    return spark.read.schema(fields).json(folder).unpivot(["query", "pipeline", "batch"], COUNTERS, "event", "value")
