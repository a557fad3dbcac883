"""Counts, extents, top-k and time ranges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tlake.functions import epoch_micros, time_bucket
from tlake.operators.transforms import has_trace, recent


def recent_count(df: DataFrame, as_of: datetime | str | Column, hours: int = 1) -> DataFrame:
    return recent(df, as_of, hours).agg(F.count("*").alias("n"))


def top_metrics(df: DataFrame, as_of: datetime | str | Column, k: int = 10, hours: int = 1) -> DataFrame:
    """Most frequent (service, metric) pairs of the recent window; ties by name."""
    return (
        recent(df, as_of, hours, "TimeUnix")
        .groupBy("ServiceName", "MetricName")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "ServiceName", "MetricName")
        .limit(k)
    )


def trace_time_ranges(traces: DataFrame) -> DataFrame:
    """First and last timestamp per trace."""
    return has_trace(traces).groupBy("TraceId").agg(
        F.min("Timestamp").alias("Start"), F.max("Timestamp").alias("End")
    )


def table_extent(df: DataFrame, column: str = "Timestamp") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.min(column).alias("oldest"), F.max(column).alias("newest")
    )


def exact_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n_distinct"))


def log_histogram(df: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Log volume per time bucket and severity."""
    return df.groupBy(time_bucket("Timestamp", bucket).alias("bucket"), "SeverityText").agg(
        F.count("*").alias("n")
    )


def attr_profile(df: DataFrame, column: str = "LogAttributes") -> DataFrame:
    """Per attribute key: records that carry it and exact number of distinct values.

    Counted per (key, value) first, so a key on every record is spread over its
    values and the second step sees one row per distinct value.
    """
    pairs = df.select(F.explode(column).alias("key", "value"))
    return (
        pairs.groupBy("key", "value").agg(F.count("*").alias("c"))
        .groupBy("key").agg(F.sum("c").alias("n"), F.count("value").alias("n_values"))
    )


def session_summary(df: DataFrame) -> DataFrame:
    """Start, end, length and number of records per session id."""
    sid = F.try_element_at("LogAttributes", F.lit("sessionId"))
    return (
        df.select("Timestamp", sid.alias("sessionId")).filter("sessionId is not null")
        .groupBy("sessionId")
        .agg(F.min("Timestamp").alias("start"), F.max("Timestamp").alias("end"), F.count("*").alias("n"))
        .withColumn("duration_us", epoch_micros("end") - epoch_micros("start"))
    )
