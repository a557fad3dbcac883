"""Default projections of the stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tlake.functions import literal_time, trunc_second


def logs_view(df: DataFrame) -> DataFrame:
    return df.select("Timestamp", "ServiceName", "SeverityText", "Body")


def spans_view(df: DataFrame) -> DataFrame:
    """Span list; duration in whole milliseconds, halves to the even neighbour."""
    return df.select(
        "Timestamp", "ServiceName", "StatusCode",
        F.bround(F.col("Duration") / F.lit(1e6)).alias("DurationMs"), "SpanName",
    )


def sessions_view(
    df: DataFrame,
    start: datetime | str | Column | None = None,
    end: datetime | str | Column | None = None,
) -> DataFrame:
    """Session records, filtered on the second-precision time (end exclusive)."""
    at = F.col("TimestampTime") if "TimestampTime" in df.columns else trunc_second("Timestamp")
    if start is not None:
        df = df.filter(at >= literal_time(start))
    if end is not None:
        df = df.filter(at < literal_time(end))
    return df.select("Timestamp", "ServiceName", "Body")


def logs_context_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("Timestamp").alias("time"), F.col("SeverityText").alias("level"),
        F.col("Body").alias("message"), "TraceId", "SpanId", "ServiceName",
        "LogAttributes", "ResourceAttributes",
    )


# Uniform span field names and the columns behind them.
TRACE_FIELDS = {
    "traceId": "TraceId", "spanId": "SpanId", "parentSpanId": "ParentSpanId",
    "operation": "SpanName", "service": "ServiceName", "duration": "Duration",
    "start": "Timestamp", "tags": "SpanAttributes", "serviceTags": "ResourceAttributes",
    "kind": "SpanKind", "status": "StatusCode", "message": "StatusMessage",
}


def trace_view(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for n, c in TRACE_FIELDS.items()])

