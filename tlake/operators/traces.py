"""Spans: rates and durations, span tree, service edges, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tlake.functions import looked_up, own_key, time_bucket
from tlake.operators.flatten import unnest
from tlake.operators.percentiles import exact_percentiles
from tlake.operators.transforms import has_trace
from tlake.session import stored


def red_metrics(spans: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Count, errors and exact p50/p95/p99 duration per service, operation and time bucket."""
    keyed = spans.select(
        time_bucket("Timestamp", bucket).alias("bucket"), "ServiceName", "SpanName", "Duration", "StatusCode"
    )
    out = exact_percentiles(
        keyed,
        ["bucket", "ServiceName", "SpanName"],
        "Duration",
        {"p50": 0.5, "p95": 0.95, "p99": 0.99},
        {"errors": F.col("StatusCode") == "Error"},
    )
    return out.withColumnRenamed("total", "total_ns")


def span_tree(spans: DataFrame) -> DataFrame:
    """Each span with root flag, parent name and service, direct child time and self time.

    Child time is summed per parent before the join, so a parent with very many
    children is one row. The parent lookup keeps one row per span; a hot parent
    is split by AQE skew handling.
    """
    s = has_trace(spans).select(
        "TraceId", "SpanId", "ParentSpanId", "SpanName", "ServiceName", "Timestamp", "Duration"
    )
    children = (
        s.filter(F.col("ParentSpanId") != "")
        .groupBy("TraceId", F.col("ParentSpanId").alias("SpanId"))
        .agg(F.sum("Duration").alias("children_ns"), F.count("*").alias("n_children"))
    )
    parents = s.select(
        "TraceId", looked_up("SpanId").alias("_key"),
        F.col("SpanName").alias("parent_name"), F.col("ServiceName").alias("parent_service"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        s.withColumn("_key", own_key("ParentSpanId", F.col("ParentSpanId") != "", "SpanId"))
        .join(parents, ["TraceId", "_key"], "left").drop("_key")
        .join(children, ["TraceId", "SpanId"], "left")
        .withColumns(
            {
                "is_root": F.col("ParentSpanId") == "",
                "children_ns": F.coalesce("children_ns", zero),
                "n_children": F.coalesce("n_children", zero),
                "self_ns": F.greatest(F.col("Duration") - F.coalesce("children_ns", zero), zero),
            }
        )
    )


def span_roots(spans: DataFrame) -> DataFrame:
    """TraceId, SpanId, root, depth and state of every span, by pointer jumping.

    Each span points to its parent at first. In a round every pointer jumps to where the span it points to points, so the
    distance covered doubles and a chain of n spans is done after log2(n) rounds. States: ``rooted``; ``orphan``, if the topmost
    span there is names a parent that is not stored (it stands for the root); ``cycle``, if the way up never ends, with root ''
    and depth -1. Twice as far as the largest trace has spans there can be nothing but cycles, which ends the rounds.

    A repeated span id counts once, with its smallest parent id. Each round is kept in the shared checkpoint folder; only spans
    that are not at the top yet are looked up again.
    """
    s = has_trace(spans).groupBy("TraceId", "SpanId").agg(F.min("ParentSpanId").alias("ParentSpanId"))
    parents = s.select("TraceId", F.col("SpanId").alias("_p"), F.lit(True).alias("_there"))
    start = stored(
        s.withColumn("_p", own_key("ParentSpanId", F.col("ParentSpanId") != "", "TraceId", "SpanId"))
        .join(parents.withColumn("_p", looked_up("_p")), ["TraceId", "_p"], "left")
        .select(
            "TraceId", "SpanId", F.when(F.col("_there"), F.col("ParentSpanId")).otherwise(F.col("SpanId")).alias("to"),
            F.when(F.col("_there"), 1).otherwise(0).cast("bigint").alias("depth"), F.col("_there").isNull().alias("top"),
            F.when(F.col("_there"), "").when(F.col("ParentSpanId") == "", "rooted").otherwise("orphan").alias("state"),
        )
    )
    most = start.groupBy("TraceId").count().agg(F.max("count")).first()[0] or 0
    now, reach = start, 1
    while reach <= 2 * most and not now.filter(~F.col("top")).isEmpty():
        above = now.select(
            "TraceId", F.col("SpanId").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"),
            F.col("top").alias("_top"), F.col("state").alias("_state"),
        )
        jumped = now.filter(~F.col("top")).join(above, ["TraceId", "to"]).select(
            "TraceId", "SpanId", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_top").alias("top"), F.col("_state").alias("state"),
        )
        now = stored(now.filter("top").unionByName(jumped))
        reach *= 2
    return now.select(
        "TraceId", "SpanId", F.when(F.col("top"), F.col("to")).otherwise("").alias("root"),
        F.when(F.col("top"), F.col("depth")).otherwise(-1).alias("depth"), F.when(F.col("top"), F.col("state")).otherwise("cycle").alias("state"),
    )


def span_self_time(spans: DataFrame) -> DataFrame:
    """Self time alone: one join less than the full tree."""
    s = has_trace(spans).select("TraceId", "SpanId", "ParentSpanId", "SpanName", "ServiceName", "Duration")
    children = (
        s.filter(F.col("ParentSpanId") != "")
        .groupBy("TraceId", F.col("ParentSpanId").alias("SpanId"))
        .agg(F.sum("Duration").alias("children_ns"))
    )
    rest = F.col("Duration") - F.coalesce("children_ns", F.lit(0).cast("bigint"))
    return s.join(children, ["TraceId", "SpanId"], "left").select(
        "TraceId", "SpanId", "SpanName", "ServiceName", "Duration",
        F.greatest(rest, F.lit(0).cast("bigint")).alias("self_ns"),
    )


def service_edges(spans: DataFrame) -> DataFrame:
    """Calls from parent service to child service.

    Children are counted per (parent, child service) before the join. Nanoseconds are added up as DECIMAL(38,0): the spans of
    a large table last longer together than a BIGINT can say.
    """
    s = has_trace(spans)
    calls = (
        s.filter(F.col("ParentSpanId") != "")
        .groupBy("TraceId", F.col("ParentSpanId").alias("SpanId"), F.col("ServiceName").alias("child_service"))
        .agg(F.count("*").alias("c"), F.sum(F.col("Duration").cast("decimal(38,0)")).alias("d"))
    )
    parents = s.select("TraceId", "SpanId", F.col("ServiceName").alias("parent_service"))
    return (
        calls.join(parents, ["TraceId", "SpanId"])
        .groupBy("parent_service", "child_service")
        .agg(F.sum("c").alias("n_calls"), F.sum("d").alias("total_ns"))
    )


def logs_for_traces(logs: DataFrame, traces: DataFrame, how: str = "inner") -> DataFrame:
    """Log records with the span they were written in."""
    spans = has_trace(traces).select(
        "TraceId", "SpanId", "SpanName", F.col("ServiceName").alias("SpanService"), "Duration", "StatusCode"
    )
    if how == "inner":
        return has_trace(logs).join(spans, ["TraceId", "SpanId"])
    keyed = logs.withColumn("_key", own_key("TraceId", F.col("TraceId") != "", "Timestamp_ns", "SpanId", "Body"))
    spans = spans.withColumn("_key", looked_up("TraceId")).drop("TraceId")
    return keyed.join(spans, ["_key", "SpanId"], "left").drop("_key")


def session_activity(sessions: DataFrame, logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Per session: own records, and the logs and spans of the traces it touched.

    Logs and spans are counted per trace first; only counts are joined.
    """
    sid = F.try_element_at("LogAttributes", F.lit("sessionId"))
    own = (
        sessions.select(sid.alias("sessionId"), "TraceId").filter("sessionId is not null")
        .groupBy("sessionId", "TraceId").agg(F.count("*").alias("records"))
    )
    per_trace = lambda df, n: (
        has_trace(df).groupBy("TraceId").agg(F.count("*").alias(n)).select(looked_up("TraceId").alias("_key"), n)
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return (
        own.withColumn("_key", own_key("TraceId", F.col("TraceId") != "", "sessionId"))
        .join(per_trace(logs, "logs"), "_key", "left")
        .join(per_trace(traces, "spans"), "_key", "left")
        .groupBy("sessionId")
        .agg(
            F.sum("records").alias("records"),
            F.count_if(F.col("TraceId") != "").alias("traces"),
            total("logs"), total("spans"),
        )
    )


def exemplar_spans(metrics: DataFrame, traces: DataFrame) -> DataFrame:
    """Exemplars of metric points with the span they point to."""
    ex = unnest(metrics.select("ServiceName", "MetricName", "TimeUnix", "Exemplars"), "Exemplars")
    ex = ex.withColumnsRenamed({"Exemplars_TraceId": "TraceId", "Exemplars_SpanId": "SpanId"})
    spans = traces.select("TraceId", "SpanId", "SpanName", "Duration", F.col("ServiceName").alias("SpanService"))
    return has_trace(ex).join(has_trace(spans), ["TraceId", "SpanId"])


def trace_days(ids: DataFrame, ranges: DataFrame) -> DataFrame:
    """First and last day of each wanted trace. ``ranges`` may hold several partial ranges
    per trace; only those of wanted traces are put together."""
    wanted = has_trace(ids).select("TraceId").distinct()
    return (
        ranges.join(wanted, "TraceId", "left_semi").groupBy("TraceId")
        .agg(F.to_date(F.min("Start")).alias("first_day"), F.to_date(F.max("End")).alias("last_day"))
    )


def get_traces(traces: DataFrame, ids: DataFrame) -> DataFrame:
    """All spans of many traces (column ``TraceId`` of ``ids``); on stored tables use
    ``Lake.get_traces``, which reads only the days the traces are on."""
    return has_trace(traces).join(has_trace(ids).select("TraceId"), "TraceId", "left_semi")
