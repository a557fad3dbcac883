"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame of scalars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tlake import schemas
from tlake.functions import (
    attrs_to_values,
    json_string,
    map_text,
    readable_size,
    typed_value,
    unix_seconds,
    value_kind,
    values_text,
)
from tlake.operators import aggregates as agg
from tlake.operators import metrics as met
from tlake.operators import traces as trc
from tlake.operators import transforms as trf
from tlake.operators import views
from tlake.operators.metrics import union_metrics
from tlake.operators.flatten import (
    archive_logs,
    container_fields,
    flatten_otlp_logs,
    left_array_join,
    otlp_to_logs,
    otlp_to_metrics,
    otlp_to_spans,
    unnest,
)
from tlake.plans import Lake, apply_moves, compact, compact_due, inventory, plan_moves, reports
from tlake.plans import hadoop
from tlake.plans.lake import TIERS, shard_of
from tlake.plans.textindex import search_files, update_text_index
from tlake.session import scratch_dir
from tlake.sources import (
    parse_lines,
    parse_prom_text,
    read_container_logs,
    read_journal_json,
    read_otlp_logs,
    read_raw_lines,
)
from tlake.sources.files import parse_journal
from tlake.streaming import otlp_requests, pipelines, sinks, write_otlp_archive
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def newest(df: DataFrame, column: str = "Timestamp"):
    """Latest time in the data, as a scalar subquery: the queries never use wall-clock time."""
    return df.agg(F.max(column)).scalar()


def lake_at(spark: SparkSession, name: str, tables: list[str] | None = None) -> Lake:
    root = scratch_dir(spark, name)
    lake = Lake(spark, f"{root}/hot", f"{root}/cold")
    if tables:
        lake.tables = tables
    return lake.create_tables()


# -- recent windows, extents, top-k ---------------------------------------------


@query
def top_metrics_by_service(spark, sf_dir):
    g = fx.gauge(spark, sf_dir)
    return agg.top_metrics(g, newest(g, "TimeUnix"), k=10)


@query
def recent_log_count(spark, sf_dir):
    df = fx.logs(spark, sf_dir)
    return agg.recent_count(df, newest(df))


@query
def recent_trace_count(spark, sf_dir):
    df = fx.spans(spark, sf_dir)
    return agg.recent_count(df, newest(df))


@query
def trace_time_ranges(spark, sf_dir):
    return agg.trace_time_ranges(fx.logs(spark, sf_dir))


@query
def table_extent(spark, sf_dir):
    return agg.table_extent(fx.logs(spark, sf_dir))


@query
def exact_distinct_services(spark, sf_dir):
    return agg.exact_distinct(fx.logs(spark, sf_dir), "ServiceName")


# -- unnesting raw requests -----------------------------------------------------


def _log_requests(spark, sf_dir):
    return parse_lines(otlp_requests(fx.logs(spark, sf_dir)), schemas.OTLP_LOGS)


@query
def otlp_flatten_logs(spark, sf_dir):
    return archive_logs(_log_requests(spark, sf_dir)).select(
        "timestamp", "service_name", "severity", "body", "trace_id", "span_id",
        map_text("log_attributes", "k").alias("k"), map_text("log_attributes", "sessionId").alias("session_id"),
    )


@query
def otlp_log_rows(spark, sf_dir):
    return otlp_to_logs(_log_requests(spark, sf_dir)).select(
        "Timestamp", "Timestamp_ns", "TimestampTime", "SeverityText", "SeverityNumber", "ServiceName", "Body",
        "ScopeName", map_text("ResourceAttributes", "k8s.pod.name").alias("pod"), "TraceFlags",
    )


@query
def container_path_extract(spark, sf_dir):
    return container_fields(fx.container_request_lines(spark, sf_dir))


@query
def container_flatten_all(spark, sf_dir):
    return container_fields(fx.container_request_lines(spark, sf_dir), first_only=False)


@query
def left_array_join_keeps_empty(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    long_lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 80)
    return left_array_join(docs.select("doc_id", long_lines.alias("lines")), "lines", "line").select(
        "doc_id", F.coalesce("line", F.lit("")).alias("line")
    )


@query
def three_level_array_join(spark, sf_dir):
    """Records per service through all three levels."""
    flat = flatten_otlp_logs(_log_requests(spark, sf_dir))
    return flat.groupBy(F.get("resource.attributes", 0)["value"]["stringValue"].alias("service")).agg(
        F.count("item").alias("n")
    )


@query
def unnest_span_events(spark, sf_dir):
    ev = unnest(fx.spans(spark, sf_dir).select("TraceId", "SpanId", "Events"), "Events")
    return ev.select("TraceId", "SpanId", "Events_Name", "Events_Timestamp", map_text("Events_Attributes", "k").alias("k"))


@query
def unnest_span_links(spark, sf_dir):
    ln = unnest(fx.spans(spark, sf_dir).select("SpanId", "Links"), "Links", keep_empty=True)
    return ln.select("SpanId", F.coalesce("Links_TraceId", F.lit("")).alias("LinkedTrace"))


@query
def unnest_summary_quantiles(spark, sf_dir):
    q = unnest(fx.summary(spark, sf_dir).select("ServiceName", "TimeUnix", "Count", "ValueAtQuantiles"), "ValueAtQuantiles")
    return q.withColumnsRenamed({"ValueAtQuantiles_Quantile": "q", "ValueAtQuantiles_Value": "v"})


# -- ingest transforms ----------------------------------------------------------


@query
def fix_time_rules(spark, sf_dir):
    seen = F.expr("Timestamp_ns + 1000000000")
    case = F.col("event_id") % 4
    df = fx.logs(spark, sf_dir).withColumns(
        {
            "ObservedTimestamp_ns": F.when(case >= 2, F.lit(0)).otherwise(seen),
            "Timestamp_ns": F.when(case.isin(1, 3), F.lit(0)).otherwise(F.col("Timestamp_ns")),
        }
    )
    return trf.fix_time(df, fx.AS_OF).select("event_id", "Timestamp", "Timestamp_ns", "ObservedTimestamp_ns", "TimestampTime")


@query
def split_no_session(spark, sf_dir):
    return trf.split_sessions(fx.logs(spark, sf_dir))[0].select("event_id", "Body")


@query
def split_session_only(spark, sf_dir):
    return trf.split_sessions(fx.logs(spark, sf_dir))[1].select(
        "event_id", map_text("LogAttributes", "sessionId").alias("session_id")
    )


@query
def set_log_type_overwrite(spark, sf_dir):
    return trf.set_log_type(fx.logs(spark, sf_dir), "otel").select(
        "event_id", map_text("LogAttributes", "log_type").alias("log_type"), map_text("LogAttributes", "k").alias("k"),
        F.size("LogAttributes").alias("n_attrs"),
    )


@query
def set_log_type_keep(spark, sf_dir):
    return trf.set_log_type(fx.logs(spark, sf_dir), "otel", overwrite=False).select(
        "event_id", map_text("LogAttributes", "log_type").alias("log_type")
    )


@query
def upsert_resource_attr(spark, sf_dir):
    return trf.upsert_attr(fx.logs(spark, sf_dir), "ResourceAttributes", "log_type", "journal").select(
        "event_id", map_text("ResourceAttributes", "log_type").alias("log_type"),
        map_text("ResourceAttributes", "service.name").alias("service"),
    )


@query
def enrich_pods(spark, sf_dir):
    r = lambda key, name: map_text("ResourceAttributes", key).alias(name)
    return trf.enrich_k8s(fx.logs(spark, sf_dir), fx.pods(spark, sf_dir)).select(
        "event_id", r("k8s.pod.name", "pod_name"), r("k8s.namespace.name", "namespace"), r("k8s.pod.uid", "pod_uid"),
        r("k8s.container.name", "container_name"), r("k8s.node.name", "node_name"),
    )


@query
def container_log_merge(spark, sf_dir):
    r = lambda key: map_text("ResourceAttributes", key)
    return trf.parse_container(fx.container_lines(spark, sf_dir)).select(
        "Timestamp", "Body", map_text("LogAttributes", "log.iostream").alias("stream"),
        r("k8s.namespace.name").alias("namespace"), r("k8s.pod.name").alias("pod"), r("k8s.pod.uid").alias("uid"),
        r("k8s.container.name").alias("container"),
    )


def _container_files(spark, sf_dir):
    """Log files as on a node: one folder per pod, one per container."""
    root = scratch_dir(spark, "pods")
    fx.log_files(fx.container_lines(spark, sf_dir), root)
    return f"{root}/*/*/*.log"


def _of_pod(column: str = "ResourceAttributes") -> list:
    """What path and pod table say of a record's origin."""
    names = {
        "namespace": "k8s.namespace.name", "pod": "k8s.pod.name", "uid": "k8s.pod.uid", "container": "k8s.container.name",
        "restart": "k8s.container.restart_count", "node": "k8s.node.name",
    }
    return [map_text(column, key).alias(name) for name, key in names.items()]


@query
def container_log_files(spark, sf_dir):
    """Real log files, read back with their line positions and parsed."""
    parsed = trf.parse_container(read_container_logs(spark, _container_files(spark, sf_dir)))
    return parsed.groupBy(map_text("LogAttributes", "log.iostream").alias("stream"), "Body", *_of_pod()).agg(F.count("*").alias("n"))


@query
def container_log_rotated(spark, sf_dir):
    """Rotated and live files in one read: a message cut by the rotation is one row."""
    root = scratch_dir(spark, "pods")
    fx.log_files(fx.rotated_lines(spark, sf_dir), root)
    parsed = trf.parse_container(read_container_logs(spark, f"{root}/*/*/*.log*"))
    return parsed.select("Timestamp", "Body", map_text("LogAttributes", "log.iostream").alias("stream"), *_of_pod())


@query
def enrich_pods_as_of(spark, sf_dir):
    """The pod that bore the name at the time of the record."""
    return trf.enrich_k8s_as_of(fx.logs(spark, sf_dir), fx.pod_lives(spark, sf_dir)).select("event_id", *_of_pod())


@query
def journal_entries(spark, sf_dir):
    return parse_journal(fx.journal_lines(spark, sf_dir)).select(
        "Timestamp", "Body", "SeverityText", "SeverityNumber", "ServiceName",
        map_text("LogAttributes", "_PID").alias("pid"), F.size("LogAttributes").alias("n_attrs"),
    )


def _prom(spark, sf_dir):
    return parse_prom_text(fx.prom_lines(spark, sf_dir), job="job")


@query
def prom_gauge(spark, sf_dir):
    return _prom(spark, sf_dir)["gauge"].select(
        "ServiceName", "MetricName", "MetricDescription", "TimeUnix", map_text("Attributes", "svc").alias("svc"),
        map_text("Attributes", "type").alias("type"), "Value",
    )


@query
def prom_counter(spark, sf_dir):
    return _prom(spark, sf_dir)["sum"].select(
        "MetricName", "TimeUnix", map_text("Attributes", "svc").alias("svc"), map_text("Attributes", "type").alias("type"),
        "Value", "IsMonotonic", "AggregationTemporality",
    )


@query
def prom_histogram(spark, sf_dir):
    return _prom(spark, sf_dir)["histogram"].select(
        "MetricName", "TimeUnix", map_text("Attributes", "svc").alias("svc"), map_text("Attributes", "type").alias("type"),
        "Count", "Sum", F.array_join(F.col("BucketCounts").cast("array<string>"), ",").alias("counts"),
        F.size("ExplicitBounds").alias("n_bounds"),
    )


@query
def prom_summary(spark, sf_dir):
    return _prom(spark, sf_dir)["summary"].select(
        "MetricName", "TimeUnix", map_text("Attributes", "svc").alias("svc"), map_text("Attributes", "type").alias("type"),
        "Count", "Sum", F.get("ValueAtQuantiles", 0)["Quantile"].alias("q"), F.get("ValueAtQuantiles", 0)["Value"].alias("v"),
    )


@query
def prom_exemplars(spark, sf_dir):
    """Exemplars behind samples, of a counter and of buckets, at the point of their series."""
    points = _prom(spark, sf_dir)
    both = union_metrics({kind: points[kind] for kind in ("sum", "histogram")})
    return unnest(both.select("MetricName", "TimeUnix", "Attributes", "Exemplars"), "Exemplars").select(
        "MetricName", "TimeUnix", map_text("Attributes", "svc").alias("svc"), map_text("Attributes", "type").alias("type"),
        F.col("Exemplars_Value").alias("value"), F.col("Exemplars_TimeUnix_ns").alias("at_ns"),
        F.col("Exemplars_TraceId").alias("trace_id"), F.col("Exemplars_SpanId").alias("span_id"),
        map_text("Exemplars_FilteredAttributes", "note").alias("note"), F.size("Exemplars_FilteredAttributes").alias("n_labels"),
    )


@query
def otlp_spans(spark, sf_dir):
    parsed = otlp_to_spans(parse_lines(fx.span_requests(fx.spans(spark, sf_dir)), schemas.OTLP_TRACES))
    return parsed.select(
        "Timestamp", "Timestamp_ns", "TraceId", "SpanId", "ParentSpanId", "SpanName", "SpanKind", "ServiceName",
        "Duration", "StatusCode", "StatusMessage", F.size("Events").alias("n_events"), F.size("Links").alias("n_links"),
        map_text("SpanAttributes", "k").alias("k"),
    )


@query
def otlp_span_events(spark, sf_dir):
    """What is inside the lists of parsed spans, with nanoseconds."""
    parsed = otlp_to_spans(parse_lines(fx.span_requests(fx.spans(spark, sf_dir)), schemas.OTLP_TRACES))
    return unnest(parsed.select("TraceId", "SpanId", "Events"), "Events").select(
        "TraceId", "SpanId", F.col("Events_Name").alias("name"), F.col("Events_Timestamp").alias("at"),
        F.col("Events_Timestamp_ns").alias("at_ns"), map_text("Events_Attributes", "k").alias("k"),
    )


def _otlp_metric(spark, sf_dir, kind, df):
    return otlp_to_metrics(parse_lines(fx.metric_requests({kind: df}), schemas.OTLP_METRICS))[kind]


@query
def otlp_metrics_gauge(spark, sf_dir):
    return _otlp_metric(spark, sf_dir, "gauge", fx.gauge(spark, sf_dir)).select(
        "ServiceName", "MetricName", "TimeUnix", "TimeUnix_ns", "Value", map_text("Attributes", "k").alias("k"),
        F.size("Exemplars").alias("n_exemplars"),
    )


@query
def otlp_exemplars(spark, sf_dir):
    """Exemplars of parsed points, with nanoseconds."""
    points = _otlp_metric(spark, sf_dir, "gauge", fx.gauge(spark, sf_dir)).select("MetricName", "Exemplars")
    return unnest(points, "Exemplars").select(
        "MetricName", F.col("Exemplars_TimeUnix").alias("at"), F.col("Exemplars_TimeUnix_ns").alias("at_ns"),
        F.col("Exemplars_Value").alias("value"), F.col("Exemplars_TraceId").alias("trace_id"),
        F.col("Exemplars_SpanId").alias("span_id"),
    )


@query
def otlp_metrics_sum(spark, sf_dir):
    return _otlp_metric(spark, sf_dir, "sum", fx.counter(spark, sf_dir)).select(
        "ServiceName", "MetricName", "TimeUnix", "Value", map_text("Attributes", "user").alias("user"),
        "AggregationTemporality", "IsMonotonic",
    )


def _list(c):
    return F.array_join(F.col(c).cast("array<string>"), ",")


@query
def otlp_metrics_histogram(spark, sf_dir):
    return _otlp_metric(spark, sf_dir, "histogram", fx.histogram(spark, sf_dir)).select(
        "ServiceName", "MetricName", "TimeUnix", "Count", "Sum", "Min", "Max", _list("BucketCounts").alias("counts"),
        F.size("ExplicitBounds").alias("n_bounds"),
    )


@query
def otlp_metrics_exp_histogram(spark, sf_dir):
    return _otlp_metric(spark, sf_dir, "exp_histogram", fx.exp_histogram(spark, sf_dir)).select(
        "ServiceName", "MetricName", "TimeUnix", "Count", "Sum", "Scale", "ZeroCount", "PositiveOffset",
        F.size("PositiveBucketCounts").alias("n_buckets"),
        F.aggregate("PositiveBucketCounts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("in_buckets"),
    )


@query
def otlp_metrics_summary(spark, sf_dir):
    at = lambda i: F.get("ValueAtQuantiles", i)["Value"]
    return _otlp_metric(spark, sf_dir, "summary", fx.summary(spark, sf_dir)).select(
        "ServiceName", "MetricName", "TimeUnix", "Count", "Sum", at(0).alias("q50"), at(1).alias("q90"), at(2).alias("q99")
    )


# -- projections and filters ----------------------------------------------------


@query
def logs_default_view(spark, sf_dir):
    return views.logs_view(fx.logs(spark, sf_dir))


@query
def spans_default_view(spark, sf_dir):
    return views.spans_view(fx.spans(spark, sf_dir))


@query
def sessions_default_view(spark, sf_dir):
    """From the oldest session record to an hour before the newest one."""
    rows = fx.sessions(spark, sf_dir)
    ends = rows.agg(F.min("Timestamp").alias("first"), (F.max("Timestamp") - F.expr("INTERVAL 1 HOUR")).alias("last"))
    return views.sessions_view(rows, start=ends.select("first").scalar(), end=ends.select("last").scalar())


@query
def logs_context_view(spark, sf_dir):
    return views.logs_context_view(fx.logs(spark, sf_dir)).select(
        "time", "level", "message", "TraceId", "SpanId", "ServiceName", map_text("LogAttributes", "k").alias("k"),
        map_text("ResourceAttributes", "k8s.pod.name").alias("pod"),
    )


@query
def trace_field_view(spark, sf_dir):
    v = views.trace_view(fx.spans(spark, sf_dir))
    return v.select(*[c for c in v.columns if c not in ("tags", "serviceTags")], map_text("tags", "k").alias("k"),
                    map_text("serviceTags", "service.name").alias("serviceTag"))


@query
def filter_logs_by_fields(spark, sf_dir):
    return trf.filter_logs(fx.logs(spark, sf_dir), level="ERROR", service="svc-1", attrs={"log_type": "error"}).select(
        "event_id", "Body"
    )


@query
def search_logs(spark, sf_dir):
    return trf.search(fx.logs(spark, sf_dir), "PURCHASE BY").select("event_id", "Body")


@query
def search_documents_regex(spark, sf_dir):
    """Regular expression over whole texts."""
    docs = fx.table(spark, sf_dir, "documents")
    return trf.search(docs, r"[0-9]{3}-[0-9]{4}", column="text", regex=True).select("doc_id", "source")


@query
def inventory_like_filter(spark, sf_dir):
    inv = fx.file_inventory(spark, sf_dir)
    keep = F.col("table").like("%\\_local") & (F.col("table").isin("t1_local", "t2_local") | (F.col("tier") == "hot"))
    return inv.filter(keep).groupBy("table").agg(F.count("*").alias("files")).orderBy("table")


@query
def traced_log_count(spark, sf_dir):
    return trf.has_trace(fx.logs(spark, sf_dir)).agg(F.count("*").alias("n"))


# -- joins ----------------------------------------------------------------------


@query
def trace_lookup(spark, sf_dir):
    """One trace, by its stored time range: the trace of the longest span."""
    lake = lake_at(spark, "lookup", ["otel_traces", schemas.TRACE_RANGES])
    spans = fx.spans(spark, sf_dir)
    lake.write_spans(spans)
    wanted = spans.orderBy(F.desc("Duration"), "TraceId").select("TraceId").first()["TraceId"]
    return lake.get_trace(wanted).select("TraceId", "SpanId", "Timestamp", "Duration")


@query
def traces_with_errors(spark, sf_dir):
    """All spans of every trace that has an error log."""
    lake = lake_at(spark, "lookups", ["otel_traces", schemas.TRACE_RANGES])
    lake.write_spans(fx.spans(spark, sf_dir))
    ids = trf.has_trace(trf.filter_logs(fx.logs(spark, sf_dir), level="ERROR"))
    return lake.get_traces(ids).select("TraceId", "SpanId", "SpanName")


@query
def traces_by_id(spark, sf_dir):
    """The same on spans that are not stored."""
    ids = trf.has_trace(trf.filter_logs(fx.logs(spark, sf_dir), level="ERROR"))
    return trc.get_traces(fx.spans(spark, sf_dir), ids).select("TraceId", "SpanId", "SpanName")


@query
def logs_with_spans(spark, sf_dir):
    return trc.logs_for_traces(fx.logs(spark, sf_dir), fx.spans(spark, sf_dir)).select(
        "event_id", "TraceId", "SpanName", "SpanService", "Duration"
    )


@query
def logs_with_spans_left(spark, sf_dir):
    return trc.logs_for_traces(fx.logs(spark, sf_dir), fx.spans(spark, sf_dir), how="left").select(
        "event_id", F.coalesce("SpanName", F.lit("")).alias("SpanName")
    )


@query
def session_activity(spark, sf_dir):
    return trc.session_activity(fx.sessions(spark, sf_dir), fx.logs(spark, sf_dir), fx.spans(spark, sf_dir))


@query
def exemplar_spans(spark, sf_dir):
    return trc.exemplar_spans(fx.gauge(spark, sf_dir), fx.spans(spark, sf_dir)).select(
        "MetricName", "TimeUnix", F.col("Exemplars_Value").alias("value"), "TraceId", "SpanId", "SpanName", "SpanService"
    )


@query
def span_tree(spark, sf_dir):
    return trc.span_tree(fx.spans(spark, sf_dir)).select(
        "TraceId", "SpanId", "is_root", F.coalesce("parent_name", F.lit("")).alias("parent_name"),
        F.coalesce("parent_service", F.lit("")).alias("parent_service"), "n_children", "children_ns", "self_ns",
    )


@query
def span_roots(spark, sf_dir):
    """Root, depth, orphans and cycles of chains of spans."""
    return trc.span_roots(fx.span_chains(spark, sf_dir))


@query
def span_self_time(spark, sf_dir):
    return trc.span_self_time(fx.spans(spark, sf_dir)).select("SpanId", "Duration", "self_ns")


@query
def service_edges(spark, sf_dir):
    return trc.service_edges(fx.spans(spark, sf_dir)).withColumn("total_ns", F.col("total_ns").cast("bigint"))


@query
def service_edges_long_spans(spark, sf_dir):
    """Spans of months and years: their sums do not fit a BIGINT any more and are compared as text."""
    long = fx.spans(spark, sf_dir).withColumn("Duration", F.col("Duration") * F.lit(5_000_000_000))
    return trc.service_edges(long).withColumn("total_ns", F.col("total_ns").cast("string"))


@query
def red_metrics(spark, sf_dir):
    out = trc.red_metrics(fx.spans(spark, sf_dir), "1 day")
    return out.select("bucket", "ServiceName", "SpanName", "n", "errors",
                      *[F.round(p, 0).cast("bigint").alias(p) for p in ("p50", "p95", "p99")])


# -- profiles and metric series ---------------------------------------------------


@query
def log_volume(spark, sf_dir):
    return agg.log_histogram(fx.logs(spark, sf_dir), "1 hour")


@query
def attr_profile(spark, sf_dir):
    return agg.attr_profile(fx.logs(spark, sf_dir))


@query
def session_summary(spark, sf_dir):
    return agg.session_summary(fx.sessions(spark, sf_dir))


@query
def gauge_series(spark, sf_dir):
    g = fx.gauge(spark, sf_dir, fx.cents().cast("double"))
    key = F.regexp_extract("attr_key", r'"value":"([^"]*)"', 1).alias("k")
    return met.gauge_series(g, "1 day").select(
        "bucket", "ServiceName", "MetricName", key, "avg", "min", "max", "last", "n"
    )


@query
def counter_rate(spark, sf_dir):
    out = met.counter_rate(fx.counter(spark, sf_dir), "1 hour")
    user = F.regexp_extract("attr_key", r'"value":"([^"]*)"', 1).alias("user")
    return out.select("bucket", "ServiceName", "MetricName", user, "increase", "n", "rate")


@query
def histogram_quantile(spark, sf_dir):
    out = met.histogram_quantile(fx.histogram(spark, sf_dir), 0.9, "1 day")
    return out.select("bucket", "ServiceName", "MetricName", "n", F.round("quantile", 6).alias("p90"))


@query
def histogram_quantile_cumulative(spark, sf_dir):
    out = met.histogram_quantile(fx.cumulative_histogram(spark, sf_dir), 0.9, "1 day")
    return out.select("bucket", "ServiceName", "MetricName", "n", F.round("quantile", 6).alias("p90"))


@query
def exp_histogram_quantile_cumulative(spark, sf_dir):
    """Running points whose scale changes from hour to hour."""
    out = met.exp_histogram_quantile(fx.cumulative_exp_histogram(spark, sf_dir), 0.5, "1 day")
    return out.select("bucket", "ServiceName", "MetricName", "n", F.round("quantile", 6).alias("p50"))


@query
def exp_histogram_quantile(spark, sf_dir):
    out = met.exp_histogram_quantile(fx.exp_histogram(spark, sf_dir), 0.5, "1 day")
    return out.select("bucket", "ServiceName", "MetricName", "n", F.round("quantile", 6).alias("p50"))


@query
def histogram_quantile_mixed_bounds(spark, sf_dir):
    """Histograms on two layouts of bounds in one group; the number of all values is kept."""
    out = met.histogram_quantile_mixed(fx.histogram_of_two_layouts(spark, sf_dir), 0.9, "100 days", ["MetricName"])
    return out.select("bucket", "MetricName", F.round("n", 6).alias("n"), F.round("quantile", 6).alias("p90"))


@query
def counter_rate_restarts(spark, sf_dir):
    """Restarts told by the start time, steps shared out over the days they cross."""
    out = met.counter_rate_by_start(fx.restarting_counter(spark, sf_dir), "1 day")
    user = F.regexp_extract("attr_key", r'"value":"([^"]*)"', 1).alias("user")
    return out.select("bucket", "ServiceName", "MetricName", user, F.round("increase", 4).alias("increase"), "n")


@query
def summary_quantile(spark, sf_dir):
    return met.summary_quantile(fx.summary(spark, sf_dir), 0.9).select("ServiceName", "TimeUnix", "Count", "quantile")


@query
def metrics_by_kind(spark, sf_dir):
    u = met.union_metrics(fx.metrics(spark, sf_dir))
    return u.groupBy("kind", "ServiceName").agg(F.count("*").alias("n"), F.count_distinct("MetricName").alias("names"))


# -- tables on two tiers ----------------------------------------------------------


def _logs_lake(spark, sf_dir, name):
    lake = lake_at(spark, name, ["otel_logs"])
    lake.write(fx.logs(spark, sf_dir), "otel_logs")
    return lake


@query
def lake_logs_round_trip(spark, sf_dir):
    return _logs_lake(spark, sf_dir, "logs").scan("otel_logs", materialized=True).select(
        "Timestamp", "Timestamp_ns", "TimestampTime", "TraceId", "SpanId", "SeverityText", "ServiceName", "Body",
        map_text("LogAttributes", "k").alias("k"), "tier", "event_date",
    )


@query
def rand_sharding(spark, sf_dir):
    """Rows spread by seeded random numbers: shards, all rows, and whether the largest is within a third of the mean."""
    lake = lake_at(spark, "lake", ["otel_logs"])
    lake.write(fx.logs(spark, sf_dir), "otel_logs", tasks=3, seed=11)
    shards = inventory(lake, "otel_logs").groupBy(shard_of("path", 3).alias("shard")).agg(F.sum("rows").alias("n"))
    return shards.agg(F.count("*").alias("shards"), F.sum("n").alias("rows"), (F.max("n") < F.avg("n") * 4 / 3).alias("even"))


@query
def filter_logs_promoted(spark, sf_dir):
    """Attribute conditions on stored logs, answered by promoted columns."""
    lake = lake_at(spark, "lake", ["otel_logs"])
    lake.write(fx.logs(spark, sf_dir), "otel_logs")
    found = lake.scan("otel_logs", attrs={"log_type": "purchase"}, resource={"k8s.pod.name": "pod-3"})
    return found.select("SpanId", "Body", map_text("LogAttributes", "k").alias("k"))


@query
def search_logs_indexed(spark, sf_dir):
    """Text search through sketches of the files; a part written after the index is searched as well."""
    lake, index = lake_at(spark, "lake", ["otel_logs"]), scratch_dir(spark, "text-index")
    logs = fx.logs(spark, sf_dir)
    lake.write(logs.filter("event_id % 2 = 0"), "otel_logs")
    update_text_index(lake, "otel_logs", index)
    lake.write(logs.filter("event_id % 2 = 1"), "otel_logs")
    return search_files(lake, "otel_logs", index, "CHASE by user 1").select("SpanId", "Body")


@query
def lake_sessions_round_trip(spark, sf_dir):
    lake = lake_at(spark, "sessions", ["sessions"])
    lake.write(fx.sessions(spark, sf_dir), "sessions")
    return lake.scan("sessions").select("Timestamp", "ServiceName", "Body", map_text("LogAttributes", "sessionId").alias("sid"))


@query
def lake_traces_round_trip(spark, sf_dir):
    lake = lake_at(spark, "traces", ["otel_traces", schemas.TRACE_RANGES])
    lake.write_spans(fx.spans(spark, sf_dir))
    return lake.scan("otel_traces").select("TraceId", "SpanId", "Timestamp", "Duration", "event_date")


@query
def lake_trace_ranges(spark, sf_dir):
    """The stored range table gives what the view over all spans gives."""
    lake = lake_at(spark, "ranges", ["otel_traces", schemas.TRACE_RANGES])
    lake.write_spans(fx.spans(spark, sf_dir))
    return lake.trace_ranges()


@query
def lake_metrics_round_trip(spark, sf_dir):
    lake = lake_at(spark, "metrics", [schemas.metric_table(k) for k in schemas.METRIC_KINDS])
    lake.write_metrics(fx.metrics(spark, sf_dir))
    return lake.scan_metrics().groupBy("kind", "ServiceName").agg(
        F.count("*").alias("n"), F.min("TimeUnix").alias("oldest"), F.max("TimeUnix").alias("newest")
    )


@query
def lake_recent_count(spark, sf_dir):
    """Recent window with the bound on time column and partition day."""
    lake = _logs_lake(spark, sf_dir, "recent")
    return lake.scan("otel_logs", start="2024-01-20 06:30:00", end="2024-01-22 18:00:00").agg(F.count("*").alias("n"))


@query
def lake_recent_hour(spark, sf_dir):
    """The last hour of the data, its start being a scalar subquery."""
    lake = _logs_lake(spark, sf_dir, "hour")
    start = newest(lake.scan("otel_logs")) - F.expr("INTERVAL 1 HOUR")
    return lake.scan("otel_logs", start=start).agg(F.count("*").alias("n"))


@query
def hot_cold_scan(spark, sf_dir):
    """Rows per day and tier after days were moved: one table over both tiers."""
    lake = _logs_lake(spark, sf_dir, "tiers")
    apply_moves(lake, "otel_logs", fx.AS_OF)
    return lake.scan("otel_logs").groupBy("event_date", "tier").agg(F.count("*").alias("n"))


@query
def compact_day(spark, sf_dir):
    """Two appended segments, one day merged: rows per day stay, the day has fewer segments."""
    lake = _logs_lake(spark, sf_dir, "compact")
    lake.write(fx.logs(spark, sf_dir), "otel_logs")
    compact(lake, "otel_logs", "2024-01-10")
    rows = lake.files("otel_logs", "hot").groupBy("event_date").agg(
        F.count("*").alias("n"), F.count_distinct("seg").alias("segments"), F.count_distinct("SpanId").alias("spans")
    )
    return rows


@query
def compact_due_days(spark, sf_dir):
    """Two appended segments; every day that has both is merged in one job."""
    lake = _logs_lake(spark, sf_dir, "due")
    lake.write(fx.logs(spark, sf_dir), "otel_logs")
    compact_due(lake, "otel_logs", min_segments=2)
    return lake.files("otel_logs", "hot").groupBy("event_date").agg(
        F.count("*").alias("n"), F.count_distinct("seg").alias("segments"), F.count_distinct("SpanId").alias("spans")
    )


@query
def ttl_move_plan(spark, sf_dir):
    lake = _logs_lake(spark, sf_dir, "ttl")
    return plan_moves(inventory(lake, "otel_logs"), fx.AS_OF).select("table", "event_date", "reason")


@query
def size_move_plan(spark, sf_dir):
    inv = fx.file_inventory(spark, sf_dir)
    limit = inv.filter(F.col("tier") == "hot").agg(F.avg("file_bytes")).scalar()
    return plan_moves(inv, "1990-01-01", max_hot_bytes=limit).select("table", "event_date", "reason", "bytes")


@query
def space_move_plan(spark, sf_dir):
    inv = fx.file_inventory(spark, sf_dir)
    capacity = inv.filter(F.col("tier") == "hot").agg(F.sum("file_bytes")).scalar()
    return plan_moves(inv, "1990-01-01", hot_capacity_bytes=capacity, max_hot_bytes=1 << 60).select(
        "table", "event_date", "reason", "bytes"
    )


# -- reports ----------------------------------------------------------------------


@query
def compression_report(spark, sf_dir):
    return reports.compression_report(fx.file_inventory(spark, sf_dir)).drop("compressed", "uncompressed")


@query
def ingest_report(spark, sf_dir):
    return reports.ingest_report(fx.file_inventory(spark, sf_dir))


@query
def tier_report(spark, sf_dir):
    return reports.tier_report(fx.file_inventory(spark, sf_dir))


@query
def file_report(spark, sf_dir):
    return reports.file_report(fx.file_inventory(spark, sf_dir))


@query
def cold_count(spark, sf_dir):
    return reports.cold_count(fx.file_inventory(spark, sf_dir))


@query
def balance_by_shard(spark, sf_dir):
    df = fx.logs(spark, sf_dir).withColumn("table", F.lit("otel_logs"))
    out = reports.balance_report(df, F.concat(F.lit("shard-"), (F.col("event_id") % 3).cast("string")), F.lit(1))
    return out.withColumn("skew", F.round("skew", 9))


@query
def lake_ingest_report(spark, sf_dir):
    """Rows, oldest and newest from the footers of real files."""
    return reports.ingest_report(inventory(_logs_lake(spark, sf_dir, "ingest"), "otel_logs"))


@query
def lake_compression_report(spark, sf_dir):
    """Report on real files; their sizes are not known to SQL, so what holds for them is returned."""
    report = reports.compression_report(inventory(_logs_lake(spark, sf_dir, "ratio"), "otel_logs"))
    return report.select(
        "table", "rows", (F.col("compress_ratio") > 1).alias("smaller"),
        (F.col("compressed_bytes") < F.col("uncompressed_bytes")).alias("fewer_bytes"),
    )


@query
def lake_balance_report(spark, sf_dir):
    """Rows over the shards they were written to, per table."""
    lake = lake_at(spark, "balance", ["otel_logs"])
    lake.write(fx.logs(spark, sf_dir), "otel_logs", tasks=3)
    return reports.balance_report(inventory(lake, "otel_logs"), shard_of("path", 3)).groupBy("table").agg(
        F.count("*").alias("shards"), F.sum("rows").alias("rows"), (F.max("skew") < 1.1).alias("even")
    )


@query
def json_vs_columnar(spark, sf_dir):
    """Sizes of the same rows as line JSON, as plain columns and as stored."""
    lake = _logs_lake(spark, sf_dir, "sizes")
    rows = lake.scan("otel_logs").drop("tier", "event_date", "Timestamp_ns")
    stored = lake.scan("otel_logs", materialized=True).drop("tier", "event_date")
    return reports.size_comparison(rows, inventory(lake, "otel_logs"), stored)


@query
def json_vs_columnar_order(spark, sf_dir):
    """The same in what SQL can know: rows, and that each form is smaller than the one before."""
    return json_vs_columnar(spark, sf_dir).select(
        "rows", (F.col("json_bytes") > F.col("plain_bytes")).alias("plain_below_json"),
        (F.col("plain_bytes") > F.col("compressed_bytes")).alias("stored_below_plain"),
    )


@query
def stored_order(spark, sf_dir):
    """Neighbouring rows of each stored file that break the table's order (service, time): none."""
    lake = _logs_lake(spark, sf_dir, "order")
    place = Window.partitionBy("path").orderBy("row")
    rows = lake.files("otel_logs", "hot").select(
        "ServiceName", "Timestamp_ns", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")
    )
    key = F.struct("ServiceName", "Timestamp_ns")
    return rows.select((F.lag(key).over(place) > key).alias("broken")).agg(
        F.count("*").alias("n"), F.count_if("broken").alias("broken")
    )


@query
def scalar_functions(spark, sf_dir):
    """Text at a JSON path, whole seconds of a time, a readable size, and a time that falls back to the present."""
    now = F.localtimestamp()
    unset = trf.fix_time(fx.events(spark, sf_dir).select(
        "event_id", "ts", "props", "user_id", F.lit(0).cast("bigint").alias("Timestamp_ns"),
        F.lit(0).cast("bigint").alias("ObservedTimestamp_ns"),
    ))
    size = F.pow(F.col("user_id").cast("double"), F.lit(3.0)).cast("bigint")
    return unset.select(
        "event_id", json_string("props", "k").alias("k"), json_string("props", "none", 1).alias("none"),
        unix_seconds("ts").alias("seconds"), readable_size(size).alias("size"),
        F.col("Timestamp").between(now - F.expr("INTERVAL 1 HOUR"), now + F.expr("INTERVAL 1 HOUR")).alias("is_now"),
    )


# -- archive and streams ------------------------------------------------------------


def _archive(spark, sf_dir):
    root = scratch_dir(spark, "archive")
    write_otlp_archive(fx.logs(spark, sf_dir), root, "otel")
    return root


@query
def archive_round_trip(spark, sf_dir):
    root = _archive(spark, sf_dir)
    return archive_logs(read_otlp_logs(spark, f"{root}/otel")).select(
        "timestamp", "service_name", "severity", "body", "trace_id", "span_id"
    )


@query
def archive_raw_lines(spark, sf_dir):
    """Whole request lines: each is one JSON object, records add up."""
    lines = read_raw_lines(spark, f"{_archive(spark, sf_dir)}/otel")
    n = F.size(F.from_json(F.get_json_object("value", "$.resourceLogs[0].scopeLogs[0].logRecords"), "array<string>"))
    return lines.agg(F.sum(n).alias("records"), F.count_if(~F.col("value").startswith('{"resourceLogs"')).alias("odd"))


@query
def stream_logs(spark, sf_dir):
    """Files → logs pipeline → table, until the input is used up."""
    root, lake = _archive(spark, sf_dir), lake_at(spark, "stream", ["otel_logs"])
    out = scratch_dir(spark, "stream-archive")
    q = pipelines.logs(spark, f"{root}/otel", lake, out, scratch_dir(spark, "cp"), trigger=None, now=fx.AS_OF)
    q.awaitTermination()
    return lake.scan("otel_logs").select(
        "Timestamp", "ServiceName", "SeverityText", "Body", map_text("LogAttributes", "log_type").alias("log_type")
    )


@query
def stream_archive_sink(spark, sf_dir):
    """The second sink of the same pipeline holds the same records."""
    root, lake = _archive(spark, sf_dir), lake_at(spark, "stream", ["otel_logs"])
    out = scratch_dir(spark, "stream-archive")
    q = pipelines.logs(spark, f"{root}/otel", lake, out, scratch_dir(spark, "cp"), trigger=None, now=fx.AS_OF)
    q.awaitTermination()
    return archive_logs(read_otlp_logs(spark, f"{out}/otel")).groupBy("service_name", "severity").agg(F.count("*").alias("n"))


@query
def stream_sessions(spark, sf_dir):
    root, lake = _archive(spark, sf_dir), lake_at(spark, "stream", ["sessions"])
    q = pipelines.sessions(spark, f"{root}/otel", lake, scratch_dir(spark, "cp"), trigger=None, now=fx.AS_OF)
    q.awaitTermination()
    return agg.session_summary(lake.scan("sessions"))


def _archived_containers(spark, out):
    rows = otlp_to_logs(read_otlp_logs(spark, f"{out}/k8s"))
    return rows.select(
        F.col("Timestamp").alias("timestamp"), F.col("Body").alias("body"), map_text("LogAttributes", "log_type").alias("log_type"),
        map_text("LogAttributes", "log.iostream").alias("stream"), *_of_pod(),
    )


@query
def stream_container(spark, sf_dir):
    """Container files → pod metadata → archive."""
    src, out = _container_files(spark, sf_dir), scratch_dir(spark, "k8s")
    q = pipelines.container(spark, src, fx.pods(spark, sf_dir), out, scratch_dir(spark, "cp"), trigger=None)
    q.awaitTermination()
    return _archived_containers(spark, out)


@query
def stream_container_rotated(spark, sf_dir):
    """Rotated files in a first batch, the live ones in a second: the cut messages are carried from one to the other."""
    root, out, cp = (scratch_dir(spark, n) for n in ("pods", "k8s", "cp"))
    lines = fx.rotated_lines(spark, sf_dir)
    for part in (F.col("rotated"), ~F.col("rotated")):
        fx.log_files(lines.filter(part), root)
        pipelines.container(spark, f"{root}/*/*/*.log*", fx.pods(spark, sf_dir), out, cp, trigger=None).awaitTermination()
    return _archived_containers(spark, out)


@query
def container_tail(spark, sf_dir):
    """Files read while they grow, at three sizes that cut lines and messages, and once more after a rotation."""
    full, root, out, cp = (scratch_dir(spark, n) for n in ("full", "pods", "k8s", "cp"))
    names = [p.removeprefix(f"{full}/") for p in fx.log_files(fx.container_lines(spark, sf_dir), full)]
    for third in (1, 2, 3):
        for name in names:
            hadoop.copy_start(spark, f"{full}/{name}", f"{root}/{name}", hadoop.size(spark, f"{full}/{name}") * third // 3)
        pipelines.container(spark, f"{root}/*/*/*.log", fx.pods(spark, sf_dir), out, cp, None, follow=True).awaitTermination()
    for name in names:
        hadoop.rename(spark, f"{root}/{name}", f"{root}/{name}.20240201-000000")
    pipelines.container(spark, f"{root}/*/*/*.log", fx.pods(spark, sf_dir), out, cp, None, follow=True).awaitTermination()
    return _archived_containers(spark, out)


def _archived_values(spark, sf_dir):
    src, out = scratch_dir(spark, "in"), scratch_dir(spark, "archive")
    fx.typed_requests(spark, sf_dir).write.text(src)
    lake = lake_at(spark, "lake", ["otel_logs", "sessions"])
    pipelines.records(spark, src, lake, out, scratch_dir(spark, "cp"), None, fx.AS_OF, archive_type=None).awaitTermination()
    return out


@query
def archive_by_type(spark, sf_dir):
    """The archive's prefix is the log type of each record's resource, in all requests of the stream."""
    requests = read_otlp_logs(spark, f"{_archived_values(spark, sf_dir)}/log_type=*", typed=True)
    kind = F.regexp_extract("_metadata.file_path", "log_type=([^/]*)/", 1).alias("prefix")
    records = requests.select(kind, F.explode("resourceLogs").alias("r")).select("prefix", "r.resource", F.explode("r.scopeLogs").alias("s"))
    named = values_text(attrs_to_values("resource.attributes"))
    return (
        records.select("prefix", map_text(named, "log_type").alias("log_type"), F.size("s.logRecords").alias("c"))
        .groupBy("prefix", "log_type").agg(F.sum("c").alias("n"))
    )


@query
def archive_value_kinds(spark, sf_dir):
    """Values of every kind through the stream and the archive: kinds and values are those that came."""
    rows = otlp_to_logs(read_otlp_logs(spark, f"{_archived_values(spark, sf_dir)}/log_type=*", typed=True))
    v = lambda key: F.try_element_at("LogValues", F.lit(key))
    keys = ("n", "ok", "x", "raw", "list", "pairs", "s")
    in_list = typed_value(v("list"), "arrayValue")
    in_pairs = F.get(typed_value(v("pairs"), "kvlistValue"), 0)
    return rows.select(
        "SpanId", F.concat_ws(",", *[value_kind(v(key)) for key in keys], value_kind(F.try_element_at("ResourceValues", F.lit("zone")))).alias("kinds"),
        typed_value(F.col("BodyValue"), "intValue").alias("body"), typed_value(v("n"), "intValue").alias("n"),
        typed_value(v("ok"), "boolValue").alias("ok"), typed_value(v("x"), "doubleValue").alias("x"),
        F.decode(typed_value(v("raw"), "bytesValue"), "UTF-8").alias("raw"),
        typed_value(F.get(in_list, 0), "intValue").alias("list_n"), typed_value(F.get(in_list, 1), "stringValue").alias("list_s"),
        in_pairs["key"].alias("pair_key"),
        typed_value(F.get(typed_value(in_pairs["value"], "arrayValue"), 0), "boolValue").alias("pair_value"),
        typed_value(v("s"), "stringValue").alias("s"), map_text("LogAttributes", "log_type").alias("log_type"),
    )


@query
def stream_journal(spark, sf_dir):
    src, out = scratch_dir(spark, "journal"), scratch_dir(spark, "journal-archive")
    fx.journal_lines(spark, sf_dir).write.text(src)
    q = pipelines.journal(spark, src, fx.pods(spark, sf_dir), out, scratch_dir(spark, "cp"), trigger=None)
    q.awaitTermination()
    rows = otlp_to_logs(read_otlp_logs(spark, f"{out}/journal"))
    return rows.select("Timestamp", "Body", "SeverityText", map_text("ResourceAttributes", "log_type").alias("log_type"))


@query
def journal_since(spark, sf_dir):
    """Start position "from the end": entries before it are left out."""
    src = scratch_dir(spark, "journal")
    fx.journal_lines(spark, sf_dir).write.text(src)
    return read_journal_json(spark, src, since="2024-01-15 12:00:00").agg(F.count("*").alias("n"), F.min("Timestamp").alias("oldest"))


@query
def stream_traces(spark, sf_dir):
    src, lake = scratch_dir(spark, "spans"), lake_at(spark, "stream", ["otel_traces", schemas.TRACE_RANGES])
    fx.span_requests(fx.spans(spark, sf_dir)).write.text(src)
    pipelines.traces(spark, src, lake, scratch_dir(spark, "cp"), trigger=None).awaitTermination()
    spans = lake.scan("otel_traces").groupBy("TraceId").agg(F.count("*").alias("n"), F.sum("Duration").alias("ns"))
    return spans.join(lake.trace_ranges(), "TraceId")


@query
def stream_metrics(spark, sf_dir):
    src = scratch_dir(spark, "points")
    lake = lake_at(spark, "stream", [schemas.metric_table(k) for k in schemas.METRIC_KINDS])
    fx.metric_requests(fx.metrics(spark, sf_dir)).write.text(src)
    pipelines.metrics(spark, src, lake, scratch_dir(spark, "cp"), trigger=None).awaitTermination()
    return lake.scan_metrics().groupBy("kind", "ServiceName").agg(
        F.count("*").alias("n"), F.min("TimeUnix").alias("oldest"), F.max("TimeUnix").alias("newest")
    )


@query
def stream_records(spark, sf_dir):
    """One stream, three sinks: log table, archive and session table."""
    root, lake = _archive(spark, sf_dir), lake_at(spark, "stream", ["otel_logs", "sessions"])
    out = scratch_dir(spark, "stream-archive")
    pipelines.records(spark, f"{root}/otel", lake, out, scratch_dir(spark, "cp"), trigger=None, now=fx.AS_OF).awaitTermination()
    seen = lambda df, name: df.groupBy(F.lit(name).alias("sink"), F.col("ServiceName").alias("service")).agg(F.count("*").alias("n"))
    archived = otlp_to_logs(read_otlp_logs(spark, f"{out}/otel"))
    return seen(lake.scan("otel_logs"), "logs").unionByName(seen(lake.scan("sessions"), "sessions")).unionByName(seen(archived, "archive"))


@query
def stream_two_checkpoints(spark, sf_dir):
    """The input through each of two checkpoints into one lake: nothing is written over."""
    root, lake = _archive(spark, sf_dir), lake_at(spark, "stream", ["otel_logs"])
    for name in ("cp-a", "cp-b"):
        out, cp = scratch_dir(spark, "stream-archive"), scratch_dir(spark, name)
        pipelines.logs(spark, f"{root}/otel", lake, out, cp, trigger=None, now=fx.AS_OF).awaitTermination()
    return lake.scan("otel_logs").groupBy("SpanId").agg(F.count("*").alias("n"))


@query
def ingest_counters(spark, sf_dir):
    """Counters that the logs pipeline has written with its batches."""
    root, lake = _archive(spark, sf_dir), lake_at(spark, "stream", ["otel_logs"])
    cp = scratch_dir(spark, "cp")
    pipelines.logs(spark, f"{root}/otel", lake, scratch_dir(spark, "a"), cp, trigger=None, now=fx.AS_OF).awaitTermination()
    return reports.ingest_counters(reports.counter_rows(spark, pipelines.counters(cp)))


def _odd_input(spark, sf_dir):
    """Five pipelines under one checkpoint root, with lines among their input that none of them can read. Each starts when its
    input is there."""
    cp, out = scratch_dir(spark, "cp"), scratch_dir(spark, "out")
    lake, pods = lake_at(spark, "lake"), fx.pods(spark, sf_dir)
    odd = fx.odd_lines(spark, sf_dir).select("value")
    runs = []
    batch = fx.PACKED_BATCH
    for name, lines, run in (
        ("logs", otlp_requests(fx.logs(spark, sf_dir)), lambda src: pipelines.records(spark, src, lake, out, cp, None, fx.AS_OF, pack=True, **batch)),
        ("traces", fx.span_requests(fx.spans(spark, sf_dir)), lambda src: pipelines.traces(spark, src, lake, cp, None, **batch)),
        ("metrics", fx.metric_requests({"gauge": fx.gauge(spark, sf_dir)}), lambda src: pipelines.metrics(spark, src, lake, cp, None, **batch)),
        ("journal", fx.journal_lines(spark, sf_dir), lambda src: pipelines.journal(spark, src, pods, out, cp, None, None, pack=True, **batch)),
    ):
        src = scratch_dir(spark, name)
        for part in (lines.toDF("value"), odd):
            fx.packed_lines(part, src)
        runs.append(run(src))
    fx.log_files(fx.odd_container_lines(spark, sf_dir), f"{out}-pods")
    runs.append(pipelines.container(spark, f"{out}-pods/*/*/*.log", pods, out, cp, None, pack=True))
    for run in runs:
        run.awaitTermination()
    return cp


@query
def stream_backlog(spark, sf_dir):
    """Three files, one a batch: what was outstanding at the end of each, and rows of units of at most 100."""
    src, cp = scratch_dir(spark, "requests"), scratch_dir(spark, "cp")
    otlp_requests(fx.logs(spark, sf_dir)).repartition(3).write.text(src)
    lake = lake_at(spark, "lake", ["otel_logs", "sessions"])
    lake.rows_per_file = 100
    pipelines.records(
        spark, src, lake, scratch_dir(spark, "a"), cp, None, fx.AS_OF, watch=True, maxFilesPerTrigger="1"
    ).awaitTermination()
    rows = inventory(lake, "otel_logs").unionByName(inventory(lake, "sessions")).agg(
        F.sum("rows").alias("rows"), (F.max("rows") <= 100).alias("small_units")
    )
    left = reports.backlog_rows(spark, pipelines.counters(cp))
    return left.select("batch", "files", (F.col("bytes") > 0).alias("has_bytes")).join(rows)


@query
def rejected_lines(spark, sf_dir):
    """What five pipelines have turned away, line by line with its reason and batch."""
    rejected = sinks.rejected_lines(spark, pipelines.rejected(_odd_input(spark, sf_dir)))
    return rejected.select(
        "pipeline", "line", "reason", "passed", "batch", F.col("source_file").startswith("file:").alias("has_file"),
        (F.col("query") != "").alias("has_query"),
    )


@query
def ingest_counters_by_pipeline(spark, sf_dir):
    rows = reports.counter_rows(spark, pipelines.counters(_odd_input(spark, sf_dir)))
    return rows.groupBy("pipeline", "event").agg(F.sum("value").alias("value"))


@query
def tier_filter_scan(spark, sf_dir):
    """A tier literal in a filter keeps the other tier out of the plan; counts per tier."""
    lake = _logs_lake(spark, sf_dir, "arms")
    apply_moves(lake, "otel_logs", fx.AS_OF)
    out = None
    for t in TIERS:
        arm = lake.scan("otel_logs").filter(F.col("tier") == t).agg(F.count("*").alias("n"), F.lit(t).alias("tier"))
        out = arm if out is None else out.unionByName(arm)
    return out
