"""Table layouts and the shapes of the raw inputs.

Strings are stored non-null, the empty string means "absent". Instants carry
nanoseconds in a ``*_ns`` BIGINT next to the microsecond ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

S, L, I, D, B = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()
TS, DAY = TimestampNTZType(), DateType()
MAP = MapType(S, S)


def _struct(**columns: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


# ---------------------------------------------------------------------------
# Column names, order and types of the stored tables.
# ---------------------------------------------------------------------------
_LOGS = _struct(
    Timestamp=TS, Timestamp_ns=L, TraceId=S, SpanId=S, TraceFlags=L, SeverityText=S,
    SeverityNumber=I, ServiceName=S, Body=S, ResourceSchemaUrl=S, ResourceAttributes=MAP,
    ScopeSchemaUrl=S, ScopeName=S, ScopeVersion=S, ScopeAttributes=MAP, LogAttributes=MAP,
    EventName=S, TimestampTime=TS,
)

EVENTS_TYPE = ArrayType(_struct(Timestamp=TS, Timestamp_ns=L, Name=S, Attributes=MAP))
LINKS_TYPE = ArrayType(_struct(TraceId=S, SpanId=S, TraceState=S, Attributes=MAP))

_SPANS = _struct(
    Timestamp=TS, Timestamp_ns=L, TraceId=S, SpanId=S, ParentSpanId=S, TraceState=S,
    SpanName=S, SpanKind=S, ServiceName=S, ResourceAttributes=MAP, ScopeName=S,
    ScopeVersion=S, SpanAttributes=MAP, Duration=L, StatusCode=S, StatusMessage=S,
    Events=EVENTS_TYPE, Links=LINKS_TYPE,
)

EXEMPLARS_TYPE = ArrayType(
    _struct(FilteredAttributes=MAP, TimeUnix=TS, TimeUnix_ns=L, Value=D, SpanId=S, TraceId=S)
)
QUANTILES_TYPE = ArrayType(_struct(Quantile=D, Value=D))

_POINT = dict(
    ResourceAttributes=MAP, ResourceSchemaUrl=S, ScopeName=S, ScopeVersion=S, ScopeAttributes=MAP,
    ScopeDroppedAttrCount=L, ScopeSchemaUrl=S, ServiceName=S, MetricName=S, MetricDescription=S,
    MetricUnit=S, Attributes=MAP, StartTimeUnix=TS, StartTimeUnix_ns=L, TimeUnix=TS, TimeUnix_ns=L,
)
_NUMBER = dict(Value=D, Flags=L, Exemplars=EXEMPLARS_TYPE)

TABLES: dict[str, StructType] = {
    "otel_logs": _LOGS,
    "otel_traces": _SPANS,
    "otel_metrics_gauge": _struct(**_POINT, **_NUMBER),
    "otel_metrics_sum": _struct(**_POINT, **_NUMBER, AggregationTemporality=I, IsMonotonic=B),
    "otel_metrics_histogram": _struct(
        **_POINT, Count=L, Sum=D, BucketCounts=ArrayType(L), ExplicitBounds=ArrayType(D),
        Exemplars=EXEMPLARS_TYPE, Flags=L, Min=D, Max=D, AggregationTemporality=I,
    ),
    "otel_metrics_exp_histogram": _struct(
        **_POINT, Count=L, Sum=D, Scale=I, ZeroCount=L, PositiveOffset=I,
        PositiveBucketCounts=ArrayType(L), NegativeOffset=I, NegativeBucketCounts=ArrayType(L),
        Exemplars=EXEMPLARS_TYPE, Flags=L, Min=D, Max=D, AggregationTemporality=I,
    ),
    "otel_metrics_summary": _struct(
        **_POINT, Count=L, Sum=D, ValueAtQuantiles=QUANTILES_TYPE, Flags=L
    ),
    "sessions": _LOGS,
}

# Small per-trace time range table kept next to the spans, so that a trace
# lookup need not scan all spans first.
TRACE_RANGES = "otel_traces_trace_id_ts"
RANGES_SCHEMA = _struct(TraceId=S, Start=TS, End=TS, Start_ns=L)

METRIC_KINDS = ("gauge", "sum", "histogram", "exp_histogram", "summary")

# Sort keys inside a day. Attributes are ordered through their canonical text.
_METRIC_SORT = ("ServiceName", "MetricName", "Attributes", "TimeUnix_ns")
SORT_KEYS: dict[str, tuple[str, ...]] = {
    "otel_logs": ("ServiceName", "Timestamp_ns"),
    "sessions": ("ServiceName", "Timestamp_ns"),
    "otel_traces": ("ServiceName", "SpanName", "Timestamp_ns", "TraceId"),
    TRACE_RANGES: ("TraceId", "Start_ns"),
    **{f"otel_metrics_{k}": _METRIC_SORT for k in METRIC_KINDS},
}

# Columns computed on write and left out of the default projection.
MATERIALIZED = {"otel_logs": ("TimestampTime",), "sessions": ("TimestampTime",)}


# Attributes that are also stored as columns of their own, so that a search for a value can skip row groups.
PROMOTED: dict[str, dict[str, tuple[str, str]]] = {
    t: {
        "attr_sessionId": ("LogAttributes", "sessionId"),
        "attr_log_type": ("LogAttributes", "log_type"),
        "attr_k8s_pod_name": ("ResourceAttributes", "k8s.pod.name"),
    }
    for t in ("otel_logs", "sessions")
}


def promoted_column(table: str, map_column: str, key: str) -> str | None:
    return next((c for c, source in PROMOTED.get(table, {}).items() if source == (map_column, key)), None)


def metric_table(kind: str) -> str:
    return f"otel_metrics_{kind}"


def table_schema(table: str) -> StructType:
    return RANGES_SCHEMA if table == TRACE_RANGES else TABLES[table]


def time_column(table: str) -> str:
    if table == TRACE_RANGES:
        return "Start"
    return "TimeUnix" if table.startswith("otel_metrics_") else "Timestamp"


# ---------------------------------------------------------------------------
# OTLP-JSON request shapes (one request per line). 64-bit numbers
# arrive as text or as numbers, so they are declared STRING and cast later.
# ---------------------------------------------------------------------------
_ANY = (
    "STRUCT<stringValue:STRING,intValue:STRING,doubleValue:STRING,boolValue:STRING,"
    "arrayValue:STRING,kvlistValue:STRING,bytesValue:STRING>"
)
KEY_VALUES = f"ARRAY<STRUCT<key:STRING,value:{_ANY}>>"
_RESOURCE = f"resource:STRUCT<attributes:{KEY_VALUES}>"
_SCOPE = (
    f"scope:STRUCT<name:STRING,version:STRING,attributes:{KEY_VALUES},"
    "droppedAttributesCount:STRING>"
)

LOG_RECORD = f"""STRUCT<timeUnixNano:STRING,observedTimeUnixNano:STRING,
    severityText:STRING,severityNumber:STRING,body:{_ANY},traceId:STRING,spanId:STRING,
    flags:STRING,eventName:STRING,attributes:{KEY_VALUES}>"""

_SPAN_EVENT = f"STRUCT<timeUnixNano:STRING,name:STRING,attributes:{KEY_VALUES}>"
_SPAN_LINK = f"STRUCT<traceId:STRING,spanId:STRING,traceState:STRING,attributes:{KEY_VALUES}>"
_SPAN = f"""STRUCT<traceId:STRING,spanId:STRING,parentSpanId:STRING,traceState:STRING,
    name:STRING,kind:STRING,startTimeUnixNano:STRING,endTimeUnixNano:STRING,
    attributes:{KEY_VALUES},status:STRUCT<code:STRING,message:STRING>,
    events:ARRAY<{_SPAN_EVENT}>,links:ARRAY<{_SPAN_LINK}>>"""

_EXEMPLAR = f"""STRUCT<filteredAttributes:{KEY_VALUES},timeUnixNano:STRING,
    asDouble:STRING,asInt:STRING,spanId:STRING,traceId:STRING>"""
_POINT_HEAD = f"attributes:{KEY_VALUES},startTimeUnixNano:STRING,timeUnixNano:STRING,flags:STRING"
_NUMBER_POINT = f"""STRUCT<{_POINT_HEAD},asDouble:STRING,asInt:STRING,
    exemplars:ARRAY<{_EXEMPLAR}>>"""
_HIST_POINT = f"""STRUCT<{_POINT_HEAD},count:STRING,sum:DOUBLE,bucketCounts:ARRAY<STRING>,
    explicitBounds:ARRAY<DOUBLE>,exemplars:ARRAY<{_EXEMPLAR}>,min:DOUBLE,max:DOUBLE>"""
_EXP_BUCKETS = "STRUCT<offset:INT,bucketCounts:ARRAY<STRING>>"
_EXP_POINT = f"""STRUCT<{_POINT_HEAD},count:STRING,sum:DOUBLE,scale:INT,zeroCount:STRING,
    positive:{_EXP_BUCKETS},negative:{_EXP_BUCKETS},exemplars:ARRAY<{_EXEMPLAR}>,
    min:DOUBLE,max:DOUBLE>"""
_SUMMARY_POINT = f"""STRUCT<{_POINT_HEAD},count:STRING,sum:DOUBLE,
    quantileValues:ARRAY<STRUCT<quantile:DOUBLE,value:DOUBLE>>>"""
_METRIC = f"""STRUCT<name:STRING,description:STRING,unit:STRING,
    gauge:STRUCT<dataPoints:ARRAY<{_NUMBER_POINT}>>,
    sum:STRUCT<dataPoints:ARRAY<{_NUMBER_POINT}>,aggregationTemporality:STRING,
               isMonotonic:BOOLEAN>,
    histogram:STRUCT<dataPoints:ARRAY<{_HIST_POINT}>,aggregationTemporality:STRING>,
    exponentialHistogram:STRUCT<dataPoints:ARRAY<{_EXP_POINT}>,aggregationTemporality:STRING>,
    summary:STRUCT<dataPoints:ARRAY<{_SUMMARY_POINT}>>>"""


def _request(outer: str, mid: str, leaf: str, item: str) -> str:
    return (
        f"{outer} ARRAY<STRUCT<{_RESOURCE},schemaUrl:STRING,"
        f"{mid}:ARRAY<STRUCT<{_SCOPE},schemaUrl:STRING,{leaf}:ARRAY<{item}>>>>>"
    )


OTLP_LOGS = _request("resourceLogs", "scopeLogs", "logRecords", LOG_RECORD)
# The same with values as VARIANT, which keeps their kind at any depth.
OTLP_LOGS_TYPED = OTLP_LOGS.replace(_ANY, "VARIANT")
OTLP_TRACES = _request("resourceSpans", "scopeSpans", "spans", _SPAN)
OTLP_METRICS = _request("resourceMetrics", "scopeMetrics", "metrics", _METRIC)

# Pod table used to enrich records; unique on the first two columns.
PODS = _struct(pod_name=S, namespace=S, pod_uid=S, container_name=S, node_name=S)

# One row per stored file.
INVENTORY = _struct(
    table=S, tier=S, event_date=DAY, seg=S, path=S, rows=L, compressed_bytes=L,
    uncompressed_bytes=L, file_bytes=L, min_time=TS, max_time=TS,
)
