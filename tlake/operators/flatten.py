"""Unnesting of OTLP requests into flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tlake import schemas
from tlake.functions import (
    as_bigint,
    any_value_text,
    attrs_to_map,
    attrs_to_values,
    empty_map,
    first_attr,
    from_unix_nanos,
    json_value,
    map_text,
    text,
    trunc_second,
    values_text,
    variant_text,
)


def left_array_join(df: DataFrame, arr: Column | str, alias: str) -> DataFrame:
    """One row per element; a row with an empty or NULL array is kept with a NULL element."""
    return df.select("*", F.explode_outer(arr).alias(alias))


def unnest(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """Array-of-struct column → one row per element, fields as ``<column>_<field>``."""
    element = df.schema[column].dataType.elementType
    explode = F.explode_outer if keep_empty else F.explode
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, explode(column).alias("_e")).select(
        *rest, *[F.col(f"_e.{f.name}").alias(f"{column}_{f.name}") for f in element.fields]
    )


def _three_levels(
    df: DataFrame,
    outer: str,
    mid: str,
    leaf: str,
    per_resource: list[Column | str],
    per_scope: list[Column | str],
    keep_empty: bool = False,
) -> DataFrame:
    """Columns of the resource and of the scope, and ``item``, one row per leaf element.

    ``per_resource`` reads ``resource`` and ``res_url``, ``per_scope`` reads ``scope``
    and ``scope_url``; both are computed before the level below is unnested, once per
    list and not once per element. Each list is a column of its own when it is
    unnested, so that no element drags the list it came from along.

    All levels use the outer form; without ``keep_empty`` rows without an element go at
    the end. An inner explode would make the optimizer test the list for emptiness below
    the projection that parses it, and parse the text once more for the test.
    """
    carried = [c for c in df.columns if c != outer]
    named = lambda cols, frame: frame.select(*cols).columns
    res = df.select(*carried, F.explode_outer(outer).alias("_r")).select(
        *carried, F.col("_r.resource").alias("resource"), F.col("_r.schemaUrl").alias("res_url"),
        F.col(f"_r.{mid}").alias("_list"),
    )
    above = [*carried, *named(per_resource, res)]
    res = res.select(*carried, *per_resource, "_list")
    scope = res.select(*above, F.explode_outer("_list").alias("_s")).select(
        *above, F.col("_s.scope").alias("scope"), F.col("_s.schemaUrl").alias("scope_url"),
        F.col(f"_s.{leaf}").alias("_list"),
    )
    kept = [*above, *named(per_scope, scope)]
    flat = scope.select(*above, *per_scope, "_list").select(*kept, F.explode_outer("_list").alias("item"))
    return flat if keep_empty else flat.filter(F.col("item").isNotNull())


def flatten_otlp_logs(df: DataFrame, keep_empty: bool = True) -> DataFrame:
    """resourceLogs → scopeLogs → logRecords; columns resource, res_url, scope, scope_url, item."""
    return _three_levels(
        df, "resourceLogs", "scopeLogs", "logRecords", ["resource", "res_url"], ["scope", "scope_url"], keep_empty
    )


def archive_logs(df: DataFrame) -> DataFrame:
    """Flat view of archived requests: the seven columns of the ad-hoc archive query.

    Requests with an empty list on any level keep one row with default values.
    """
    service = first_attr("resource.attributes", "service.name").alias("service_name")
    flat = _three_levels(df, "resourceLogs", "scopeLogs", "logRecords", [service], [], keep_empty=True)
    return flat.select(
        from_unix_nanos(as_bigint("item.timeUnixNano")).alias("timestamp"),
        "service_name",
        text("item.severityText").alias("severity"),
        text("item.body.stringValue").alias("body"),
        text("item.traceId").alias("trace_id"),
        text("item.spanId").alias("span_id"),
        attrs_to_map("item.attributes").alias("log_attributes"),
    )


def container_fields(lines: DataFrame, first_only: bool = True) -> DataFrame:
    """Path-based extraction from raw request lines (column ``value``).

    ``first_only`` reads the first element on each level, as the ad-hoc
    container query does; otherwise every record is returned.
    """
    if not first_only:
        parsed = lines.select(F.from_json("value", schemas.OTLP_LOGS).alias("r")).select("r.*")
        names = {"namespace": "k8s.namespace.name", "pod_name": "k8s.pod.name", "container_name": "k8s.container.name"}
        pod = [first_attr("resource.attributes", k).alias(n) for n, k in names.items()]
        flat = _three_levels(parsed, "resourceLogs", "scopeLogs", "logRecords", pod, [], keep_empty=True)
        return flat.select(
            from_unix_nanos(as_bigint("item.timeUnixNano")).alias("timestamp"), *names,
            text("item.body.stringValue").alias("log_body"), text("item.severityText").alias("severity"),
        )
    # Two passes over the line, each cut down to what is read from it.
    parts = lines.select(
        json_value("value", schemas.LOG_RECORD, "resourceLogs", 1, "scopeLogs", 1, "logRecords", 1).alias("rec"),
        json_value("value", schemas.KEY_VALUES, "resourceLogs", 1, "resource", "attributes").alias("attrs"),
    )
    return parts.select(
        from_unix_nanos(as_bigint("rec.timeUnixNano")).alias("timestamp"),
        first_attr("attrs", "k8s.namespace.name").alias("namespace"),
        first_attr("attrs", "k8s.pod.name").alias("pod_name"),
        first_attr("attrs", "k8s.container.name").alias("container_name"),
        text("rec.body.stringValue").alias("log_body"),
        text("rec.severityText").alias("severity"),
    )


def _number(x: str) -> Column:
    """Whole number or 0. Nothing here raises: one bad record must not stop a stream."""
    return F.coalesce(as_bigint(x), F.lit(0).cast("bigint"))


def _nanos(e: Column) -> Column:
    """Time of a nested event or exemplar, 0 when it has none."""
    return F.coalesce(as_bigint(e["timeUnixNano"]), F.lit(0).cast("bigint"))


def finish_logs(df: DataFrame) -> DataFrame:
    """Derive the timestamp columns from ``Timestamp_ns``; call after time repair."""
    return df.withColumns(
        {
            "Timestamp": from_unix_nanos("Timestamp_ns"),
            "TimestampTime": trunc_second(from_unix_nanos("Timestamp_ns")),
        }
    )


def log_rows(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    """Fill the log layout: given columns, defaults for the rest. ``Timestamp_ns`` is required."""
    cols = []
    for f in schemas.TABLES["otel_logs"].fields:
        if f.name in ("Timestamp", "TimestampTime"):
            continue
        if f.name in given:
            c = given[f.name]
        elif f.dataType.typeName() == "string":
            c = F.lit("")
        elif f.dataType.typeName() == "map":
            c = empty_map()
        else:
            c = F.lit(0)
        cols.append(c.cast(f.dataType).alias(f.name))
    carried = [v.alias(k) for k, v in given.items() if k not in schemas.TABLES["otel_logs"].names]
    return finish_logs(df.select(*cols, *carried)).select(
        *schemas.TABLES["otel_logs"].names, *[k for k in given if k not in schemas.TABLES["otel_logs"].names]
    )


def _values_are_typed(df: DataFrame) -> bool:
    resource = df.schema["resourceLogs"].dataType.elementType["resource"].dataType
    return resource["attributes"].dataType.elementType["value"].dataType.typeName() == "variant"


def otlp_to_logs(df: DataFrame) -> DataFrame:
    """Requests → rows in table layout plus ``ObservedTimestamp_ns`` (0 = not set).

    Requests read with typed values give ``ResourceValues``, ``LogValues`` (maps of VARIANT) and ``BodyValue`` besides, for the archive.
    """
    typed = _values_are_typed(df)
    if typed:
        of_resource = [attrs_to_values("resource.attributes").alias("ResourceValues")]
        attributes, body = values_text(attrs_to_values("scope.attributes")), text(variant_text(F.col("item.body")))
    else:
        of_resource = [
            attrs_to_map("resource.attributes").alias("ResourceAttributes"),
            first_attr("resource.attributes", "service.name").alias("ServiceName"),
        ]
        attributes, body = attrs_to_map("scope.attributes"), text(any_value_text(F.col("item.body")))
    flat = _three_levels(
        df, "resourceLogs", "scopeLogs", "logRecords",
        [text("res_url").alias("ResourceSchemaUrl"), *of_resource],
        [
            text("scope_url").alias("ScopeSchemaUrl"),
            text("scope.name").alias("ScopeName"),
            text("scope.version").alias("ScopeVersion"),
            attributes.alias("ScopeAttributes"),
        ],
    )
    values = []
    if typed:
        # Maps of text are made from those of values; both are columns before anything reads them.
        flat = flat.withColumn("ResourceAttributes", values_text("ResourceValues"))
        flat = flat.withColumn("LogValues", attrs_to_values("item.attributes"))
        flat = flat.withColumn("ServiceName", map_text("ResourceAttributes", "service.name"))
        values = ["ResourceValues", "LogValues", F.col("item.body").alias("BodyValue")]
    record = values_text("LogValues") if typed else attrs_to_map("item.attributes")
    rows = flat.select(
        "ResourceSchemaUrl", "ResourceAttributes", "ServiceName",
        "ScopeSchemaUrl", "ScopeName", "ScopeVersion", "ScopeAttributes",
        _number("item.timeUnixNano").alias("Timestamp_ns"),
        _number("item.observedTimeUnixNano").alias("ObservedTimestamp_ns"),
        text("item.traceId").alias("TraceId"),
        text("item.spanId").alias("SpanId"),
        _number("item.flags").alias("TraceFlags"),
        text("item.severityText").alias("SeverityText"),
        F.coalesce(F.col("item.severityNumber").try_cast("int"), F.lit(0)).alias("SeverityNumber"),
        body.alias("Body"),
        record.alias("LogAttributes"),
        text("item.eventName").alias("EventName"),
        *values,
    )
    names = schemas.TABLES["otel_logs"].names
    return finish_logs(rows).select(*names, "ObservedTimestamp_ns", *(["ResourceValues", "LogValues", "BodyValue"] if typed else []))


# Text forms of the span kind and status numbers of the OTLP standard.
SPAN_KINDS = ["Unspecified", "Internal", "Server", "Client", "Producer", "Consumer"]
STATUS_CODES = ["Unset", "Ok", "Error"]


def _enum(x: Column, names: list[str], prefix: str) -> Column:
    """Enum as number or as its standard name → short text."""
    out = F.when(x.isNull() | (x == ""), F.lit(names[0]))
    for i, n in enumerate(names):
        out = out.when(x.isin(str(i), f"{prefix}{n.upper()}"), F.lit(n))
    return out.otherwise(x)


def otlp_to_spans(df: DataFrame) -> DataFrame:
    flat = _three_levels(
        df, "resourceSpans", "scopeSpans", "spans",
        [
            first_attr("resource.attributes", "service.name").alias("ServiceName"),
            attrs_to_map("resource.attributes").alias("ResourceAttributes"),
        ],
        [text("scope.name").alias("ScopeName"), text("scope.version").alias("ScopeVersion")],
    )
    start = _number("item.startTimeUnixNano")
    return flat.select(
        from_unix_nanos(start).alias("Timestamp"),
        start.alias("Timestamp_ns"),
        text("item.traceId").alias("TraceId"),
        text("item.spanId").alias("SpanId"),
        text("item.parentSpanId").alias("ParentSpanId"),
        text("item.traceState").alias("TraceState"),
        text("item.name").alias("SpanName"),
        _enum(F.col("item.kind"), SPAN_KINDS, "SPAN_KIND_").alias("SpanKind"),
        "ServiceName", "ResourceAttributes", "ScopeName", "ScopeVersion",
        attrs_to_map("item.attributes").alias("SpanAttributes"),
        F.greatest(F.try_subtract(_number("item.endTimeUnixNano"), start), F.lit(0).cast("bigint")).alias("Duration"),
        _enum(F.col("item.status.code"), STATUS_CODES, "STATUS_CODE_").alias("StatusCode"),
        text("item.status.message").alias("StatusMessage"),
        F.transform(
            F.coalesce(F.col("item.events"), F.array()),
            lambda e: F.struct(
                from_unix_nanos(_nanos(e)).alias("Timestamp"),
                _nanos(e).alias("Timestamp_ns"),
                text(e["name"]).alias("Name"),
                attrs_to_map(e["attributes"]).alias("Attributes"),
            ),
        ).cast(schemas.EVENTS_TYPE).alias("Events"),
        F.transform(
            F.coalesce(F.col("item.links"), F.array()),
            lambda e: F.struct(
                text(e["traceId"]).alias("TraceId"),
                text(e["spanId"]).alias("SpanId"),
                text(e["traceState"]).alias("TraceState"),
                attrs_to_map(e["attributes"]).alias("Attributes"),
            ),
        ).cast(schemas.LINKS_TYPE).alias("Links"),
    )


# Temporality names of the OTLP standard.
TEMPORALITIES = ["UNSPECIFIED", "DELTA", "CUMULATIVE"]


def _temporality(x: str) -> Column:
    c = F.col(x)
    out = F.when(c.isNull(), F.lit(0))
    for i, n in enumerate(TEMPORALITIES):
        out = out.when(c.isin(str(i), f"AGGREGATION_TEMPORALITY_{n}"), F.lit(i))
    return out.otherwise(F.lit(0)).cast("int")


def _double(x: str) -> Column:
    return F.coalesce(F.col(x).cast("double"), F.lit(0.0))


def _exemplars() -> Column:
    return F.transform(
        F.coalesce(F.col("p.exemplars"), F.array()),
        lambda e: F.struct(
            attrs_to_map(e["filteredAttributes"]).alias("FilteredAttributes"),
            from_unix_nanos(_nanos(e)).alias("TimeUnix"),
            _nanos(e).alias("TimeUnix_ns"),
            F.coalesce(e["asDouble"].try_cast("double"), e["asInt"].try_cast("double"), F.lit(0.0)).alias("Value"),
            text(e["spanId"]).alias("SpanId"),
            text(e["traceId"]).alias("TraceId"),
        ),
    ).cast(schemas.EXEMPLARS_TYPE).alias("Exemplars")


def _counts(x: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.transform(F.coalesce(F.col(x), F.array().cast("array<string>")), lambda c: F.coalesce(as_bigint(c), zero))


def _point_columns(kind: str) -> list[Column]:
    number = [
        F.coalesce(
            F.col("p.asDouble").try_cast("double"), F.col("p.asInt").try_cast("double"), F.lit(0.0)
        ).alias("Value"),
        _number("p.flags").alias("Flags"),
    ] if kind in ("gauge", "sum") else []
    head = [_number("p.count").alias("Count"), _double("p.sum").alias("Sum")]
    tail = [_number("p.flags").alias("Flags")]
    span = [_double("p.min").alias("Min"), _double("p.max").alias("Max")]
    if kind == "gauge":
        return [*number, _exemplars()]
    if kind == "sum":
        return [*number, _exemplars(), "AggregationTemporality", "IsMonotonic"]
    if kind == "histogram":
        return [
            *head, _counts("p.bucketCounts").alias("BucketCounts"),
            F.coalesce(F.col("p.explicitBounds"), F.array().cast("array<double>")).alias("ExplicitBounds"),
            _exemplars(), *tail, *span, "AggregationTemporality",
        ]
    if kind == "exp_histogram":
        zero = F.lit(0)
        return [
            *head, F.coalesce("p.scale", zero).alias("Scale"), _number("p.zeroCount").alias("ZeroCount"),
            F.coalesce("p.positive.offset", zero).alias("PositiveOffset"),
            _counts("p.positive.bucketCounts").alias("PositiveBucketCounts"),
            F.coalesce("p.negative.offset", zero).alias("NegativeOffset"),
            _counts("p.negative.bucketCounts").alias("NegativeBucketCounts"),
            _exemplars(), *tail, *span, "AggregationTemporality",
        ]
    return [
        *head,
        F.transform(
            F.coalesce(F.col("p.quantileValues"), F.array()),
            lambda q: F.struct(q["quantile"].alias("Quantile"), q["value"].alias("Value")),
        ).cast(schemas.QUANTILES_TYPE).alias("ValueAtQuantiles"),
        *tail,
    ]


# Field of the request that holds the points of each kind.
_KIND_FIELD = {
    "gauge": "gauge", "sum": "sum", "histogram": "histogram",
    "exp_histogram": "exponentialHistogram", "summary": "summary",
}


def flatten_otlp_metrics(df: DataFrame) -> DataFrame:
    """resourceMetrics → scopeMetrics → metrics: the columns of resource and scope, and ``item``, a metric with its points."""
    per_resource = [
        attrs_to_map("resource.attributes").alias("ResourceAttributes"),
        text("res_url").alias("ResourceSchemaUrl"),
        first_attr("resource.attributes", "service.name").alias("ServiceName"),
    ]
    per_scope = [
        text("scope.name").alias("ScopeName"), text("scope.version").alias("ScopeVersion"),
        attrs_to_map("scope.attributes").alias("ScopeAttributes"),
        _number("scope.droppedAttributesCount").alias("ScopeDroppedAttrCount"),
        text("scope_url").alias("ScopeSchemaUrl"),
    ]
    return _three_levels(df, "resourceMetrics", "scopeMetrics", "metrics", per_resource, per_scope)


def metric_points(flat: DataFrame) -> dict[str, DataFrame]:
    """Metrics of ``flatten_otlp_metrics`` → one frame per point kind, in table layout. To write them all, persist the
    metrics: the outer levels are then unnested once for the five kinds."""
    above = [c for c in flat.columns if c != "item"]
    out = {}
    for kind, field in _KIND_FIELD.items():
        keep = [*above, text("item.name").alias("MetricName"), text("item.description").alias("MetricDescription"),
                text("item.unit").alias("MetricUnit")]
        if kind in ("sum", "histogram", "exp_histogram"):
            keep.append(_temporality(f"item.{field}.aggregationTemporality").alias("AggregationTemporality"))
        if kind == "sum":
            keep.append(F.coalesce(F.col("item.sum.isMonotonic"), F.lit(False)).alias("IsMonotonic"))
        lists = flat.select(*keep, F.col(f"item.{field}.dataPoints").alias("_list"))
        points = lists.select(*[c for c in lists.columns if c != "_list"], F.explode("_list").alias("p"))
        start, at = _number("p.startTimeUnixNano"), _number("p.timeUnixNano")
        rows = points.select(
            *above, "MetricName", "MetricDescription", "MetricUnit",
            attrs_to_map("p.attributes").alias("Attributes"),
            from_unix_nanos(start).alias("StartTimeUnix"), start.alias("StartTimeUnix_ns"),
            from_unix_nanos(at).alias("TimeUnix"), at.alias("TimeUnix_ns"),
            *_point_columns(kind),
        )
        out[kind] = rows.select(*schemas.TABLES[schemas.metric_table(kind)].names)
    return out


def otlp_to_metrics(df: DataFrame) -> dict[str, DataFrame]:
    """Requests → one frame per point kind, in table layout."""
    return metric_points(flatten_otlp_metrics(df))
