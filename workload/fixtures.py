"""Telemetry rows derived from the driver tables, by narrow expressions or plain groupings.

A trace is a run of eight events by id, its spans form a binary tree: all spans
and parents follow from the id, without ordering any group.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tlake import schemas
from tlake.functions import empty_map, epoch_micros, time_bucket, unix_nanos, unix_seconds
from tlake.operators.flatten import log_rows
from tlake.operators.percentiles import exact_percentiles
from tlake.plans import hadoop
from tlake.session import SHUFFLES_GO, prepare, scratch_dir, settings
from tlake.streaming.archive import PACKED_TEXT, key_values

BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
AS_OF = "2024-02-05 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def hex_id(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def trace_id() -> Column:
    return hex_id(F.expr("event_id div 8 + 1"), 32)


def span_id(n: Column | None = None) -> Column:
    return hex_id((F.col("event_id") if n is None else n) + 1, 16)


def cents() -> Column:
    return F.round(F.col("value") * 100).cast("bigint")


def k() -> Column:
    return F.get_json_object("props", "$.k")


def service(of: str = "user_id") -> Column:
    return F.concat(F.lit("svc-"), (F.col(of) % 5).cast("string"))


def pod() -> Column:
    return F.concat(F.lit("pod-"), (F.col("user_id") % 30).cast("string"))


def namespace() -> Column:
    return F.concat(F.lit("ns-"), (F.col("user_id") % 4).cast("string"))


def severity() -> Column:
    t = F.col("event_type")
    return F.when(t == "error", "ERROR").when(t == "purchase", "WARN").when(t == "view", "DEBUG").otherwise("INFO")


def body() -> Column:
    return F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"))


def logs(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Log rows in table layout, plus ``event_id``."""
    attrs = F.create_map(F.lit("k"), k(), F.lit("log_type"), F.col("event_type"))
    session = F.create_map(F.lit("sessionId"), F.concat(F.lit("s-"), F.col("user_id").cast("string")))
    return log_rows(
        events(spark, sf_dir) if source is None else source,
        {
            "Timestamp_ns": unix_nanos("ts"),
            "TraceId": F.when(F.col("event_id") % 10 == 0, "").otherwise(trace_id()),
            "SpanId": span_id(),
            "SeverityText": severity(),
            "ServiceName": service(),
            "Body": body(),
            "ScopeName": F.lit("app"),
            "ResourceAttributes": F.create_map(
                F.lit("service.name"), service(), F.lit("k8s.pod.name"), pod(),
                F.lit("k8s.namespace.name"), namespace(),
            ),
            "LogAttributes": F.when(F.col("user_id") % 3 == 0, F.map_concat(attrs, session)).otherwise(attrs),
            "event_id": F.col("event_id"),
        },
    )


def spans(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    rn = F.col("event_id") % 8 + 1
    parent = F.expr("(event_id div 8) * 8 + (event_id % 8 + 1) div 2 - 1")
    error = F.col("event_type") == "error"
    ev = F.array(F.struct(F.col("ts").alias("Timestamp"), (unix_nanos("ts") + 7).alias("Timestamp_ns"), F.lit("exception").alias("Name"),
                          F.create_map(F.lit("k"), k()).alias("Attributes")))
    links = F.array(F.struct(hex_id(F.expr("event_id div 8"), 32).alias("TraceId"), span_id().alias("SpanId"),
                             F.lit("").alias("TraceState"), empty_map().alias("Attributes")))
    given = (events(spark, sf_dir) if source is None else source).select(
        F.col("ts").alias("Timestamp"), unix_nanos("ts").alias("Timestamp_ns"),
        trace_id().alias("TraceId"), span_id().alias("SpanId"),
        F.when(rn == 1, "").otherwise(span_id(parent)).alias("ParentSpanId"), F.lit("").alias("TraceState"),
        F.col("event_type").alias("SpanName"), F.when(rn == 1, "Server").otherwise("Internal").alias("SpanKind"),
        service("event_id").alias("ServiceName"),
        F.create_map(F.lit("service.name"), service("event_id")).alias("ResourceAttributes"),
        F.lit("app").alias("ScopeName"), F.lit("1").alias("ScopeVersion"),
        F.create_map(F.lit("k"), k()).alias("SpanAttributes"), (cents() * 10000).alias("Duration"),
        F.when(error, "Error").otherwise("Ok").alias("StatusCode"),
        F.when(error, body()).otherwise("").alias("StatusMessage"),
        F.when(error, ev).otherwise(F.array()).cast(schemas.EVENTS_TYPE).alias("Events"),
        F.when((rn == 1) & (F.col("event_id") >= 8), links).otherwise(F.array())
        .cast(schemas.LINKS_TYPE).alias("Links"),
    )
    return given


def _points(df: DataFrame, kind: str, own: dict[str, Column], attrs: Column, at: Column, name: Column) -> DataFrame:
    """Metric rows in table layout."""
    common = {
        "ResourceAttributes": F.create_map(F.lit("service.name"), F.col("svc")),
        "ServiceName": F.col("svc"), "MetricName": name, "Attributes": attrs,
        "TimeUnix": at, "TimeUnix_ns": unix_nanos(at),
        "StartTimeUnix": F.lit("2024-01-01").cast("timestamp_ntz"),
        "StartTimeUnix_ns": F.lit(1_704_067_200_000_000_000),
    }
    cols = []
    for f in schemas.TABLES[schemas.metric_table(kind)].fields:
        c = {**common, **own}.get(f.name)
        if c is None:
            t = f.dataType.typeName()
            c = (F.lit("") if t == "string" else empty_map() if t == "map" else F.array() if t == "array" else F.lit(0))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def gauge(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    v = F.col("value") if value is None else value
    ex = F.array(F.struct(F.create_map(F.lit("k"), k()).alias("FilteredAttributes"), F.col("ts").alias("TimeUnix"),
                          (unix_nanos("ts") + 7).alias("TimeUnix_ns"), F.col("value").alias("Value"), span_id().alias("SpanId"), trace_id().alias("TraceId")))
    return _points(
        events(spark, sf_dir).withColumn("svc", service()), "gauge",
        {"Value": v, "Exemplars": F.when(F.col("event_id") % 10 != 0, ex).otherwise(F.array().cast(schemas.EXEMPLARS_TYPE))},
        F.create_map(F.lit("k"), k()), F.col("ts"), F.col("event_type"),
    )


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a reading of its user's counter; a smaller reading means a reset."""
    return _points(
        events(spark, sf_dir).withColumn("svc", service()), "sum",
        {"Value": cents().cast("double"), "AggregationTemporality": F.lit(2), "IsMonotonic": F.lit(True)},
        F.create_map(F.lit("user"), F.col("user_id").cast("string")), F.col("ts"), F.col("event_type"),
    )


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per (service, type, hour), upper bounds inclusive."""
    edges = [None, *BOUNDS, None]
    v = F.col("value")
    per_bound = []
    for lo, hi in zip(edges, edges[1:]):
        cond = F.lit(True) if lo is None else v > lo
        per_bound.append(F.count_if(cond if hi is None else cond & (v <= hi)))
    g = (
        events(spark, sf_dir)
        .groupBy(service().alias("svc"), "event_type", time_bucket("ts", "1 hour").alias("at"))
        .agg(
            F.count("*").alias("n"), (F.sum(cents()) / F.lit(100)).alias("s"), F.min("value").alias("lo"),
            F.max("value").alias("hi"), F.array(*per_bound).alias("counts"),
        )
    )
    return _points(
        g, "histogram",
        {"Count": F.col("n"), "Sum": F.col("s"), "Min": F.col("lo"), "Max": F.col("hi"),
         "BucketCounts": F.col("counts"), "ExplicitBounds": F.array(*[F.lit(b) for b in BOUNDS]),
         "AggregationTemporality": F.lit(1)},
        empty_map(), F.col("at"), F.col("event_type"),
    )


def cumulative_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly histograms of each series added up to running ones."""
    upto = Window.partitionBy("ServiceName", "MetricName").orderBy("TimeUnix").rowsBetween(Window.unboundedPreceding, 0)
    running = F.array(*[F.sum(F.get("BucketCounts", F.lit(i))).over(upto) for i in range(len(BOUNDS) + 1)])
    return histogram(spark, sf_dir).withColumns({"BucketCounts": running, "AggregationTemporality": F.lit(2)})


def log2_index() -> Column:
    """Index of the base-2 bucket (2^i, 2^(i+1)] that holds the value, from whole cents."""
    x = F.expr("(c * 128 + 99) div 100")
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("int") - 8


def exp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-2 buckets per (service, type, hour): scale 0, zero values counted apart."""
    per_bucket = (
        events(spark, sf_dir)
        .select(service().alias("svc"), "event_type", time_bucket("ts", "1 hour").alias("at"), cents().alias("c"))
        .withColumn("i", F.when(F.col("c") > 0, log2_index()))
        .groupBy("svc", "event_type", "at", "i").agg(F.count("*").alias("n"), F.sum("c").alias("s"))
    )
    g = per_bucket.groupBy("svc", "event_type", "at").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.lit(100)).alias("s"),
        F.sum(F.when(F.col("i").isNull(), F.col("n")).otherwise(0)).alias("zero"),
        F.min("i").alias("lo"), F.max("i").alias("hi"),
        F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n")))).alias("m"),
    )
    counts = F.when(
        F.col("lo").isNotNull(),
        F.transform(F.sequence("lo", "hi"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))),
    ).otherwise(F.array())
    return _points(
        g, "exp_histogram",
        {"Count": F.col("n"), "Sum": F.col("s"), "ZeroCount": F.col("zero"),
         "PositiveOffset": F.coalesce("lo", F.lit(0)), "PositiveBucketCounts": counts,
         "AggregationTemporality": F.lit(1)},
        empty_map(), F.col("at"), F.col("event_type"),
    )


def cumulative_exp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running histograms per (service, type), one point per hour with events: base 2 (scale 0) in even hours, base 4
    (scale -1) in odd ones."""
    series, zero = ["svc", "event_type"], F.lit(-1000)
    counts = (
        events(spark, sf_dir)
        .select(service().alias("svc"), "event_type", time_bucket("ts", "1 hour").alias("at"), cents().alias("c"))
        .groupBy(*series, "at", F.when(F.col("c") > 0, log2_index()).otherwise(zero).alias("i"))
        .agg(F.count("*").alias("n"))
    )
    points = counts.select(*series, "at").distinct().join(counts.select(*series, "i").distinct(), series)
    upto = Window.partitionBy(*series, "i").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    coarse = F.hour("at") % 2
    g = (
        points.join(counts, [*series, "at", "i"], "left")
        .withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(upto))
        .withColumn("i", F.when(F.col("i") != zero, F.call_function("shiftright", F.col("i"), coarse)))
        .groupBy(*series, "at", "i").agg(F.sum("n").alias("n"))
        .groupBy(*series, "at")
        .agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("n"))), F.lit(0)).alias("zero"),
            F.min("i").alias("lo"), F.max("i").alias("hi"),
            F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n")))).alias("m"),
        )
    )
    filled = F.when(
        F.col("lo").isNotNull(),
        F.transform(F.sequence("lo", "hi"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))),
    ).otherwise(F.array())
    return _points(
        g, "exp_histogram",
        {"Count": F.col("n"), "Scale": -coarse, "ZeroCount": F.col("zero"), "PositiveOffset": F.coalesce("lo", F.lit(0)),
         "PositiveBucketCounts": filled, "AggregationTemporality": F.lit(2)},
        empty_map(), F.col("at"), F.col("event_type"),
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the cents per (service, hour)."""
    qs = {"q50": 0.5, "q90": 0.9, "q99": 0.99}
    keyed = events(spark, sf_dir).select(
        service().alias("svc"), time_bucket("ts", "1 hour").alias("at"), cents().alias("c")
    )
    g = exact_percentiles(keyed, ["svc", "at"], "c", qs)
    pairs = F.array(*[F.struct(F.lit(q).alias("Quantile"), F.round(F.col(n), 3).alias("Value")) for n, q in qs.items()])
    return _points(
        g, "summary", {"Count": F.col("n"), "Sum": F.col("total") / F.lit(100), "ValueAtQuantiles": pairs},
        empty_map(), F.col("at"), F.lit("value"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "gauge": gauge(spark, sf_dir), "sum": counter(spark, sf_dir), "histogram": histogram(spark, sf_dir),
        "exp_histogram": exp_histogram(spark, sf_dir), "summary": summary(spark, sf_dir),
    }


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session records, one per conversation turn; the trace is that of the conversation number."""
    at = F.timestamp_add("HOUR", F.col("conv_id").cast("bigint"), F.expr("timestamp_ntz'2024-01-01'"))
    at = F.timestamp_add("MINUTE", F.col("turn").cast("bigint"), at)
    return log_rows(
        table(spark, sf_dir, "conversations"),
        {
            "Timestamp_ns": unix_nanos(at),
            "TraceId": F.when(F.col("turn") == 0, "").otherwise(hex_id(F.col("conv_id") + 1, 32)),
            "ServiceName": F.lit("web"),
            "Body": F.col("text"),
            "LogAttributes": F.create_map(
                F.lit("sessionId"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")),
                F.lit("role"), F.col("role"),
            ),
        },
    )


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit("pod-"), F.col("n_nationkey").cast("string")).alias("pod_name"),
        F.concat(F.lit("ns-"), F.col("n_regionkey").cast("string")).alias("namespace"),
        F.col("n_nationkey").cast("string").alias("pod_uid"),
        F.col("n_name").alias("container_name"),
        F.concat(F.lit("node-"), (F.col("n_nationkey") % 3).cast("string")).alias("node_name"),
    )


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows derived from line items: one per (line number, ship month)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("t"), F.col("l_linenumber").cast("string"), F.lit("_local")).alias("table"),
            F.trunc("l_shipdate", "month").alias("event_date"),
        )
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("compressed_bytes"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("uncompressed_bytes"),
            F.min("l_shipdate").alias("min_time"), F.max("l_shipdate").alias("max_time"),
        )
        .select(
            "table",
            F.when(F.col("event_date") < F.lit("1998-01-01").cast("date"), "cold").otherwise("hot").alias("tier"),
            "event_date", F.lit("a-0").alias("seg"),
            F.concat_ws("/", "table", F.col("event_date").cast("string")).alias("path"),
            "rows", "compressed_bytes", "uncompressed_bytes", F.col("compressed_bytes").alias("file_bytes"),
            "min_time", "max_time",
        )
    )


# -- raw inputs ---------------------------------------------------------------


def container_request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archived container request per event, with pod attributes on the resource."""
    kv = lambda key, c: F.struct(F.lit(key).alias("key"), F.struct(c.alias("stringValue")).alias("value"))
    rec = F.struct(
        unix_nanos("ts").cast("string").alias("timeUnixNano"), severity().alias("severityText"),
        F.struct(body().alias("stringValue")).alias("body"),
    )
    attrs = F.array(
        kv("k8s.namespace.name", namespace()), kv("k8s.pod.name", pod()),
        kv("k8s.container.name", F.col("event_type")),
    )
    req = F.struct(
        F.array(
            F.struct(
                F.struct(attrs.alias("attributes")).alias("resource"),
                F.array(F.struct(F.array(rec).alias("logRecords"))).alias("scopeLogs"),
            )
        ).alias("resourceLogs")
    )
    return events(spark, sf_dir).select(F.to_json(req).alias("value"))


def container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRI lines: events with an id divisible by 3 are cut into three fragments, the others
    are one full line. Two streams per file are interleaved, blocks cut the files."""
    n = F.when(F.col("event_id") % 3 == 0, 3).otherwise(1)
    frag = events(spark, sf_dir).select("*", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    text = F.when(F.col("n") == 1, body()).otherwise(
        F.when(F.col("i") == 1, F.col("event_type")).when(F.col("i") == 2, F.lit(" by user "))
        .otherwise(F.col("user_id").cast("string"))
    )
    # The stream is that of the user, so fragments of a message stay in one stream.
    stream = F.when(F.col("user_id") % 2 == 0, "stdout").otherwise("stderr")
    line_no = F.col("event_id") * 4 + F.col("i")
    return frag.select(
        F.concat_ws(" ", ts, stream, F.when(F.col("i") == F.col("n"), "F").otherwise("P"), text).alias("value"),
        F.concat(F.lit("file:/var/log/pods/"), namespace(), F.lit("_"), pod(), F.lit("_uid"),
                 F.lit("/app/0.log")).alias("file_path"),
        F.expr("(event_id * 4 + i) div 1001 * 1001").alias("block_start"),
        line_no.alias("line_no"),
    )


OTHER_BOUNDS = [10.0, 50.0, 100.0, 500.0]


def histogram_of_two_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly histograms; services of odd number count on bounds of their own."""
    def counts(bounds: list[float]) -> Column:
        edges = [None, *bounds, None]
        return F.array(*[
            F.count_if((F.lit(True) if lo is None else F.col("value") > lo) & (F.lit(True) if hi is None else F.col("value") <= hi))
            for lo, hi in zip(edges, edges[1:])
        ])

    odd = F.substring("svc", 5, 1).cast("int") % 2 == 1
    g = (
        events(spark, sf_dir).groupBy(service().alias("svc"), "event_type", time_bucket("ts", "1 hour").alias("at"))
        .agg(counts(BOUNDS).alias("one"), counts(OTHER_BOUNDS).alias("other"), F.count("*").alias("n"))
    )
    bounds = lambda xs: F.array(*[F.lit(b) for b in xs])
    return _points(
        g, "histogram",
        {"Count": F.col("n"), "BucketCounts": F.when(odd, F.col("other")).otherwise(F.col("one")),
         "ExplicitBounds": F.when(odd, bounds(OTHER_BOUNDS)).otherwise(bounds(BOUNDS)), "AggregationTemporality": F.lit(1)},
        empty_map(), F.col("at"), F.col("event_type"),
    )


def restarting_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters with a restart at the begin of every third day, told by the start time."""
    days = F.expr("unix_date(CAST(TimeUnix AS DATE)) div 3 * 3").cast("bigint")
    return counter(spark, sf_dir).withColumn("StartTimeUnix_ns", days * F.lit(86_400_000_000_000).cast("bigint"))


def span_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that are chains of up to 1,000 spans: of three events in a row each goes to a chain of its own. The first of
    the chains is whole, the second one's first span names a parent that is not there, the third one's first span
    names the tenth as its parent, which makes a cycle."""
    pos, kind = F.expr("event_id % 3000 div 3"), F.col("event_id") % 3
    first = F.when(kind == 0, "").when(kind == 1, "f" * 16).otherwise(span_id(F.col("event_id") + 27))
    return events(spark, sf_dir).select(
        hex_id(F.expr("event_id div 3000 * 3 + event_id % 3 + 1"), 32).alias("TraceId"), span_id().alias("SpanId"),
        F.when(pos == 0, first).otherwise(span_id(F.col("event_id") - 3)).alias("ParentSpanId"),
    )


def typed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines with a value of every kind; the resource of views has no ``log_type``."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    pair = lambda key, value: F.concat(F.lit(f'{{"key":"{key}","value":{{'), *value, F.lit("}}"))
    n, type_ = F.col("event_id").cast("string"), quoted(F.col("event_type"))
    attributes = F.concat_ws(
        ",",
        pair("n", [F.lit('"intValue":"'), n, F.lit('"')]),
        pair("ok", [F.lit('"boolValue":'), (F.col("event_id") % 2 == 0).cast("string")]),
        pair("x", [F.lit('"doubleValue":'), (F.col("event_id") % 8 / F.lit(8.0)).cast("string")]),
        pair("raw", [F.lit('"bytesValue":"'), F.base64(F.encode("event_type", "UTF-8")), F.lit('"')]),
        pair("list", [F.lit('"arrayValue":{"values":[{"intValue":"'), n, F.lit('"},{"stringValue":'), type_, F.lit("}]}")]),
        pair("pairs", [F.lit('"kvlistValue":{"values":[{"key":"k","value":{"arrayValue":{"values":[{"boolValue":true}]}}}]}')]),
        pair("s", [F.lit('"stringValue":'), type_]),
    )
    own = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit(","), pair("log_type", [F.lit('"stringValue":'), type_])))
    resource = F.concat(pair("service.name", [F.lit('"stringValue":"'), service(), F.lit('"')]), own, F.lit(","), pair("zone", [F.lit('"intValue":"7"')]))
    record = F.concat(
        F.lit('{"timeUnixNano":"'), unix_nanos("ts").cast("string"), F.lit('","spanId":"'), span_id(),
        F.lit('","body":{"intValue":"'), n, F.lit('"},"attributes":['), attributes, F.lit("]}"),
    )
    return events(spark, sf_dir).select(F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":['), resource, F.lit(']},"scopeLogs":[{"scope":{},"logRecords":['), record, F.lit("]}]}]}"),
    ).alias("value"))


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no pipeline can read: of seven events one gives broken JSON, one JSON that is no request."""
    n = F.col("event_id").cast("string")
    broken = F.concat(F.lit('{"broken '), n)
    other = F.concat(F.lit('{"x":'), n, F.lit("}"))
    return events(spark, sf_dir).filter(F.col("event_id") % 7 < 2).select(
        F.when(F.col("event_id") % 7 == 0, broken).otherwise(other).alias("value"), "event_id"
    )


def odd_container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container lines, and before some messages a line of no known format."""
    odd = events(spark, sf_dir).filter(F.col("event_id") % 7 == 0).select(
        F.concat(F.lit("odd line "), F.col("event_id").cast("string")).alias("value"),
        F.concat(F.lit("file:/var/log/pods/"), namespace(), F.lit("_"), pod(), F.lit("_uid"), F.lit("/app/0.log")).alias("file_path"),
        (F.col("event_id") * 4).alias("line_no"),
    )
    return container_lines(spark, sf_dir).select("value", "file_path", "line_no").unionByName(odd)


# A packed file is read by one task, so files have at most so many lines.
PACKED_FILE_LINES = 50_000
# Streams count bytes as they are stored: packed, these are 1 to 2 GiB of lines, no less than a pipeline's own limit.
PACKED_BATCH = {"maxBytesPerTrigger": str(144 << 20)}


def packed_lines(lines: DataFrame, root: str) -> None:
    """Add lines (column ``value``) to a folder of packed text files."""
    with settings(lines.sparkSession, SHUFFLES_GO):
        lines.write.mode("append").options(maxRecordsPerFile=PACKED_FILE_LINES, **PACKED_TEXT).text(root)


def log_files(lines: DataFrame, root: str) -> list[str]:
    """Write lines as files with the names a node gives them, each in line order; returns their paths. Spark writes one file
    per name, which is then given that name."""
    spark = lines.sparkSession
    staged = scratch_dir(spark, "staged")
    with settings(spark, SHUFFLES_GO):
        (
            lines.select("value", F.regexp_extract("file_path", "/var/log/pods/(.*)", 1).alias("name"), "line_no")
            .repartition("name").sortWithinPartitions("name", "line_no").drop("line_no")
            .write.partitionBy("name").text(staged)
        )
    paths = []
    for folder in hadoop.names(spark, staged):
        for part in hadoop.names(spark, f"{staged}/{folder}") if folder.startswith("name=") else []:
            if part.startswith("part-"):
                paths.append(f"{root}/{unquote(folder.removeprefix('name='))}")
                hadoop.rename(spark, f"{staged}/{folder}/{part}", paths[-1])
    return paths


def rotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container lines, each file rotated in the middle of a message: of the middle one of its messages with three
    fragments the first is in the rotated file, the others in the live one."""
    lines = container_lines(spark, sf_dir).withColumn("event", F.expr("line_no div 4"))
    middle = lines.agg((F.max("event") / 2).alias("m")).scalar()
    cut = (
        lines.filter((F.col("event") % 3 == 0) & (F.col("event") >= middle))
        .groupBy("file_path").agg((F.min("event") * 4 + 1).alias("cut"))
    )
    old = F.col("line_no") <= F.col("cut")
    return lines.join(cut, "file_path", "left").select(
        "value", "block_start", "line_no", F.coalesce(old, F.lit(True)).alias("rotated"),
        F.when(F.coalesce(old, F.lit(True)), F.concat("file_path", F.lit(".20240131-000000"))).otherwise(F.col("file_path")).alias("file_path"),
    )


def pod_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pods over time: every pod has been made anew on 2024-01-08 and 2024-01-15, those of an odd number have ended on the 20th."""
    lives = []
    for life, (start, end) in enumerate([("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", None)]):
        ended = F.when(F.col("n") % 2 == 1, F.lit("2024-01-20")) if end is None else F.lit(end)
        lives.append(F.struct(
            F.concat("pod_uid", F.lit(f"-{life}")).alias("pod_uid"),
            F.concat(F.lit("node-"), ((F.col("n") + life) % 3).cast("string")).alias("node_name"),
            unix_nanos(F.lit(start).cast("timestamp_ntz")).alias("valid_from_ns"),
            unix_nanos(ended.cast("timestamp_ntz")).alias("valid_to_ns"),
        ))
    known = pods(spark, sf_dir).withColumn("n", F.col("pod_uid").cast("int"))
    return known.select("pod_name", "namespace", "container_name", F.explode(F.array(*lives)).alias("life")).select(
        "pod_name", "namespace", "container_name", "life.*"
    )


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prio = F.when(F.col("event_type") == "error", "3").when(F.col("event_type") == "purchase", "4").otherwise("6")
    entry = F.struct(
        epoch_micros("ts").cast("string").alias("__REALTIME_TIMESTAMP"),
        body().alias("MESSAGE"), prio.alias("PRIORITY"),
        F.concat(service(), F.lit(".service")).alias("_SYSTEMD_UNIT"), k().alias("_PID"),
    )
    return events(spark, sf_dir).select(F.to_json(entry).alias("value"))


def prom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposition text, one snapshot per hour: a gauge per service and type with the event
    count, a counter with the cents, a histogram and a summary of the values."""
    h = histogram(spark, sf_dir).select(
        "ServiceName", "MetricName", "TimeUnix", "BucketCounts", "Count", F.round(F.col("Sum") * 100).cast("bigint").alias("s")
    )
    label = F.concat(F.lit('svc="'), F.col("ServiceName"), F.lit('",type="'), F.col("MetricName"), F.lit('"'))
    cum = lambda i: F.aggregate(F.slice("BucketCounts", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.col("Count").cast("string")
    s = F.col("s").cast("string")
    line = lambda name, lab, v: F.concat(F.lit(name), F.lit("{"), lab, F.lit("} "), v)
    # The counter has an exemplar without a time, two buckets of the histogram have one with time and another label.
    seen = F.concat(F.lit(' # {trace_id="'), hex_id(F.col("Count"), 32), F.lit('",span_id="'), hex_id(F.col("Count") + 1, 16))
    second = F.concat(unix_seconds("TimeUnix").cast("string"), F.lit(".25"))
    of_bucket = lambda i: F.concat(
        seen, F.lit('",note="a \\"}# b"} '), F.lit(f"{BOUNDS[i]} "), second) if i in (1, 3) else F.lit("")
    lines = [
        line("events_now", label, n),
        F.concat(line("cents_total", label, s), seen, F.lit('"} 1.0')),
        *[
            F.concat(line("value_dist_bucket", F.concat(label, F.lit(f',le="{b}"')), cum(i).cast("string")), of_bucket(i))
            for i, b in enumerate([*[str(x) for x in BOUNDS], "+Inf"])
        ],
        line("value_dist_sum", label, s), line("value_dist_count", label, n),
        line("value_q", F.concat(label, F.lit(',quantile="0.5"')), n),
        line("value_q_sum", label, s), line("value_q_count", label, n),
    ]
    meta = ["# TYPE events_now gauge", "# HELP events_now events seen", "# TYPE cents_total counter",
            "# TYPE value_dist histogram", "# TYPE value_q summary"]
    source = F.date_format("TimeUnix", "yyyyMMddHH").alias("source")
    heads = h.select("TimeUnix").distinct().select(
        F.explode(F.array(*[F.lit(m) for m in meta])).alias("value"), source, F.col("TimeUnix").alias("scraped_at")
    )
    return h.select(F.explode(F.array(*lines)).alias("value"), source, F.col("TimeUnix").alias("scraped_at")).unionByName(heads)


def _wrap(outer: str, mid: str, leaf: str, item: Column, scope: str | None = "ScopeName") -> Column:
    sc = F.struct(F.col(scope).alias("name")) if scope else F.struct(F.lit("").alias("name"))
    return F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.struct(key_values("ResourceAttributes").alias("attributes")).alias("resource"),
                    F.array(F.struct(sc.alias("scope"), F.array(item).alias(leaf))).alias(mid),
                )
            ).alias(outer)
        )
    ).alias("value")


def span_requests(df: DataFrame) -> DataFrame:
    """Spans → request lines, one span each."""
    item = F.struct(
        F.col("TraceId").alias("traceId"), F.col("SpanId").alias("spanId"), F.col("ParentSpanId").alias("parentSpanId"),
        F.col("SpanName").alias("name"), F.when(F.col("SpanKind") == "Server", 2).otherwise(1).alias("kind"),
        F.col("Timestamp_ns").cast("string").alias("startTimeUnixNano"),
        (F.col("Timestamp_ns") + F.col("Duration")).cast("string").alias("endTimeUnixNano"),
        key_values("SpanAttributes").alias("attributes"),
        F.struct(F.when(F.col("StatusCode") == "Error", 2).otherwise(1).alias("code"),
                 F.col("StatusMessage").alias("message")).alias("status"),
        F.transform("Events", lambda e: F.struct(e["Timestamp_ns"].cast("string").alias("timeUnixNano"),
                                                 e["Name"].alias("name"), key_values(e["Attributes"]).alias("attributes"))).alias("events"),
        F.transform("Links", lambda e: F.struct(e["TraceId"].alias("traceId"), e["SpanId"].alias("spanId"))).alias("links"),
    )
    return df.select(_wrap("resourceSpans", "scopeSpans", "spans", item))


def metric_requests(frames: dict[str, DataFrame]) -> DataFrame:
    """Metric points of all kinds → request lines, one point each."""
    txt = lambda c: F.col(c).cast("string")
    head = [
        key_values("Attributes").alias("attributes"), txt("StartTimeUnix_ns").alias("startTimeUnixNano"),
        txt("TimeUnix_ns").alias("timeUnixNano"), F.col("Flags").alias("flags"),
    ]
    ex = F.transform("Exemplars", lambda e: F.struct(
        e["TimeUnix_ns"].cast("string").alias("timeUnixNano"), e["Value"].alias("asDouble"),
        e["SpanId"].alias("spanId"), e["TraceId"].alias("traceId"))).alias("exemplars")
    cnt = [txt("Count").alias("count"), F.col("Sum").alias("sum")]
    strs = lambda c: F.transform(c, lambda x: x.cast("string"))
    span = [F.col("Min").alias("min"), F.col("Max").alias("max")]
    temp = F.col("AggregationTemporality").alias("aggregationTemporality")
    dp = lambda *cols: F.array(F.struct(*head, *cols)).alias("dataPoints")
    data = {
        "gauge": ("gauge", lambda: F.struct(dp(F.col("Value").alias("asDouble"), ex))),
        "sum": ("sum", lambda: F.struct(dp(F.col("Value").alias("asDouble"), ex), temp, F.col("IsMonotonic").alias("isMonotonic"))),
        "histogram": ("histogram", lambda: F.struct(dp(*cnt, strs("BucketCounts").alias("bucketCounts"),
                                                      F.col("ExplicitBounds").alias("explicitBounds"), *span), temp)),
        "exp_histogram": ("exponentialHistogram", lambda: F.struct(dp(
            *cnt, F.col("Scale").alias("scale"), txt("ZeroCount").alias("zeroCount"),
            F.struct(F.col("PositiveOffset").alias("offset"), strs("PositiveBucketCounts").alias("bucketCounts")).alias("positive"),
            F.struct(F.col("NegativeOffset").alias("offset"), strs("NegativeBucketCounts").alias("bucketCounts")).alias("negative"),
            *span), temp)),
        "summary": ("summary", lambda: F.struct(dp(*cnt, F.transform("ValueAtQuantiles", lambda q: F.struct(
            q["Quantile"].alias("quantile"), q["Value"].alias("value"))).alias("quantileValues")))),
    }
    out = None
    for kind, df in frames.items():
        field, make = data[kind]
        item = F.struct(F.col("MetricName").alias("name"), make().alias(field))
        lines = df.select(_wrap("resourceMetrics", "scopeMetrics", "metrics", item))
        out = lines if out is None else out.unionByName(lines)
    return out
