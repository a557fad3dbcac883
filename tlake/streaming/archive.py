"""Log rows back to OTLP-JSON requests, one per line."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tlake.functions import map_text, same_or_text
from tlake.session import settings

ROWS_PER_REQUEST = 1000

# Writer options of packed text, at a level that costs little time. Readers go by the name of the file.
PACKED_TEXT = {"compression": "gzip", "zlib.compress.level": "THREE"}


def key_values(m: str | Column) -> Column:
    """MAP → list of key/value structs."""
    return F.transform(
        F.map_entries(m),
        lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")),
    )


def typed_key_values(values: str, m: str, came: str | None = None) -> Column:
    """MAP → list of key/value structs with VARIANT values: as they came, where the map still says the same. ``came`` names
    the map of texts that they came with."""
    text = lambda e: F.try_element_at(F.col(came), e["key"]) if came else None
    value = lambda e: same_or_text(F.try_element_at(F.col(values), e["key"]), e["value"], text(e))
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), value(e).alias("value")))


def as_read(df: DataFrame) -> DataFrame:
    """Rows as ``otlp_to_logs`` gives them, which remember the texts of their typed values (column ``TextsRead``) for
    ``packed``: it then sees by them which values later steps have changed, and need not read every value again."""
    texts = F.struct("ResourceAttributes", "LogAttributes", "Body")
    return df.withColumn("TextsRead", texts) if "LogValues" in df.columns else df


def _record(typed: bool, came: bool) -> Column:
    body = same_or_text(F.col("BodyValue"), F.col("Body"), F.col("TextsRead.Body") if came else None) if typed else None
    attributes = typed_key_values("LogValues", "LogAttributes", "TextsRead.LogAttributes" if came else None) if typed else None
    return F.struct(
        F.col("Timestamp_ns").cast("string").alias("timeUnixNano"),
        F.col("ObservedTimestamp_ns").cast("string").alias("observedTimeUnixNano"),
        F.col("SeverityText").alias("severityText"),
        F.col("SeverityNumber").alias("severityNumber"),
        (body if typed else F.struct(F.col("Body").alias("stringValue"))).alias("body"),
        F.col("TraceId").alias("traceId"),
        F.col("SpanId").alias("spanId"),
        F.col("TraceFlags").alias("flags"),
        F.col("EventName").alias("eventName"),
        (attributes if typed else key_values("LogAttributes")).alias("attributes"),
    )


def packed(df: DataFrame, rows_per_request: int = ROWS_PER_REQUEST, *also: Column) -> DataFrame:
    """Log rows → requests (column ``resourceLogs``), and columns that all records of a request have in common.

    Records of one resource and scope are put into one request per block of neighbouring rows, so no request grows with
    the number of records a service has. The lists are made before the shuffle, in the task that reads the block.
    Rows read with typed values keep the kind of every value; others have text.
    """
    if "ObservedTimestamp_ns" not in df.columns:
        df = df.withColumn("ObservedTimestamp_ns", F.col("Timestamp_ns"))
    typed, came = "LogValues" in df.columns, "TextsRead" in df.columns
    if typed:
        attributes = typed_key_values("ResourceValues", "ResourceAttributes", "TextsRead.ResourceAttributes" if came else None)
    else:
        attributes = key_values("ResourceAttributes")
    rows = df.select(
        *also,
        F.spark_partition_id().alias("task"),
        # The lower 33 bits count the rows of a task.
        F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) div {int(rows_per_request)}").alias("block"),
        F.struct(attributes.alias("attributes")).alias("resource"),
        F.col("ResourceSchemaUrl").alias("res_url"),
        F.struct(
            F.col("ScopeName").alias("name"), F.col("ScopeVersion").alias("version"),
            key_values("ScopeAttributes").alias("attributes"),
        ).alias("scope"),
        F.col("ScopeSchemaUrl").alias("scope_url"),
        _record(typed, came).alias("record"),
    )
    also_names = rows.columns[: len(also)]
    records, of_scope = F.collect_list("record").alias("logRecords"), ("res_url", "scope", "scope_url")
    if typed:  # VARIANTs cannot be grouped by, their text can
        lists = (
            rows.withColumn("key", F.to_json("resource")).groupBy(*also_names, "task", "block", "key", *of_scope)
            .agg(F.first("resource").alias("resource"), records)
        )
    else:
        lists = rows.groupBy(*also_names, "task", "block", "resource", *of_scope).agg(records)
    scopes = F.array(F.struct("scope", F.col("scope_url").alias("schemaUrl"), "logRecords"))
    return lists.select(
        *also_names, F.array(F.struct("resource", F.col("res_url").alias("schemaUrl"), scopes.alias("scopeLogs"))).alias("resourceLogs")
    )


def otlp_requests(df: DataFrame, rows_per_request: int = ROWS_PER_REQUEST) -> DataFrame:
    """Log rows → request lines (column ``value``)."""
    return packed(df, rows_per_request).select(F.to_json(F.struct("resourceLogs")).alias("value"))


def write_otlp_archive(
    df: DataFrame, root: str, archive_type: str = "unknown", segment: str | None = None, **options: str
) -> str:
    """Archive log rows below ``<root>/<archive_type>/<segment>``; a repeated write of a
    segment replaces the first attempt. ``options`` are the writer's, such as ``PACKED_TEXT``."""
    path = f"{root.rstrip('/')}/{archive_type or 'unknown'}/{segment or uuid.uuid4().hex}"
    packed(df).write.mode("overwrite").options(**options).json(path)
    return path


def write_archive_by_type(df: DataFrame, root: str, segment: str | None = None, **options: str) -> str:
    """Archive log rows below ``<root>/log_type=<type>/seg=<segment>``, where the type is the attribute ``log_type`` of each
    record's resource, ``unknown`` where that is absent or empty. Types come from the data; a repeated write of a segment
    replaces the first attempt, type by type. Read one type with ``read_otlp_logs(spark, f"{root}/log_type=<type>", typed=True)``.
    """
    segment = segment or uuid.uuid4().hex
    kind = F.coalesce(F.nullif(map_text("ResourceAttributes", "log_type"), F.lit("")), F.lit("unknown"))
    requests = packed(df, ROWS_PER_REQUEST, kind.alias("log_type")).withColumn("seg", F.lit(segment))
    with settings(df.sparkSession, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        requests.write.mode("overwrite").options(**options).partitionBy("log_type", "seg").json(root)
    return segment
