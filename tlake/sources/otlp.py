"""OTLP-JSON request files: one export request per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tlake import schemas
from tlake.functions import computed_once
from tlake.operators.flatten import otlp_to_metrics, otlp_to_spans
from tlake.session import prepare


def _requests(spark, path, schema, streaming, options) -> DataFrame:
    prepare(spark)
    reader = spark.readStream if streaming else spark.read
    # A declared schema: inference would cost a pass and drop unseen fields.
    return (
        reader.schema(schema)
        .option("recursiveFileLookup", "true")
        .options(**options)
        .json(path)
    )


def read_otlp_logs(
    spark: SparkSession, path: str, streaming: bool = False, typed: bool = False, **options: str
) -> DataFrame:
    """Log requests, still nested (see ``operators.flatten``). ``typed`` reads values as VARIANT, which keeps their kinds."""
    return _requests(spark, path, schemas.OTLP_LOGS_TYPED if typed else schemas.OTLP_LOGS, streaming, options)


def read_otlp_traces(
    spark: SparkSession, path: str, streaming: bool = False, **options: str
) -> DataFrame:
    """Spans in table layout."""
    return otlp_to_spans(_requests(spark, path, schemas.OTLP_TRACES, streaming, options))


def read_otlp_metrics(
    spark: SparkSession, path: str, streaming: bool = False, **options: str
) -> dict[str, DataFrame]:
    """Metric points in table layout, one frame per kind. Each frame parses the input; to
    write all of them, persist the requests as ``pipelines.metrics`` does."""
    return otlp_to_metrics(_requests(spark, path, schemas.OTLP_METRICS, streaming, options))


def read_raw_lines(
    spark: SparkSession, path: str, streaming: bool = False, **options: str
) -> DataFrame:
    """Whole lines in column ``value``, for path-based extraction."""
    prepare(spark)
    reader = spark.readStream if streaming else spark.read
    return reader.option("recursiveFileLookup", "true").options(**options).text(path)


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Requests from a text column (a queue payload, for example)."""
    prepare(lines.sparkSession)
    return lines.select(F.from_json(column, schema).alias("_r")).select("_r.*")


def read_request_lines(spark: SparkSession, path: str, schema: str, streaming: bool = True, **options: str) -> DataFrame:
    """Request lines with their file: ``value``, ``source_file`` and the parsed request ``req``. Blank lines are left out; in
    a line that is no request the fields of ``req`` are NULL."""
    prepare(spark)
    reader = spark.readStream if streaming else spark.read
    lines = reader.option("recursiveFileLookup", "true").options(**options).text(path)
    given = lines.filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("source_file"))
    return computed_once(given, F.from_json("value", schema), "req")
