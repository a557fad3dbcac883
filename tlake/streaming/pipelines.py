"""The named pipelines, one streaming query each.

======================  ===================================================  =======================
pipeline                steps                                                 sinks
======================  ===================================================  =======================
``logs/records``        the next two in one stream                            table, archive, sessions
``logs``                fix_time, drop sessions, log_type=otel                table, archive ``otel``
``logs/sessions``       fix_time, keep sessions                               session table
``logs/container``      parse, pod metadata, log_type=container               archive ``k8s``
``logs/journal``        pod metadata, log_type=journal (resource and record)  archive ``journal``
``traces``              flatten                                               span table, trace ranges
``metrics``             flatten, route by kind                                five metric tables
======================  ===================================================  =======================

The input folder is the queue: writers add files, the checkpoint remembers which
were read. Batch size is set by files or bytes per trigger (``maxFilesPerTrigger``,
``maxBytesPerTrigger``), the tasks that write a batch by ``writers``; raise both together
for a larger input. Files of at most so many rows are set with ``Lake(rows_per_file=…)``.
``pack`` writes the archive's files packed, as ``.json.gz``: a tenth of the size and less, but each is read by one task.
Each pipeline leaves counters and rejected lines below its checkpoint root; ``watch`` adds what is still to be read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tlake import schemas
from tlake.operators.flatten import flatten_otlp_metrics, metric_points, otlp_to_logs, otlp_to_spans
from tlake.operators.transforms import (
    FRAGMENTS,
    container_lines,
    container_rows,
    enrich_k8s,
    fix_time,
    merge_fragments,
    set_log_type,
    split_sessions,
    unknown_format,
    upsert_attr,
)
from tlake.plans import hadoop
from tlake.plans.lake import Lake
from tlake.session import prepare
from tlake.sources.files import is_sample, journal_since, parse_journal, parse_prom_text, read_journal_lines
from tlake.sources.otlp import read_request_lines
from tlake.sources.tail import tail_container_logs
from tlake.plans import hadoop
from tlake.streaming.archive import as_read
from tlake.streaming.sinks import (
    TRIGGER,
    Rejects,
    Sink,
    archive_sink,
    counted,
    fan_out,
    observed,
    only,
    segment,
    span_sink,
    table_sink,
)

# Bounds one micro-batch; Spark file sources count bytes and files, not rows.
BATCH_BYTES = str(1 << 30)


def _bounded(options: dict) -> dict:
    """One of the two limits; Spark takes files or bytes, not both."""
    return options if "maxFilesPerTrigger" in options else {"maxBytesPerTrigger": BATCH_BYTES, **options}


def counters(checkpoint: str) -> str:
    """Folder of the batch counters of the pipelines under one checkpoint root."""
    return f"{checkpoint}/counters"


class Fragments:
    """Unfinished messages of a pipeline: a small table per batch, written last. Batch n reads the table of n - 1, so a
    repeated batch finds what its first attempt found."""

    def __init__(self, root: str, patience: int) -> None:
        self.root, self.patience = root, patience

    def path(self, batch_id: int) -> str:
        return f"{self.root}/{batch_id:012d}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return spark.read.schema(FRAGMENTS).parquet(self.path(batch_id - 1)) if batch_id else None

    def finished(self, messages: DataFrame) -> DataFrame:
        return messages.filter(F.col("closed") | (F.col("carried") >= self.patience))

    def sink(self, messages: DataFrame, batch: str) -> None:
        spark, batch_id = messages.sparkSession, int(batch[-12:])
        still_open = messages.filter(~F.col("closed") & (F.col("carried") < self.patience))
        columns = ("source", "stream", "file_path", "parts", "carried")
        # The batch is filtered where it lies; only what is left is moved, into as few files as its size allows.
        still_open.select(*columns).hint("rebalance").write.mode("overwrite").parquet(self.path(batch_id))
        if batch_id >= 2:  # the batch that read it is done
            hadoop.delete(spark, self.path(batch_id - 2))


def rejected(checkpoint: str) -> str:
    """Folder of the lines that the pipelines under one checkpoint root have turned away."""
    return f"{checkpoint}/rejected"


def _no_request(checkpoint: str, field: str) -> Rejects:
    """Lines that are no request with the field."""
    reason = F.when(F.try_parse_json("value").isNull(), "no JSON").otherwise(f"no request: {field} is missing or no list")
    return Rejects(rejected(checkpoint), F.col(f"req.{field}").isNull(), reason)


def records(
    spark: SparkSession, src: str, lake: Lake, archive: str, checkpoint: str,
    trigger: str | None = TRIGGER, now: datetime | str | Column | None = None,
    overwrite_type: bool = True, writers: int | None = None, archive_type: str | None = "otel", watch: bool = False,
    pack: bool = False, **options: str,
) -> StreamingQuery:
    """``logs`` and ``logs/sessions`` in one stream: the input is read and parsed once for all three sinks. The archive keeps
    the kinds of values; ``archive_type=None`` takes its prefix from the resource's ``log_type``."""
    requests = read_request_lines(spark, src, schemas.OTLP_LOGS_TYPED, **_bounded(options))
    plain = lambda df: set_log_type(split_sessions(df)[0], "otel", overwrite_type)
    name = "logs/records"
    sinks = [
        only(plain, counted(table_sink(lake, "otel_logs", name, writers))),
        only(lambda df: plain(as_read(df)), archive_sink(archive, archive_type, name, pack)),
        only(lambda df: split_sessions(df)[1], counted(table_sink(lake, "sessions", name, writers))),
    ]
    return fan_out(
        requests, sinks, f"{checkpoint}/{name}", name, trigger, lambda df, _: fix_time(otlp_to_logs(df.select("req.*")), now),
        counters(checkpoint), _no_request(checkpoint, "resourceLogs"), src if watch else None,
    )


def logs(
    spark: SparkSession, src: str, lake: Lake, archive: str, checkpoint: str,
    trigger: str | None = TRIGGER, now: datetime | str | Column | None = None,
    overwrite_type: bool = True, writers: int | None = None, archive_type: str | None = "otel", watch: bool = False,
    pack: bool = False, **options: str,
) -> StreamingQuery:
    requests = read_request_lines(spark, src, schemas.OTLP_LOGS_TYPED, **_bounded(options))
    name = "logs"
    plain = lambda df: set_log_type(df, "otel", overwrite_type)
    sinks = [
        only(plain, counted(table_sink(lake, "otel_logs", name, writers))),
        only(lambda df: plain(as_read(df)), archive_sink(archive, archive_type, name, pack)),
    ]

    def ordinary(batch: DataFrame, _: int) -> DataFrame:
        return split_sessions(fix_time(otlp_to_logs(batch.select("req.*")), now))[0]

    return fan_out(
        requests, sinks, f"{checkpoint}/{name}", name, trigger, ordinary, counters(checkpoint),
        _no_request(checkpoint, "resourceLogs"), src if watch else None,
    )


def sessions(
    spark: SparkSession, src: str, lake: Lake, checkpoint: str,
    trigger: str | None = TRIGGER, now: datetime | str | Column | None = None,
    writers: int | None = None, **options: str,
) -> StreamingQuery:
    requests = read_request_lines(spark, src, schemas.OTLP_LOGS, **_bounded(options))
    name = "logs/sessions"
    sinks = [counted(table_sink(lake, "sessions", name, writers))]
    only_sessions = lambda df, _: split_sessions(fix_time(otlp_to_logs(df.select("req.*")), now))[1]
    return fan_out(
        requests, sinks, f"{checkpoint}/{name}", name, trigger, only_sessions, counters(checkpoint), _no_request(checkpoint, "resourceLogs")
    )


def container(
    spark: SparkSession, glob: str, pods: DataFrame, archive: str, checkpoint: str,
    trigger: str | None = TRIGGER, follow: bool = False, patience: int = 100, pack: bool = False, **options: str,
) -> StreamingQuery:
    """Container log files from the beginning: a new checkpoint reads every file.

    ``follow`` reads files while they grow, by byte positions; ``glob`` then finds the live files. Otherwise a file is read
    once, and ``glob`` is to find closed files, such as ``/var/log/pods/*/*/*.log.*``.

    A message that is not finished in a batch, because its file is not or because a rotation has cut it, is kept below the
    checkpoint, in a version per batch, and continued by the next batch; a repeated batch starts from the version before
    its own again. After ``patience`` batches it is passed on as it is, so what is kept stays small.
    """
    prepare(spark)
    name = "logs/container"
    kept = Fragments(f"{checkpoint}/{name}-fragments", patience)
    if follow:
        lines = tail_container_logs(spark, glob)
    else:
        lines = spark.readStream.options(**_bounded(options)).text(glob).select(
            "value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block_start"),
        )

    def merge(batch: DataFrame, batch_id: int) -> DataFrame:
        numbered = batch if follow else batch.withColumn("line_no", F.monotonically_increasing_id())
        return merge_fragments(container_lines(numbered), kept.before(batch.sparkSession, batch_id))

    def rows(messages: DataFrame) -> DataFrame:
        return set_log_type(enrich_k8s(container_rows(kept.finished(messages)), pods), "container")

    sinks = [only(rows, counted(archive_sink(archive, "k8s", name, pack))), kept.sink]
    odd = Rejects(rejected(checkpoint), unknown_format(), F.lit("unknown format"), source_file="file_path", passed=True)
    return fan_out(lines, sinks, f"{checkpoint}/{name}", name, trigger, merge, counters(checkpoint), odd)


def journal(
    spark: SparkSession, src: str, pods: DataFrame, archive: str, checkpoint: str,
    since: datetime | str | None = None, trigger: str | None = TRIGGER, archive_type: str | None = "journal",
    pack: bool = False, **options: str,
) -> StreamingQuery:
    """Journal exports; ``since`` set to the start time reads "from the end". The resource's ``log_type`` is ``journal`` too."""
    lines = read_journal_lines(spark, src, since, streaming=True, **_bounded(options))
    name = "logs/journal"

    def entries(batch: DataFrame, _: int) -> DataFrame:
        rows = enrich_k8s(journal_since(parse_journal(batch), since), pods)
        return set_log_type(upsert_attr(rows, "ResourceAttributes", "log_type", "journal"), "journal")

    no_entry = (F.trim("value") != "") & F.from_json("value", "map<string,string>").isNull()
    odd = Rejects(rejected(checkpoint), no_entry, F.lit("no JSON object"))
    sinks = [counted(archive_sink(archive, archive_type, name, pack))]
    return fan_out(lines, sinks, f"{checkpoint}/{name}", name, trigger, entries, counters(checkpoint), odd)


def traces(
    spark: SparkSession, src: str, lake: Lake, checkpoint: str, trigger: str | None = TRIGGER,
    writers: int | None = None, **options: str,
) -> StreamingQuery:
    requests = read_request_lines(spark, src, schemas.OTLP_TRACES, **_bounded(options))
    # Spans and their trace ranges are two writes of one batch.
    return fan_out(
        requests, [counted(span_sink(lake, "traces", writers), "SpanName")], f"{checkpoint}/traces", "traces", trigger,
        lambda df, _: otlp_to_spans(df.select("req.*")), counters(checkpoint), _no_request(checkpoint, "resourceSpans"),
    )


def _points_sink(lake: Lake, name: str, writers: int | None, points: Callable[[DataFrame], dict[str, DataFrame]]) -> Sink:
    """Points by kind into their tables, from one parse of the batch."""

    def write(batch: DataFrame, written: str) -> dict:
        parsed = batch.persist()  # five projections of one parse, the outer levels unnested
        seen = {kind: Observation() for kind in schemas.METRIC_KINDS}
        numbers = (F.count("*").alias("rows"), F.sum(F.octet_length("MetricName")).alias("bytes"))
        try:
            frames = {kind: df.observe(seen[kind], *numbers) for kind, df in points(parsed).items()}
            lake.write_metrics(frames, segment(name, written), writers)
        finally:
            parsed.unpersist()
        told = [observed(seen[kind], "rows", "bytes") for kind in frames]
        return {n: sum(t[n] for t in told) for n in ("rows", "bytes")}

    return write


def metrics(
    spark: SparkSession, src: str, lake: Lake, checkpoint: str, trigger: str | None = TRIGGER,
    writers: int | None = None, **options: str,
) -> StreamingQuery:
    requests = read_request_lines(spark, src, schemas.OTLP_METRICS, **_bounded(options))
    sink = _points_sink(lake, "metrics", writers, metric_points)
    return fan_out(
        requests, [sink], f"{checkpoint}/metrics", "metrics", trigger, lambda df, _: flatten_otlp_metrics(df.select("req.*")),
        counters(checkpoint), _no_request(checkpoint, "resourceMetrics"),
    )


def scraped_metrics(
    spark: SparkSession, src: str, lake: Lake, checkpoint: str, job: str = "",
    trigger: str | None = "10 seconds", writers: int | None = None, **options: str,
) -> StreamingQuery:
    """The scraped input of the metrics pipeline: text snapshots, one scrape per file."""
    prepare(spark)
    lines = spark.readStream.options(recursiveFileLookup="true", **_bounded(options)).text(src).select(
        "value", F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("scraped_at"),
    )

    odd = Rejects(rejected(checkpoint), ~is_sample(), F.lit("no sample"), source_file="source")
    sink = _points_sink(lake, "metrics-scraped", writers, lambda df: parse_prom_text(df, job))
    return fan_out(
        lines, [sink], f"{checkpoint}/metrics-scraped", "metrics-scraped", trigger, None, counters(checkpoint), odd
    )
