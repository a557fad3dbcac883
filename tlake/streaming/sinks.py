"""Sinks for micro-batches. Each is idempotent per streaming query and batch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tlake.functions.scalar import bucket_micros
from tlake.plans import hadoop
from tlake.plans.lake import Lake
from tlake.plans.reports import backlog
from tlake.session import SHUFFLES_GO
from tlake.streaming.archive import PACKED_TEXT, write_archive_by_type, write_otlp_archive

#: A sink writes a batch under the name it is given; it may return ``{"rows": n, "bytes": n}`` of what it wrote.
Sink = Callable[[DataFrame, str], object]

# Fixed value: trigger interval.
TRIGGER = "5 seconds"


def segment(name: str, batch: str) -> str:
    """``batch`` names the streaming query and its batch, so a new checkpoint never writes over stored rows."""
    return f"a-{name.replace('/', '-')}-{batch}"


def table_sink(lake: Lake, table: str, name: str, tasks: int | None = None) -> Sink:
    return lambda df, batch: lake.write(df, table, segment(name, batch), tasks)


def span_sink(lake: Lake, name: str, tasks: int | None = None) -> Sink:
    return lambda df, batch: lake.write_spans(df, segment(name, batch), tasks)


def only(rows: Callable[[DataFrame], DataFrame], sink: Sink) -> Sink:
    """The sink gets a part of the batch."""
    return lambda df, batch: sink(rows(df), batch)


def observed(seen: Observation, *names: str) -> dict[str, int]:
    """Observed numbers of a query that has ended. Where Spark found the observed rows to be none before it ran their part of
    the plan, it has dropped the observation with that part, and all numbers are 0."""
    try:
        found = seen.get
    except Py4JJavaError:
        found = {}
    return {n: found.get(n) or 0 for n in names}


def counted(sink: Sink, column: str = "Body") -> Sink:
    """The sink, and how many rows and bytes of a column it was given, counted while it writes."""

    def run(df: DataFrame, batch: str) -> dict:
        seen = Observation()
        sink(df.observe(seen, F.count("*").alias("rows"), F.sum(F.octet_length(column)).alias("bytes")), batch)
        return observed(seen, "rows", "bytes")

    return run


def archive_sink(root: str, archive_type: str | None, name: str, pack: bool = False) -> Sink:
    """Without ``archive_type`` each record goes below the ``log_type`` of its resource. ``pack`` writes ``.json.gz``."""
    options = PACKED_TEXT if pack else {}
    if archive_type is None:
        return lambda df, batch: write_archive_by_type(df, root, segment(name, batch), **options)
    return lambda df, batch: write_otlp_archive(df, root, archive_type, segment(name, batch), **options)


@dataclass
class Rejects:
    """Which input rows a pipeline turns away, as conditions on the batch frame.

    ``line`` and ``source_file`` are the input line and its file, ``reason`` says why, ``folder`` holds the table of rejected
    lines of all pipelines. ``passed`` says that the lines went on all the same, as messages of unknown format do.
    """

    folder: str
    condition: Column
    reason: Column
    line: str = "value"
    source_file: str = "source_file"
    passed: bool = False

    def write(self, batch: DataFrame, name: str, query: str, batch_id: int, written: str) -> None:
        """A part per pipeline and batch, in place of what an earlier attempt of the batch has left."""
        rows = batch.filter(self.condition).select(
            F.lit(name).alias("pipeline"), F.col(self.source_file).alias("source_file"), F.col(self.line).alias("line"),
            self.reason.alias("reason"), F.lit(self.passed).alias("passed"), F.lit(query).alias("query"),
            F.lit(batch_id).cast("bigint").alias("batch"),
        )
        rows.write.mode("overwrite").parquet(f"{self.folder}/{segment(name, written)}")


REJECTED = "pipeline STRING, source_file STRING, line STRING, reason STRING, passed BOOLEAN, query STRING, batch BIGINT"


def rejected_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that pipelines have turned away, with source file, reason, query and batch."""
    if not hadoop.names(spark, folder):
        return spark.createDataFrame([], REJECTED)
    return spark.read.schema(REJECTED).option("recursiveFileLookup", "true").parquet(folder)


def fan_out(
    stream: DataFrame,
    sinks: list[Sink],
    checkpoint: str,
    name: str,
    trigger: str | None = TRIGGER,
    prepare_batch: Callable[[DataFrame, int], DataFrame] | None = None,
    counters: str | None = None,
    rejects: Rejects | None = None,
    watch: str | None = None,
) -> StreamingQuery:
    """One pipeline into several sinks; the batch is read and transformed once.

    ``trigger=None`` works through what is there and stops. The checkpoint is the
    position in the source; a batch that is repeated after a failure replaces its
    own segments, which carry the query's id from the checkpoint. ``prepare_batch`` holds steps that need a batch frame
    and its number.

    With ``counters`` each batch leaves a file in that folder once all sinks are done: rows and bytes that the sinks say
    they wrote, input rows that were rejected, and whether the batch took longer than the trigger interval. A repeated
    batch replaces its file, so sums over the folder are right after failures and for any number of batches. Rejected
    rows are counted while the first sink reads the batch; only a batch that has some is read once more, to keep them.
    ``watch`` names the input folder; the counters then also say how many files and bytes no batch has taken yet.
    """
    seconds = bucket_micros(trigger) / 1e6 if trigger else None

    ids: list[str] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        if not ids:  # the query's id lives as long as its checkpoint, over restarts
            ids.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        written = f"{ids[0]}-{batch_id:012d}"
        # Streaming sessions come with adaptive execution off; the writes here are batch jobs.
        for k, v in {"spark.sql.adaptive.enabled": "true", **SHUFFLES_GO}.items():
            batch.sparkSession.conf.set(k, v)
        began, read, given = time.monotonic(), Observation(), batch
        if counters:
            refused = F.count_if(rejects.condition) if rejects else F.count_if(F.lit(False))
            batch = batch.observe(read, refused.alias("rejected"))
        rows = prepare_batch(batch, batch_id) if prepare_batch else batch
        shared = len(sinks) > 1
        if shared:
            rows = rows.persist()
        try:
            told = [t for t in (sink(rows, written) for sink in sinks) if isinstance(t, dict)]
        finally:
            if shared:
                rows.unpersist()
        if counters:
            late = seconds is not None and time.monotonic() - began > seconds
            n_rejected = observed(read, "rejected")["rejected"]
            if rejects and n_rejected:
                rejects.write(given, name, ids[0], batch_id, written)
            seen = {
                "query": ids[0], "pipeline": name, "batch": batch_id, "InsertQuery": 1, "InsertedRows": sum(t["rows"] for t in told),
                "InsertedBytes": sum(t["bytes"] for t in told), "RejectedInserts": n_rejected, "DelayedInserts": int(late),
            }
            if watch:
                left = backlog(batch.sparkSession, watch, checkpoint).first()
                seen |= {"OutstandingFiles": left["files"], "OutstandingBytes": left["bytes"]}
            hadoop.put_text(batch.sparkSession, f"{counters}/{written}.json", json.dumps(seen))

    writer = (
        stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(run)
    )
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()
