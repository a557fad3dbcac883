"""Jobs for spark-submit: ``jobs.py create|ingest|move|compact|vacuum|report --hot URI --cold URI …``

Roots are Hadoop URIs (``s3a://``, ``abfss://``, ``hdfs://``, local paths).
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tlake import schemas
from tlake.plans import Lake, apply_moves, compact, compact_due, reports, vacuum
from tlake.plans.inventory import inventories
from tlake.streaming import pipelines


def _args(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["create", "ingest", "move", "compact", "vacuum", "report"])
    p.add_argument("--hot", required=True)
    p.add_argument("--cold", required=True)
    p.add_argument("--table", action="append", help="default: all tables")
    p.add_argument("--day", help="compact: the day to merge; default: all days in many segments")
    p.add_argument("--min-segments", type=int, default=8, help="compact without a day: segments from which a day is merged")
    p.add_argument("--as-of", help="move: evaluate the rules at this time (UTC), default now")
    p.add_argument("--hot-capacity", type=int, help="move: bytes of hot storage, for the free-space rule")
    p.add_argument("--archive", help="ingest: root of the request archive")
    p.add_argument("--checkpoint", help="ingest: root of the checkpoints")
    p.add_argument("--pods", help="ingest: parquet folder of the pod table")
    for name in ("logs", "traces", "metrics", "container", "journal", "scraped"):
        p.add_argument(f"--{name}", help="ingest: input folder of this pipeline")
    p.add_argument("--writers", type=int, help="ingest: tasks that write a batch")
    p.add_argument("--batch-bytes", help="ingest: input bytes per batch")
    p.add_argument("--once", action="store_true", help="ingest: work through what is there, then stop")
    a = p.parse_args(argv)
    if a.job == "ingest" and not a.checkpoint:
        p.error("ingest needs --checkpoint, a folder that all executors share")
    if a.job == "ingest" and not a.archive and (a.logs or a.container or a.journal):
        p.error("logs, container and journal need --archive")
    return a


def ingest(spark: SparkSession, lake: Lake, a: argparse.Namespace) -> None:
    """Start a streaming query per given input and wait."""
    how = {"trigger": None} if a.once else {}
    bytes_ = {"maxBytesPerTrigger": a.batch_bytes} if a.batch_bytes else {}
    size = {**({"writers": a.writers} if a.writers else {}), **bytes_}
    queries = []
    if a.logs:
        queries.append(pipelines.records(spark, a.logs, lake, a.archive, a.checkpoint, **how, **size))
    if a.traces:
        queries.append(pipelines.traces(spark, a.traces, lake, a.checkpoint, **how, **size))
    if a.metrics:
        queries.append(pipelines.metrics(spark, a.metrics, lake, a.checkpoint, **how, **size))
    if a.scraped:
        queries.append(pipelines.scraped_metrics(spark, a.scraped, lake, a.checkpoint, **how, **size))
    if a.container or a.journal:
        pods = spark.read.schema(schemas.PODS).parquet(a.pods) if a.pods else spark.createDataFrame([], schemas.PODS)
        if a.container:
            queries.append(pipelines.container(spark, a.container, pods, a.archive, a.checkpoint, **how, **bytes_))
        if a.journal:
            since = None if a.once else datetime.now(timezone.utc).replace(tzinfo=None)
            queries.append(pipelines.journal(spark, a.journal, pods, a.archive, a.checkpoint, since, **how, **bytes_))
    for q in queries:
        q.awaitTermination()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _args(argv)
    spark = spark or SparkSession.builder.appName(f"tlake-{a.job}").getOrCreate()
    lake = Lake(spark, a.hot, a.cold).create_tables()
    tables = a.table or lake.tables
    if a.job == "ingest":
        ingest(spark, lake, a)
    elif a.job == "move":
        at = a.as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        print(apply_moves(lake, tables, at, hot_capacity_bytes=a.hot_capacity))
    elif a.job == "compact":
        for t in tables:
            print(t, compact(lake, t, a.day) if a.day else compact_due(lake, t, a.min_segments))
    elif a.job == "vacuum":
        for t in tables:
            print(t, vacuum(lake, t))
    elif a.job == "report":
        inv = inventories(lake, tables).persist()
        for report in (reports.compression_report, reports.ingest_report, reports.tier_report, reports.cold_count):
            report(inv).show(len(tables) * 2, truncate=False)


if __name__ == "__main__":
    main()
