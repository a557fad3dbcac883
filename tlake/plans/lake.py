"""Tables on two storage roots, seen as one.

Layout: ``<root>/<table>/seg=<segment>/event_date=<day>/*.parquet``. Every write
makes a segment of its own. Appended segments (``a-…``) count once their write has
left its ``_SUCCESS`` file; segments made by a move or a compaction (``m-…``) count once the manifest
lists them, and the same manifest version takes the segments they replace out of
sight. So a reader sees each row once, before, during and after a rewrite.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tlake import schemas
from tlake.functions import attr_pairs, literal_time, map_text, unix_nanos
from tlake.functions.scalar import trunc_second
from tlake.plans import hadoop
from tlake.plans.reports import plain_bytes
from tlake.operators.aggregates import trace_time_ranges
from tlake.operators.metrics import union_metrics
from tlake.operators.traces import trace_days
from tlake.session import prepare, settings, stored

TIERS = ("hot", "cold")

# Dictionary, delta and ZSTD level 1 come with these writer settings.
WRITER_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
}


# Trace ids are looked up one by one: a filter per row group says whether it may hold one.
HAS_ID_FILTERS = ("otel_traces", schemas.TRACE_RANGES)


def value_filters(table: str) -> dict[str, str]:
    """Writer options: Bloom filters of trace ids and of promoted attributes."""
    columns = [*(["TraceId"] if table in HAS_ID_FILTERS else []), *schemas.PROMOTED.get(table, ())]
    enabled = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    return {**enabled, "parquet.bloom.filter.adaptive.enabled": "true"} if columns else {}


def with_attributes(df: DataFrame, table: str, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """Rows whose attributes (map column, key, value) have all the values; a missing key reads as ''.

    Promoted keys are asked for by their columns. Files written without these have NULL there; their rows are an arm of its
    own, which skips all other files by their null counts. One condition for both arms would be a disjunction, and no
    Bloom filter can answer that.
    """
    columns = [schemas.promoted_column(table, m, key) for m, key, _ in wanted]
    in_map = [map_text(m, key) == value for m, key, value in wanted]
    own = [F.col(c) == value for c, (_, _, value) in zip(columns, wanted) if c]
    for c, condition in zip(columns, in_map):
        df = df if c else df.filter(condition)
    if not own:
        return df
    absent = reduce(or_, [F.col(c).isNull() for c in columns if c])
    said = reduce(and_, [condition for c, condition in zip(columns, in_map) if c])
    return df.filter(reduce(and_, own)).unionByName(df.filter(absent & said))


# Shuffled bytes per writing task of a bulk load: files of some hundred megabytes.
TASK_BYTES = "512m"
# The same where files have at most so many rows: their size is that of their rows, and small tasks end together.
SMALL_TASK_BYTES = "2m"
# Plain bytes per writing task of a load in a given number of shards; sorting holds about twice as much.
SHARD_TASK_BYTES = 96 << 20


def shard_of(path: str | Column, tasks: int) -> Column:
    """Shard, from 0, of a file that ``Lake.write(tasks=tasks)`` has made."""
    return F.regexp_extract(path, r"/part-(\d+)-", 1).cast("int") % tasks


@dataclass
class Lake:
    spark: SparkSession
    hot_root: str
    cold_root: str
    tables: list[str] = field(default_factory=lambda: [*schemas.TABLES, schemas.TRACE_RANGES])
    rows_per_file: int = 0  # 0: files are as large as their task

    def __post_init__(self) -> None:
        prepare(self.spark)

    # -- layout --------------------------------------------------------------

    def create_tables(self) -> "Lake":
        """Make the table folders in both tiers. Does nothing to what is there."""
        for t in self.tables:
            for tier in TIERS:
                hadoop.mkdirs(self.spark, self.path(t, tier))
            hadoop.mkdirs(self.spark, self._manifest_dir(t))
        return self

    def root(self, tier: str) -> str:
        return (self.hot_root if tier == "hot" else self.cold_root).rstrip("/")

    def path(self, table: str, tier: str = "hot") -> str:
        return f"{self.root(tier)}/{table}"

    def _manifest_dir(self, table: str) -> str:
        return f"{self.root('hot')}/_manifest/{table}"

    # -- manifest ------------------------------------------------------------

    def manifest(self, table: str) -> dict:
        """Latest version: which rewritten (tier, day, segment) count, which do not any more."""
        d = self._manifest_dir(table)
        versions = [n for n in hadoop.names(self.spark, d) if n.endswith(".json")]
        if not versions:
            return {"version": 0, "live": [], "retired": []}
        return json.loads(hadoop.read_text(self.spark, f"{d}/{versions[-1]}"))

    def commit(self, table: str, base: dict, live: list, retired: list) -> dict:
        """Write the next version. Of two maintenance jobs on one table the second finds
        its version number taken and fails; appending needs no commit."""
        new = {"version": base["version"] + 1, "live": sorted(live), "retired": sorted(retired)}
        path = f"{self._manifest_dir(table)}/{new['version']:012d}.json"
        hadoop.create_text(self.spark, path, json.dumps(new))
        return new

    # -- read ----------------------------------------------------------------

    def _schema(self, table: str) -> StructType:
        s = StructType(list(schemas.table_schema(table).fields))
        for c in schemas.PROMOTED.get(table, ()):  # NULL in files written without them
            s = s.add(c, "string")
        return s.add("seg", "string").add("event_date", "date")

    def files(self, table: str, tier: str, manifest: dict | None = None) -> DataFrame:
        """Rows of one tier that count, with ``seg`` and ``event_date``. The test is on
        partition columns only, so hidden segments are never opened."""
        m = self.manifest(table) if manifest is None else manifest
        done = self.finished(table, tier)
        df = self.spark.read.schema(self._schema(table)).parquet(self.path(table, tier))
        open_ = self.unfinished(table, tier, done)
        unit = F.concat_ws("/", F.col("event_date").cast("string"), F.col("seg"))
        here = lambda rows: [f"{d}/{s}" for t, d, s in rows if t == tier]
        live, retired = here(m["live"]), here(m["retired"])
        counts = F.col("seg").startswith("a-")
        if open_:
            counts = counts & ~F.col("seg").isin(open_)
        if retired:
            counts = counts & ~unit.isin(retired)
        if live:
            counts = counts | unit.isin(live)
        return df.filter(counts)

    def finished(self, table: str, tier: str) -> set[str]:
        """Segments whose write has ended; to be taken before the files are listed."""
        found = hadoop.matching(self.spark, f"{self.path(table, tier)}/seg=a-*/_SUCCESS")
        return {n.removeprefix("seg=") for n in found}

    def unfinished(self, table: str, tier: str, finished: set[str]) -> list[str]:
        """Appended segments that had not ended before the files were listed: those being written now, and what
        writes that died have left. Only these few names get into a plan."""
        there = [n.removeprefix("seg=") for n in hadoop.names(self.spark, self.path(table, tier))]
        return [s for s in there if s.startswith("a-") and s not in finished]

    def scan(
        self,
        table: str,
        start: datetime | str | Column | None = None,
        end: datetime | str | Column | None = None,
        tier: str | None = None,
        materialized: bool = False,
        attrs: dict[str, str] | None = None,
        resource: dict[str, str] | None = None,
    ) -> DataFrame:
        """One table over both tiers, ``start`` inclusive and ``end`` exclusive.

        ``attrs`` and ``resource`` are values wanted of log and resource attributes (a missing key reads as ''). Of promoted
        keys the condition is on their column, whose statistics and Bloom filter let a scan skip row groups.

        The bounds are put on the time column and on the partition day, because
        Spark does not derive the one from the other. ``tier`` is a literal per
        arm: a filter on it removes the other arm from the plan.
        """
        m = self.manifest(table)
        arms = [
            self.files(table, t, m).withColumn("tier", F.lit(t)) for t in TIERS if tier in (None, t)
        ]
        df = arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])
        ts = schemas.time_column(table)
        if start is not None:
            at = literal_time(start)
            df = df.filter((F.col(ts) >= at) & (F.col("event_date") >= F.to_date(at)))
        if end is not None:
            at = literal_time(end)
            df = df.filter((F.col(ts) < at) & (F.col("event_date") <= F.to_date(at)))
        wanted = [("LogAttributes", *x) for x in (attrs or {}).items()] + [("ResourceAttributes", *x) for x in (resource or {}).items()]
        df = with_attributes(df, table, wanted)
        hidden = () if materialized else (*schemas.PROMOTED.get(table, ()), *schemas.MATERIALIZED.get(table, ()))
        return df.drop("seg", *hidden)

    def scan_metrics(self, kinds: list[str] | None = None, **bounds) -> DataFrame:
        kinds = kinds or list(schemas.METRIC_KINDS)
        return union_metrics({k: self.scan(schemas.metric_table(k), **bounds) for k in kinds})

    def trace_ranges(self) -> DataFrame:
        """Time range per trace from the small range table (written with the spans)."""
        return self.scan(schemas.TRACE_RANGES).groupBy("TraceId").agg(
            F.min("Start").alias("Start"), F.max("End").alias("End")
        )

    def get_trace(self, trace_id: str) -> DataFrame:
        """All spans of one trace: look its time range up, then read only that range."""
        row = self.trace_ranges().filter(F.col("TraceId") == trace_id).first()
        if row is None:
            return self.scan("otel_traces").filter(F.lit(False))
        found = self.scan("otel_traces", start=row["Start"]).filter(
            (F.col("Timestamp") <= literal_time(row["End"]))
            & (F.col("event_date") <= F.to_date(literal_time(row["End"])))
        )
        return found.filter(F.col("TraceId") == trace_id)

    def get_traces(self, ids: DataFrame) -> DataFrame:
        """All spans of many traces: the range table says on which days they can be, and only
        those days are read. What is collected is one row per day stored."""
        wanted = stored(trace_days(ids, self.scan(schemas.TRACE_RANGES)))
        first_last = wanted.groupBy("first_day").agg(F.max("last_day").alias("last_day")).collect()
        on_days = F.lit(False)
        for first, last in _merged([(r["first_day"], r["last_day"]) for r in first_last]):
            on_days = on_days | F.col("event_date").between(F.lit(first), F.lit(last))
        spans = self.scan("otel_traces").filter(on_days)
        return spans.join(wanted.select("TraceId"), "TraceId", "left_semi")

    # -- write ---------------------------------------------------------------

    def table_rows(self, df: DataFrame, table: str) -> DataFrame:
        """Project onto the table layout and derive what is computed on write."""
        ts = schemas.time_column(table)
        if table in schemas.MATERIALIZED:
            df = df.withColumn("TimestampTime", trunc_second(ts))
        if f"{ts}_ns" not in df.columns:
            df = df.withColumn(f"{ts}_ns", unix_nanos(ts))
        s = schemas.table_schema(table)
        own = [map_text(m, key).alias(c) for c, (m, key) in schemas.PROMOTED.get(table, {}).items()]
        return df.select(*[F.col(f.name).cast(f.dataType) for f in s.fields], *own, F.to_date(ts).alias("event_date"))

    def write(
        self,
        df: DataFrame,
        table: str,
        segment: str | None = None,
        tasks: int | None = None,
        seed: int | None = None,
    ) -> str:
        """Append rows as one segment, partitioned by day, sorted by the table key.

        Bulk loads (``tasks=None``) are rebalanced by day: adaptive execution cuts
        days larger than the advisory size into several tasks, whatever keys are
        in them, and joins small ones. A micro-batch is spread over ``tasks`` shards by
        round robin instead, or with ``seed`` by random numbers, as a table sharded by ``rand()``. A shard above ``SHARD_TASK_BYTES``
        is written by several tasks, so that none sorts more however large the load is; their numbers are equal modulo ``tasks``
        (``shard_of``), and the shard of a row is the same for any number of them. With a given segment name a repeated write
        replaces the first attempt.
        """
        segment = segment or f"a-{uuid.uuid4().hex}"
        rows = self.table_rows(df, table)
        if tasks:
            n = tasks * _tasks_per_shard(rows, tasks)
            spread = rows.repartition(n) if seed is None else rows.repartition(n, F.rand(seed))
            self.save(spread, table, "hot", segment)
        else:
            size = SMALL_TASK_BYTES if self.rows_per_file else TASK_BYTES
            with settings(df.sparkSession, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": size}):
                self.save(rows.hint("rebalance", "event_date"), table, "hot", segment)
        return segment

    def save(self, spread: DataFrame, table: str, tier: str, segment: str) -> None:
        # The attribute key is a column while sorting, or each comparison would build it anew.
        keys = ["_attrs" if k == "Attributes" else k for k in schemas.SORT_KEYS[table]]
        rows = spread.withColumn("_attrs", attr_pairs("Attributes")) if "_attrs" in keys else spread
        (
            rows.sortWithinPartitions("event_date", *keys).drop("_attrs")
            .write.mode("overwrite")
            .partitionBy("event_date")
            .options(**WRITER_OPTIONS, **value_filters(table), maxRecordsPerFile=self.rows_per_file)
            .parquet(f"{self.path(table, tier)}/seg={segment}")
        )

    def write_spans(self, df: DataFrame, segment: str | None = None, tasks: int | None = None) -> str:
        """Spans plus the partial time range of each trace of this write."""
        segment = self.write(df, "otel_traces", segment, tasks)
        # From the files just written: two columns, and the input is not computed twice.
        saved = self.spark.read.schema(schemas.table_schema("otel_traces")).parquet(
            f"{self.path('otel_traces')}/seg={segment}"
        )
        self.write(trace_time_ranges(saved), schemas.TRACE_RANGES, segment, tasks)
        return segment

    def write_metrics(
        self, frames: dict[str, DataFrame], segment: str | None = None, tasks: int | None = None
    ) -> str:
        """Route points to the table of their kind."""
        segment = segment or f"a-{uuid.uuid4().hex}"
        for kind, df in frames.items():
            self.write(df, schemas.metric_table(kind), segment, tasks)
        return segment


def _tasks_per_shard(rows: DataFrame, tasks: int) -> int:
    """From the size of all rows, which takes a pass over them."""
    width = sum((F.coalesce(plain_bytes(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in rows.schema.fields), F.lit(0))
    size = rows.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return max(1, -(-size // (tasks * SHARD_TASK_BYTES)))


def _merged(spans: list[tuple[date, date]]) -> list[tuple[date, date]]:
    """Day ranges that touch or overlap as one."""
    out: list[tuple[date, date]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + timedelta(days=1):
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def day_text(d: date | str) -> str:
    return d if isinstance(d, str) else d.isoformat()
