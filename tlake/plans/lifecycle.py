"""Moves from hot to cold and compaction, as table jobs."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField
from pyspark.sql.window import Window

from tlake import schemas
from tlake.functions import attr_pairs, literal_time, trunc_second
from tlake.plans import hadoop
from tlake.plans.inventory import inventories, inventory
from tlake.plans.lake import TASK_BYTES, TIERS, Lake, day_text
from tlake.session import settings

# Retention on hot, free-space threshold, largest file on hot.
TTL_DAYS = 30
MOVE_FACTOR = 0.3
MAX_HOT_BYTES = 1 << 30

TARGET_FILE_BYTES = 512 << 20


def plan_moves(
    inv: DataFrame,
    as_of: datetime | str | Column,
    hot_capacity_bytes: int | None = None,
    move_factor: float = MOVE_FACTOR,
    max_hot_bytes: int = MAX_HOT_BYTES,
    ttl_days: int = TTL_DAYS,
) -> DataFrame:
    """What has to leave hot, one row per (table, event_date, seg) with the reason.

    ``ttl``: the newest row of the day is at least ``ttl_days`` old, at second
    precision. ``size``: the segment has a file above ``max_hot_bytes``.
    ``space``: free hot space is below ``move_factor``; the oldest days go until it
    is not. Space is judged after the other two.
    """
    per_day = Window.partitionBy("table", "event_date")
    newest = trunc_second(F.col("newest"))
    units = (
        inv.filter(F.col("tier") == "hot")
        .groupBy("table", "event_date", "seg")
        .agg(
            F.max("max_time").alias("newest"), F.sum("file_bytes").alias("bytes"),
            F.max("file_bytes").alias("largest"),
        )
        .withColumn("newest", F.max("newest").over(per_day))
        .withColumn(
            "reason",
            F.when(newest + F.expr(f"INTERVAL {int(ttl_days)} DAY") <= literal_time(as_of), "ttl")
            .when(F.col("largest") > max_hot_bytes, "size"),
        )
    )
    out = ["table", "event_date", "seg", "reason", "bytes"]
    if hot_capacity_bytes is None:
        return units.filter("reason is not null").select(*out)
    # One row per (table, day) that stays: the running sum orders a few thousand rows.
    days = units.filter("reason is null").groupBy("table", "event_date").agg(F.sum("bytes").alias("day_bytes"))
    oldest_first = Window.orderBy("event_date", "table")
    evicted = (
        days.withColumn("_total", F.sum("day_bytes").over(oldest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_gone", F.sum("day_bytes").over(oldest_first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("day_bytes"))
        .filter(F.col("_total") - F.col("_gone") > F.lit((1 - move_factor) * hot_capacity_bytes))
        .select("table", "event_date", F.lit("space").alias("_space"))
    )
    return (
        units.join(evicted, ["table", "event_date"], "left")
        .withColumn("reason", F.coalesce("reason", "_space"))
        .filter("reason is not null")
        .select(*out)
    )


def _hashable(f: StructField) -> Column:
    """Maps as entry lists, lists that hold maps as text: hashes take neither."""
    kind = f.dataType.typeName()
    if kind == "map":
        return F.map_entries(f.name)
    return F.to_json(f.name) if "map" in f.dataType.simpleString() else F.col(f.name)


def _fingerprint(df: DataFrame) -> dict:
    """Rows and an order-free checksum per day."""
    rows = df.drop("seg", "tier")
    whole = F.xxhash64(*[_hashable(f) for f in rows.schema.fields if f.name != "event_date"])
    found = rows.groupBy("event_date").agg(
        F.count("*").alias("n"), F.sum(whole.cast("decimal(38,0)")).alias("h")
    )
    return {r["event_date"]: (r["n"], r["h"]) for r in found.collect()}


def _in_ranges(lake: Lake, table: str, rows: DataFrame, days: int, units: list) -> DataFrame:
    """Rows in as many key ranges as the files of the units are worth.

    Rows equal in the whole key are told apart by the file block they come from, so
    copies of one record cannot pile up in one range.
    """
    keys = [attr_pairs("Attributes") if k == "Attributes" else F.col(k) for k in schemas.SORT_KEYS[table]]
    own = [f"{d}/{s}" for _, d, s in units]
    sizes = inventory(lake, table).filter(F.concat_ws("/", F.col("event_date").cast("string"), F.col("seg")).isin(own))
    total = sizes.agg(F.sum("file_bytes")).first()[0] or 0
    files = max(days, -(-total // TARGET_FILE_BYTES))
    place = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    return (
        rows.withColumn("_place", place)
        .repartitionByRange(int(files), "event_date", *keys, "_place").drop("_place")
    )


def _rewrite(lake: Lake, table: str, units: list[tuple[str, str, str]], to_tier: str, merge: bool) -> dict:
    """Write (tier, day, segment) units as one segment on ``to_tier``.

    Write → verify count and checksum per day → flip the manifest. Old files stay
    until ``vacuum``, for readers that started before the flip.

    A move is narrow: each task reads some files of the days and writes them sorted
    again, nothing is shuffled. With ``merge`` the rows are also put into ranges of
    the table key, so that the files of a day cover separate ranges.
    """
    base = lake.manifest(table)
    source = None
    for tier in TIERS:
        own = [f"{d}/{s}" for t, d, s in units if t == tier]
        if own:
            unit = F.concat_ws("/", F.col("event_date").cast("string"), F.col("seg"))
            arm = lake.files(table, tier, base).filter(unit.isin(own))
            source = arm if source is None else source.unionByName(arm)
    before = _fingerprint(source)
    rows = source.drop("seg")
    segment = f"m-{uuid.uuid4().hex}"
    with settings(lake.spark, {"spark.sql.files.maxPartitionBytes": TASK_BYTES}):
        lake.save(_in_ranges(lake, table, rows, len(before), units) if merge else rows, table, to_tier, segment)
    written = (
        lake.spark.read.schema(lake._schema(table)).parquet(lake.path(table, to_tier))
        .filter(F.col("seg") == segment)
    )
    if _fingerprint(written) != before:
        raise RuntimeError(f"{table}: rewritten rows differ from the source, nothing was changed")
    gone = {tuple(u) for u in units}
    live = [list(u) for u in base["live"] if tuple(u) not in gone]
    live += [[to_tier, day_text(d), segment] for d in before]
    retired = [*base["retired"], *[list(u) for u in gone]]
    lake.commit(table, base, live, retired)
    return {"segment": segment, "rows": sum(n for n, _ in before.values()), "days": len(before)}


def apply_moves(lake: Lake, tables: str | list[str], as_of: datetime | str, **limits) -> dict:
    """Evaluate the rules now and move what is due, one job per table.

    Free space is shared by all tables, so with a hot capacity all of them are
    judged together, also when only some are to be moved.
    """
    wanted = [tables] if isinstance(tables, str) else list(tables)
    judged = lake.tables if limits.get("hot_capacity_bytes") is not None else wanted
    plan = plan_moves(inventories(lake, judged), as_of, **limits)
    due: dict[str, list] = {t: [] for t in wanted}
    for r in plan.filter(F.col("table").isin(wanted)).select("table", "event_date", "seg").collect():
        due[r["table"]].append(("hot", day_text(r["event_date"]), r["seg"]))
    nothing = {"segment": None, "rows": 0, "days": 0}
    done = {t: _rewrite(lake, t, units, "cold", merge=False) if units else nothing for t, units in due.items()}
    return done[tables] if isinstance(tables, str) else done


def compact(lake: Lake, table: str, day: date | str, tier: str = "hot") -> dict:
    """Merge all segments of a day in a tier into few sorted files."""
    d = day_text(day)
    segs = [r["seg"] for r in lake.files(table, tier).filter(F.col("event_date") == F.lit(d).cast("date"))
            .select("seg").distinct().collect()]
    if not segs:
        return {"segment": None, "rows": 0, "days": 0}
    return _rewrite(lake, table, [(tier, d, s) for s in segs], tier, merge=True)


def compact_due(lake: Lake, table: str, min_segments: int = 8, tier: str = "hot") -> dict:
    """Merge all days that lie in at least ``min_segments`` segments of a tier, in one job."""
    units = lake.files(table, tier).select("event_date", "seg").distinct()
    days = units.groupBy("event_date").count().filter(F.col("count") >= min_segments).select("event_date")
    due = [(tier, day_text(r["event_date"]), r["seg"]) for r in units.join(days, "event_date").collect()]
    if not due:
        return {"segment": None, "rows": 0, "days": 0}
    return _rewrite(lake, table, due, tier, merge=True)


def vacuum(lake: Lake, table: str) -> int:
    """Remove the files of retired units; run when no reader older than the flip is left."""
    base = lake.manifest(table)
    for tier, day, seg in base["retired"]:
        hadoop.delete(lake.spark, f"{lake.path(table, tier)}/seg={seg}/event_date={day}")
    if base["retired"]:
        lake.commit(table, base, base["live"], [])
    return len(base["retired"])
