"""Metric points: gauges, counters, histograms, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tlake import schemas
from tlake.functions import attr_pairs, from_unix_nanos, time_bucket
from tlake.functions.scalar import bucket_micros

SERIES = ["ServiceName", "MetricName", "attr_key"]


def _keyed(df: DataFrame) -> DataFrame:
    """Series key as a sorted list; rendered as text only on the results."""
    return df.withColumn("attr_key", attr_pairs("Attributes"))


def _rendered(df: DataFrame) -> DataFrame:
    return df.withColumn("attr_key", F.to_json("attr_key"))


def gauge_series(df: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """avg/min/max/last per series and time bucket."""
    return _rendered(
        _keyed(df).groupBy(time_bucket("TimeUnix", bucket).alias("bucket"), *SERIES)
        .agg(
            F.avg("Value").alias("avg"), F.min("Value").alias("min"), F.max("Value").alias("max"),
            F.max_by("Value", "TimeUnix_ns").alias("last"), F.count("*").alias("n"),
        )
    )


def counter_increase(df: DataFrame, series: list[str], bucket: str, slice_width: str) -> DataFrame:
    """Increase of ``Value`` per series and time bucket; one row per (bucket, series).

    Delta points are added up. For cumulative points the step from the previous
    point of the series counts; after a fall of a monotonic counter (reset) the
    new value itself. The first point of a series opens it and adds nothing.

    Steps need order, and one series may hold very many points. So steps are
    taken inside short time slices, each slice keeps its first and last value,
    and the steps between slices are taken over that much smaller table.
    """
    if bucket_micros(bucket) % bucket_micros(slice_width):
        raise ValueError("the slice width must divide the bucket width")
    line = [*series, "AggregationTemporality", "IsMonotonic"]
    points = df.select(*line, "TimeUnix_ns", "Value", time_bucket("TimeUnix", slice_width).alias("slice"))
    order = ["TimeUnix_ns", "Value"]

    def step(prev: Column, cur: Column) -> Column:
        reset = F.col("IsMonotonic") & (cur < prev)
        return F.when(prev.isNull(), 0.0).when(reset, cur).otherwise(cur - prev)

    delta = F.col("AggregationTemporality") == 1
    inside = Window.partitionBy(*line, "slice").orderBy(*order)
    prev, following = F.lag("Value").over(inside), F.lead("Value").over(inside)
    slices = (
        points.withColumns({"_prev": prev, "_next": following})
        .withColumn("_step", F.when(delta, F.col("Value")).otherwise(step(F.col("_prev"), F.col("Value"))))
        .groupBy(*line, "slice")
        .agg(
            F.sum("_step").alias("inside"), F.count("*").alias("n"),
            F.max(F.when(F.col("_prev").isNull(), F.col("Value"))).alias("first"),
            F.max(F.when(F.col("_next").isNull(), F.col("Value"))).alias("last"),
        )
    )
    before = F.lag("last").over(Window.partitionBy(*line).orderBy("slice"))
    between = F.when(delta, 0.0).otherwise(step(F.col("_before"), F.col("first")))
    return (
        slices.withColumn("_before", before)
        .withColumn("_inc", F.col("inside") + between)
        .groupBy(time_bucket("slice", bucket).alias("bucket"), *series)
        .agg(F.sum("_inc").alias("increase"), F.sum("n").alias("n"))
    )


def counter_rate(df: DataFrame, bucket: str = "1 hour", slice_width: str = "1 minute") -> DataFrame:
    """Increase and per-second rate of counters per series and time bucket."""
    seconds = bucket_micros(bucket) / 1e6
    increase = counter_increase(_keyed(df), SERIES, bucket, slice_width)
    return _rendered(increase).withColumn("rate", F.col("increase") / F.lit(seconds))


def counter_increase_by_start(df: DataFrame, series: list[str], bucket: str, slice_width: str) -> DataFrame:
    """Increase of ``Value`` per series and time bucket, with restarts told by ``StartTimeUnix_ns`` and shared out by time.

    Points of a series with the same start time are one run of the counter. A later start (both known, not 0) is a
    restart, also if the new run has overtaken the old value: the whole value has been counted since the start. Without
    start times a fall of a monotonic counter is the restart. Every step, and every delta point (temporality 1, counted
    since its start), stands for the time from its begin to its point; where that crosses bucket edges, the
    step is shared out in proportion. The first point of a series opens it and adds nothing. ``n`` counts points.

    As in ``counter_increase`` order is taken inside short slices, then between the slices' first and last points.
    A step over a long silence gives a row for each bucket it covers.
    """
    if bucket_micros(bucket) % bucket_micros(slice_width):
        raise ValueError("the slice width must divide the bucket width")
    line = [*series, "AggregationTemporality", "IsMonotonic"]
    width = F.lit(bucket_micros(bucket) * 1000).cast("bigint")
    edge = lambda ns: ns - F.pmod(ns, width)
    p = F.struct(F.col("TimeUnix_ns").alias("t"), F.coalesce("StartTimeUnix_ns", F.lit(0)).alias("s"), F.col("Value").alias("v"))
    points = df.select(*line, time_bucket("TimeUnix", slice_width).alias("slice"), p.alias("p"))
    delta = F.col("AggregationTemporality") == 1

    def step(prev: Column, cur: Column) -> Column:
        """begin, end and amount of what a cumulative point adds to the one before it."""
        restart = (prev["s"] > 0) & (cur["s"] > prev["s"])
        reset = restart | (F.col("IsMonotonic") & (cur["v"] < prev["v"]))
        return F.struct(
            F.when(restart, F.least(F.greatest(prev["t"], cur["s"]), cur["t"])).otherwise(F.coalesce(prev["t"], cur["t"])).alias("begin"),
            cur["t"].alias("end"),
            F.when(prev.isNull(), 0.0).when(reset, cur["v"]).otherwise(cur["v"] - prev["v"]).alias("amount"),
        )

    of_delta = F.struct(
        F.when((F.col("p.s") > 0) & (F.col("p.s") < F.col("p.t")), F.col("p.s")).otherwise(F.col("p.t")).alias("begin"),
        F.col("p.t").alias("end"), F.col("p.v").alias("amount"),
    )
    inside = Window.partitionBy(*line, "slice").orderBy("p")  # by t, s, v
    steps = points.withColumns({"_prev": F.lag("p").over(inside), "_next": F.lead("p").over(inside)}).withColumn(
        "_step", F.when(delta, of_delta).otherwise(step(F.col("_prev"), F.col("p")))
    )
    within = edge(F.col("_step.begin")) == edge(F.col("_step.end"))
    # First and last points of the slices, one row where they are the same: before a first point is the last one of the slice before.
    opens, closes = F.col("_prev").isNull(), F.col("_next").isNull()
    ends = steps.filter(~delta & (opens | closes)).select(*line, "slice", "p", opens.alias("_opens"))
    between = (
        ends.withColumn("_before", F.lag("p").over(Window.partitionBy(*line).orderBy("slice", F.desc("_opens"))))
        .filter(F.col("_opens") & F.col("_before").isNotNull()).select(*series, step(F.col("_before"), F.col("p")).alias("_step"))
    )
    begin, end = F.col("_step.begin"), F.col("_step.end")
    covered = F.sequence(edge(begin), edge(end), width)
    spread = between.unionByName(steps.filter(~within).select(*series, "_step")).select(
        *series, "_step", F.explode(covered).alias("_edge")
    )
    share = F.when(begin == end, 1.0).otherwise(
        (F.least(end, F.col("_edge") + width) - F.greatest(begin, F.col("_edge"))) / (end - begin).cast("double")
    )
    parts = steps.select(
        *series, time_bucket("slice", bucket).alias("bucket"),
        F.coalesce(F.when(within, F.col("_step.amount")), F.lit(0.0)).alias("x"), F.lit(1).cast("bigint").alias("n"),
    ).unionByName(
        spread.select(*series, from_unix_nanos("_edge").alias("bucket"), (F.col("_step.amount") * share).alias("x"), F.lit(0).cast("bigint").alias("n"))
    )
    return parts.groupBy("bucket", *series).agg(F.sum("x").alias("increase"), F.sum("n").alias("n"))


def counter_rate_by_start(df: DataFrame, bucket: str = "1 hour", slice_width: str = "1 minute") -> DataFrame:
    """As ``counter_rate``, with restarts by start time and steps shared out over bucket edges."""
    increase = counter_increase_by_start(_keyed(df), SERIES, bucket, slice_width)
    return _rendered(increase).withColumn("rate", F.col("increase") / F.lit(bucket_micros(bucket) / 1e6))


def histogram_quantile(
    df: DataFrame,
    q: float,
    bucket: str = "1 hour",
    keys: list[str] | None = None,
    slice_width: str = "1 minute",
) -> DataFrame:
    """Merge histograms of equal bounds and interpolate a quantile.

    Counts are added per bound before any ordering, so the windows below see one
    row per bound. Histograms with other bounds are not mixed: the bounds are
    part of the group. Points that say they are cumulative (temporality 2) are
    read as one counter per bound of each series, and its increase is merged; the
    counts of all others are added as they are.
    """
    keys = keys or ["ServiceName", "MetricName"]
    group = ["bucket", *keys, "bounds_key"]
    bounds = F.to_json("ExplicitBounds").alias("bounds_key")
    cumulative = F.col("AggregationTemporality").eqNullSafe(F.lit(2))
    series = list(dict.fromkeys([*keys, *SERIES, "bounds_key", "i"]))
    bounds_counts = _keyed(df.filter(cumulative)).select(
        *[c for c in series if c not in ("bounds_key", "i")], "TimeUnix", "TimeUnix_ns",
        "AggregationTemporality", F.lit(True).alias("IsMonotonic"), bounds,
        F.posexplode("BucketCounts").alias("i", "c"),
    ).withColumn("Value", F.col("c").cast("double"))
    increases = counter_increase(bounds_counts, series, bucket, slice_width)
    added = df.filter(~cumulative).select(
        time_bucket("TimeUnix", bucket).alias("bucket"), *keys, bounds,
        F.posexplode("BucketCounts").alias("i", "c"),
    )
    counts = added.unionByName(increases.select("bucket", *keys, "bounds_key", "i", F.col("increase").cast("bigint").alias("c")))
    parts = counts.groupBy(*group, "i").agg(F.sum("c").alias("c")).withColumn(
        "b", F.from_json("bounds_key", "array<double>")
    )
    w = Window.partitionBy(*group)
    run = F.sum("c").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.withColumns({"upto": run, "n": F.sum("c").over(w)}).withColumn("rank", F.lit(q) * F.col("n"))
    # The first bound that reaches the rank; an open outer bucket gives its finite edge.
    reached = (F.col("upto") >= F.col("rank")) & (F.col("c") > 0)
    hit = ranked.filter(reached & ((F.col("upto") - F.col("c") < F.col("rank")) | (F.col("upto") == F.col("c"))))
    lower = F.coalesce(F.get("b", F.col("i") - 1), F.least(F.lit(0.0), F.get("b", F.lit(0))))
    upper = F.get("b", F.col("i"))
    inside = (F.col("rank") - (F.col("upto") - F.col("c"))) / F.col("c")
    value = F.when(upper.isNull(), F.get("b", F.size("b") - 1)).otherwise(lower + (upper - lower) * inside)
    return hit.select("bucket", *keys, "bounds_key", "n", value.alias("quantile"))


def merge_bounds(counts: DataFrame, group: list[str]) -> DataFrame:
    """Histogram counts of any bounds on the common refinement of the bounds of each group.

    Input: the group, ``ExplicitBounds``, bucket number ``i`` (from 0) and count ``c``. Output: the group, ``lo`` and ``hi`` of a
    refined bucket, NULL above the last bound, and its count, now a fraction. A bucket is shared out over the refined
    ones inside it in proportion to their width, so no count is lost. The first bucket begins at 0, or at the group's smallest
    bound where that is negative; the open last bucket of any histogram goes to the open one of the group, since nothing is
    known about its inside.
    """
    added = counts.groupBy(*group, "ExplicitBounds", "i").agg(F.sum("c").alias("c"))
    layouts = added.groupBy(*group).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ExplicitBounds")))).alias("_all")
    )
    floor = F.least(F.lit(0.0), F.coalesce(F.get("_all", F.lit(0)), F.lit(0.0)))
    own = lambda k: F.get("ExplicitBounds", k)
    joined = added.join(layouts, group).select(
        *group, "c", F.coalesce(own(F.col("i") - 1), floor).alias("from"), own(F.col("i")).alias("to"), "_all", floor.alias("_floor")
    )
    open_ = F.col("to").isNull()
    edges = F.concat(F.array("from"), F.filter("_all", lambda b: (b > F.col("from")) & (b < F.col("to"))), F.array("to"))
    pieces = F.when(open_, F.array(F.struct(F.coalesce(F.element_at("_all", -1), F.col("from")).alias("lo"), F.col("to").alias("hi")))).otherwise(
        F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda e, k: F.struct(e.alias("lo"), F.get(edges, k + 1).alias("hi")))
    )
    width = F.col("to") - F.col("from")
    share = F.when(open_ | (width <= 0), 1.0).otherwise((F.col("_b.hi") - F.col("_b.lo")) / width)
    return (
        joined.withColumn("_b", F.explode(pieces))
        .groupBy(*group, F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"))
        .agg(F.sum(F.col("c") * share).alias("c"))
    )


def histogram_quantile_mixed(df: DataFrame, q: float, bucket: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Quantile of histograms whose bounds differ, merged by ``merge_bounds``. Counts are added as they are (temporality 1)."""
    keys = keys or ["ServiceName", "MetricName"]
    group = ["bucket", *keys]
    counts = df.select(
        time_bucket("TimeUnix", bucket).alias("bucket"), *keys, "ExplicitBounds", F.posexplode("BucketCounts").alias("i", "c")
    )
    merged = merge_bounds(counts, group).filter(F.col("c") > 0)
    w = Window.partitionBy(*group)
    run = F.sum("c").over(w.orderBy("lo", F.asc_nulls_last("hi")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumns({"upto": run, "n": F.sum("c").over(w)}).withColumn("rank", F.lit(q) * F.col("n"))
    # Sums of fractions: the last bucket reaches every rank.
    last = F.row_number().over(w.orderBy(F.desc("lo"), F.desc_nulls_first("hi"))) == 1
    reached = ranked.withColumn("_last", last).filter((F.col("upto") >= F.col("rank")) | F.col("_last"))
    first = reached.withColumn("_k", F.row_number().over(w.orderBy("lo", F.asc_nulls_last("hi")))).filter("_k = 1")
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rank") - (F.col("upto") - F.col("c"))) / F.col("c")))
    value = F.when(F.col("hi").isNull(), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * inside)
    return first.select(*group, "n", value.alias("quantile"))


def _bucket_entries() -> Column:
    """Buckets of an exponential histogram as (side, idx, c) entries."""
    zero = F.lit(0)
    side = lambda s, off, cnt: F.transform(
        F.col(cnt),
        lambda c, i: F.struct(F.lit(s).alias("side"), (F.col(off) + i).alias("idx"), c.alias("c")),
    )
    return F.concat(
        side(1, "PositiveOffset", "PositiveBucketCounts"),
        side(-1, "NegativeOffset", "NegativeBucketCounts"),
        F.array(F.struct(zero.alias("side"), zero.alias("idx"), F.col("ZeroCount").alias("c"))),
    )


def _cumulative_buckets(df: DataFrame, keys: list[str], slice_width: str) -> DataFrame:
    """Cumulative points → keys, scale ``s`` and entries ``e`` that each adds to the point before it in its series.

    Both are put on the coarser of their scales; what the earlier one holds is entered with a minus sign. A fall of
    the total count is a reset, after which the whole point counts. The first point of a series adds nothing. As with
    counters, order is taken inside time slices, then between the slices' first and last points.
    """
    series = list(dict.fromkeys([*(k for k in keys if k != "bucket"), *SERIES]))
    kept = list(dict.fromkeys([*series, *keys]))
    point = F.struct(F.col("Count").alias("n"), F.col("Scale").alias("s"), _bucket_entries().alias("e"))
    points = _keyed(df).select(*kept, "TimeUnix_ns", time_bucket("TimeUnix", slice_width).alias("slice"), point.alias("p"))
    inside = Window.partitionBy(*kept, "slice").orderBy("TimeUnix_ns", "p.n")
    ordered = points.withColumns({"before": F.lag("p").over(inside), "after": F.lead("p").over(inside)})
    ends = (
        ordered.filter(F.col("before").isNull() | F.col("after").isNull())
        .groupBy(*kept, "slice")
        .agg(
            F.max(F.when(F.col("before").isNull(), F.col("p"))).alias("p"),
            F.max(F.when(F.col("after").isNull(), F.col("p"))).alias("last"),
        )
        .withColumn("before", F.lag("last").over(Window.partitionBy(*series).orderBy("slice")))
    )
    steps = ordered.select(*keys, "p", "before").unionByName(ends.select(*keys, "p", "before")).filter(F.col("before").isNotNull())
    reset = F.col("p.n") < F.col("before.n")
    moved = lambda x, sign: F.transform(
        F.col(f"{x}.e"),
        lambda e: F.struct(
            e["side"].alias("side"),
            F.call_function("shiftright", e["idx"], F.col(f"{x}.s") - F.col("s")).alias("idx"),
            (e["c"] * F.lit(sign)).alias("c"),
        ),
    )
    return steps.withColumn("s", F.when(reset, F.col("p.s")).otherwise(F.least("p.s", "before.s"))).select(
        *keys, "s", F.when(reset, moved("p", 1)).otherwise(F.concat(moved("p", 1), moved("before", -1))).alias("e")
    )


def exp_histogram_merge(df: DataFrame, keys: list[str], slice_width: str = "1 minute") -> DataFrame:
    """Merge exponential histograms on the coarsest scale of each group.

    Points that say they are cumulative (temporality 2) count with what they add to the point before, all others
    as they are. A key ``bucket`` holds the time bucket of the point, of which the slice width is a divisor.

    Output: group keys, ``scale``, ``side`` (-1, 0, 1), ``idx`` and count ``c``.
    """
    as_is = lambda x: x.select(*keys, F.col("Scale").alias("s"), _bucket_entries().alias("e"))
    if "AggregationTemporality" in df.columns:
        cumulative = F.col("AggregationTemporality").eqNullSafe(F.lit(2))
        entries = as_is(df.filter(~cumulative)).unionByName(_cumulative_buckets(df.filter(cumulative), keys, slice_width))
    else:
        entries = as_is(df)
    # Adding up on the original scale first leaves a bounded number of rows per group.
    parts = (
        entries.select(*keys, "s", F.explode("e").alias("e"))
        .select(*keys, "s", "e.side", "e.idx", "e.c")
        .groupBy(*keys, "s", "side", "idx").agg(F.sum("c").alias("c"))
    )
    coarse = parts.withColumn("scale", F.min("s").over(Window.partitionBy(*keys))).filter("c > 0")
    return (
        coarse.withColumn("idx", F.expr("shiftright(idx, s - scale)"))
        .groupBy(*keys, "scale", "side", "idx").agg(F.sum("c").alias("c"))
    )


def exp_histogram_quantile(
    df: DataFrame, q: float, bucket: str = "1 hour", keys: list[str] | None = None, slice_width: str = "1 minute"
) -> DataFrame:
    """Quantile of merged exponential histograms, geometric inside a bucket."""
    if bucket_micros(bucket) % bucket_micros(slice_width):
        raise ValueError("the slice width must divide the bucket width")
    keys = keys or ["ServiceName", "MetricName"]
    group = ["bucket", *keys]
    merged = exp_histogram_merge(df.withColumn("bucket", time_bucket("TimeUnix", bucket)), group, slice_width)
    w = Window.partitionBy(*group)
    # Ascending by value: negative buckets from large to small index, zero, positive.
    order = w.orderBy("side", F.col("side") * F.col("idx"))
    run = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumns({"upto": run, "n": F.sum("c").over(w)}).withColumn("rank", F.lit(q) * F.col("n"))
    hit = ranked.filter(
        (F.col("upto") >= F.col("rank")) & ((F.col("upto") - F.col("c") < F.col("rank")) | (F.col("upto") == F.col("c")))
    )
    inside = (F.col("rank") - (F.col("upto") - F.col("c"))) / F.col("c")
    width = F.pow(F.lit(2.0), -F.col("scale"))  # log2 of the base
    magnitude = lambda f: F.pow(F.lit(2.0), (F.col("idx") + f) * width)
    value = (
        F.when(F.col("side") == 0, 0.0)
        .when(F.col("side") > 0, magnitude(inside))
        .otherwise(-magnitude(1 - inside))
    )
    return hit.select(*group, "n", value.alias("quantile"))


def summary_quantile(df: DataFrame, q: float) -> DataFrame:
    """Stored value of one quantile per summary point; points without it are left out."""
    hit = F.get(F.filter("ValueAtQuantiles", lambda x: x["Quantile"] == F.lit(q)), 0)
    return df.select("ServiceName", "MetricName", "Attributes", "TimeUnix", "Count", "Sum",
                     hit["Value"].alias("quantile")).filter("quantile is not null")


def union_metrics(frames: dict[str, DataFrame]) -> DataFrame:
    """One frame over the metric tables, column ``kind`` tells the source."""
    out = None
    for kind in schemas.METRIC_KINDS:
        if kind not in frames:
            continue
        df = frames[kind].withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
