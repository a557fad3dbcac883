"""Metric operators and percentiles against brute force, with skewed groups."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tlake.operators import aggregates, metrics, traces
from tlake.operators.percentiles import exact_percentiles
from tlake.session import prepare

T0 = datetime(2024, 1, 1)


def counters(spark, points, temporality=2, monotonic=True):
    rows_ = [("s", "m", {"k": k}, T0 + timedelta(seconds=t), int((T0.timestamp() + t) * 1e9), float(v), temporality, monotonic)
             for k, t, v in points]
    return spark.createDataFrame(rows_, "ServiceName string, MetricName string, Attributes map<string,string>, TimeUnix timestamp_ntz, "
                                        "TimeUnix_ns bigint, Value double, AggregationTemporality int, IsMonotonic boolean")


def brute(points):
    out, last = {}, {}
    for k, t, v in sorted(points, key=lambda p: (p[0], p[1])):
        step = 0.0 if k not in last else (v if v < last[k] else v - last[k])
        last[k] = v
        b = (k, t // 3600)
        out[b] = out.get(b, 0.0) + step
    return out


def test_counter_rate_with_one_hot_series(spark):
    rnd = random.Random(1)
    times = rnd.sample(range(6 * 3600), 3000)
    # One series holds a third of the points; resets fall inside buckets and slices.
    points = [("hot" if i % 3 == 0 else f"s{i % 40}", t, rnd.randrange(1000)) for i, t in enumerate(times)]
    want = brute(points)
    for width in ("1 minute", "5 minutes", "1 hour"):
        df = metrics.counter_rate(counters(spark, points), "1 hour", width)
        got = {(r["attr_key"].split('"')[7], int((r["bucket"] - T0).total_seconds()) // 3600): r["increase"] for r in df.collect()}
        assert got == want


def test_counter_cases(spark):
    inc = lambda pts, **kw: sum(r["increase"] for r in metrics.counter_rate(counters(spark, pts, **kw)).collect())
    reset = [("a", 0, 5), ("a", 10, 9), ("a", 20, 2), ("a", 30, 4)]
    assert inc(reset) == 4 + 2 + 2
    assert inc(reset, monotonic=False) == 4 - 7 + 2
    assert inc(reset, temporality=1) == 20
    with pytest.raises(ValueError):
        metrics.counter_rate(counters(spark, reset), "1 hour", "7 minutes")


@pytest.mark.parametrize("scale", [100, 10**7, 2**45])
def test_percentiles_equal_numpy_on_skewed_groups(spark, scale):
    rnd = random.Random(scale)
    data = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 11}", rnd.randrange(-scale, scale)) for i in range(5000)]
    data += [("one", 5), ("copies", 7)] + [("copies", 7)] * 2000
    df = spark.createDataFrame(data, "g string, v bigint")
    qs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    out = exact_percentiles(df, ["g"], "v", qs, {"neg": F.col("v") < 0})
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == {g for g, _ in data}
    for g, r in got.items():
        vs = [v for x, v in data if x == g]
        assert (r["n"], r["total"], r["neg"]) == (len(vs), sum(vs), sum(v < 0 for v in vs))
        for name, q in qs.items():
            assert r[name] == pytest.approx(float(np.percentile(vs, q * 100)), rel=1e-12, abs=1e-6)


def test_percentiles_ignore_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 3)], "g string, v bigint")
    assert rows(exact_percentiles(df, ["g"], "v", {"p": 0.5})) == [("a", 2, 4, 2.0)]


def test_percentiles_share_one_scan(spark, sf_dir):
    from workload.queries import REGISTRY

    df = REGISTRY["red_metrics"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2


def hist(spark, *points, temporality=1):
    return spark.createDataFrame(
        [("s", "m", {}, T0 + timedelta(seconds=t), int((T0.timestamp() + t) * 1e9), c, b, temporality) for t, c, b in points],
        "ServiceName string, MetricName string, Attributes map<string,string>, TimeUnix timestamp_ntz, TimeUnix_ns bigint, "
        "BucketCounts array<bigint>, ExplicitBounds array<double>, AggregationTemporality int",
    )


def test_histogram_quantile(spark):
    q = lambda df, x, **kw: sorted((r["bounds_key"], r["n"], r["quantile"]) for r in metrics.histogram_quantile(df, x, **kw).collect())
    two = hist(spark, (0, [1, 2, 0], [10.0, 20.0]), (5, [1, 0, 0], [10.0, 20.0]))
    assert q(two, 0.5) == [("[10.0,20.0]", 4, 10.0)]
    assert q(two, 1.0) == [("[10.0,20.0]", 4, 20.0)]
    mixed = hist(spark, (0, [4, 0], [10.0]), (1, [0, 4], [5.0]))
    assert q(mixed, 0.5) == [("[10.0]", 4, 5.0), ("[5.0]", 4, 5.0)]
    assert q(hist(spark, (0, [3], [])), 0.5) == [("[]", 3, None)]
    cumulative = hist(spark, (0, [1, 0], [10.0]), (10, [1, 4], [10.0]), (20, [3, 4], [10.0]), temporality=2)
    assert q(cumulative, 0.5) == [("[10.0]", 6, 10.0)]


def exps(spark, *points):
    return spark.createDataFrame(
        [("s", "m", T0, *p) for p in points],
        "ServiceName string, MetricName string, TimeUnix timestamp_ntz, Scale int, ZeroCount bigint, PositiveOffset int, "
        "PositiveBucketCounts array<bigint>, NegativeOffset int, NegativeBucketCounts array<bigint>",
    )


def test_exp_histogram_downscale(spark):
    # Scale 1 buckets 2..5 are scale 0 buckets 1..2.
    df = exps(spark, (1, 0, 2, [1, 2, 3, 4], 0, []), (0, 5, 1, [10], -1, [1]))
    got = sorted(rows(metrics.exp_histogram_merge(df, ["ServiceName"])))
    assert got == [("s", 0, -1, -1, 1), ("s", 0, 0, 0, 5), ("s", 0, 1, 1, 13), ("s", 0, 1, 2, 7)]
    q = lambda x: metrics.exp_histogram_quantile(df, x).first()["quantile"]
    assert q(0.1) == 0.0 and q(0.0) == pytest.approx(-1.0)
    assert q(1.0) == pytest.approx(8.0) and 2 < q(0.5) <= 4


def test_cumulative_exp_histogram_against_a_plain_walk(spark):
    """Growing buckets on both sides, changing scales and resets, many points in one time slice."""
    rng = random.Random(5)
    points, want = [], {}
    for name in ("a", "b"):
        held, before = {}, None
        for t in range(120):
            if rng.random() < 0.05 and sum(held.values()) > 20:
                held = {}
            for _ in range(rng.randrange(4)):
                spot = (rng.choice((-1, 1)), rng.randrange(-9, 9)) if rng.random() < 0.9 else (0, 0)
                held[spot] = held.get(spot, 0) + rng.randrange(1, 4)
            scale = rng.choice((0, 0, 0, -1, -2))
            on = lambda h, s: {k: sum(c for (d, i), c in h.items() if (d, i >> -s) == k) for k in {(d, i >> -s) for d, i in h}}
            row = []
            for side in (1, -1):
                idx = sorted(i for d, i in on(held, scale) if d == side)
                full = range(idx[0], idx[-1] + 1) if idx else range(0)
                row += [idx[0] if idx else 0, [on(held, scale).get((side, i), 0) for i in full]]
            points.append((name, "m", {}, T0 + timedelta(seconds=11 * t), int((T0.timestamp() + 11 * t) * 1e9), scale, sum(held.values()), held.get((0, 0), 0), *row, 2))
            if before is not None:
                fell = sum(held.values()) < sum(before.values())
                s = scale if fell else min(scale, last)
                for k, c in on(held, s).items():
                    want[(name, s, *k)] = want.get((name, s, *k), 0) + c
                for k, c in ({} if fell else on(before, s)).items():
                    want[(name, s, *k)] -= c
            before, last = dict(held), scale
    df = spark.createDataFrame(
        points,
        "ServiceName string, MetricName string, Attributes map<string,string>, TimeUnix timestamp_ntz, TimeUnix_ns bigint, Scale int, "
        "Count bigint, ZeroCount bigint, PositiveOffset int, PositiveBucketCounts array<bigint>, NegativeOffset int, "
        "NegativeBucketCounts array<bigint>, AggregationTemporality int",
    )
    coarse = {}
    for (name, s, side, i), c in want.items():
        coarse[(name, -2, side, i >> (s + 2))] = coarse.get((name, -2, side, i >> (s + 2)), 0) + c
    got = sorted(rows(metrics.exp_histogram_merge(df, ["ServiceName"]).select("ServiceName", "scale", "side", "idx", "c")))
    assert got == sorted((*k, c) for k, c in coarse.items() if c)


def test_gauge_last_and_summary(spark):
    df = counters(spark, [("a", 5, 1), ("a", 50, 7), ("a", 20, 3), ("b", 4000, 9)])
    got = {(r["attr_key"], r["bucket"].hour): (r["avg"], r["min"], r["max"], r["last"], r["n"]) for r in metrics.gauge_series(df).collect()}
    assert sorted(got.values()) == [(11 / 3, 1.0, 7.0, 7.0, 3), (9.0, 9.0, 9.0, 9.0, 1)]
    s = spark.createDataFrame([("s", "m", {}, T0, 1, 1.0, [(0.5, 2.0), (0.9, 3.0)]), ("s", "m", {}, T0, 1, 1.0, [])],
                              "ServiceName string, MetricName string, Attributes map<string,string>, TimeUnix timestamp_ntz, Count bigint, "
                              "Sum double, ValueAtQuantiles array<struct<Quantile:double,Value:double>>")
    assert [r["quantile"] for r in metrics.summary_quantile(s, 0.9).collect()] == [3.0]


def spans(spark, *rows_):
    return spark.createDataFrame([(*r, T0) for r in rows_],
                                 "TraceId string, SpanId string, ParentSpanId string, SpanName string, ServiceName string, Duration bigint, Timestamp timestamp_ntz")


def test_span_tree_edges(spark):
    df = spans(spark, ("t", "1", "", "root", "a", 100), ("t", "2", "1", "x", "b", 70), ("t", "3", "1", "y", "b", 60),
               ("t", "4", "gone", "z", "c", 5), ("u", "2", "1", "other", "c", 9), ("", "9", "", "n", "n", 1))
    got = {(r["TraceId"], r["SpanId"]): r for r in traces.span_tree(df).collect()}
    assert len(got) == 5
    assert (got["t", "1"]["self_ns"], got["t", "1"]["n_children"], got["t", "1"]["is_root"]) == (0, 2, True)
    assert (got["t", "2"]["parent_name"], got["t", "2"]["self_ns"]) == ("root", 70)
    assert (got["t", "4"]["parent_name"], got["t", "4"]["is_root"], got["u", "2"]["parent_name"]) == (None, False, None)
    assert sorted(rows(traces.service_edges(df))) == [("a", "b", 2, 130)]


def test_hot_parent(spark):
    """A third of all spans below one parent: one row per child, sums pre-aggregated."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("TraceId"),
        F.col("id").cast("string").alias("SpanId"),
        F.when(F.col("id") == 0, "").when(F.col("id") % 3 == 0, "0").otherwise("").alias("ParentSpanId"),
        F.lit("op").alias("SpanName"), F.lit("s").alias("ServiceName"), F.lit(1).cast("bigint").alias("Duration"),
        F.lit(T0).cast("timestamp_ntz").alias("Timestamp"),
    )
    tree = traces.span_tree(df)
    assert tree.count() == 9000
    assert tree.filter("SpanId = '0'").first()["n_children"] == 2999
    assert rows(traces.service_edges(df)) == [("s", "s", 2999, 2999)]


def test_logs_outside_traces_stay(spark):
    logs = spark.createDataFrame([(1, "t", "1", "a", 1), (2, "", "1", "b", 2), (3, "t", "x", "c", 3)],
                                 "id int, TraceId string, SpanId string, Body string, Timestamp_ns bigint")
    sp = spans(spark, ("t", "1", "", "root", "a", 100), ("", "1", "", "no", "a", 1)).withColumn("StatusCode", F.lit("Ok"))
    got = {r["id"]: r["SpanName"] for r in traces.logs_for_traces(logs, sp, "left").collect()}
    assert got == {1: "root", 2: None, 3: None}
    assert [r["id"] for r in traces.logs_for_traces(logs, sp).collect()] == [1]


def test_attr_profile_hot_key(spark):
    df = spark.range(3000).select(F.create_map(F.lit("all"), (F.col("id") % 500).cast("string"), F.lit("one"), F.lit("x")).alias("LogAttributes"))
    assert sorted(rows(aggregates.attr_profile(df))) == [("all", 3000, 500), ("one", 3000, 1)]


def test_skewed_lookups_are_split(spark, sf_dir):
    """A hot span: adaptive execution cuts its partition, and the result stays whole."""
    from tlake.session import settings

    n = 60000
    logs = spark.range(0, n, 1, 8).select(
        F.col("id"), F.lit("t").alias("TraceId"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("SpanId"),
        F.sha2(F.col("id").cast("string"), 512).alias("Body"), F.col("id").alias("Timestamp_ns"),
    )
    sp = spark.range(0, n, 1, 8).select(
        F.lit("t").alias("TraceId"), F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("SpanId"),
        F.sha2(F.col("id").cast("string"), 512).alias("SpanName"), F.lit("s").alias("ServiceName"),
        F.lit(1).alias("Duration"), F.lit("Ok").alias("StatusCode"),
    )
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    with settings(spark, conf):
        for how in ("inner", "left"):
            df = traces.logs_for_traces(logs, sp, how)
            got = df.collect()
            assert len(got) == n and all(r["SpanName"] for r in got)
            assert "skewed" in df._jdf.queryExecution().executedPlan().toString()


def started(spark, points, temporality=2):
    """(series, start second, second, value)"""
    ns = lambda s: int((T0.timestamp() + s) * 1e9) if s is not None else 0
    data = [("s", "m", {"k": k}, T0 + timedelta(seconds=t), ns(t), ns(s), float(v), temporality, True) for k, s, t, v in points]
    return spark.createDataFrame(data, "ServiceName string, MetricName string, Attributes map<string,string>, TimeUnix timestamp_ntz, "
                                       "TimeUnix_ns bigint, StartTimeUnix_ns bigint, Value double, AggregationTemporality int, IsMonotonic boolean")


def shared_out(points, temporality, width=3600):
    """Plain version: increase per (series, hour)."""
    out, last = {}, {}

    def add(k, begin, end, amount):
        for hour in range(int(begin // width), int(end // width) + 1):
            part = 1.0 if begin == end else (min(end, (hour + 1) * width) - max(begin, hour * width)) / (end - begin)
            out[k, hour] = out.get((k, hour), 0.0) + amount * part

    for k, s, t, v in sorted(points, key=lambda p: (p[0], p[2], p[1] or 0)):
        if temporality == 1:
            add(k, s if s is not None and s < t else t, t, v)
            continue
        if k in last:
            s0, t0, v0 = last[k]
            restart = s0 is not None and s is not None and s > s0
            begin = min(max(t0, s), t) if restart else t0
            add(k, begin, t, v if restart or v < v0 else v - v0)
        else:
            add(k, t, t, 0.0)
        last[k] = (s, t, v)
    return out


@pytest.mark.parametrize("temporality", [1, 2])
def test_restarts_and_shares_equal_plain_code(spark, temporality):
    rnd = random.Random(7)
    points = []
    for k in "abcd":
        start, value, at = rnd.randrange(100), 0, 100
        for _ in range(60):
            at += rnd.choice((1, 20, 400, 9000))
            if rnd.random() < 0.2:
                start, value = at - rnd.randrange(1, 50), rnd.randrange(1000)  # may overtake the old value
            value += rnd.randrange(50)
            points.append((k, None if k == "d" else start, at, value if temporality == 2 else rnd.randrange(9)))
    want = shared_out(points, temporality)
    for width in ("1 minute", "1 hour"):
        got = {(r["attr_key"].split('"')[7], int((r["bucket"] - T0).total_seconds()) // 3600): r["increase"]
               for r in metrics.counter_rate_by_start(started(spark, points, temporality), "1 hour", width).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_steps_by_start_are_not_aggregated_by_sorting(spark, capsys):
    """Slices are found in the sorted points; tasks get 16 MB of what was shuffled."""
    metrics.counter_rate_by_start(started(spark, [("a", 1, 10, 5), ("a", 1, 20, 9)])).explain()
    assert "SortAggregate" not in capsys.readouterr().out
    assert prepare(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_points_of_one_time_and_value_open_and_close_a_slice(spark):
    same = [("a", 1, 3600, 5), ("a", 1, 3600, 5), ("a", 1, 7300, 8), ("a", 1, 7300, 8), ("b", 1, 50, 4), ("b", 1, 60, 4), ("b", 1, 4000, 6)]
    got = {(r["attr_key"].split('"')[7], (r["bucket"] - T0).total_seconds() // 3600): (r["increase"], r["n"])
           for r in metrics.counter_rate_by_start(started(spark, same), "1 hour").collect()}
    assert [n for _, n in got.values()].count(2) == 3 and abs(sum(x for (k, _), (x, _) in got.items() if k == "a") - 3) < 1e-9
    assert abs(sum(x for (k, _), (x, _) in got.items() if k == "b") - 2) < 1e-9


def test_restart_that_overtakes_the_old_value(spark):
    inc = lambda pts: sum(r["increase"] for r in metrics.counter_rate_by_start(started(spark, pts)).collect())
    assert inc([("a", 1, 10, 5), ("a", 1, 20, 9), ("a", 25, 30, 12)]) == 4 + 12
    assert inc([("a", None, 10, 5), ("a", None, 20, 9), ("a", None, 30, 12)]) == 7


def mixed(spark, layouts):
    data = [("s", "m", T0, [int(c) for c in counts], [float(b) for b in bounds]) for bounds, counts in layouts]
    return spark.createDataFrame(data, "ServiceName string, MetricName string, TimeUnix timestamp_ntz, BucketCounts array<bigint>, ExplicitBounds array<double>")


def test_merged_bounds_keep_all_counts(spark):
    rnd = random.Random(2)
    for _ in range(4):
        layouts = []
        for _ in range(5):
            bounds = sorted(rnd.sample(range(-20, 100), rnd.randrange(0, 6)))
            layouts.append((bounds, [rnd.randrange(20) for _ in range(len(bounds) + 1)]))
        df = mixed(spark, layouts).select("ServiceName", "ExplicitBounds", F.posexplode("BucketCounts").alias("i", "c"))
        merged = metrics.merge_bounds(df, ["ServiceName"]).collect()
        assert abs(sum(r["c"] for r in merged) - sum(sum(c) for _, c in layouts)) < 1e-9
        all_bounds = sorted({float(b) for bounds, _ in layouts for b in bounds})
        inner = [(r["lo"], r["hi"]) for r in merged if r["hi"] is not None and r["lo"] < r["hi"]]
        assert all(not any(lo < b < hi for b in all_bounds) for lo, hi in inner)


def test_mixed_bounds_by_hand(spark):
    df = mixed(spark, [([10, 20], [4, 0, 0]), ([5, 20], [0, 6, 2])])
    # 5..20 holds 6: 2 of them up to 10; 0..10 holds 4: 2 up to 5. Refined: 2, 4, 4, open 2.
    value = lambda q: metrics.histogram_quantile_mixed(df, q).first()
    assert value(0.5)["n"] == 12
    assert abs(value(0.5)["quantile"] - 10.0) < 1e-9
    assert abs(value(2 / 12)["quantile"] - 5.0) < 1e-9
    assert value(0.99)["quantile"] == 20.0
    assert metrics.histogram_quantile_mixed(df.limit(0), 0.5).collect() == []


def plain_roots(parents):
    out = {}
    for trace, span in parents:
        seen, at = [], span
        while True:
            seen.append(at)
            above = parents[trace, at]
            if above == "" or (trace, above) not in parents:
                out[trace, span] = (at, len(seen) - 1, "rooted" if above == "" else "orphan")
                break
            if above in seen:
                out[trace, span] = ("", -1, "cycle")
                break
            at = above
    return out


def test_span_roots_equal_plain_walk(spark):
    rnd = random.Random(11)
    parents = {("chain", f"c{i}"): f"c{i - 1}" if i else "" for i in range(1000)}
    parents |= {("lost", f"l{i}"): f"l{i - 1}" if i else "gone" for i in range(300)}
    parents |= {("ring", f"r{i}"): f"r{(i + 1) % 7}" for i in range(7)}
    parents |= {("ring", f"h{i}"): f"r{i % 7}" if i < 20 else f"h{i - 20}" for i in range(60)}
    parents[("self", "x")] = "x"
    for t in range(30):
        n = rnd.randrange(1, 40)
        parents |= {(f"t{t}", f"s{i}"): rnd.choice(["", "none", *[f"s{j}" for j in range(n)]]) for i in range(n)}
    data = [(t, s, p) for (t, s), p in parents.items()]
    data += data[:50] + [("", "no", "trace")]
    got = traces.span_roots(spark.createDataFrame(data, "TraceId string, SpanId string, ParentSpanId string"))
    assert {(r["TraceId"], r["SpanId"]): (r["root"], r["depth"], r["state"]) for r in got.collect()} == plain_roots(parents)
    assert got.count() == len(parents)
    assert traces.span_roots(got.limit(0).withColumn("ParentSpanId", F.lit(""))).collect() == []
