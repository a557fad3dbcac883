"""Tables on two tiers: moves, compaction, reports, plans."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tlake import schemas
from tlake.functions import map_text
from tlake.operators import transforms, views
from tlake.operators.flatten import log_rows
from tlake.plans import apply_moves, compact, inventory, plan_moves, reports, textindex, vacuum
from tlake.plans import lake as lake_module
from tlake.plans.inventory import inventories
from tlake.plans.lifecycle import _fingerprint
from workload import fixtures as fx


def count(df):
    return {(str(r[0]), r[1]): r[2] for r in df.groupBy("event_date", "tier").count().collect()}


def plan_text(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def logs(spark, sf_dir, lake):
    lake.write(fx.logs(spark, sf_dir), "otel_logs")
    return lake


def test_create_tables_never_drops(logs):
    n = logs.scan("otel_logs").count()
    logs.create_tables()
    assert n == logs.scan("otel_logs").count() > 0
    assert set(os.listdir(logs.hot_root)) >= set(schemas.TABLES)


def test_rows_come_back_whole(spark, sf_dir, logs):
    src = logs.table_rows(fx.logs(spark, sf_dir), "otel_logs")
    assert _fingerprint(src) == _fingerprint(logs.scan("otel_logs", materialized=True))


def test_scan_is_the_same_before_during_and_after_a_move(logs):
    before = _fingerprint(logs.scan("otel_logs"))
    out = apply_moves(logs, "otel_logs", "2024-02-05 12:00:00")
    assert out["days"] > 0
    # The old files are still there, next to the new ones.
    assert _fingerprint(logs.scan("otel_logs")) == before
    tiers = count(logs.scan("otel_logs"))
    assert {t for _, t in tiers} == {"hot", "cold"}
    assert vacuum(logs, "otel_logs") > 0
    assert _fingerprint(logs.scan("otel_logs")) == before
    assert count(logs.scan("otel_logs")) == tiers
    assert apply_moves(logs, "otel_logs", "2024-02-05 12:00:00")["days"] == 0


def test_late_rows_of_a_moved_day_are_seen_and_move_too(spark, sf_dir, logs):
    n = logs.scan("otel_logs").count()
    apply_moves(logs, "otel_logs", "2024-02-05 12:00:00")
    late = fx.logs(spark, sf_dir).filter(F.to_date("Timestamp") == F.lit("2024-01-02").cast("date"))
    m = late.count()
    logs.write(late, "otel_logs")
    assert logs.scan("otel_logs").count() == n + m
    apply_moves(logs, "otel_logs", "2024-02-05 12:00:00")
    got = count(logs.scan("otel_logs"))
    assert got[("2024-01-02", "cold")] == 2 * m and ("2024-01-02", "hot") not in got


def test_a_lost_commit_changes_nothing(logs, monkeypatch):
    before = _fingerprint(logs.scan("otel_logs"))
    base = logs.manifest("otel_logs")
    logs.commit("otel_logs", base, [], [])
    with pytest.raises(FileExistsError):
        logs.commit("otel_logs", base, [["cold", "2024-01-01", "m-x"]], [])
    monkeypatch.setattr(logs, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        apply_moves(logs, "otel_logs", "2024-02-05 12:00:00")
    assert _fingerprint(logs.scan("otel_logs")) == before


def test_compact(spark, sf_dir, logs):
    for _ in range(3):
        logs.write(fx.logs(spark, sf_dir), "otel_logs", tasks=3)
    before = _fingerprint(logs.scan("otel_logs"))
    day = F.col("event_date") == F.lit("2024-01-10").cast("date")
    assert inventory(logs, "otel_logs").filter(day).count() > 4
    compact(logs, "otel_logs", "2024-01-10")
    assert inventory(logs, "otel_logs").filter(day).count() == 1
    assert _fingerprint(logs.scan("otel_logs")) == before
    vacuum(logs, "otel_logs")
    assert _fingerprint(logs.scan("otel_logs")) == before


def test_files_are_sorted_by_the_table_key(logs):
    import pyarrow.parquet as pq

    path = inventory(logs, "otel_logs").first()["path"].replace("file:", "")
    t = pq.read_table(path, columns=["ServiceName", "Timestamp_ns"], partitioning=None).to_pylist()
    keys = [(r["ServiceName"], r["Timestamp_ns"]) for r in t]
    assert keys == sorted(keys)
    col = pq.ParquetFile(path).metadata.row_group(0)
    by_name = {col.column(i).path_in_schema: col.column(i) for i in range(col.num_columns)}
    assert by_name["Timestamp"].compression == "ZSTD"
    assert by_name["Timestamp"].statistics.has_min_max and by_name["ServiceName"].has_dictionary_page
    assert "DELTA_BINARY_PACKED" in by_name["Timestamp_ns"].encodings


def test_repeated_write_of_a_segment_replaces_it(spark, sf_dir, lake):
    for _ in range(2):
        lake.write(fx.logs(spark, sf_dir), "otel_logs", "a-batch-1", tasks=2)
    assert lake.scan("otel_logs").count() == fx.events(spark, sf_dir).count()


def test_large_shards_are_written_by_several_tasks(spark, sf_dir, lake, monkeypatch):
    """Without more tasks the rows are on the same shards, and those of nulls count as well."""
    logs = fx.logs(spark, sf_dir).withColumn("Body", F.when(F.col("event_id") % 2 == 0, F.col("Body")))
    shard = lambda: lake_module.shard_of(F.col("_metadata.file_path"), 3)
    dealt = lambda seg: sorted(rows(lake.files("otel_logs", "hot").filter(F.col("seg") == seg).select(shard(), "SpanId")))
    files = lambda seg: inventory(lake, "otel_logs").filter(F.col("seg") == seg)
    task = F.regexp_extract("path", r"/part-(\d+)-", 1).cast("int")
    one, other = lake.write(logs, "otel_logs", "a-one", tasks=3, seed=5), "a-other"
    assert files(one).agg(F.max(task)).first()[0] == 2
    monkeypatch.setattr(lake_module, "SHARD_TASK_BYTES", 20_000)
    lake.write(logs, "otel_logs", other, tasks=3, seed=5)
    assert files(other).agg(F.max(task)).first()[0] > 5
    assert dealt(one) == dealt(other) and len(dealt(one)) == logs.count()
    even = lake.write(logs, "otel_logs", tasks=3)
    n = [r["rows"] for r in reports.balance_report(files(even), lake_module.shard_of("path", 3)).collect()]
    assert len(n) == 3 and sum(n) == logs.count() and max(n) < 1.1 * min(n)


def test_a_half_written_segment_does_not_count(spark, sf_dir, lake):
    lake.write(fx.logs(spark, sf_dir), "otel_logs", "a-whole")
    n, files = lake.scan("otel_logs").count(), inventory(lake, "otel_logs").count()
    lake.write(fx.logs(spark, sf_dir), "otel_logs", "a-half")
    os.remove(f"{lake.path('otel_logs')}/seg=a-half/_SUCCESS")
    assert lake.scan("otel_logs").count() == n and inventory(lake, "otel_logs").count() == files
    lake.write(fx.logs(spark, sf_dir), "otel_logs", "a-half")
    assert lake.scan("otel_logs").count() == 2 * n


def test_metric_tables_sort_by_attributes(spark, sf_dir, lake):
    import pyarrow.parquet as pq

    lake.write_metrics(fx.metrics(spark, sf_dir))
    path = inventory(lake, "otel_metrics_gauge").first()["path"].replace("file:", "")
    t = pq.read_table(path, columns=["ServiceName", "MetricName", "Attributes", "TimeUnix_ns"], partitioning=None).to_pylist()
    keys = [(r["ServiceName"], r["MetricName"], sorted(r["Attributes"]), r["TimeUnix_ns"]) for r in t]
    assert keys == sorted(keys) and len(keys) > 10
    u = lake.scan_metrics()
    assert u.select("kind").distinct().count() == 5
    assert lake.scan_metrics(["gauge"]).count() == fx.events(spark, sf_dir).count()


def test_ttl_boundary_is_inclusive_at_second_precision(spark):
    base = dict(table="t", tier="hot", rows=1, compressed_bytes=1, uncompressed_bytes=1, file_bytes=1)
    at = {"in": "2024-01-06 12:00:00.9", "out": "2024-01-06 12:00:01"}
    data = [
        {**base, "event_date": datetime(2024, 1, i + 1).date(), "seg": "a-1", "path": k,
         "min_time": datetime.fromisoformat(t), "max_time": datetime.fromisoformat(t)}
        for i, (k, t) in enumerate(at.items())
    ]
    inv = spark.createDataFrame(data, schemas.INVENTORY)
    got = plan_moves(inv, "2024-02-05 12:00:00").collect()
    assert [(r["event_date"].day, r["reason"]) for r in got] == [(1, "ttl")]


def test_newest_row_decides_for_the_whole_day(spark):
    base = dict(table="t", tier="hot", event_date=datetime(2024, 1, 1).date(), rows=1, compressed_bytes=1,
                uncompressed_bytes=1, file_bytes=1, path="p")
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 1, 23)
    inv = spark.createDataFrame([{**base, "seg": "a-1", "min_time": old, "max_time": old},
                                 {**base, "seg": "a-2", "min_time": new, "max_time": new}], schemas.INVENTORY)
    assert plan_moves(inv, "2024-01-31 12:00:00").count() == 0
    assert plan_moves(inv, "2024-01-31 23:00:00").count() == 2


def test_space_and_size_rules(spark):
    def f(day, size, seg="a-1"):
        t = datetime(2024, 1, day)
        return dict(table="t", tier="hot", event_date=t.date(), seg=seg, path=f"{day}{seg}", rows=1, compressed_bytes=size,
                    uncompressed_bytes=size, file_bytes=size, min_time=t, max_time=t)

    inv = spark.createDataFrame([f(1, 30), f(2, 30), f(3, 30), f(4, 5), f(4, 200, "a-2")], schemas.INVENTORY)
    got = {(r["event_date"].day, r["seg"]): r["reason"] for r in plan_moves(inv, "2024-01-05", 100, max_hot_bytes=100).collect()}
    # 95 stay after the size rule; 70 are allowed: the oldest day goes, 65 remain.
    assert got == {(4, "a-2"): "size", (1, "a-1"): "space"}
    assert plan_moves(inv, "2024-01-05", 1000, max_hot_bytes=1000).count() == 0


def test_free_space_is_judged_over_all_tables(spark, sf_dir, logs):
    logs.write(fx.logs(spark, sf_dir), "sessions")
    used = inventories(logs, ["otel_logs", "sessions"]).agg(F.sum("file_bytes")).first()[0]
    # Each table alone would fit; both together leave no room.
    before = _fingerprint(logs.scan("otel_logs"))
    out = apply_moves(logs, ["otel_logs", "sessions"], "2024-01-31", hot_capacity_bytes=used)
    assert out["otel_logs"]["days"] > 0 and out["sessions"]["days"] > 0
    hot = inventories(logs, ["otel_logs", "sessions"]).filter("tier = 'hot'").agg(F.sum("file_bytes")).first()[0]
    assert hot <= 0.7 * used
    assert _fingerprint(logs.scan("otel_logs")) == before
    assert apply_moves(logs, "otel_logs", "2024-01-31", hot_capacity_bytes=2 * used)["days"] == 0


def test_inventory_and_reports(spark, sf_dir, logs):
    n = fx.events(spark, sf_dir).count()
    inv = inventories(logs, ["otel_logs", "sessions"])
    assert set(inv.columns) == set(schemas.INVENTORY.names)
    r = reports.compression_report(inv).first()
    assert r["rows"] == n and r["compress_ratio"] > 1 and "iB" in r["compressed"]
    assert reports.tier_report(inv).first()["tier"] == "hot"
    assert reports.cold_count(inv).first()["n"] == 0
    apply_moves(logs, "otel_logs", "2024-02-05 12:00:00")
    assert reports.cold_count(inventory(logs, "otel_logs")).first()["n"] > 0
    assert inventory(logs, "otel_logs").agg(F.sum("rows")).first()[0] == n
    assert reports.balance_report(inventory(logs, "otel_logs")).count() > 1


def test_get_trace_reads_only_its_days(spark, sf_dir, lake):
    lake.write_spans(fx.spans(spark, sf_dir))
    tid = fx.spans(spark, sf_dir).first()["TraceId"]
    df = lake.get_trace(tid)
    assert df.count() == 8
    assert lake.get_trace("nope").count() == 0
    plan = plan_text(df)
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    ids = spark.createDataFrame([(tid,)], "TraceId string")
    assert lake.get_traces(ids).count() == 8
    # The range table can be compacted and moved like the others.
    before = sorted(rows(lake.trace_ranges()))
    apply_moves(lake, schemas.TRACE_RANGES, "2024-02-05 12:00:00")
    vacuum(lake, schemas.TRACE_RANGES)
    assert sorted(rows(lake.trace_ranges())) == before


def test_one_bad_time_does_not_unfold_days(spark, lake):
    """A trace with a span at the epoch: its range is long, but nothing grows with it."""
    cols = [c for c in schemas.TABLES["otel_traces"].names]
    base = fx_span(spark, cols)
    lake.write_spans(base)
    assert lake.get_traces(spark.createDataFrame([("t",)], "TraceId string")).count() == 2
    assert lake.get_trace("t").count() == 2
    assert views.sessions_view(lake.scan("sessions"), "2024-01-01").count() == 0


def fx_span(spark, cols):
    from tlake.functions import from_unix_nanos

    df = spark.createDataFrame([("t", "1", 0), ("t", "2", 1704067200000000000), ("u", "3", 1704067200000000000)],
                               "TraceId string, SpanId string, Timestamp_ns bigint")
    df = df.withColumn("Timestamp", from_unix_nanos("Timestamp_ns"))
    for f in schemas.TABLES["otel_traces"].fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*cols)


def test_plans(spark, sf_dir, logs):
    """Day pruning, pushed filters, column pruning, no Python on the row path."""
    df = logs.scan("otel_logs", start="2024-01-10", end="2024-01-11").filter(F.col("ServiceName") == "svc-1").select("Body")
    plan = plan_text(df)
    hot = plan.split("FileScan")[1]
    assert "event_date" in hot.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(ServiceName,svc-1)" in hot
    schema = hot.split("ReadSchema: ")[1].split(">")[0]
    assert "Body" in schema and "ResourceAttributes" not in schema
    only = logs.scan("otel_logs").filter(F.col("tier") == "cold").select("Body")
    assert plan_text(only).split("Initial Plan")[0].count("FileScan") <= 1
    for name in ("enrich_pods", "span_tree", "counter_rate", "otlp_spans", "container_log_merge"):
        from workload.queries import REGISTRY

        text = plan_text(REGISTRY[name](spark, sf_dir))
        assert "Python" not in text and "Pandas" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_jobs(spark, sf_dir, tmp_path, capsys):
    from tlake import jobs
    from tlake.plans import Lake

    roots = ["--hot", f"{tmp_path}/hot", "--cold", f"{tmp_path}/cold"]
    run = lambda *a: jobs.main([*a, *roots], spark)
    run("create")
    fx.span_requests(fx.spans(spark, sf_dir)).write.text(f"{tmp_path}/in")
    run("ingest", "--traces", f"{tmp_path}/in", "--checkpoint", f"{tmp_path}/cp", "--once")
    table = ["--table", "otel_traces"]
    run("move", *table, "--as-of", "2024-02-05 12:00:00")
    run("compact", *table, "--day", "2024-01-20")
    run("compact", *table, "--min-segments", "1")
    run("vacuum", *table)
    run("report", *table)
    assert "otel_traces" in capsys.readouterr().out
    lake = Lake(spark, f"{tmp_path}/hot", f"{tmp_path}/cold")
    assert lake.scan("otel_traces").count() == fx.events(spark, sf_dir).count()
    assert lake.scan("otel_traces", tier="cold").count() > 0


def test_scan_from_a_computed_time(spark, sf_dir, logs):
    newest = logs.scan("otel_logs").agg(F.max("Timestamp")).scalar()
    n = logs.scan("otel_logs", start=newest - F.expr("INTERVAL 1 HOUR")).count()
    ev = fx.events(spark, sf_dir)
    top = ev.agg(F.max("ts")).first()[0]
    assert n == ev.filter(F.col("ts") >= F.lit(str(top)).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")).count() > 0


def test_checksum_sees_every_column(spark, sf_dir, lake):
    """Changing one value anywhere, in maps and nested lists too, changes the checksum."""
    df = lake.table_rows(fx.spans(spark, sf_dir), "otel_traces")
    whole = _fingerprint(df)
    first = F.col("SpanId") == df.agg(F.min("SpanId")).first()[0]
    for c, new in {
        "SpanName": F.lit("?"), "Duration": F.col("Duration") + 1, "SpanAttributes": F.create_map(F.lit("k"), F.lit("?")),
        "Events": F.array(F.struct(F.col("Timestamp"), F.col("Timestamp_ns"), F.lit("e").alias("Name"), F.create_map(F.lit("a"), F.lit("?")).alias("Attributes"))),
    }.items():
        assert _fingerprint(df.withColumn(c, F.when(first, new).otherwise(F.col(c)))) != whole


def scanned_rows(df):
    """Rows that the scans of a finished query gave on, after row groups and pages were skipped."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name.startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def session_logs(spark, n=40_000, per_session=100):
    return log_rows(
        spark.range(n).withColumn("s", F.concat(F.lit("s-"), F.xxhash64(F.expr(f"id div {per_session}")).cast("string"))),
        {"Timestamp_ns": F.col("id") * 1_000_000 + 1704067200 * 10**9, "ServiceName": F.lit("web"), "Body": F.concat(F.lit("row "), F.col("id").cast("string")),
         "LogAttributes": F.create_map(F.lit("sessionId"), F.col("s"), F.lit("log_type"), F.lit("web"))},
    )


def test_promoted_attribute_skips_row_groups(spark, lake):
    logs = session_logs(spark)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(64 << 10))  # some hundred row groups
    try:
        lake.write(logs.coalesce(1), "sessions", tasks=1)
    finally:
        hadoop.unset("parquet.block.size")
    wanted = logs.select(map_text("LogAttributes", "sessionId").alias("v")).first()["v"]
    plain = lake.scan("sessions").filter(map_text("LogAttributes", "sessionId") == wanted)
    fast = lake.scan("sessions", attrs={"sessionId": wanted}).select("Body", "LogAttributes")
    assert sorted(r["Body"] for r in fast.collect()) == sorted(r["Body"] for r in plain.collect()) and fast.count() == 100
    assert "EqualTo(attr_sessionId" in fast._jdf.queryExecution().toString()
    assert scanned_rows(fast) < 0.1 * 40_000
    assert scanned_rows(plain.select("Body", "LogAttributes")) == 40_000
    assert lake.scan("sessions").columns == lake.scan("sessions", attrs={"other": ""}).columns


def test_promoted_condition_on_files_without_the_column(spark, lake, monkeypatch):
    logs = session_logs(spark, 300)
    monkeypatch.setattr(schemas, "PROMOTED", {})
    lake.write(logs, "otel_logs")
    monkeypatch.undo()
    lake.write(logs, "otel_logs")
    one = logs.select(map_text("LogAttributes", "sessionId")).first()[0]
    assert lake.scan("otel_logs", attrs={"sessionId": one, "log_type": "web"}).count() == 200
    assert lake.scan("otel_logs", attrs={"sessionId": ""}).count() == 0
    assert lake.scan("otel_logs", resource={"k8s.pod.name": ""}).count() == 600


def test_text_index_gives_the_rows_of_the_scan(spark, lake, tmp_path):
    index = f"{tmp_path}/index"
    words = ["Ünïcode ǅ İstanbul", "plain text", "a", "", "日本語のログ", "Error 4711 in module"]
    rows_ = spark.createDataFrame([(i, words[i % 6] + ("" if i % 6 in (2, 3) else f" no{i}")) for i in range(600)], "i int, Body string")
    logs = log_rows(rows_, {"Timestamp_ns": (F.col("i") % 30).cast("bigint") * 86_400 * 10**9, "Body": F.col("Body")})
    queries = ["no123", "NO12", "error 4711 in", "日本語", "本", "", "a", "İstanbul", "nowhere to be found", "ünï"]
    same = lambda text: sorted(r["Body"] for r in textindex.search_files(lake, "otel_logs", index, text).collect()) == sorted(
        r["Body"] for r in transforms.search(lake.scan("otel_logs"), text).collect())
    lake.write(logs, "otel_logs")
    assert same("no123")  # no index yet
    textindex.update_text_index(lake, "otel_logs", index)
    lake.write(logs, "otel_logs")
    assert all(same(q) for q in queries)
    textindex.update_text_index(lake, "otel_logs", index)
    assert all(same(q) for q in queries)
    rare = textindex.search_report(lake, "otel_logs", index, "no124").first()
    assert rare["files"] == 60 and rare["hold"] == 2 and rare["missed"] == 0 and rare["false_share"] < 0.1
    short = textindex.search_report(lake, "otel_logs", index, "no").first()
    assert short["opened"] == 60 and short["missed"] == 0
    n = spark.read.parquet(f"{index}/*").count()
    textindex.update_text_index(lake, "otel_logs", index)  # nothing new
    assert spark.read.parquet(f"{index}/*").count() == n


def test_text_index_sorts_no_runs(spark, lake, capsys):
    """Runs are put together in words by hash tables before anything is sorted, and give the bitmaps that the runs give."""
    texts = spark.range(3000).select(
        F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("日本 "), F.md5((F.col("id") % 500).cast("string")))).alias("Body"),
    )
    made = textindex.bitmaps(texts, "Body")
    made.explain()
    shown = capsys.readouterr().out
    assert shown.count("HashAggregate(keys=[file") >= 2 and shown.rindex("Sort ") < shown.index("HashAggregate(keys=[file")
    place = F.explode(textindex._runs(F.col("Body")))
    plain = texts.select("file", place.alias("p")).groupBy("file", F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    assert sorted(rows(made.select("file", "bucket", F.hex("bits")))) == sorted(rows(plain.select("file", "bucket", F.hex("bits"))))


def test_text_index_opens_only_candidates(spark, lake, tmp_path):
    index = f"{tmp_path}/index"
    logs = log_rows(spark.range(2000), {"Timestamp_ns": (F.col("id") % 40) * 86_400 * 10**9, "Body": F.concat(F.lit("entry "), F.md5(F.col("id").cast("string")))})
    lake.write(logs, "otel_logs")
    textindex.update_text_index(lake, "otel_logs", index)
    one = logs.first()["Body"]
    found = textindex.search_files(lake, "otel_logs", index, one).select("Body")
    assert [r["Body"] for r in found.collect()] == [one]
    assert scanned_rows(found) <= 100  # of 2,000: the file of one day, and at most one opened for nothing
