"""Batch and stream give the same tables; batches can be repeated."""

import gzip
import json
import pathlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tlake import schemas, session
from tlake.functions import map_text
from tlake.operators.flatten import archive_logs, log_rows, otlp_to_logs
from tlake.operators.transforms import fix_time, set_log_type, split_sessions
from tlake.plans import inventory, reports
from tlake.sources import read_otlp_logs
from tlake.streaming import fan_out, otlp_requests, pipelines, write_otlp_archive
from workload import fixtures as fx
from workload.queries import REGISTRY

COLS = ["Timestamp_ns", "TraceId", "SpanId", "ServiceName", "Body", "SeverityText"]


def archive(spark, sf_dir, tmp_path):
    write_otlp_archive(fx.logs(spark, sf_dir), f"{tmp_path}/in", "otel")
    return f"{tmp_path}/in/otel"


def test_stream_equals_batch(spark, sf_dir, lake, tmp_path):
    src = archive(spark, sf_dir, tmp_path)
    pipelines.logs(spark, src, lake, f"{tmp_path}/out", f"{tmp_path}/cp", None, fx.AS_OF).awaitTermination()
    pipelines.sessions(spark, src, lake, f"{tmp_path}/cp", None, fx.AS_OF).awaitTermination()
    batch = fix_time(otlp_to_logs(read_otlp_logs(spark, src)), fx.AS_OF)
    plain, sess = split_sessions(batch)
    kind = map_text("LogAttributes", "log_type")
    assert sorted(rows(lake.scan("otel_logs").select(*COLS, kind))) == sorted(rows(set_log_type(plain, "otel").select(*COLS, kind)))
    assert sorted(rows(lake.scan("sessions").select(*COLS))) == sorted(rows(sess.select(*COLS)))
    # Both sinks hold the same records.
    assert archive_logs(read_otlp_logs(spark, f"{tmp_path}/out/otel")).count() == lake.scan("otel_logs").count()


def test_new_files_only_and_many_batches(spark, sf_dir, lake, tmp_path):
    src = archive(spark, sf_dir, tmp_path)
    run = lambda: pipelines.logs(
        spark, src, lake, f"{tmp_path}/out", f"{tmp_path}/cp", None, fx.AS_OF, maxFilesPerTrigger="1")
    run().awaitTermination()
    n = lake.scan("otel_logs").count()
    run().awaitTermination()
    assert lake.scan("otel_logs").count() == n
    write_otlp_archive(fx.logs(spark, sf_dir), f"{tmp_path}/in", "otel")
    run().awaitTermination()
    assert lake.scan("otel_logs").count() == 2 * n


def test_failed_batch_is_repeated_without_duplicates(spark, sf_dir, lake, tmp_path):
    src = archive(spark, sf_dir, tmp_path)
    rows_ = split_sessions(fix_time(otlp_to_logs(read_otlp_logs(spark, src, streaming=True)), fx.AS_OF))[0]
    from tlake.streaming.sinks import table_sink

    first = table_sink(lake, "otel_logs", "x")
    state = {"fail": True}

    def second(df, batch_id):
        if state["fail"]:
            raise RuntimeError("sink down")

    q = fan_out(rows_, [first, second], f"{tmp_path}/cp", "x", None)
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001
        pass
    state["fail"] = False
    fan_out(rows_, [first, second], f"{tmp_path}/cp", "x", None).awaitTermination()
    assert lake.scan("otel_logs").count() == fx.logs(spark, sf_dir).filter(~F.map_contains_key("LogAttributes", "sessionId")).count()


def test_rejected_lines_are_counted(spark, sf_dir, lake, tmp_path):
    src = archive(spark, sf_dir, tmp_path)
    (tmp_path / "in" / "otel" / "bad.json").write_text("{broken\nnot json\n")
    q = pipelines.logs(spark, src, lake, f"{tmp_path}/out", f"{tmp_path}/cp", None, fx.AS_OF)
    q.awaitTermination()
    got = dict(rows(reports.ingest_counters(reports.counter_rows(spark, pipelines.counters(f"{tmp_path}/cp")))))
    assert got["RejectedInserts"] == 2
    assert got["InsertedRows"] == lake.scan("otel_logs").count() and got["InsertedBytes"] > 0
    assert list(got) == sorted(reports.COUNTERS)


def test_traces_and_metrics(spark, sf_dir, lake, tmp_path):
    fx.span_requests(fx.spans(spark, sf_dir)).write.text(f"{tmp_path}/t")
    pipelines.traces(spark, f"{tmp_path}/t", lake, f"{tmp_path}/cp", None).awaitTermination()
    assert lake.scan("otel_traces").count() == fx.events(spark, sf_dir).count()
    assert lake.trace_ranges().count() == lake.scan("otel_traces").select("TraceId").distinct().count()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.prom").write_text("# TYPE up gauge\nup 1\n# TYPE c counter\nc 2\n")
    pipelines.scraped_metrics(spark, f"{tmp_path}/p", lake, f"{tmp_path}/cp", "job", None).awaitTermination()
    assert lake.scan("otel_metrics_gauge").count() == lake.scan("otel_metrics_sum").count() == 1


def test_journal_pipeline_sets_both_types(spark, lake, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"__REALTIME_TIMESTAMP": "1704067200000000", "MESSAGE": "m"}))
    pods = spark.createDataFrame([], schemas.PODS)
    pipelines.journal(spark, f"{tmp_path}/j", pods, f"{tmp_path}/out", f"{tmp_path}/cp", trigger=None).awaitTermination()
    r = otlp_to_logs(read_otlp_logs(spark, f"{tmp_path}/out/journal")).first()
    assert r["LogAttributes"]["log_type"] == r["ResourceAttributes"]["log_type"] == "journal"


def test_two_checkpoints_keep_all_rows(spark, sf_dir, lake, tmp_path):
    """A new checkpoint starts again at batch 0 and must not write over what another one stored."""
    src = archive(spark, sf_dir, tmp_path)
    for cp in ("a", "b"):
        pipelines.logs(spark, src, lake, f"{tmp_path}/out", f"{tmp_path}/{cp}", None, fx.AS_OF).awaitTermination()
    once = split_sessions(fix_time(otlp_to_logs(read_otlp_logs(spark, src)), fx.AS_OF))[0].count()
    assert lake.scan("otel_logs").count() == 2 * once
    assert archive_logs(read_otlp_logs(spark, f"{tmp_path}/out/otel")).count() == 2 * once


def test_rejected_lines_are_kept_once(spark, sf_dir, lake, tmp_path, monkeypatch):
    """Broken lines of a batch that is repeated, and of a later one, with their files and reasons."""
    from tlake.streaming import sinks

    src = tmp_path / "in"
    src.mkdir()
    good = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"1704067200000000000","body":{"stringValue":"x"}}]}]}]}'
    (src / "a.json").write_text(f'{good}\n{{"broken\n\n[]\n{{"resourceLogs":"text"}}\n{good}\n')
    run = lambda: pipelines.records(spark, str(src), lake, f"{tmp_path}/out", f"{tmp_path}/cp", None, "2024-01-02").awaitTermination()
    real = sinks.hadoop.put_text
    monkeypatch.setattr(sinks.hadoop, "put_text", lambda *a: 1 / 0)  # the last step of the batch fails
    with pytest.raises(Exception):  # noqa: B017
        run()
    monkeypatch.setattr(sinks.hadoop, "put_text", real)
    run()
    (src / "b.json").write_text("{}\n")
    run()
    kept = sinks.rejected_lines(spark, pipelines.rejected(f"{tmp_path}/cp")).collect()
    assert sorted((r["line"], r["reason"].split(":")[0], r["batch"], r["source_file"].rpartition("/")[2]) for r in kept) == [
        ("[]", "no request", 0, "a.json"), ('{"broken', "no JSON", 0, "a.json"),
        ('{"resourceLogs":"text"}', "no request", 0, "a.json"), ("{}", "no request", 1, "b.json"),
    ]
    assert lake.scan("otel_logs").count() == 2
    counted = dict(rows(reports.ingest_counters(reports.counter_rows(spark, pipelines.counters(f"{tmp_path}/cp")))))
    assert (counted["InsertedRows"], counted["RejectedInserts"], counted["InsertQuery"]) == (2, 4, 2)
    assert sinks.rejected_lines(spark, f"{tmp_path}/nowhere").collect() == []


def test_backlog_with_a_real_trigger(spark, sf_dir, lake, tmp_path):
    src = f"{tmp_path}/in"
    otlp_requests(fx.logs(spark, sf_dir).limit(40), 5).repartition(4).write.text(src)
    q = pipelines.logs(spark, src, lake, f"{tmp_path}/out", f"{tmp_path}/cp", "1 second", fx.AS_OF, watch=True, maxFilesPerTrigger="1")
    q.processAllAvailable()
    q.stop()
    left = sorted(rows(reports.backlog_rows(spark, pipelines.counters(f"{tmp_path}/cp")).select("batch", "files")))
    assert left == [(0, 3), (1, 2), (2, 1), (3, 0)]
    otlp_requests(fx.logs(spark, sf_dir).limit(5)).write.mode("append").text(src)
    now = reports.backlog(spark, src, f"{tmp_path}/cp/logs").first()
    assert now["files"] >= 1 and now["bytes"] > 0 and now["oldest"] is not None


def test_a_day_of_small_units_is_written_by_several_tasks(spark, lake):
    words = F.concat_ws(" ", *[F.md5(F.concat_ws("-", F.lit(i), F.col("id"))) for i in range(12)])
    day = log_rows(spark.range(0, 20_000, 1, 8), {"Timestamp_ns": F.col("id") * 1000 + 1_704_067_200_000_000_000, "Body": words})
    lake.rows_per_file = 5000
    lake.write(day, "otel_logs")
    files = inventory(lake, "otel_logs")
    task = F.regexp_extract("path", r"/part-(\d+)-", 1)
    assert files.agg(F.count_distinct(task)).first()[0] > 1
    assert files.agg(F.sum("rows"), F.max("rows") <= 5000).first()[:] == (20_000, True)


def test_units_of_rows(spark, sf_dir, tmp_path):
    from tlake.plans import Lake, inventory

    lake = Lake(spark, f"{tmp_path}/hot", f"{tmp_path}/cold", ["otel_logs"], rows_per_file=7).create_tables()
    lake.write(fx.logs(spark, sf_dir), "otel_logs")
    sizes = [r["rows"] for r in inventory(lake, "otel_logs").collect()]
    assert max(sizes) <= 7 and sum(sizes) == fx.logs(spark, sf_dir).count()


def small_tables(spark, folder):
    """Events of which some come twice, and nations."""
    spark.sql("""
        SELECT e AS event_id, timestamp_ntz'2024-01-03 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, e) AS ts, e % 50 AS user_id,
          element_at(array('view', 'error', 'click'), CAST(e % 3 + 1 AS INT)) AS event_type, e % 90 / 4 AS value, '{"k": ' || e % 9 || '}' AS props
        FROM (SELECT id AS e FROM range(0, 2000, 1, 2) UNION ALL SELECT id * 100 FROM range(20)) AS t
    """).withColumn("value", F.col("value").cast("double")).write.parquet(f"{folder}/events.parquet")
    spark.sql("SELECT CAST(id AS INT) AS n_nationkey, 'N' || id AS n_name, CAST(id % 3 AS INT) AS n_regionkey FROM range(8)").write.parquet(f"{folder}/nation.parquet")


def test_input_and_archive_of_odd_lines_are_packed(spark, tmp_path, monkeypatch):
    """Each of them in many small files; they hold the lines they held, and the same ones are rejected."""
    small_tables(spark, tmp_path)
    monkeypatch.setattr(fx, "PACKED_FILE_LINES", 700)
    monkeypatch.setattr(session, "shared_root", lambda _: f"{tmp_path}/shared")
    got = REGISTRY["rejected_lines"](spark, str(tmp_path)).groupBy("pipeline", "line").count()
    ids = [*range(2000), *range(0, 2000, 100)]
    expected = Counter()
    for e in ids:
        if e % 7 == 0:
            expected.update([(p, f'{{"broken {e}') for p in ("logs/records", "traces", "metrics", "logs/journal")] + [("logs/container", f"odd line {e}")])
        elif e % 7 == 1:
            expected.update([(p, f'{{"x":{e}}}') for p in ("logs/records", "traces", "metrics")])
    assert {(r["pipeline"], r["line"]): r["count"] for r in got.collect()} == expected
    scratch = tmp_path / "shared" / "tlake"
    for name in ("logs", "traces", "metrics", "journal"):
        files = [*scratch.glob(f"{name}-*/part-*")]
        texts = [gzip.decompress(f.read_bytes()) for f in files if f.name.endswith(".txt.gz")]
        assert len(texts) == len(files) and max(t.count(b"\n") for t in texts) <= 700
        assert sum(f.stat().st_size for f in files) < sum(map(len, texts)) / 4
        if name != "logs":
            assert sum(t.count(b"\n") for t in texts) == len(ids) + sum(e % 7 < 2 for e in ids)
    for name in ("otel", "k8s", "journal"):
        files = [*scratch.glob(f"out-*/{name}/*/part-*")]
        assert files and all(f.name.endswith(".json.gz") for f in files)


def test_packed_archive_holds_the_same(spark, sf_dir, lake, tmp_path):
    src, read = archive(spark, sf_dir, tmp_path), {}
    for kind, pack in ((None, True), (None, False), ("otel", True)):
        out = f"{tmp_path}/out-{kind}-{pack}"
        pipelines.logs(spark, src, lake, out, f"{out}-cp", None, fx.AS_OF, archive_type=kind, pack=pack).awaitTermination()
        files = [f.name for f in pathlib.Path(out).rglob("part-*")]
        assert files and all(f.endswith(".json.gz" if pack else ".json") for f in files)
        read[kind, pack] = sorted(rows(archive_logs(read_otlp_logs(spark, out))), key=str)
    assert read[None, True] == read[None, False] == read["otel", True]


def test_shuffled_files_go_with_the_batch(spark, sf_dir, lake, tmp_path):
    """What a batch's writes have shuffled is deleted when they end, not when the driver's memory is next cleaned."""
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for d in folders for f in pathlib.Path(d).rglob("shuffle_*")}
    src = archive(spark, sf_dir, tmp_path)
    before = shuffled()
    pipelines.logs(spark, src, lake, f"{tmp_path}/out", f"{tmp_path}/cp", None, fx.AS_OF).awaitTermination()
    fx.packed_lines(otlp_requests(fx.logs(spark, sf_dir)), f"{tmp_path}/lines")
    fx.log_files(fx.odd_container_lines(spark, sf_dir), f"{tmp_path}/pods")
    until = time.monotonic() + 20
    while (left := shuffled() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert lake.scan("otel_logs").count() == archive_logs(read_otlp_logs(spark, f"{tmp_path}/out/otel")).count() > 0
