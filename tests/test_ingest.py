"""Hand-written rows for the ingest rules."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from tlake import schemas
from tlake.functions import map_text
from tlake.operators import flatten, transforms
from tlake.sources import (
    parse_lines,
    parse_prom_text,
    read_container_logs,
    read_journal_json,
    read_otlp_logs,
    read_otlp_metrics,
    read_otlp_traces,
    read_prom_text,
)
from tlake.streaming import otlp_requests


def lines(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")


def request(*records, attrs=()):
    return {"resourceLogs": [{"resource": {"attributes": list(attrs)}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": list(records)}]}]}


def kv(k, v, kind="stringValue"):
    return {"key": k, "value": {kind: v}}


EMPTY = [{"resourceLogs": []}, {"resourceLogs": [{"scopeLogs": []}]}, {"resourceLogs": [{"scopeLogs": [{"logRecords": []}]}]}, {}]


def test_empty_lists_keep_a_row_in_the_archive_view_only(spark):
    df = parse_lines(lines(spark, *EMPTY), schemas.OTLP_LOGS)
    got = rows(flatten.archive_logs(df))
    assert got == [(None, "", "", "", "", "", {})] * 4
    assert flatten.otlp_to_logs(df).count() == 0


def test_number_attributes_and_bodies(spark):
    rec = {"timeUnixNano": 1704067200000000123, "body": {"intValue": 5}, "severityNumber": 9, "flags": 1,
           "attributes": [kv("n", 7, "intValue"), kv("n", 8, "intValue"), kv("e", "")]}
    df = flatten.otlp_to_logs(parse_lines(lines(spark, request(rec, attrs=[kv("service.name", "web")])), schemas.OTLP_LOGS))
    r = df.first()
    assert r["Timestamp_ns"] == 1704067200000000123
    assert r["Timestamp"] == datetime(2024, 1, 1)
    assert (r["Body"], r["ServiceName"], r["SeverityNumber"], r["TraceFlags"]) == ("5", "web", 9, 1)
    assert r["LogAttributes"] == {"n": "8", "e": ""}
    assert (r["TraceId"], r["ObservedTimestamp_ns"]) == ("", 0)


def test_bad_times(spark):
    recs = [{"timeUnixNano": "0"}, {"timeUnixNano": ""}, {}, {"timeUnixNano": "1704067200000000001"}]
    df = flatten.otlp_to_logs(parse_lines(lines(spark, request(*recs)), schemas.OTLP_LOGS))
    assert sorted(r["Timestamp_ns"] for r in df.collect()) == [0, 0, 0, 1704067200000000001]


def test_fix_time_truth_table(spark):
    df = spark.createDataFrame([(1, 10**18, 2 * 10**18), (2, 10**18, 0), (3, 0, 2 * 10**18), (4, 0, 0), (5, None, None)],
                               "id int, Timestamp_ns bigint, ObservedTimestamp_ns bigint")
    now = 1704067200 * 10**9
    got = rows(transforms.fix_time(df, "2024-01-01").select("id", "Timestamp_ns", "ObservedTimestamp_ns").orderBy("id"))
    assert got == [(1, 10**18, 2 * 10**18), (2, 10**18, 10**18), (3, now, 2 * 10**18), (4, now, now), (5, now, now)]


def test_split_is_exact(spark):
    df = spark.createDataFrame([(1, {"sessionId": "a"}), (2, {"sessionId": ""}), (3, {"x": "y"}), (4, {}), (5, None)],
                               "id int, LogAttributes map<string,string>")
    plain, sess = transforms.split_sessions(df)
    assert sorted(r[0] for r in plain.collect()) == [3, 4, 5]
    assert sorted(r[0] for r in sess.collect()) == [1, 2]


def test_log_type(spark):
    df = spark.createDataFrame([(1, {"log_type": "http"}), (2, {"a": "b"})], "id int, LogAttributes map<string,string>")
    assert rows(transforms.set_log_type(df, "otel").orderBy("id")) == [(1, {"log_type": "otel"}), (2, {"a": "b", "log_type": "otel"})]
    kept = transforms.set_log_type(df, "otel", overwrite=False).orderBy("id")
    assert [r["LogAttributes"]["log_type"] for r in kept.collect()] == ["http", "otel"]


def pod_logs(spark, *attrs):
    df = spark.createDataFrame([(i, i, a) for i, a in enumerate(attrs)], "id int, n int, ResourceAttributes map<string,string>")
    return df.select("id", F.col("n").cast("bigint").alias("Timestamp_ns"), F.lit("").alias("TraceId"),
                     F.lit("").alias("SpanId"), F.lit("").alias("Body"), "ResourceAttributes")


def test_enrich_needs_both_keys_and_never_multiplies(spark):
    pods = spark.createDataFrame([("p", "n", "u1", "c", "node"), ("p", "n", "u2", "c", "node"), ("p", "m", "u3", "c", "node")], schemas.PODS)
    hit = {"k8s.pod.name": "p", "k8s.namespace.name": "n", "x": "y"}
    miss = {"k8s.pod.name": "p", "k8s.namespace.name": "other"}
    df = pod_logs(spark, hit, miss, {"k8s.pod.name": "p"}, {}, None)
    got = {r["id"]: r["ResourceAttributes"] for r in transforms.enrich_k8s(df, pods).collect()}
    assert len(got) == 5
    assert got[0] == {**hit, "k8s.pod.uid": "u2", "k8s.container.name": "c", "k8s.node.name": "node"}
    assert (got[1], got[2], got[3], got[4]) == (miss, {"k8s.pod.name": "p"}, {}, None)


def container(spark, *values, block=None, path="file:/var/log/pods/ns_pod_uid/app/0.log"):
    return spark.createDataFrame(
        [(v, path, (block(i) if block else 0), i) for i, v in enumerate(values)],
        "value string, file_path string, block_start bigint, line_no bigint",
    )


CRI = [
    "2024-01-01T00:00:01.000000001Z stdout P one ",
    "2024-01-01T00:00:01Z stderr P err ",
    "2024-01-01T00:00:01Z stdout P two ",
    "2024-01-01T00:00:01Z stderr F end",
    "2024-01-01T00:00:01Z stdout F three",
    "2024-01-01T09:00:02.5+09:00 stdout F whole",
    "not a log line",
]


def test_fragments_of_interleaved_streams(spark):
    for block in (None, lambda i: i, lambda i: i // 2):
        df = transforms.parse_container(container(spark, *CRI, block=block))
        got = sorted(rows(df.select(map_text("LogAttributes", "log.iostream"), "Body", "Timestamp_ns")))
        t = 1704067200 * 10**9
        assert got == [("", "not a log line", 0), ("stderr", "err end", t + 10**9), ("stdout", "one two three", t + 10**9 + 1), ("stdout", "whole", t + 2_500_000_000)]
    assert df.first()["ResourceAttributes"] == {
        "k8s.namespace.name": "ns", "k8s.pod.name": "pod", "k8s.pod.uid": "uid", "k8s.container.name": "app",
        "k8s.container.restart_count": "0",
    }


def test_docker_lines(spark):
    docs = [json.dumps({"log": s, "stream": "stdout", "time": "2024-01-01T00:00:00.5Z"}) for s in ("a", "b\n", "c\n")]
    assert sorted(r["Body"] for r in transforms.parse_container(container(spark, *docs)).collect()) == ["ab", "c"]


def test_container_files(spark, tmp_path):
    d = tmp_path / "pods" / "ns_pod_uid" / "app"
    d.mkdir(parents=True)
    (d / "0.log").write_text("\n".join(CRI) + "\n")
    df = transforms.parse_container(read_container_logs(spark, f"{tmp_path}/pods/*/*/*.log"))
    assert sorted(r["Body"] for r in df.collect()) == ["err end", "not a log line", "one two three", "whole"]
    (d / "0.log.20240101-000000").write_text(CRI[5] + "\n")
    closed = transforms.parse_container(read_container_logs(spark, f"{tmp_path}/pods/*/*/*.log.*")).first()
    assert (closed["Body"], closed["ResourceAttributes"]["k8s.pod.uid"], closed["ResourceAttributes"]["k8s.container.restart_count"]) == ("whole", "uid", "0")
    assert df.first()["ResourceAttributes"]["k8s.pod.name"] == "pod"


def test_one_long_file_in_many_blocks(spark, tmp_path):
    """Splits cut messages anywhere; the result must equal a plain read of the file."""
    d = tmp_path / "ns_pod_uid" / "app"
    d.mkdir(parents=True)
    want, text = [], []
    for i in range(4000):
        n = i % 4
        for j in range(n):
            text.append(f"2024-01-01T00:00:00Z stdout P m{i}.{j};")
        text.append(f"2024-01-01T00:00:00Z stdout F m{i}.end")
        want.append("".join(f"m{i}.{j};" for j in range(n)) + f"m{i}.end")
    (d / "0.log").write_text("\n".join(text) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        src = read_container_logs(spark, f"{tmp_path}/*/*/*.log")
        assert src.select("block_start").distinct().count() > 10
        got = [r["Body"] for r in transforms.parse_container(src).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted(want)


def test_journal(spark, tmp_path):
    (tmp_path / "j.json").write_text("\n".join([
        json.dumps({"__REALTIME_TIMESTAMP": "1704067200000001", "MESSAGE": "hi", "PRIORITY": "3", "_SYSTEMD_UNIT": "a.service", "_PID": "1"}),
        json.dumps({"__REALTIME_TIMESTAMP": "1704153600000000", "MESSAGE": None, "N": 5}), "garbage"]))
    got = sorted(rows(read_journal_json(spark, str(tmp_path)).select("Timestamp", "Body", "SeverityText", "SeverityNumber", "ServiceName", "LogAttributes")))
    assert got == [
        (datetime(2024, 1, 1, 0, 0, 0, 1), "hi", "err", 17, "a.service", {"_SYSTEMD_UNIT": "a.service", "_PID": "1"}),
        (datetime(2024, 1, 2), "", "", 0, "", {"N": "5"}),
    ]
    assert read_journal_json(spark, str(tmp_path), since="2024-01-02").count() == 1
    assert read_journal_json(spark, str(tmp_path), since="2999-01-01").count() == 0


PROM = r"""# HELP up Is it "up"?
# TYPE up gauge
up{job="a",path="C:\\x",q="say \"hi\"",b="{x}"} 1
# TYPE req_total counter
req_total{code="200"} 1027 1704067200123
# TYPE lat histogram
lat_bucket{le="0.1"} 2
lat_bucket{le="+Inf"} 7
lat_bucket{le="1"} 5
lat_sum 3.5
lat_count 7
# TYPE rpc summary
rpc{quantile="0.5"} 4
rpc{quantile="0.99"} 9
rpc_sum 17
rpc_count 3
untyped_x 3e2
bad line here now
"""


def test_prom_text(spark, tmp_path):
    (tmp_path / "s.prom").write_text(PROM)
    m = read_prom_text(spark, str(tmp_path), job="j")
    g = {r["MetricName"]: r for r in m["gauge"].collect()}
    assert set(g) == {"up", "untyped_x"}
    assert g["up"]["Attributes"] == {"job": "a", "path": "C:\\x", "q": 'say "hi"', "b": "{x}"}
    assert (g["up"]["MetricDescription"], g["untyped_x"]["Value"], g["up"]["ServiceName"]) == ('Is it "up"?', 300.0, "j")
    c = m["sum"].collect()
    assert [(r["MetricName"], r["Value"], r["IsMonotonic"], r["TimeUnix"]) for r in c] == [
        ("req_total", 1027.0, True, datetime(2024, 1, 1, 0, 0, 0, 123000))]
    h = m["histogram"].first()
    assert (h["MetricName"], h["Count"], h["Sum"], h["BucketCounts"], h["ExplicitBounds"]) == ("lat", 7, 3.5, [2, 3, 2], [0.1, 1.0])
    assert len(h["BucketCounts"]) == len(h["ExplicitBounds"]) + 1
    s = m["summary"].first()
    assert (s["Count"], s["Sum"], [tuple(q) for q in s["ValueAtQuantiles"]]) == (3, 17.0, [(0.5, 4.0), (0.99, 9.0)])


def test_otlp_files(spark, tmp_path):
    (tmp_path / "l").mkdir(), (tmp_path / "t").mkdir(), (tmp_path / "m").mkdir()
    (tmp_path / "l" / "a.json").write_text(json.dumps(request({"timeUnixNano": "1", "body": {"stringValue": "x"}})) + "\nbroken{\n")
    assert [r["Body"] for r in flatten.otlp_to_logs(read_otlp_logs(spark, str(tmp_path / "l"))).collect()] == ["x"]
    span = {"traceId": "t", "spanId": "s", "name": "op", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": "1000", "endTimeUnixNano": "5000",
            "status": {"code": 2, "message": "m"}, "events": [{"timeUnixNano": "2000", "name": "e", "attributes": [kv("a", "b")]}]}
    (tmp_path / "t" / "a.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}))
    r = read_otlp_traces(spark, str(tmp_path / "t")).first()
    assert (r["SpanKind"], r["StatusCode"], r["Duration"], r["ParentSpanId"], r["Links"]) == ("Client", "Error", 4000, "", [])
    assert (r["Events"][0]["Name"], r["Events"][0]["Attributes"]) == ("e", {"a": "b"})
    pts = [
        {"name": "g", "gauge": {"dataPoints": [{"asInt": "3", "timeUnixNano": "7"}]}},
        {"name": "s", "sum": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_DELTA", "isMonotonic": True, "dataPoints": [{"asDouble": 1.5}]}},
        {"name": "h", "histogram": {"aggregationTemporality": 2, "dataPoints": [{"count": "1", "bucketCounts": ["1"], "explicitBounds": []}]}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [{"count": 3, "scale": -1, "zeroCount": "1", "positive": {"offset": 2, "bucketCounts": ["2"]}}]}},
        {"name": "q", "summary": {"dataPoints": [{"count": "2", "sum": 3, "quantileValues": [{"quantile": 0.5, "value": 1}]}]}},
    ]
    (tmp_path / "m" / "a.json").write_text(json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": pts}]}]}))
    m = {k: v.collect() for k, v in read_otlp_metrics(spark, str(tmp_path / "m")).items()}
    assert {k: [r["MetricName"] for r in v] for k, v in m.items()} == {"gauge": ["g"], "sum": ["s"], "histogram": ["h"], "exp_histogram": ["e"], "summary": ["q"]}
    assert (m["gauge"][0]["Value"], m["gauge"][0]["TimeUnix_ns"]) == (3.0, 7)
    assert (m["sum"][0]["AggregationTemporality"], m["sum"][0]["IsMonotonic"]) == (1, True)
    assert (m["histogram"][0]["BucketCounts"], m["histogram"][0]["ExplicitBounds"], m["histogram"][0]["AggregationTemporality"]) == ([1], [], 2)
    e = m["exp_histogram"][0]
    assert (e["Scale"], e["ZeroCount"], e["PositiveOffset"], e["PositiveBucketCounts"], e["NegativeBucketCounts"]) == (-1, 1, 2, [2], [])


def test_requests_round_trip_with_odd_text(spark):
    rec = [{"timeUnixNano": str(i), "body": {"stringValue": f'q"\\{i}\n{{}} é'}, "attributes": [kv("a", 'b"')]} for i in range(2500)]
    src = flatten.otlp_to_logs(parse_lines(lines(spark, request(*rec, attrs=[kv("service.name", "s")])), schemas.OTLP_LOGS))
    reqs = otlp_requests(src, rows_per_request=1000)
    assert reqs.count() == 3  # no request above the bound
    back = flatten.otlp_to_logs(parse_lines(reqs, schemas.OTLP_LOGS))
    key = ["Timestamp_ns", "Body", "ServiceName", "ScopeName", "ObservedTimestamp_ns"]
    assert sorted(rows(back.select(*key))) == sorted(rows(src.select(*key)))
    assert back.first()["LogAttributes"] == {"a": 'b"'}


def test_search_and_filter(spark):
    df = spark.createDataFrame([("Hello World", "INFO", "a", {"k": "v"}), ("bye", "WARN", "b", {})],
                               "Body string, SeverityText string, ServiceName string, LogAttributes map<string,string>")
    assert transforms.search(df, "hello w").count() == 1
    assert transforms.search(df, "hello w", ignore_case=False).count() == 0
    assert transforms.search(df, "^b.e$", regex=True).count() == 1
    assert transforms.filter_logs(df, attrs={"k": "v"}).count() == 1
    assert transforms.filter_logs(df, level="WARN", service="a").count() == 0


def test_prom_lines_of_many_snapshots_stay_apart(spark):
    df = spark.createDataFrame([(v, s, datetime(2024, 1, 1, i)) for i, s in enumerate("ab") for v in PROM.splitlines()],
                               "value string, source string, scraped_at timestamp_ntz")
    h = parse_prom_text(df)["histogram"].orderBy("TimeUnix").collect()
    assert [(r["TimeUnix"].hour, r["BucketCounts"]) for r in h] == [(0, [2, 3, 2]), (1, [2, 3, 2])]


def test_absurd_numbers_do_not_stop_the_job(spark):
    big = "9" * 30
    rec = {"timeUnixNano": big, "severityNumber": big, "flags": "x", "attributes": [kv("n", big, "intValue")]}
    r = flatten.otlp_to_logs(parse_lines(lines(spark, request(rec)), schemas.OTLP_LOGS)).first()
    assert (r["Timestamp_ns"], r["SeverityNumber"], r["TraceFlags"], r["LogAttributes"]) == (0, 0, 0, {"n": big})
    span = {"startTimeUnixNano": "-9223372036854775807", "endTimeUnixNano": "9223372036854775807"}
    s = parse_lines(lines(spark, {"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}), schemas.OTLP_TRACES)
    assert flatten.otlp_to_spans(s).first()["Duration"] == 0
    prom = "# TYPE h histogram\nh_bucket{le=\"1\"} NaN\nh_bucket{le=\"+Inf\"} +Inf\nh_count NaN\nup 1 99999999999999999\n"
    df = spark.createDataFrame([(v, "a", datetime(2024, 1, 1)) for v in prom.splitlines()], "value string, source string, scraped_at timestamp_ntz")
    m = parse_prom_text(df)
    h = m["histogram"].first()
    assert (h["Count"], h["Sum"], len(h["BucketCounts"])) == (0, 0.0, 2)
    assert m["gauge"].first()["TimeUnix"] == datetime(2024, 1, 1)
    bad = container(spark, "2024-99-99T00:00:00Z stdout F x", "stdout F", "")
    assert sorted((r["Body"], r["Timestamp_ns"]) for r in transforms.parse_container(bad).collect()) == [("stdout F", 0), ("x", 0)]


def test_fragments_against_a_plain_walk(spark):
    """Random files, streams and block cuts."""
    import random

    for seed in range(4):
        rnd = random.Random(seed)
        recs, open_, want = [], {}, []
        cut = {f: sorted(rnd.sample(range(400), rnd.choice([0, 3, 60]))) for f in "ab"}
        for i in range(400):
            f, s, tag = rnd.choice("ab"), rnd.choice(["stdout", "stderr"]), rnd.choice("PPF")
            block = sum(c <= i for c in cut[f])
            recs.append((f"2024-01-01T00:00:00Z {s} {tag} {i};", f"/x/n_{f}_u/c/0.log", block, i))
            open_.setdefault((f, s), []).append(f"{i};")
            if tag == "F":
                want.append((f, s, "".join(open_.pop((f, s)))))
        want += [(f, s, "".join(v)) for (f, s), v in open_.items()]
        df = spark.createDataFrame(recs, "value string, file_path string, block_start bigint, line_no bigint")
        out = transforms.parse_container(df).select(
            map_text("ResourceAttributes", "k8s.pod.name"), map_text("LogAttributes", "log.iostream"), "Body")
        assert sorted(rows(out)) == sorted(want)


def test_exemplars_leave_the_point_as_it_is(spark):
    from pyspark.sql import functions as F

    from tlake.sources.files import _samples

    lines = ['h_bucket{le="1",note="a # {b"} 5 # {trace_id="abc"} 0.67', 'h_sum 3 # {trace_id="x"} 1 2', 'g{a="b"} 7 1000']
    df = spark.createDataFrame([(x,) for x in lines], "value string").select(
        "value", F.lit("f").alias("source"), F.lit("2024-01-01").cast("timestamp_ntz").alias("scraped_at")
    )
    got = {r.name: (dict(r.labels), r.x) for r in _samples(df).collect()}
    assert got == {"h_bucket": ({"le": "1", "note": "a # {b"}, 5.0), "h_sum": ({}, 3.0), "g": ({"a": "b"}, 7.0)}


def prom(spark, *values):
    return spark.createDataFrame([(v, "s", datetime(2024, 1, 1)) for v in values], "value string, source string, scraped_at timestamp_ntz")


def test_prom_exemplars(spark):
    out = parse_prom_text(prom(
        spark, "# TYPE h histogram", "# TYPE c counter", "# TYPE q summary",
        'h_bucket{p="a # {b}",le="1"} 2 # {trace_id="t1",span_id="s1",x="a\\"}# "} 0.5 1704067200.000000123',
        'h_bucket{p="a # {b}",le="+Inf"} 3 1704067200000 # {trace_id="t2"} 7', 'h_sum{p="a # {b}"} 8', 'h_count{p="a # {b}"} 3',
        'c_total 5 # {} 1.5 bad', "c_total{x=\"y\"} 6 # {trace_id=\"t3\"} 2e0", "c_total{x=\"z\"} 6 # words", 'g{a="}"} NaN', "not a sample line here", "1x 2", "g2 1 2 3",
    ))
    sums = {r["Attributes"].get("x", ""): r["Exemplars"] for r in out["sum"].collect()}
    assert sums[""] == [] and sums["z"] == []
    assert [(e["TraceId"], e["Value"], e["TimeUnix_ns"]) for e in sums["y"]] == [("t3", 2.0, 0)]
    points = out["histogram"].collect()
    of = {e["TraceId"]: e for p in points for e in p["Exemplars"]}
    assert of["t1"]["SpanId"] == "s1" and of["t1"]["FilteredAttributes"] == {"x": 'a"}# '}
    assert of["t1"]["TimeUnix_ns"] == 1704067200 * 10**9 + 123 and of["t2"]["Value"] == 7.0
    assert {p["Attributes"]["p"] for p in points} == {"a # {b}"}
    assert [r["MetricName"] for r in out["gauge"].collect()] == ["g"]
