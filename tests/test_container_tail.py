"""Growing and rotated log files, messages carried between batches, pods over time."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tlake import schemas
from tlake.functions import map_text
from tlake.operators import transforms
from tlake.operators.flatten import log_rows, otlp_to_logs
from tlake.sources import read_otlp_logs
from tlake.sources.tail import TailReader, lines
from tlake.streaming import as_read, otlp_requests, pipelines


def pods(spark):
    return spark.createDataFrame([("pod", "ns", "uid", "app", "node-1")], schemas.PODS)


def pod_folder(tmp_path):
    d = tmp_path / "pods" / "ns_pod_uid" / "app"
    d.mkdir(parents=True)
    return d


def cri(text, tag="F", second=1):
    return f"2024-01-01T00:00:{second:02d}Z stdout {tag} {text}\n"


class Run:
    """A pipeline over a growing folder, one batch a call."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.root, self.options = spark, tmp_path, {"follow": True, **options}

    def __call__(self):
        glob = f"{self.root}/pods/*/*/*.log" + ("" if self.options["follow"] else "*")
        pipelines.container(self.spark, glob, pods(self.spark), f"{self.root}/out", f"{self.root}/cp", None, **self.options).awaitTermination()

    def bodies(self):
        read = otlp_to_logs(read_otlp_logs(self.spark, f"{self.root}/out/k8s"))
        return sorted(r["Body"] for r in read.select("Body").collect())


def test_open_messages_are_found_where_the_batch_lies(spark, tmp_path):
    """The tasks that read the batch find them, not one task; the table that is left is small."""
    in_task = F.udf(lambda _: __import__("pyspark").TaskContext.get().partitionId(), "int")
    parts = F.array(F.struct(F.col("id").alias("line_no"), F.lit(1).cast("bigint").alias("ns"), F.lit("m").alias("msg")))
    messages = spark.range(0, 800, 1, 8).select(
        F.col("id").cast("string").alias("source"), F.lit("stdout").alias("stream"), F.lit("f").alias("file_path"),
        parts.alias("parts"), (F.col("id") % 100 != 0).alias("closed"), in_task("id").alias("carried"),
    )
    kept = pipelines.Fragments(str(tmp_path), 100)
    kept.sink(messages, "query-000000000000")
    left = kept.before(spark, 1)
    assert sorted(r[0] for r in left.select("carried").collect()) == list(range(8))
    assert len(left.inputFiles()) == 1


def test_lines_of_any_ranges_are_each_read_once():
    draw = random.Random(3)
    for _ in range(200):
        text = b"".join(bytes(draw.choice(b"ab\n") for _ in range(draw.randrange(60))) for _ in range(2)) + b"tail"
        cuts = sorted({0, len(text), *(draw.randrange(len(text)) for _ in range(draw.randrange(6)))})
        f = FakeFile(text)
        got = [x for a, b in zip(cuts, cuts[1:]) for x in lines(f, a, b)]
        want, at = [], 0
        for line in text.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


class FakeFile:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return io.BytesIO(self.data[at : at + n]).read()


def test_positions_follow_files_not_names(tmp_path):
    d = pod_folder(tmp_path)
    (d / "0.log").write_text(cri("one") + cri("two")[:10])
    (d / ".0.log.crc").write_text("x\n")
    (d / "0.log.20230101-000000.gz").write_text("x\n")
    (d / "1.log").write_text("no line end yet")
    reader = TailReader(f"{tmp_path}/pods/*/*/*.log")
    first = reader.latestOffset()
    assert [v["path"].rpartition("/")[2] for v in first.values()] == ["0.log"]
    (d / "0.log").rename(d / "0.log.20240101-000000")
    (d / "0.log").write_text(cri("three") + cri("more", second=9) * 20)
    second = reader.latestOffset()
    assert set(first) < set(second) and len(second) == 2
    ranges = {r.path.rpartition("/")[2]: (r.start, r.end) for r in reader.partitions(first, second)}
    # The renamed file goes on where it was, so there is nothing to read; the new one starts at 0, though it is longer.
    assert list(ranges) == ["0.log"] and ranges["0.log"][0] == 0
    assert TailReader(f"{tmp_path}/pods/*/*/*.log").latestOffset() == second  # a restart finds the same names
    # What was planned under the old name is found under the new one.
    planned = reader.partitions({}, first)[0]
    assert [b.to_pylist()[0]["value"] for b in reader.read(planned)] == [cri("one")[:-1]]


def test_file_grows_and_rotates(spark, tmp_path):
    d, run = pod_folder(tmp_path), Run(spark, tmp_path)
    text = cri("a") + cri("b1 ", "P") + cri("b2") + cri("c1 ", "P")
    for size in (5, len(cri("a")) + 30, len(text)):
        (d / "0.log").write_text(text[:size])
        run()
    assert run.bodies() == ["a", "b1 b2"]  # c is not finished
    (d / "0.log").rename(d / "0.log.20240101-000000")
    (d / "0.log").write_text(cri("c2") + cri("d"))
    run()
    assert run.bodies() == ["a", "b1 b2", "c1 c2", "d"]
    run()  # nothing new
    assert len(run.bodies()) == 4


def test_rotation_between_batches_of_closed_files(spark, tmp_path):
    d, run = pod_folder(tmp_path), Run(spark, tmp_path, follow=False)
    (d / "0.log.20240101-000000").write_text(cri("one ", "P") + cri("two ", "P"))
    run()
    (d / "0.log.20240102-000000").write_text(cri("three ", "P"))
    run()
    (d / "0.log.20240103-000000").write_text(cri("end") + cri("whole"))
    run()
    assert run.bodies() == ["one two three end", "whole"]


def test_fragments_that_are_never_finished_are_passed_on(spark, tmp_path):
    d, run = pod_folder(tmp_path), Run(spark, tmp_path, patience=3)
    for i in range(4):
        (d / "0.log").write_text(cri("open ", "P"))
        (d / f"{i + 1}.log").write_text(cri(f"other {i}"))
        run()
    assert run.bodies() == ["open ", "other 0", "other 1", "other 2", "other 3"]
    # Versions that no repeated batch can need are gone.
    assert len(list((tmp_path / "cp" / "logs" / "container-fragments").iterdir())) == 2


def test_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """The second batch fails after the archive is written; its repetition starts from the same fragments."""
    d, run = pod_folder(tmp_path), Run(spark, tmp_path)
    (d / "0.log").write_text(cri("one ", "P"))
    run()
    (d / "0.log").write_text(cri("one ", "P") + cri("two") + cri("next ", "P"))
    real = pipelines.Fragments.sink

    def fails(self, messages, batch):
        raise RuntimeError("lost")

    monkeypatch.setattr(pipelines.Fragments, "sink", fails)
    with pytest.raises(Exception):  # noqa: B017
        run()
    monkeypatch.setattr(pipelines.Fragments, "sink", real)
    (d / "0.log").write_text(cri("one ", "P") + cri("two") + cri("next ", "P") + cri("end"))
    run()
    run()
    assert run.bodies() == ["next end", "one two"]


def test_merge_over_rotation_in_one_read(spark):
    data = [(cri("a ", "P")[:-1], "/x/ns_pod_uid/app/0.log.20240101-000000", 0, 0), (cri("b")[:-1], "/x/ns_pod_uid/app/0.log", 0, 0),
            (cri("c ", "P")[:-1], "/x/ns_pod_uid/app/0.log", 0, 1), (cri("d")[:-1], "/x/ns_pod_uid/app/1.log", 0, 0)]
    df = spark.createDataFrame(data, "value string, file_path string, block_start bigint, line_no bigint")
    got = {r["Body"]: r["LogAttributes"]["log.file.path"] for r in transforms.parse_container(df).collect()}
    # The next restart is another source: c stays open.
    assert got == {"a b": data[0][1], "c ": data[2][1], "d": data[3][1]}


def test_pods_over_time_equal_plain_search(spark):
    draw = random.Random(8)
    day = 86_400 * 10**9
    lives = []
    for pod in range(6):
        at = draw.randrange(day)
        for n in range(draw.randrange(1, 7)):
            end = None if draw.random() < 0.3 else at + draw.randrange(3 * day)
            lives.append((f"p{pod}", "n", f"u{pod}-{n}", "c", f"node{n}", at, end))
            at += draw.randrange(1, 3 * day)
    records = [(i, f"p{draw.randrange(7)}", draw.randrange(14 * day)) for i in range(500)]
    life = spark.createDataFrame(lives, "pod_name string, namespace string, pod_uid string, container_name string, node_name string, valid_from_ns bigint, valid_to_ns bigint")
    df = log_rows(
        spark.createDataFrame(records, "id int, pod string, at bigint"),
        {"Timestamp_ns": F.col("at"), "ResourceAttributes": F.create_map(F.lit("k8s.pod.name"), F.col("pod"), F.lit("k8s.namespace.name"), F.lit("n")), "id": F.col("id")},
    )

    def plain(pod, at):
        born = [x for x in lives if x[0] == pod and x[5] <= at]
        best = max(born, key=lambda x: x[5], default=None)
        return best[2] if best and (best[6] is None or at < best[6]) else ""

    got = transforms.enrich_k8s_as_of(df, life).select("id", map_text("ResourceAttributes", "k8s.pod.uid"))
    assert sorted(rows(got)) == [(i, plain(p, at)) for i, p, at in records]
    hourly = transforms.enrich_k8s_as_of(df, life, "1 hour").select("id", map_text("ResourceAttributes", "k8s.pod.uid"))
    assert sorted(rows(hourly)) == sorted(rows(got))


def test_as_of_odd_lives(spark):
    life = spark.createDataFrame(
        [("p", "n", "u1", "c", "x", 10, 10), ("p", "n", "u2", "c", "x", 20, 5), ("p", "n", "u3", None, "x", 30, None), ("p", "n", "u4", "c", "x", None, None)],
        "pod_name string, namespace string, pod_uid string, container_name string, node_name string, valid_from_ns bigint, valid_to_ns bigint",
    )
    at = lambda ns, names: (ns, names)
    df = log_rows(
        spark.createDataFrame([at(15, ["p", "n"]), at(25, ["p", "n"]), at(35, ["p", "n"]), at(35, None)], "at bigint, x array<string>"),
        {"Timestamp_ns": F.col("at"), "ResourceAttributes": F.when(F.col("x").isNotNull(), F.create_map(F.lit("k8s.pod.name"), F.col("x")[0], F.lit("k8s.namespace.name"), F.col("x")[1]))},
    )
    got = [r[0] for r in transforms.enrich_k8s_as_of(df, life).select(map_text("ResourceAttributes", "k8s.pod.uid")).collect()]
    assert sorted(got) == ["", "", "", "u3"]


def test_typed_archive_keeps_kinds_and_takes_changes(spark, tmp_path, lake):
    value = {"arrayValue": {"values": [{"intValue": "1"}, {"kvlistValue": {"values": [{"key": "é\"", "value": {"doubleValue": 0.5}}]}}]}}
    record = {
        "timeUnixNano": "1704067200000000000", "body": {"kvlistValue": {"values": []}},
        "attributes": [{"key": "deep", "value": value}, {"key": "n", "value": {"intValue": "9007199254740993"}}, {"key": "none", "value": {}},
                       {"key": "log_type", "value": {"intValue": "3"}}],
    }
    resource = {"attributes": [{"key": "log_type", "value": {"stringValue": "a/b c"}}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps({"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [record]}]}]}) + "\n")
    pipelines.logs(spark, f"{tmp_path}/in", lake, f"{tmp_path}/out", f"{tmp_path}/cp", None, "2024-01-02", archive_type=None).awaitTermination()
    folder = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("log_type="))
    assert folder.name == "log_type=a%2Fb c"
    line = next(p for p in folder.rglob("*.json")).read_text()
    got = json.loads(line)["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    attributes = {a["key"]: a["value"] for a in got["attributes"]}
    assert attributes["deep"] == value and attributes["n"] == {"intValue": "9007199254740993"}
    assert attributes["log_type"] == {"stringValue": "otel"}  # set by the pipeline
    assert attributes["none"] == {"stringValue": ""} and got["body"] == {"kvlistValue": {"values": []}}
    assert lake.scan("otel_logs").first()["LogAttributes"]["n"] == "9007199254740993"


def test_packing_sees_changes_by_the_texts_that_were_read(spark, tmp_path):
    """With ``as_read`` requests are what they are without: values as they came, changed, added, removed, empty, of no kind."""
    attributes = [
        {"key": "n", "value": {"intValue": "5"}}, {"key": "list", "value": {"arrayValue": {"values": [{"boolValue": True}]}}},
        {"key": "empty", "value": {"stringValue": ""}}, {"key": "none", "value": {}}, {"key": "null"}, {"key": "old", "value": {"intValue": "1"}},
        {"key": "gone", "value": {"intValue": "2"}}, {"key": "cleared", "value": {"doubleValue": 0.5}},
    ]
    records = [{"body": body, "attributes": attributes} for body in ({"intValue": "7"}, {"stringValue": ""}, {}, {"kvlistValue": {"values": []}})]
    resource = {"attributes": [{"key": "zone", "value": {"intValue": "7"}}, {"key": "of", "value": {"intValue": "8"}}]}
    (tmp_path / "x.json").write_text(json.dumps({"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": records}]}]}) + "\n")
    read = otlp_to_logs(read_otlp_logs(spark, f"{tmp_path}/x.json", typed=True))

    def changed(df):
        df = transforms.upsert_attr(transforms.upsert_attr(df, "LogAttributes", "old", "one"), "LogAttributes", "new", "5")
        df = df.withColumn("LogAttributes", F.map_filter("LogAttributes", lambda k, _: k != "gone"))
        df = transforms.upsert_attr(df, "LogAttributes", "cleared", "")
        df = transforms.upsert_attr(df, "ResourceAttributes", "of", "other")
        return df.withColumn("Body", F.when(F.col("Body") == "7", "seven").otherwise(F.col("Body")))

    lines = lambda df: sorted(r[0] for r in otlp_requests(df).collect())
    for step in (lambda df: df, changed):
        assert lines(step(as_read(read))) == lines(step(read))
    got = json.loads(lines(changed(as_read(read)))[0])["resourceLogs"][0]
    values = {a["key"]: a["value"] for a in got["scopeLogs"][0]["logRecords"][0]["attributes"]}
    assert values == {
        "n": {"intValue": "5"}, "list": {"arrayValue": {"values": [{"boolValue": True}]}}, "empty": {"stringValue": ""}, "none": {"stringValue": ""},
        "null": {"stringValue": ""}, "old": {"stringValue": "one"}, "new": {"stringValue": "5"}, "cleared": {"stringValue": ""},
    }
    assert {a["key"]: a["value"] for a in got["resource"]["attributes"]} == {"zone": {"intValue": "7"}, "of": {"stringValue": "other"}}
    assert [r["body"] for r in got["scopeLogs"][0]["logRecords"]] == [
        {"stringValue": "seven"}, {"stringValue": ""}, {"stringValue": ""}, {"kvlistValue": {"values": []}}]
