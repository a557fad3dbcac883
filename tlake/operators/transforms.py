"""Ingest transforms and filters on log rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tlake.functions import (
    as_bigint,
    computed_once,
    literal_time,
    looked_up,
    map_text,
    own_key,
    text,
    unix_nanos,
    upsert,
)
from tlake.functions.attributes import empty_map
from tlake.functions.scalar import bucket_micros
from tlake.operators.flatten import finish_logs, log_rows
from tlake.schemas import PODS


def fix_time(df: DataFrame, now: datetime | str | Column | None = None) -> DataFrame:
    """Repair event and observed time (0 or NULL = not set).

    Event time falls back to ``now``, observed time to the event time. A record
    that has only an observed time still gets ``now`` as event time.
    """
    now_ns = unix_nanos(F.localtimestamp() if now is None else literal_time(now))
    unset = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    at = F.when(unset("Timestamp_ns"), now_ns).otherwise(F.col("Timestamp_ns"))
    seen = F.when(unset("ObservedTimestamp_ns"), at).otherwise(F.col("ObservedTimestamp_ns"))
    return finish_logs(df.withColumns({"Timestamp_ns": at, "ObservedTimestamp_ns": seen}))


def upsert_attr(df: DataFrame, map_col: str, key: str, value: str | Column) -> DataFrame:
    return df.withColumn(map_col, upsert(map_col, {key: value}))


def set_log_type(df: DataFrame, value: str, overwrite: bool = True) -> DataFrame:
    """Stamp the record with its pipeline; ``overwrite=False`` keeps a value already there."""
    if not overwrite:
        old = F.try_element_at("LogAttributes", F.lit("log_type"))
        return upsert_attr(df, "LogAttributes", "log_type", F.coalesce(old, F.lit(value)))
    return upsert_attr(df, "LogAttributes", "log_type", value)


def has_session() -> Column:
    """True when the record carries a session id; an empty one counts."""
    m = F.coalesce(F.col("LogAttributes"), empty_map())
    return F.map_contains_key(m, "sessionId")


def split_sessions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary logs, session records); every record is in exactly one of them."""
    return df.filter(~has_session()), df.filter(has_session())


def unique_pods(pods: DataFrame) -> DataFrame:
    """One row per (pod, namespace), so that enrichment cannot multiply records."""
    rest = ("pod_uid", "container_name", "node_name")
    return (
        pods.groupBy("pod_name", "namespace")
        .agg(F.max(F.struct(*rest)).alias("_p"))
        .select("pod_name", "namespace", *[F.col(f"_p.{c}").alias(c) for c in rest])
    )


def enrich_k8s(df: DataFrame, pods: DataFrame) -> DataFrame:
    """Add pod metadata to the resource attributes by pod name and namespace.

    No hint: Spark broadcasts the pod table when its size allows and otherwise
    joins by shuffle. Records without both keys cannot match; they get a key of
    their own, or they would all meet in one shuffle partition.
    """
    pod = F.try_element_at("ResourceAttributes", F.lit("k8s.pod.name"))
    ns = F.try_element_at("ResourceAttributes", F.lit("k8s.namespace.name"))
    both = pod.isNotNull() & ns.isNotNull()
    keyed = df.withColumns(
        {"_pod": own_key(pod, both, "Timestamp_ns", "TraceId", "SpanId", "Body"), "_ns": F.coalesce(ns, F.lit(""))}
    )
    p = unique_pods(pods).withColumn("_key", looked_up("pod_name"))
    joined = keyed.join(p, (keyed["_pod"] == p["_key"]) & (keyed["_ns"] == p["namespace"]), "left")
    return _with_pod(joined.withColumn("_p", F.when(F.col("pod_name").isNotNull(), F.struct(*PODS.names))), "_p").select(*df.columns)


def _with_pod(df: DataFrame, pod: str) -> DataFrame:
    """Resource attributes with what a pod (a struct, NULL: none) has for them. What a record says of itself stays: only
    keys that are absent or empty are filled."""
    own = lambda key, c: F.coalesce(F.nullif(F.try_element_at("ResourceAttributes", F.lit(key)), F.lit("")), text(c))
    told = {
        "k8s.pod.name": "pod_name",
        "k8s.pod.uid": "pod_uid",
        "k8s.namespace.name": "namespace",
        "k8s.container.name": "container_name",
        "k8s.node.name": "node_name",
    }
    found = upsert("ResourceAttributes", {key: own(key, F.col(f"{pod}.{c}")) for key, c in told.items()})
    return df.withColumn(
        "ResourceAttributes", F.when(F.col(pod).isNotNull(), found).otherwise(F.col("ResourceAttributes"))
    )


def enrich_k8s_as_of(df: DataFrame, lives: DataFrame, bucket: str = "1 day") -> DataFrame:
    """As ``enrich_k8s``, with the pod that bore the name when the record was made.

    ``lives`` has the columns of the pod table with ``valid_from_ns`` and ``valid_to_ns`` (exclusive, NULL: still there).
    A life also ends where the next one of the same name begins. A StatefulSet gives the same name to pod after pod, so
    a name has any number of lives. Those that have ended are cut at the borders of fixed time buckets, and a record looks
    up (name, namespace, bucket), where only the lives of that bucket are compared; of those without an end there is at
    most one per name, so it is looked up by name alone. Records at a time without a life stay as they are.
    """
    width = F.lit(bucket_micros(bucket) * 1000).cast("bigint")
    div = lambda a, b: F.call_function("div", a, b)
    rest = ("pod_uid", "container_name", "node_name")
    own = Window.partitionBy("pod_name", "namespace").orderBy("valid_from_ns", F.coalesce("pod_uid", F.lit("")))
    given = lives.select("pod_name", "namespace", *rest, "valid_from_ns", F.least("valid_to_ns", F.lead("valid_from_ns").over(own)).alias("end"))
    given = given.filter(F.col("valid_from_ns").isNotNull()).withColumn("_key", looked_up("pod_name"))
    here = F.struct("pod_name", "namespace", *rest)
    ended = given.filter(F.col("end") > F.col("valid_from_ns")).select(
        F.col("_key").alias("_k1"), F.col("namespace").alias("_n1"), F.col("valid_from_ns").alias("_f1"), F.col("end").alias("_e1"),
        here.alias("_p1"), F.explode(F.sequence(div(F.col("valid_from_ns"), width), div(F.col("end") - 1, width))).alias("_b1"),
    )
    lasting = given.filter(F.col("end").isNull()).select(
        F.col("_key").alias("_k2"), F.col("namespace").alias("_n2"), F.col("valid_from_ns").alias("_f2"), here.alias("_p2")
    )
    pod, ns = (F.try_element_at("ResourceAttributes", F.lit(f"k8s.{x}.name")) for x in ("pod", "namespace"))
    both, at = pod.isNotNull() & ns.isNotNull(), F.col("Timestamp_ns")
    keyed = df.withColumns({
        "_pod": own_key(pod, both, "Timestamp_ns", "TraceId", "SpanId", "Body"), "_ns": F.coalesce(ns, F.lit("")),
        "_bucket": div(at, width),
    })
    k = F.col
    joined = keyed.join(
        ended, (k("_pod") == k("_k1")) & (k("_ns") == k("_n1")) & (k("_bucket") == k("_b1")) & (at >= k("_f1")) & (at < k("_e1")), "left"
    ).join(lasting, (k("_pod") == k("_k2")) & (k("_ns") == k("_n2")) & (at >= k("_f2")), "left")
    return _with_pod(joined.withColumn("_p", F.coalesce("_p1", "_p2")), "_p").select(*df.columns)


def rfc3339_nanos(x: Column) -> Column:
    """RFC 3339 text with up to nine fraction digits → nanoseconds; NULL when malformed.

    The cast reads zone and microseconds; digits seven to nine are added.
    """
    micros = F.unix_micros(x.try_cast("timestamp"))
    six = F.substring(x, 21, 6)
    long_fraction = (F.length(six) == 6) & (F.translate(six, "0123456789", "") == "")
    rest = F.rpad(F.regexp_extract(F.substring(x, 27, 3), "^[0-9]*", 0), 3, "0")
    return micros * 1000 + F.when(long_fraction, as_bigint(rest)).otherwise(F.lit(0))


# A log file's path up to ``.log``, and what a rotation has put behind it.
_LOG_FILE = r"^(.*\.log)(?:\.(.+))?$"
_LIVE = "~"  # sorts behind every time of rotation


def container_lines(df: DataFrame) -> DataFrame:
    """Single lines of both formats → file, position, stream, full flag, message, time.

    JSON lines carry log, stream and time; the others are ``time stream tag message``.
    A line of neither format is passed on as a whole message without stream and time;
    empty lines are left out. ``source`` is the file without the time of its rotation, ``file_no``
    that time, which orders the files of one source; the file still written to is the last.
    """
    v = F.col("value")
    is_json = v.startswith("{")
    line = F.struct(
        F.when(is_json, F.from_json(v, "log STRING, stream STRING, time STRING")).alias("j"),
        F.when(~is_json, F.split(v, " ", 4)).alias("p"),
    )
    rows = computed_once(df.filter(v != ""), line, "line")
    part = lambda i: F.get("line.p", i)
    j = F.col("line.j")
    plain = part(1).isin("stdout", "stderr") & F.substring(part(2), 1, 1).isin("F", "P")
    docker = j["log"].isNotNull()
    path = F.col("file_path")
    return rows.select(
        "file_path", "block_start", "line_no",
        F.coalesce(F.nullif(F.regexp_extract(path, _LOG_FILE, 1), F.lit("")), path).alias("source"),
        F.coalesce(F.nullif(F.regexp_extract(path, _LOG_FILE, 2), F.lit("")), F.lit(_LIVE)).alias("file_no"),
        F.when(docker, text(j["stream"])).when(plain, part(1)).otherwise("").alias("stream"),
        F.when(docker, j["log"].endswith("\n")).when(plain, part(2).startswith("F")).otherwise(True).alias("full"),
        F.when(docker, F.regexp_replace(j["log"], r"\n$", "")).when(plain, text(part(3))).otherwise(v).alias("msg"),
        F.coalesce(rfc3339_nanos(F.when(docker, j["time"]).when(plain, part(0))), F.lit(0).cast("bigint")).alias("ns"),
    )


def unknown_format(value: str = "value") -> Column:
    """A line, not empty, of neither container log format; ``container_lines`` passes it on as a whole message."""
    v = F.col(value)
    p = F.split(v, " ", 4)
    plain = F.get(p, 1).isin("stdout", "stderr") & F.substring(F.get(p, 2), 1, 1).isin("F", "P")
    docker = v.startswith("{") & F.from_json(v, "log STRING")["log"].isNotNull()
    return (v != "") & ~F.coalesce(docker, F.lit(False)) & ~F.coalesce(plain & ~v.startswith("{"), F.lit(False))


#: What is kept of a message without its last line until the next batch.
FRAGMENTS = (
    "source STRING, stream STRING, file_path STRING, "
    "parts ARRAY<STRUCT<line_no: BIGINT, ns: BIGINT, msg: STRING>>, carried INT"
)


def merge_fragments(lines: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """Runs of lines up to the next full line of the same (source, stream), in line order, also over a rotation.

    Result: source, stream, file_path, parts, ``closed`` (a full line ends the run) and ``carried``, the batches it has been
    open for. ``fragments`` are the open runs of the batch before; lines that follow continue them.

    Runs are found per input block, so one long file is spread over its blocks. Inside a
    block a run is numbered by the full lines before it. Only the first run of a block and
    an open last one can belong to a message that crosses blocks or files: at most two rows per
    block and stream, which are numbered again over the whole source. Both parts read the
    same shuffled lines.
    """
    full = F.col("full").cast("bigint")
    block = ("source", "stream", "file_no", "block_start")
    up_to_here = Window.partitionBy(*block).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        lines.withColumn("local", F.coalesce(F.sum(full).over(up_to_here), F.lit(0)))
        .groupBy(*block, "local")
        .agg(
            F.array_sort(F.collect_list(F.struct("line_no", "ns", "msg"))).alias("parts"),
            F.max("full").alias("closed"), F.min("file_path").alias("file_path"),
        )
    )
    edge = (F.col("local") == 0) | ~F.col("closed")
    pieces = runs.filter(edge).withColumn("carried", F.lit(0))
    if fragments is not None:
        before = fragments.select(
            "source", "stream", F.lit("").alias("file_no"), F.lit(-1).cast("bigint").alias("block_start"),
            F.lit(0).cast("bigint").alias("local"), "parts", F.lit(False).alias("closed"), "file_path", "carried",
        )
        pieces = pieces.unionByName(before)
    along_source = (
        Window.partitionBy("source", "stream").orderBy("file_no", "block_start", "local")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    crossing = (
        pieces.withColumn("run", F.coalesce(F.sum(F.col("closed").cast("bigint")).over(along_source), F.lit(0)))
        .groupBy("source", "stream", "run")
        .agg(
            F.array_sort(F.collect_list(F.struct("file_no", "block_start", "local", "file_path", "parts"))).alias("pieces"),
            F.max("closed").alias("closed"), (F.max("carried") + 1).alias("carried"),
        )
        .select(
            "source", "stream", F.col("pieces")[0]["file_path"].alias("file_path"),
            F.flatten(F.transform("pieces", lambda x: x["parts"])).alias("parts"), "closed", "carried",
        )
    )
    inner = runs.filter(~edge).select("source", "stream", "file_path", "parts", "closed", F.lit(0).alias("carried"))
    return inner.unionByName(crossing)


def container_rows(messages: DataFrame) -> DataFrame:
    """Merged messages → log rows, with what the path says of pod and container."""
    # …/<namespace>_<pod>_<uid>/<container>/<restart>.log
    steps = messages.withColumn("_d", F.split("source", "/")).withColumn("_pod", F.split(F.try_element_at("_d", F.lit(-3)), "_"))
    known = (F.size("_pod") == 3) & F.try_element_at("_d", F.lit(-1)).endswith(".log")
    resource = F.when(
        known,
        F.create_map(
            F.lit("k8s.namespace.name"), F.get("_pod", 0), F.lit("k8s.pod.name"), F.get("_pod", 1),
            F.lit("k8s.pod.uid"), F.get("_pod", 2), F.lit("k8s.container.name"), F.try_element_at("_d", F.lit(-2)),
            F.lit("k8s.container.restart_count"), F.substring_index(F.try_element_at("_d", F.lit(-1)), ".", 1),
        ),
    ).otherwise(empty_map())
    return log_rows(
        steps,
        {
            "Timestamp_ns": F.col("parts")[0]["ns"],
            "Body": F.array_join(F.transform("parts", lambda x: x["msg"]), ""),
            "ResourceAttributes": resource,
            "LogAttributes": F.create_map(
                F.lit("log.file.path"), F.col("file_path"), F.lit("log.iostream"), F.col("stream")
            ),
        },
    )


def parse_container(df: DataFrame) -> DataFrame:
    """Container log lines → log rows; fragments of one message are joined.

    Input: ``value``, ``file_path`` and the line position ``block_start, line_no``. A
    message is one row, so its fragments meet in one task. What is still open at the end becomes a message.
    """
    return container_rows(merge_fragments(container_lines(df)))


def filter_logs(
    df: DataFrame,
    level: str | None = None,
    service: str | None = None,
    attrs: dict[str, str] | None = None,
) -> DataFrame:
    """By severity, service and attribute values; scalar conditions reach the scan."""
    if level is not None:
        df = df.filter(F.col("SeverityText") == level)
    if service is not None:
        df = df.filter(F.col("ServiceName") == service)
    for k, v in (attrs or {}).items():
        df = df.filter(map_text("LogAttributes", k) == v)
    return df


def search(df: DataFrame, pattern: str, column: str = "Body", regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """Text search in the implicit column, by substring or by regular expression."""
    c = F.col(column)
    if regex:
        return df.filter(c.rlike(f"(?i){pattern}" if ignore_case else pattern))
    if ignore_case:
        return df.filter(F.lower(c).contains(pattern.lower()))
    return df.filter(c.contains(pattern))


def has_trace(df: DataFrame) -> DataFrame:
    return df.filter(F.col("TraceId") != "")


def recent(df: DataFrame, as_of: datetime | str | Column, hours: int = 1, column: str = "Timestamp") -> DataFrame:
    """Rows of the last hours before ``as_of`` (inclusive), never wall-clock time."""
    return df.filter(F.col(column) >= literal_time(as_of) - F.expr(f"INTERVAL {int(hours)} HOUR"))
