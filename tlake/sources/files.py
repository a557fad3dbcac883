"""Container log files, journal exports and metric text snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tlake import schemas
from tlake.functions import (
    as_bigint,
    attr_key,
    computed_once,
    empty_map,
    from_micros,
    from_unix_nanos,
    literal_time,
    map_text,
    text,
    unix_nanos,
    upsert,
)
from tlake.operators.flatten import log_rows
from tlake.session import prepare


def read_container_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of container log files with their position.

    Inside one input split lines are read in file order, so
    ``(file_path, block_start, line_no)`` is the line order of each file.
    """
    prepare(spark)
    return spark.read.text(glob).select(
        "value",
        "_metadata.file_path",
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
    )


# Journal priorities 0..7 as severity text and number.
PRIORITIES = [
    ("emerg", 21), ("alert", 19), ("crit", 18), ("err", 17),
    ("warning", 13), ("notice", 10), ("info", 9), ("debug", 5),
]


def parse_journal(lines: DataFrame) -> DataFrame:
    """Journal export lines (column ``value``) → log rows; other fields become attributes."""
    prepare(lines.sparkSession)
    entry = F.from_json("value", "map<string,string>")
    e = F.col("e")
    prio = as_bigint(map_text(e, "PRIORITY"))
    sev = F.lit("")
    num = F.lit(0)
    for i, (name, n) in enumerate(PRIORITIES):
        sev = F.when(prio == i, F.lit(name)).otherwise(sev)
        num = F.when(prio == i, F.lit(n)).otherwise(num)
    own = ("MESSAGE", "PRIORITY", "__REALTIME_TIMESTAMP")
    return log_rows(
        computed_once(lines.select("value"), entry, "e").filter(e.isNotNull()),
        {
            "Timestamp_ns": F.coalesce(F.try_multiply(as_bigint(map_text(e, "__REALTIME_TIMESTAMP")), F.lit(1000)), F.lit(0)),
            "SeverityText": sev,
            "SeverityNumber": num,
            "ServiceName": map_text(e, "_SYSTEMD_UNIT"),
            "Body": map_text(e, "MESSAGE"),
            "LogAttributes": F.transform_values(
                F.map_filter(e, lambda k, _: ~k.isin(*own)), lambda _, v: text(v)
            ),
        },
    )


def read_journal_json(
    spark: SparkSession,
    path: str,
    since: datetime | str | None = None,
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Journal exports (JSON lines). ``since`` is the start position "from the end":
    files last written before it are not read and older entries are dropped."""
    lines = read_journal_lines(spark, path, since, streaming, **options)
    return journal_since(parse_journal(lines), since)


def read_journal_lines(
    spark: SparkSession, path: str, since: datetime | str | None = None, streaming: bool = False, **options: str
) -> DataFrame:
    """Lines of journal exports with their file; without files that were last written before ``since``."""
    prepare(spark)
    reader = spark.readStream if streaming else spark.read
    lines = reader.option("recursiveFileLookup", "true").options(**options).text(path)
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time").cast("timestamp_ntz") >= literal_time(since))
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"))


def journal_since(rows: DataFrame, since: datetime | str | None) -> DataFrame:
    return rows if since is None else rows.filter(F.col("Timestamp") >= literal_time(since))


_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
_TYPE = r"^#\s+TYPE\s+(\S+)\s+(\S+)\s*$"
_HELP = r"^#\s+HELP\s+(\S+)\s+(.*)$"
# Inside braces: anything but quotes and a closing brace, and quoted text. Possessive, so that no line is tried twice.
_INSIDE = r'[^"}]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"}]*+)*+'
# name {labels} value time # exemplar; the exemplar, if it is one, {labels} value time.
_SAMPLE = rf"^\s*([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\s*\{{({_INSIDE})\}}\s*|\s+)([^\s#]+)(?:\s+([^\s#]+))?\s*(?:#\s*(.*))?$"
_EXEMPLAR = rf"^\{{({_INSIDE})\}}\s+(\S+)(?:\s+(\S+))?\s*$"
_CUT = "\ufdd0"  # no character, so it stands in no text


def _unescape(v: Column) -> Column:
    for code, char in (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")):
        v = F.replace(v, F.lit(code), F.lit(char))
    return v


def _labels(x: Column) -> Column:
    values = F.regexp_extract_all(x, F.lit(_LABEL), 2)
    values = F.when(x.contains("\\"), F.transform(values, _unescape)).otherwise(values)
    return F.map_from_arrays(F.regexp_extract_all(x, F.lit(_LABEL), 1), values)


def _parts(x: Column, grammar: str, n: int) -> Column:
    """The groups of a grammar that the whole text follows, by one pass over it; other text is one part."""
    return F.split(F.regexp_replace(x, grammar, _CUT.join(f"${i + 1}" for i in range(n))), _CUT)


def _exemplar(x: Column) -> Column:
    """What stands behind ``#`` as a struct that can be compared; NULL where it is no exemplar. Its time is in seconds."""
    e = _parts(x, _EXEMPLAR, 3)
    nanos = (F.get(e, 2).try_cast("decimal(38,9)") * 1_000_000_000).try_cast("bigint")
    value = F.get(e, 1).try_cast("double")
    return F.when(
        (x != "") & (F.size(e) == 3) & value.isNotNull() & ((F.get(e, 2) == "") | nanos.isNotNull()),
        F.struct(F.coalesce(nanos, F.lit(0)).alias("ns"), value.alias("value"), F.get(e, 0).alias("labels")),
    )


def _exemplars(list_: Column) -> Column:
    """Compared structs → the exemplars of a point: ids of their own, other labels as attributes."""

    def one(e: Column) -> Column:
        labels = _labels(e["labels"])
        return F.struct(
            F.map_filter(labels, lambda k, _: ~k.isin("trace_id", "span_id")).alias("FilteredAttributes"),
            from_unix_nanos(e["ns"]).alias("TimeUnix"), e["ns"].alias("TimeUnix_ns"), e["value"].alias("Value"),
            map_text(labels, "span_id").alias("SpanId"), map_text(labels, "trace_id").alias("TraceId"),
        )

    return F.transform(list_, one)


def _samples(lines: DataFrame) -> DataFrame:
    """``name{labels} value [time] [# exemplar]`` lines; others are left out, and what is no exemplar behind a sample."""
    rows = computed_once(lines.filter(~F.col("value").startswith("#")), _parts(F.col("value"), _SAMPLE, 5), "s")
    part = lambda i: F.get("s", i)
    at = as_bigint(part(3))
    x = part(2).try_cast("double")
    valid = (F.size("s") == 5) & x.isNotNull()
    return rows.filter(valid).select(
        "source", F.coalesce(from_micros(F.try_multiply(at, F.lit(1000))), F.col("scraped_at")).alias("at"),
        part(0).alias("name"), _labels(part(1)).alias("labels"), x.alias("x"), _exemplar(part(4)).alias("exemplar"),
    )


def is_sample(value: str = "value") -> Column:
    """A line of scraped text that is a comment, blank or a sample."""
    v = F.col(value)
    s = _parts(v, _SAMPLE, 5)
    return v.startswith("#") | (F.trim(v) == "") | ((F.size(s) == 5) & F.get(s, 2).try_cast("double").isNotNull())


def _without(m: str, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != F.lit(key))


def parse_prom_text(lines: DataFrame, job: str = "") -> dict[str, DataFrame]:
    """Exposition text → metric rows by kind (gauge, sum, histogram, summary).

    Input columns: ``value`` (line), ``source`` (snapshot id), ``scraped_at``. Exemplars go to the point of their
    sample, those of buckets to the histogram's point, in order of time.
    """
    prepare(lines.sparkSession)
    v = F.col("value")
    meta = lines.filter(v.startswith("#"))
    declared = (
        meta.select(
            "source",
            F.coalesce(F.nullif(F.regexp_extract(v, _TYPE, 1), F.lit("")),
                       F.regexp_extract(v, _HELP, 1)).alias("family"),
            F.nullif(F.regexp_extract(v, _TYPE, 2), F.lit("")).alias("type"),
            F.nullif(F.regexp_extract(v, _HELP, 2), F.lit("")).alias("help"),
        )
        .filter("family <> ''")
        .groupBy("source", "family")
        .agg(F.max("type").alias("type"), F.max("help").alias("help"))
    )
    # Which sample names belong to a family, and in which role.
    roles = {
        "histogram": {"_bucket": "bucket", "_sum": "sum", "_count": "count"},
        "summary": {"": "quantile", "_sum": "sum", "_count": "count"},
        "counter": {"": "value", "_total": "value"},
    }
    names = F.array(F.struct(F.lit("").alias("suffix"), F.lit("value").alias("role")))
    for t, rs in roles.items():
        arr = F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(r).alias("role")) for s, r in rs.items()])
        names = F.when(F.col("type") == t, arr).otherwise(names)
    known = declared.select("source", "family", "type", "help", F.explode(names).alias("n")).select(
        "source", F.concat("family", "n.suffix").alias("name"), "family", "type", "help", "n.role"
    )
    samples = (
        _samples(lines)
        .join(known, ["source", "name"], "left")
        .withColumns({"family": F.coalesce("family", "name"), "type": F.coalesce("type", F.lit("unknown"))})
    )
    simple = samples.filter(~F.col("type").isin("histogram", "summary"))
    own_exemplar = F.when(F.col("exemplar").isNotNull(), F.array("exemplar")).otherwise(F.slice(F.array("exemplar"), 1, 0))
    number = [F.col("x").alias("Value"), _exemplars(own_exemplar).alias("Exemplars")]
    counter = F.col("type") == "counter"
    out = {
        "gauge": _metric_rows(simple.filter(~counter), "gauge", job, F.col("name"), number),
        "sum": _metric_rows(
            simple.filter(counter), "sum", job, F.col("name"),
            [*number, F.lit(2).alias("AggregationTemporality"), F.lit(True).alias("IsMonotonic")],
        ),
    }
    # Points of one series in one snapshot; a group holds one row per bound or quantile.
    part = {"histogram": "le", "summary": "quantile"}
    for kind, label in part.items():
        series = _without("labels", label)
        points = (
            samples.filter(F.col("type") == kind)
            .select("source", "at", "family", "help", "role", "x", "exemplar", series.alias("labels"),
                    F.try_element_at("labels", F.lit(label)).try_cast("double").alias("edge"))
            .withColumn("key", attr_key("labels"))
            # Repeated lines become one value, so the list below has one entry per edge.
            .groupBy("source", "at", "family", "key", "role", "edge")
            .agg(
                F.max("x").alias("x"), F.first("labels").alias("labels"), F.max("help").alias("help"),
                F.max("exemplar").alias("exemplar"),
            )
            .groupBy("source", "at", "family", "key")
            .agg(
                F.first("labels").alias("labels"), F.max("help").alias("help"),
                F.max(F.when(F.col("role") == "sum", F.col("x"))).alias("total"),
                F.max(F.when(F.col("role") == "count", F.col("x"))).alias("n"),
                F.array_sort(
                    F.collect_list(F.when(F.col("edge").isNotNull(), F.struct("edge", "x")))
                ).alias("parts"),
                F.array_sort(F.collect_list("exemplar")).alias("exemplars"),
            )
        )
        head = [F.coalesce(F.col("n").try_cast("bigint"), F.lit(0)).alias("Count"), F.coalesce("total", F.lit(0.0)).alias("Sum")]
        if kind == "histogram":
            finite = F.filter("parts", lambda p: p["edge"] != F.lit(float("inf")))
            steps = F.transform(
                "parts",
                lambda p, i: F.coalesce(
                    (p["x"] - F.coalesce(F.get("parts", i - 1)["x"], F.lit(0.0))).try_cast("bigint"), F.lit(0)
                ),
            )
            body = [steps.alias("BucketCounts"), F.transform(finite, lambda p: p["edge"]).alias("ExplicitBounds"),
                    F.lit(2).alias("AggregationTemporality"), _exemplars(F.col("exemplars")).alias("Exemplars")]
        else:
            body = [F.transform("parts", lambda p: F.struct(p["edge"].alias("Quantile"), p["x"].alias("Value")))
                    .alias("ValueAtQuantiles")]
        out[kind] = _metric_rows(points, kind, job, F.col("family"), [*head, *body])
    return out


def _metric_rows(df: DataFrame, kind: str, job: str, name: Column, own: list[Column]) -> DataFrame:
    schema = schemas.TABLES[schemas.metric_table(kind)]
    resource = upsert(empty_map(), {"service.name": job}) if job else empty_map()
    given = df.select(
        resource.alias("ResourceAttributes"), F.lit(job).alias("ServiceName"), name.alias("MetricName"),
        text("help").alias("MetricDescription"), F.col("labels").alias("Attributes"),
        F.col("at").alias("TimeUnix"), unix_nanos("at").alias("TimeUnix_ns"), *own,
    )
    cols = []
    for f in schema.fields:
        if f.name in given.columns:
            c = F.col(f.name).cast(f.dataType)
        elif f.name == "StartTimeUnix":
            c = from_unix_nanos(F.lit(0).cast("bigint"))
        elif f.dataType.typeName() == "string":
            c = F.lit("")
        elif f.dataType.typeName() == "map":
            c = empty_map()
        elif f.dataType.typeName() == "array":
            c = F.array().cast(f.dataType)
        else:
            c = F.lit(0).cast(f.dataType)
        cols.append(c.alias(f.name))
    return given.select(*cols)


def read_prom_text(spark: SparkSession, path: str, job: str = "") -> dict[str, DataFrame]:
    """Snapshot files, one scrape per file; the file time stands for the scrape time."""
    prepare(spark)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("scraped_at"),
    )
    return parse_prom_text(lines, job)
