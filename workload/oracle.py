"""The expected results in SQL over the same tables."""

from __future__ import annotations

# -- derived tables ---------------------------------------------------------------

LOGS = """
logs AS (
  SELECT event_id, ts, date_trunc('second', ts) AS ts_s, epoch_us(ts) * 1000 AS ns, user_id, event_type,
    CASE WHEN event_id % 10 = 0 THEN '' ELSE lpad(lower(hex(event_id // 8 + 1)), 32, '0') END AS trace_id,
    lpad(lower(hex(event_id + 1)), 16, '0') AS span_id,
    'svc-' || (user_id % 5) AS svc,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS sev,
    event_type || ' by user ' || user_id AS body,
    json_extract_string(props, '$.k') AS k,
    CASE WHEN user_id % 3 = 0 THEN 's-' || user_id ELSE '' END AS session_id,
    'pod-' || (user_id % 30) AS pod, 'ns-' || (user_id % 4) AS ns_name,
    CAST(round(value * 100) AS BIGINT) AS cents, value
  FROM events)
"""

SPANS = """
spans AS (
  SELECT event_id, ts, epoch_us(ts) * 1000 AS ns,
    lpad(lower(hex(event_id // 8 + 1)), 32, '0') AS trace_id,
    lpad(lower(hex(event_id + 1)), 16, '0') AS span_id,
    CASE WHEN event_id % 8 = 0 THEN ''
         ELSE lpad(lower(hex(event_id // 8 * 8 + (event_id % 8 + 1) // 2)), 16, '0') END AS parent_id,
    event_type AS span_name, CASE WHEN event_id % 8 = 0 THEN 'Server' ELSE 'Internal' END AS kind,
    'svc-' || (event_id % 5) AS svc, CAST(round(value * 100) AS BIGINT) * 10000 AS dur,
    CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ok' END AS status,
    CASE WHEN event_type = 'error' THEN event_type || ' by user ' || user_id ELSE '' END AS msg,
    json_extract_string(props, '$.k') AS k
  FROM events)
"""

SESSIONS = """
sess AS (
  SELECT 'conv-' || conv_id AS sid,
    TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE AS ts,
    CASE WHEN turn = 0 THEN '' ELSE lpad(lower(hex(conv_id + 1)), 32, '0') END AS trace_id, text
  FROM conversations)
"""

INV = """
inv AS (
  SELECT 't' || l_linenumber || '_local' AS tab, CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
    count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS comp,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS uncomp,
    min(l_shipdate) AS oldest, max(l_shipdate) AS newest,
    CASE WHEN date_trunc('month', l_shipdate) < DATE '1998-01-01' THEN 'cold' ELSE 'hot' END AS tier
  FROM lineitem GROUP BY ALL)
"""

HIST = """
hist AS (
  SELECT svc, event_type, date_trunc('hour', ts) AS hr, count(*) AS n, CAST(sum(cents) AS BIGINT) AS s,
    min(value) AS lo, max(value) AS hi,
    count(*) FILTER (value <= 5) AS c0, count(*) FILTER (value > 5 AND value <= 10) AS c1,
    count(*) FILTER (value > 10 AND value <= 25) AS c2, count(*) FILTER (value > 25 AND value <= 50) AS c3,
    count(*) FILTER (value > 50 AND value <= 100) AS c4, count(*) FILTER (value > 100 AND value <= 250) AS c5,
    count(*) FILTER (value > 250) AS c6
  FROM logs GROUP BY ALL)
"""

# Base-2 bucket (2^i, 2^(i+1)] by comparing whole cents with the bounds.
EXP = """
bounds AS (SELECT unnest(range(-8, 40)) AS i),
expo AS (
  SELECT l.svc, l.event_type, date_trunc('hour', l.ts) AS hr, l.cents, b.i
  FROM logs l LEFT JOIN bounds b
    ON l.cents > 0 AND l.cents > 100 * pow(2.0, b.i) AND l.cents <= 100 * pow(2.0, b.i + 1))
"""

SUMMARY = """
ranked AS (
  SELECT svc, date_trunc('hour', ts) AS hr, cents,
    row_number() OVER (PARTITION BY svc, date_trunc('hour', ts) ORDER BY cents) - 1 AS r,
    count(*) OVER (PARTITION BY svc, date_trunc('hour', ts)) AS n
  FROM logs),
summ AS (
  SELECT svc, hr, n, CAST(sum(cents) AS BIGINT) AS s, {cols}
  FROM ranked GROUP BY svc, hr, n)
"""


def interpolated(q: float, value: str) -> str:
    """Percentile by rank from columns r (0-based) and n."""
    pos = f"({q}::DOUBLE * (n - 1))"
    lo = f"max({value}) FILTER (r = CAST(floor({pos}) AS BIGINT))"
    hi = f"max({value}) FILTER (r = CAST(ceil({pos}) AS BIGINT))"
    return f"{lo} + ({hi} - {lo}) * ({pos} - floor({pos}))"


SUMMARY = SUMMARY.format(
    cols=", ".join(f"round({interpolated(q, 'cents')}, 3) AS q{int(q * 100)}" for q in (0.5, 0.9, 0.99))
)


def readable(n: str) -> str:
    """Byte count as text with a binary unit, two decimals."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    cases = [f"WHEN {n} < {1024 ** (i + 1)} THEN printf('%.2f {u}', {n} / {1024 ** i}::DOUBLE)" for i, u in enumerate(units)]
    return f"CASE {' '.join(cases)} END"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"


L, S = _with(LOGS), _with(SPANS)
AS_OF = "TIMESTAMP '2024-02-05 12:00:00'"
DAY_OF = "CAST(ts AS DATE)"

_TRACE_FIELDS = (
    'trace_id AS "traceId", span_id AS "spanId", parent_id AS "parentSpanId", span_name AS operation, '
    'svc AS service, dur AS duration, ts AS "start", kind, status, msg AS message, k, svc AS "serviceTag"'
)

_TREE = """
kids AS (SELECT trace_id, parent_id, CAST(sum(dur) AS BIGINT) AS d, count(*) AS c FROM spans
         WHERE parent_id <> '' GROUP BY ALL)
"""

_METRIC_COUNTS = _with(LOGS, HIST, SUMMARY) + """
SELECT 'gauge' AS kind, svc AS "ServiceName", count(*) AS n, {cols_ts} FROM logs GROUP BY svc
UNION ALL SELECT 'sum', svc, count(*), {cols_ts} FROM logs GROUP BY svc
UNION ALL SELECT 'histogram', svc, count(*), {cols_at} FROM hist GROUP BY svc
UNION ALL SELECT 'exp_histogram', svc, count(*), {cols_at} FROM hist GROUP BY svc
UNION ALL SELECT 'summary', svc, count(*), {cols_sum} FROM summ GROUP BY svc
"""

_STORED_METRICS = _METRIC_COUNTS.format(
    cols_ts="min(ts) AS oldest, max(ts) AS newest", cols_at="min(hr) AS oldest, max(hr) AS newest",
    cols_sum="min(hr) AS oldest, max(hr) AS newest",
)

_PROM = 'hr AS "TimeUnix", svc, event_type AS type'

_SESSION_LIST = """
SELECT session_id AS "sessionId", min(ts) AS start, max(ts) AS "end", count(*) AS n,
  epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
FROM logs WHERE session_id <> '' GROUP BY session_id
"""

# What the path of a container log file says.
_ORIGIN = "ns_name AS namespace, pod, 'uid' AS uid, 'app' AS container, '0' AS restart"

ORACLE: dict[str, str] = {
    # recent windows, extents, top-k
    "top_metrics_by_service": L + """
        SELECT svc AS "ServiceName", event_type AS "MetricName", count(*) AS n FROM logs
        WHERE ts >= (SELECT max(ts) FROM logs) - INTERVAL 1 HOUR
        GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10""",
    "recent_log_count": """
        SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "recent_trace_count": """
        SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "trace_time_ranges": L + """
        SELECT trace_id AS "TraceId", min(ts) AS "Start", max(ts) AS "End" FROM logs
        WHERE trace_id <> '' GROUP BY trace_id""",
    "table_extent": "SELECT count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM events",
    "exact_distinct_services": L + "SELECT count(DISTINCT svc) AS n_distinct FROM logs",
    # unnesting
    "otlp_flatten_logs": L + """
        SELECT ts AS timestamp, svc AS service_name, sev AS severity, body, trace_id, span_id, k, session_id FROM logs""",
    "otlp_log_rows": L + """
        SELECT ts AS "Timestamp", ns AS "Timestamp_ns", ts_s AS "TimestampTime", sev AS "SeverityText",
          CAST(0 AS INTEGER) AS "SeverityNumber", svc AS "ServiceName", body AS "Body", 'app' AS "ScopeName", pod,
          CAST(0 AS BIGINT) AS "TraceFlags" FROM logs""",
    "container_path_extract": L + """
        SELECT ts AS timestamp, ns_name AS namespace, pod AS pod_name, event_type AS container_name,
          body AS log_body, sev AS severity FROM logs""",
    "left_array_join_keeps_empty": """
        SELECT doc_id, coalesce(line, '') AS line FROM documents
        LEFT JOIN LATERAL (SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line)
          WHERE length(line) > 80) ON TRUE""",
    "three_level_array_join": L + "SELECT svc AS service, count(*) AS n FROM logs GROUP BY svc",
    "unnest_span_events": S + """
        SELECT trace_id AS "TraceId", span_id AS "SpanId", 'exception' AS "Events_Name", ts AS "Events_Timestamp", k
        FROM spans WHERE status = 'Error'""",
    "unnest_span_links": S + """
        SELECT span_id AS "SpanId", CASE WHEN event_id % 8 = 0 AND event_id >= 8
          THEN lpad(lower(hex(event_id // 8)), 32, '0') ELSE '' END AS "LinkedTrace" FROM spans""",
    "unnest_summary_quantiles": _with(LOGS, SUMMARY) + """
        SELECT svc AS "ServiceName", hr AS "TimeUnix", n AS "Count", CAST(0.5 AS DOUBLE) AS q, q50 AS v FROM summ
        UNION ALL SELECT svc, hr, n, CAST(0.9 AS DOUBLE), q90 FROM summ
        UNION ALL SELECT svc, hr, n, CAST(0.99 AS DOUBLE), q99 FROM summ""",
    # transforms
    "fix_time_rules": L + f"""
        , t AS (SELECT event_id, CASE WHEN event_id % 4 IN (1, 3) THEN epoch_us({AS_OF}) * 1000 ELSE ns END AS fixed,
          CASE WHEN event_id % 4 >= 2 THEN 0 ELSE ns + 1000000000 END AS seen FROM logs)
        SELECT event_id, make_timestamp(fixed // 1000) AS "Timestamp", fixed AS "Timestamp_ns",
          CASE WHEN seen = 0 THEN fixed ELSE seen END AS "ObservedTimestamp_ns",
          date_trunc('second', make_timestamp(fixed // 1000)) AS "TimestampTime" FROM t""",
    "split_no_session": L + """SELECT event_id, body AS "Body" FROM logs WHERE session_id = ''""",
    "split_session_only": L + "SELECT event_id, session_id FROM logs WHERE session_id <> ''",
    "set_log_type_overwrite": L + """
        SELECT event_id, 'otel' AS log_type, k, CAST(CASE WHEN user_id % 3 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_attrs FROM logs""",
    "set_log_type_keep": "SELECT event_id, event_type AS log_type FROM events",
    "upsert_resource_attr": L + "SELECT event_id, 'journal' AS log_type, svc AS service FROM logs",
    "enrich_pods": L + """
        SELECT event_id, pod AS pod_name, ns_name AS namespace,
          coalesce(CAST(n_nationkey AS VARCHAR), '') AS pod_uid, coalesce(n_name, '') AS container_name,
          coalesce('node-' || (n_nationkey % 3), '') AS node_name
        FROM logs LEFT JOIN nation ON pod = 'pod-' || n_nationkey AND ns_name = 'ns-' || n_regionkey""",
    "container_log_merge": L + """
        SELECT ts AS "Timestamp", body AS "Body", CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
          ns_name AS namespace, pod, 'uid' AS uid, 'app' AS container FROM logs""",
    "container_log_files": L + f"""
        SELECT CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, body AS "Body", {_ORIGIN},
          '' AS node, count(*) AS n FROM logs GROUP BY ALL""",
    "container_log_rotated": L + f"""
        SELECT ts AS "Timestamp", body AS "Body", CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
          {_ORIGIN}, '' AS node FROM logs""",
    "enrich_pods_as_of": L + """
        , lives AS (SELECT n_nationkey AS n, 'pod-' || n_nationkey AS pod, 'ns-' || n_regionkey AS ns_name, n_name, life,
            TIMESTAMP '2024-01-01' + life * INTERVAL 7 DAY AS start,
            CASE WHEN life < 2 THEN TIMESTAMP '2024-01-08' + life * INTERVAL 7 DAY
              WHEN n_nationkey % 2 = 1 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '9999-01-01' END AS stop
          FROM nation, (VALUES (0), (1), (2)) t(life))
        SELECT event_id, logs.ns_name AS namespace, logs.pod, coalesce(n || '-' || life, '') AS uid, coalesce(n_name, '') AS container,
          '' AS restart, coalesce('node-' || ((n + life) % 3), '') AS node
        FROM logs LEFT JOIN lives ON logs.pod = lives.pod AND logs.ns_name = lives.ns_name AND ts >= start AND ts < stop""",
    "journal_entries": L + """
        SELECT ts AS "Timestamp", body AS "Body",
          CASE event_type WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS "SeverityText",
          CAST(CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS INTEGER) AS "SeverityNumber",
          svc || '.service' AS "ServiceName", k AS pid, CAST(2 AS INTEGER) AS n_attrs FROM logs""",
    "prom_gauge": _with(LOGS, HIST) + f"""
        SELECT 'job' AS "ServiceName", 'events_now' AS "MetricName", 'events seen' AS "MetricDescription", {_PROM},
          CAST(n AS DOUBLE) AS "Value" FROM hist""",
    "prom_counter": _with(LOGS, HIST) + f"""
        SELECT 'cents_total' AS "MetricName", {_PROM}, CAST(s AS DOUBLE) AS "Value", TRUE AS "IsMonotonic",
          CAST(2 AS INTEGER) AS "AggregationTemporality" FROM hist""",
    "prom_histogram": _with(LOGS, HIST) + f"""
        SELECT 'value_dist' AS "MetricName", {_PROM}, n AS "Count", CAST(s AS DOUBLE) AS "Sum",
          concat_ws(',', c0, c1, c2, c3, c4, c5, c6) AS counts, CAST(6 AS INTEGER) AS n_bounds FROM hist""",
    "prom_summary": _with(LOGS, HIST) + f"""
        SELECT 'value_q' AS "MetricName", {_PROM}, n AS "Count", CAST(s AS DOUBLE) AS "Sum",
          CAST(0.5 AS DOUBLE) AS q, CAST(n AS DOUBLE) AS v FROM hist""",
    "prom_exemplars": _with(LOGS, HIST) + f"""
        , own AS (SELECT {_PROM}, lpad(lower(hex(n)), 32, '0') AS trace_id, lpad(lower(hex(n + 1)), 16, '0') AS span_id,
            epoch_us(hr) * 1000 + 250000000 AS ns FROM hist)
        SELECT 'cents_total' AS "MetricName", "TimeUnix", svc, type, CAST(1 AS DOUBLE) AS value, CAST(0 AS BIGINT) AS at_ns,
          trace_id, span_id, '' AS note, CAST(0 AS INTEGER) AS n_labels FROM own
        UNION ALL SELECT 'value_dist', "TimeUnix", svc, type, CAST(b AS DOUBLE), ns, trace_id, span_id, 'a "}}# b', 1
        FROM own, (VALUES (10), (50)) t(b)""",
    "otlp_spans": S + """
        SELECT ts AS "Timestamp", ns AS "Timestamp_ns", trace_id AS "TraceId", span_id AS "SpanId",
          parent_id AS "ParentSpanId", span_name AS "SpanName", kind AS "SpanKind", svc AS "ServiceName",
          dur AS "Duration", status AS "StatusCode", msg AS "StatusMessage",
          CAST(CASE WHEN status = 'Error' THEN 1 ELSE 0 END AS INTEGER) AS n_events,
          CAST(CASE WHEN event_id % 8 = 0 AND event_id >= 8 THEN 1 ELSE 0 END AS INTEGER) AS n_links, k FROM spans""",
    "otlp_metrics_gauge": L + """
        SELECT svc AS "ServiceName", event_type AS "MetricName", ts AS "TimeUnix", ns AS "TimeUnix_ns", value AS "Value", k,
          CAST(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_exemplars FROM logs""",
    "otlp_metrics_sum": L + """
        SELECT svc AS "ServiceName", event_type AS "MetricName", ts AS "TimeUnix", CAST(cents AS DOUBLE) AS "Value",
          CAST(user_id AS VARCHAR) AS "user", CAST(2 AS INTEGER) AS "AggregationTemporality", TRUE AS "IsMonotonic" FROM logs""",
    "otlp_metrics_histogram": _with(LOGS, HIST) + """
        SELECT svc AS "ServiceName", event_type AS "MetricName", hr AS "TimeUnix", n AS "Count", s / 100 AS "Sum",
          lo AS "Min", hi AS "Max", concat_ws(',', c0, c1, c2, c3, c4, c5, c6) AS counts,
          CAST(6 AS INTEGER) AS n_bounds FROM hist""",
    "otlp_metrics_exp_histogram": _with(LOGS, EXP) + """
        SELECT svc AS "ServiceName", event_type AS "MetricName", hr AS "TimeUnix", count(*) AS "Count",
          CAST(sum(cents) AS BIGINT) / 100 AS "Sum", CAST(0 AS INTEGER) AS "Scale",
          count(*) FILTER (i IS NULL) AS "ZeroCount", CAST(coalesce(min(i), 0) AS INTEGER) AS "PositiveOffset",
          CAST(coalesce(max(i) - min(i) + 1, 0) AS INTEGER) AS n_buckets, count(i) AS in_buckets
        FROM expo GROUP BY svc, event_type, hr""",
    "otlp_metrics_summary": _with(LOGS, SUMMARY) + """
        SELECT svc AS "ServiceName", 'value' AS "MetricName", hr AS "TimeUnix", n AS "Count", s / 100 AS "Sum",
          q50, q90, q99 FROM summ""",
    # projections and filters
    "logs_default_view": L + """
        SELECT ts AS "Timestamp", svc AS "ServiceName", sev AS "SeverityText", body AS "Body" FROM logs""",
    "spans_default_view": S + """
        SELECT ts AS "Timestamp", svc AS "ServiceName", status AS "StatusCode", round_even(dur / 1e6, 0) AS "DurationMs",
          span_name AS "SpanName" FROM spans""",
    "sessions_default_view": _with(SESSIONS) + """
        SELECT ts AS "Timestamp", 'web' AS "ServiceName", text AS "Body" FROM sess
        WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM sess)""",
    "logs_context_view": L + """
        SELECT ts AS time, sev AS level, body AS message, trace_id AS "TraceId", span_id AS "SpanId",
          svc AS "ServiceName", k, pod FROM logs""",
    "trace_field_view": S + f"SELECT {_TRACE_FIELDS} FROM spans",
    "filter_logs_by_fields": L + """
        SELECT event_id, body AS "Body" FROM logs WHERE event_type = 'error' AND svc = 'svc-1'""",
    "search_logs": L + """SELECT event_id, body AS "Body" FROM logs WHERE lower(body) LIKE '%purchase by%'""",
    "search_documents_regex": """
        SELECT doc_id, source FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')""",
    "inventory_like_filter": _with(INV) + """
        SELECT tab AS "table", count(*) AS files FROM inv
        WHERE tab LIKE '%_local' AND (tab IN ('t1_local', 't2_local') OR tier = 'hot') GROUP BY tab ORDER BY tab""",
    "traced_log_count": L + "SELECT count(*) AS n FROM logs WHERE trace_id <> ''",
    # joins
    "trace_lookup": S + """
        SELECT trace_id AS "TraceId", span_id AS "SpanId", ts AS "Timestamp", dur AS "Duration" FROM spans
        WHERE trace_id = (SELECT trace_id FROM spans ORDER BY dur DESC, trace_id LIMIT 1)""",
    "traces_with_errors": _with(LOGS, SPANS) + """
        SELECT trace_id AS "TraceId", span_id AS "SpanId", span_name AS "SpanName" FROM spans
        WHERE trace_id IN (SELECT trace_id FROM logs WHERE sev = 'ERROR' AND trace_id <> '')""",
    "logs_with_spans": _with(LOGS, SPANS) + """
        SELECT l.event_id, l.trace_id AS "TraceId", s.span_name AS "SpanName", s.svc AS "SpanService", s.dur AS "Duration"
        FROM logs l JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
    "logs_with_spans_left": _with(LOGS, SPANS) + """
        SELECT l.event_id, coalesce(s.span_name, '') AS "SpanName"
        FROM logs l LEFT JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
    "session_activity": _with(LOGS, SPANS, SESSIONS) + """
        , pairs AS (SELECT sid, trace_id, count(*) AS records FROM sess GROUP BY ALL),
        lc AS (SELECT trace_id, count(*) AS c FROM logs WHERE trace_id <> '' GROUP BY trace_id),
        sc AS (SELECT trace_id, count(*) AS c FROM spans GROUP BY trace_id)
        SELECT sid AS "sessionId", CAST(sum(records) AS BIGINT) AS records, count(*) FILTER (p.trace_id <> '') AS traces,
          CAST(coalesce(sum(lc.c), 0) AS BIGINT) AS logs, CAST(coalesce(sum(sc.c), 0) AS BIGINT) AS spans
        FROM pairs p LEFT JOIN lc ON p.trace_id = lc.trace_id LEFT JOIN sc ON p.trace_id = sc.trace_id GROUP BY sid""",
    "exemplar_spans": _with(LOGS, SPANS) + """
        SELECT l.event_type AS "MetricName", l.ts AS "TimeUnix", l.value, s.trace_id AS "TraceId", s.span_id AS "SpanId",
          s.span_name AS "SpanName", s.svc AS "SpanService"
        FROM logs l JOIN spans s ON l.event_id = s.event_id WHERE l.trace_id <> ''""",
    "span_tree": _with(SPANS, _TREE) + """
        SELECT s.trace_id AS "TraceId", s.span_id AS "SpanId", s.parent_id = '' AS is_root,
          coalesce(p.span_name, '') AS parent_name, coalesce(p.svc, '') AS parent_service,
          coalesce(c, 0) AS n_children, coalesce(d, 0) AS children_ns, greatest(s.dur - coalesce(d, 0), 0) AS self_ns
        FROM spans s LEFT JOIN spans p ON s.trace_id = p.trace_id AND s.parent_id = p.span_id
        LEFT JOIN kids ON s.trace_id = kids.trace_id AND s.span_id = kids.parent_id""",
    "span_roots": """
        SELECT lpad(lower(hex(event_id // 3000 * 3 + event_id % 3 + 1)), 32, '0') AS "TraceId", lpad(lower(hex(event_id + 1)), 16, '0') AS "SpanId",
          CASE WHEN event_id % 3 = 2 THEN '' ELSE lpad(lower(hex(event_id // 3000 * 3000 + event_id % 3 + 1)), 16, '0') END AS root,
          CASE WHEN event_id % 3 = 2 THEN -1 ELSE event_id % 3000 // 3 END AS depth,
          CASE event_id % 3 WHEN 0 THEN 'rooted' WHEN 1 THEN 'orphan' ELSE 'cycle' END AS state FROM events""",
    "span_self_time": _with(SPANS, _TREE) + """
        SELECT s.span_id AS "SpanId", s.dur AS "Duration", greatest(s.dur - coalesce(d, 0), 0) AS self_ns
        FROM spans s LEFT JOIN kids ON s.trace_id = kids.trace_id AND s.span_id = kids.parent_id""",
    "service_edges": S + """
        SELECT p.svc AS parent_service, s.svc AS child_service, count(*) AS n_calls, CAST(sum(s.dur) AS BIGINT) AS total_ns
        FROM spans s JOIN spans p ON s.trace_id = p.trace_id AND s.parent_id = p.span_id GROUP BY ALL""",
    "red_metrics": S + """
        , ranked AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, svc, span_name, dur, status,
          row_number() OVER (PARTITION BY date_trunc('day', ts), svc, span_name ORDER BY dur) - 1 AS r,
          count(*) OVER (PARTITION BY date_trunc('day', ts), svc, span_name) AS n FROM spans)
        SELECT bucket, svc AS "ServiceName", span_name AS "SpanName", n, count(*) FILTER (status = 'Error') AS errors, """
    + ", ".join(f"CAST(round({interpolated(q, 'dur')}) AS BIGINT) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99))
    + " FROM ranked GROUP BY bucket, svc, span_name, n",
    # profiles and series
    "log_volume": L + """
        SELECT date_trunc('hour', ts) AS bucket, sev AS "SeverityText", count(*) AS n FROM logs GROUP BY ALL""",
    "attr_profile": L + """
        SELECT 'k' AS key, count(*) AS n, count(DISTINCT k) AS n_values FROM logs
        UNION ALL SELECT 'log_type', count(*), count(DISTINCT event_type) FROM logs
        UNION ALL SELECT 'sessionId', count(*), count(DISTINCT session_id) FROM logs WHERE session_id <> ''""",
    "session_summary": _with(SESSIONS) + """
        SELECT sid AS "sessionId", min(ts) AS start, max(ts) AS "end", count(*) AS n,
          epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM sess GROUP BY sid""",
    "gauge_series": L + """
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, svc AS "ServiceName", event_type AS "MetricName", k,
          CAST(sum(cents) AS DOUBLE) / count(*) AS avg, CAST(min(cents) AS DOUBLE) AS min, CAST(max(cents) AS DOUBLE) AS max,
          CAST(arg_max(cents, ts) AS DOUBLE) AS last, count(*) AS n FROM logs GROUP BY ALL""",
    "counter_rate": L + """
        , steps AS (SELECT svc, event_type, user_id, date_trunc('hour', ts) AS bucket, cents,
          lag(cents) OVER (PARTITION BY svc, event_type, user_id ORDER BY ts) AS prev FROM logs)
        SELECT bucket, svc AS "ServiceName", event_type AS "MetricName", CAST(user_id AS VARCHAR) AS "user",
          CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN cents < prev THEN cents ELSE cents - prev END) AS DOUBLE) AS increase,
          count(*) AS n,
          CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN cents < prev THEN cents ELSE cents - prev END) AS DOUBLE) / 3600.0::DOUBLE AS rate
        FROM steps GROUP BY ALL""",
    "histogram_quantile": L + """
        , edges AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE), (1, 5.0, 10.0), (2, 10.0, 25.0), (3, 25.0, 50.0),
          (4, 50.0, 100.0), (5, 100.0, 250.0), (6, 250.0, NULL)) t(i, lo, hi)),
        c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, svc, event_type,
          CASE WHEN value <= 5 THEN 0 WHEN value <= 10 THEN 1 WHEN value <= 25 THEN 2 WHEN value <= 50 THEN 3
               WHEN value <= 100 THEN 4 WHEN value <= 250 THEN 5 ELSE 6 END AS i, count(*) AS c FROM logs GROUP BY ALL),
        r AS (SELECT *, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY bucket, svc, event_type) AS n
          FROM c WINDOW w AS (PARTITION BY bucket, svc, event_type ORDER BY i)),
        h AS (SELECT *, row_number() OVER (PARTITION BY bucket, svc, event_type ORDER BY i) AS rn
          FROM r WHERE upto >= 0.9::DOUBLE * n)
        SELECT bucket, svc AS "ServiceName", event_type AS "MetricName", CAST(n AS BIGINT) AS n,
          round(CASE WHEN hi IS NULL THEN 250.0::DOUBLE
            ELSE lo + (hi - lo) * ((0.9::DOUBLE * n - (upto - c)) / c) END, 6) AS p90
        FROM h JOIN edges USING (i) WHERE rn = 1""",
    "exp_histogram_quantile": _with(LOGS, EXP) + """
        , c AS (SELECT CAST(date_trunc('day', hr) AS TIMESTAMP) AS bucket, svc, event_type, coalesce(i, -1000) AS i, count(*) AS c
          FROM expo GROUP BY ALL),
        r AS (SELECT *, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY bucket, svc, event_type) AS n
          FROM c WINDOW w AS (PARTITION BY bucket, svc, event_type ORDER BY i)),
        h AS (SELECT *, row_number() OVER (PARTITION BY bucket, svc, event_type ORDER BY i) AS rn
          FROM r WHERE upto >= 0.5::DOUBLE * n)
        SELECT bucket, svc AS "ServiceName", event_type AS "MetricName", CAST(n AS BIGINT) AS n,
          round(CASE WHEN i = -1000 THEN 0.0::DOUBLE
            ELSE pow(2.0::DOUBLE, i + (0.5::DOUBLE * n - (upto - c)) / c) END, 6) AS p50
        FROM h WHERE rn = 1""",
    "histogram_quantile_mixed_bounds": L + """
        , layout AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE), (0, 5.0, 10.0), (0, 10.0, 25.0), (0, 25.0, 50.0), (0, 50.0, 100.0),
          (0, 100.0, 250.0), (0, 250.0, NULL), (1, 0.0, 10.0), (1, 10.0, 50.0), (1, 50.0, 100.0), (1, 100.0, 500.0), (1, 500.0, NULL)) t(odd, a, b)),
        fine AS (SELECT * FROM (VALUES (0.0::DOUBLE, 5.0::DOUBLE), (5.0, 10.0), (10.0, 25.0), (25.0, 50.0), (50.0, 100.0), (100.0, 250.0),
          (250.0, 500.0), (500.0, NULL)) t(lo, hi)),
        c AS (SELECT make_timestamp(epoch_us(ts) // 8640000000000 * 8640000000000) AS bucket, event_type, a, b, count(*) AS c
          FROM logs JOIN layout ON odd = user_id % 5 % 2 AND (value > a OR a = 0) AND (b IS NULL OR value <= b) GROUP BY ALL),
        shared AS (SELECT bucket, event_type, lo, hi, sum(CASE WHEN b IS NULL THEN c ELSE c * (hi - lo) / (b - a) END) AS c
          FROM c JOIN fine ON (b IS NULL AND hi IS NULL) OR (lo >= a AND hi <= b) GROUP BY ALL),
        r AS (SELECT *, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY bucket, event_type) AS n
          FROM shared WHERE c > 0 WINDOW w AS (PARTITION BY bucket, event_type ORDER BY lo)),
        h AS (SELECT *, row_number() OVER (PARTITION BY bucket, event_type ORDER BY lo) AS rn FROM r WHERE upto >= 0.9::DOUBLE * n)
        SELECT bucket, event_type AS "MetricName", round(n, 6) AS n,
          round(CASE WHEN hi IS NULL THEN lo ELSE lo + (hi - lo) * ((0.9::DOUBLE * n - (upto - c)) / c) END, 6) AS p90 FROM h WHERE rn = 1""",
    "counter_rate_restarts": L + """
        , runs AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 259200000000 * 259200000000 AS start FROM logs),
        steps AS (SELECT *, lag(cents) OVER w AS prev, lag(us) OVER w AS before, lag(start) OVER w AS was FROM runs
          WINDOW w AS (PARTITION BY svc, event_type, user_id ORDER BY ts)),
        taken AS (SELECT svc, event_type, user_id, us, CASE WHEN prev IS NULL THEN us WHEN start > was THEN greatest(before, start) ELSE before END AS began,
            CASE WHEN prev IS NULL THEN 0 WHEN start > was OR cents < prev THEN cents ELSE cents - prev END AS amount FROM steps),
        days AS (SELECT *, unnest(range(began // 86400000000, us // 86400000000 + 1)) * 86400000000 AS d FROM taken),
        parts AS (SELECT make_timestamp(d) AS bucket, svc, event_type, user_id, CASE WHEN d = us // 86400000000 * 86400000000 THEN 1 ELSE 0 END AS point,
            CASE WHEN us = began THEN amount ELSE amount * ((least(us, d + 86400000000) - greatest(began, d))::DOUBLE / (us - began)) END AS part FROM days)
        SELECT bucket, svc AS "ServiceName", event_type AS "MetricName", CAST(user_id AS VARCHAR) AS "user",
          round(CAST(sum(part) AS DOUBLE), 4) AS increase, CAST(sum(point) AS BIGINT) AS n FROM parts GROUP BY ALL""",
    "summary_quantile": _with(LOGS, SUMMARY) + """
        SELECT svc AS "ServiceName", hr AS "TimeUnix", n AS "Count", q90 AS quantile FROM summ""",
    "metrics_by_kind": _with(LOGS, HIST, SUMMARY) + """
        SELECT 'gauge' AS kind, svc AS "ServiceName", count(*) AS n, count(DISTINCT event_type) AS names FROM logs GROUP BY svc
        UNION ALL SELECT 'sum', svc, count(*), count(DISTINCT event_type) FROM logs GROUP BY svc
        UNION ALL SELECT 'histogram', svc, count(*), count(DISTINCT event_type) FROM hist GROUP BY svc
        UNION ALL SELECT 'exp_histogram', svc, count(*), count(DISTINCT event_type) FROM hist GROUP BY svc
        UNION ALL SELECT 'summary', svc, count(*), 1 FROM summ GROUP BY svc""",
    # tables on two tiers
    "lake_logs_round_trip": L + f"""
        SELECT ts AS "Timestamp", ns AS "Timestamp_ns", ts_s AS "TimestampTime", trace_id AS "TraceId", span_id AS "SpanId",
          sev AS "SeverityText", svc AS "ServiceName", body AS "Body", k, 'hot' AS tier, {DAY_OF} AS event_date FROM logs""",
    "rand_sharding": "SELECT CAST(3 AS BIGINT) AS shards, count(*) AS rows, TRUE AS even FROM events",
    "filter_logs_promoted": L + """
        SELECT span_id AS "SpanId", body AS "Body", k FROM logs WHERE event_type = 'purchase' AND pod = 'pod-3'""",
    "search_logs_indexed": L + """
        SELECT span_id AS "SpanId", body AS "Body" FROM logs WHERE lower(body) LIKE '%chase by user 1%'""",
    "lake_sessions_round_trip": _with(SESSIONS) + """
        SELECT ts AS "Timestamp", 'web' AS "ServiceName", text AS "Body", sid FROM sess""",
    "lake_traces_round_trip": S + f"""
        SELECT trace_id AS "TraceId", span_id AS "SpanId", ts AS "Timestamp", dur AS "Duration", {DAY_OF} AS event_date FROM spans""",
    "lake_trace_ranges": S + """
        SELECT trace_id AS "TraceId", min(ts) AS "Start", max(ts) AS "End" FROM spans GROUP BY trace_id""",
    "lake_metrics_round_trip": _STORED_METRICS,
    "lake_recent_count": """
        SELECT count(*) AS n FROM events
        WHERE ts >= TIMESTAMP '2024-01-20 06:30:00' AND ts < TIMESTAMP '2024-01-22 18:00:00'""",
    "hot_cold_scan": f"""
        SELECT {DAY_OF} AS event_date, CASE WHEN date_trunc('second', max(ts)) + INTERVAL 30 DAY <= {AS_OF}
          THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n FROM events GROUP BY {DAY_OF}""",
    "compact_day": f"""
        SELECT {DAY_OF} AS event_date, 2 * count(*) AS n, CAST(CASE WHEN {DAY_OF} = DATE '2024-01-10' THEN 1 ELSE 2 END AS BIGINT) AS segments,
          count(*) AS spans FROM events GROUP BY {DAY_OF}""",
    "ttl_move_plan": f"""
        SELECT 'otel_logs' AS "table", {DAY_OF} AS event_date, 'ttl' AS reason FROM events GROUP BY {DAY_OF}
        HAVING date_trunc('second', max(ts)) + INTERVAL 30 DAY <= {AS_OF}""",
    "size_move_plan": _with(INV) + """
        SELECT tab AS "table", d AS event_date, 'size' AS reason, comp AS bytes FROM inv
        WHERE tier = 'hot' AND comp > (SELECT avg(comp) FROM inv WHERE tier = 'hot')""",
    "space_move_plan": _with(INV) + """
        , h AS (SELECT *, sum(comp) OVER (ORDER BY d, tab) - comp AS gone, sum(comp) OVER () AS total FROM inv WHERE tier = 'hot')
        SELECT tab AS "table", d AS event_date, 'space' AS reason, comp AS bytes FROM h
        WHERE total - gone > 0.7::DOUBLE * total""",
    # reports
    "compression_report": _with(INV) + """
        SELECT tab AS "table", CAST(sum(n) AS BIGINT) AS rows, CAST(sum(comp) AS BIGINT) AS compressed_bytes,
          CAST(sum(uncomp) AS BIGINT) AS uncompressed_bytes,
          round_even(CAST(sum(uncomp) AS DOUBLE) / CAST(sum(comp) AS DOUBLE), 1) AS compress_ratio
        FROM inv GROUP BY tab ORDER BY tab""",
    "ingest_report": _with(INV) + """
        SELECT tab AS "table", CAST(sum(n) AS BIGINT) AS rows, min(oldest) AS oldest, max(newest) AS newest
        FROM inv GROUP BY tab ORDER BY tab""",
    "tier_report": _with(INV) + """
        SELECT *, """ + readable("bytes") + """ AS size FROM (
          SELECT tier, tab AS "table", count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(comp) AS BIGINT) AS bytes
          FROM inv GROUP BY tier, tab) ORDER BY tier, "table\"""",
    "file_report": _with(INV) + """
        SELECT tab AS "table", d AS event_date, tab || '/' || d AS path, tier, n AS rows, comp AS bytes
        FROM inv ORDER BY tab, tier, d""",
    "cold_count": _with(INV) + "SELECT count(*) AS n FROM inv WHERE tier = 'cold'",
    "balance_by_shard": """
        SELECT 'otel_logs' AS "table", 'shard-' || (event_id % 3) AS shard, count(*) AS rows,
          round(count(*) / avg(count(*)) OVER (), 9) AS skew FROM events GROUP BY event_id % 3""",
    "lake_ingest_report": "SELECT 'otel_logs' AS \"table\", count(*) AS rows, min(ts) AS oldest, max(ts) AS newest FROM events",
    # archive and streams
    "archive_round_trip": L + """
        SELECT ts AS timestamp, svc AS service_name, sev AS severity, body, trace_id, span_id FROM logs""",
    "archive_raw_lines": "SELECT count(*) AS records, CAST(0 AS BIGINT) AS odd FROM events",
    "stream_logs": L + """
        SELECT ts AS "Timestamp", svc AS "ServiceName", sev AS "SeverityText", body AS "Body", 'otel' AS log_type
        FROM logs WHERE session_id = ''""",
    "stream_archive_sink": L + """
        SELECT svc AS service_name, sev AS severity, count(*) AS n FROM logs WHERE session_id = '' GROUP BY ALL""",
    "stream_sessions": L + _SESSION_LIST,
    "stream_container": L + f"""
        SELECT ts AS timestamp, body, 'container' AS log_type, CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
          {_ORIGIN}, coalesce('node-' || (n_nationkey % 3), '') AS node
        FROM logs LEFT JOIN nation ON pod = 'pod-' || n_nationkey AND ns_name = 'ns-' || n_regionkey""",
    "archive_by_type": """
        SELECT CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS prefix,
          CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS log_type, count(*) AS n FROM events GROUP BY ALL""",
    "archive_value_kinds": """
        SELECT lpad(lower(hex(event_id + 1)), 16, '0') AS "SpanId",
          'intValue,boolValue,doubleValue,bytesValue,arrayValue,kvlistValue,stringValue,intValue' AS kinds, event_id AS body, event_id AS n,
          event_id % 2 = 0 AS ok, event_id % 8 / 8.0::DOUBLE AS x, event_type AS raw, event_id AS list_n, event_type AS list_s,
          'k' AS pair_key, TRUE AS pair_value, event_type AS s, 'otel' AS log_type FROM events""",
    "stream_journal": L + """
        SELECT ts AS "Timestamp", body AS "Body",
          CASE event_type WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS "SeverityText",
          'journal' AS log_type FROM logs""",
    "journal_since": """
        SELECT count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'""",
    "stream_traces": S + """
        SELECT trace_id AS "TraceId", count(*) AS n, CAST(sum(dur) AS BIGINT) AS ns, min(ts) AS "Start", max(ts) AS "End"
        FROM spans GROUP BY trace_id""",
    "stream_metrics": _STORED_METRICS,
    "stream_records": L + """
        SELECT 'logs' AS sink, svc AS service, count(*) AS n FROM logs WHERE session_id = '' GROUP BY svc
        UNION ALL SELECT 'archive', svc, count(*) FROM logs WHERE session_id = '' GROUP BY svc
        UNION ALL SELECT 'sessions', svc, count(*) FROM logs WHERE session_id <> '' GROUP BY svc""",
    "stream_two_checkpoints": L + """
        SELECT span_id AS "SpanId", CAST(2 AS BIGINT) AS n FROM logs WHERE session_id = ''""",
    "ingest_counters": L + """
        SELECT 'InsertQuery' AS event, CAST(1 AS BIGINT) AS value
        UNION ALL SELECT 'InsertedRows', count(*) FILTER (session_id = '') FROM logs
        UNION ALL SELECT 'InsertedBytes', CAST(coalesce(sum(strlen(body)) FILTER (session_id = ''), 0) AS BIGINT) FROM logs
        UNION ALL SELECT 'RejectedInserts', 0 UNION ALL SELECT 'DelayedInserts', 0""",
    "stream_backlog": """
        SELECT CAST(b AS BIGINT) AS batch, CAST(2 - b AS BIGINT) AS files, b < 2 AS has_bytes, (SELECT count(*) FROM events) AS rows,
          TRUE AS small_units FROM range(3) t(b)""",
    "rejected_lines": """
        SELECT pipeline, CASE WHEN event_id % 7 = 0 THEN '{"broken ' || event_id ELSE '{"x":' || event_id || '}' END AS line,
          CASE WHEN event_id % 7 = 0 THEN 'no JSON' ELSE 'no request: ' || field || ' is missing or no list' END AS reason,
          FALSE AS passed, CAST(0 AS BIGINT) AS batch, TRUE AS has_file, TRUE AS has_query
        FROM events, (VALUES ('logs/records', 'resourceLogs'), ('traces', 'resourceSpans'), ('metrics', 'resourceMetrics')) t(pipeline, field)
        WHERE event_id % 7 < 2
        UNION ALL SELECT 'logs/journal', '{"broken ' || event_id, 'no JSON object', FALSE, 0, TRUE, TRUE FROM events WHERE event_id % 7 = 0
        UNION ALL SELECT 'logs/container', 'odd line ' || event_id, 'unknown format', TRUE, 0, TRUE, TRUE FROM events WHERE event_id % 7 = 0""",
    "ingest_counters_by_pipeline": L + """
        , odd AS (SELECT count(*) FILTER (event_id % 7 = 0) AS broken, count(*) FILTER (event_id % 7 = 1) AS other,
            CAST(coalesce(sum(strlen('odd line ' || event_id)) FILTER (event_id % 7 = 0), 0) AS BIGINT) AS odd_bytes FROM events),
        sums AS (SELECT count(*) AS n, CAST(sum(strlen(body)) AS BIGINT) AS body_bytes, CAST(sum(strlen(event_type)) AS BIGINT) AS name_bytes FROM logs),
        t AS (SELECT 'logs/records' AS pipeline, n AS InsertedRows, body_bytes AS InsertedBytes, broken + other AS RejectedInserts FROM sums, odd
          UNION ALL SELECT 'traces', n, name_bytes, broken + other FROM sums, odd
          UNION ALL SELECT 'metrics', n, name_bytes, broken + other FROM sums, odd
          -- A journal line with other fields is an entry without a message.
          UNION ALL SELECT 'logs/journal', n + other, body_bytes, broken FROM sums, odd
          UNION ALL SELECT 'logs/container', n + broken, body_bytes + odd_bytes, broken FROM sums, odd)
        SELECT pipeline, 'InsertedRows' AS event, InsertedRows AS value FROM t UNION ALL SELECT pipeline, 'InsertedBytes', InsertedBytes FROM t
        UNION ALL SELECT pipeline, 'RejectedInserts', RejectedInserts FROM t UNION ALL SELECT pipeline, 'InsertQuery', 1 FROM t
        UNION ALL SELECT pipeline, 'DelayedInserts', 0 FROM t""",
    "lake_compression_report": """
        SELECT 'otel_logs' AS "table", count(*) AS rows, TRUE AS smaller, TRUE AS fewer_bytes FROM events""",
    "lake_balance_report": """
        SELECT 'otel_logs' AS "table", CAST(3 AS BIGINT) AS shards, count(*) AS rows, TRUE AS even FROM events""",
    "json_vs_columnar_order": "SELECT count(*) AS rows, TRUE AS plain_below_json, TRUE AS stored_below_plain FROM events",
    "stored_order": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS broken FROM events",
    "scalar_functions": """
        SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS none, epoch_us(ts) // 1000000 AS seconds,
          """ + readable("CAST(user_id AS BIGINT) * user_id * user_id") + """ AS size, TRUE AS is_now FROM events""",
    "otlp_span_events": S + """
        SELECT trace_id AS "TraceId", span_id AS "SpanId", 'exception' AS name, ts AS at, ns + 7 AS at_ns, k
        FROM spans WHERE status = 'Error'""",
    "otlp_exemplars": _with(LOGS) + """
        SELECT event_type AS "MetricName", ts AS at, ns + 7 AS at_ns, value,
          lpad(lower(hex(event_id // 8 + 1)), 32, '0') AS trace_id, span_id FROM logs WHERE event_id % 10 <> 0""",
    "service_edges_long_spans": S + """
        SELECT p.svc AS parent_service, s.svc AS child_service, count(*) AS n_calls,
          CAST(CAST(sum(s.dur * CAST(5000000000 AS HUGEINT)) AS DECIMAL(38, 0)) AS VARCHAR) AS total_ns
        FROM spans s JOIN spans p ON s.trace_id = p.trace_id AND s.parent_id = p.span_id GROUP BY ALL""",
    "exp_histogram_quantile_cumulative": _with(LOGS, EXP) + """
        , hours AS (SELECT DISTINCT svc, event_type, hr, -(CAST(extract('hour' FROM hr) AS INTEGER) % 2) AS s FROM expo),
        steps AS (SELECT *, lag(s) OVER (PARTITION BY svc, event_type ORDER BY hr) AS before,
          CAST(date_trunc('day', hr) AS TIMESTAMP) AS bucket FROM hours),
        scales AS (SELECT svc, event_type, bucket, min(least(s, before)) AS scale FROM steps WHERE before IS NOT NULL GROUP BY ALL),
        c AS (SELECT bucket, e.svc, e.event_type, scale,
          CASE WHEN e.i IS NULL THEN -1000 ELSE CAST(floor(e.i / pow(2.0::DOUBLE, -scale)) AS INTEGER) END AS i, count(*) AS c
          FROM expo e JOIN steps t ON e.svc = t.svc AND e.event_type = t.event_type AND e.hr = t.hr
          JOIN scales x USING (bucket) WHERE x.svc = e.svc AND x.event_type = e.event_type AND before IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY bucket, svc, event_type) AS n
          FROM c WINDOW w AS (PARTITION BY bucket, svc, event_type ORDER BY i)),
        h AS (SELECT *, row_number() OVER (PARTITION BY bucket, svc, event_type ORDER BY i) AS rn
          FROM r WHERE upto >= 0.5::DOUBLE * n)
        SELECT bucket, svc AS "ServiceName", event_type AS "MetricName", CAST(n AS BIGINT) AS n,
          round(CASE WHEN i = -1000 THEN 0.0::DOUBLE
            ELSE pow(2.0::DOUBLE, (i + (0.5::DOUBLE * n - (upto - c)) / c) * pow(2.0::DOUBLE, -scale)) END, 6) AS p50
        FROM h WHERE rn = 1""",
}
ORACLE["stream_container_rotated"] = ORACLE["container_tail"] = ORACLE["stream_container"]
ORACLE["lake_recent_hour"] = ORACLE["recent_log_count"]
ORACLE["traces_by_id"] = ORACLE["traces_with_errors"]
ORACLE["container_flatten_all"] = ORACLE["container_path_extract"]
ORACLE["tier_filter_scan"] = f"""
    WITH d AS ({ORACLE['hot_cold_scan']})
    SELECT t.tier, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (VALUES ('hot'), ('cold')) t(tier)
    LEFT JOIN d ON t.tier = d.tier GROUP BY t.tier"""
ORACLE["histogram_quantile_cumulative"] = (
    ORACLE["histogram_quantile"]
    .replace("edges AS (", "opened AS (SELECT svc, event_type, date_trunc('hour', min(ts)) AS h0 FROM logs GROUP BY ALL),\n        edges AS (", 1)
    .replace("FROM logs GROUP BY ALL),\n        r AS", "FROM logs JOIN opened USING (svc, event_type) WHERE date_trunc('hour', ts) > h0 GROUP BY ALL),\n        r AS", 1)
)
ORACLE["compact_due_days"] = f"""
    SELECT {DAY_OF} AS event_date, 2 * count(*) AS n, CAST(1 AS BIGINT) AS segments, count(*) AS spans FROM events GROUP BY {DAY_OF}"""
