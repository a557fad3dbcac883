from tlake.streaming import pipelines
from tlake.streaming.archive import as_read, otlp_requests, write_archive_by_type, write_otlp_archive
from tlake.streaming.sinks import Rejects, archive_sink, fan_out, rejected_lines, table_sink

__all__ = [
    "Rejects", "archive_sink", "as_read", "fan_out", "otlp_requests", "pipelines", "rejected_lines", "table_sink", "write_archive_by_type",
    "write_otlp_archive",
]
