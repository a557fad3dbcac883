from tlake.sources.files import (
    parse_prom_text,
    read_container_logs,
    read_journal_json,
    read_prom_text,
)
from tlake.sources.otlp import (
    parse_lines,
    read_otlp_logs,
    read_otlp_metrics,
    read_otlp_traces,
    read_raw_lines,
)
from tlake.sources.tail import tail_container_logs

__all__ = [
    "parse_lines", "parse_prom_text", "read_container_logs", "read_journal_json",
    "read_otlp_logs", "read_otlp_metrics", "read_otlp_traces", "read_prom_text", "read_raw_lines", "tail_container_logs",
]
