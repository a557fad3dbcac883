"""One row per stored file, from a distributed listing and Parquet footers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tlake import schemas
from tlake.functions import from_unix_nanos
from tlake.plans.lake import TIERS, Lake

_FOOTER = (
    "path STRING, file_bytes BIGINT, rows BIGINT, compressed_bytes BIGINT, uncompressed_bytes BIGINT, "
    "min_ns BIGINT, max_ns BIGINT"
)


def _footers(column: str, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Row count, column bytes and time bounds from footers; no data pages are read.

    The function holds all it needs, so executors do not have to import this package.
    """

    def open_file(path: str):
        from urllib.parse import unquote, urlparse

        from pyarrow import fs

        u = urlparse(path)
        if u.scheme in ("", "file"):
            return fs.LocalFileSystem().open_input_file(unquote(u.path))
        # Hadoop schemes whose name differs in Arrow.
        scheme = {"s3a": "s3", "s3n": "s3"}.get(u.scheme, u.scheme)
        remote, name = fs.FileSystem.from_uri(f"{scheme}://{u.netloc}{unquote(u.path)}")
        return remote.open_input_file(name)

    def footer(path: str, size: int) -> tuple:
        import pyarrow.parquet as pq

        with open_file(path) as f:
            md = pq.ParquetFile(f).metadata
        groups = [md.row_group(g) for g in range(md.num_row_groups)]
        chunks = [g.column(c) for g in groups for c in range(g.num_columns)]
        stats = [c.statistics for c in chunks if c.path_in_schema == column]
        bounds = [(s.min, s.max) for s in stats if s is not None and s.has_min_max]
        return (
            path, size, md.num_rows, sum(c.total_compressed_size for c in chunks),
            sum(c.total_uncompressed_size for c in chunks),
            min((b[0] for b in bounds), default=None), max((b[1] for b in bounds), default=None),
        )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [footer(p, n) for p, n in zip(pdf["path"], pdf["length"])]
            yield pd.DataFrame(rows, columns=names).astype({"min_ns": "Int64", "max_ns": "Int64"})

    return read


def inventory(lake: Lake, table: str) -> DataFrame:
    """Files of a table that count, in both tiers. Footers are read on the executors."""
    m = lake.manifest(table)
    column = f"{schemas.time_column(table)}_ns"
    out = None
    for tier in TIERS:
        done = lake.finished(table, tier)
        # Only names and sizes are read: the content column is pruned.
        listed = (
            lake.spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", "true")
            .load(lake.path(table, tier))
            .select("path", "length")
        )
        units = {k: [f"{s}/{d}" for t, d, s in m[k] if t == tier] for k in ("live", "retired")}
        unit = F.concat_ws(
            "/", F.regexp_extract("path", r"/seg=([^/]+)/", 1), F.regexp_extract("path", r"/event_date=([^/]+)/", 1)
        )
        counts = unit.startswith("a-")
        if open_ := lake.unfinished(table, tier, done):
            counts = counts & ~F.regexp_extract("path", r"/seg=([^/]+)/", 1).isin(open_)
        if units["retired"]:
            counts = counts & ~unit.isin(units["retired"])
        if units["live"]:
            counts = counts | unit.isin(units["live"])
        read = listed.filter(counts).mapInPandas(_footers(column, [c.split()[0] for c in _FOOTER.split(", ")]), _FOOTER)
        arm = read.select(
            F.lit(table).alias("table"), F.lit(tier).alias("tier"),
            F.regexp_extract("path", r"/event_date=([^/]+)/", 1).cast("date").alias("event_date"),
            F.regexp_extract("path", r"/seg=([^/]+)/", 1).alias("seg"),
            "path", "rows", "compressed_bytes", "uncompressed_bytes", "file_bytes",
            from_unix_nanos("min_ns").alias("min_time"), from_unix_nanos("max_ns").alias("max_time"),
        )
        out = arm if out is None else out.unionByName(arm)
    return out


def inventories(lake: Lake, tables: list[str] | None = None) -> DataFrame:
    out = None
    for t in tables or list(schemas.TABLES):
        inv = inventory(lake, t)
        out = inv if out is None else out.unionByName(inv)
    return out
