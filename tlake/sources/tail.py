"""Log files that grow and are rotated, as a streaming source.

The position is a table of bytes per file, kept by Spark with the checkpoint of the query. A file is known by its folder,
its restart number and a digest of its first line, so a rename by rotation keeps its position, and a new file under the old
name starts at 0. A line belongs to the byte range that holds its line end: what is behind the last line end is read by the
batch in which the line is finished, and a range may begin anywhere.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

SCHEMA = "value STRING, file_path STRING, block_start BIGINT, line_no BIGINT"
ARROW = pa.schema([("value", pa.string()), ("file_path", pa.string()), ("block_start", pa.int64()), ("line_no", pa.int64())])
HEAD = 1024  # bytes that name a file, at most
RANGE = 64 << 20
BLOCK = 1 << 20
ROWS = 8192
PACKED = (".gz", ".zst", ".tmp")


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of one file."""

    root: str
    path: str
    name: str
    start: int
    end: int


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """File system, path on it, and what Spark puts in front of such paths."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), parts.path, "file:"
    system, inner = arrow_fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)]


def folder(pattern: str) -> str:
    """The longest leading part without wildcards."""
    steps = pattern.split("/")
    first = next((i for i, s in enumerate(steps[:-1]) if re.search(r"[*?\[]", s)), len(steps) - 1)
    return "/".join(steps[:first]) or "/"


def matcher(pattern: str) -> re.Pattern:
    """Wildcards inside path steps; rotated files have a time behind the name."""
    steps = [fnmatch.translate(s).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*") for s in pattern.split("/")]
    return re.compile("/".join(steps) + r"(\.[^/]+)?")


def head(system: arrow_fs.FileSystem, path: str) -> str | None:
    """Digest of the first line, or of its first bytes; None while it is not finished."""
    try:
        with system.open_input_file(path) as f:
            first = f.read_at(min(HEAD, f.size()), 0)
    except FileNotFoundError:
        return None
    line, end, _ = first.partition(b"\n")
    return hashlib.sha1(line).hexdigest() if end or len(first) == HEAD else None


def log_file(path: str) -> bool:
    """Neither hidden nor packed."""
    return path.rpartition("/")[2][:1] not in (".", "_") and not path.endswith(PACKED)


def stem(path: str) -> str:
    """The path up to ``.log``."""
    place, _, name = path.rpartition("/")
    return f"{place}/{name.partition('.log')[0]}.log"


def line_start(f: pa.NativeFile, at: int) -> int:
    """Start of the line that goes on at byte ``at``."""
    while at > 0:
        back = max(0, at - BLOCK)
        found = f.read_at(at - back, back).rfind(b"\n")
        if found >= 0:
            return back + found + 1
        at = back
    return 0


def lines(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of each line whose line end lies in [start, end)."""
    at = line_start(f, start)
    rest = [f.read_at(start - at, at)] if start > at else []
    for block in range(start, end, BLOCK):
        data = f.read_at(min(BLOCK, end - block), block)
        parts = data.split(b"\n")
        for part in parts[:-1]:
            line = b"".join((*rest, part))
            yield at, line
            at += len(line) + 1
            rest = []
        rest.append(parts[-1])


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str) -> None:
        self.pattern, self.seen = pattern, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All files there are, by name, with their sizes. Only files that changed since the last look are opened, to see
        whether they are still the same ones."""
        system, pattern, _ = open_fs(self.pattern)
        fits = matcher(pattern)
        selector = arrow_fs.FileSelector(folder(pattern), recursive=True, allow_not_found=True)
        found = [i for i in system.get_file_info(selector) if i.type == arrow_fs.FileType.File and fits.fullmatch(i.path)]
        found = [i for i in found if i.size and log_file(i.path)]
        looked = {i.path: (i.size, i.mtime_ns) for i in found}
        changed = [p for p, state in looked.items() if self.seen.get(p, (None, None))[0] != state]
        heads = {p: head(system, p) for p in changed}
        self.seen = {p: (state, heads[p] if p in heads else self.seen[p][1]) for p, state in looked.items()}
        out: dict = {}
        for path, ((size, _), first) in sorted(self.seen.items()):
            if first is None:
                continue
            name = f"{stem(path)}#{first}"
            if size > out.get(name, {"size": 0})["size"]:
                out[name] = {"path": path, "size": size}
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for name, file in sorted(end.items()):
            begin = start.get(name, {"size": 0})["size"]
            for at in range(begin, file["size"], RANGE):
                ranges.append(Range(self.pattern, file["path"], name, at, min(at + RANGE, file["size"])))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _, prefix = open_fs(partition.root)
        path = self.located(system, partition)
        if path is None:
            return  # deleted since it was listed
        rows: list[tuple] = []
        size = 0
        with system.open_input_file(path) as f:
            for at, line in lines(f, partition.start, partition.end):
                rows.append((line.removesuffix(b"\r").decode("utf-8", "replace"), prefix + path, partition.start, at))
                size += len(line)
                if len(rows) == ROWS or size > 8 * BLOCK:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    @staticmethod
    def located(system: arrow_fs.FileSystem, wanted: Range) -> str | None:
        """Where the file is now; a rotation may have renamed it."""
        first = wanted.name.rpartition("#")[2]
        if head(system, wanted.path) == first:
            return wanted.path
        beside = system.get_file_info(arrow_fs.FileSelector(wanted.path.rpartition("/")[0], allow_not_found=True))
        same = [i for i in beside if i.size and log_file(i.path) and stem(i.path) == stem(wanted.path)]
        return next((i.path for i in same if i.size >= wanted.end and head(system, i.path) == first), None)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def tail_container_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Stream of the lines of growing container log files from the beginning, each once.

    ``glob`` finds the live files, such as ``/var/log/pods/*/*/*.log``; files that a rotation has put beside them (a time
    behind the name, not packed) are found as well. Columns as of ``read_container_logs``. The table of positions holds the
    files there are, some 150 bytes for each; a query is to follow the files of one node or of a group of nodes.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", glob).load()
