"""Scalar expressions. All of them stay inside the JVM. Times are UTC, see
``session.RUNTIME_CONF``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(_c(us)).cast("timestamp_ntz")


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_unix_nanos(ns: Column | str) -> Column:
    """Nanoseconds since the epoch as a microsecond timestamp (truncating)."""
    return from_micros(_floor_div(_c(ns), 1000))


def _floor_div(n: Column, d: int) -> Column:
    """Whole-number division rounding down, without a detour over DOUBLE."""
    step = F.lit(d).cast("bigint")
    return F.call_function("div", n, step) - F.when(n % step < 0, 1).otherwise(0)


def unix_nanos(ts: Column | str) -> Column:
    return epoch_micros(ts) * F.lit(1000).cast("bigint")


def unix_seconds(ts: Column | str) -> Column:
    return _floor_div(epoch_micros(ts), 1_000_000)


def trunc_second(ts: Column | str) -> Column:
    return time_bucket(ts, "1 second")


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def bucket_micros(width: str) -> int:
    """``'5 minutes'`` → 300000000."""
    n, unit = width.split()
    return int(n) * _UNITS[unit.rstrip("s")] * 1_000_000


def time_bucket(ts: Column | str, width: str) -> Column:
    """Start of the fixed-width bucket, aligned to the epoch, that holds ``ts``."""
    us = epoch_micros(ts)
    return from_micros(us - F.pmod(us, F.lit(bucket_micros(width)).cast("bigint")))


def literal_time(t: datetime | str | Column) -> Column:
    """A zone-less timestamp from a literal; columns (scalar subqueries too) pass through."""
    if isinstance(t, Column):
        return t
    return F.lit(str(t)).cast("timestamp_ntz")


def as_bigint(x: Column | str) -> Column:
    """Cast that gives NULL for text that is no number."""
    return _c(x).try_cast("bigint")


def text(x: Column | str) -> Column:
    """NULL becomes the stored form of "absent"."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def array_first(arr: Column | str, cond) -> Column:
    """First element that meets the condition, NULL when there is none."""
    return F.get(F.filter(_c(arr), cond), 0)


def _json_path(*steps: str | int) -> str:
    return "$" + "".join(f"[{s - 1}]" if isinstance(s, int) else f".{s}" for s in steps)


def json_string(doc: Column | str, *steps: str | int) -> Column:
    """Text at a path; integer steps count array elements from 1; missing → ''."""
    return F.coalesce(F.get_json_object(_c(doc), _json_path(*steps)), F.lit(""))


def json_value(doc: Column | str, schema: str, *steps: str | int) -> Column:
    """Typed value at a path (JSONExtract with a type)."""
    return F.from_json(F.get_json_object(_c(doc), _json_path(*steps)), schema)


def readable_size(n: Column | str) -> Column:
    """Byte count as text with a binary unit, two decimals."""
    x = _c(n).cast("double")
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    out = F.format_string("%.2f PiB", x / F.lit(1024.0**5))
    for i in range(4, -1, -1):
        scaled = F.format_string(f"%.2f {units[i]}", x / F.lit(1024.0**i))
        out = F.when(x < F.lit(1024.0 ** (i + 1)), scaled).otherwise(out)
    return out


def like_literal(x: Column | str, prefix: str = "", suffix: str = "") -> Column:
    """LIKE with literal underscores and percent signs around one free part."""
    esc = lambda s: s.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%")
    return _c(x).like(f"{esc(prefix)}%{esc(suffix)}")


def computed_once(df: DataFrame, expr: Column, name: str) -> DataFrame:
    """Add a costly column so that filters on it do not compute it a second time.

    A filter is moved below a plain projection together with a copy of the
    expression; it is not moved below a generator.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))
