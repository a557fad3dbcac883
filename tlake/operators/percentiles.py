"""Exact percentiles of whole numbers without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A 63-bit number is narrowed 21 bits at a time: no window below sees more than
# 2^21 pre-aggregated rows, however many rows a group has.
SHIFTS = (42, 21, 0)


def exact_percentiles(
    df: DataFrame, keys: list[str], column: str, qs: dict[str, float], flags: dict[str, Column] | None = None
) -> DataFrame:
    """Linear-interpolated percentiles of a BIGINT column per group, NULLs left out.

    ``qs`` maps output names to fractions; ``flags`` maps output names to
    conditions that are counted. ``n`` is the count and ``total`` the sum, a DECIMAL(38,0).

    Rows are first counted per (group, value). Then, for each wanted rank, the
    bucket of leading bits that holds it is found from bucket totals, and only
    that bucket is opened on the next level. The counts are the same plan on
    every level (key struct and value are never NULL and the flags are grouping
    columns, so no filter or pruning sets the levels apart): they are computed
    and shuffled once and the exchange is reused.
    """
    flags = flags or {}
    value = F.col(column)
    counts = (
        df.filter(value.isNotNull())
        .select(
            F.struct(*keys).alias("_k"), F.coalesce(value, F.lit(0)).cast("bigint").alias("_v"),
            *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()],
        )
        .groupBy("_k", "_v", *flags)
        .agg(F.count("*").alias("_c"))
    )
    names = list(qs)
    extra = ["total", *flags]
    # Zero-based ranks below and above the interpolation point.
    pos = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs.values()]
    ranks = F.array(
        *[
            F.struct(F.lit(2 * i + side).alias("q"), f(p).cast("bigint").alias("r"))
            for i, p in enumerate(pos)
            for side, f in enumerate((F.floor, F.ceil))
        ]
    )
    level = None
    for depth, shift in enumerate(SHIFTS):
        bucket = F.shiftright("_v", shift) if shift else F.col("_v")
        grouped = counts.groupBy("_k", bucket.alias("_b"))
        if depth == 0:
            whole = Window.partitionBy("_k")
            rows = grouped.agg(
                F.sum("_c").alias("_c"),
                F.sum((F.col("_v").cast("decimal(19,0)") * F.col("_c")).cast("decimal(38,0)")).alias("total"),
                *[F.sum(F.when(F.col(n), F.col("_c")).otherwise(0)).alias(n) for n in flags],
            ).withColumns({"_n": F.sum("_c").over(whole), **{n: F.sum(n).over(whole) for n in extra}})
            rows = rows.withColumn("_want", ranks)
            within = whole.orderBy("_b")
        else:
            totals = grouped.agg(F.sum("_c").alias("_c")).withColumn(
                "_up", F.shiftright("_b", SHIFTS[depth - 1] - shift)
            )
            rows = totals.join(level, ["_k", "_up"])
            within = Window.partitionBy("_k", "_up").orderBy("_b")
        upto = F.sum("_c").over(within.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_end", upto).withColumn("_before", F.col("_end") - F.col("_c"))
        hit = F.filter("_want", lambda w: (w["r"] >= F.col("_before")) & (w["r"] < F.col("_end")))
        rest = F.transform(hit, lambda w: F.struct(w["q"].alias("q"), (w["r"] - F.col("_before")).alias("r")))
        holds = F.exists("_want", lambda w: (w["r"] >= F.col("_before")) & (w["r"] < F.col("_end")))
        level = rows.filter(holds).select("_k", "_n", *extra, rest.alias("_want"), F.col("_b").alias("_up"))
    # One row per found value: put the neighbours of each fraction side by side.
    found = level.select("_k", "_n", *extra, F.col("_up").alias("_v"), F.explode("_want").alias("_w"))
    pick = lambda i: F.max(F.when(F.col("_w.q") == i, F.col("_v"))).cast("double")
    sides = found.groupBy("_k", "_n", *extra).agg(
        *[pick(2 * i + s).alias(f"_{i}_{s}") for i in range(len(names)) for s in (0, 1)]
    )
    out = []
    for i, name in enumerate(names):
        lo, hi = F.col(f"_{i}_0"), F.col(f"_{i}_1")
        out.append((lo + (hi - lo) * (pos[i] - F.floor(pos[i]))).alias(name))
    return sides.select("_k.*", F.col("_n").alias("n"), *extra, *out)
