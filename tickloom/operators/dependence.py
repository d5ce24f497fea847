"""Distance correlation of two columns, exact, without pairs of rows.

The sum over pairs of |dx| * |dy| is 2 D - T: T is the sum of dx * dy over all pairs, which moments give, and D the same over those pairs
whose order by x is that by y. Rows are dealt into ranges by x and, again, into ranges by y. A pair is in one range of x, or in one range of
y, or neither: the first two kinds are counted in the tasks of the ranges (by bitwise merging, n log n), the last one by running sums over
the table of (x range, y range) cells. The row sums of distances come from running sums in the ranges' order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.shared import written

#: Rows of a range, about.
SIZE = 200_000


def concordant(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of (x_j - x_i) * (y_j - y_i) over the pairs with x_i <= x_j and y_i <= y_j (each once), in n log n steps.

    Rows stand in the order of y; a bit of their rank by x after the other, from the highest, parts blocks of ranks into a lower and
    an upper half: what an upper row has of its block's lower rows before it in the order of y are running sums.
    """
    n = len(x)
    if n < 2:
        return 0.0
    order = np.lexsort((y, x))
    x, y = x[order] - x.mean(), y[order] - y.mean()
    rank = np.argsort(y, kind="stable")
    total, width = 0.0, 1 << (n - 1).bit_length() - 1
    while width:
        lower = (rank & width) == 0
        start = (rank // (2 * width)) * (2 * width)
        a, b = x[rank], y[rank]
        sums = [np.r_[0.0, np.cumsum(np.where(lower, v, 0.0))] for v in (np.ones(n), a, b, a * b)]
        at = np.flatnonzero(~lower)
        k, sx, sy, sxy = (s[at] - s[start[at]] for s in sums)
        total += float((a[at] * b[at] * k - a[at] * sy - b[at] * sx + sxy).sum())
        place = np.where(lower, start + (sums[0][:-1] - sums[0][start]), start + width + (np.arange(n) - start) - (sums[0][:-1] - sums[0][start])).astype(np.int64)
        moved = np.empty_like(rank)
        moved[place] = rank
        rank, width = moved, width >> 1
    return total


def _dealt(rows: DataFrame, keys: list[str], by: list[str], parts: int, name: str) -> DataFrame:
    return written(rows.repartitionByRange(parts, *keys, *by).withColumn(name, F.spark_partition_id()), "ranges")


def _row_sums(rows: DataFrame, keys: list[str], x: str, part: str, out: str) -> DataFrame:
    """The rows with ``out``, the sum of |x - x'| over all rows of the group; ``part`` are ranges in the order of x."""
    w = Window.partitionBy(*keys)
    per = rows.groupBy(*keys, part).agg(F.count("*").alias("_n"), F.sum(x).alias("_s"))
    before = w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s")], *[F.sum(c).over(w).alias(f"{c}1") for c in ("_n", "_s")])
    run = Window.partitionBy(*keys, part).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumns({"_k": F.count("*").over(run), "_c": F.sum(x).over(run)}).join(carry, [*keys, part])
    k, c = F.col("_k") + F.col("_n0"), F.col("_c") + F.col("_s0")
    return d.withColumn(out, F.col(x) * k - c + (F.col("_s1") - c) - F.col(x) * (F.col("_n1") - k)).drop("_k", "_c", "_n0", "_s0", "_n1", "_s1")


def _inside(rows: DataFrame, keys: list[str], part: str, less: str | None = None) -> DataFrame:
    """keys, d: ``concordant`` of each range; less that of the parts of the range that ``less`` names."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        d = concordant(f["_x"].to_numpy(), f["_y"].to_numpy())
        if less:
            d -= sum(concordant(g["_x"].to_numpy(), g["_y"].to_numpy()) for _, g in f.groupby(less))
        return f[keys].head(1).assign(d=d)

    need = [*keys, part, "_x", "_y", *([less] if less else [])]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.select(*need).groupBy(*keys, part).applyInPandas(run, f"{kinds}, d double")


def _across(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d: the pairs of lower ranges by both x and y, of the table of cells."""
    sums = ["n", "x", "y", "xy"]
    cells = rows.groupBy(*keys, "_cx", "_cy").agg(F.count("*").cast("double").alias("n"), F.sum("_x").alias("x"), F.sum("_y").alias("y"), F.sum(F.col("_x") * F.col("_y")).alias("xy"))
    cells = written(cells, "cells")
    grid = cells.select(*keys, "_cx").distinct().join(cells.select(*keys, "_cy").distinct(), keys)
    full = grid.join(cells, [*keys, "_cx", "_cy"], "left").fillna(0.0, sums)
    left = Window.partitionBy(*keys, "_cy").orderBy("_cx").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys, "_cx").orderBy("_cy").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({f"l{c}": F.sum(c).over(left) for c in sums}).withColumns({f"b{c}": F.sum(f"l{c}").over(down) for c in sums})
    return full.select(*keys, F.coalesce(F.col("bn") * F.col("xy") - F.col("bx") * F.col("y") - F.col("by") * F.col("x") + F.col("n") * F.col("bxy"), F.lit(0.0)).alias("d"))


def distance_correlation(df: DataFrame, x: str, y: str, keys: list[str], size: int = SIZE) -> DataFrame:
    """The keys (not null), n and distance_correlation of x and y: 0 if one of them is constant, null for fewer than two rows.

    Rows in which one is null or NaN are left out. No task holds more than about ``size`` rows of a group.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    rows = df.where(ok).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    middle = rows.groupBy(*keys).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    rows = rows.join(middle, keys).select(*keys, (F.col("_x") - F.col("_mx")).alias("_x"), (F.col("_y") - F.col("_my")).alias("_y"))
    parts = max(1, -(-rows.count() // size))
    by_x = _row_sums(_dealt(rows, keys, ["_x", "_y"], parts, "_cx"), keys, "_x", "_cx", "_a")
    by_y = _dealt(by_x, keys, ["_y", "_x"], parts, "_cy")
    both = written(_row_sums(by_y, keys, "_y", "_cy", "_b"), "sums")
    pairs = _inside(both, keys, "_cx").unionByName(_inside(both, keys, "_cy", "_cx")).unionByName(_across(both, keys)).groupBy(*keys).agg(F.sum("d").alias("_d"))
    s = lambda c: F.sum(c)
    X, Y, A, B = (F.col(c) for c in ("_x", "_y", "_a", "_b"))  # noqa: N806
    m = both.groupBy(*keys).agg(F.count("*").alias("n"), s(X).alias("x"), s(Y).alias("y"), s(X * X).alias("xx"), s(Y * Y).alias("yy"), s(X * Y).alias("xy"), s(A).alias("a"), s(B).alias("b"), s(A * A).alias("aa"), s(B * B).alias("bb"), s(A * B).alias("ab"))
    n = F.col("n").cast("double")
    product = 2 * (2 * F.col("_d") - (n * F.col("xy") - F.col("x") * F.col("y")))  # over ordered pairs

    def dcov(prod, one, two, cross):
        return prod / (n * n) + one / (n * n) * two / (n * n) - 2 * cross / (n * n * n)

    vx = dcov(2 * (n * F.col("xx") - F.col("x") * F.col("x")), F.col("a"), F.col("a"), F.col("aa"))
    vy = dcov(2 * (n * F.col("yy") - F.col("y") * F.col("y")), F.col("b"), F.col("b"), F.col("bb"))
    both_ways = F.greatest(dcov(product, F.col("a"), F.col("b"), F.col("ab")), F.lit(0.0))
    scale = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return m.join(pairs, keys).select(*keys, "n", F.when(F.col("n") >= 2, F.when(scale > 1e-300, F.sqrt(both_ways / scale)).otherwise(0.0)).alias("distance_correlation"))
