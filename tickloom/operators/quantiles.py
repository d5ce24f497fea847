"""Exact quantiles of groups of any size, by selection.

A quantile sketch of each group brackets every wanted rank between two values; one pass counts what lies below a bracket and
gathers the different values inside it with their counts; those alone are sorted, over tasks, to find the value at the rank.
So a group that has all rows is a few numbers in the first pass and a hundredth of its rows in the sort, which no single task does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.shared import written

#: Half the width of a bracket as a share of the rows, the sketch's accuracy (ranks are off by 1 / ACCURACY at most), and the
#: rows of a group below which its bracket is open: there a rank could lie outside by rounding.
WIDTH, ACCURACY, SMALL = 0.005, 10_000, 2_000


def _sketch(rows: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """keys, n, low, high: for each of ``ps`` values at or below and at or above it; null where the bracket is open."""
    at = sorted({min(max(p + d, 0.0), 1.0) for p in ps for d in (-WIDTH, WIDTH)})
    place = lambda p: at.index(min(max(p, 0.0), 1.0))
    value = lambda p, open_: F.when((F.col("n") >= SMALL) & F.lit(not open_), F.get("_at", F.lit(place(p))))
    d = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_x", at, ACCURACY).alias("_at"))
    low = F.array(*[value(p - WIDTH, p - WIDTH <= 0) for p in ps])
    high = F.array(*[value(p + WIDTH, p + WIDTH >= 1) for p in ps])
    return d.select(*keys, "n", low.alias("_low"), high.alias("_high"))


def _at_ranks(counts: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """keys, _t, lower, upper: the values at the two ranks (from 0) of ``ranks`` (keys, _t, first, second), from ``counts`` (keys, _t, _x,
    c: different values with their counts; null: what lies below). The sort is by ranges over all groups."""
    by = [*keys, "_t"]
    dealt = written(counts.repartitionByRange(*by, F.asc_nulls_first("_x")).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = dealt.groupBy(*by, "_part").agg(F.sum("c").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "_part").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0)
    d = dealt.withColumn("_to", F.sum("c").over(inside)).join(carry.drop("_in"), [*by, "_part"]).withColumn("_to", F.col("_to") + F.col("_before"))
    d = d.join(ranks, by).where("_x is not null")
    holds = lambda k: F.max(F.when((F.col(k) < F.col("_to")) & (F.col(k) >= F.col("_to") - F.col("c")), F.col("_x")))
    return d.groupBy(*by).agg(holds("first").alias("lower"), holds("second").alias("upper"))


def exact_quantiles(df: DataFrame, keys: list[str], x: Column | str, **ps: float) -> DataFrame:
    """The keys, n (values that are not null) and for each name the quantile p, linear between order statistics, as ``percentile`` gives it.

    NaN counts as greater than all numbers. Groups without values give no row; null keys are groups of their own.
    """
    names, want = list(ps), list(ps.values())
    if not all(0 <= p <= 1 for p in want):
        raise ValueError("quantiles lie between 0 and 1")
    own = [f"_k{i}" for i in range(len(keys))]  # null keys do not join: a marker stands for them
    rows = df.select(*[F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key")).alias(o) for k, o in zip(keys, own)], (F.col(x) if isinstance(x, str) else x).cast("double").alias("_x")).where("_x is not null")
    flat = [F.to_json(o).alias(o) for o in own]
    names_of = rows.select(*flat, *[F.col(f"{o}.key").alias(k) for k, o in zip(keys, own)]).distinct()
    rows = rows.select(*flat, "_x")
    bounds = written(_sketch(rows, own, want), "brackets")
    met = rows.join(bounds.drop("n"), own) if own else rows.crossJoin(F.broadcast(bounds.drop("n")))
    targets = []
    for t in range(len(want)):
        low, high = F.get("_low", F.lit(t)), F.get("_high", F.lit(t))
        below, above = F.coalesce(F.col("_x") < low, F.lit(False)), F.coalesce(F.col("_x") > high, F.lit(False))
        targets.append(F.when(~above, F.struct(F.lit(t).alias("t"), F.when(~below, F.col("_x")).alias("x"))))
    each = met.select(*own, F.explode(F.array_compact(F.array(*targets))).alias("_e")).select(*own, F.col("_e.t").alias("_t"), F.col("_e.x").alias("_x"))
    counts = each.groupBy(*own, "_t", "_x").agg(F.count("*").alias("c"))
    at = F.array(*[F.struct(F.lit(t).alias("_t"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for t, p in enumerate(want)])
    ranks = bounds.select(*own, "n", F.explode(at).alias("_e")).select(*own, "n", "_e._t", "_e.at").withColumns({"first": F.floor("at"), "second": F.ceil("at")})
    found = _at_ranks(counts, own, ranks.drop("n", "at")).join(ranks, [*own, "_t"])
    value = F.when(F.col("first") == F.col("second"), F.col("lower")).otherwise((F.col("second") - F.col("at")) * F.col("lower") + (F.col("at") - F.col("first")) * F.col("upper"))
    wide = found.groupBy(*own).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_t") == t, value)).alias(name) for t, name in enumerate(names)])
    return (wide.join(names_of, own) if own else wide).select(*keys, "n", *names)


def exact_bins(df: DataFrame, keys: list[str], x: str, bins: int, out: str, digits: int | None = None) -> DataFrame:
    """The rows with ``out``, 0 to bins - 1: how many of the group's quantiles 1/bins, 2/bins, ... lie below the row's ``x``; null for null.

    With ``digits``, both are compared as rounded: values that are equal but for their rounding errors stay together."""
    if bins < 2:
        raise ValueError("two bins at least")
    inner = {f"_q{k}": k / bins for k in range(1, bins)}
    cuts = exact_quantiles(df, keys, x, **inner).drop("n")
    met = df.join(cuts, keys, "left") if keys else df.crossJoin(F.broadcast(cuts))
    near = lambda c: F.col(c) if digits is None else F.round(c, digits)
    return met.withColumn(out, sum((near(x) > near(q)).cast("int") for q in inner)).drop(*inner)


def median_deviation(df: DataFrame, keys: list[str], x: str, out: str = "mad") -> DataFrame:
    """The keys and the median distance from the group's median."""
    middle = exact_quantiles(df, keys, x, _middle=0.5).drop("n")
    d = df.join(middle, keys) if keys else df.crossJoin(F.broadcast(middle))
    return exact_quantiles(d, keys, F.abs(F.col(x) - F.col("_middle")), **{out: 0.5}).drop("n")

