"""Market activity while orders were open, and what trading a larger share of it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_bins

MINUTE_MS = 60_000


def interval_sums(intervals: DataFrame, points: DataFrame, sums: dict[str, Column], key: str = "symbol", at: str = "ts_ms", bucket_ms: int = MINUTE_MS) -> DataFrame:
    """The rows of ``intervals`` (key, start, stop, both included, and others) with the sums over the key's points in them, 0 without any.

    Points are added up by buckets of time first. An interval takes the sums of the buckets that it covers whole and, one by one, the points
    of the buckets at its ends, so that neither many points nor long intervals make many pairs. Intervals with a null in key or bounds, or
    with stop before start, have sums of 0. Sums are found once for each key, start and stop, and met by these, so equal rows are kept;
    a row number would be another one where Spark computes the rows again.
    """
    taken, span = list(sums), ["_k", "_from", "_to"]
    spans = intervals.select(F.col(key).alias("_k"), F.col("start").alias("_from"), F.col("stop").alias("_to")).where("_from <= _to").distinct()
    bucket = lambda c: F.floor(c / bucket_ms)
    p = points.select(F.col(key).alias("_k"), F.col(at).alias("_at"), bucket(F.col(at)).alias("_b"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()])
    whole = p.groupBy("_k", "_b").agg(*[F.sum(n).alias(n) for n in taken])
    first, last = bucket(F.col("_from")), bucket(F.col("_to"))
    inner = spans.where(last - first > 1).select(*span, F.explode(F.sequence(first + 1, last - 1)).alias("_b")).join(whole, ["_k", "_b"])
    ends = spans.select(*span, F.explode(F.array_distinct(F.array(first, last))).alias("_b")).join(p, ["_k", "_b"]).where("_at between _from and _to")
    found = inner.select(*span, *taken).unionByName(ends.select(*span, *taken)).groupBy(*span).agg(*[F.sum(n).alias(n) for n in taken])
    met = (F.col(key) == F.col("_k")) & (F.col("start") == F.col("_from")) & (F.col("stop") == F.col("_to"))
    return intervals.join(found, met, "left").fillna(0, taken).drop(*span)


def slippage_curve(orders: DataFrame, bins: int = 5) -> DataFrame:
    """(symbol, participation_bin, n, participation, slippage_bps) of orders (symbol, side, decision, fill_px, filled, volume): the share of
    the market's volume that an order was, cut in quantile bins by symbol, and the mean cost against the price at the decision.

    Shares are binned by 12 digits: equal ones differ beyond that, as their sums are added up in another order. Orders without fills,
    market volume or a price are left out."""
    d = orders.where("filled > 0 and volume > 0 and decision > 0 and fill_px is not null").select("symbol", (F.col("filled") / F.col("volume")).alias("participation"), (F.col("side") * (F.col("fill_px") / F.col("decision") - 1) * 1e4).alias("slippage_bps"))
    d = exact_bins(d, ["symbol"], "participation", bins, "participation_bin", digits=12)
    return d.groupBy("symbol", "participation_bin").agg(F.count("*").alias("n"), F.avg("participation").alias("participation"), F.avg("slippage_bps").alias("slippage_bps"))
