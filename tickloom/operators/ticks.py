"""Tick features, rolling windows, as-of joins and the kernels K1 to K5 of a trade tape, by symbol across days.

A row's place ``i`` in its symbol (from 1, in the order of day and trade id) comes from day counts, and windows run over
chunks of SIZE rows with as many rows before and after them as they look at: no task holds a symbol's history.
Window sums are differences of prefix sums, whatever the window's length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.shared import written

#: Rows of a chunk, but no fewer than four times the rows around it.
SIZE = 100_000
BUCKET_MS = 3_600_000


def indexed(trades: DataFrame) -> DataFrame:
    """The rows with ``i``, their place in their symbol."""
    days = trades.groupBy("symbol", "trade_date").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("symbol", "trade_date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("symbol", "trade_date").orderBy("trade_id"))
    return trades.withColumn("i", place.cast("long")).join(days, ["symbol", "trade_date"]).withColumn("i", F.col("i") + F.col("_before")).drop("_before")


def chunks(rows: DataFrame, back: int, ahead: int = 0, size: int = SIZE) -> DataFrame:
    """Rows with a chunk number; a chunk also gets (own = false) the ``back`` rows before it and the ``ahead`` rows after it."""
    size = max(size, 4 * (back + ahead))
    at = F.col("i") - 1
    near = F.sequence(F.greatest(F.floor((at - ahead) / size), F.lit(0)), F.floor((at + back) / size))
    return rows.withColumn("chunk", F.explode(near)).withColumn("own", F.col("chunk") == F.floor(at / size))


def in_chunks(rows: DataFrame, step: Callable[[DataFrame, WindowSpec], DataFrame], back: int, ahead: int = 0, size: int = SIZE) -> DataFrame:
    """``step`` adds columns by a window over the chunk's rows; what it looks at lies within ``back`` and ``ahead`` rows."""
    return step(chunks(rows, back, ahead, size), Window.partitionBy("symbol", "chunk").orderBy("i")).where("own").drop("chunk", "own")


def _z(x: Column, n: Column, s: Column, ss: Column, eps: float) -> Column:
    return (x - s / n) / (F.sqrt(F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0))) + eps)


def add_rolling(df: DataFrame, w: WindowSpec, column: str, width: int, mean: str | None = None, total: str | None = None, z: str | None = None, online: bool = False, eps: float = 1e-8) -> DataFrame:
    """Adds the trailing mean, sum or z-score of ``column``: of full windows with the sample deviation (else null), or ``online``:
    of what there is, with the population deviation, 0 for fewer than two rows or no variance."""
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(column).cast("double")
    v = F.coalesce(x, F.lit(0.0))
    exact = F.coalesce(F.col(column), F.lit(0)) if df.schema[column].dataType.typeName() == "long" else v  # sums of whole numbers have no error
    df = df.withColumns({"_cn": F.count(x).over(run), "_cs": F.sum(exact).over(run), "_cq": F.sum(v * v).over(run)})
    n, s, ss = (F.col(c) - F.coalesce(F.lag(c, width).over(w), F.lit(0)) for c in ("_cn", "_cs", "_cq"))
    df = df.withColumns({"_n": n, "_s": s, "_q": ss})
    n, s, ss = F.col("_n"), F.col("_s"), F.col("_q")
    full = n == width
    out = {}
    if mean:
        out[mean] = F.when(full | F.lit(online), s / n)
    if total:
        out[total] = F.when(full | F.lit(online), s)
    if z and online:
        var = ss / n - (s / n) * (s / n)
        out[z] = F.when((n >= 2) & (var > 1e-12), (x - s / n) / (F.sqrt(var) + eps)).otherwise(0.0)
    elif z:
        out[z] = F.when(full & x.isNotNull(), _z(x, n, s, ss, eps))
    return df.withColumns(out).drop("_cn", "_cs", "_cq", "_n", "_s", "_q")


def rolling_zscore(rows: DataFrame, column: str, width: int, out: str, online: bool = False, eps: float = 1e-8) -> DataFrame:
    return in_chunks(rows, lambda d, w: add_rolling(d, w, column, width, z=out, online=online, eps=eps), width)


def rolling_mean(rows: DataFrame, column: str, width: int, out: str, online: bool = False) -> DataFrame:
    return in_chunks(rows, lambda d, w: add_rolling(d, w, column, width, mean=out, online=online), width)


def rolling_quantile(rows: DataFrame, column: str, width: int, p: float, out: str, size: int = SIZE) -> DataFrame:
    """Trailing quantile of full windows, linear between order statistics; a sorted window in each chunk."""
    schema = rows.withColumn(out, F.lit(None).cast("double")).schema

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i", kind="stable")
        f[out] = f[column].astype(float).rolling(width).quantile(p, interpolation="linear")
        return f.loc[f["own"], schema.names]

    return chunks(rows, width, size=size).groupBy("symbol", "chunk").applyInPandas(run, schema)


def features(trades: DataFrame) -> DataFrame:
    """i, p, q, sign, v (signed quantity), sv (the same in whole units of 1e-8), x (log price), r, dt (seconds), spd, spd_online and
    tox of each trade with a price."""
    p, q = F.col("px") / 1e8, F.col("qty") / 1e8
    sign = F.when(F.col("flags").bitwiseAND(1) == 1, -1).otherwise(1)
    rows = indexed(trades.where("px > 0")).withColumns({"p": p, "q": q, "sign": sign, "v": q * sign, "sv": F.col("qty") * sign, "x": F.log(p)})

    def step(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"r": F.col("x") - F.lag("x").over(w), "dt": (F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000.0, "tox": F.col("q") * F.abs(F.col("sign") - F.lag("sign").over(w))})
        return d.withColumns({"spd": F.col("v") / (F.sqrt("dt") + 0.001), "spd_online": F.col("v") / F.sqrt(F.greatest("dt", F.lit(0.001)))})

    return in_chunks(rows, step, 1)


def kernels(ticks: DataFrame, short: int = 64, medium: int = 1024, long: int = 10_000, smooth: int = 256, online: bool = False, which=("k1", "k3", "k4"), size: int = SIZE) -> DataFrame:
    """Adds k1 (order flow and speed), k3 (toxicity) and k4 (liquidity), or ``which`` of them, to the rows of ``features``.

    The spec form has nulls until its windows are full; the online form (one look at each trade) has partial windows, the raw
    toxicity in k3, and 1 in place of the volume quantile in k4."""
    depth = {"k1": short + medium, "k3": long if online else medium + long, "k4": medium if online else smooth + medium}
    if "k4" in which and not online:
        ticks = rolling_quantile(ticks.withColumn("_a", F.abs("v")), "_a", long, 0.9, "_p90", size).drop("_a")

    def step(d: DataFrame, w: WindowSpec) -> DataFrame:
        if "k1" in which:
            d = d.withColumn("_spd", F.coalesce("spd_online", F.lit(0.0)) if online else F.col("spd"))
            d = add_rolling(d, w, "sv", short, total="_ofi", online=online).withColumn("_ofi", F.col("_ofi") / 1e8)
            for c in ("_ofi", "_spd"):
                d = add_rolling(d, w, c, medium, z=f"_z{c}", online=online)
            d = d.withColumn("k1", 0.75 * F.col("_z_ofi") + 0.25 * F.col("_z_spd"))
        if "k3" in which:
            d = d.withColumn("_tox", F.coalesce("tox", F.lit(0.0))) if online else add_rolling(d, w, "tox", medium, mean="_tox")
            d = add_rolling(d, w, "_tox", long, z="k3", online=online)
        if "k4" in which:
            if online:
                d = d.withColumn("_lam", F.coalesce(F.abs("r"), F.lit(0.0)) / (F.abs("v") + 1.0))
            else:
                d = add_rolling(d.withColumn("_raw", F.abs("r") / (F.abs("v") + 0.01 * F.col("_p90"))), w, "_raw", smooth, mean="_lam")
            d = add_rolling(d, w, "_lam", medium, z="_z_lam", online=online).withColumn("k4", -F.col("_z_lam"))
        return d

    out = in_chunks(ticks, step, max(depth[k] for k in which), size=size)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def asof(left: DataFrame, right: DataFrame, on: str, values: list[str], keys: list[str] = (), at: Column | None = None, tie: str = "trade_id", strict: bool = False, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Left rows with the ``values`` of the last right row whose ``on`` is at or before (strict: before) the left row's time
    ``at`` (its own ``on``, if not given); nulls if there is none. Of equal times the largest ``tie`` counts.

    The work is cut into buckets of time; a bucket starts from the last right row of the buckets before it.
    """
    keys = list(keys)
    mine = left.withColumn("_at", at if at is not None else F.col(on)).withColumn("_side", F.lit(0 if strict else 1))
    pack = F.struct(*values)
    kind = right.select(pack.alias("s")).schema["s"].dataType
    theirs = right.select(*keys, F.col(on).alias("_at"), F.col(tie).alias("_tie"), pack.alias("_v"), F.lit(1 if strict else 0).alias("_side"), F.lit(True).alias("_right"))
    both = mine.withColumns({"_tie": F.lit(None).cast(right.schema[tie].dataType), "_v": F.lit(None).cast(kind), "_right": F.lit(False)}).unionByName(theirs, allowMissingColumns=True)
    return _last_before(both, keys, left.columns, bucket_ms).select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


def _last_before(both: DataFrame, keys: list[str], columns: list[str], bucket_ms: int) -> DataFrame:
    """The rows that are not _right, with the _v of the last _right row by (_at, _side, _tie). The rows are written once, and read for the
    buckets' ends and for the windows inside buckets."""
    both = written(both.withColumn("_b", F.floor(F.col("_at") / bucket_ms)), "asof")
    last = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_right"), F.struct("_at", "_tie"))).alias("_last"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    carry = last.select(*keys, "_b", F.last("_last", ignorenulls=True).over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("not _right")
    return both.join(carry, [*keys, "_b"], "left").withColumn("_v", F.coalesce("_v", "_carry")).select(*columns, "_v")


def ahead(ticks: DataFrame, horizons: list[int], value: str = "p") -> DataFrame:
    """The rows once for each of ``horizons`` (ms), with _h, the horizon, and _v, the symbol's ``value`` in force that much later. Each row is
    looked up and looks up others in one pass, however many horizons there are."""
    looks = [F.struct((F.col("ts_ms") + h).alias("_at"), F.lit(1).alias("_side"), F.lit(h).cast("long").alias("_h"), F.lit(False).alias("_right")) for h in horizons]
    own = F.struct(F.col("ts_ms").alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_h"), F.lit(True).alias("_right"))
    rows = ticks.withColumn("_e", F.explode(F.array(own, *looks))).select("*", "_e.*").drop("_e")
    right = F.col("_right")
    columns = [F.when(~right, F.col(c)).alias(c) if c != "symbol" else F.col(c) for c in ticks.columns]
    both = rows.select(*columns, "_at", "_side", "_h", "_right", F.when(right, F.col("trade_id")).alias("_tie"), F.when(right, F.struct(F.col(value).alias("x"))).alias("_v"))
    return _last_before(both, ["symbol"], [*ticks.columns, "_h"], BUCKET_MS).withColumn("_v", F.col("_v.x"))


def forward_price(ticks: DataFrame, horizon_ms: int = 500) -> DataFrame:
    """y: the price in force ``horizon_ms`` later, less the price now."""
    return ahead(ticks, [horizon_ms]).withColumn("y", F.col("_v") - F.col("p")).drop("_v", "_h")


def lead_lag(ticks: DataFrame, leader: DataFrame, width: int = 1024, weights=(0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """k2: the z-score of the weighted last returns of a leader (ts_ms, trade_id, r_spot; a symbol column if each symbol has its
    own), joined as of each trade."""
    met = asof(ticks, leader, "ts_ms", ["r_spot"], ["symbol"] if "symbol" in leader.columns else [])

    def step(d: DataFrame, w: WindowSpec) -> DataFrame:
        mixed = sum(F.lag("r_spot", k).over(w) * c if k else F.col("r_spot") * c for k, c in enumerate(weights))
        return add_rolling(d.withColumn("_lead", mixed), w, "_lead", width, z="k2").drop("_lead")

    return in_chunks(met, step, width + len(weights))


def regime(ticks: DataFrame, step: int = 5000) -> DataFrame:
    """(symbol, ts_ms, hurst, efficiency): each whole block of ``step`` trades, stamped with the trade that follows it.

    hurst is twice the log-log slope of the deviation of 5-, 10- and 20-trade log-price differences, 0.5 if the first is 0."""
    lags = (5, 10, 20)
    block = F.floor((F.col("i") - 1) / step)
    w = Window.partitionBy("symbol", "_b").orderBy("i")
    d = ticks.withColumn("_b", block).withColumns({f"_d{k}": F.col("x") - F.lag("x", k).over(w) for k in (1, *lags)})
    blocks = d.groupBy("symbol", "_b").agg(F.min_by("ts_ms", "i").alias("ts0"), F.min_by("x", "i").alias("a"), F.max_by("x", "i").alias("z"), F.sum(F.abs("_d1")).alias("path"), *[F.stddev_pop(f"_d{k}").alias(f"s{k}") for k in lags])
    blocks = blocks.withColumn("ts_ms", F.lead("ts0").over(Window.partitionBy("symbol").orderBy("_b"))).where("ts_ms is not null")
    t = np.log(lags) - np.log(lags).mean()
    slope = sum(F.log(f"s{k}") * float(c / (t * t).sum()) for k, c in zip(lags, t))
    return blocks.select("symbol", "ts_ms", F.when(F.col("s5") == 0, 0.5).otherwise(2 * slope).alias("hurst"), F.when(F.col("path") > 0, (F.col("z") - F.col("a")) / F.col("path")).alias("efficiency"))


def ffill_regime(ticks: DataFrame, k5: DataFrame) -> DataFrame:
    """Ticks with the hurst and efficiency that were last known."""
    return asof(ticks, k5.withColumn("_tie", F.lit(0)), "ts_ms", ["hurst", "efficiency"], ["symbol"], tie="_tie")


def trade_signal(k1: Column, k2: Column, weight: float = 0.5, limit: float = 2.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), k1 + weight * k2))


def position_scale(k3: Column, k4: Column, factor: float = 0.5) -> Column:
    """0 where liquidity is scarce (k4 <= -1), ``factor`` where flow is toxic (k3 > 1), else 1; null while one is unknown."""
    return F.when(k3.isNull() | k4.isNull(), None).when(k4 <= -1, 0.0).when(k3 > 1, factor).otherwise(1.0)


def composite_alpha(k1: Column, k3: Column, k4: Column) -> Column:
    return k1 * F.when(k4 < -1.5, 0.0).when(k3 > 2, 0.2).when(k3 > 1, 0.5).otherwise(1.0)


def hit_rate(rows: DataFrame, gate: float = 0.5) -> DataFrame:
    """By symbol: how often the signs of k1 and y agree and the basis points won, over all trades and over those with k4 above ``gate``."""
    d = rows.where("k1 is not null and y is not null").withColumns({"hit": (F.signum("k1") == F.signum("y")).cast("double"), "bps": F.signum("k1") * F.col("y") / F.col("p") * 1e4})
    open_ = F.col("k4") > gate
    return d.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("hit").alias("hit_rate"), F.avg("bps").alias("bps_per_trade"), F.count_if(open_).alias("n_open"), F.avg(F.when(open_, F.col("hit"))).alias("hit_rate_open"), F.avg(F.when(open_, F.col("bps"))).alias("bps_per_trade_open"))
