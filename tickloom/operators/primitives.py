"""Microstructure signals of the rows of ``ticks.features``, by symbol across days (see ticks.in_chunks)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_bins, exact_quantiles
from .ticks import in_chunks, indexed


def _later(ticks: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds columns that lie some rows ahead (or behind, if negative)."""
    back, ahead = max([0, *(-k for _, k in columns.values())]), max([0, *(k for _, k in columns.values())])
    return in_chunks(ticks, lambda d, w: d.withColumns({n: F.lead(c, k).over(w) for n, (c, k) in columns.items()}), back, ahead)


def slope(points: list[tuple[Column, float]]) -> Column:
    """Least-squares slope of some columns over fixed abscissae; null if one of them is."""
    t = np.array([x for _, x in points])
    t = t - t.mean()
    return sum(y * float(c / (t * t).sum()) for (y, _), c in zip(points, t))


def impact_response(ticks: DataFrame, taus=(1,)) -> DataFrame:
    """(symbol, tau, response, signature): the mean signed log-price move after ``tau`` trades, and over its root mean square."""
    d = _later(ticks, {f"_x{t}": ("x", t) for t in taus})
    d = d.select("symbol", "sign", F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), (F.col(f"_x{t}") - F.col("x")).alias("d")) for t in taus])).alias("_m")).where("_m.d is not null")
    move = F.col("_m.d")
    d = d.groupBy("symbol", F.col("_m.tau").alias("tau")).agg(F.avg(move * F.col("sign")).alias("response"), F.sqrt(F.avg(move * move)).alias("_rms"))
    return d.withColumn("signature", F.when(F.col("_rms") > 0, F.col("response") / F.col("_rms"))).drop("_rms")


def sign_autocorr(ticks: DataFrame, taus=(1,)) -> DataFrame:
    d = _later(ticks, {f"_s{t}": ("sign", t) for t in taus})
    return d.groupBy("symbol").agg(*[F.avg(F.col("sign") * F.col(f"_s{t}")).alias(f"acf_{t}") for t in taus])


def blocks(ticks: DataFrame, size: int = 100) -> DataFrame:
    """(symbol, b, trade_date, n, dp, net, qty, notional): whole and unfinished blocks of ``size`` trades; dp is the log-price move
    to the first trade of the next block."""
    b = F.floor((F.col("i") - 1) / size)
    d = ticks.groupBy("symbol", b.alias("b")).agg(F.min("trade_date").alias("trade_date"), F.count("*").alias("n"), F.min_by("x", "i").alias("x0"), F.min_by("p", "i").alias("p0"), F.sum("v").alias("net"), F.sum("q").alias("qty"), F.sum(F.col("q") * F.col("p")).alias("notional"))
    w = Window.partitionBy("symbol").orderBy("b")
    return d.withColumn("dp", F.lead("x0").over(w) - F.col("x0")).drop("x0")


def permanent_impact(ticks: DataFrame, size: int = 100) -> DataFrame:
    """(symbol, g_inf): sum(dp * net) / sum(net^2) over whole blocks that another one follows; 0 without net volume."""
    d = blocks(ticks, size).where("dp is not null").groupBy("symbol").agg(F.sum(F.col("dp") * F.col("net")).alias("a"), F.sum(F.col("net") * F.col("net")).alias("b"))
    return d.select("symbol", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("g_inf"))


def meta_orders(ticks: DataFrame, size: int = 100) -> DataFrame:
    """(symbol, impact, qty, vol, sigma): each block as an order, with its day's volume and deviation of returns."""
    day = ticks.groupBy("symbol", "trade_date").agg(F.sum("q").alias("vol"), F.stddev_samp("r").alias("sigma"))
    return blocks(ticks, size).where("dp is not null").join(day, ["symbol", "trade_date"]).select("symbol", F.col("dp").alias("impact"), F.abs("net").alias("qty"), "vol", "sigma")


def concave_impact(orders: DataFrame) -> DataFrame:
    """(y, delta): ln(|impact| / sigma) = ln y + delta * ln(qty / vol) over orders with an impact and a quantity."""
    y, x = F.log(F.abs("impact") / F.col("sigma")), F.log(F.col("qty") / F.col("vol"))
    d = orders.where("impact <> 0 and qty > 0 and vol > 0 and sigma > 0")
    return d.agg(F.exp(F.regr_intercept(y, x)).alias("y"), F.regr_slope(y, x).alias("delta"))


def hawkes_intensity(ticks: DataFrame, alpha: float = 0.8, beta: float = 0.1) -> DataFrame:
    """(symbol, trade_date, i, trade_id, buys, sells): intensities that jump by ``alpha`` and decay by ``beta`` a second; new every day.

    Sums are rescaled whenever beta times the time since the last rescaling passes 30, so that no exponential overflows."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i", kind="stable")
        t, sell = beta * (f["ts_ms"].to_numpy() - f["ts_ms"].iat[0]) / 1000.0, f["sign"].to_numpy() < 0
        buys, sells = np.empty(len(f)), np.empty(len(f))
        at, b, s, last = 0, 0.0, 0.0, t[0]
        while at < len(t):
            end = max(at + 1, int(np.searchsorted(t, t[at] + 30.0, "right")))
            grow = np.exp(t[at:end] - t[at])
            decay = np.exp(t[at] - last) if t[at] < last else np.exp(-(t[at] - last))
            buys[at:end] = (b * decay + np.cumsum(np.where(sell[at:end], 0.0, alpha * grow))) / grow
            sells[at:end] = (s * decay + np.cumsum(np.where(sell[at:end], alpha * grow, 0.0))) / grow
            b, s, last, at = buys[end - 1], sells[end - 1], t[end - 1], end
        return pd.DataFrame({"symbol": f["symbol"].iat[0], "trade_date": f["trade_date"].iat[0], "i": f["i"], "trade_id": f["trade_id"], "buys": buys, "sells": sells})

    slim = ticks.select("symbol", "trade_date", "i", "trade_id", "ts_ms", "sign")
    return slim.groupBy("symbol", "trade_date").applyInPandas(run, "symbol string, trade_date date, i long, trade_id long, buys double, sells double")


def hawkes_fade(intensities: DataFrame, width: int = 256, limit: float = 3.5) -> DataFrame:
    """Adds z, of the total intensity against the ``width`` rows before it, and fade (z > limit); null until they are full."""

    def step(d: DataFrame, w) -> DataFrame:
        run = w.rowsBetween(-width, -1)
        d = d.withColumn("_t", F.col("buys") + F.col("sells")).withColumns({"_n": F.count("*").over(run), "_m": F.avg("_t").over(run), "_s": F.stddev_samp("_t").over(run)})
        return d.withColumn("z", F.when((F.col("_n") == width) & (F.col("_s") > 0), (F.col("_t") - F.col("_m")) / F.col("_s")))

    return in_chunks(intensities, step, width).withColumn("fade", F.col("z") > limit).drop("_t", "_n", "_m", "_s")


def hawkes_rho(params: DataFrame) -> DataFrame:
    """Largest eigenvalue of alpha_ij / beta_ij (columns a11..a22, b11..b22) of each row."""
    k = {ij: F.col(f"a{ij}") / F.col(f"b{ij}") for ij in ("11", "12", "21", "22")}
    trace, det = k["11"] + k["22"], k["11"] * k["22"] - k["12"] * k["21"]
    return params.withColumn("rho", trace / 2 + F.sqrt(F.greatest(trace * trace / 4 - det, F.lit(0.0))))


def multifractal_width(ticks: DataFrame, q_min: float = -2.0, q_max: float = 2.0, lags=(1, 2, 4, 8, 16, 32, 64)) -> DataFrame:
    """(symbol, width): H(q_min) - H(q_max), H(q) = slope of ln E|x_i - x_(i-lag)|^q on ln lag, over q; equal prices left out."""
    d = _later(ticks, {f"_x{k}": ("x", -k) for k in lags})
    move = lambda k: F.abs(F.col("x") - F.col(f"_x{k}"))
    d = d.groupBy("symbol").agg(*[F.log(F.avg(F.when(move(k) > 0, F.pow(move(k), F.lit(q))))).alias(f"_m{j}_{k}") for j, q in enumerate((q_min, q_max)) for k in lags])
    h = [slope([(F.col(f"_m{j}_{k}"), float(np.log(k))) for k in lags]) / q for j, q in enumerate((q_min, q_max))]
    return d.select("symbol", (h[0] - h[1]).alias("width"))


def noise_variance(ticks: DataFrame, sparse: int = 5) -> DataFrame:
    """(symbol, noise): (RV of all returns - RV of every ``sparse``-th row's return) / (2 * number of returns)."""
    d = _later(ticks, {"_x": ("x", -sparse)}).where("r is not null")
    coarse = F.when((F.col("i") - 1) % sparse == 0, F.pow(F.col("x") - F.col("_x"), 2))
    return d.groupBy("symbol").agg(((F.sum(F.col("r") * F.col("r")) - F.coalesce(F.sum(coarse), F.lit(0.0))) / (2.0 * F.count("*"))).alias("noise"))


def realized_variance(ticks: DataFrame, ms: int) -> DataFrame:
    """(symbol, rv): squared log moves between the last prices of the clock's intervals that have trades."""
    last = ticks.groupBy("symbol", F.floor(F.col("ts_ms") / ms).alias("g")).agg(F.max_by("x", "i").alias("c"), F.count("*").alias("n"))
    # the interval before: intervals are numbered as ticks are, so that no task holds a symbol
    place = last.withColumnsRenamed({"g": "trade_id"}).withColumns({"trade_date": F.to_date(F.timestamp_millis(F.col("trade_id") * ms)), "x": F.col("c")})
    moved = in_chunks(indexed(place), lambda d, w: d.withColumn("m", F.col("x") - F.lag("x").over(w)), 1)
    return moved.groupBy("symbol").agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("rv"))


def vol_signature_bias(ticks: DataFrame, dense_ms: int = 1000, sparse_ms: int = 60_000) -> DataFrame:
    """(symbol, bias): RV of the sparse clock over the dense one's times the ratio of their lengths."""
    a, b = realized_variance(ticks, sparse_ms).withColumnRenamed("rv", "s"), realized_variance(ticks, dense_ms)
    return a.join(b, "symbol").select("symbol", F.when(F.col("rv") > 0, F.col("s") / (F.col("rv") * (sparse_ms / dense_ms))).alias("bias"))


def lagged_pairs(a: DataFrame, b: DataFrame, lags: list[int], grid_ms: int, keys=()) -> DataFrame:
    """(keys, lag, g, va, vb): the sums of two series (keys, ts_ms, v) on a common grid, b moved by each lag of grid steps."""
    on_grid = lambda d, n: d.groupBy(*keys, F.floor(F.col("ts_ms") / grid_ms).alias("g")).agg(F.sum("v").alias(n))
    moved = on_grid(b, "vb").withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("g", F.col("g") + F.col("lag"))
    return on_grid(a, "va").join(moved, [*keys, "g"]).select(*keys, "lag", "g", "va", "vb")


def best_lag(pairs: DataFrame, keys=()) -> DataFrame:
    """(keys, lag, rho): the lag of the largest positive correlation, the smallest of equal ones; lag 0 and rho 0 if there is none."""
    d = pairs.groupBy(*keys, "lag").agg(F.corr("va", "vb").alias("rho"))
    best = d.groupBy(*keys).agg(F.max(F.when(F.col("rho") > 0, F.struct("rho", (-F.col("lag")).alias("l")))).alias("m"))
    return best.select(*keys, F.coalesce(-F.col("m.l"), F.lit(0)).alias("lag"), F.coalesce("m.rho", F.lit(0.0)).alias("rho"))


def impact_asymmetry(ticks: DataFrame, tau: int = 1) -> DataFrame:
    """(symbol, ratio): mean signed log move after a buy over that after a sell."""
    d = _later(ticks, {"_x": ("x", tau)}).withColumn("m", (F.col("_x") - F.col("x")) * F.col("sign"))
    buy, sell = (F.avg(F.when(F.col("sign") == s, F.col("m"))) for s in (1, -1))
    return d.groupBy("symbol").agg(buy.alias("b"), sell.alias("s")).select("symbol", F.when(F.col("s") != 0, F.col("b") / F.col("s")).alias("ratio"))


def meta_acceleration(ticks: DataFrame, column: str = "x") -> DataFrame:
    """Adds acc: the second difference of an impact curve (the log price, if not named); 0 for a symbol's first two rows."""
    d = in_chunks(ticks, lambda d, w: d.withColumns({"_1": F.lag(column, 1).over(w), "_2": F.lag(column, 2).over(w)}), 2)
    return d.withColumn("acc", F.coalesce(F.col(column) - 2 * F.col("_1") + F.col("_2"), F.lit(0.0))).drop("_1", "_2")


def resilience(ticks: DataFrame, theta: float = 0.5, share: float = 0.95) -> DataFrame:
    """(symbol, trade_date, trade_id, steps): of returns beyond the symbol's ``share`` quantile of |r|, how many trades until the
    price is within theta of the move from where it was; -1 if it never is on that day. A search in doubling steps."""
    cut = exact_quantiles(ticks, ["symbol"], F.abs("r"), cut=share).drop("n")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i", kind="stable")
        p, r = f["p"].to_numpy(), f["r"].abs().to_numpy()
        shocks = [k for k in np.flatnonzero(r > f["cut"].iat[0]) if k > 0]
        steps = []
        for k in shocks:
            ref, limit, at, width, found = p[k - 1], theta * abs(p[k] - p[k - 1]), k + 1, 64, -1
            while at < len(p):
                hit = np.flatnonzero(np.abs(p[at : at + width] - ref) < limit)
                if len(hit):
                    found = at + int(hit[0]) - k
                    break
                at, width = at + width, width * 2
            steps.append(found)
        return pd.DataFrame({"symbol": f["symbol"].iat[0], "trade_date": f["trade_date"].iat[0], "trade_id": f["trade_id"].to_numpy()[shocks], "steps": np.array(steps, np.int32)})

    slim = ticks.select("symbol", "trade_date", "trade_id", "i", "p", "r").join(cut, "symbol")
    return slim.groupBy("symbol", "trade_date").applyInPandas(run, "symbol string, trade_date date, trade_id long, steps int")


def _volume_place(ticks: DataFrame, size: int | None, n_buckets: int | None) -> DataFrame:
    """The rows with _hi, the symbol's volume up to and with the trade, and _u, a bucket's, in whole units of 1e-8."""
    day = ticks.groupBy("symbol", "trade_date").agg(F.sum("qty").alias("_d"))
    run = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select("symbol", "trade_date", F.coalesce(F.sum("_d").over(run), F.lit(0)).alias("_base"), F.sum("_d").over(Window.partitionBy("symbol")).alias("_all"))
    inside = F.sum("qty").over(Window.partitionBy("symbol", "trade_date").orderBy("trade_id").rowsBetween(Window.unboundedPreceding, 0))
    d = ticks.withColumn("_hi", inside).join(day, ["symbol", "trade_date"]).withColumn("_hi", F.col("_hi") + F.col("_base"))
    unit = F.lit(size).cast("long") if size else F.greatest(F.ceil(F.col("_all") / n_buckets), F.lit(1))
    return d.withColumn("_u", unit).drop("_base", "_all")


def volume_bars(ticks: DataFrame, size: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """(symbol, bucket, vol, net, vwap, close): equal-volume buckets (``size`` in units of 1e-8, or the symbol's volume in ``n_buckets``);
    a trade over a boundary is split. A whole symbol's buckets run over its days."""
    d = _volume_place(ticks, size, n_buckets)
    d = d.withColumn("_lo", F.col("_hi") - F.col("qty")).where("qty > 0")
    d = d.withColumn("bucket", F.explode(F.sequence(F.expr("_lo div _u"), F.expr("(_hi - 1) div _u"))))
    part = F.least(F.col("_hi"), (F.col("bucket") + 1) * F.col("_u")) - F.greatest(F.col("_lo"), F.col("bucket") * F.col("_u"))
    d = d.withColumn("_part", part)
    return d.groupBy("symbol", "bucket").agg((F.sum("_part") / 1e8).alias("vol"), (F.sum(F.col("_part") * F.col("sign")) / 1e8).alias("net"), (F.sum(F.col("p") * F.col("_part")) / F.sum("_part")).alias("vwap"), F.max_by("p", "i").alias("close"))


def vpin(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.avg(F.abs("net") / F.col("vol")).alias("vpin"))


def rolling_vpin(ticks: DataFrame, size: int | None = None, n_buckets: int | None = None, window: int = 10) -> DataFrame:
    """The trades with vpin: the mean |net| / volume of the last ``window`` volume buckets (fewer at the beginning) that were full when
    the trade came or that it filled; null before the first."""
    bars = volume_bars(ticks, size, n_buckets)
    w = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(1 - window, 0)
    per = bars.select("symbol", F.col("bucket").alias("_full"), F.avg(F.abs("net") / F.col("vol")).over(w).alias("vpin"))
    return _volume_place(ticks, size, n_buckets).withColumn("_full", F.expr("_hi div _u") - 1).join(per, ["symbol", "_full"], "left").drop("_full", "_hi", "_u")


def hill_index(ticks: DataFrame, tail: float = 0.05) -> DataFrame:
    """(symbol, hill) of the k = floor(n * tail) largest |r| > 0 against the next one. The cut is narrowed by an approximate
    quantile, so that only the tail is sorted."""
    d = ticks.where("r <> 0").select("symbol", F.abs("r").alias("y"), "i")
    low = d.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile_approx("y", max(0.0, 1 - 1.5 * tail), 1000).alias("low"))
    top = d.join(F.broadcast(low), "symbol").where("y >= low")
    w = Window.partitionBy("symbol").orderBy(F.desc("y"), "i")
    ranked = top.withColumns({"rk": F.row_number().over(w), "k": F.floor(F.col("n") * tail)}).where("rk <= k + 1")
    g = ranked.groupBy("symbol").agg(F.max("k").alias("k"), F.sum(F.when(F.col("rk") <= F.col("k"), F.log("y"))).alias("s"), F.max(F.when(F.col("rk") == F.col("k") + 1, F.log("y"))).alias("yk"))
    return g.where("k > 0").select("symbol", (1.0 / (F.col("s") / F.col("k") - F.col("yk"))).alias("hill"))


def transfer_entropy(ticks: DataFrame, x: str = "v", y: str = "r", bins: int | None = None) -> DataFrame:
    """(symbol, te): H(y' | y) - H(y' | y, x) of the signs of two columns, or of their quantile ``bins`` (exact, by symbol; equal values
    in one bin); counted by group before any join."""
    d = ticks.where(f"{y} is not null and {x} is not null")
    if bins:
        d = exact_bins(exact_bins(d.select("symbol", "i", x, y), ["symbol"], x, bins, "x0"), ["symbol"], y, bins, "y0")
    else:
        d = d.withColumns({"x0": F.signum(x), "y0": F.signum(y)})
    d = in_chunks(d, lambda d, w: d.withColumn("y1", F.lead("y0").over(w)), 0, 1).where("y1 is not null")
    c = d.groupBy("symbol", "y1", "y0", "x0").agg(F.count("*").cast("double").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("symbol", *k))
    c = c.withColumns({"t": over(), "a": over("y0", "x0"), "b": over("y1", "y0"), "c": over("y0")})
    return c.groupBy("symbol").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("c") / (F.col("a") * F.col("b")))).alias("te"))


def pairs_within(points: DataFrame, columns: list[str], r: float, key: str = "id") -> DataFrame:
    """(id_a, id_b) with id_a < id_b and Euclidean distance below ``r``: each point meets the points of its grid cell and of half
    of the cells around it. The result holds every such pair, so its size is that of the answer."""
    from itertools import product

    cell = [F.floor(F.col(c) / r) for c in columns]
    at = points.select(key, *columns, *[c.alias(f"_c{k}") for k, c in enumerate(cell)])
    near = [o for o in product((-1, 0, 1), repeat=len(columns)) if o >= (0,) * len(columns)]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"_o{k}") for k, v in enumerate(o)]) for o in near])
    spread = at.withColumn("_o", F.explode(offsets)).select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns], *[(F.col(f"_c{k}") + F.col(f"_o._o{k}")).alias(f"_c{k}") for k in range(len(columns))], F.expr(" and ".join(f"_o._o{k} = 0" for k in range(len(columns)))).alias("_own"))
    met = spread.join(at, [f"_c{k}" for k in range(len(columns))]).where(~F.col("_own") | (F.col("_a") < F.col(key)))
    distance = sum((F.col(f"_a_{c}") - F.col(c)) * (F.col(f"_a_{c}") - F.col(c)) for c in columns)
    return met.where(distance < r * r).select(F.least("_a", key).alias("id_a"), F.greatest("_a", key).alias("id_b"))


def correlation_dimension(points: DataFrame, columns: list[str], r: float, key: str = "id") -> DataFrame:
    """(pairs): how many pairs are within ``r``."""
    return pairs_within(points, columns, r, key).agg(F.count("*").alias("pairs"))


def bartlett_weights(h: int) -> list[float]:
    return [1 - k / (h + 1) for k in range(1, h + 1)]


def parzen_weights(h: int) -> list[float]:
    """Of lags 1 to h, over a span of h + 1."""
    x = [k / (h + 1) for k in range(1, h + 1)]
    return [1 - 6 * v**2 + 6 * v**3 if v <= 0.5 else 2 * (1 - v) ** 3 for v in x]


def realized_kernel(ticks: DataFrame, weights: list[float]) -> DataFrame:
    """(symbol, rk): the sum of squared returns and twice the weighted sums of products of returns 1, 2, ... rows apart."""
    d = _later(ticks, {f"_r{k}": ("r", -k) for k in range(1, len(weights) + 1)})
    r = F.col("r")
    total = F.sum(r * r) + sum(F.coalesce(F.sum(r * F.col(f"_r{k}")), F.lit(0.0)) * (2 * w) for k, w in enumerate(weights, 1))
    return d.groupBy("symbol").agg(total.alias("rk"))


def fano_factor(ticks: DataFrame, window: int = 100) -> DataFrame:
    """(symbol, fano): the mean over whole blocks of ``window`` trades of variance over mean of the child trade counts."""
    b = ticks.groupBy("symbol", F.floor((F.col("i") - 1) / window).alias("b")).agg(F.count("*").alias("n"), (F.var_samp("trade_count") / F.avg("trade_count")).alias("f"))
    return b.where(F.col("n") == window).groupBy("symbol").agg(F.avg("f").alias("fano"))


def burstiness(ticks: DataFrame, lookback: int = 100) -> DataFrame:
    """Adds burst, the largest child trade count of the last ``lookback`` trades."""
    return in_chunks(ticks, lambda d, w: d.withColumn("burst", F.max("trade_count").over(w.rowsBetween(1 - lookback, 0))), lookback)


def _from_end(ticks: DataFrame) -> DataFrame:
    """Adds _k, how many rows of the symbol come after this one."""
    last = ticks.groupBy("symbol").agg(F.max("i").alias("_n"))
    return ticks.join(F.broadcast(last), "symbol").withColumn("_k", F.col("_n") - F.col("i"))


def fractional_weights(spark, d: float, n: int) -> DataFrame:
    """(k, w) for k from 0 to n - 1: w_0 = 1, w_k = -w_(k-1) (d - k + 1) / k."""
    w = [1.0]
    for k in range(1, n):
        w.append(-w[-1] * (d - k + 1) / k)
    return spark.createDataFrame(list(enumerate(w)), "k long, w double")


def farima_forecast(ticks: DataFrame, d: float = 0.4, terms: int = 500) -> DataFrame:
    """(symbol, forecast): the sum of w_k v_(k+1 from the end) for k from 1 to terms - 1, of the symbol's last trades."""
    tail = _from_end(ticks).where(F.col("_k").between(1, terms - 1))
    return tail.join(F.broadcast(fractional_weights(ticks.sparkSession, d, terms)), F.col("_k") == F.col("k")).groupBy("symbol").agg(F.sum(F.col("w") * F.col("v")).alias("forecast"))


def propagator_response(ticks: DataFrame, gamma: float = 0.5) -> DataFrame:
    """(symbol, response): the sum over all trades but the last of v / (rows from there to the end)^gamma."""
    return _from_end(ticks).where("_k > 0").groupBy("symbol").agg(F.sum(F.col("v") / F.pow(F.col("_k") + 1, F.lit(gamma))).alias("response"))


def lagged_correlations(rows: DataFrame, x: str, y: str, lags: list[int]) -> DataFrame:
    """(symbol, lag, rho): correlation of x with y ``lag`` rows before; one pass for all lags."""
    d = _later(rows, {f"_y{j}": (y, -k) for j, k in enumerate(lags)})
    g = d.groupBy("symbol").agg(*[F.corr(x, f"_y{j}").alias(f"_c{j}") for j in range(len(lags))])
    return g.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_c{j}").alias("rho")) for j, k in enumerate(lags)])).alias("_m")).select("symbol", "_m.lag", "_m.rho")


def rough_volatility(ticks: DataFrame, q: float = 2.0, lags=(1, 2, 4, 8, 16), floor: float = 1e-6) -> DataFrame:
    """(symbol, h): slope of ln E|difference of ln(floor + |r|)|^q on ln lag, over q; one pass for all lags."""
    d = ticks.withColumn("_v", F.log(F.abs("r") + floor))
    d = _later(d, {f"_v{k}": ("_v", -k) for k in lags})
    move = lambda k: F.abs(F.col("_v") - F.col(f"_v{k}"))
    d = d.groupBy("symbol").agg(*[F.log(F.avg(F.when(move(k) > 0, F.pow(move(k), F.lit(q))))).alias(f"_m{k}") for k in lags])
    return d.select("symbol", (slope([(F.col(f"_m{k}"), float(np.log(k))) for k in lags]) / q).alias("h"))
