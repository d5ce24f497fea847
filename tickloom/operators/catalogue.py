"""Metrics of signals, simulated trades and books that need more than one aggregate.

A signal panel has symbol, trade_date, trade_id, i, s (the signal) and rf (the return that follows); see ``signal_panel``.
Resampling draws from md5 of the replicate and the row's number, so that it is the same at any partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ticks import add_rolling, in_chunks

#: Cumulative probabilities of a Poisson variable of mean 1; beyond the last one the count is their number.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]).tolist()
#: Digests that are Python objects at a time.
DIGESTS = 65_536


def signal_panel(ticks: DataFrame, width: int = 8, ahead: int = 4) -> DataFrame:
    """The rows of ``features`` with s, the mean signed volume of the last ``width`` trades, and rf, the log return of the next ``ahead``."""

    def step(d: DataFrame, w) -> DataFrame:
        return add_rolling(d, w, "sv", width, mean="s").withColumn("s", F.col("s") / 1e8).withColumn("rf", F.lead("x", ahead).over(w) - F.col("x"))

    return in_chunks(ticks, step, width, ahead).where("s is not null and rf is not null")


def tail_probability(f: Column) -> Column:
    """P(chi-square of one degree of freedom > f), for a few aggregated rows: Spark SQL has no error function."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)) if v == v else None)

    return tail(f)


def _sums(*names: str) -> dict[str, Column]:
    """Centred sums of products of each two columns, by the name of both."""
    return {f"{a}_{b}": F.covar_pop(a, b) * F.count("*") for k, a in enumerate(names) for b in names[k:]}


def granger(panel: DataFrame, series: str = "r") -> DataFrame:
    """(symbol, n, f, pvalue): does the last signal help to predict the next return beyond the last return?"""
    d = in_chunks(panel, lambda d, w: d.withColumns({"_a": F.lag(series).over(w), "_b": F.lag("s").over(w)}), 1)
    d = d.where(f"{series} is not null and _a is not null and _b is not null").withColumn("_y", F.col(series))
    g = d.groupBy("symbol").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in _sums("_y", "_a", "_b").items()])
    yy, ya, yb, aa, ab, bb = (F.col(f"_{x}__{y}") for x, y in ("yy", "ya", "yb", "aa", "ab", "bb"))
    det = aa * bb - ab * ab
    short = yy - ya * ya / aa
    full = yy - (ya * (ya * bb - yb * ab) + yb * (yb * aa - ya * ab)) / det
    g = g.withColumn("f", (short - full) / (full / (F.col("n") - 3)))
    return g.select("symbol", "n", "f", tail_probability(F.col("f")).alias("pvalue"))


def chow_break(panel: DataFrame) -> DataFrame:
    """(symbol, f, pvalue): is the mean signal of the first half of the rows other than that of the second?"""
    last = panel.groupBy("symbol").agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    d = panel.join(F.broadcast(last), "symbol").withColumn("_first", 2 * F.col("i") <= F.col("_lo") + F.col("_hi"))
    h = d.groupBy("symbol", "_first").agg(F.count("*").alias("n"), F.sum("s").alias("t"), (F.var_pop("s") * F.count("*")).alias("sse"), F.sum(F.col("s") * F.col("s")).alias("tt"))
    g = h.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), (F.sum("tt") - F.sum("t") * F.sum("t") / F.sum("n")).alias("all"))
    f = (F.col("all") - F.col("sse")) / (F.col("sse") / (F.col("n") - 2))
    return g.withColumn("f", f).select("symbol", "f", tail_probability(F.col("f")).alias("pvalue"))


def factor_model(panel: DataFrame, factors: list[str]) -> DataFrame:
    """By symbol: factor_model_r2 of s on the factor columns, residual_ic_after_factors,
    partial_corr_with_returns_controlling_factors and vif_signal. Covariances are Spark's; one row a symbol is solved."""
    names = ["s", "rf", *factors]
    d = panel.dropna(subset=names).groupBy("symbol").agg(*[F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])

    def solve(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                c = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
                b, e = (np.linalg.lstsq(c[2:, 2:], c[2:, k], rcond=None)[0] for k in (0, 1))
                vs, vr = c[0, 0] - b @ c[2:, 0], c[1, 1] - e @ c[2:, 1]
                both = c[0, 1] - b @ c[2:, 1]
                r2 = 1 - vs / c[0, 0]
                out.append((row["symbol"], r2, both / math.sqrt(vs * c[1, 1]), both / math.sqrt(vs * vr), 1 / (1 - r2)))
            yield pd.DataFrame(out, columns=["symbol", "factor_model_r2", "residual_ic_after_factors", "partial_corr_with_returns_controlling_factors", "vif_signal"])

    return d.mapInPandas(solve, "symbol string, factor_model_r2 double, residual_ic_after_factors double, partial_corr_with_returns_controlling_factors double, vif_signal double")


def principal_component(pnl: DataFrame) -> DataFrame:
    """(alpha_id, pca_loading_on_first_component, pca_explained_variance_share) from daily pnl (alpha_id, trade_date, p). Alphas meet by
    day; the square of their number is all that the eigenvectors need."""
    a, b = (pnl.select(F.col("alpha_id").alias(n), "trade_date", F.col("p").alias(f"p{n}")) for n in "ab")
    cov = a.join(b, "trade_date").groupBy("a", "b").agg(F.covar_samp("pa", "pb").alias("c"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        m = f.pivot(index="a", columns="b", values="c").fillna(0.0).sort_index().sort_index(axis=1)
        value, vector = np.linalg.eigh(m.to_numpy())
        v = vector[:, -1] * np.sign(vector[np.abs(vector[:, -1]).argmax(), -1])
        return pd.DataFrame({"alpha_id": m.index, "pca_loading_on_first_component": v, "pca_explained_variance_share": value[-1] / value.sum()})

    return cov.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "alpha_id string, pca_loading_on_first_component double, pca_explained_variance_share double")


def uniform(rep: Column, key: Column) -> Column:
    """A number in [0, 1) that follows from the replicate and the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", rep.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(rep: Column, key: Column) -> Column:
    u = uniform(rep, key)
    return sum(F.when(u >= c, 1).otherwise(0) for c in POISSON)


def weighted_corr(x: str, y: str, w: str) -> Column:
    wx, wy, n = F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y)), F.sum(w)
    xx, yy, xy = (F.sum(F.col(w) * F.col(a) * F.col(b)) for a, b in ((x, x), (y, y), (x, y)))
    return (xy - wx * wy / n) / F.sqrt((xx - wx * wx / n) * (yy - wy * wy / n))


def replicates(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))


def shuffle_ic_pvalue(panel: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, ic, mc_shuffle_ic_pvalue): the share of permutations (within each day) whose IC is as large; NaN and 1 where s or rf does not vary.

    A permutation puts a day's rf in the order of md5 of replicate and trade id. A task takes a symbol-day for all replicates, with one
    of them at a time in memory, and gives one row of sums; so rows are not repeated, and those of a symbol are added up in the order of days.
    """

    def orders(ids: pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The rows as they are, then by the digests of each replicate."""
        yield np.arange(len(ids))
        for rep in range(1, n + 1):
            start, words = f"{rep}:".encode(), np.empty((len(ids), 2), np.uint64)
            for k in range(0, len(ids), DIGESTS):
                some = ids.slice(k, DIGESTS).to_pylist()
                words[k : k + len(some)] = np.frombuffer(b"".join([hashlib.md5(start + x, usedforsecurity=False).digest() for x in some]), ">u8").reshape(-1, 2)
            yield np.lexsort((words[:, 1], words[:, 0]))

    def day(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("trade_id", "ascending")], null_placement="at_start"))
        x, y = (t[c].to_numpy() for c in ("s", "rf"))
        first = {"m_s": x[0], "m_rf": y[0]}
        x, y = x - x[0], y - y[0]
        means = {"m_s": x.mean(), "m_rf": y.mean()}
        x, y = x - means["m_s"], y - means["m_rf"]
        cross = [float((x * y[o]).sum()) for o in orders(t["_id"].cast(pa.binary()))]
        row = {"symbol": t["symbol"][0], "trade_date": t["trade_date"][0], "n": len(t), **{k: float(first[k] + m) for k, m in means.items()}, "ss": float((x * x).sum()), "rr": float((y * y).sum()), "cross": cross}
        return pa.table({k: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v]) for k, v in row.items()})

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("trade_date")
        k, a, b, ss, rr = (t[c].to_numpy() for c in ("n", "m_s", "m_rf", "ss", "rr"))
        a, b = ((m - m[0]) - (k * (m - m[0])).sum() / k.sum() for m in (a, b))
        c = np.array(t["cross"].to_pylist()).sum(0) + (k * a * b).sum()
        scale = math.sqrt((ss.sum() + (k * a * a).sum()) * (rr.sum() + (k * b * b).sum()))
        ic, p = (c[0] / scale, (int((np.abs(c[1:]) >= abs(c[0])).sum()) + 1) / (n + 1)) if scale > 0 else (math.nan, 1.0)
        return pa.table({"symbol": pa.array([t["symbol"][0].as_py()]), "ic": pa.array([ic]), "mc_shuffle_ic_pvalue": pa.array([p])})

    rows = panel.where("symbol is not null and trade_date is not null and s is not null and rf is not null")
    rows = rows.select("symbol", "trade_date", "trade_id", F.coalesce(F.col("trade_id").cast("string"), F.lit("")).alias("_id"), F.col("s").cast("double"), F.col("rf").cast("double"))
    days = rows.groupBy("symbol", "trade_date").applyInArrow(day, "symbol string, trade_date date, n long, m_s double, m_rf double, ss double, rr double, cross array<double>")
    return days.groupBy("symbol").applyInArrow(whole, "symbol string, ic double, mc_shuffle_ic_pvalue double")


def bootstrap_ic(panel: DataFrame, n: int = 50) -> DataFrame:
    """(symbol, ic_low, ic_high): 95 % interval of the IC over Poisson resamples of the rows; summed up before any shuffle."""
    d = replicates(panel.select("symbol", "trade_id", "s", "rf"), n).withColumn("w", poisson_weight(F.col("rep"), F.col("trade_id")))
    d = d.groupBy("symbol", "rep").agg(weighted_corr("s", "rf", "w").alias("ic"))
    return d.groupBy("symbol").agg(F.percentile("ic", 0.025).alias("ic_low"), F.percentile("ic", 0.975).alias("ic_high"))


def daily_pnl(panel: DataFrame) -> DataFrame:
    """(symbol, trade_date, p): basis points a day of following the signal's sign."""
    return panel.groupBy("symbol", "trade_date").agg((F.sum(F.signum("s") * F.col("rf")) * 1e4).alias("p"))


def bootstrap_sharpe(pnl: DataFrame, n: int = 50, periods: float = 365.0) -> DataFrame:
    d = replicates(pnl, n).withColumn("w", poisson_weight(F.col("rep"), F.datediff("trade_date", F.lit("1970-01-01"))))
    m = F.sum(F.col("w") * F.col("p")) / F.sum("w")
    sd = F.sqrt(F.sum(F.col("w") * F.col("p") * F.col("p")) / F.sum("w") - m * m)
    d = d.groupBy("symbol", "rep").agg((m / sd * math.sqrt(periods)).alias("sharpe"))
    return d.groupBy("symbol").agg(F.percentile("sharpe", 0.025).alias("sharpe_low"), F.percentile("sharpe", 0.975).alias("sharpe_high"))


def probability_of_ruin(pnl: DataFrame, loss: float, n: int = 50) -> DataFrame:
    """(symbol, probability_of_ruin): the share of resampled paths that fall below -loss."""
    d = replicates(pnl, n).withColumn("w", poisson_weight(F.col("rep"), F.datediff("trade_date", F.lit("1970-01-01"))))
    run = Window.partitionBy("symbol", "rep").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("path", F.sum(F.col("w") * F.col("p")).over(run)).groupBy("symbol", "rep").agg((F.min("path") < -loss).cast("double").alias("ruined"))
    return d.groupBy("symbol").agg(F.avg("ruined").alias("probability_of_ruin"))


def sharpe_moments(pnl: DataFrame) -> DataFrame:
    """(symbol, n, sharpe, skew, kurt) of the periods' pnl; not annualised, kurt 3 for a normal variable."""
    return pnl.groupBy("symbol").agg(F.count("*").alias("n"), (F.avg("p") / F.stddev_samp("p")).alias("sharpe"), F.skewness("p").alias("skew"), (F.kurtosis("p") + 3).alias("kurt"))


def track_record(pnl: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(symbol, minimum_track_record_length): periods after which a Sharpe ratio like this one is above 0 with that confidence; null if it is not."""
    z = NormalDist().inv_cdf(confidence)
    sr = F.col("sharpe")
    spread = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    return sharpe_moments(pnl).select("symbol", F.when(sr > 0, 1 + spread * F.pow(z / sr, F.lit(2))).alias("minimum_track_record_length"))


def deflated_sharpe(pnl: DataFrame, trials: int, trial_variance: float) -> DataFrame:
    """(symbol, deflated_sharpe): the probability that the Sharpe ratio is above what the best of so many trials would show by chance."""
    normal, gamma = NormalDist(), 0.5772156649015329
    best = math.sqrt(trial_variance) * ((1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e)))

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: normal.cdf(v) if v == v else None)

    sr = F.col("sharpe")
    z = (sr - best) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr)
    return sharpe_moments(pnl).select("symbol", cdf(z).alias("deflated_sharpe"))


def neighbourhood(results: DataFrame) -> DataFrame:
    """Of sweep results (param_id in grid order, symbol, net_pnl_bps), by symbol: num_tried_params, num_significant_params (|t| > 1.96) and
    param_neighborhood_stability_score, the mean over parameters of the worse neighbour's mean pnl less the own, over the own deviation."""
    g = results.groupBy("symbol", "param_id").agg(F.count("*").alias("n"), F.avg("net_pnl_bps").alias("m"), F.stddev_samp("net_pnl_bps").alias("sd"))
    w = Window.partitionBy("symbol").orderBy("param_id")
    near = F.least(F.lag("m").over(w), F.lead("m").over(w))
    g = g.withColumns({"near": near, "t": F.abs(F.col("m")) * F.sqrt("n") / F.col("sd")})
    return g.groupBy("symbol").agg(F.count("*").alias("num_tried_params"), F.count_if(F.col("t") > 1.96).alias("num_significant_params"), F.avg((F.col("near") - F.col("m")) / F.col("sd")).alias("param_neighborhood_stability_score"))


def holding(sim: DataFrame) -> DataFrame:
    """By symbol, of trades with bar numbers: how long positions are held."""
    bars, days = (F.col("exit_bar") - F.col("entry_bar")).cast("double"), (F.col("exit_ts") - F.col("entry_ts")) / 86_400_000.0
    day = lambda c: F.to_date(F.timestamp_millis(c))
    return sim.groupBy("symbol").agg(F.avg(bars).alias("avg_holding_period_bars"), F.avg(days).alias("avg_holding_period_days"), F.avg((bars == 0).cast("double")).alias("pct_trades_closed_same_bar"), F.percentile(bars, 0.5).alias("median_trade_holding_time_bars"), F.avg((day(F.col("entry_ts")) < day(F.col("exit_ts"))).cast("double")).alias("pct_overnight_trades"))


def trade_patterns(sim: DataFrame, bars: DataFrame, cost: float = 5.0, sl: float = -15.0, flat: float = 0.5, gap: float = 5.0) -> DataFrame:
    """By symbol: expectancy, trades a symbol and day, and the shares of flat trades (|pnl| < flat), stop-outs (before cost below sl) and
    entries on a bar that opens ``gap`` basis points from the last close."""
    w = Window.partitionBy("symbol", "shard_id").orderBy("trade_date", "bar_no")
    opened = bars.select("symbol", "shard_id", (F.row_number().over(w) - 1).alias("entry_bar"), (F.abs(F.col("open") / F.lag("close").over(w) - 1) * 1e4 > gap).alias("_gap"))
    d = sim.join(opened, ["symbol", "shard_id", "entry_bar"]).withColumn("_day", F.to_date(F.timestamp_millis("entry_ts")))
    p, share = F.col("net_pnl_bps"), lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    per = d.groupBy("symbol", "_day").agg(F.count("*").alias("n"), F.sum(p).alias("p"), *[F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(k) for k, c in (("flat", F.abs(p) < flat), ("stop", p + cost < sl), ("gap", F.col("_gap")))])
    return per.groupBy("symbol").agg((F.sum("p") / F.sum("n")).alias("expectancy_bps_per_trade"), F.avg("n").alias("trades_per_symbol_per_day"), *[(F.sum(k) / F.sum("n")).alias(n) for k, n in (("flat", "pct_round_trips_flat_pnl"), ("stop", "pct_stop_out_trades"), ("gap", "pct_gap_open_trades"))])


def kendall_tau(panel: DataFrame) -> DataFrame:
    """(symbol, trade_date, ic_kendall_tau): concordant less discordant pairs over all pairs, ties as neither; by sorting and
    merging, so that no pairs are made."""

    def inversions(x: np.ndarray) -> int:
        """Pairs i < j with x[i] > x[j], by doubling merges."""
        total, width, n = 0, 1, len(x)
        x = x.copy()
        while width < n:
            for lo in range(0, n - width, 2 * width):
                a, b = x[lo : lo + width], x[lo + width : lo + 2 * width]
                total += int(len(a) * len(b) - np.searchsorted(a, b, "right").sum())
                x[lo : lo + 2 * width] = np.sort(x[lo : lo + 2 * width], kind="stable")
            width *= 2
        return total

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["s", "rf"], kind="stable")
        n = len(f)
        pairs = n * (n - 1) // 2
        tied = lambda *c: int(sum(k * (k - 1) // 2 for k in f.groupby(list(c)).size()))
        bad = inversions(f["rf"].to_numpy())
        good = pairs - bad - tied("s") - tied("rf") + tied("s", "rf")
        return pd.DataFrame({"symbol": [f["symbol"].iat[0]], "trade_date": [f["trade_date"].iat[0]], "ic_kendall_tau": [(good - bad) / pairs if pairs else None]})

    return panel.select("symbol", "trade_date", "s", "rf").groupBy("symbol", "trade_date").applyInPandas(run, "symbol string, trade_date date, ic_kendall_tau double")


def complexity(panel: DataFrame, bins: int = 2) -> DataFrame:
    """By symbol and day: higuchi_fractal_dimension_signal, lempel_ziv_complexity_signal (of the sign about the median, over n / log2 n)
    and spectral_density_peak_freq (cycles a row) of the whole day's signal."""

    def higuchi(x: np.ndarray, most: int = 8) -> float:
        lengths = []
        for k in range(1, most + 1):
            parts = [np.abs(np.diff(x[m::k])).sum() * (len(x) - 1) / (((len(x) - 1 - m) // k) * k) / k for m in range(k) if (len(x) - 1 - m) // k > 0]
            lengths.append(np.mean(parts))
        good = np.array(lengths) > 0
        return float(-np.polyfit(np.log(np.arange(1, most + 1)[good]), np.log(np.array(lengths)[good]), 1)[0]) if good.sum() > 1 else float("nan")

    def phrases(bits: np.ndarray) -> int:
        """Lempel-Ziv 1978 phrases: each one is new, one symbol longer than an old one. They are nodes of a tree, 0 the empty one."""
        tree, node = {}, 0
        for bit in bits.tolist():
            step = 2 * node + bit
            node = tree.get(step, 0)
            if not node:
                tree[step] = len(tree) + 1
        return len(tree) + bool(node)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("i", kind="stable")["s"].to_numpy()
        n = len(x)
        bits = x > np.median(x)
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2
        out = (higuchi(x), phrases(bits) / (n / math.log2(n)), (1 + int(power[1:].argmax())) / n) if n > 16 else (None, None, None)
        names = ["higuchi_fractal_dimension_signal", "lempel_ziv_complexity_signal", "spectral_density_peak_freq"]
        return pd.DataFrame([(f["symbol"].iat[0], f["trade_date"].iat[0], *out)], columns=["symbol", "trade_date", *names])

    return panel.select("symbol", "trade_date", "i", "s").groupBy("symbol", "trade_date").applyInPandas(run, "symbol string, trade_date date, higuchi_fractal_dimension_signal double, lempel_ziv_complexity_signal double, spectral_density_peak_freq double")
