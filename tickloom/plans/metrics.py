"""Queries of the catalogue operators and their oracles, each in SQL of its own."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import catalogue as C
from tickloom.operators import primitives as P
from tickloom.sources.tape import tape

from .kernels import BASE, features, rounded
from .oracles import GRID, ONE, sims

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PANEL = f"""{BASE},
g AS (SELECT *, CASE WHEN count(*) OVER w = 8 THEN CAST(sum(qty * sign) OVER w AS DOUBLE) / 8e8 END AS s, lead(x, 4) OVER (PARTITION BY symbol ORDER BY i) - x AS rf FROM f WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
sig AS (SELECT * FROM g WHERE s IS NOT NULL AND rf IS NOT NULL),
pnl AS (SELECT symbol, trade_date, sum(sign(s) * rf) * 1e4 AS p FROM sig GROUP BY 1, 2)"""
_HEX = "('0x' || substr(md5(rep::VARCHAR || ':' || {k}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_DRAW = "(" + " + ".join(f"CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in C.POISSON) + ")"


def panel(spark, sf_dir: str):
    return C.signal_panel(features(spark, sf_dir))


def query(name: str, sql: str | None, source=panel, digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda s, d: rounded(f(source(s, d)), digits)
        if sql:
            ORACLES[name] = sql.replace("round(", "0e0 + round(").replace("0e0 + round((1000", "round((1000")
        return f

    return keep


def _panel(sql: str) -> str:
    return f"WITH {PANEL} {sql}" if sql.startswith("SELECT") else f"WITH {PANEL}, {sql}"


query("ts4_granger", _panel("""l AS (SELECT symbol, r AS y, lag(r) OVER w AS a, lag(s) OVER w AS b FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY i)),
  c AS (SELECT symbol, count(*) AS n, regr_syy(y, a) AS yy, regr_sxx(y, a) AS aa, regr_sxx(y, b) AS bb, regr_sxy(y, a) AS ya, regr_sxy(y, b) AS yb, regr_sxy(a, b) AS ab FROM l WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
  e AS (SELECT *, yy - ya * ya / aa AS short, yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab) AS full_ FROM c) SELECT symbol, n, round((short - full_) / (full_ / (n - 3)), 4) AS f FROM e"""), digits=4)(lambda d: C.granger(d).drop("pvalue"))
query("sd8_chow_break", _panel("""h AS (SELECT symbol, s, 2 * i <= min(i) OVER (PARTITION BY symbol) + max(i) OVER (PARTITION BY symbol) AS one FROM sig),
  e AS (SELECT symbol, count(*) AS n, var_pop(s) * count(*) AS whole FROM sig GROUP BY 1), k AS (SELECT symbol, sum(v) AS parts FROM (SELECT symbol, var_pop(s) * count(*) AS v FROM h GROUP BY symbol, one) GROUP BY 1) SELECT symbol, round((whole - parts) / (parts / (n - 2)), 4) AS f FROM e JOIN k USING (symbol)"""), digits=4)(lambda d: C.chow_break(d).drop("pvalue"))
query("or2_factor_model", _panel("""day AS (SELECT trade_date, avg(r) * 1e4 AS market, ln(sum(q)) AS volume FROM f GROUP BY 1), j AS (SELECT symbol, s, rf, market AS a, volume AS b FROM sig JOIN day USING (trade_date)),
  c AS (SELECT symbol, var_pop(s) AS ss, var_pop(rf) AS rr, covar_pop(s, rf) AS sr, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(s, a) AS sa, covar_pop(s, b) AS sb, covar_pop(rf, a) AS ra, covar_pop(rf, b) AS rb FROM j GROUP BY 1),
  e AS (SELECT *, aa * bb - ab * ab AS d FROM c), m AS (SELECT *, (sa * bb - sb * ab) / d AS b1, (sb * aa - sa * ab) / d AS b2, (ra * bb - rb * ab) / d AS c1, (rb * aa - ra * ab) / d AS c2 FROM e),
  z AS (SELECT *, ss - b1 * sa - b2 * sb AS vs, rr - c1 * ra - c2 * rb AS vr, sr - b1 * ra - b2 * rb AS bo FROM m)
  SELECT symbol, round(1 - vs / ss, 6) AS factor_model_r2, round(bo / sqrt(vs * rr), 6) AS residual_ic_after_factors, round(bo / sqrt(vs * vr), 6) AS partial_corr_with_returns_controlling_factors, round(ss / vs, 6) AS vif_signal FROM z"""), features)(
    lambda t: C.factor_model(C.signal_panel(t).join(_factors(t), "trade_date"), ["market", "volume"]))
query("rb3_shuffle_pvalue", _panel("""r AS (SELECT symbol, trade_date, trade_id, s, rf, unnest(range(1, 21)) AS rep FROM sig), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, rep ORDER BY trade_id) AS a, row_number() OVER (PARTITION BY symbol, trade_date, rep ORDER BY md5(rep::VARCHAR || ':' || trade_id::VARCHAR)) AS b FROM r),
  t AS (SELECT x.symbol, x.rep, corr(x.s, y.rf) AS c FROM o x JOIN o y ON x.symbol = y.symbol AND x.trade_date = y.trade_date AND x.rep = y.rep AND x.a = y.b GROUP BY 1, 2), k AS (SELECT symbol, corr(s, rf) AS ic FROM sig GROUP BY 1)
  SELECT symbol, round(any_value(ic), 6) AS ic, round((count(*) FILTER (abs(c) >= abs(ic)) + 1) / (count(*) + 1.0), 6) AS mc_shuffle_ic_pvalue FROM t JOIN k USING (symbol) GROUP BY symbol"""))(C.shuffle_ic_pvalue)
query("rb4_bootstrap_ic", _panel(f"""r AS (SELECT symbol, trade_id, s, rf, unnest(range(1, 51)) AS rep FROM sig), d AS (SELECT *, {_HEX.format(k='trade_id')} AS u FROM r), w AS (SELECT symbol, rep, s, rf, {_DRAW} AS w FROM d),
  c AS (SELECT symbol, rep, (sum(w * s * rf) - sum(w * s) * sum(w * rf) / sum(w)) / sqrt((sum(w * s * s) - sum(w * s) * sum(w * s) / sum(w)) * (sum(w * rf * rf) - sum(w * rf) * sum(w * rf) / sum(w))) AS ic FROM w GROUP BY 1, 2)
  SELECT symbol, round(quantile_cont(ic, 0.025), 6) AS ic_low, round(quantile_cont(ic, 0.975), 6) AS ic_high FROM c GROUP BY 1"""))(C.bootstrap_ic)
_PATHS = f"r AS (SELECT *, unnest(range(1, 51)) AS rep FROM pnl), d AS (SELECT *, {_HEX.format(k='(trade_date - DATE ' + chr(39) + '1970-01-01' + chr(39) + ')')} AS u FROM r), w AS (SELECT *, {_DRAW} AS w FROM d)"
query("rb4_bootstrap_sharpe", _panel(f"{_PATHS}, c AS (SELECT symbol, rep, sum(w * p) / sum(w) AS m, sum(w * p * p) / sum(w) AS q FROM w GROUP BY 1, 2), h AS (SELECT symbol, m / sqrt(q - m * m) * sqrt(365) AS k FROM c) SELECT symbol, round(quantile_cont(k, 0.025), 6) AS sharpe_low, round(quantile_cont(k, 0.975), 6) AS sharpe_high FROM h GROUP BY 1"))(lambda d: C.bootstrap_sharpe(C.daily_pnl(d)))
query("rt5_probability_of_ruin", _panel(f"{_PATHS}, c AS (SELECT symbol, rep, sum(w * p) OVER (PARTITION BY symbol, rep ORDER BY trade_date) AS path FROM w), e AS (SELECT symbol, rep, min(path) < -2000 AS ruined FROM c GROUP BY 1, 2) SELECT symbol, round(avg(ruined::INTEGER), 6) AS probability_of_ruin FROM e GROUP BY 1"))(lambda d: C.probability_of_ruin(C.daily_pnl(d), 2000.0))
query("rb6_track_record", _panel("""m AS (SELECT symbol, avg(p) / stddev_samp(p) AS sr, avg(pow(p, 3)) - 3 * avg(p) * avg(p * p) + 2 * pow(avg(p), 3) AS m3, avg(pow(p, 4)) - 4 * avg(p) * avg(pow(p, 3)) + 6 * avg(p) * avg(p) * avg(p * p) - 3 * pow(avg(p), 4) AS m4, var_pop(p) AS v FROM pnl GROUP BY 1)
  SELECT symbol, round(CASE WHEN sr > 0 THEN 1 + (1 - m3 / pow(v, 1.5) * sr + (m4 / (v * v) - 1) / 4 * sr * sr) * pow(1.6448536269514722 / sr, 2) END, 4) AS minimum_track_record_length FROM m"""), digits=4)(lambda d: C.track_record(C.daily_pnl(d)))
_BEST = math.sqrt(0.01) * ((1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / 20) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (20 * math.e)))
#: The normal distribution by Simpson's rule over 2,000 steps from 0 to z.
query("rb6_deflated_sharpe", _panel(f"""m AS (SELECT symbol, count(*) AS n, avg(p) / stddev_samp(p) AS sr, (avg(pow(p, 3)) - 3 * avg(p) * avg(p * p) + 2 * pow(avg(p), 3)) / pow(var_pop(p), 1.5) AS sk, (avg(pow(p, 4)) - 4 * avg(p) * avg(pow(p, 3)) + 6 * avg(p) * avg(p) * avg(p * p) - 3 * pow(avg(p), 4)) / pow(var_pop(p), 2) AS ku FROM pnl GROUP BY 1),
  z AS (SELECT symbol, (sr - {_BEST!r}::DOUBLE) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM m), i AS (SELECT symbol, z, unnest(range(0, 2001)) AS k FROM z)
  SELECT symbol, round(0.5::DOUBLE + sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * k / 2000, 2) / 2)) * any_value(z) / 6000 / sqrt(2 * pi()), 6) AS deflated_sharpe FROM i GROUP BY symbol"""))(lambda d: C.deflated_sharpe(C.daily_pnl(d), 20, 0.01))
#: The first eigenvector by 2,000 rounds of power iteration.
query("bk4_principal_component", _panel("""cov AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.p, b.p) AS c FROM pnl a JOIN pnl b USING (trade_date) GROUP BY 1, 2), mat AS (SELECT list(r ORDER BY a) AS m, list(a ORDER BY a) AS names FROM (SELECT a, list(c ORDER BY b) AS r FROM cov GROUP BY a)),
  it AS (SELECT 0 AS k, list_transform(range(1, len(m) + 1), lambda i: 1.0::DOUBLE / i) AS v FROM mat UNION ALL SELECT k + 1, list_transform(u, lambda y: y / sqrt(list_dot_product(u, u))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM it, mat WHERE k < 2000) w),
  e AS (SELECT names, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS top, (SELECT sum(c) FROM cov WHERE a = b) AS whole FROM it, mat WHERE k = 2000),
  l AS (SELECT unnest(names) AS alpha_id, unnest(v) AS x, list_sum(list_filter(v, lambda y: abs(y) = list_max(list_transform(v, lambda w: abs(w))))) AS big, top / whole AS share FROM e)
  SELECT alpha_id, round(x * sign(big), 6) AS pca_loading_on_first_component, round(share, 6) AS pca_explained_variance_share FROM l""").replace("WITH ", "WITH RECURSIVE ", 1))(lambda d: C.principal_component(C.daily_pnl(d).withColumnRenamed("symbol", "alpha_id")))
query("pp2_kendall_tau", _panel("SELECT a.symbol, a.trade_date, round(sum(sign(a.s - b.s) * sign(a.rf - b.rf)) / count(*), 6) AS ic_kendall_tau FROM sig a JOIN sig b ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND a.i < b.i GROUP BY 1, 2"))(lambda d: C.kendall_tau(d).where("ic_kendall_tau is not null"))
query("sd6_complexity", None)(C.complexity)
query("tc4_capacity", f"""WITH {PANEL}, day AS (SELECT symbol, trade_date, sum(q) AS dq FROM f GROUP BY 1, 2), j AS (SELECT sig.*, q / dq AS part FROM sig JOIN day USING (symbol, trade_date)),
  bl AS (SELECT symbol, (i - 1) // 20 AS b, min_by(x, i) AS x0, sum(q) AS bq FROM f GROUP BY 1, 2), b2 AS (SELECT *, lead(x0) OVER (PARTITION BY symbol ORDER BY b) - x0 AS dp FROM bl), im AS (SELECT symbol, regr_slope(ln(abs(dp)), ln(bq)) AS k FROM b2 WHERE dp <> 0 GROUP BY 1)
  SELECT symbol, round(regr_slope(sign(s) * rf * 1e4, part), 4) AS capacity_curve_slope, round(corr(abs(s), q), 4) AS capacity_crowding_indicator, round(any_value(k), 4) AS impact_concavity_cost FROM j JOIN im USING (symbol) GROUP BY symbol""", features, 4)(lambda t: _capacity(t))


def _factors(t):
    """Market return and volume of each day, over all symbols."""
    return t.groupBy("trade_date").agg((F.avg("r") * 1e4).alias("market"), F.log(F.sum("q")).alias("volume"))


def _capacity(t):
    day = t.groupBy("symbol", "trade_date").agg(F.sum("q").alias("dq"))
    d = C.signal_panel(t).join(day, ["symbol", "trade_date"])
    im = P.blocks(t, 20).where("dp <> 0").groupBy("symbol").agg(F.regr_slope(F.log(F.abs("dp")), F.log("qty")).alias("impact_concavity_cost"))
    g = d.groupBy("symbol").agg(F.regr_slope(F.signum("s") * F.col("rf") * 1e4, F.col("q") / F.col("dq")).alias("capacity_curve_slope"), F.corr(F.abs("s"), F.col("q")).alias("capacity_crowding_indicator"))
    return g.join(im, "symbol")


# simulated trades
def _bars(spark, sf_dir: str):
    return B.assign_shards(B.delta_bars(tape(spark, sf_dir), 1.0), 4)


_TRADES = f"""WITH RECURSIVE {sims(ONE)}, zz AS (SELECT *, lag(z.close) OVER (PARTITION BY symbol, shard_id ORDER BY rn) AS before FROM z),
nb AS (SELECT s.*, a.rn AS a, b.rn AS b, bars.open, a.before, bars.trade_date FROM sim s JOIN zz a ON a.symbol = s.symbol AND a.shard_id = s.shard_id AND a.ts_end = s.entry_ts AND a.signal = s.side AND a.eff = s.k1 AND a.impact = s.k3 JOIN z b ON b.symbol = s.symbol AND b.shard_id = s.shard_id AND b.ts_end = s.exit_ts JOIN bars ON bars.symbol = s.symbol AND bars.ts_end = s.entry_ts AND bars.close = a.close AND bars.eff = a.eff)"""
query("tc1_holding", f"{_TRADES} SELECT symbol, round(avg(b - a), 6) AS avg_holding_period_bars, round(avg((exit_ts - entry_ts) / 86400000.0::DOUBLE), 6) AS avg_holding_period_days, round(avg((a = b)::INTEGER), 6) AS pct_trades_closed_same_bar, round(quantile_cont(CAST(b - a AS DOUBLE), 0.5), 6) AS median_trade_holding_time_bars, round(avg((entry_ts // 86400000 < exit_ts // 86400000)::INTEGER), 6) AS pct_overnight_trades FROM nb GROUP BY symbol", _bars)(lambda b: C.holding(B.backtest(b, bar_numbers=True)))
query("tl1_tl2_trade_patterns", f"""{_TRADES}, per AS (SELECT symbol, count(*) * 1.0 / count(DISTINCT entry_ts // 86400000) AS per_day FROM nb GROUP BY 1) SELECT symbol, round(avg(net_pnl_bps), 6) AS expectancy_bps_per_trade, round(any_value(per_day), 6) AS trades_per_symbol_per_day, round(avg((abs(net_pnl_bps) < 0.5)::INTEGER), 6) AS pct_round_trips_flat_pnl,
  round(avg((net_pnl_bps + 5 < -15)::INTEGER), 6) AS pct_stop_out_trades, round(avg(coalesce((abs(open / before - 1) * 1e4 > 5)::INTEGER, 0)), 6) AS pct_gap_open_trades FROM nb JOIN per USING (symbol) GROUP BY symbol""", _bars)(lambda b: C.trade_patterns(B.backtest(b, bar_numbers=True), b))
query("udf2_time_stop", f"WITH RECURSIVE {sims(ONE).replace('(roi > tp OR roi < sl)', '(roi > tp OR roi < sl OR rn - ern >= 3)').replace('pos, e, ets, ek1', 'pos, e, ets, ern, ek1').replace('signal, close, ts_end, eff, impact, 0', 'signal, close, ts_end, rn, eff, impact, 0').replace('CASE WHEN kept <> 0 THEN ets ELSE ts_end END,', 'CASE WHEN kept <> 0 THEN ets ELSE ts_end END, CASE WHEN kept <> 0 THEN ern ELSE rn END,').replace('st.ets, st.ek1', 'st.ets, st.ern, st.ek1')} SELECT symbol, shard_id, seq, entry_ts, exit_ts, round(net_pnl_bps, 6) AS net_pnl_bps, side, round(k1, 6) AS k1, round(k3, 6) AS k3 FROM sim", _bars)(
    lambda b: B.backtest(b, leave=lambda roi, held: (roi > 40.0) | (roi < -15.0) | (held >= 3)))
_grid = lambda b: b.sparkSession.createDataFrame([(1, 36.0, -13.5, 5.0), (2, 40.0, -15.0, 5.0), (3, 44.0, -16.5, 5.0)], "param_id int, tp double, sl double, cost double")
query("rb7_neighbourhood", f"""WITH RECURSIVE {sims(GRID)}, g AS (SELECT symbol, param_id, count(*) AS n, avg(net_pnl_bps) AS m, stddev_samp(net_pnl_bps) AS sd FROM sim GROUP BY 1, 2), h AS (SELECT *, least(lag(m) OVER w, lead(m) OVER w) AS near FROM g WINDOW w AS (PARTITION BY symbol ORDER BY param_id))
  SELECT symbol, count(*) AS num_tried_params, count(*) FILTER (abs(m) * sqrt(n) / sd > 1.96) AS num_significant_params, round(avg((near - m) / sd), 6) AS param_neighborhood_stability_score FROM h GROUP BY symbol""", _bars)(lambda b: C.neighbourhood(B.sweep(b, _grid(b))))
query("tc4_turnover_elasticity", f"WITH RECURSIVE {sims(GRID)}, g AS (SELECT symbol, param_id, count(*) AS n, sum(net_pnl_bps) AS p FROM sim GROUP BY 1, 2) SELECT symbol, round(regr_slope(p, n), 4) AS turnover_elasticity_of_performance FROM g GROUP BY symbol", _bars, 4)(
    lambda b: B.sweep(b, _grid(b)).groupBy("symbol", "param_id").agg(F.count("*").alias("n"), F.sum("net_pnl_bps").alias("p")).groupBy("symbol").agg(F.regr_slope("p", "n").alias("turnover_elasticity_of_performance")))

_lags = lambda ks: "(" + " UNION ALL ".join(f"SELECT symbol, {k} AS lag, corr(s, y) AS rho FROM (SELECT symbol, s, lag(rf, {k}) OVER (PARTITION BY symbol ORDER BY i) AS y FROM sig) a{k + 9} GROUP BY symbol" for k in ks) + ")"
query("ts3_cross_corr_peak_lag", _panel(f"SELECT symbol, max_by(lag, rho)::INTEGER AS peak_lag, round(max(rho), 6) AS rho FROM {_lags(range(-4, 5))} GROUP BY symbol"))(
    lambda d: P.lagged_correlations(d, "s", "rf", list(range(-4, 5))).groupBy("symbol").agg(F.max_by("lag", "rho").alias("peak_lag"), F.max("rho").alias("rho")))
query("sd3_acf", _panel("SELECT symbol, k::INTEGER AS lag_rows, round(corr(s, y), 6) AS acf FROM (SELECT symbol, k, s, lag(s, k::INTEGER) OVER (PARTITION BY symbol, k ORDER BY i) AS y FROM sig, (SELECT unnest([1, 2, 4, 8]) AS k)) GROUP BY 1, 2"))(
    lambda d: P.lagged_correlations(d, "s", "s", [1, 2, 4, 8]).select("symbol", F.col("lag").alias("lag_rows"), F.col("rho").alias("acf")))
query("ms47_rough_vol_h", f"WITH {BASE}, v AS (SELECT symbol, i, ln(1e-6 + abs(r)) AS v FROM f), m AS (SELECT symbol, k, abs(v - lag(v, k::INTEGER) OVER (PARTITION BY symbol, k ORDER BY i)) AS y FROM v, (SELECT unnest([1, 2, 4, 8, 16]) AS k)), e AS (SELECT symbol, k, ln(avg(y * y)) AS l FROM m WHERE y > 0 GROUP BY 1, 2) SELECT symbol, round(regr_slope(l, ln(k)) / 2, 6) AS h FROM e GROUP BY symbol", features)(P.rough_volatility)
