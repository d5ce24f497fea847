"""The rest of the catalogue's columns, as plans of the same two dialects; and those that run on operators, with oracles of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import primitives as P
from tickloom.operators import ticks as T
from tickloom.sources.tape import tape

from . import metrics, oracles
from .panels import BOOK, DRAWN, ORDERS, TURNED
from .signals import D, DAILY, PANEL, PLANS, PNL, QUOTES, RANKS, REGIME, RS, by_symbol

share = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"

# data quality
PLANS["dq1_gaps"] = (lambda d: "SELECT count(DISTINCT symbol) AS n_symbols, count(*) AS n_symbol_days, round(avg(gap), 6) AS pct_days_with_data_gaps FROM (SELECT symbol, trade_date, max(CASE WHEN dt > 3600 THEN 1.0 ELSE 0.0 END) AS gap FROM panel GROUP BY 1, 2) g", PANEL)
by_symbol("dq2_missing_signal", pct_missing_signal=share("s IS NULL"), pct_missing_volume=share("qty IS NULL OR qty = 0"))
PLANS["dq3_signal_outliers"] = (lambda d: f"SELECT symbol, round({share('abs(s - m) > 3 * sd')}, 6) AS pct_signal_outliers FROM sig JOIN (SELECT symbol AS s2, avg(s) AS m, stddev_samp(s) AS sd FROM sig GROUP BY symbol) k ON symbol = s2 GROUP BY symbol", PANEL)
by_symbol("dq4_quote_faults", "quotes", needs=QUOTES, pct_bad_quotes=share("bid IS NULL OR ask IS NULL OR bid <= 0 OR ask <= 0"), pct_negative_spreads=share("ask < bid"), avg_depth_shares="avg((trade_id % 50 + 1 + trade_id % 37 + 1) / 2.0)")
_RV = lambda d, ms: f"(SELECT symbol, sqrt(sum(lr * lr)) AS v FROM (SELECT symbol, ln(c / lag(c) OVER (PARTITION BY symbol, trade_date ORDER BY g)) AS lr FROM (SELECT symbol, trade_date, {d.div('ts_ms', ms)} AS g, max_by(x, i) AS c FROM panel GROUP BY 1, 2, 3) a{ms}) b{ms} GROUP BY symbol)"
PLANS["dq5_realized_vol_1m_5m"] = (lambda d: f"SELECT a.symbol, round(a.v, 6) AS realized_vol_1m, round(b.v, 6) AS realized_vol_5m FROM {_RV(d, 60000)} a JOIN {_RV(d, 300000)} b ON a.symbol = b.symbol", PANEL)
# the signal
by_symbol("sd1_tails", "sig", signal_pct_5=lambda d: d.pct("s", 0.05), signal_pct_95=lambda d: d.pct("s", 0.95))
PLANS["sd1_mad"] = (lambda d: f"SELECT symbol, round({d.pct('abs(s - m)', 0.5)}, 6) AS signal_mad FROM sig JOIN (SELECT symbol AS s2, {d.pct('s', 0.5)} AS m FROM sig GROUP BY symbol) k ON symbol = s2 GROUP BY symbol", PANEL)
PLANS["sd3_decay"] = (lambda d: f"SELECT symbol, round(a, 6) AS pacf_lag1_signal, round(CASE WHEN a > 0 AND a < 1 THEN -1.0 / ln(a) END, 4) AS autocorr_decay_time_constant, round(p, 6) AS position_autocorr_lag1 FROM (SELECT symbol, corr(s, y) AS a, corr(CAST(sign(s) AS DOUBLE), CAST(sign(y) AS DOUBLE)) AS p FROM (SELECT symbol, s, lag(s) OVER ({D}) AS y FROM sig) z GROUP BY symbol) a", PANEL)
PLANS["sd4_hurst"] = (RS("s"), PANEL)
by_symbol("sd5_near_zero", "sig", pct_zero_nearzero_signal=share("abs(s) < 0.0015"))
PLANS["sd7_persistence"] = (lambda d: f"SELECT symbol, round(CAST(count(*) AS DOUBLE) / sum(CASE WHEN y IS NULL OR sign(s) <> sign(y) THEN 1 ELSE 0 END), 6) AS signal_state_persistence FROM (SELECT symbol, s, lag(s) OVER ({D}) AS y FROM sig) a GROUP BY symbol", PANEL)
# predictive power
_W = "(SELECT symbol, s, rf, exp(-0.05 * ({last} - {day})) AS w FROM sig JOIN (SELECT symbol AS s2, max({day}) AS {last} FROM sig GROUP BY symbol) k ON symbol = s2)"
PLANS["pp3_time_weighted"] = (lambda d: "SELECT symbol, round((sum(w * s * rf) - sum(w * s) * sum(w * rf) / sum(w)) / sqrt((sum(w * s * s) - sum(w * s) * sum(w * s) / sum(w)) * (sum(w * rf * rf) - sum(w * rf) * sum(w * rf) / sum(w))), 6) AS ic_time_weighted FROM " + _W.format(last="mx", day=d.day("trade_date")) + " a GROUP BY symbol", PANEL)
PLANS["pp4_ic_drawdown"] = (lambda d: "SELECT symbol, round(max(peak - eq), 6) AS max_ic_drawdown FROM (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS peak FROM (SELECT *, sum(ic) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM ic WHERE ic IS NOT NULL) a) b GROUP BY symbol", DAILY)
by_symbol("pp6_quintiles", "(SELECT *, ceil(dec / 2.0) AS q5 FROM rk) a", needs=RANKS, quintile_spread_q5_q1_bps="1e4 * (avg(CASE WHEN q5 = 5 THEN rf END) - avg(CASE WHEN q5 = 1 THEN rf END))", hit_rate_top_vs_bottom_diff="avg(CASE WHEN dec = 10 THEN CAST(up AS DOUBLE) END) - avg(CASE WHEN dec = 1 THEN CAST(up AS DOUBLE) END)")
by_symbol("pp12_brier", "rk", needs=RANKS, brier_score="avg(pow(1 / (1 + exp(-s)) - up, 2))")
PLANS["pp12_auc_pr"] = (lambda d: "SELECT symbol, trade_date, round(sum(CASE WHEN up = 1 THEN CAST(hits AS DOUBLE) / k END) / sum(up), 6) AS auc_pr FROM (SELECT symbol, trade_date, up, sum(up) OVER w AS hits, row_number() OVER w AS k FROM rk WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY s DESC, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) a GROUP BY 1, 2 HAVING sum(up) > 0", RANKS)
by_symbol("pp13_f1", "sig", f1_score="2.0 * sum(CASE WHEN s > 0 AND rf > 0 THEN 1 ELSE 0 END) / (sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN rf > 0 THEN 1 ELSE 0 END))")
# costs and factors
by_symbol("tc2_participation", "turned", needs=TURNED, participation_rate="sum(moved * q) / sum(q)")
by_symbol("tc3_expected_cost", "quotes", needs=QUOTES, expected_transaction_cost_bps="5 + avg((ask - bid) / 2 / x * 1e4)")
FACTORS = PNL + """, mk AS (SELECT trade_date AS d2, avg(r) * 1e4 AS market, stddev_samp(r) * 1e4 AS volatility FROM panel GROUP BY trade_date),
factors AS (SELECT *, -sum(market) OVER (ORDER BY d2 ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS cheap, avg(volatility) OVER (ORDER BY d2 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS vix FROM mk)"""
by_symbol("or1_value_and_vix", "pnl JOIN factors ON trade_date = d2", needs=FACTORS, corr_with_value_factor="corr(p, cheap)", corr_with_vix="corr(p, vix)")
by_symbol("ma1_pressure", "(SELECT symbol, s, CASE WHEN dt > 0 THEN 1 / dt END AS speed, ofi / (1 + trade_count) AS pressure FROM sig) a", corr_with_trade_intensity="corr(s, speed)", corr_with_meta_order_pressure="corr(s, pressure)")
# regimes
LIQUID = REGIME + ", liq AS (SELECT symbol AS s3, trade_date AS d3, ntile(3) OVER (PARTITION BY symbol ORDER BY sum(q), trade_date) AS liq3 FROM panel GROUP BY symbol, trade_date), lreg AS (SELECT * FROM sig JOIN liq ON symbol = s3 AND trade_date = d3)"
by_symbol("rg1_liquidity", "lreg", needs=LIQUID, ic_low_liquidity="corr(CASE WHEN liq3 = 1 THEN s END, rf)", ic_mid_liquidity="corr(CASE WHEN liq3 = 2 THEN s END, rf)", ic_high_liquidity="corr(CASE WHEN liq3 = 3 THEN s END, rf)")
LABELS = lambda d: REGIME + f""", dd AS (SELECT symbol AS s3, trade_date AS d3, min_by(x, i) AS o, max_by(x, i) AS c, sqrt(sum(r * r)) AS rv, abs(max_by(x, i) - min_by(x, i)) / sum(abs(dx)) AS eff FROM panel GROUP BY symbol, trade_date),
  lab AS (SELECT *, abs(o / lag(c) OVER (PARTITION BY s3 ORDER BY d3) - 1) AS gap, ntile(4) OVER (PARTITION BY s3 ORDER BY rv, d3) AS rv4, ntile(2) OVER (PARTITION BY s3 ORDER BY eff, d3) AS e2 FROM dd), labelled AS (SELECT * FROM sig JOIN lab ON symbol = s3 AND trade_date = d3)"""  # noqa: E731
by_symbol("rg2_day_labels", "labelled", needs=LABELS, ic_trending_days="corr(CASE WHEN e2 = 2 THEN s END, rf)", ic_mean_reverting_days="corr(CASE WHEN e2 = 1 THEN s END, rf)", ic_large_gap_days="corr(CASE WHEN gap > 0.05 THEN s END, rf)", ic_quiet_days="corr(CASE WHEN rv4 = 1 THEN s END, rf)", ic_macro_event_days=lambda d: f"corr(CASE WHEN {d.day('trade_date')} % 7 = 4 THEN s END, rf)")
by_symbol("rg3_named_times", "(SELECT symbol, s, rf, ts_ms % 86400000 AS t FROM sig) a", ic_open_30m="corr(CASE WHEN t < 1800000 THEN s END, rf)", ic_midday="corr(CASE WHEN t >= 39600000 AND t < 46800000 THEN s END, rf)", ic_close_30m="corr(CASE WHEN t >= 84600000 THEN s END, rf)")
# returns
by_symbol("rt1_net_daily", "(SELECT symbol, trade_date, sum(pos * rf) * 1e4 - 5 * sum(moved) AS p FROM turned GROUP BY 1, 2) a", needs=TURNED, net_mean_return_bps_daily="avg(p)")
PLANS["rt2_benchmark_ir"] = (lambda d: "SELECT symbol, round(avg(p - b) / stddev_samp(p - b), 6) AS information_ratio_vs_benchmark FROM pnl JOIN (SELECT trade_date AS d2, avg(r) * 1e4 AS b FROM panel GROUP BY 1) k ON trade_date = d2 GROUP BY symbol", PNL)
PLANS["rt3_drawdown_days"] = (lambda d: """SELECT symbol, max(k) AS max_drawdown_duration_bars, round(100 * max(dd) / 10000.0, 6) AS max_drawdown_pct, round(100 * avg(dd) / 10000.0, 6) AS avg_drawdown_pct FROM (SELECT symbol, dd, CASE WHEN dd > 0 THEN row_number() OVER (PARTITION BY symbol, isl ORDER BY trade_date) - CASE WHEN isl > 0 THEN 1 ELSE 0 END ELSE 0 END AS k
  FROM (SELECT *, sum(CASE WHEN dd > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM drawn) a) b GROUP BY symbol""", DRAWN)
PLANS["rt4_var_es_99"] = (lambda d: "SELECT symbol, round(max(v), 6) AS var_99_daily, round(avg(CASE WHEN p <= v THEN p END), 6) AS es_99_daily FROM pnl JOIN (SELECT symbol AS s2, " + d.pct("p", 0.01) + " AS v FROM pnl GROUP BY symbol) k ON symbol = s2 GROUP BY symbol", PNL)
PLANS["rt4_cdar_99"] = (lambda d: f"SELECT symbol, round(avg(CASE WHEN dd >= v THEN dd END), 6) AS cdar_99_daily FROM drawn JOIN (SELECT symbol AS s2, {d.pct('dd', 0.99)} AS v FROM drawn GROUP BY symbol) k ON symbol = s2 GROUP BY symbol", DRAWN)
# robustness, execution and the book
PLANS["rb1_ratios"] = (lambda d: f"SELECT symbol, round(o / i, 4) AS oos_to_is_ic_ratio, round(so / si, 4) AS oos_to_is_sharpe_ratio FROM (SELECT symbol, corr(CASE WHEN half = 1 THEN s END, rf) AS i, corr(CASE WHEN half = 2 THEN s END, rf) AS o, avg(CASE WHEN half = 1 THEN sign(s) * rf END) / stddev_samp(CASE WHEN half = 1 THEN sign(s) * rf END) AS si, avg(CASE WHEN half = 2 THEN sign(s) * rf END) / stddev_samp(CASE WHEN half = 2 THEN sign(s) * rf END) AS so FROM (SELECT symbol, s, rf, CASE WHEN 2 * {d.day('trade_date')} < m THEN 1 ELSE 2 END AS half FROM sig JOIN (SELECT symbol AS s2, min({d.day('trade_date')}) + max({d.day('trade_date')}) AS m FROM sig GROUP BY symbol) k ON symbol = s2) h GROUP BY symbol) r", PANEL)
_PERIOD = lambda d, p: f"(SELECT symbol, {p} AS k, sum(p) AS total, avg(p) / stddev_samp(p) AS sharpe FROM (SELECT *, {d.div(d.day('trade_date'), 7)} AS week FROM pnl) w GROUP BY 1, 2)"
PLANS["rb2_periods"] = (lambda d: f"SELECT y.symbol, yearly_positive_pct, quarterly_positive_pct, dispersion AS subsample_sharpe_dispersion FROM (SELECT symbol, round(100.0 * {share('total > 0')}, 6) AS yearly_positive_pct FROM {_PERIOD(d, 'year(trade_date)')} a GROUP BY 1) y JOIN (SELECT symbol, round(100.0 * {share('total > 0')}, 6) AS quarterly_positive_pct FROM {_PERIOD(d, 'year(trade_date) * 4 + quarter(trade_date)')} b GROUP BY 1) q ON y.symbol = q.symbol JOIN (SELECT symbol, round(stddev_samp(sharpe), 6) AS dispersion FROM {_PERIOD(d, 'week')} c GROUP BY 1) w ON y.symbol = w.symbol", PNL)
by_symbol("ex2_adverse_selection", "(SELECT *, lead((bid + ask) / 2, 4) OVER (PARTITION BY symbol, trade_date ORDER BY trade_id) AS later FROM quotes) a", "later IS NOT NULL", needs=QUOTES, short_term_adverse_selection_bps="avg(2 * sign * (later - (bid + ask) / 2) / x * 1e4)")
by_symbol("ex3_notional_impact", "(SELECT symbol, trade_date, b, min_by(x, i) AS x0, sum(sv * x) / 1e8 AS notional FROM (SELECT *, floor((i - 1) / @block@) AS b FROM panel) p GROUP BY 1, 2, 3) k JOIN (SELECT symbol AS s2, trade_date AS d2, floor((i - 1) / @block@) - 1 AS b2, min_by(x, i) AS x1 FROM panel GROUP BY 1, 2, 3) n ON symbol = s2 AND trade_date = d2 AND b = b2", price_impact_per_1m_notional_bps="regr_slope((x1 / x0 - 1) * 1e4, notional) * 1e6")
by_symbol("ex4_cancels", "met", needs=ORDERS, pct_canceled_before_fill="100.0 * avg(CASE WHEN fills = 0 AND order_id % 3 = 1 THEN 1.0 ELSE 0.0 END)")
PLANS["bk1_benchmark"] = (lambda d: "SELECT symbol, round(regr_slope(p, b), 6) AS beta_to_benchmark FROM pnl JOIN (SELECT trade_date AS d2, avg(r) * 1e4 AS b FROM panel GROUP BY 1) k ON trade_date = d2 GROUP BY symbol", PNL)
PLANS["bk2_marginal"] = (lambda d: f"SELECT symbol, round(sum(CASE WHEN all_p <= v THEN p END) / count(CASE WHEN all_p <= v THEN 1 END), 6) AS marginal_es, round(min_by(p, abs(all_p - v)), 6) AS marginal_var FROM book CROSS JOIN (SELECT {d.pct('all_p', 0.05)} AS v FROM (SELECT DISTINCT trade_date, all_p FROM book) u) k GROUP BY symbol", BOOK)
PLANS["bk2_clusters"] = (lambda d: "SELECT round(max(g) / sum(g), 6) AS cluster_exposure_concentration, count(*) AS clusters FROM (SELECT c, sum(w) AS g FROM (SELECT symbol, sum(abs(p)) AS w, CASE WHEN corr(p, all_p) > 0.3 THEN 1 ELSE 2 END AS c FROM book GROUP BY symbol) a GROUP BY c) b", BOOK)
_DD = lambda c: f"(SELECT symbol, max(peak - eq) AS dd FROM (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS peak FROM (SELECT symbol, trade_date, sum({c}) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM book) e) f GROUP BY symbol)"
PLANS["bk3_drawdown"] = (lambda d: f"SELECT a.symbol, round(a.dd - b.dd, 6) AS incremental_drawdown_contribution FROM {_DD('all_p')} a JOIN {_DD('all_p - p')} b ON a.symbol = b.symbol", BOOK)

# on operators
metrics.query("dq1_bars", f"WITH RECURSIVE {oracles.BARS} SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol", lambda s, d: B.delta_bars(tape(s, d), 1.0))(lambda b: b.groupBy("symbol").agg(F.count("*").alias("n_bars")))
metrics.query("pp14_transfer_entropy", f"""WITH {metrics.PANEL}, h AS (SELECT symbol, sign(s) AS x0, sign(r) AS y0, lead(sign(r)) OVER (PARTITION BY symbol ORDER BY i) AS y1 FROM sig WHERE r IS NOT NULL), c AS (SELECT symbol, x0, y0, y1, count(*) AS n FROM h WHERE y1 IS NOT NULL GROUP BY ALL)
  SELECT symbol, round(sum(n / t * ln(n * m3 / (m1 * m2))), 6) AS te FROM (SELECT *, sum(n) OVER (PARTITION BY symbol)::DOUBLE AS t, sum(n) OVER (PARTITION BY symbol, x0, y0)::DOUBLE AS m1, sum(n) OVER (PARTITION BY symbol, y1, y0)::DOUBLE AS m2, sum(n) OVER (PARTITION BY symbol, y0)::DOUBLE AS m3 FROM c) GROUP BY symbol""")(lambda p: P.transfer_entropy(p, "s", "r"))
HORIZONS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "60m": 3_600_000, "240m": 14_400_000, "1d": 86_400_000}
_TERM = f"WITH {metrics.PANEL}, last AS (SELECT symbol, ts_ms, max_by(p, trade_id) AS p FROM f GROUP BY 1, 2), " + ", ".join(f"t{n} AS (SELECT a.symbol, corr(a.s, b.p - a.p) AS ic FROM (SELECT *, ts_ms + {ms} AS until FROM sig) a ASOF JOIN last b ON a.symbol = b.symbol AND a.until >= b.ts_ms GROUP BY 1)" for n, ms in HORIZONS.items())
_JOINED = "t1m " + " ".join(f"JOIN t{n} USING (symbol)" for n in list(HORIZONS)[1:])


def term_structure(panel):
    """(symbol, ic_<horizon>...): correlation of the signal with the price move over each clock horizon."""
    d = T.ahead(panel.select("symbol", "ts_ms", "trade_id", "p", "s"), list(HORIZONS.values()))
    return d.groupBy("symbol").agg(*[F.corr(F.when(F.col("_h") == ms, F.col("s")), F.col("_v") - F.col("p")).alias(f"ic_{n}") for n, ms in HORIZONS.items()])


metrics.query("ts1_term_structure", _TERM.replace("FROM f GROUP BY 1, 2)", "FROM sig GROUP BY 1, 2)", 1) + " SELECT symbol, " + ", ".join(f"round(t{n}.ic, 6) AS ic_{n}" for n in HORIZONS) + f" FROM {_JOINED}")(term_structure)
metrics.query("ts2_decay_ratios", _TERM.replace("FROM f GROUP BY 1, 2)", "FROM sig GROUP BY 1, 2)", 1) + f" SELECT symbol, round(t60m.ic / t15m.ic, 4) AS ic_decay_ratio_60m_15m, round(t1d.ic / t15m.ic, 4) AS ic_decay_ratio_1d_15m FROM {_JOINED}", digits=4)(
    lambda p: term_structure(p).select("symbol", (F.col("ic_60m") / F.col("ic_15m")).alias("ic_decay_ratio_60m_15m"), (F.col("ic_1d") / F.col("ic_15m")).alias("ic_decay_ratio_1d_15m")))
