"""More plans over the panel: calendars, interval and quote joins, panel tests and costs. Every window stays in one symbol-day; splits in halves are by day."""

from __future__ import annotations

from .signals import D, DAILY, PANEL, PLANS, PNL, QUOTES, Spark, by_symbol, row_level, rounded

# calendars: every day between the tape's first and last, for each symbol
CALENDAR = lambda d: f"days AS (SELECT symbol, {d.series('k', 'a', 'b')} FROM (SELECT symbol, a, b FROM (SELECT DISTINCT symbol FROM tape) s CROSS JOIN (SELECT {d.day('min(trade_date)')} AS a, {d.day('max(trade_date)')} AS b FROM tape) r) c), have AS (SELECT symbol, {d.day('trade_date')} AS k, count(*) AS n, min(px) AS low, min(qty) AS least FROM tape GROUP BY symbol, trade_date)"
PLANS["src8_day_calendar"] = (lambda d: "SELECT symbol, CAST(k AS INTEGER) AS epoch_day FROM days", CALENDAR)
PLANS["src9_days_to_ingest"] = (lambda d: "SELECT days.symbol, CAST(days.k AS INTEGER) AS epoch_day FROM days LEFT JOIN (SELECT * FROM have WHERE k % 2 = 0) h ON days.symbol = h.symbol AND days.k = h.k WHERE h.k IS NULL", CALENDAR)
PLANS["src10_ingest_status"] = (lambda d: """SELECT status, count(*) AS days FROM (SELECT CASE WHEN h.k % 2 = 0 THEN 'skip' WHEN h.k IS NULL THEN 'missing' WHEN low <= 0 OR least < 0 THEN 'error' ELSE 'ok' END AS status
  FROM days LEFT JOIN have h ON days.symbol = h.symbol AND days.k = h.k) t GROUP BY status""", CALENDAR)

PLANS["ms13_propagator_signal"] = (lambda d: """SELECT symbol, trade_date, round(actual - model, 6) AS resid, CAST(CASE WHEN abs(actual - model) > 2 THEN -sign(actual - model) ELSE 0 END AS INTEGER) AS signal
  FROM (SELECT symbol, trade_date, max_by(x, i) - min_by(x, i) AS actual, sum(CASE WHEN k > 1 THEN v / sqrt(k) ELSE 0.0 END) AS model FROM (SELECT *, count(*) OVER (PARTITION BY symbol, trade_date) - i + 1 AS k FROM panel) a GROUP BY symbol, trade_date) b""", PANEL)

LAGS = (1, 2, 4, 8)
PLANS["ms45_decay_halflife"] = (lambda d: "SELECT symbol, round(ln(2.0) * sum(lag * lag) / -sum(lag * ln(ac)), 6) AS halflife FROM (" + " UNION ALL ".join(f"SELECT symbol, {k} AS lag, avg(s * n) / avg(s * s) AS ac FROM (SELECT symbol, s, lead(s, {k}) OVER ({D}) AS n FROM sig) a{k} GROUP BY symbol" for k in LAGS) + ") t WHERE ac > 0.001 GROUP BY symbol", PANEL)

# joins with labels, factors, quotes and order intervals
PLANS["join7_label_join"] = (lambda d: f"""SELECT symbol, label, count(*) AS n, round(corr(s, rf), 6) AS ic FROM sig JOIN (SELECT DISTINCT trade_date AS d2, CASE WHEN {d.day('trade_date')} % 7 IN (2, 3) THEN 'weekend' WHEN {d.day('trade_date')} % 7 = 4 THEN 'event' ELSE 'plain' END AS label FROM tape) l ON trade_date = d2 GROUP BY symbol, label""", PANEL)
FACTORS = PNL + """, mk AS (SELECT trade_date AS d2, avg(r) * 1e4 AS market, stddev_samp(r) * 1e4 AS volatility, sum(q) AS volume, avg(v) AS size FROM panel GROUP BY trade_date), factors AS (SELECT *, lag(market) OVER (ORDER BY d2) AS momentum FROM mk)"""
by_symbol("or1_join8_factor_corr", "pnl JOIN factors ON trade_date = d2", needs=FACTORS, corr_with_market_return="corr(p, market)", corr_with_momentum_factor="corr(p, momentum)", corr_with_volatility="corr(p, volatility)", corr_with_volume="corr(p, volume)", corr_with_size_factor="corr(p, size)")
STAMPED = QUOTES + ", stamped AS (SELECT symbol, trade_date, ts_ms, max_by(bid, trade_id) AS bid, max_by(ask, trade_id) AS ask FROM quotes GROUP BY 1, 2, 3)"
PLANS["join9_quote_join"] = (lambda d: "SELECT symbol, trade_id, round(x - (f.bid + f.ask) / 2, 6) AS off_mid FROM joined WHERE x IS NOT NULL" if d is Spark else
    "SELECT p.symbol, p.trade_id, round(p.x - (o.bid + o.ask) / 2, 6) AS off_mid FROM panel p ASOF LEFT JOIN stamped o ON p.symbol = o.symbol AND p.trade_date = o.trade_date AND p.ts_ms > o.ts_ms",
    {"spark": STAMPED + """, joined AS (SELECT *, max(CASE WHEN x IS NULL THEN struct(ts_ms, bid, ask) END) OVER (PARTITION BY symbol, trade_date ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
  FROM (SELECT symbol, trade_date, ts_ms, trade_id, x, CAST(NULL AS DOUBLE) AS bid, CAST(NULL AS DOUBLE) AS ask FROM panel UNION ALL SELECT symbol, trade_date, ts_ms, NULL, NULL, bid, ask FROM stamped) u)""", "duck": STAMPED})
#: An order is open for one bucket's length, so it meets its own bucket and the next.
OPEN_MS = 3_600_000
ORDERS = lambda d: PANEL + f""", orders AS (SELECT symbol, trade_id AS order_id, sign AS side, x AS decision, ts_ms AS t0, ts_ms + {OPEN_MS} AS t1, {d.series('b', d.div('ts_ms', OPEN_MS), d.div('ts_ms', OPEN_MS) + ' + 1')} FROM panel WHERE trade_id % 50 = 0),
met AS (SELECT o.symbol, order_id, any_value(side) AS side, any_value(decision) AS decision, count(p.x) AS trades, sum(CASE WHEN p.trade_id % 3 = 0 THEN 1 ELSE 0 END) AS fills, sum(CASE WHEN p.trade_id % 3 = 0 THEN p.x * p.q END) / sum(CASE WHEN p.trade_id % 3 = 0 THEN p.q END) AS fill_px, sum(p.x * p.q) / sum(p.q) AS vwap, avg(p.x) AS twap
  FROM orders o LEFT JOIN (SELECT *, {d.div('ts_ms', OPEN_MS)} AS b FROM panel) p ON o.symbol = p.symbol AND o.b = p.b AND p.ts_ms BETWEEN o.t0 AND o.t1 GROUP BY o.symbol, order_id)"""  # noqa: E731
PLANS["join10_order_fill"] = (lambda d: f"SELECT symbol, order_id, trades, CAST(fills AS BIGINT) AS fills, {rounded(fill_px='fill_px', vwap='vwap')} FROM met", ORDERS)
by_symbol("ex1_slippage", "met", needs=ORDERS, slippage_vs_vwap_bps="avg(side * (fill_px - vwap) / vwap * 1e4)", slippage_vs_twap_bps="avg(side * (fill_px - twap) / twap * 1e4)", implementation_shortfall_bps="avg(side * (fill_px - decision) / decision * 1e4)")
by_symbol("ex4_fill_rate", "met", needs=ORDERS, fill_rate_pct="100.0 * avg(CASE WHEN fills > 0 THEN 1.0 ELSE 0.0 END)", pct_partial_fills="100.0 * avg(CASE WHEN fills > 0 AND fills < trades THEN 1.0 ELSE 0.0 END)")

# halves by day
HALVES = lambda d: PANEL + f", halves AS (SELECT symbol, s, rf, CASE WHEN 2 * {d.day('trade_date')} < m THEN 1 ELSE 2 END AS half FROM sig JOIN (SELECT symbol AS s2, min({d.day('trade_date')}) + max({d.day('trade_date')}) AS m FROM sig GROUP BY symbol) k ON symbol = s2)"
by_symbol("pp10_predictive_r2_oos", "halves JOIN (SELECT symbol AS s2, regr_slope(rf, s) AS b, regr_intercept(rf, s) AS a, avg(rf) AS m FROM halves WHERE half = 1 GROUP BY symbol) fit ON symbol = s2", "half = 2", needs=HALVES,
          predictive_r2_oos="1 - sum((rf - a - b * s) * (rf - a - b * s)) / sum((rf - m) * (rf - m))")
# panel tests
_lagged = ", ".join(f"lag(e, {k}) OVER (PARTITION BY symbol ORDER BY trade_date) AS e{k}" for k in range(1, 11))
_q = " + ".join(f"pow(sum(e * e{k}) / sum(e * e), 2) / (count(*) - {k})" for k in range(1, 11))
PLANS["pp5_ic_ljung_box"] = (lambda d: f"SELECT symbol, round(q, 6) AS q, round(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 6) AS pvalue FROM (SELECT symbol, count(*) * (count(*) + 2) * ({_q}) AS q FROM (SELECT *, {_lagged} FROM (SELECT symbol, trade_date, ic - avg(ic) OVER (PARTITION BY symbol) AS e FROM ic WHERE ic IS NOT NULL) a) b GROUP BY symbol) c", DAILY)
_hac = " + ".join(f"2 * (1 - {h} / 5.0) * sum(coalesce(u * u{h}, 0))" for h in range(1, 5))
_us = ", ".join(f"lag(u, {h}) OVER ({D}) AS u{h}" for h in range(1, 5))
PLANS["pp9_hac_tstat"] = (lambda d: f"""SELECT symbol, round(max(b) * max(sxx) / sqrt(sum(u * u) + {_hac}), 6) AS hac_tstat FROM (SELECT *, {_us} FROM (SELECT *, (s - ms) * (rf - a - b * s) AS u FROM sig JOIN (SELECT symbol AS s2, regr_slope(rf, s) AS b, regr_intercept(rf, s) AS a, avg(s) AS ms, regr_sxx(rf, s) AS sxx FROM sig GROUP BY symbol) f ON symbol = s2) e) g GROUP BY symbol""", PANEL)
PLANS["pp11_fama_macbeth"] = (lambda d: f"SELECT count(*) AS sections, round(avg(b) / (stddev_samp(b) / sqrt(count(*))), 6) AS fama_macbeth_tstat, round(avg(r2), 6) AS fama_macbeth_r2 FROM (SELECT regr_slope(rf, s) AS b, regr_r2(rf, s) AS r2 FROM sig GROUP BY trade_date, {d.div('ts_ms', 14_400_000)} HAVING count(*) > 2) a", PANEL)
PLANS["pp14_mutual_information"] = (lambda d: """SELECT symbol, round(sum(n / t * ln(n * t / (na * nb))), 6) AS mutual_information FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY symbol) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY symbol, a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY symbol, b) AS DOUBLE) AS nb
  FROM (SELECT symbol, sign(s) AS a, sign(rf) AS b, CAST(count(*) AS DOUBLE) AS n FROM sig GROUP BY 1, 2, 3) c) e GROUP BY symbol""", PANEL)
PLANS["ts2_ic_decay"] = (lambda d: f"SELECT symbol, round(max(CASE WHEN horizon = 8 THEN ic END) / max(CASE WHEN horizon = 2 THEN ic END), 4) AS ic_decay_ratio, round(-ln(2.0) / regr_slope(ln(abs(ic)), horizon), 4) AS ic_half_life FROM ({PLANS['ts1_ic_by_horizon'][0](d).replace('round(corr(s, y), 6)', 'corr(s, y)')}) t GROUP BY symbol", PANEL)
# costs and the book
TURNED = PANEL + f", turned AS (SELECT *, sign(s) AS pos, abs(sign(s) - coalesce(lag(sign(s)) OVER ({D}), 0)) AS moved, lag(s) OVER ({D}) AS s1 FROM sig)"
by_symbol("tc2_turnover", "turned", needs=TURNED, portfolio_turnover_per_bar="avg(moved)", portfolio_turnover_daily="sum(moved) / count(DISTINCT trade_date)", turnover_pct_of_adv="100 * sum(moved * q) / sum(q)", avg_trade_size_shares="sum(moved * q) / sum(CASE WHEN moved > 0 THEN 1 END)", avg_trade_size_notional="sum(moved * q * x) / sum(CASE WHEN moved > 0 THEN 1 END)")
by_symbol("tc3_costs", "turned", needs=TURNED, break_even_cost_bps="sum(pos * rf) * 1e4 / sum(moved)", expected_tc_drag_bps="5 * avg(moved)", turnover_adjusted_ic="corr(s, rf) * sqrt(1 - corr(s, s1))")
BOOK = PNL + ", book AS (SELECT symbol, trade_date, p, sum(p) OVER (PARTITION BY trade_date) AS all_p FROM pnl)"
by_symbol("bk3_incremental", "book", needs=BOOK, incremental_sharpe_contribution="(avg(all_p) / stddev_samp(all_p) - avg(all_p - p) / stddev_samp(all_p - p)) * sqrt(365.0)", incremental_return_contribution="avg(p)")
PLANS["bk2_diversification"] = (lambda d: "SELECT round(sum(sd) / max(book_sd), 6) AS inverse_diversification_ratio, round(sum(g * g) / (sum(g) * sum(g)), 6) AS herfindahl_of_signal_weights FROM (SELECT symbol, stddev_samp(p) AS sd, sum(abs(p)) AS g FROM pnl GROUP BY symbol) a CROSS JOIN (SELECT stddev_samp(p) AS book_sd FROM (SELECT sum(p) AS p FROM pnl GROUP BY trade_date) b) c", PNL)
# returns: per bar, tails, and the drawdown of the daily equity
by_symbol("rt1_returns_per_bar", "turned", needs=TURNED, gross_mean_return_bps_per_bar="avg(pos * rf) * 1e4", net_mean_return_bps_per_bar="avg(pos * rf) * 1e4 - 5 * avg(moved)", return_vol_bps_per_bar="stddev_samp(pos * rf) * 1e4")
TAILS = lambda d: PNL + f", tails AS (SELECT * FROM pnl JOIN (SELECT symbol AS s2, {d.pct('p', 0.05)} AS lo, {d.pct('p', 0.95)} AS hi FROM pnl GROUP BY symbol) k ON symbol = s2)"
by_symbol("rt2_tails", "tails", needs=TAILS, pnl_kurtosis=lambda d: d.kurt("p"), tail_ratio="avg(CASE WHEN p >= hi THEN p END) / abs(avg(CASE WHEN p <= lo THEN p END))", downside_volatility="sqrt(avg(least(p, 0.0) * least(p, 0.0)))")
#: One row a symbol-day here, so a symbol's window holds its days only.
DRAWN = PNL + """, drawn AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) - eq AS dd
  FROM (SELECT *, sum(p) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM pnl) e)"""
by_symbol("rt3_drawdowns", "drawn", needs=DRAWN, max_drawdown_bps="max(dd)", avg_drawdown_bps="avg(dd)", ulcer_index="sqrt(avg(dd * dd))")
PLANS["rt4_cdar"] = (lambda d: f"SELECT symbol, round(avg(CASE WHEN dd >= v THEN dd END), 6) AS cdar_95_daily FROM drawn JOIN (SELECT symbol AS s2, {d.pct('dd', 0.95)} AS v FROM drawn GROUP BY symbol) k ON symbol = s2 GROUP BY symbol", DRAWN)
# robustness by time split, interaction with volatility, and the book's information ratio with the signal
by_symbol("rb1_is_oos", "halves", needs=HALVES, ic_is="corr(CASE WHEN half = 1 THEN s END, rf)", ic_oos="corr(CASE WHEN half = 2 THEN s END, rf)", sharpe_is="avg(CASE WHEN half = 1 THEN sign(s) * rf END) / stddev_samp(CASE WHEN half = 1 THEN sign(s) * rf END)", sharpe_oos="avg(CASE WHEN half = 2 THEN sign(s) * rf END) / stddev_samp(CASE WHEN half = 2 THEN sign(s) * rf END)")
by_symbol("rg4_conditioned_ic", "(SELECT sig.*, CASE WHEN trade_id % 5 + trade_id % 3 < 3 THEN 1 ELSE 0 END AS narrow FROM sig) a", corr_signal_times_vol_with_returns="corr(s * abs(r), rf)", ic_conditioned_on_spread_narrow="corr(CASE WHEN narrow = 1 THEN s END, rf)", ic_conditioned_on_spread_wide="corr(CASE WHEN narrow = 0 THEN s END, rf)")
by_symbol("or3_incremental_ir", "book", needs=BOOK, incremental_ir_in_book="avg(all_p) / stddev_samp(all_p) - avg(all_p - p) / stddev_samp(all_p - p)")
by_symbol("rb2_period_stats", "(SELECT symbol, trade_date, p, sum(p) OVER (PARTITION BY symbol, year(trade_date), month(trade_date)) AS month_p FROM pnl) a", needs=PNL, walk_forward_pnl_stability_score="avg(p) / stddev_samp(p)", monthly_positive_pct="100.0 * avg(CASE WHEN month_p > 0 THEN 1.0 ELSE 0.0 END)")
