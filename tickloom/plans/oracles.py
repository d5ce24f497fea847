"""DuckDB SQL for the stateful queries: recursive common table expressions that step all groups together."""

from __future__ import annotations

from .signals import TAPE_DUCK

BARS = f"""{TAPE_DUCK},
t AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY trade_id) AS rn, CASE WHEN flags & 1 = 1 THEN -qty ELSE qty END AS sv FROM tape),
w(symbol, trade_date, rn, ts0, ts, o, h, l, c, vol, net, path, done) AS (
  SELECT symbol, trade_date, rn, ts_ms, ts_ms, px, px, px, px, qty, sv, CAST(0 AS BIGINT), abs(sv) >= 100000000 FROM t WHERE rn = 1
  UNION ALL
  SELECT t.symbol, t.trade_date, t.rn, CASE WHEN done THEN ts_ms ELSE ts0 END, ts_ms, CASE WHEN done THEN px ELSE o END,
    CASE WHEN done THEN px ELSE greatest(h, px) END, CASE WHEN done THEN px ELSE least(l, px) END, px,
    CASE WHEN done THEN qty ELSE vol + qty END, CASE WHEN done THEN sv ELSE net + sv END, CASE WHEN done THEN 0 ELSE path + abs(px - c) END,
    abs(CASE WHEN done THEN sv ELSE net + sv END) >= 100000000
  FROM w JOIN t ON t.symbol = w.symbol AND t.trade_date = w.trade_date AND t.rn = w.rn + 1),
bars AS (SELECT symbol, trade_date, CAST(row_number() OVER (PARTITION BY symbol, trade_date ORDER BY rn) - 1 AS INTEGER) AS bar_no, ts0 AS ts_start, ts AS ts_end, o / 1e8 AS open, h / 1e8 AS high, l / 1e8 AS low, c / 1e8 AS close,
  vol / 1e8 AS vol, net / 1e8 AS delta, CASE WHEN path > 0 THEN abs(c - o) / CAST(path AS DOUBLE) ELSE 0.0 END AS eff, (c / 1e8 - o / 1e8) / (net / 1e8) AS impact FROM w WHERE done),
sg AS (SELECT *, CAST(CASE WHEN eff > 0.6 THEN CASE WHEN delta > 0 AND close > open THEN 1 WHEN delta < 0 AND close < open THEN -1 ELSE 0 END WHEN eff < 0.25 THEN -sign(delta) ELSE 0 END AS INTEGER) AS signal FROM bars),
shards AS (SELECT symbol, trade_date, CAST(ntile(4) OVER (PARTITION BY symbol ORDER BY trade_date) AS INTEGER) AS shard_id FROM (SELECT DISTINCT symbol, trade_date FROM bars))"""


def sims(grid: str) -> str:
    return f"""{BARS},
z AS (SELECT g.*, s.symbol, h.shard_id, ts_end, close, eff, impact, signal, row_number() OVER (PARTITION BY param_id, s.symbol, h.shard_id ORDER BY s.trade_date, bar_no) AS rn
  FROM sg s JOIN shards h ON s.symbol = h.symbol AND s.trade_date = h.trade_date CROSS JOIN ({grid}) g),
st(param_id, symbol, shard_id, rn, pos, e, ets, ek1, ek3, out_pos, out_ets, out_ts, out_pnl, out_k1, out_k3) AS (
  SELECT param_id, symbol, shard_id, rn, signal, close, ts_end, eff, impact, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM z WHERE rn = 1
  UNION ALL
  SELECT param_id, symbol, shard_id, rn, CASE WHEN kept <> 0 THEN kept ELSE signal END, CASE WHEN kept <> 0 THEN e ELSE close END, CASE WHEN kept <> 0 THEN ets ELSE ts_end END, CASE WHEN kept <> 0 THEN ek1 ELSE eff END, CASE WHEN kept <> 0 THEN ek3 ELSE impact END,
    CASE WHEN hit THEN pos ELSE 0 END, ets, ts_end, roi - cost, ek1, ek3
  FROM (SELECT *, CASE WHEN hit THEN 0 ELSE pos END AS kept FROM (SELECT *, pos <> 0 AND (roi > tp OR roi < sl) AS hit FROM (
    SELECT z.*, st.pos, st.e, st.ets, st.ek1, st.ek3, (z.close - st.e) / st.e * 10000.0 * st.pos AS roi FROM st JOIN z ON z.param_id = st.param_id AND z.symbol = st.symbol AND z.shard_id = st.shard_id AND z.rn = st.rn + 1) a) b) c),
sim AS (SELECT param_id, symbol, shard_id, CAST(row_number() OVER (PARTITION BY param_id, symbol, shard_id ORDER BY rn) - 1 AS INTEGER) AS seq, out_ets AS entry_ts, out_ts AS exit_ts, out_pnl AS net_pnl_bps, out_pos AS side, out_k1 AS k1, out_k3 AS k3 FROM st WHERE out_pos <> 0)"""


ONE = "SELECT 1 AS param_id, CAST(40 AS DOUBLE) AS tp, CAST(-15 AS DOUBLE) AS sl, CAST(5 AS DOUBLE) AS cost"
GRID = " UNION ALL ".join(f"SELECT {k} AS param_id, CAST({tp} AS DOUBLE) AS tp, CAST({sl} AS DOUBLE) AS sl, CAST(5 AS DOUBLE) AS cost" for k, tp, sl in ((1, 36, -13.5), (2, 40, -15), (3, 44, -16.5)))
R = lambda **c: ", ".join(f"round({e}, 6) AS {n}" for n, e in c.items())
CARD = f"""{sims(ONE)},
o AS (SELECT *, net_pnl_bps AS p, row_number() OVER (PARTITION BY symbol ORDER BY shard_id, seq) AS rn, count(*) OVER (PARTITION BY symbol) AS n,
  sum(net_pnl_bps) OVER (PARTITION BY symbol ORDER BY shard_id, seq) AS eq FROM sim),
pk AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY rn), 0) AS peak FROM o),
fl AS (SELECT *, CASE WHEN eq > coalesce(lag(peak) OVER (PARTITION BY symbol ORDER BY rn), 0) THEN 1 ELSE 0 END AS np FROM pk),
isl AS (SELECT *, sum(np) OVER (PARTITION BY symbol ORDER BY rn) AS island FROM fl),
dur AS (SELECT symbol, max(k) AS duration FROM (SELECT symbol, island, count(*) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS k FROM isl GROUP BY symbol, island) GROUP BY symbol),
lv AS (SELECT symbol, p > 0 AS win, rn, row_number() OVER (PARTITION BY symbol ORDER BY rn) - row_number() OVER (PARTITION BY symbol, p > 0 ORDER BY rn) AS g FROM o WHERE p <> 0),
stk AS (SELECT symbol, coalesce(max(k) FILTER (win), 0) AS mw, coalesce(max(k) FILTER (NOT win), 0) AS ml FROM (SELECT symbol, win, g, count(*) AS k FROM lv GROUP BY 1, 2, 3) GROUP BY symbol),
a AS (SELECT symbol, count(*) AS n, sum(p) AS total, avg(p) AS m, coalesce(stddev_samp(p), 0) AS sd, min_by(entry_ts, rn) AS t0, max_by(exit_ts, rn) AS t1, sqrt(avg(pow(least(p, 0), 2))) AS down,
  max(peak - eq) AS dd, avg(pow(p, 3)) - 3 * avg(p) * avg(pow(p, 2)) + 2 * pow(avg(p), 3) AS m3, quantile_cont(p, 0.01) AS q1, quantile_cont(p, 0.05) AS q5, quantile_cont(p, 0.95) AS q95, quantile_cont(p, 0.99) AS q99,
  100 * avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS wr, coalesce(avg(p) FILTER (p > 0), 0) AS aw, coalesce(avg(p) FILTER (p <= 0), 0) AS al, coalesce(sum(p) FILTER (p > 0), 0) AS won, -coalesce(sum(p) FILTER (p <= 0), 0) AS lost,
  avg(CAST(exit_ts - entry_ts AS DOUBLE) / 1000) AS hold, coalesce(avg(p) FILTER (k3 < -0.5), 0) AS pl, coalesce(avg(p) FILTER (k3 BETWEEN -0.5 AND 0.5), 0) AS pm, coalesce(avg(p) FILTER (k3 > 0.5), 0) AS ph, count(*) FILTER (k3 < -0.5) AS nl, count(*) FILTER (k3 > 0.5) AS nh,
  avg(p) FILTER (rn <= n // 2) AS m1, stddev_samp(p) FILTER (rn <= n // 2) AS s1, avg(p) FILTER (rn > n // 2) AS m2, stddev_samp(p) FILTER (rn > n // 2) AS s2 FROM pk GROUP BY symbol),
b AS (SELECT *, n / greatest((t1 - t0) / 86400000.0, 1.0) AS tpd FROM a),
c AS (SELECT *, sqrt(tpd * 365) AS yr, coalesce(CASE WHEN s1 > 0 THEN m1 / s1 * sqrt(tpd * 365) END, 0) AS h1, coalesce(CASE WHEN s2 > 0 THEN m2 / s2 * sqrt(tpd * 365) END, 0) AS h2 FROM b)
SELECT c.symbol, n AS total_trades, {R(net_pnl_bps='total', gross_mean_return_bps_per_trade='m', return_vol_bps_per_trade='sd', trades_per_day='tpd', sharpe_annualized='CASE WHEN sd <> 0 THEN m * yr / sd ELSE 0 END', sortino_ratio='CASE WHEN down <> 0 THEN m * yr / down ELSE 0 END', calmar_ratio='CASE WHEN dd <> 0 THEN m * tpd * 365 / dd ELSE 0 END', recovery_factor='CASE WHEN dd <> 0 THEN total / dd ELSE 0 END', max_drawdown_bps='dd', pnl_skewness='CASE WHEN sd > 0 THEN m3 / pow(sd, 3) ELSE 0 END', pnl_percentile_1='q1', pnl_percentile_5='q5', pnl_percentile_95='q95', pnl_percentile_99='q99', win_rate_pct='wr', avg_win_bps='aw', avg_loss_bps='al', profit_factor='CASE WHEN lost <> 0 THEN won / lost ELSE 0 END', risk_reward_ratio='CASE WHEN al <> 0 THEN aw / abs(al) ELSE 0 END', sqn='CASE WHEN sd <> 0 THEN sqrt(n) * m / sd ELSE 0 END', avg_holding_sec='hold', avg_pnl_low_vol='pl', avg_pnl_mid_vol='pm', avg_pnl_high_vol='ph', sharpe_is_first_half='h1', sharpe_oos_second_half='h2', consistency_ratio='CASE WHEN greatest(h1, h2) <> 0 THEN least(h1, h2) / greatest(h1, h2) ELSE 0 END')},
  duration AS max_drawdown_duration_trades, coalesce(mw, 0) AS max_consecutive_wins, coalesce(ml, 0) AS max_consecutive_losses, nl AS count_low_vol, nh AS count_high_vol
FROM c JOIN dur ON c.symbol = dur.symbol LEFT JOIN stk ON c.symbol = stk.symbol"""

CORE = {
    "seq1_delta_bars": f"WITH RECURSIVE {BARS} SELECT symbol, trade_date, bar_no, ts_start, ts_end, {R(**{c: c for c in ('open', 'high', 'low', 'close', 'vol', 'delta', 'eff', 'impact')})} FROM bars",
    "prj11_absorption_signal": f"WITH RECURSIVE {BARS} SELECT symbol, trade_date, bar_no, signal FROM sg",
    "seq5_assign_shards": f"WITH RECURSIVE {BARS} SELECT symbol, trade_date, shard_id FROM shards",
    "seq4_backtest": f"WITH RECURSIVE {sims(ONE)} SELECT symbol, shard_id, seq, entry_ts, exit_ts, {R(net_pnl_bps='net_pnl_bps', k1='k1', k3='k3')}, side FROM sim",
    "seq7_sweep": f"WITH RECURSIVE {sims(GRID)} SELECT param_id, symbol, count(*) AS trades, round(sum(round(net_pnl_bps, 6)), 4) AS pnl FROM sim GROUP BY 1, 2",
    "sc_scorecard": f"WITH RECURSIVE {CARD}",
    "seq6_ledger": f"""WITH RECURSIVE {TAPE_DUCK},
t AS (SELECT symbol, trade_date, px / 1e8 AS p, trade_id % 3 - 1 AS s, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY trade_id) AS rn FROM tape),
w(symbol, trade_date, rn, cash, pos, p) AS (
  SELECT symbol, trade_date, rn, CASE WHEN s = 1 AND p < 100000 THEN 100000 - p ELSE CAST(100000 AS DOUBLE) END, CASE WHEN s = 1 AND p < 100000 THEN 1 ELSE 0 END, p FROM t WHERE rn = 1
  UNION ALL SELECT t.symbol, t.trade_date, t.rn, CASE WHEN s = 1 AND cash > t.p THEN cash - t.p WHEN s = -1 AND pos > 0 THEN cash + t.p ELSE cash END, CASE WHEN s = 1 AND cash > t.p THEN pos + 1 WHEN s = -1 AND pos > 0 THEN pos - 1 ELSE pos END, t.p
  FROM w JOIN t ON t.symbol = w.symbol AND t.trade_date = w.trade_date AND t.rn = w.rn + 1)
SELECT symbol, trade_date, round(max_by(cash + pos * p, rn), 6) AS final_value FROM w GROUP BY 1, 2""",
    "win5_rolling_prefix": f"""WITH {TAPE_DUCK} SELECT symbol, trade_id, CAST(sum(CASE WHEN flags & 1 = 1 THEN -qty ELSE qty END) OVER w AS BIGINT) AS net, CAST(count(*) OVER w AS INTEGER) AS n_rows FROM tape
WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY trade_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)""",
}

_DAY = "(PARTITION BY symbol, trade_date ORDER BY trade_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_ALL, _EIGHT = _DAY.format("UNBOUNDED"), _DAY.format(7)
#: The streams' rows as batch queries; clock bars are those that end by the watermark.
STREAMS = {
    "str1_stream_rolling_g_inf": f"""WITH {TAPE_DUCK}, t AS (SELECT *, (1 - 2 * flags) * qty / 1e8 AS q, px / 1e8 - lag(px / 1e8) OVER (PARTITION BY symbol, trade_date ORDER BY trade_id) AS dx FROM tape),
u AS (SELECT *, var_pop(CASE WHEN dx IS NOT NULL THEN q END) OVER {_ALL} AS v, covar_pop(dx, q) OVER {_ALL} AS c FROM t)
SELECT symbol, trade_date, trade_id, round(CASE WHEN v > 1e-9 THEN c / v END, 6) AS g_inf FROM u""",
    "str2_stream_hawkes": f"""WITH {TAPE_DUCK}, t AS (SELECT *, (ts_ms % 86400000) / 3600000.0 AS h FROM tape)
SELECT symbol, trade_date, trade_id, round(exp(-0.5 * h) * sum(CASE WHEN flags = 0 THEN 0.8 * exp(0.5 * h) ELSE 0 END) OVER {_ALL}, 6) AS buys, round(exp(-0.5 * h) * sum(CASE WHEN flags = 1 THEN 0.8 * exp(0.5 * h) ELSE 0 END) OVER {_ALL}, 6) AS sells FROM t""",
    "str3_stream_delta_bars": CORE["seq1_delta_bars"],
    "str4_stream_rolling_window": f"""WITH {TAPE_DUCK}, t AS (SELECT *, avg(qty / 1e8) OVER {_EIGHT} AS m, stddev_pop(qty / 1e8) OVER {_EIGHT} AS sd FROM tape)
SELECT symbol, trade_date, trade_id, round(m, 6) AS mean, round(CASE WHEN sd > 1e-6 THEN (qty / 1e8 - m) / sd ELSE 0 END, 6) AS z FROM t""",
    "str5_stream_clock_bars": f"""WITH {TAPE_DUCK}, t AS (SELECT *, ts_ms - ts_ms % 3600000 AS start_ms, max(ts_ms) OVER () - 60000 AS mark FROM tape)
SELECT symbol, start_ms, {R(open='min_by(px, trade_id) / 1e8', high='max(px) / 1e8', low='min(px) / 1e8', close='max_by(px, trade_id) / 1e8', vol='sum(qty) / 1e8')} FROM t WHERE start_ms + 3600000 <= mark GROUP BY 1, 2""",
}
CORE["seq1_delta_bars_in_ranges"] = CORE["seq1_delta_bars"]

#: Rows in any order, in the order of time: those that the last watermark (a day behind the last trade) has passed.
_PASSED = "tape AS (SELECT * FROM (SELECT *, max(ts_ms) OVER () - 86400000 AS mark FROM tape0) WHERE ts_ms < mark)"
STREAMS |= {f"str{k}_stream_any_order": STREAMS[n].replace("tape AS (SELECT event_type", "tape0 AS (SELECT event_type", 1).replace("epoch_us(ts) // 1000 AS ts_ms FROM events)", f"epoch_us(ts) // 1000 AS ts_ms FROM events), {_PASSED}", 1) for k, n in ((1, "str1_stream_rolling_g_inf"), (2, "str2_stream_hawkes"), (3, "str3_stream_delta_bars"), (4, "str4_stream_rolling_window"))}
