"""Tick features, microstructure signals and panel metrics as SQL plans.

Windows run over one symbol-day each (tick features start anew every day), so no task holds a symbol's history.
A plan is a function of a dialect, which names the few functions that Spark and the oracle spell differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.sources.tape import tape


class Spark:
    pct = staticmethod(lambda x, p: f"percentile({x}, {p})")
    skew = staticmethod(lambda x: f"skewness({x})")
    kurt = staticmethod(lambda x: f"kurtosis({x})")
    day = staticmethod(lambda a: f"unix_date({a})")
    div = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    ratio = staticmethod(lambda a, b: f"CASE WHEN {b} = 0 THEN {a} * double('Infinity') ELSE {a} / {b} END")  # a division by zero is an error here
    series = staticmethod(lambda n, a, b: f"explode(sequence({a}, {b})) AS {n}")


class Duck:
    pct = staticmethod(lambda x, p: f"quantile_cont(CAST({x} AS DOUBLE), {p})")
    skew = staticmethod(lambda x: f"(avg(pow({x}, 3)) - 3 * avg({x}) * avg(pow({x}, 2)) + 2 * pow(avg({x}), 3)) / pow(var_pop({x}), 1.5)")
    kurt = staticmethod(lambda x: f"kurtosis_pop({x})")
    day = staticmethod(lambda a: f"({a} - DATE '1970-01-01')")
    div = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    ratio = staticmethod(lambda a, b: f"{a} / {b}")
    series = staticmethod(lambda n, a, b: f"unnest(range({a}, {b} + 1)) AS {n}")


TAPE_DUCK = """tape AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS trade_date, event_id AS trade_id,
  CAST(round((1000 + value) * 100) AS BIGINT) * 1000000 AS px, (CAST(json_extract(props, '$.k') AS BIGINT) + 1) * 1000000 AS qty,
  event_id * 10 AS first_id, 1 + event_id % 4 AS trade_count, CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS flags, epoch_us(ts) // 1000 AS ts_ms FROM events)"""

#: What a plan's text leaves open, as @name@, and the values that the queries have: rows of the signal's window, rows ahead of its return,
#: a volume bucket in units of 1e-8, trades of a block, a clock bucket in ms, every so many rows of a decimated series, the differences of a
#: variance ratio, rows of a daily return correlation that count, bins of an entropy in units of the signal.
PARAMETERS = {"short": 8, "ahead": 4, "bucket": 500_000_000, "block": 10, "clock_ms": 3_600_000, "step": 5, "lag": 4, "least": 5, "per_unit": 20}
PANEL = f"""
b0 AS (SELECT *, px / 1e8 AS x, qty / 1e8 AS q, CASE WHEN (flags & 1) = 1 THEN -1 ELSE 1 END AS sign FROM tape WHERE px > 0),
b1 AS (SELECT *, qty * sign AS sv, row_number() OVER w AS i, lag(px) OVER w AS ppx, ln(x / lag(x) OVER w) AS r, x - lag(x) OVER w AS dx,
  (ts_ms - lag(ts_ms) OVER w) / 1000.0 AS dtd, lag(sign) OVER w AS psign, lead(sign) OVER w AS nsign, lead(x, @ahead@) OVER w AS xf, sum(qty * sign) OVER (PARTITION BY symbol, trade_date ORDER BY trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cv,
  sum(qty) OVER (PARTITION BY symbol, trade_date ORDER BY trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cq
  FROM b0 WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY trade_id)),
panel AS (SELECT *, CAST(dtd AS DOUBLE) AS dt, q * sign AS v, (CAST(cv AS DOUBLE) - coalesce(lag(CAST(cv AS DOUBLE), @short@) OVER w, 0)) / 1e8 AS ofi, ln(xf / x) AS rf,
  (CAST(cv AS DOUBLE) - lag(CAST(cv AS DOUBLE), @short@) OVER w) / (@short@ * 1e8) AS s, abs(q * (sign - psign)) AS tox
  FROM b1 WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY trade_id)),
sig AS (SELECT * FROM panel WHERE s IS NOT NULL AND rf IS NOT NULL)"""

PLANS: dict[str, Callable] = {}


def plan(name: str, needs: str = PANEL):
    def keep(f):
        PLANS[name] = (f, needs)
        return f

    return keep


def rounded(**cols: str) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in cols.items())


def by_symbol(name: str, source: str = "panel", where: str = "true", keys: str = "symbol", needs: str = PANEL, **cols):
    """One row for each symbol: expressions, or functions of the dialect that give them."""
    PLANS[name] = (lambda d: f"SELECT {keys}, {rounded(**{n: e(d) if callable(e) else e for n, e in cols.items()})} FROM {source} WHERE {where} GROUP BY {keys}", needs)


def row_level(name: str, source: str = "panel", where: str = "true", **cols):
    PLANS[name] = (lambda d: f"SELECT symbol, trade_id, {rounded(**{n: e(d) if callable(e) else e for n, e in cols.items()})} FROM {source} WHERE {where}", PANEL)


D = "PARTITION BY symbol, trade_date ORDER BY trade_id"
# scalars
row_level("prj4_unscale", price="px / 1e8", quantity="qty / 1e8")
row_level("prj6_sign", sign="sign")
#: Fixed value: the largest count that the old row layout holds; a larger one was cut to it.
MOST_COUNT = 65535
PLANS["prj7_last_trade_id"] = (lambda d: f"SELECT symbol, trade_id, CAST(first_id + trade_count - 1 AS DOUBLE) AS last_id, trade_count >= {MOST_COUNT} AS clamped FROM panel", PANEL)
row_level("prj8_signed_volume", signed="sv / 1e8")
PLANS["prj9_trade_day"] = (lambda d: "SELECT symbol, CAST(trade_date AS STRING) AS trade_day, count(*) AS n FROM tape GROUP BY symbol, trade_date", "")
PLANS["prj10_day_range"] = (lambda d: "SELECT symbol, count(*) AS n FROM tape WHERE trade_date >= DATE '2024-01-05' AND trade_date < DATE '2024-01-15' GROUP BY symbol", "")
PLANS["src5_day_manifest"] = (lambda d: "SELECT symbol, trade_date, count(*) AS row_count, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM tape GROUP BY symbol, trade_date", "")
PLANS["src6_available_days"] = (lambda d: "SELECT DISTINCT trade_date FROM tape", "")
PLANS["src7_recent_months"] = (lambda d: "SELECT DISTINCT year(trade_date) AS y, month(trade_date) AS m FROM tape ORDER BY y DESC, m DESC LIMIT 6", "")
# window features
row_level("win5_rolling_sum", ofi="ofi", mean="ofi / least(i, @short@)")


@plan("win20_clock_bars")
def _(d):
    return f"SELECT symbol, {d.div('ts_ms', '@clock_ms@')} AS bucket, round(min_by(x, trade_id), 6) AS o, round(max(x), 6) AS h, round(min(x), 6) AS l, round(max_by(x, trade_id), 6) AS c, round(CAST(sum(qty) AS DOUBLE) / 1e8, 6) AS vol FROM panel GROUP BY 1, 2"


VOLUME = lambda d: PANEL + f""",
cut AS (SELECT *, CAST(cq AS BIGINT) AS hi, CAST(cq AS BIGINT) - qty AS lo FROM panel),
piece AS (SELECT *, {d.series('bucket', 'b0', 'b1')} FROM (SELECT *, {d.div('lo', '@bucket@')} AS b0, {d.div('hi - 1', '@bucket@')} AS b1 FROM cut) z),
vbar AS (SELECT symbol, trade_date, bucket, CAST(sum(part) AS DOUBLE) / 1e8 AS vol, CAST(sum(part * sign) AS DOUBLE) / 1e8 AS net, sum(x * part) / CAST(sum(part) AS DOUBLE) AS vwap, max_by(x, trade_id) AS c
  FROM (SELECT *, least(hi, (bucket + 1) * @bucket@) - greatest(lo, bucket * @bucket@) AS part FROM piece) y GROUP BY symbol, trade_date, bucket)"""  # noqa: E731
PLANS["win21_volume_bars"] = (lambda d: "SELECT symbol, trade_date, bucket, round(vol, 6) AS vol, round(net, 6) AS net, round(c, 6) AS c FROM vbar", VOLUME)
PLANS["ms16_bucket_vwap"] = (lambda d: "SELECT symbol, trade_date, bucket, round(vwap, 6) AS vwap FROM vbar", VOLUME)
PLANS["ms20_rv_volume_clock"] = (lambda d: "SELECT symbol, round(sum(pow(lr, 2)), 6) AS rv FROM (SELECT symbol, ln(c / lag(c) OVER (PARTITION BY symbol, trade_date ORDER BY bucket)) AS lr FROM vbar) y GROUP BY symbol", VOLUME)

# microstructure signals
BLOCKS = lambda d: PANEL + f", blk AS (SELECT symbol, trade_date, {d.div('i - 1', '@block@')} AS b, CAST(sum(sv) AS DOUBLE) / 1e8 AS bq, min_by(x, i) AS x0, count(*) AS n, avg(trade_count) AS tc FROM panel GROUP BY 1, 2, 3), blk2 AS (SELECT *, lead(x0) OVER (PARTITION BY symbol, trade_date ORDER BY b) - x0 AS dp FROM blk)"
by_symbol("ex3_kyle_lambda", "blk2", "n = @block@ AND dp IS NOT NULL", needs=BLOCKS, kyle_lambda="regr_slope(dp, bq)")


by_symbol("ms9_duration_dispersion", where="dt IS NOT NULL", dispersion="stddev_samp(dt) / avg(dt)")
by_symbol("ms10_fano_factor", fano="var_samp(trade_count) / avg(trade_count)")
PLANS["ms17_iceberg"] = (lambda d: "SELECT symbol, trade_id, round(trade_count * (1 - least(abs(dx) / (q * sd), 1.0)), 6) AS score FROM (SELECT *, stddev_samp(dx) OVER (PARTITION BY symbol, trade_date) AS sd FROM panel) a WHERE dx IS NOT NULL AND sd > 0", PANEL)
RUN = f"OVER ({D} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PLANS["ms19_rolling_g_inf"] = (lambda d: f"SELECT symbol, trade_id, round({d.ratio(f'covar_samp(dx, v) {RUN}', f'var_samp(v) {RUN}')}, 6) AS g FROM panel WHERE i > 1", PANEL)
row_level("ms21_duration_adj_return", where="i > 1", a="CASE WHEN dt > 0 THEN r / sqrt(dt) ELSE 0 END")
by_symbol("ms22_frag_speed_corr", where="dt IS NOT NULL", rho="corr(q / trade_count, dt)")
RS = lambda col: lambda d: f"SELECT symbol, trade_date, round(ln((max(c) - min(c)) / max(sd)) / ln(count(*)), 6) AS hurst FROM (SELECT *, sum({col} - m) OVER ({D} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM (SELECT *, avg({col}) OVER (PARTITION BY symbol, trade_date) AS m, stddev_samp({col}) OVER (PARTITION BY symbol, trade_date) AS sd FROM panel WHERE {col} IS NOT NULL) a) b GROUP BY 1, 2 HAVING count(*) > 10 AND max(sd) > 0"
PLANS["ms25_hurst_rs"] = (RS("r"), PANEL)
PLANS["ms46_long_memory"] = (lambda d: f"SELECT symbol, trade_date, round(hurst - 0.5, 6) AS d FROM ({RS('sign')(d)}) z", PANEL)


by_symbol("ms33_concavity", where="dx IS NOT NULL", index="avg(abs(dx) / sqrt(q))")
by_symbol("ms35_realized_skew_kurt", where="r IS NOT NULL", skew="avg(pow(r, 3)) / pow(avg(r * r), 1.5)", kurt="avg(pow(r, 4)) / pow(avg(r * r), 2)")
PLANS["ms36_leverage_effect"] = (lambda d: f"SELECT symbol, round(corr(r, f), 6) AS rho FROM (SELECT symbol, r, pow(lead(r) OVER ({D}), 2) AS f FROM panel WHERE r IS NOT NULL) a GROUP BY symbol", PANEL)
by_symbol("ms37_vsi", vsi="abs(sum(v)) / sum(q)", keys="symbol, trade_date")
row_level("ms39_effective_spread", where="i > 1", spread="2 * abs(dx) / q")
PLANS["ms40_toxicity_count"] = (lambda d: "SELECT symbol, trade_date, b, round(abs(bq) * n * tc / sum(n * tc) OVER (PARTITION BY symbol, trade_date), 6) AS toxicity FROM blk", BLOCKS)
by_symbol("ms42_max_staleness", stale="max(dt)")
by_symbol("ms43_hidden_liquidity", hidden=lambda d: d.pct("trade_count", 0.5))
by_symbol("ms44_aggress_ratio", ratio="avg(CASE WHEN trade_count = 1 THEN 1.0 ELSE 0.0 END)")
PLANS["ms48_univ_y"] = (lambda d: "SELECT symbol, round(avg(i0 / (sd * sqrt(vol))), 6) AS y FROM (SELECT symbol, trade_date, abs(sum(dx)) AS i0, stddev_samp(dx) AS sd, sum(q) AS vol FROM panel GROUP BY 1, 2) a WHERE sd > 0 GROUP BY symbol", PANEL)
# data quality, signal diagnostics
by_symbol("dq1_counts", n_trades="count(*)", n_days="count(DISTINCT trade_date)")
by_symbol("dq2_missing", pct_missing_prices="avg(CASE WHEN px IS NULL THEN 1.0 ELSE 0.0 END)", pct_nonmonotonic_timestamps="avg(CASE WHEN dt < 0 THEN 1.0 ELSE 0.0 END)")
PLANS["dq3_outliers"] = (lambda d: "SELECT symbol, round(avg(CASE WHEN abs(r - m) > 3 * sd THEN 1.0 ELSE 0.0 END), 6) AS pct_return_outliers, round(avg(CASE WHEN q > p99 THEN 1.0 ELSE 0.0 END), 6) AS pct_volume_spikes FROM panel JOIN (SELECT symbol AS s2, avg(r) AS m, stddev_samp(r) AS sd, " + d.pct("q", 0.99) + " AS p99 FROM panel GROUP BY symbol) k ON symbol = s2 WHERE r IS NOT NULL GROUP BY symbol", PANEL)
PLANS["dq5_realized_vol"] = (lambda d: f"SELECT symbol, round(sqrt(sum(lr * lr)), 6) AS realized_vol FROM (SELECT symbol, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY g)) AS lr FROM (SELECT symbol, {d.div('ts_ms', '@clock_ms@')} AS g, max_by(x, trade_id) AS c FROM panel GROUP BY 1, 2) a) b GROUP BY symbol", PANEL)
by_symbol("sd1_signal_distribution", "sig", signal_mean="avg(s)", signal_std="stddev_samp(s)", signal_median=lambda d: d.pct("s", 0.5), signal_pct_1=lambda d: d.pct("s", 0.01), signal_pct_99=lambda d: d.pct("s", 0.99), signal_iqr=lambda d: f"{d.pct('s', 0.75)} - {d.pct('s', 0.25)}")
by_symbol("sd2_signal_shape", "sig", signal_skew=lambda d: d.skew("s"), signal_kurtosis=lambda d: d.kurt("s"), signal_jarque_bera_pvalue=lambda d: f"exp(-count(*) / 12.0 * (pow({d.skew('s')}, 2) + pow({d.kurt('s')}, 2) / 4))")
PLANS["sd4_variance_ratio"] = (lambda d: f"SELECT symbol, round(var_samp(d4) / (@lag@ * var_samp(d1)), 6) AS variance_ratio FROM (SELECT symbol, s - lag(s) OVER ({D}) AS d1, s - lag(s, @lag@) OVER ({D}) AS d4 FROM sig) a GROUP BY symbol", PANEL)
PLANS["sd5_entropy"] = (lambda d: "SELECT symbol, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS p FROM (SELECT symbol, floor(s * @per_unit@) AS b, CAST(count(*) AS DOUBLE) AS n FROM sig GROUP BY 1, 2) a) b GROUP BY symbol", PANEL)
PLANS["sd7_sign_flips"] = (lambda d: f"SELECT symbol, round(avg(CASE WHEN sign(s) <> sign(y) THEN 1.0 ELSE 0.0 END), 6) AS flip_rate FROM (SELECT symbol, s, lag(s) OVER ({D}) AS y FROM sig) a WHERE y IS NOT NULL GROUP BY symbol", PANEL)
# predictive power
by_symbol("pp1_ic_pearson", "sig", ic_pearson="corr(s, rf)")
RANKS = PANEL + ", rk AS (SELECT *, rank() OVER (PARTITION BY symbol, trade_date ORDER BY s) + (count(*) OVER (PARTITION BY symbol, trade_date, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY symbol, trade_date ORDER BY rf) + (count(*) OVER (PARTITION BY symbol, trade_date, rf) - 1) / 2.0 AS rr, ntile(10) OVER (PARTITION BY symbol, trade_date ORDER BY s, trade_id) AS dec, CASE WHEN rf > 0 THEN 1 ELSE 0 END AS up FROM sig)"
by_symbol("pp1_ic_spearman", "rk", keys="symbol, trade_date", needs=RANKS, ic_spearman="corr(CAST(rs AS DOUBLE), CAST(rr AS DOUBLE))")
by_symbol("pp3_ic_decimated", "sig", "i % @step@ = 0", ic_decimated="corr(s, rf)")
DAILY = PANEL + ", ic AS (SELECT symbol, trade_date, corr(s, rf) AS ic FROM sig GROUP BY 1, 2 HAVING count(*) > @least@)"
by_symbol("pp4_ic_series", "ic", needs=DAILY, ic_volatility="stddev_samp(ic)", ic_information_ratio="avg(ic) / stddev_samp(ic)", pct_positive_ic="avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)", ic_skewness=lambda d: d.skew("ic"), ic_kurtosis=lambda d: d.kurt("ic"))
by_symbol("pp6_quantile_spread", "rk", needs=RANKS, decile_spread_top_bottom_bps="1e4 * (avg(CASE WHEN dec = 10 THEN rf END) - avg(CASE WHEN dec = 1 THEN rf END))", hit_rate_top_quantile="avg(CASE WHEN dec = 10 THEN CAST(up AS DOUBLE) END)")
PLANS["pp7_monotonicity"] = (lambda d: "SELECT symbol, round(corr(CAST(dec AS DOUBLE), CAST(k AS DOUBLE)), 6) AS score FROM (SELECT symbol, dec, rank() OVER (PARTITION BY symbol ORDER BY m) AS k FROM (SELECT symbol, dec, avg(rf) AS m FROM rk GROUP BY 1, 2) a) b GROUP BY symbol", RANKS)
by_symbol("pp8_ols", "sig", beta="regr_slope(rf, s)", alpha_bps="regr_intercept(rf, s) * 1e4", r2="regr_r2(rf, s)", tstat="regr_slope(rf, s) * sqrt((count(*) - 2) * regr_sxx(rf, s) / (regr_syy(rf, s) - pow(regr_sxy(rf, s), 2) / regr_sxx(rf, s)))")
PLANS["pp12_auc_roc"] = (lambda d: "SELECT symbol, trade_date, round((sum(CASE WHEN up = 1 THEN rs END) - p * (p + 1) / 2) / (p * n), 6) AS auc FROM (SELECT *, CAST(sum(up) OVER (PARTITION BY symbol, trade_date) AS DOUBLE) AS p, CAST(sum(1 - up) OVER (PARTITION BY symbol, trade_date) AS DOUBLE) AS n FROM rk) a WHERE p > 0 AND n > 0 GROUP BY symbol, trade_date, p, n", RANKS)
PLANS["pp13_confusion"] = (lambda d: "SELECT symbol, sign(s) AS predicted, sign(rf) AS actual, count(*) AS n FROM sig GROUP BY 1, 2, 3", PANEL)
PLANS["ts1_ic_by_horizon"] = (lambda d: " UNION ALL ".join(f"SELECT symbol, {k} AS horizon, round(corr(s, y), 6) AS ic FROM (SELECT symbol, s, ln(lead(x, {k}) OVER ({D}) / x) AS y FROM panel WHERE s IS NOT NULL) a{k} GROUP BY symbol" for k in (1, 2, 4, 8, 16)), PANEL)
by_symbol("ma1_corr_with_primitives", "sig", corr_with_signed_volume="corr(s, v)", corr_with_trade_sign="corr(s, CAST(sign AS DOUBLE))", corr_with_duration="corr(s, dt)", corr_with_child_count="corr(s, CAST(trade_count AS DOUBLE))", corr_with_order_flow_imbalance="corr(s, ofi)")
REGIME = PANEL + ", dayv AS (SELECT symbol AS s2, trade_date AS d2, ntile(3) OVER (PARTITION BY symbol ORDER BY sqrt(sum(r * r)), trade_date) AS vol3, CASE WHEN max_by(x, i) >= min_by(x, i) THEN 'bull' ELSE 'bear' END AS trend FROM panel GROUP BY symbol, trade_date), reg AS (SELECT * FROM sig JOIN dayv ON symbol = s2 AND trade_date = d2)"
PLANS["rg1_ic_vol_regimes"] = (lambda d: "SELECT symbol, vol3, round(corr(s, rf), 6) AS ic FROM reg GROUP BY symbol, vol3", REGIME)
PLANS["rg2_ic_trend_days"] = (lambda d: "SELECT symbol, trend, round(corr(s, rf), 6) AS ic FROM reg GROUP BY symbol, trend", REGIME)
PLANS["rg3_ic_time_of_day"] = (lambda d: f"SELECT symbol, {d.div('ts_ms % 86400000', 3600000 * 4)} AS bucket, round(corr(s, rf), 6) AS ic FROM sig GROUP BY 1, 2", PANEL)
PLANS["rg5_regime_cube"] = (lambda d: "SELECT vol3, trend, count(*) AS n, round(corr(s, rf), 6) AS ic FROM reg GROUP BY CUBE (vol3, trend)", REGIME)
PNL = PANEL + ", pnl AS (SELECT symbol, trade_date, sum(sign(s) * rf) * 1e4 AS p FROM sig GROUP BY 1, 2)"
by_symbol("rt1_returns", "pnl", needs=PNL, gross_mean_return_bps_daily="avg(p)", return_vol_annualized="stddev_samp(p) * sqrt(365.0)")
PLANS["rt4_var_es"] = (lambda d: "SELECT symbol, round(max(v), 6) AS var_95_daily, round(avg(CASE WHEN p <= v THEN p END), 6) AS es_95_daily FROM pnl JOIN (SELECT symbol AS s2, " + d.pct("p", 0.05) + " AS v FROM pnl GROUP BY symbol) k ON symbol = s2 GROUP BY symbol", PNL)
by_symbol("rb2_walk_forward", "ic", needs=DAILY, stability="avg(ic) / stddev_samp(ic)")
PLANS["rb5_decimated_grid"] = (lambda d: "SELECT symbol, round(abs(avg(sign(ic))), 6) AS agreement FROM (SELECT symbol, i % @step@ AS o, corr(s, rf) AS ic FROM sig GROUP BY 1, 2) a GROUP BY symbol", PANEL)
PLANS["bk1_book"] = (lambda d: "SELECT a.symbol, round(corr(a.p, b.p), 6) AS correlation_to_book_pnl, round(regr_slope(a.p, b.p), 6) AS beta_to_book FROM pnl a JOIN (SELECT trade_date, sum(p) AS p FROM pnl GROUP BY 1) b ON a.trade_date = b.trade_date GROUP BY a.symbol", PNL)
QUOTES = PANEL + ", quotes AS (SELECT *, x - (1 + trade_id % 5) * 0.01 AS bid, CASE WHEN trade_id % 97 = 0 THEN x - 0.1 ELSE x + (1 + trade_id % 3) * 0.01 END AS ask FROM panel)"
by_symbol("dq4_quotes", "quotes", needs=QUOTES, pct_crossed_markets="avg(CASE WHEN bid > ask THEN 1.0 ELSE 0.0 END)", avg_spread_bps="avg((ask - bid) / x * 1e4)", median_spread_bps=lambda d: d.pct("(ask - bid) / x * 1e4", 0.5))
by_symbol("ex2_spreads", "quotes", "xf IS NOT NULL", needs=QUOTES, avg_effective_spread_bps="avg(2 * sign * (x - (bid + ask) / 2) / x * 1e4)", avg_realized_spread_bps="avg(2 * sign * (x - xf) / x * 1e4)")


def composed(body: str, needs, d, **parameters) -> str:
    """``body`` with the relations that it needs before it, and PARAMETERS or other values in its open places."""
    if unknown := set(parameters) - set(PARAMETERS):
        raise ValueError(f"no such parameter: {', '.join(sorted(unknown))}")
    needs = needs["spark" if d is Spark else "duck"] if isinstance(needs, dict) else needs(d) if callable(needs) else needs
    parts = [p for p in ([TAPE_DUCK] if d is Duck else []) + [needs.strip().strip(",")] if p]
    whole = (f"WITH {', '.join(parts)} " if parts else "") + body
    for name, value in (PARAMETERS | parameters).items():
        whole = whole.replace(f"@{name}@", str(int(value)))
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\de])", r"\1e0", whole)  # doubles, not decimals


def text(name: str, d, **parameters) -> str:
    f, needs = PLANS[name]
    return composed(f(d), needs, d, **parameters)


def relation(trades: DataFrame, body: str, needs=PANEL, **parameters) -> DataFrame:
    """A query on the relations of ``needs`` over any trades table (the columns of a tape)."""
    body = composed(body, needs, Spark, **parameters).replace("{", "{{").replace("}", "}}").replace("FROM tape", "FROM {tape}")
    return trades.sparkSession.sql(body, tape=trades)


def over(trades: DataFrame, name: str, **parameters) -> DataFrame:
    """The plan ``name`` over any trades table, with other values for some of PARAMETERS."""
    f, needs = PLANS[name]
    return relation(trades, f(Spark), needs, **parameters)


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: over(tape(spark, sf_dir), name)
