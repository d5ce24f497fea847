"""Queries of the tick operators at the reference windows and at small ones (for short tapes), and their oracles: SQL of
its own with plain window frames, recursive or quadratic where that is the plainest form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import primitives as P
from tickloom.operators import ticks as T
from tickloom.sources.tape import tape

from .signals import TAPE_DUCK

HOUR = 3_600_000
REF = {"short": 64, "medium": 1024, "long": 10_000, "smooth": 256}
SMALL = {"short": 8, "medium": 32, "long": 64, "smooth": 8}

BASE = f"""{TAPE_DUCK},
f0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date, trade_id) AS i, px / 1e8 AS p, qty / 1e8 AS q, 1 - 2 * (flags & 1) AS sign FROM tape WHERE px > 0),
f AS (SELECT *, q * sign AS v, ln(p) AS x, ln(p) - ln(lag(p) OVER s) AS r, (ts_ms - lag(ts_ms) OVER s) / 1e3 AS dt, q * abs(sign - lag(sign) OVER s) AS tox FROM f0 WINDOW s AS (PARTITION BY symbol ORDER BY i))"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def features(spark, sf_dir: str) -> DataFrame:
    return T.features(tape(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def query(name: str, sql: str, digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda s, d: rounded(f(features(s, d)), digits)
        text = f"WITH {BASE}, {sql.strip()}" if not sql.lstrip().upper().startswith("SELECT") else f"WITH {BASE} {sql}"
        ORACLES[name] = text.replace("round(", "0e0 + round(").replace("0e0 + round((1000", "round((1000")  # no negative zeros
        return f

    return keep


def ring(ticks: DataFrame, value: str, name: str) -> DataFrame:
    """Each symbol's rows as those of the symbol before it in the alphabet (the last one's go to the first): its leader."""
    from pyspark.sql import Window

    names = ticks.select("symbol").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("symbol")
    pairs = names.withColumns({"of": F.coalesce(F.lag("symbol").over(w), F.last("symbol").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))})
    return ticks.join(pairs, "symbol").select(F.col("of").alias("symbol"), "ts_ms", "trade_id", F.col(value).alias(name))


RING = "pairs AS (SELECT coalesce(lag(symbol) OVER (ORDER BY symbol), (SELECT max(symbol) FROM f)) AS led, symbol FROM (SELECT DISTINCT symbol FROM f))"


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _z(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {_w(n)} = {n} AND {c} IS NOT NULL THEN ({c} - avg({c}) OVER {_w(n)}) / (stddev_samp({c}) OVER {_w(n)} + 1e-8) END"


def _zo(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {_w(n)} >= 2 AND var_pop({c}) OVER {_w(n)} > 1e-12 THEN ({c} - avg({c}) OVER {_w(n)}) / (sqrt(var_pop({c}) OVER {_w(n)}) + 1e-8) ELSE 0 END"


def _full(f: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {_w(n)} = {n} THEN {f}({c}) OVER {_w(n)} END"


@query("win6_rolling_zscore", f"SELECT symbol, trade_id, round({_z('v', 128)}, 4) AS z, round({_zo('v', 128)}, 4) AS z_online FROM f", 4)
def _(t):
    return T.rolling_zscore(T.rolling_zscore(t, "v", 128, "z"), "v", 128, "z_online", online=True).select("symbol", "trade_id", "z", "z_online")


for _n, _width in (("win7_rolling_quantile", 10_000), ("win7_rolling_quantile_small", 64)):
    query(_n, f"g AS (SELECT *, abs(v) AS a FROM f) SELECT symbol, trade_id, round(CASE WHEN count(a) OVER {_w(_width)} = {_width} THEN quantile_cont(a, 0.9) OVER {_w(_width)} END, 6) AS q90 FROM g")(
        lambda t, n=_width: T.rolling_quantile(t.withColumn("a", F.abs("v")), "a", n, 0.9, "q90").select("symbol", "trade_id", "q90"))

for _tag, _s in (("", REF), ("_small", SMALL)):
    a, m, l, k = _s["short"], _s["medium"], _s["long"], _s["smooth"]
    query(f"win8_k1{_tag}", f"g AS (SELECT *, {_full('sum', 'v', a)} AS ofi, v / (sqrt(dt) + 0.001) AS spd FROM f) SELECT symbol, trade_id, round(0.75 * {_z('ofi', m)} + 0.25 * {_z('spd', m)}, 4) AS k1 FROM g", 4)(
        lambda t, s=_s: T.kernels(t, **s, which=["k1"]).select("symbol", "trade_id", "k1"))
    query(f"win10_k3_spec{_tag}", f"g AS (SELECT *, {_full('avg', 'tox', m)} AS mt FROM f) SELECT symbol, trade_id, round({_z('mt', l)}, 4) AS k3 FROM g", 4)(
        lambda t, s=_s: T.kernels(t, **s, which=["k3"]).select("symbol", "trade_id", "k3"))
    query(f"win11_k4_spec{_tag}", f"""g AS (SELECT *, CASE WHEN count(v) OVER {_w(l)} = {l} THEN quantile_cont(abs(v), 0.9) OVER {_w(l)} END AS p90 FROM f),
      h AS (SELECT *, abs(r) / (abs(v) + 0.01 * p90) AS lam FROM g), j AS (SELECT *, {_full('avg', 'lam', k)} AS ml FROM h) SELECT symbol, trade_id, round(-({_z('ml', m)}), 4) AS k4 FROM j""", 4)(
        lambda t, s=_s: T.kernels(t, **s, which=["k4"]).select("symbol", "trade_id", "k4"))
    query(f"win9_k2_lead_lag{_tag}", f"""{RING}, led AS (SELECT led AS symbol, ts_ms, max_by(r, trade_id) AS rs FROM f JOIN pairs USING (symbol) WHERE r IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT f.*, led.rs FROM f ASOF LEFT JOIN led ON f.symbol = led.symbol AND f.ts_ms >= led.ts_ms),
      h AS (SELECT *, 0.4 * rs + 0.3 * lag(rs, 1) OVER s + 0.2 * lag(rs, 2) OVER s + 0.1 * lag(rs, 3) OVER s AS y FROM g WINDOW s AS (PARTITION BY symbol ORDER BY i)) SELECT symbol, trade_id, round({_z('y', m)}, 2) AS k2 FROM h""", 2)(
        lambda t, s=_s: T.lead_lag(t, ring(t.where("r is not null"), "r", "r_spot"), s["medium"]).select("symbol", "trade_id", "k2"))

_ONLINE = lambda s: f"""g AS (SELECT *, sum(v) OVER {_w(s['short'])} AS ofi, coalesce(v / sqrt(greatest(dt, 0.001)), 0) AS spd, coalesce(tox, 0) AS tx, coalesce(abs(r), 0) / (abs(v) + 1.0) AS lam FROM f),
  k AS (SELECT *, 0.75 * ({_zo('ofi', s['medium'])}) + 0.25 * ({_zo('spd', s['medium'])}) AS k1, {_zo('tx', s['long'])} AS k3, -({_zo('lam', s['medium'])}) AS k4 FROM g)"""  # noqa: E731
query("win10_k3_online", f"{_ONLINE(REF)} SELECT symbol, trade_id, round(k3, 4) AS k3 FROM k", 4)(lambda t: T.kernels(t, **REF, online=True, which=["k3"]).select("symbol", "trade_id", "k3"))
query("win11_k4_online", f"{_ONLINE(REF)} SELECT symbol, trade_id, round(k4, 3) AS k4 FROM k", 3)(lambda t: T.kernels(t, **REF, online=True, which=["k4"]).select("symbol", "trade_id", "k4"))
query("prj17_composite_alpha", f"{_ONLINE(REF)} SELECT symbol, trade_id, round(k1 * CASE WHEN k4 < -1.5 THEN 0 WHEN k3 > 2 THEN 0.2 WHEN k3 > 1 THEN 0.5 ELSE 1 END, 3) AS alpha FROM k", 3)(
    lambda t: T.kernels(t, **REF, online=True).select("symbol", "trade_id", T.composite_alpha(F.col("k1"), F.col("k3"), F.col("k4")).alias("alpha")))
query("prj16_position_scale", f"{_ONLINE(SMALL)} SELECT symbol, trade_id, CASE WHEN k4 <= -1 THEN 0.0 WHEN k3 > 1 THEN 0.5 ELSE 1.0 END AS scale FROM k")(
    lambda t: T.kernels(t, **SMALL, online=True).select("symbol", "trade_id", T.position_scale(F.col("k3"), F.col("k4")).alias("scale")))
_LED = f"""{RING}, led AS (SELECT led AS symbol, ts_ms, max_by(r, trade_id) AS rs FROM f JOIN pairs USING (symbol) WHERE r IS NOT NULL GROUP BY 1, 2), f2 AS (SELECT f.*, led.rs FROM f ASOF LEFT JOIN led ON f.symbol = led.symbol AND f.ts_ms >= led.ts_ms)"""
query("prj15_trade_signal", f"""{_LED}, g AS (SELECT *, {_full('sum', 'v', 8)} AS ofi, v / (sqrt(dt) + 0.001) AS spd, 0.4 * rs + 0.3 * lag(rs, 1) OVER s + 0.2 * lag(rs, 2) OVER s + 0.1 * lag(rs, 3) OVER s AS y FROM f2 WINDOW s AS (PARTITION BY symbol ORDER BY i))
  SELECT symbol, trade_id, CASE WHEN k1 + 0.5 * k2 IS NOT NULL THEN round(greatest(-2, least(2, k1 + 0.5 * k2)), 2) END AS signal FROM (SELECT symbol, trade_id, 0.75 * {_z('ofi', 32)} + 0.25 * {_z('spd', 32)} AS k1, {_z('y', 32)} AS k2 FROM g)""", 2)(
    lambda t: T.lead_lag(T.kernels(t, **SMALL, which=["k1"]), ring(t.where("r is not null"), "r", "r_spot"), 32).select("symbol", "trade_id", F.when((F.col("k1") + F.col("k2")).isNotNull(), T.trade_signal(F.col("k1"), F.col("k2"))).alias("signal")))
_AHEAD = lambda source, h: f"ahead AS (SELECT a.*, b.p - a.p AS y FROM (SELECT *, ts_ms + {h} AS until FROM {source}) a ASOF JOIN (SELECT symbol, ts_ms, max_by(p, trade_id) AS p FROM f GROUP BY 1, 2) b ON a.symbol = b.symbol AND a.until >= b.ts_ms)"
for _n, _h in (("win13_target_500ms", 500), ("join4_forward_price", HOUR)):
    query(_n, f"{_AHEAD('f', _h)} SELECT symbol, trade_id, round(y, 6) AS y FROM ahead")(lambda t, h=_h: T.forward_price(t, h).select("symbol", "trade_id", "y"))
query("win14_hit_rate", f"""{_ONLINE(REF)}, {_AHEAD('k', HOUR)} SELECT symbol, count(*) AS n, round(avg(CASE WHEN sign(k1) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(sign(k1) * y / p * 1e4), 6) AS bps_per_trade,
  count(*) FILTER (k4 > 0.5) AS n_open, round(avg(CASE WHEN sign(k1) = sign(y) THEN 1.0 ELSE 0.0 END) FILTER (k4 > 0.5), 6) AS hit_rate_open, round(avg(sign(k1) * y / p * 1e4) FILTER (k4 > 0.5), 6) AS bps_per_trade_open FROM ahead GROUP BY symbol""")(
    lambda t: T.hit_rate(T.forward_price(T.kernels(t, **REF, online=True), HOUR)))
query("join2_asof_backward", f"{_LED} SELECT symbol, trade_id, round(rs, 6) AS leader_r FROM f2")(
    lambda t: T.asof(t, ring(t.where("r is not null"), "r", "leader_r"), "ts_ms", ["leader_r"], ["symbol"]).select("symbol", "trade_id", "leader_r"))
_REGIME = lambda s: f"""b AS (SELECT symbol, i, ts_ms, x, (i - 1) // {s} AS b, lag(ts_ms) OVER (PARTITION BY symbol ORDER BY i DESC) AS after FROM f),
  d AS (SELECT *, x - lag(x, 1) OVER s AS d1, x - lag(x, 5) OVER s AS d5, x - lag(x, 10) OVER s AS d10, x - lag(x, 20) OVER s AS d20 FROM b WINDOW s AS (PARTITION BY symbol, b ORDER BY i)),
  e AS (SELECT symbol, b, max_by(after, i) AS ts_ms, max_by(x, i) - min_by(x, i) AS net, sum(abs(d1)) AS path, stddev_pop(d5) AS s5, stddev_pop(d10) AS s10, stddev_pop(d20) AS s20 FROM d GROUP BY 1, 2 HAVING count(*) = {s}),
  k5 AS (SELECT symbol, ts_ms, CASE WHEN s5 = 0 THEN 0.5 ELSE 2 * (SELECT regr_slope(ln(y), ln(t)) FROM (VALUES (s5, 5.0), (s10, 10.0), (s20, 20.0)) u(y, t)) END AS hurst, net / nullif(path, 0) AS efficiency FROM e WHERE ts_ms IS NOT NULL)"""  # noqa: E731
for _tag, _step in (("", 5000), ("_small", 200)):
    query(f"win12_k5_regime{_tag}", f"{_REGIME(_step)} SELECT symbol, ts_ms, round(hurst, 5) AS hurst, round(efficiency, 5) AS efficiency FROM k5", 5)(lambda t, s=_step: T.regime(t, s))
query("join3_ffill_regime", f"{_REGIME(200)} SELECT f.symbol, f.trade_id, round(hurst, 5) AS hurst, round(efficiency, 5) AS efficiency FROM f ASOF LEFT JOIN k5 ON f.symbol = k5.symbol AND f.ts_ms >= k5.ts_ms", 5)(
    lambda t: T.ffill_regime(t, T.regime(t, 200)).select("symbol", "trade_id", "hurst", "efficiency"))

# microstructure signals
query("ms1_ms2_impact_response", "m AS (SELECT symbol, tau, sign, lead(x, CAST(tau AS INTEGER)) OVER (PARTITION BY symbol, tau ORDER BY i) - x AS d FROM f, (SELECT unnest([1, 5, 20]) AS tau)) SELECT symbol, CAST(tau AS INTEGER) AS tau, round(avg(d * sign) * 1e4, 6) AS response_bps, round(avg(d * sign) / sqrt(avg(d * d)), 6) AS signature FROM m WHERE d IS NOT NULL GROUP BY 1, 2")(
    lambda t: P.impact_response(t, (1, 5, 20)).select("symbol", "tau", (F.col("response") * 1e4).alias("response_bps"), "signature"))
_BLOCKS = "bl AS (SELECT symbol, (i - 1) // 100 AS b, any_value(trade_date ORDER BY i) AS trade_date, min_by(x, i) AS x0, sum(v) AS net FROM f GROUP BY 1, 2), bl2 AS (SELECT *, lead(x0) OVER (PARTITION BY symbol ORDER BY b) - x0 AS dp FROM bl)"
query("ms3_permanent_impact", f"{_BLOCKS} SELECT symbol, round(sum(dp * net) / sum(net * net) * 1e4, 6) AS g_inf FROM bl2 WHERE dp IS NOT NULL GROUP BY symbol")(lambda t: P.permanent_impact(t).withColumn("g_inf", F.col("g_inf") * 1e4))
query("ms4_concave_impact", f"{_BLOCKS}, dy AS (SELECT symbol, trade_date, sum(q) AS vol, stddev_samp(r) AS sigma FROM f GROUP BY 1, 2), o AS (SELECT ln(abs(dp) / sigma) AS y, ln(abs(net) / vol) AS x FROM bl2 JOIN dy USING (symbol, trade_date) WHERE dp <> 0 AND net <> 0 AND sigma > 0) SELECT round(exp(regr_intercept(y, x)), 6) AS y, round(regr_slope(y, x), 6) AS delta FROM o")(lambda t: P.concave_impact(P.meta_orders(t)))
query("ms5_sign_autocorr", "SELECT symbol, round(avg(sign * s1), 6) AS acf_1, round(avg(sign * s5), 6) AS acf_5, round(avg(sign * s20), 6) AS acf_20 FROM (SELECT symbol, sign, lead(sign, 1) OVER w AS s1, lead(sign, 5) OVER w AS s5, lead(sign, 20) OVER w AS s20 FROM f WINDOW w AS (PARTITION BY symbol ORDER BY i)) GROUP BY symbol")(lambda t: P.sign_autocorr(t, (1, 5, 20)))
query("ms6_hill_index", "y AS (SELECT symbol, abs(r) AS y, row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC, i) AS rk, floor(count(*) OVER (PARTITION BY symbol) * 0.05) AS k FROM f WHERE r <> 0), t AS (SELECT *, max(CASE WHEN rk = k + 1 THEN y END) OVER (PARTITION BY symbol) AS yk FROM y) SELECT symbol, round(1.0 / avg(ln(y) - ln(yk)), 6) AS hill FROM t WHERE rk <= k GROUP BY symbol")(P.hill_index)
for _n, _b in (("ms14_hawkes_intensity", 0.002), ("ms14_hawkes_intensity_fast", 1.0)):
    # pairs of one day that are not decayed to nothing; plain double loop
    query(_n, f"SELECT a.symbol, a.trade_id, round(sum(CASE WHEN b.sign = 1 THEN 0.8 * exp(-{_b} * (a.ts_ms - b.ts_ms) / 1e3) ELSE 0 END), 6) AS buys, round(sum(CASE WHEN b.sign = -1 THEN 0.8 * exp(-{_b} * (a.ts_ms - b.ts_ms) / 1e3) ELSE 0 END), 6) AS sells FROM f a JOIN f b ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND b.i <= a.i AND a.ts_ms - b.ts_ms < {int(40_000 / _b)} GROUP BY 1, 2")(
        lambda t, b=_b: P.hawkes_intensity(t, 0.8, b).select("symbol", "trade_id", "buys", "sells"))
query("ms15_hawkes_fade", f"""h AS (SELECT a.symbol, a.i, a.trade_id, sum(0.8 * exp(-0.002 * (a.ts_ms - b.ts_ms) / 1e3)) AS tot FROM f a JOIN f b ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND b.i <= a.i GROUP BY 1, 2, 3),
  z AS (SELECT *, CASE WHEN count(*) OVER w = 64 AND stddev_samp(tot) OVER w > 0 THEN (tot - avg(tot) OVER w) / stddev_samp(tot) OVER w END AS z FROM h WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)) SELECT symbol, trade_id, round(z, 4) AS z, z > 3.5 AS fade FROM z""", 4)(
    lambda t: P.hawkes_fade(P.hawkes_intensity(t, 0.8, 0.002), 64).select("symbol", "trade_id", "z", "fade"))
_Q = "max(CASE WHEN q = {q} THEN h END)"
query("ms26_multifractal_width", """m AS (SELECT symbol, lg, abs(x - lag(x, CAST(lg AS INTEGER)) OVER (PARTITION BY symbol, lg ORDER BY i)) AS y FROM f, (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS lg)),
  e AS (SELECT symbol, q, lg, ln(avg(pow(y, q))) AS l FROM m, (SELECT unnest([-2.0, 2.0]) AS q) WHERE y > 0 GROUP BY 1, 2, 3), s AS (SELECT symbol, q, regr_slope(l, ln(lg)) / q AS h FROM e GROUP BY 1, 2) SELECT symbol, round(max(CASE WHEN q < 0 THEN h END) - max(CASE WHEN q > 0 THEN h END), 6) AS width FROM s GROUP BY symbol""")(P.multifractal_width)
query("ms27_transfer_entropy", """g AS (SELECT symbol, sign(v) AS x0, sign(r) AS y0, lead(sign(r)) OVER (PARTITION BY symbol ORDER BY i) AS y1 FROM f WHERE r IS NOT NULL), c AS (SELECT symbol, x0, y0, y1, count(*) AS n FROM g WHERE y1 IS NOT NULL GROUP BY ALL)
  SELECT symbol, round(sum(n / t * ln(n * m3 / (m1 * m2))), 6) AS te FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY symbol) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY symbol, x0, y0) AS DOUBLE) AS m1, CAST(sum(n) OVER (PARTITION BY symbol, y1, y0) AS DOUBLE) AS m2, CAST(sum(n) OVER (PARTITION BY symbol, y0) AS DOUBLE) AS m3 FROM c) GROUP BY symbol""")(P.transfer_entropy)
query("ms29_resilience_time", """q AS (SELECT symbol, quantile_cont(abs(r), 0.95) AS cut FROM f WHERE r IS NOT NULL GROUP BY symbol), d AS (SELECT *, lag(p) OVER (PARTITION BY symbol, trade_date ORDER BY i) AS ref FROM f),
  s AS (SELECT d.* FROM d JOIN q USING (symbol) WHERE abs(r) > cut AND ref IS NOT NULL) SELECT s.symbol, s.trade_id, coalesce(min(f.i) - any_value(s.i), -1)::INTEGER AS steps FROM s LEFT JOIN f ON f.symbol = s.symbol AND f.trade_date = s.trade_date AND f.i > s.i AND abs(f.p - s.ref) < 0.5 * abs(s.p - s.ref) GROUP BY 1, 2""")(
    lambda t: P.resilience(t).select("symbol", "trade_id", "steps"))
query("ms30_impact_asymmetry", "m AS (SELECT symbol, sign, (lead(x) OVER (PARTITION BY symbol ORDER BY i) - x) * sign AS m FROM f) SELECT symbol, round(avg(m) FILTER (sign = 1) / avg(m) FILTER (sign = -1), 4) AS ratio FROM m GROUP BY symbol", 4)(P.impact_asymmetry)
_RV = lambda ms: f"(SELECT symbol, sum(d * d) AS rv FROM (SELECT symbol, c - lag(c) OVER (PARTITION BY symbol ORDER BY g) AS d FROM (SELECT symbol, ts_ms // {ms} AS g, max_by(x, i) AS c FROM f GROUP BY 1, 2)) GROUP BY symbol)"
query("ms31_vol_signature_bias", f"SELECT a.symbol, round(a.rv / (60 * b.rv), 6) AS bias FROM {_RV(60000)} a JOIN {_RV(1000)} b USING (symbol)")(P.vol_signature_bias)
_GRID = f"""{RING}, gr AS (SELECT symbol, ts_ms // 1800000 AS g, sum(r) AS va FROM f WHERE r IS NOT NULL GROUP BY 1, 2), lg AS (SELECT gr.symbol, lag, corr(gr.va, o.va) AS rho FROM gr JOIN pairs ON gr.symbol = pairs.led JOIN gr o ON o.symbol = pairs.symbol CROSS JOIN (SELECT unnest(range(-5, 5)) AS lag) WHERE gr.g = o.g + lag GROUP BY 1, 2)"""
_series = lambda t: (t.where("r is not null").select("symbol", "ts_ms", F.col("r").alias("v")), ring(t.where("r is not null"), "r", "v"))
query("join5_lagged_panel", f"{_GRID} SELECT symbol, lag::INTEGER AS lag, round(rho, 6) AS rho FROM lg")(lambda t: P.lagged_pairs(*_series(t), list(range(-5, 5)), 1_800_000, ["symbol"]).groupBy("symbol", "lag").agg(F.corr("va", "vb").alias("rho")))
query("ms32_lead_lag", f"{_GRID} SELECT symbol, coalesce(max_by(lag, rho) FILTER (rho > 0), 0)::INTEGER AS lag, round(coalesce(max(rho) FILTER (rho > 0), 0), 6) AS rho FROM lg GROUP BY symbol")(lambda t: P.best_lag(P.lagged_pairs(*_series(t), list(range(-5, 5)), 1_800_000, ["symbol"]), ["symbol"]))
_share = lambda a, b: F.avg(F.when((F.col("sign") == a) & (F.col("n") == b), 1.0).otherwise(0.0))
_PAIR = ((1, 1, "11"), (1, -1, "12"), (-1, 1, "21"), (-1, -1, "22"))
query("ms34_hawkes_rho", "g AS (SELECT symbol, sign AS a, lead(sign) OVER (PARTITION BY symbol ORDER BY i) AS b, q FROM f), k AS (SELECT symbol, a, b, count(*) / any_value(t) / (0.5 + avg(q)) AS k FROM (SELECT *, CAST(count(*) OVER (PARTITION BY symbol) AS DOUBLE) AS t FROM g WHERE b IS NOT NULL) GROUP BY 1, 2, 3), m AS (SELECT symbol, max(k) FILTER (a = 1 AND b = 1) AS p, max(k) FILTER (a = 1 AND b = -1) AS r, max(k) FILTER (a = -1 AND b = 1) AS s, max(k) FILTER (a = -1 AND b = -1) AS t FROM k GROUP BY symbol) SELECT symbol, round((p + t) / 2 + sqrt((p - t) * (p - t) / 4 + r * s), 6) AS rho FROM m")(
    lambda t: P.hawkes_rho(P._later(t, {"n": ("sign", 1)}).where("n is not null").groupBy("symbol").agg(*[_share(a, b).alias(f"a{ij}") for a, b, ij in _PAIR], *[(0.5 + F.avg(F.when((F.col("sign") == a) & (F.col("n") == b), F.col("q")))).alias(f"b{ij}") for a, b, ij in _PAIR])).select("symbol", "rho"))
query("ms41_noise_variance", "g AS (SELECT symbol, i, r, x, x - lag(x, 5) OVER (PARTITION BY symbol ORDER BY i) AS c FROM f) SELECT symbol, round((sum(r * r) - sum(CASE WHEN i % 5 = 1 THEN c * c ELSE 0 END)) / (2.0 * count(r)) * 1e6, 6) AS noise FROM g WHERE r IS NOT NULL GROUP BY symbol")(lambda t: P.noise_variance(t).withColumn("noise", F.col("noise") * 1e6))
query("ms18_meta_acceleration", "SELECT symbol, trade_id, round(coalesce(x - 2 * lag(x, 1) OVER s + lag(x, 2) OVER s, 0), 6) AS acc FROM f WINDOW s AS (PARTITION BY symbol ORDER BY i)")(lambda t: P.meta_acceleration(t).select("symbol", "trade_id", "acc"))
_VB = """vb0 AS (SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY i)::BIGINT AS hi, ceil(sum(qty) OVER (PARTITION BY symbol) / 50)::BIGINT AS u FROM f), vb1 AS (SELECT *, unnest(range((hi - qty) // u, (hi - 1) // u + 1)) AS bucket FROM vb0),
  vb AS (SELECT symbol, bucket, sum(part) / 1e8 AS vol, sum(part * sign) / 1e8 AS net, sum(p * part) / sum(part) AS vwap, max_by(p, i) AS close FROM (SELECT *, least(hi, (bucket + 1) * u) - greatest(hi - qty, bucket * u) AS part FROM vb1) GROUP BY 1, 2)"""
query("win21_volume_bars_n", f"{_VB} SELECT symbol, bucket, round(vol, 6) AS vol, round(net, 6) AS net, round(vwap, 6) AS vwap, round(close, 6) AS close FROM vb")(lambda t: P.volume_bars(t, n_buckets=50))
query("ms8_vpin", f"{_VB} SELECT symbol, round(avg(abs(net) / vol), 6) AS vpin FROM vb GROUP BY symbol")(lambda t: P.vpin(P.volume_bars(t, n_buckets=50)))
_points = lambda t: t.groupBy("symbol", "trade_date").agg(F.stddev_samp("x").alias("a"), F.avg("v").alias("b")).select(F.concat_ws("|", "symbol", "trade_date").alias("id"), (F.col("a") * 10).alias("a"), "b")
_POINTS = "pt AS (SELECT symbol || '|' || trade_date::VARCHAR AS id, stddev_samp(x) * 10 AS a, avg(v) AS b FROM f GROUP BY symbol, trade_date)"
query("join6_pairs_within", f"{_POINTS} SELECT l.id AS id_a, r.id AS id_b FROM pt l JOIN pt r ON l.id < r.id WHERE (l.a - r.a) * (l.a - r.a) + (l.b - r.b) * (l.b - r.b) < 0.01")(lambda t: P.pairs_within(_points(t).where("a is not null"), ["a", "b"], 0.1))
query("ms28_correlation_dimension", f"{_POINTS} SELECT count(*) AS pairs FROM pt l JOIN pt r ON l.id < r.id WHERE (l.a - r.a) * (l.a - r.a) + (l.b - r.b) * (l.b - r.b) < 0.01")(lambda t: P.correlation_dimension(_points(t).where("a is not null"), ["a", "b"], 0.1))

# features over days, and signals with parameters
query("win1_log_return", "SELECT symbol, trade_id, round(r, 6) AS r FROM f WHERE i > 1")(lambda t: t.where("i > 1").select("symbol", "trade_id", "r"))
query("win2_duration", "SELECT symbol, trade_id, round(dt, 6) AS dt FROM f WHERE i > 1")(lambda t: t.where("i > 1").select("symbol", "trade_id", "dt"))
query("win3_trade_speed", "SELECT symbol, trade_id, round(v / (sqrt(dt) + 0.001), 6) AS spec, round(v / sqrt(greatest(dt, 0.001)), 6) AS online FROM f WHERE i > 1")(lambda t: t.where("i > 1").select("symbol", "trade_id", F.col("spd").alias("spec"), F.col("spd_online").alias("online")))
query("win4_flow_toxicity", "SELECT symbol, trade_id, round(tox, 6) AS tox FROM f WHERE i > 1")(lambda t: t.where("i > 1").select("symbol", "trade_id", "tox"))
_KERNEL = lambda w: "SELECT symbol, round((sum(r * r) + " + " + ".join(f"2 * {v!r}::DOUBLE * coalesce(sum(r * r{k}), 0)" for k, v in enumerate(w, 1)) + ") * 1e3, 6) AS rk FROM (SELECT symbol, r, " + ", ".join(f"lag(r, {k}) OVER s AS r{k}" for k in range(1, len(w) + 1)) + " FROM f WINDOW s AS (PARTITION BY symbol ORDER BY i)) GROUP BY symbol"
for _n, _w5 in (("ms7_realized_kernel", [5 / 6, 4 / 6, 3 / 6, 2 / 6, 1 / 6]), ("ms24_parzen_kernel", [1 - 6 / 36 + 6 / 216, 1 - 6 / 9 + 6 / 27, 1 - 6 / 4 + 6 / 8, 2 / 27, 2 / 216])):
    query(_n, _KERNEL(_w5))(lambda t, w=P.bartlett_weights if _n.startswith("ms7") else P.parzen_weights: P.realized_kernel(t, w(5)).withColumn("rk", F.col("rk") * 1e3))
query("ms10_fano_blocks", "b AS (SELECT symbol, (i - 1) // 100 AS b, var_samp(trade_count) / avg(trade_count) AS f FROM f GROUP BY 1, 2 HAVING count(*) = 100) SELECT symbol, round(avg(f), 6) AS fano FROM b GROUP BY symbol")(P.fano_factor)
query("ms38_burstiness", "SELECT symbol, trade_id, max(trade_count) OVER (PARTITION BY symbol ORDER BY i ROWS 99 PRECEDING) AS burst FROM f")(lambda t: P.burstiness(t).select("symbol", "trade_id", "burst"))
query("ms11_farima_ms23_weights", """e AS (SELECT symbol, v, max(i) OVER (PARTITION BY symbol) - i AS k FROM f), fw AS (SELECT k, list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, k + 1), lambda j: (-(0.4 - j + 1) / j)::DOUBLE)), lambda a, b: a * b) AS w FROM (SELECT unnest(range(1, 500)) AS k))
  SELECT symbol, round(sum(w * v), 6) AS forecast FROM e JOIN fw ON e.k = fw.k GROUP BY symbol""")(P.farima_forecast)
query("ms12_propagator", "e AS (SELECT symbol, v, max(i) OVER (PARTITION BY symbol) - i AS k FROM f) SELECT symbol, round(sum(v / sqrt(k + 1)), 6) AS response FROM e WHERE k > 0 GROUP BY symbol")(P.propagator_response)
