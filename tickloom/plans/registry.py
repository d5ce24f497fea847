"""Queries over the trade tape and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import chunked_bars, rolling, scorecard
from tickloom.sources.tape import tape
from tickloom.streaming import tape as streaming

from . import kernels, metrics, oracles, panels, panels_more, selected, signals, sources  # noqa: F401  (the panels add their plans to those of signals)

THRESHOLD, SHARDS = 1.0, 4


def _bars(spark, sf_dir):
    return B.delta_bars(tape(spark, sf_dir), THRESHOLD)


def _sharded(spark, sf_dir):
    return B.assign_shards(_bars(spark, sf_dir), SHARDS)


def _sim(spark, sf_dir):
    return B.backtest(_sharded(spark, sf_dir))


def _round(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _ledger(spark, sf_dir):
    ticks = tape(spark, sf_dir).select("symbol", "trade_date", F.col("trade_id").alias("i"), (F.col("px") / 1e8).alias("price"), (F.col("trade_id") % 3 - 1).alias("sig"))
    return _round(B.cash_position_ledger(ticks))


def _grid(spark, sf_dir):
    grid = spark.createDataFrame([(1, 36.0, -13.5, 5.0), (2, 40.0, -15.0, 5.0), (3, 44.0, -16.5, 5.0)], "param_id int, tp double, sl double, cost double")
    return _round(B.sweep(_sharded(spark, sf_dir), grid)).groupBy("param_id", "symbol").agg(F.count("*").alias("trades"), F.round(F.sum("net_pnl_bps"), 4).alias("pnl"))


def _rolling(spark, sf_dir):
    t = tape(spark, sf_dir).withColumn("sv", F.when(F.col("flags").bitwiseAND(1) == 1, -F.col("qty")).otherwise(F.col("qty")))
    out = rolling.rolling_sums(t, {"net": "sv"}, 128, ["symbol", "trade_date"], "trade_id")
    return out.select("symbol", "trade_id", "net", "n_rows")


def _stream(operator):
    return lambda s, d: _round(streaming.run(operator(streaming.stream_tape(s, d))))


def _any_order(operator):
    return lambda s, d: _round(streaming.shuffled_arrivals(s, d, lambda t: operator(t, keeper=streaming.in_order)))


QUERIES = {
    "seq1_delta_bars": lambda s, d: _round(_bars(s, d)),
    "seq1_delta_bars_in_ranges": lambda s, d: _round(chunked_bars.delta_bars(tape(s, d), THRESHOLD, 2_000)),
    "prj11_absorption_signal": lambda s, d: _bars(s, d).select("symbol", "trade_date", "bar_no", B.absorption_signal().alias("signal")),
    "seq5_assign_shards": lambda s, d: _sharded(s, d).select("symbol", "trade_date", "shard_id").distinct(),
    "seq4_backtest": lambda s, d: _round(_sim(s, d)),
    "seq6_ledger": _ledger,
    "seq7_sweep": _grid,
    "sc_scorecard": lambda s, d: scorecard.scorecard(_sim(s, d)),
    "sc14_scorecard_long": lambda s, d: scorecard.scorecard_long(scorecard.scorecard(_sim(s, d))),
    "win5_rolling_prefix": _rolling,
    "str1_stream_rolling_g_inf": _stream(streaming.rolling_g_inf),
    "str2_stream_hawkes": _stream(streaming.hawkes),
    "str3_stream_delta_bars": _stream(lambda t: streaming.delta_bars(t, THRESHOLD)),
    "str4_stream_rolling_window": _stream(streaming.rolling_window),
    "str5_stream_clock_bars": _stream(streaming.clock_bars),
    "str1_stream_any_order": _any_order(streaming.rolling_g_inf),
    "str2_stream_any_order": _any_order(streaming.hawkes),
    "str3_stream_any_order": _any_order(lambda t, keeper: streaming.delta_bars(t, THRESHOLD, keeper)),
    "str4_stream_any_order": _any_order(streaming.rolling_window),
} | {n: signals.query(n) for n in signals.PLANS} | kernels.QUERIES | metrics.QUERIES | sources.QUERIES | selected.QUERIES

ORACLES = oracles.CORE | oracles.STREAMS | {n: signals.text(n, signals.Duck).replace("AS STRING", "AS VARCHAR") for n in signals.PLANS} | kernels.ORACLES | metrics.ORACLES | sources.ORACLES
