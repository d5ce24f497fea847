"""Event bars, rule signal, shards, backtest, ledger and sweep. State that resets on the data runs in grouped maps,
one group a symbol and day (bars) or a symbol and shard (backtest)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, trade_date date, bar_no int, ts_start long, ts_end long, open double, high double, low double, close double, vol double, delta double, eff double, impact double"


def delta_bars(trades: DataFrame, threshold: float = 50.0) -> DataFrame:
    """A bar closes at the first trade with |buys - sells| >= threshold; the unfinished tail of a day is dropped."""
    target = round(threshold * 1e8)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("trade_id", kind="stable")
        px, qty, ts = f["px"].to_numpy(), f["qty"].to_numpy(), f["ts_ms"].to_numpy()
        net = np.cumsum(np.where(f["flags"].to_numpy() & 1, -qty, qty))
        ends, base, at, width = [], 0, 0, 64
        while at < len(net):
            hit = np.flatnonzero(np.abs(net[at : at + width] - base) >= target)
            if len(hit):
                at += int(hit[0]) + 1
                ends.append(at - 1)
                base, width = net[at - 1], 64
            else:  # look on from here; the bar's base stays
                at += width
                width *= 2
        if not ends:
            return pd.DataFrame(columns=[c.split()[0] for c in BAR_SCHEMA.split(", ")])
        e = np.array(ends)
        s = np.r_[0, e[:-1] + 1]
        step = np.abs(np.diff(px, prepend=px[0]))
        step[s] = 0
        k = e[-1] + 1
        path, vol = np.add.reduceat(step[:k], s), np.add.reduceat(qty[:k], s)
        delta = net[e] - np.r_[0, net[e[:-1]]]
        o, c = px[s], px[e]
        d = delta / 1e8
        with np.errstate(divide="ignore", invalid="ignore"):
            eff = np.where(path > 0, np.abs(c - o) / path, 0.0)
            imp = np.where(np.abs(d) > 1e-9, (c / 1e8 - o / 1e8) / d, 0.0)
        return pd.DataFrame({"symbol": f["symbol"].iat[0], "trade_date": f["trade_date"].iat[0], "bar_no": np.arange(len(e)), "ts_start": ts[s], "ts_end": ts[e], "open": o / 1e8, "high": np.maximum.reduceat(px[:k], s) / 1e8, "low": np.minimum.reduceat(px[:k], s) / 1e8, "close": c / 1e8, "vol": vol / 1e8, "delta": d, "eff": eff, "impact": imp})

    return trades.select("symbol", "trade_date", "trade_id", "px", "qty", "flags", "ts_ms").groupBy("symbol", "trade_date").applyInPandas(run, BAR_SCHEMA)


def absorption_signal() -> Column:
    up, down = (F.col("delta") > 0) & (F.col("close") > F.col("open")), (F.col("delta") < 0) & (F.col("close") < F.col("open"))
    return F.when(F.col("eff") > 0.6, F.when(up, 1).when(down, -1).otherwise(0)).when(F.col("eff") < 0.25, -F.signum("delta")).otherwise(0).cast("int")


def assign_shards(bars: DataFrame, n: int = 24) -> DataFrame:
    """Contiguous day shards of each symbol; the days are few and come back by a join."""
    days = bars.select("symbol", "trade_date").distinct().withColumn("shard_id", F.ntile(n).over(Window.partitionBy("symbol").orderBy("trade_date")))
    return bars.join(days, ["symbol", "trade_date"])


SIM_SCHEMA = "symbol string, shard_id int, seq int, entry_ts long, exit_ts long, net_pnl_bps double, side int, k1 double, k3 double"
#: Says for some bars after an entry (moves in basis points for the position, bars held) at which the position is closed.
ExitRule = Callable[[np.ndarray, np.ndarray], np.ndarray]


def tp_sl(tp: float, sl: float) -> ExitRule:
    return lambda roi, held: (roi > tp) | (roi < sl)


def _simulate(f: pd.DataFrame, leave: ExitRule, cost: float) -> list[tuple]:
    """One open position; the exit test comes before the entry, which may follow on the same bar. The exit is looked for in
    doubling steps, so that the work is in proportion to the bars held."""
    c, sig, ts = f["close"].to_numpy(), f["signal"].to_numpy(), f["ts_end"].to_numpy()
    entries, out, at = np.flatnonzero(sig != 0), [], 0
    while True:
        k = np.searchsorted(entries, at)
        if k == len(entries):
            return out
        i = int(entries[k])
        lo, width, end = i + 1, 64, None
        while lo < len(c):
            hi = min(lo + width, len(c))
            roi = (c[lo:hi] - c[i]) / c[i] * 10000.0 * sig[i]
            hit = np.flatnonzero(leave(roi, np.arange(lo - i, hi - i)))
            if len(hit):
                end = lo + int(hit[0])
                break
            lo, width = hi, width * 2
        if end is None:
            return out
        at = end
        out.append((int(ts[i]), int(ts[at]), float(roi[hit[0]] - cost), int(sig[i]), float(f["eff"].iat[i]), float(f["impact"].iat[i]), i, at))


_SIM = ["entry_ts", "exit_ts", "net_pnl_bps", "side", "k1", "k3", "entry_bar", "exit_bar"]


def backtest(bars: DataFrame, tp: float = 40.0, sl: float = -15.0, cost: float = 5.0, signal: Callable[[], Column] = absorption_signal, leave: ExitRule | None = None, bar_numbers: bool = False) -> DataFrame:
    """Simulated trades of bars with a shard_id; a position open at a shard's end is discarded. ``signal`` is the entry rule,
    ``leave`` the exit rule (tp and sl, if not given); with ``bar_numbers`` also the shard's bars (from 0) of entry and exit."""
    leave = leave or tp_sl(tp, sl)
    schema = SIM_SCHEMA + ", entry_bar int, exit_bar int" * bar_numbers

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["trade_date", "bar_no"], kind="stable")
        out = pd.DataFrame(_simulate(f, leave, cost), columns=_SIM)
        if not bar_numbers:
            out = out[_SIM[:6]]
        out.insert(0, "seq", np.arange(len(out)))
        out.insert(0, "shard_id", f["shard_id"].iat[0])
        out.insert(0, "symbol", f["symbol"].iat[0])
        return out

    slim = bars.withColumn("signal", signal()).select("symbol", "shard_id", "trade_date", "bar_no", "ts_end", "close", "eff", "impact", "signal")
    return slim.groupBy("symbol", "shard_id").applyInPandas(run, schema)


def sweep(bars: DataFrame, grid: DataFrame, signal: Callable[[], Column] = absorption_signal) -> DataFrame:
    """The backtest for each row of a small grid (param_id, tp, sl, cost), keyed by parameter, symbol and shard. A shard's bars
    are read once for all parameters."""
    params = [tuple(r) for r in grid.select("param_id", "tp", "sl", "cost").collect()]  # the caller's small table

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["trade_date", "bar_no"], kind="stable")
        parts = []
        for param, tp, sl, cost in params:
            out = pd.DataFrame(_simulate(f, tp_sl(tp, sl), cost), columns=_SIM)[_SIM[:4]]
            out.insert(0, "seq", np.arange(len(out)))
            for name, value in (("shard_id", f["shard_id"].iat[0]), ("symbol", f["symbol"].iat[0]), ("param_id", param)):
                out.insert(0, name, value)
            parts.append(out)
        return pd.concat(parts)

    slim = bars.withColumn("signal", signal()).select("symbol", "shard_id", "trade_date", "bar_no", "ts_end", "close", "eff", "impact", "signal")
    return slim.groupBy("symbol", "shard_id").applyInPandas(run, "param_id int, symbol string, shard_id int, seq int, entry_ts long, exit_ts long, net_pnl_bps double, side int")


def cash_position_ledger(ticks: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """Buy one at sig 1 with enough cash, sell one at sig -1 with a position; final value of each (symbol, trade_date).

    What a tick does depends on all before it, so a day is one walk; its ticks are streamed in order and no task holds them."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, money, pos, p, done = None, cash, 0, 0.0, []
        for b in frames:
            for now, p_now, s in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if now != key:
                    if key is not None:
                        done.append((*key, money + pos * p))
                    key, money, pos = now, cash, 0
                p = p_now
                if s == 1 and money > p:
                    pos, money = pos + 1, money - p
                elif s == -1 and pos > 0:
                    pos, money = pos - 1, money + p
            yield rows(done)
            done = []
        yield rows(done if key is None else [(*key, money + pos * p)])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done) if done else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.date32(), pa.float64()))], ["symbol", "trade_date", "final_value"])

    sorted_ = ticks.repartition("symbol", "trade_date").sortWithinPartitions("symbol", "trade_date", "i")
    return sorted_.select("symbol", "trade_date", F.col("price").cast("double"), "sig").mapInArrow(run, "symbol string, trade_date date, final_value double")
