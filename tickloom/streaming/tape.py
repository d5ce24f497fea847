"""The tape as a stream: clock bars under a watermark, and state kept for each symbol-day.

A stateful step gets one symbol-day's new rows in trade order and the state its last rows left; the state of a day is
dropped once the watermark is KEEP_MS past the day's last row. With ``by_day`` rows of a day must arrive in trade order over
batches (within a batch any order will do) and come out at once; with ``in_order`` they may come in any order until the watermark
has passed them, and come out then. ``run`` drains a stream into the shared folder and reads the rows back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickloom.shared import fresh_path
from tickloom.sources.tape import TAPE_COLUMNS

KEEP_MS = 2 * 86_400_000
WINDOW = 8
ALPHA, BETA = 0.8, 0.5


def stream_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: a plain path must be a folder
    return rows.selectExpr(*TAPE_COLUMNS).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "1 minute")


def shuffled_arrivals(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame], files: int = 4, late_ms: int = 86_400_000) -> DataFrame:
    """The operator's rows over the tape that arrives in ``files`` files, each trade up to ``late_ms`` after its time (by its id); the
    query is stopped after half of the files and started again from its checkpoint."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*TAPE_COLUMNS)
    arrival = F.col("ts_ms") + F.pmod(F.col("trade_id") * 7_919_117, F.lit(late_ms))
    lo, hi = rows.agg(F.min(arrival), F.max(arrival)).first()
    file = F.least(F.floor((arrival - lo) * files / (hi - lo + 1)), F.lit(files - 1))
    source, path = fresh_path(spark, "arrivals"), fresh_path(spark, "stream")
    out = None
    for k in range(files):
        rows.where(file == k).coalesce(1).write.mode("append").parquet(source)
        if k + 1 in (files // 2, files):
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", f"{late_ms} milliseconds")
            out = run(operator(stream), path)
    return out


def run(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Drains what has arrived into ``path`` (a new one, if not given), going on from the checkpoint there, and reads all rows back."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def clock_bars(trades: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars of the windows that the watermark has closed; open ones wait in the state."""
    at = F.struct("ts_ms", "trade_id", "px")
    bars = trades.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("qty").alias("vol"))
    return bars.select("symbol", F.unix_millis("w.start").alias("start_ms"), *((F.col(c) / 1e8).alias(n) for c, n in (("a.px", "open"), ("high", "high"), ("low", "low"), ("b.px", "close"), ("vol", "vol"))))


def by_day(trades: DataFrame, schema: str, state_schema: str, first: tuple, step: Callable) -> DataFrame:
    """step(rows of one symbol-day in trade order, state) -> (output columns, new state)."""

    def run_group(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values("trade_id", kind="stable")
        out, new = step(f, state.get if state.exists else first)
        state.update(new)
        state.setTimeoutTimestamp(int(f["ts_ms"].max()) + KEEP_MS)
        yield pd.DataFrame({"symbol": key[0], "trade_date": key[1], **out})

    columns = trades.select("symbol", "trade_date", "trade_id", "px", "qty", "flags", "ts_ms", "ts")
    return columns.groupBy("symbol", "trade_date").applyInPandasWithState(run_group, f"symbol string, trade_date date, {schema}", state_schema, "append", "EventTimeTimeout")


#: Columns of a row that waits for the watermark.
_HELD = ["trade_id", "px", "qty", "flags", "ts_ms"]


class InOrder(StatefulProcessor):
    """Steps through a symbol-day's rows in the order of time and trade id, whatever order they come in.

    A row waits in a list until the watermark has passed it; a timer stands at the first one that waits. Rows that come after the
    watermark are dropped by Spark. The day's state goes once nothing has waited for KEEP_MS.
    """

    def __init__(self, columns: list[str], state_schema: str, first: tuple, step: Callable):
        self.columns, self.state_schema, self.first, self.step = columns, state_schema, first, step

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.held = handle.getListState("held", "trade_id long, px long, qty long, flags int, ts_ms long")

    def _alarm(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        f = pd.concat(list(rows))
        new = [tuple(map(int, r)) for r in f[_HELD].itertuples(index=False)]
        earlier = [r[4] for r in self.held.get()] if self.held.exists() else []
        self.held.appendList(new)
        self._alarm(min(earlier + [r[4] for r in new]) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.held.get()) if self.held.exists() else []
        ready = sorted((r for r in held if r[4] < mark), key=lambda r: (r[4], r[0]))
        waits = [r for r in held if r[4] >= mark]
        if not ready and not waits:
            self.state.clear()
            self.held.clear()
            return iter([])
        if waits:
            self.held.put(waits)
        else:
            self.held.clear()
        self._alarm(min(r[4] for r in waits) + 1 if waits else ready[-1][4] + KEEP_MS)
        if not ready:
            return iter([])
        out, new = self.step(pd.DataFrame(ready, columns=_HELD), self.state.get() if self.state.exists() else self.first)
        self.state.update(tuple(new))
        return iter([pd.DataFrame({"symbol": key[0], "trade_date": key[1], **out})[self.columns]])

    def close(self) -> None:
        pass


def in_order(trades: DataFrame, schema: str, state_schema: str, first: tuple, step: Callable) -> DataFrame:
    """As ``by_day``, for rows in any order that come before the watermark has passed them; rows come out once it has."""
    spark = trades.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    whole = f"symbol string, trade_date date, {schema}"
    names = [c.split()[0] for c in whole.split(", ")]
    columns = trades.select("symbol", "trade_date", *_HELD, "ts")
    return columns.groupBy("symbol", "trade_date").transformWithStateInPandas(InOrder(names, state_schema, first, step), whole, "append", "eventTime")


def _g_inf(f, state):
    last, *sums = state
    x, q = f["px"].to_numpy() / 1e8, np.where(f["flags"].to_numpy() & 1, -1.0, 1.0) * f["qty"].to_numpy() / 1e8
    dx = np.diff(x, prepend=np.nan if last is None else last)
    ok = ~np.isnan(dx)
    d, w = np.where(ok, dx, 0.0), np.where(ok, q, 0.0)
    n, sx, sq, sxq, sqq = (np.cumsum(c) + s for c, s in zip((ok.astype(float), d, w, d * w, w * w), sums))
    var = n * sqq - sq * sq
    g = np.where(var > 1e-9, (n * sxq - sx * sq) / np.where(var > 1e-9, var, 1), np.nan)
    return {"trade_id": f["trade_id"].to_numpy(), "g_inf": g}, (float(x[-1]), *(float(c[-1]) for c in (n, sx, sq, sxq, sqq)))


def rolling_g_inf(trades: DataFrame, keeper: Callable = by_day) -> DataFrame:
    """Running Cov(price change, signed quantity) / Var(signed quantity); null while that variance is 0. ``keeper`` is ``by_day``
    or ``in_order``, here and below."""
    out = keeper(trades, "trade_id long, g_inf double", "px double, n double, sx double, sq double, sxq double, sqq double", (None, 0.0, 0.0, 0.0, 0.0, 0.0), _g_inf)
    return out.withColumn("g_inf", F.nanvl("g_inf", F.lit(None).cast("double")))


def _hawkes(alpha: float, beta: float):
    def step(f, state):
        last, b, s = state
        t, sell = beta * f["ts_ms"].to_numpy() / 1000.0, (f["flags"].to_numpy() & 1) == 1
        last, at = t[0] if last is None else last, 0
        buys, sells = np.empty(len(t)), np.empty(len(t))
        while at < len(t):  # rescaled before an exponential grows too large
            end = max(at + 1, int(np.searchsorted(t, t[at] + 30.0, "right")))
            grow, decay = np.exp(t[at:end] - t[at]), np.exp(min(0.0, last - t[at]))
            buys[at:end] = (b * decay + np.cumsum(np.where(sell[at:end], 0.0, alpha * grow))) / grow
            sells[at:end] = (s * decay + np.cumsum(np.where(sell[at:end], alpha * grow, 0.0))) / grow
            b, s, last, at = float(buys[end - 1]), float(sells[end - 1]), float(t[end - 1]), end
        return {"trade_id": f["trade_id"].to_numpy(), "buys": buys, "sells": sells}, (last, b, s)

    return step


def hawkes(trades: DataFrame, alpha: float = ALPHA, beta: float = BETA / 3600, keeper: Callable = by_day) -> DataFrame:
    """Intensities that jump by ``alpha`` at a trade of their side and decay by ``beta`` a second."""
    return keeper(trades, "trade_id long, buys double, sells double", "scaled_time double, buys double, sells double", (None, 0.0, 0.0), _hawkes(alpha, beta))


def _rolling(f, state):
    ring = list(state[0] or [])
    x = pd.Series([*ring, *(f["qty"].to_numpy() / 1e8)])
    r = x.rolling(WINDOW, min_periods=1)
    mean, var = r.mean(), r.var(ddof=0)
    z = np.where(var > 1e-12, (x - mean) / np.sqrt(var.where(var > 1e-12, 1)), 0.0)
    return {"trade_id": f["trade_id"].to_numpy(), "mean": mean.to_numpy()[len(ring) :], "z": z[len(ring) :]}, (x.to_list()[-WINDOW + 1 :],)


def rolling_window(trades: DataFrame, keeper: Callable = by_day) -> DataFrame:
    """Mean and z-score (population) of the quantity over the last WINDOW rows; z is 0 without variance."""
    return keeper(trades, "trade_id long, mean double, z double", "ring array<double>", ([],), _rolling)


_BAR = ("bar_no", "ts_start", "ts_end", "open", "high", "low", "close", "vol", "delta", "eff", "impact")


def _delta_bars(target: int):
    def step(f, state):
        bar, open_, t0, o, h, l, c, vol, net, path = state
        out = {n: [] for n in _BAR}
        for px, qty, flag, ts in zip(*(f[n].tolist() for n in ("px", "qty", "flags", "ts_ms"))):
            if not open_:
                open_, t0, o, h, l, c, vol, net, path = 1, ts, px, px, px, px, 0, 0, 0
            h, l, path, c = max(h, px), min(l, px), path + abs(px - c), px
            vol, net = vol + qty, net + (-qty if flag & 1 else qty)
            if abs(net) >= target:
                row = (bar, t0, ts, o / 1e8, h / 1e8, l / 1e8, c / 1e8, vol / 1e8, net / 1e8, abs(c - o) / path if path else 0.0, (c / 1e8 - o / 1e8) / (net / 1e8) if abs(net) > 0.1 else 0.0)
                for n, v in zip(_BAR, row):
                    out[n].append(v)
                bar, open_ = bar + 1, 0
        return out, (bar, open_, t0, o, h, l, c, vol, net, path)

    return step


def delta_bars(trades: DataFrame, threshold: float = 50.0, keeper: Callable = by_day) -> DataFrame:
    """As the batch operator; the open bar waits in the state, and bars never cross a day."""
    schema = "bar_no int, ts_start long, ts_end long, open double, high double, low double, close double, vol double, delta double, eff double, impact double"
    state = ", ".join(f"{n} long" for n in ("bar", "open_", "t0", "o", "h", "l", "c", "vol", "net", "path"))
    return keeper(trades, schema, state, (0,) * 10, _delta_bars(round(threshold * 1e8)))
