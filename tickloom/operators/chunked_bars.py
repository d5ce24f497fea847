"""Delta bars of symbol-days that no task holds.

A day is cut into ranges of trades. What a range does to a bar that is open when it begins depends on one number, the net volume at the
last bar's end (the base): the first trade whose net volume is the threshold away from it closes the bar, and all later ends in the
range follow from that trade. Such trades are new highs or lows of the net volume, so a range is summed up by its highs and lows, each with
the base that is in force behind the range if the first bar ends there. These summaries are composed in order; then every range cuts
its trades into pieces of bars, and pieces of one bar are added up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.shared import written

KEYS = ["symbol", "trade_date"]
_KEY = "symbol string, trade_date date"


def next_end(net: np.ndarray, at: int, base: int, target: int) -> int:
    """The first place from ``at`` on where the net volume is ``target`` or more from ``base``; -1 if there is none. Searched in doubling steps."""
    width = 64
    while at < len(net):
        hit = np.flatnonzero(np.abs(net[at : at + width] - base) >= target)
        if len(hit):
            return at + int(hit[0])
        at, width = at + width, width * 2
    return -1


def ends_from(net: np.ndarray, first: int, target: int, known: dict | None = None) -> list[int]:
    """The ends that follow from an end at ``first``, itself included; up to one that is ``known``."""
    out = [first]
    while (k := next_end(net, out[-1] + 1, int(net[out[-1]]), target)) >= 0:
        out.append(k)
        if known is not None and k in known:
            break
    return out


def summary(net: np.ndarray, before: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where the first bar of the range can end, the last end that follows from each, and how many ends that are (ways that
    meet are followed once). ``before``: the net volume in front of the range, less than ``target`` from any base."""
    high, low = np.maximum.accumulate(net), np.minimum.accumulate(net)
    new = np.r_[True, high[1:] > high[:-1]] & (high > before) | np.r_[True, low[1:] < low[:-1]] & (low < before)
    # twice the target away every bar has ended
    far = np.flatnonzero(np.abs(net - before) >= 2 * target)
    places = np.flatnonzero(new[: int(far[0]) + 1] if len(far) else new)
    known: dict[int, tuple[int, int]] = {}
    for k in places[::-1].tolist():
        if k not in known:
            way = ends_from(net, k, target, known)
            last, more = known.get(way[-1], (way[-1], 1))
            for i, e in enumerate(way):
                known[e] = (last, len(way) - 1 - i + more)
    found = np.array([known[k] for k in places.tolist()], np.int64).reshape(-1, 2)
    return places, found[:, 0], found[:, 1]


def _ranges(trades: DataFrame, rows: int) -> DataFrame:
    """The trades with _part (their range) and _net0 and _px0, the net volume and the price before it (null: none) on that day."""
    signed = F.when(F.col("flags").bitwiseAND(1) == 1, -F.col("qty")).otherwise(F.col("qty"))
    d = trades.select(*KEYS, "trade_id", "px", "qty", "ts_ms", signed.alias("_v"))
    parts = max(1, -(-d.count() // rows))
    d = written(d.repartitionByRange(parts, *KEYS, "trade_id").withColumn("_part", F.spark_partition_id()), "trades")
    per = d.groupBy(*KEYS, "_part").agg(F.sum("_v").alias("_s"), F.max_by("px", "trade_id").alias("_p"))
    w = Window.partitionBy(*KEYS).orderBy("_part")
    carry = per.select(*KEYS, "_part", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_net0"), F.lag("_p").over(w).alias("_px0"))
    return d.join(carry, [*KEYS, "_part"])


def _sorted(f: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    f = f.sort_values("trade_id", kind="stable")
    return f, np.cumsum(f["_v"].to_numpy()) + int(f["_net0"].iat[0])


def _entry_bases(ranges: DataFrame, target: int) -> DataFrame:
    """keys, _part, _base, _fresh (a bar begins with the range), _bars (ends before it)."""

    def sum_up(f: pd.DataFrame) -> pd.DataFrame:
        f, net = _sorted(f)
        places, last, ends = summary(net, int(f["_net0"].iat[0]), target)
        return f[KEYS].head(1).assign(_part=f["_part"].iat[0], value=[net[places]], base=[net[last]], whole=[last == len(net) - 1], ends=[ends])

    sums = ranges.groupBy(*KEYS, "_part").applyInPandas(sum_up, f"{_KEY}, _part int, value array<long>, base array<long>, whole array<boolean>, ends array<long>")

    def composed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_part", kind="stable")
        base, fresh, bars, out = 0, True, 0, []
        for part, value, bases, whole, ends in zip(f["_part"], f["value"], f["base"], f["whole"], f["ends"]):
            out.append((part, base, fresh, bars))
            hit = np.flatnonzero(np.abs(np.asarray(value, np.int64) - base) >= target)
            if len(hit):
                k = int(hit[0])
                base, fresh, bars = int(bases[k]), bool(whole[k]), bars + int(ends[k])
            else:
                fresh = False
        o = pd.DataFrame(out, columns=["_part", "_base", "_fresh", "_bars"])
        return o.assign(symbol=f["symbol"].iat[0], trade_date=f["trade_date"].iat[0])[[*KEYS, "_part", "_base", "_fresh", "_bars"]]

    return sums.groupBy(*KEYS).applyInPandas(composed, f"{_KEY}, _part int, _base long, _fresh boolean, _bars long")


def delta_bars(trades: DataFrame, threshold: float = 50.0, rows: int = 1_000_000) -> DataFrame:
    """As ``bars.delta_bars``, with days cut into ranges of about ``rows`` trades (a day's trade ids differ)."""
    target = round(threshold * 1e8)
    ranges = _ranges(trades, rows)
    entries = _entry_bases(ranges, target)

    def cut(f: pd.DataFrame) -> pd.DataFrame:
        f, net = _sorted(f)
        px, qty, ts = f["px"].to_numpy(), f["qty"].to_numpy(), f["ts_ms"].to_numpy()
        first = next_end(net, 0, int(f["_base"].iat[0]), target)
        e = np.array(ends_from(net, first, target) if first >= 0 else [], np.int64)
        s = np.r_[0, e + 1]
        s = s[s < len(net)]
        before = f["_px0"].iat[0]
        step = np.abs(np.diff(px, prepend=px[0]))
        step[s[1:]] = 0
        if not f["_fresh"].iat[0] and before == before:
            step[0] = abs(px[0] - int(before))
        end = np.r_[s[1:] - 1, len(net) - 1]
        volume = np.add.reduceat(f["_v"].to_numpy(), s)
        return pd.DataFrame({"symbol": f["symbol"].iat[0], "trade_date": f["trade_date"].iat[0], "bar_no": int(f["_bars"].iat[0]) + np.arange(len(s)), "_part": f["_part"].iat[0], "done": np.isin(end, e), "ts0": ts[s], "ts1": ts[end], "o": px[s], "c": px[end], "h": np.maximum.reduceat(px, s), "l": np.minimum.reduceat(px, s), "v": np.add.reduceat(qty, s), "d": volume, "p": np.add.reduceat(step, s)})

    pieces = ranges.join(entries, [*KEYS, "_part"]).groupBy(*KEYS, "_part").applyInPandas(cut, f"{_KEY}, bar_no long, _part int, done boolean, ts0 long, ts1 long, o long, c long, h long, l long, v long, d long, p long")
    b = pieces.groupBy(*KEYS, "bar_no").agg(F.max("done").alias("done"), F.min_by("ts0", "_part").alias("ts_start"), F.max_by("ts1", "_part").alias("ts_end"), F.min_by("o", "_part").alias("o"), F.max_by("c", "_part").alias("c"), F.max("h").alias("h"), F.min("l").alias("l"), F.sum("v").alias("v"), F.sum("d").alias("d"), F.sum("p").alias("p")).where("done")
    net, scaled = F.col("d") / 1e8, lambda c: F.col(c) / 1e8
    return b.select(
        *KEYS, F.col("bar_no").cast("int").alias("bar_no"), "ts_start", "ts_end", scaled("o").alias("open"), scaled("h").alias("high"), scaled("l").alias("low"), scaled("c").alias("close"), scaled("v").alias("vol"), net.alias("delta"),
        F.when(F.col("p") > 0, F.abs(F.col("c") - F.col("o")) / F.col("p")).otherwise(0.0).alias("eff"), F.when(F.abs(net) > 1e-9, (scaled("c") - scaled("o")) / net).otherwise(0.0).alias("impact"),
    )
