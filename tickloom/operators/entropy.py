"""Approximate and sample entropy without pairs of templates, and the dominant cycle of a signal.

Templates of m rows are points of m dimensions; those within r of one (in every coordinate) are the points of a box around it. Boxes
are counted for all points at once: in two dimensions by a wavelet matrix of the ranks of the second coordinate in the order of the
first, in three by a segment tree over the first coordinate whose levels each hold the points of a segment in the order of the second.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ticks import in_chunks


def count_below(values: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each (from, to, limit) of arrays: how many of values[from:to] are below limit. Values: whole numbers from 0, all below len(values).

    A wavelet matrix: values are parted by a bit, the highest first, and every query follows its two ends to where they go.
    """
    n = len(values)
    state = [[a.copy(), b.copy(), c, np.zeros(len(a), np.int64)] for a, b, c in queries]
    for bit in range(max(n, 1).bit_length() - 1, -1, -1):
        zero = ((values >> bit) & 1) == 0
        before = np.r_[0, np.cumsum(zero)]
        zeros = before[-1]
        for s in state:
            a, b, limit, count = s
            za, zb = before[a], before[b]
            one = ((limit >> bit) & 1) == 1
            count += np.where(one, zb - za, 0)
            s[0], s[1] = np.where(one, zeros + a - za, za), np.where(one, zeros + b - zb, zb)
        values = np.concatenate([values[zero], values[~zero]])
    return [s[3] for s in state]


def _ranks(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value's rank (ties apart), and the ranks from and up to which values lie within r of it."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    u, at = np.unique(x, return_inverse=True)
    edge = np.r_[np.searchsorted(x[order], u, "left"), len(x)]  # where each different value begins in the order
    lo, hi = np.searchsorted(u, u - r, "left"), np.searchsorted(u, u + r, "right")
    for _ in range(2):  # |a - b| <= r as it is computed: sums round otherwise by one value at most
        lo = np.where((lo > 0) & (u - u[np.maximum(lo - 1, 0)] <= r), lo - 1, lo)
        lo = np.where(u - u[np.minimum(lo, len(u) - 1)] > r, lo + 1, lo)
        hi = np.where((hi < len(u)) & (u[np.minimum(hi, len(u) - 1)] - u <= r), hi + 1, hi)
        hi = np.where(u[hi - 1] - u > r, hi - 1, hi)
    return rank, edge[lo][at], edge[hi][at]


def count_boxes(points: np.ndarray, r: float) -> np.ndarray:
    """For each point (a row; one to three coordinates) the points, itself included, that differ by at most r in every coordinate."""
    n, d = points.shape
    ranks = [_ranks(points[:, k], r) for k in range(d)]
    if d == 1:
        return ranks[0][2] - ranks[0][1]
    first, lo, hi = ranks[0]
    order = np.argsort(first)
    if d == 2:
        below = count_below(ranks[1][0][order], [(lo, hi, ranks[1][2]), (lo, hi, ranks[1][1])])
        return below[0] - below[1]
    if d > 3:
        raise ValueError("templates of one to three rows")
    total = np.zeros(n, np.int64)
    second, third = ranks[1][0][order], ranks[2][0][order]
    lo, hi = lo.copy(), hi.copy()
    level = 0
    while (lo < hi).any():  # a range of the first coordinate is at most two segments of each level
        segment = np.arange(n) >> level
        inside = np.lexsort((second, segment))
        key = segment[inside] * (n + 1) + second[inside]
        queries = []
        for side in (0, 1):
            use = np.flatnonzero((lo < hi) & (((lo if side == 0 else hi) & 1) == 1))
            which = lo[use] if side == 0 else hi[use] - 1
            a = np.searchsorted(key, which * (n + 1) + ranks[1][1][use], "left")
            b = np.searchsorted(key, which * (n + 1) + ranks[1][2][use], "left")
            queries.append((use, [(a, b, ranks[2][2][use]), (a, b, ranks[2][1][use])]))
        counts = iter(count_below(third[inside], [q for _, two in queries for q in two]))
        for use, _ in queries:
            total[use] += next(counts) - next(counts)
        lo, hi, level = (lo + 1) >> 1, hi >> 1, level + 1
    return total


def _templates(x: np.ndarray, m: int, count: int) -> np.ndarray:
    return np.stack([x[k : k + count] for k in range(m)], axis=1)


def approximate_entropy(x: np.ndarray, m: int, r: float) -> float:
    phi = [np.log(count_boxes(_templates(x, k, len(x) - k + 1), r) / (len(x) - k + 1)).mean() for k in (m, m + 1)]
    return float(phi[0] - phi[1])


def sample_entropy(x: np.ndarray, m: int, r: float) -> float | None:
    """None if no two templates of m + 1 rows are within r."""
    count = len(x) - m
    short, long = (int(count_boxes(_templates(x, k, count), r).sum()) - count for k in (m, m + 1))
    return -math.log(long / short) if long > 0 else None


def series_entropy(panel: DataFrame, column: str = "s", m: int = 2, tolerance: float = 0.2, keys=("symbol", "trade_date"), order: str = "i") -> DataFrame:
    """The keys, approximate_entropy_signal and sample_entropy_signal of each series, whole, with r = tolerance * its (population) deviation.

    ``m`` is 1 or 2. Nulls and NaN are left out. Both are null for series of m + 1 rows or fewer, the latter also if it is infinite.
    """
    if m not in (1, 2):
        raise ValueError("m is 1 or 2")
    keys = list(keys)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("_o", kind="stable")["_v"].to_numpy(dtype=float)
        r = tolerance * x.std()
        out = (approximate_entropy(x, m, r), sample_entropy(x, m, r)) if len(x) > m + 1 else (None, None)
        return f[keys].head(1).assign(approximate_entropy_signal=out[0], sample_entropy_signal=out[1])

    rows = panel.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*keys, F.col(order).alias("_o"), F.col(column).cast("double").alias("_v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*keys).schema)
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, approximate_entropy_signal double, sample_entropy_signal double")


def dominant_cycle(panel: DataFrame, column: str = "s", reach: int = 15) -> DataFrame:
    """(symbol, hilbert_dominant_cycle_period), in rows: of the analytic signal of ``column`` less its mean, 2 pi over the mean phase step
    weighted by amplitude.

    The quadrature part is a Hilbert filter of ``reach`` rows on both sides (2 / (pi k) at odd k, tapered by a raised cosine), so
    that a row depends on its neighbours alone and chunks give what the whole series gives. Rows without all neighbours are left out;
    null if there are none or if the phase does not move. Cycles much longer than ``reach`` are damped in the quadrature part.
    """
    mean = panel.groupBy("symbol").agg(F.avg(column).alias("_m"))
    rows = panel.join(mean, "symbol").withColumn("_v", F.col(column) - F.col("_m"))
    taps = {k: 2 / (math.pi * k) * (0.5 + 0.5 * math.cos(math.pi * k / (reach + 1))) for k in range(1, reach + 1, 2)}

    def step(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_q", sum(F.lit(h) * (F.lag("_v", k).over(w) - F.lead("_v", k).over(w)) for k, h in taps.items()))
        return d.withColumns({"_v1": F.lag("_v").over(w), "_q1": F.lag("_q").over(w)})

    d = in_chunks(rows, step, reach + 1, reach).where("_q is not null and _q1 is not null")
    d = d.groupBy("symbol").agg(F.sum(F.col("_v") * F.col("_v1") + F.col("_q") * F.col("_q1")).alias("_re"), F.sum(F.col("_q") * F.col("_v1") - F.col("_v") * F.col("_q1")).alias("_im"))
    angle = F.abs(F.atan2("_im", "_re"))
    return panel.select("symbol").distinct().join(d, "symbol", "left").select("symbol", F.when(angle > 0, 2 * math.pi / angle).alias("hilbert_dominant_cycle_period"))
