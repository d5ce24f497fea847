"""Selection, distance correlation, entropies, scorecards over shards and replayed ingest against plain computations."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_exact_quantiles_equal_percentile(spark):
    """One group with most rows and many ties, small ones, null keys and a NaN."""
    from tickloom.operators.quantiles import exact_quantiles, median_deviation

    d = spark.range(60_000).select(F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 250 > 0, F.concat(F.lit("k"), F.col("id") % 75)).alias("k"), (F.col("id") % 2).alias("j"), F.when(F.col("id") % 11 > 0, F.round(F.randn(3) * 30)).alias("x"))
    d = d.unionByName(spark.createDataFrame([("nan", 0, float("nan")), ("nan", 0, 1.0), ("none", 0, None)], "k string, j long, x double"))
    ps = {"lo": 0.0, "a": 0.01, "b": 0.25, "c": 0.5, "e": 0.999, "hi": 1.0}
    got = exact_quantiles(d, ["k", "j"], "x", **ps).toPandas()
    want = d.where("x is not null").groupBy("k", "j").agg(F.count("*").alias("n"), *[F.percentile("x", p).alias(n) for n, p in ps.items()]).toPandas()
    order = lambda f: f.assign(k=f["k"].fillna("")).sort_values(["k", "j"]).reset_index(drop=True)[["k", "j", "n", *ps]]
    assert len(got) == len(want) > 20 and order(got).equals(order(want))
    assert exact_quantiles(d.where("false"), ["k"], "x", a=0.5).count() == 0
    whole = exact_quantiles(d.where("k = 'hot'"), [], "x", a=0.5).first()["a"]
    assert whole == d.where("k = 'hot'").agg(F.percentile("x", 0.5)).first()[0]
    x = np.array([r[0] for r in d.where("k = 'hot' and x is not null").select("x").collect()])
    assert median_deviation(d.where("k = 'hot'"), ["k"], "x").first()["mad"] == np.median(np.abs(x - np.median(x)))
    with pytest.raises(ValueError):
        exact_quantiles(d, ["k"], "x", a=1.5)


def test_exact_bins_keep_equal_values_together(spark):
    from tickloom.operators.quantiles import exact_bins

    d = spark.createDataFrame([("a", float(i // 7)) for i in range(100)] + [("b", 1.0)] * 9 + [("b", None)], "k string, x double")
    rows = exact_bins(d, ["k"], "x", 4, "bin").collect()
    assert len(rows) == 110 and {r["bin"] for r in rows if r["k"] == "a"} == {0, 1, 2, 3} and {r["bin"] for r in rows if r["k"] == "b"} == {0, None}
    assert len({(r["x"], r["bin"]) for r in rows if r["k"] == "a"}) == 15


def plain_dcor(x, y):
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    scale = math.sqrt((a * a).mean() * (b * b).mean())
    return math.sqrt(max((a * b).mean(), 0) / scale) if scale > 1e-15 else 0.0


@pytest.mark.parametrize("size", [60, 10**6])
def test_distance_correlation_equals_the_double_loop(spark, size):
    from tickloom.operators.dependence import distance_correlation

    g = np.random.default_rng(1)
    x = g.normal(size=500).round(1)
    groups = {"curve": (x, (x * x + g.normal(size=500)).round(1)), "ties": (np.repeat([0.0, 1.0], 60), np.tile([0.0, 1.0, 2.0], 40)), "line": (np.arange(9.0), 5 - np.arange(9.0)), "flat": (np.ones(5), np.arange(5.0)), "two": (np.array([1.0, 2.0]), np.array([3.0, 1.0]))}
    rows = [(k, float(a), float(b)) for k, (xs, ys) in groups.items() for a, b in zip(xs, ys)] + [("one", 1.0, 2.0), ("none", None, 1.0), ("none", float("nan"), 1.0)]
    random.Random(2).shuffle(rows)
    got = {r["k"]: r["distance_correlation"] for r in distance_correlation(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"], size).collect()}
    assert set(got) == {*groups, "one"} and got["one"] is None
    for k, (xs, ys) in groups.items():
        assert got[k] == pytest.approx(plain_dcor(xs, ys), abs=1e-9), k


def test_concordant_pairs_of_a_million_rows():
    from tickloom.operators.dependence import concordant

    g = np.random.default_rng(0)
    x, y = g.normal(size=(2, 1_000_000))
    i, j = np.triu_indices(400, 1)
    dx, dy = x[j] - x[i], y[j] - y[i]
    assert concordant(x[:400], y[:400]) == pytest.approx((dx * dy)[dx * dy > 0].sum(), rel=1e-9)
    assert concordant(x, x) == pytest.approx(len(x) * (x * x).sum() - x.sum() ** 2, rel=1e-9)
    assert concordant(x, y) > 0


def test_boxes_and_entropies_equal_all_pairs(spark):
    from tickloom.operators import entropy as E

    g = np.random.default_rng(4)
    for n, d in ((1, 1), (2, 3), (7, 2), (300, 1), (301, 2), (257, 3)):
        for points in (g.normal(size=(n, d)).round(1), g.integers(0, 3, (n, d)).astype(float)):
            for r in (0.0, 0.3, 1.0):
                assert (E.count_boxes(points, r) == (np.abs(points[:, None] - points).max(2) <= r).sum(1)).all()

    def plain(x, m, r):
        t = lambda k, count: np.abs(np.stack([x[j : j + count] for j in range(k)], 1)[:, None] - np.stack([x[j : j + count] for j in range(k)], 1)).max(2) <= r
        phi = [np.log(t(k, len(x) - k + 1).mean(1)).mean() for k in (m, m + 1)]
        b, a = (t(k, len(x) - m).sum() - (len(x) - m) for k in (m, m + 1))
        return phi[0] - phi[1], -math.log(a / b) if a else None

    day = datetime.date(2024, 1, 1)
    series = {"noise": g.normal(size=200), "wave": np.sin(np.arange(150) / 3).round(2), "flat": np.ones(20), "apart": np.array([0.0, 9.0, 1.0, 50.0, 2.0]), "short": np.ones(3)}
    rows = [(k, day, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("noise", day, 10**6, None)]
    for m in (1, 2):
        got = {r["symbol"]: r for r in E.series_entropy(spark.createDataFrame(rows, "symbol string, trade_date date, i long, s double"), m=m).collect()}
        for k, x in series.items():
            want = plain(x, m, 0.2 * x.std()) if len(x) > m + 1 else (None, None)
            for name, w in zip(("approximate_entropy_signal", "sample_entropy_signal"), want):
                assert got[k][name] == (None if w is None else pytest.approx(w, abs=1e-9)), (m, k, name)


def test_a_sine_has_its_period_whole_or_in_chunks(spark, monkeypatch):
    from tickloom.operators import entropy, ticks

    rows = [(s, i + 1, 3 + math.sin(2 * math.pi * i / p)) for s, p in (("a", 12.0), ("b", 5.5)) for i in range(3000)] + [("c", i + 1, 1.0) for i in range(5)]
    d = spark.createDataFrame(rows, "symbol string, i long, s double")
    whole = {r["symbol"]: r["hilbert_dominant_cycle_period"] for r in entropy.dominant_cycle(d).collect()}
    assert whole["a"] == pytest.approx(12, rel=0.01) and whole["b"] == pytest.approx(5.5, rel=0.01) and whole["c"] is None
    real = ticks.in_chunks
    monkeypatch.setattr(entropy, "in_chunks", lambda rows, step, back, ahead=0: real(rows, step, back, ahead, 200))
    parts = {r["symbol"]: r["hilbert_dominant_cycle_period"] for r in entropy.dominant_cycle(d).collect()}
    assert parts["a"] == pytest.approx(whole["a"], rel=1e-9) and parts["b"] == pytest.approx(whole["b"], rel=1e-9)


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_paths_and_streaks_do_not_depend_on_shards(spark, shards):
    from tickloom.operators.scorecard import equity_paths, streaks

    r = random.Random(shards)
    pnl = {"a": [float(r.choice([-3, -2, -1, 0, 1, 2, 4])) for _ in range(120)], "up": [1.0] * 40, "down": [-1.0] * 40, "zero": [0.0] * 9}
    rows = [(s, i * shards // len(p), i, v) for s, p in pnl.items() for i, v in enumerate(p)]
    sim = spark.createDataFrame(rows, "symbol string, shard_id int, seq int, net_pnl_bps double")
    got = {(x["symbol"], x["seq"]): (x["rn"], x["n"], x["eq"], x["peak"], x["under"]) for x in equity_paths(sim).collect()}
    for s, p in pnl.items():
        eq = peak = last = 0
        for i, v in enumerate(p):
            eq += v
            if eq > peak:
                peak, last = eq, i + 1
            assert got[s, i] == (i + 1, len(p), eq, peak, i + 1 - last), (s, i)
    best = {x["symbol"]: (x["max_consecutive_wins"], x["max_consecutive_losses"]) for x in streaks(sim).collect()}
    for s, p in pnl.items():
        signs = "".join("w" if v > 0 else "l" for v in p if v)
        if signs:
            assert best[s] == tuple(max(map(len, signs.replace("l" if k == "w" else "w", " ").split()), default=0) for k in "wl"), s
    assert "zero" not in best


def test_rolling_vpin_takes_full_buckets_only(spark):
    from tickloom.operators.primitives import rolling_vpin

    day, r = datetime.date(2024, 1, 1), random.Random(1)
    rows = [("s", day if i < 50 else day + datetime.timedelta(1), i, i + 1, r.randint(1, 9), r.choice([-1, 1]), 1.0) for i in range(100)]
    t = spark.createDataFrame(rows, "symbol string, trade_date date, trade_id long, i long, qty long, sign int, p double")
    got = {x["i"]: x["vpin"] for x in rolling_vpin(t, size=20, window=3).collect()}
    units = [s for *_, q, s, _ in rows for _ in range(q)]
    bucket = lambda b: abs(sum(units[20 * b : 20 * b + 20])) / 20
    done = 0
    for *_, i, q, _, _ in rows:
        done += q
        last = done // 20 - 1
        want = np.mean([bucket(b) for b in range(max(0, last - 2), last + 1)]) if last >= 0 else None
        assert got[i] == (None if want is None else pytest.approx(want)), i


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    from tickloom.sources.tape import read_agg_trades_csv

    t = 1761091200000
    (tmp_path / "a.csv").write_text(f"agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n1,2.5,3.5,10,11,{t},true\n")
    (tmp_path / "b.csv").write_text(f'"Is Buyer Maker",Price,"Extra, one",Quantity,FIRST_TRADE_ID,lasttradeid,Transact_Time,isbuyermaker,id\nx,4.5,no,5.5,20,22,{t},false,2\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n")
    got = sorted((r["trade_id"], r["px"], r["qty"], r["first_id"], r["trade_count"], r["flags"]) for r in read_agg_trades_csv(spark, str(tmp_path), "B").collect())
    assert got == [(1, 250000000, 350000000, 10, 2, 1), (2, 450000000, 550000000, 20, 3, 0)]


def test_ingest_replayed_and_corrected(spark, tmp_path):
    from tickloom.sources.tape import day_manifest, ingest_stream, stream_trades, verify_days

    schema = "symbol string, trade_date date, trade_id long, px long, qty long, first_id long, trade_count long, flags int, ts_ms long"
    day = datetime.date(2024, 1, 1)
    row = lambda i, px=100, d=0: ("s", day + datetime.timedelta(d), i, px, 5, i, 1, 0, i)
    source, path, manifest = (str(tmp_path / n) for n in ("in", "out", "manifest"))

    def arrive(rows, checkpoint):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest_stream(stream_trades(spark, source, spark.createDataFrame([], schema).schema), path, manifest, str(tmp_path / checkpoint)).awaitTermination()
        stored = spark.read.parquet(path)
        assert verify_days(stored, spark.read.parquet(manifest)).count() == 0
        return sorted((r["trade_id"], r["px"]) for r in stored.collect()), sorted(map(str, day_manifest(stored).collect()))

    first = arrive([row(1), row(2), row(3, d=1)], "a")
    assert first[0] == [(1, 100), (2, 100), (3, 100)]
    assert arrive([], "a") == first and arrive([], "b") == first  # nothing new; all once more
    second = arrive([row(2, px=90), row(4)], "a")  # a corrected row and a late one of a stored day
    assert second[0] == [(1, 100), (2, 90), (3, 100), (4, 100)]


def test_calendar_ends(spark):
    from tickloom.sources.tape import day_calendar

    assert [str(r[0]) for r in day_calendar(spark, "2024-02-28", "2024-03-01").collect()] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert day_calendar(spark, "2024-02-28", "2024-02-27").count() == 0
    assert day_calendar(spark).agg(F.max("trade_date")).first()[0] == datetime.datetime.now(datetime.timezone.utc).date() - datetime.timedelta(days=1)


def _trades(n, seed, days=1, big=0.01):
    r = random.Random(seed)
    return [("s" if i % 3 else "t", datetime.date(2024, 1, 1 + i * days // n), i, 10**10 + r.randint(-40, 40) * 10**7, r.randint(1, 300) * 10**6 if r.random() > big else 40 * 10**8, i, 1, int(r.random() < 0.55), 1_704_067_200_000 + i * 1000) for i in range(n)]


TAPE = "symbol string, trade_date date, trade_id long, px long, qty long, first_id long, trade_count long, flags int, ts_ms long"


@pytest.mark.parametrize("threshold", [1.0, 30.0])
def test_bars_of_a_day_in_ranges_equal_those_of_the_whole(spark, threshold):
    from tickloom.operators import bars, chunked_bars

    t = spark.createDataFrame(_trades(2500, 1) + [("one", datetime.date(2024, 1, 1), 1, 5, 10**12, 1, 1, 0, 1)], TAPE)
    rows = lambda d: sorted(map(tuple, d.collect()))
    want = rows(bars.delta_bars(t, threshold))
    got = rows(chunked_bars.delta_bars(t, threshold, 50))  # some 50 ranges
    assert len(want) > 20 and len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)
    assert chunked_bars.delta_bars(t.where("false"), threshold).count() == 0


def test_a_stream_in_any_order_restarted_and_its_late_rows(spark, tmp_path):
    """Two runs from one checkpoint; a row in front of the watermark's place is dropped, all others count in order of time."""
    from tickloom.streaming import tape as S

    rows = _trades(200, 2)
    r, source = random.Random(3), str(tmp_path / "in")
    late = ("s", datetime.date(2024, 1, 1), 10**6, 1, 1, 1, 1, 0, rows[0][8])
    end = ("end", datetime.date(2024, 1, 1), 10**7, 1, 1, 1, 1, 0, rows[-1][8] + 10**6)
    parts = [rows[20:120], rows[:20] + rows[120:150], rows[150:] + [late], [end]]
    got = None
    for k, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, TAPE).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):
            stream = spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "120 seconds")
            got = S.run(S.rolling_window(stream, keeper=S.in_order), str(tmp_path / "out"))
    got = {x["trade_id"]: x["mean"] for x in got.collect()}
    assert set(got) == {x[2] for x in rows}
    for symbol in "st":
        q = [x[4] / 1e8 for x in rows if x[0] == symbol]
        for i, x in enumerate(x for x in rows if x[0] == symbol):
            assert got[x[2]] == pytest.approx(np.mean(q[max(0, i - 7) : i + 1])), x[2]


def test_interval_sums_equal_a_range_join(spark):
    from tickloom.operators.orders import interval_sums, slippage_curve

    r = random.Random(9)
    points = [(r.choice("ab"), r.randrange(0, 900_000), float(r.randrange(1, 9))) for _ in range(400)] + [("a", 60_000, 5.0), ("a", 119_999, 7.0)]
    spans = [("a", 60_000, 119_999), ("a", 60_000, 60_000), ("b", 0, 900_000), ("b", 0, 900_000), ("c", 0, 9), ("a", 9, 3), ("a", None, 3), (None, 1, 3)] + [("b", s := r.randrange(900_000), s + r.randrange(400_000)) for _ in range(40)]
    got = interval_sums(spark.createDataFrame(spans, "symbol string, start long, stop long"), spark.createDataFrame(points, "symbol string, ts_ms long, q double"), {"q": F.col("q"), "n": F.lit(1)}).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = [(k, a, b, sum(q for s, t, q in points if s == k and a <= t <= b) if k and a is not None else 0, sum(s == k and a <= t <= b for s, t, _ in points) if k and a is not None else 0) for k, a, b in spans]
    assert sorted(map(tuple, ((x["symbol"], x["start"], x["stop"], x["q"], x["n"]) for x in got)), key=lambda x: str(key(x))) == sorted(want, key=lambda x: str(key(x)))
    orders = spark.createDataFrame([("s", 1, 100.0, 100.0 + k / 100, float(k), 100.0) for k in range(1, 11)] + [("s", 1, 100.0, None, 0.0, 5.0)], "symbol string, side int, decision double, fill_px double, filled double, volume double")
    curve = {x["participation_bin"]: (x["n"], round(x["slippage_bps"], 6)) for x in slippage_curve(orders, 2).collect()}
    assert curve == {0: (5, 3.0), 1: (5, 8.0)}


def test_plans_take_other_parameters(spark):
    from tickloom.plans import signals

    t = spark.createDataFrame(_trades(400, 5, days=2, big=0.0), TAPE)
    rows = {}
    for x in sorted(t.collect(), key=lambda x: x["trade_id"]):
        rows.setdefault((x["symbol"], x["trade_date"]), []).append(x)
    for short, ahead in ((8, 4), (5, 2)):
        pairs = {}
        for (symbol, _), day in rows.items():
            v = np.array([(1 - 2 * x["flags"]) * x["qty"] / 1e8 for x in day])
            p = np.log([x["px"] for x in day])
            for i in range(short, len(day) - ahead):  # as in the plan, the first window has a row before it
                pairs.setdefault(symbol, []).append((v[i - short + 1 : i + 1].mean(), p[i + ahead] - p[i]))
        got = {x["symbol"]: x["ic_pearson"] for x in signals.over(t, "pp1_ic_pearson", short=short, ahead=ahead).collect()}
        for symbol, xy in pairs.items():
            assert got[symbol] == pytest.approx(np.corrcoef(np.array(xy).T)[0, 1], abs=1e-5), (symbol, short)
    bars = signals.over(t, "win21_volume_bars", bucket=10**9).toPandas()
    assert bars.groupby(["symbol", "trade_date"])["vol"].sum().sum() == pytest.approx(sum(x["qty"] for day in rows.values() for x in day) / 1e8)
    assert bars["vol"].max() == pytest.approx(10.0)
    with pytest.raises(ValueError):
        signals.over(t, "pp1_ic_pearson", width=3)


def test_rolling_g_of_equal_volumes_is_not_a_number(spark):
    """As in the SQL: a day may begin with trades of one size and side, whose variance is 0."""
    from tickloom.plans import signals

    day = datetime.date(2024, 1, 1)
    volumes = [5, 2, 2, 2, 3, 1]
    rows = [("a", day, k, (100 + k * k) * 10**8, q * 10**8, k, 1, 0, 1000 * k) for k, q in enumerate(volumes)]
    got = [x["g"] for x in signals.over(spark.createDataFrame(rows, TAPE), "ms19_rolling_g_inf").orderBy("trade_id").collect()]
    dx = np.diff([100.0 + k * k for k in range(6)])
    assert got[0] is None and math.isnan(got[1]) and math.isnan(got[2])
    for k in (4, 5):
        c = np.cov(dx[:k], volumes[1 : k + 1])
        assert got[k - 1] == pytest.approx(c[0, 1] / c[1, 1], abs=1e-6)


def test_interval_sums_do_not_hang_on_how_rows_are_dealt(spark):
    """Spark computes the intervals twice, once with a long column: in another number of partitions then."""
    from tickloom.operators.orders import interval_sums

    conf = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        points = spark.range(2000).select(F.lit("s").alias("symbol"), (F.col("id") * 60_000).alias("ts_ms"), F.col("id").alias("q"))
        long = F.concat(*[F.sha2(F.concat_ws(":", F.lit(k), "id"), 256) for k in range(8)])
        intervals = spark.range(2000).select(F.lit("s").alias("symbol"), "id", (F.col("id") * 60_000).alias("start"), (F.col("id") * 60_000 + 60_000).alias("stop"), long.alias("note")).repartition("start")
        got = interval_sums(intervals, points, {"q": F.col("q")}).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(got) == 2000 and {x["id"]: x["q"] for x in got} == {k: 2 * k + 1 if k < 1999 else k for k in range(2000)}


def test_equal_shares_are_one_bin_of_the_slippage_curve(spark):
    """0.1 + 0.2 of 0.9 and 0.3 of 0.9 are one share."""
    from tickloom.operators.orders import slippage_curve

    orders = spark.createDataFrame([("s", 1, 100.0, 100.0, 0.1 + 0.2 if k % 2 else 0.3, 0.9) for k in range(20)], "symbol string, side int, decision double, fill_px double, filled double, volume double")
    assert [(x["participation_bin"], x["n"]) for x in slippage_curve(orders).collect()] == [(0, 20)]
