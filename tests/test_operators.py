"""Hand-worked cases and brute-force comparisons of the tick, impact and catalogue operators."""

import io
import math
import random
import zipfile

import numpy as np
import pytest

RAW = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n"
SCHEMA = "symbol string, trade_date date, trade_id long, px long, qty long, first_id long, trade_count long, flags int, ts_ms long"


def tape(spark, n=600, symbols=2, seed=1, gap=9000):
    import datetime

    r, rows, t = random.Random(seed), [], 1_700_000_000_000
    for i in range(n):
        t += r.choice([0, 1, 50, gap, 40 * gap])
        day = datetime.datetime.fromtimestamp(t / 1000, datetime.UTC).date()
        rows.append((f"s{i % symbols}", day, i, 10**10 + r.randint(-40, 40) * 10**7, r.randint(1, 300) * 10**6, i * 3, r.randint(1, 4), r.randint(0, 1), t))
    return spark.createDataFrame(rows, SCHEMA)


def test_ingest_skips_rows_and_gives_up_poisoned_days(spark, tmp_path):
    from tickloom.sources.tape import ingest_status, poisoned_days, read_agg_trades_csv, read_agg_trades_zip, unzipped

    day1, day2 = 1761091200000, 1761091200000 + 86_400_000
    good = [f'"{i}","108253.{i}",0.01,{10 * i},{10 * i + 1},{day1 + i},true' for i in range(1, 4)]
    bad = [f"7,nan,0.01,1,2,{day1},true", f"8,1.0,0.01,5,4,{day1},true", f"x,1.0,0.01,1,2,{day1},true", "9,1.0"]
    other = [f"20,1.0,0.01,1,2,{day2},true", f"21,inf,0.01,1,2,{day2},true"]
    text = RAW + "\n".join([*good, *bad, *other]) + "\n"
    (tmp_path / "day.csv").write_text(text)
    rows = read_agg_trades_csv(spark, str(tmp_path / "day.csv"), "B").orderBy("trade_id").collect()
    assert [r["trade_id"] for r in rows] == [1, 2, 3] and rows[0]["px"] == 10825310000000 and all(r["px"] is not None for r in rows)
    for k, (name, content) in enumerate({"a": text, "b": "", "c": RAW}.items()):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x.csv", content)
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    assert sorted(r["trade_id"] for r in read_agg_trades_zip(spark, str(tmp_path), "B").collect()) == [1, 2, 3]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x.csv", RAW + f"1,-1.0,0.01,1,2,{day1},true\n")
    raw = unzipped(spark.createDataFrame([(bytearray(data.getvalue()),)], "content binary"))
    assert poisoned_days(raw, "B").count() == 1
    calendar = spark.sql("select 'B' symbol, explode(sequence(date'2025-10-21', date'2025-10-24')) trade_date")
    parsed, poisoned = read_agg_trades_csv(spark, str(tmp_path / "day.csv"), "B"), spark.sql("select 'B' symbol, date'2025-10-23' trade_date")
    status = ingest_status(calendar, calendar.where("trade_date = '2025-10-21'"), parsed, poisoned)
    assert [r["status"] for r in status.orderBy("trade_date").collect()] == ["skip", "ok", "error", "missing"]


def test_chunks_give_the_whole_result(spark):
    from tickloom.operators import ticks as T

    t = T.features(tape(spark)).cache()
    for online in (False, True):
        args = {"short": 5, "medium": 16, "long": 24, "smooth": 4, "online": online}
        whole = {r["trade_id"]: (r["k1"], r["k3"], r["k4"]) for r in T.kernels(t, **args, size=10**6).collect()}
        cut = {r["trade_id"]: (r["k1"], r["k3"], r["k4"]) for r in T.kernels(t, **args, size=1).collect()}
        assert whole.keys() == cut.keys() and len(whole) == 600
        for k, v in whole.items():
            for a, b in zip(v, cut[k]):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)
    assert sum(v[2] is not None for v in whole.values()) == 600


def test_features_run_over_days_and_places_count_all_rows(spark):
    from tickloom.operators import ticks as T

    rows = T.features(tape(spark)).orderBy("symbol", "i").collect()
    assert [r["i"] for r in rows if r["symbol"] == "s0"] == list(range(1, 301)) and len({r["trade_date"] for r in rows}) > 1
    for a, b in zip(rows, rows[1:]):
        if a["symbol"] == b["symbol"]:
            assert abs(b["r"] - math.log(b["px"] / a["px"])) < 1e-12 and b["dt"] == (b["ts_ms"] - a["ts_ms"]) / 1000


@pytest.mark.parametrize("strict", [False, True])
def test_asof_over_buckets_equals_brute_force(spark, strict):
    from tickloom.operators.ticks import asof

    r = random.Random(2)
    left = [("k", r.randint(0, 100), i) for i in range(60)] + [("q", 5, 900)]
    right = [("k", r.randint(0, 100), i, float(i)) for i in range(15)]
    got = asof(spark.createDataFrame(left, "key string, ts_ms long, id int"), spark.createDataFrame(right, "key string, ts_ms long, trade_id int, v double"), "ts_ms", ["v"], ["key"], strict=strict, bucket_ms=7)
    for x in got.collect():
        before = [(t, i, v) for k, t, i, v in right if k == x["key"] and (t < x["ts_ms"] if strict else t <= x["ts_ms"])]
        assert x["v"] == (max(before)[2] if before else None)


def test_regime_of_a_known_block(spark):
    from tickloom.operators import ticks as T

    t = T.features(tape(spark, 260, 1))
    x = [r["x"] for r in t.orderBy("i").collect()]
    (row,) = T.regime(t, 200).collect()
    s = [np.std([x[i] - x[i - k] for i in range(k, 200)]) for k in (5, 10, 20)]
    assert abs(row["hurst"] - 2 * np.polyfit(np.log([5, 10, 20]), np.log(s), 1)[0]) < 1e-9
    assert abs(row["efficiency"] - (x[199] - x[0]) / np.abs(np.diff(x[:200])).sum()) < 1e-9
    assert row["ts_ms"] == t.where("i = 201").first()["ts_ms"]


def test_rules_at_their_bounds(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import ticks as T

    d = spark.createDataFrame([(1.5, 1.0, -1.5), (1.5, 1.01, -1.51), (1.5, 2.0, 0.0), (3.0, 2.1, 0.0), (-9.0, None, 0.0)], "k1 double, k3 double, k4 double")
    k1, k3, k4 = F.col("k1"), F.col("k3"), F.col("k4")
    got = d.select(T.composite_alpha(k1, k3, k4).alias("a"), T.trade_signal(k1, F.lit(2.0)).alias("t"), T.position_scale(k3, k4).alias("p")).collect()
    assert [r["a"] for r in got] == [1.5, 0.0, 0.75, pytest.approx(0.6), -9.0]
    assert [r["t"] for r in got] == [2.0, 2.0, 2.0, 2.0, -2.0] and [r["p"] for r in got] == [0.0, 0.0, 0.5, 0.5, None]


@pytest.mark.parametrize("beta", [0.001, 1.0, 50.0])
def test_hawkes_intensity_equals_the_recursion(spark, beta):
    from tickloom.operators import primitives as P
    from tickloom.operators import ticks as T

    t = T.features(tape(spark, 400, 1, gap=60_000))
    got = {r["trade_id"]: (r["buys"], r["sells"]) for r in P.hawkes_intensity(t, 0.8, beta).collect()}
    last, state = None, [0.0, 0.0]
    for r in t.orderBy("i").collect():
        if last is None or last["trade_date"] != r["trade_date"]:
            state = [0.0, 0.0]
        else:
            state = [v * math.exp(-beta * (r["ts_ms"] - last["ts_ms"]) / 1000) for v in state]
        state[r["sign"] < 0] += 0.8
        last = r
        assert got[r["trade_id"]] == pytest.approx(tuple(state), rel=1e-9, abs=1e-12)


def test_exit_rules(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import bars as B

    close = [1000.0, 1004.0, 1004.1, 990.0, 1000.0] + [1000.0] * 200 + [1010.0]
    rows = [("a", 0, None, i, i * 1000, c, 1.0, 0.0, 1 if i in (0, 2, 4) else 0) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, shard_id int, trade_date date, bar_no int, ts_end long, close double, eff double, impact double, s int")
    sim = lambda **k: [(r["entry_ts"], r["exit_ts"]) for r in B.backtest(bars, signal=lambda: F.col("s"), **k).orderBy("seq").collect()]
    # 40 is no exit, 41 is; the bar of an exit may be an entry; the last exit lies far behind
    assert sim() == [(0, 2000), (2000, 3000), (4000, 205_000)]
    assert sim(leave=lambda roi, held: held >= 2) == [(0, 2000), (2000, 4000), (4000, 6000)]
    numbers = B.backtest(bars, signal=lambda: F.col("s"), bar_numbers=True).orderBy("seq").collect()
    assert [(r["entry_bar"], r["exit_bar"]) for r in numbers] == [(0, 2), (2, 3), (4, 205)]


def test_volume_bars_split_trades_and_pairs_within(spark):
    from tickloom.operators import primitives as P
    from tickloom.operators import ticks as T

    t = T.features(tape(spark, 200, 2))
    bars = P.volume_bars(t, size=5 * 10**8).collect()
    assert all(abs(b["vol"] - 5) < 1e-9 for b in bars if b["bucket"] < max(x["bucket"] for x in bars if x["symbol"] == b["symbol"]))
    assert abs(sum(b["vol"] for b in bars) - sum(r["q"] for r in t.collect())) < 1e-6
    r = random.Random(3)
    points = [(i, r.uniform(-2, 2), r.uniform(-2, 2)) for i in range(150)] + [(150, 0.0, 0.0), (151, 0.0, 0.0)]
    got = {(x["id_a"], x["id_b"]) for x in P.pairs_within(spark.createDataFrame(points, "id int, a double, b double"), ["a", "b"], 0.3).collect()}
    assert got == {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 < 0.09}


def test_catalogue_against_plain_computation(spark):
    from tickloom.operators import catalogue as C
    from tickloom.operators import ticks as T

    panel = C.signal_panel(T.features(tape(spark, 400, 2))).cache()
    rows = panel.orderBy("symbol", "i").collect()
    tau = {(r["symbol"], r["trade_date"]): r["ic_kendall_tau"] for r in C.kendall_tau(panel).collect()}
    for key in tau:
        part = [(r["s"], r["rf"]) for r in rows if (r["symbol"], r["trade_date"]) == key]
        sign = [np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for i, a in enumerate(part) for b in part[:i]]
        assert tau[key] is None and not sign or tau[key] == pytest.approx(sum(sign) / len(sign))
    pnl = C.daily_pnl(panel)
    days = {}
    for r in pnl.collect():
        days.setdefault(r["trade_date"], {})[r["symbol"]] = r["p"]
    both = np.array([[v["s0"], v["s1"]] for v in days.values() if len(v) == 2])
    value, vector = np.linalg.eigh(np.cov(both.T))
    got = {r["alpha_id"]: r for r in C.principal_component(pnl.withColumnRenamed("symbol", "alpha_id")).collect()}
    assert got["s0"]["pca_explained_variance_share"] == pytest.approx(value[-1] / value.sum(), abs=0.15)
    assert abs(abs(got["s0"]["pca_loading_on_first_component"]) - abs(vector[0, -1])) < 0.3
    for r in C.granger(panel).collect():
        assert r["pvalue"] == pytest.approx(math.erfc(math.sqrt(max(r["f"], 0) / 2)))
    for r in C.deflated_sharpe(pnl, 20, 0.01).collect():
        assert 0 <= r["deflated_sharpe"] <= 1
    w = spark.range(20_000).select(C.poisson_weight(C.F.lit(3), C.F.col("id")).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] / 20_000 for r in w}
    assert all(abs(counts[k] - math.exp(-1) / math.factorial(k)) < 0.02 for k in range(4))


def test_old_layout_and_verification(spark):
    from tickloom.sources.tape import day_manifest, upgrade_agg2, verify_days

    t = tape(spark, 50, 1)
    old = t.selectExpr("symbol", "trade_date", "trade_id", "px", "qty", "first_id", "cast(trade_count as int) as count", "0 as flags", "ts_ms", "1 - flags as side")
    assert sorted(map(tuple, upgrade_agg2(old).collect())) == sorted(map(tuple, t.collect()))
    assert verify_days(t, day_manifest(t), tick=10**7).count() == 0
    assert verify_days(t.withColumn("px", one_off(t)), day_manifest(t), tick=10**7).where("off_tick > 0").count() >= 1


def one_off(t):
    from pyspark.sql import functions as F

    return F.col("px") + F.when(F.col("trade_id") == 3, 1).otherwise(0)


def test_shuffled_ic_equals_a_plain_permutation_and_repeats_no_rows(spark, tmp_path):
    """Also from a small file, which Spark would send to the driver and to all tasks with every replicate's rows."""
    import datetime
    import hashlib

    from tickloom.operators.catalogue import shuffle_ic_pvalue

    r = random.Random(4)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    rows = [("a", day(k % 3), 7 * k, x := r.gauss(0, 1), 0.2 * x + r.gauss(0, 1)) for k in range(90)] + [("one a day", day(k), k, r.gauss(0, 1), r.gauss(0, 1)) for k in range(25)] + [("flat", day(k % 2), k, 0.1, r.gauss(0, 1)) for k in range(30)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "symbol string, trade_date date, trade_id long, s double, rf double").repartition(3).write.parquet(str(tmp_path / "panel"))
    out = shuffle_ic_pvalue(spark.read.parquet(str(tmp_path / "panel")), 20)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x["symbol"]: (x["ic"], x["mc_shuffle_ic_pvalue"]) for x in out.collect()}
    own = sorted((x for x in rows if x[0] == "a"), key=lambda x: x[1:3])
    ic = np.corrcoef([x[3] for x in own], [x[4] for x in own])[0, 1]
    drawn = [[x[4] for k in range(3) for x in sorted((x for x in own if x[1] == day(k)), key=lambda x: hashlib.md5(f"{rep}:{x[2]}".encode()).hexdigest())] for rep in range(1, 21)]
    larger = sum(abs(np.corrcoef([x[3] for x in own], y)[0, 1]) >= abs(ic) for y in drawn)
    assert got["a"] == pytest.approx((ic, (larger + 1) / 21)) and 0 < larger < 20
    assert got["one a day"][1] == 1  # each permutation is the one that is
    assert math.isnan(got["flat"][0]) and got["flat"][1] == 1


def test_complexity_of_a_long_day(spark):
    """60,000 rows in seconds (a median for each row took minutes), with the phrases of a plain dictionary."""
    import time

    from tickloom.operators.catalogue import complexity

    def phrases(bits):
        seen, now = set(), ""
        for c in bits:
            now += c
            if now not in seen:
                seen.add(now)
                now = ""
        return len(seen) + bool(now)

    n, g = 60_000, np.random.default_rng(3)
    days = {"noise": g.normal(size=n), "wave": np.sin(np.arange(n) / 7), "steps": (np.arange(n) % 1000 > 900).astype(float), "flat": np.zeros(n), "short": np.arange(16.0), "odd": g.normal(size=17)}
    rows = [(k, i, float(v)) for k, x in days.items() for i, v in enumerate(x)]
    import pandas as pd

    panel = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "i", "s"])).selectExpr("symbol", "date'2024-01-01' trade_date", "i", "s").cache()
    panel.count()
    began = time.time()
    got = {x["symbol"]: x for x in complexity(panel).collect()}
    assert time.time() - began < 30
    for k, x in days.items():
        if k == "short":
            assert got[k]["lempel_ziv_complexity_signal"] is None
        else:
            want = phrases(np.where(x > np.median(x), "1", "0")) / (len(x) / math.log2(len(x)))
            assert got[k]["lempel_ziv_complexity_signal"] == pytest.approx(want, rel=1e-12), k
    assert got["wave"]["spectral_density_peak_freq"] == pytest.approx(1 / (14 * math.pi), abs=1e-4)
