"""The further plans against their SQL on the smallest tape."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tickloom.streaming import tape as streaming

SF = "/root/testdata/sf0.001"
NAMES = ["src9_days_to_ingest", "win11_k4_spec", "ms11_farima_ms23_weights", "ms14_hawkes_intensity", "ms29_resilience_time", "join9_quote_join", "join10_order_fill", "pp9_hac_tstat", "tc2_turnover"]


def same(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(str([None if v is None else float(v) + 0.0 if isinstance(v, (int, float)) else str(v)[:10] for v in r]) for r in got.select(names).collect())
    sql = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows == sorted(str([None if v is None else float(v) + 0.0 if isinstance(v, (int, float)) else str(v)[:10] for v in r]) for r in sql) and rows


@pytest.mark.parametrize("name", NAMES)
def test_plan_matches_sql(spark, name):
    same(spark, name)


@pytest.mark.parametrize("name", ["str1_stream_rolling_g_inf", "str2_stream_hawkes", "str3_stream_delta_bars", "str4_stream_rolling_window", "str5_stream_clock_bars"])
def test_stream_matches_sql(spark, name):
    same(spark, name)


@pytest.mark.parametrize("step,first", [(streaming._g_inf, (None, 0.0, 0.0, 0.0, 0.0, 0.0)), (streaming._hawkes(0.8, 0.002), (None, 0.0, 0.0)), (streaming._rolling, ([],)), (streaming._delta_bars(300), (0,) * 10)])
def test_state_carries_over_batches(step, first):
    """A day that comes in pieces gives the rows of the whole day."""
    rng = np.random.default_rng(1)
    n = 200
    day = pd.DataFrame({"trade_id": np.arange(n), "px": rng.integers(100, 120, n) * 10**8, "qty": rng.integers(1, 99, n), "flags": rng.integers(0, 2, n), "ts_ms": np.cumsum(rng.integers(0, 90_000, n))})
    whole = pd.DataFrame(step(day, first)[0])
    state, parts = first, []
    for a, b in ((0, 1), (1, 7), (7, 120), (120, n)):
        out, state = step(day[a:b], state)
        parts.append(pd.DataFrame(out))
    pieces = pd.concat([x for x in parts if len(x)], ignore_index=True)
    assert len(pieces) == len(whole) > 0
    np.testing.assert_allclose(pieces.astype(float), whole.astype(float), rtol=1e-8, atol=1e-8, equal_nan=True)
