"""Queries of the readers and writers. Their files are made from the tape: as text with malformed rows, zipped, in the old layout."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import ticks as T
from tickloom.shared import fresh_path
from tickloom.sources import tape as S
from tickloom.streaming import tape as streaming

from . import oracles
from .kernels import BASE, REF, _zo, features, rounded
from .signals import TAPE_DUCK

TRADES = "symbol, trade_date, trade_id, px, qty, first_id, trade_count, flags, ts_ms"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = f"WITH {TAPE_DUCK} {sql}" if sql.startswith("SELECT") else sql if sql.startswith("WITH") else f"WITH {TAPE_DUCK}, {sql}"
        return f

    return keep


def raw(spark, sf_dir: str) -> DataFrame:
    """The tape as text, with rows that have no price, no id or a count below 1, and a few days with an endless price."""
    t = S.tape(spark, sf_dir)
    text = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(S.SCALE).cast("decimal(20,0)")).cast("decimal(20,8)").cast("string")
    d = t.select("symbol", "trade_date", F.col("trade_id").cast("string").alias("agg_trade_id"), text("px").alias("price"), text("qty").alias("quantity"), F.col("first_id").cast("string").alias("first_trade_id"), (F.col("first_id") + F.col("trade_count") - 1).cast("string").alias("last_trade_id"), F.col("ts_ms").cast("string").alias("transact_time"), (F.col("flags") == 1).cast("string").alias("is_buyer_maker"), F.col("trade_id").alias("_t"))
    bad = d.where("_t % 50 = 7").withColumn("price", F.lit("nan")).unionByName(d.where("_t % 50 = 13").withColumn("agg_trade_id", F.lit("x1"))).unionByName(d.where("_t % 50 = 21").withColumn("last_trade_id", F.lit("0"))).unionByName(d.where("_t % 997 = 5").withColumn("price", F.lit("inf")))
    return d.unionByName(bad).drop("_t")


_GOOD = "bad AS (SELECT DISTINCT symbol, trade_date FROM tape WHERE trade_id % 997 = 5), good AS (SELECT * FROM tape WHERE (symbol, trade_date) NOT IN (SELECT (symbol, trade_date) FROM bad))"


@query("src1_prj_csv", f"{_GOOD} SELECT {TRADES} FROM good")
def _(spark, sf_dir):
    path = fresh_path(spark, "csv")
    raw(spark, sf_dir).drop("trade_date").withColumnsRenamed({"agg_trade_id": "Agg_Trade_Id", "price": " price"}).write.partitionBy("symbol").option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return S.read_agg_trades_csv(spark, path)


@query("src2_zip", f"{_GOOD} SELECT {TRADES} FROM good")
def _(spark, sf_dir):
    def pack(f: pd.DataFrame) -> pd.DataFrame:
        text, data = io.StringIO(), io.BytesIO()
        w = csv.writer(text, quoting=csv.QUOTE_ALL)
        w.writerow(S.RAW_NAMES)
        w.writerows(f[S.RAW_NAMES].itertuples(index=False))
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "x")
            z.writestr("day.csv", text.getvalue())
        return pd.DataFrame({"symbol": [f["symbol"].iat[0]], "content": [data.getvalue()]})

    zips = raw(spark, sf_dir).groupBy("symbol", "trade_date").applyInPandas(pack, "symbol string, content binary")
    return S.parse_trades(S.unzipped(zips, keep=["symbol"]))


@query("src3_src4_set1_round_trip", f"SELECT {TRADES} FROM tape WHERE month(trade_date) = 1 AND year(trade_date) = 2024 AND symbol <> 'click'")
def _(spark, sf_dir):
    path = fresh_path(spark, "trades")
    t = S.tape(spark, sf_dir)
    S.write_trades(t, path)
    S.write_trades(t.where("day(trade_date) = 3"), path)  # a day is replaced whole
    symbols = [r[0] for r in t.select("symbol").distinct().collect() if r[0] != "click"]
    return S.read_trades(spark, path, symbols, months=[(2024, 1)]).select(*TRADES.split(", "))


@query("src5_fn5_day_manifest", "SELECT symbol, trade_date, count(*) AS row_count, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, sum(('0x' || substr(md5(concat_ws(',', trade_id, px, qty, first_id, trade_count, flags, ts_ms)), 1, 8))::BIGINT)::BIGINT AS checksum FROM tape GROUP BY 1, 2")
def _(spark, sf_dir):
    return S.day_manifest(S.tape(spark, sf_dir))


@query("src6_available_years", "SELECT DISTINCT year(trade_date)::INTEGER AS year FROM tape")
def _(spark, sf_dir):
    return S.day_manifest(S.tape(spark, sf_dir)).select(F.year("trade_date").alias("year")).distinct().orderBy("year")


@query("src10_ingest_status", f"""{_GOOD}, cal AS (SELECT s.symbol, d::DATE AS trade_date FROM (SELECT DISTINCT symbol FROM tape) s, (SELECT unnest(generate_series(min(trade_date), max(trade_date) + 3, INTERVAL 1 DAY)) AS d FROM tape))
  SELECT symbol, trade_date, CASE WHEN day(trade_date) % 7 = 0 THEN 'skip' WHEN (symbol, trade_date) IN (SELECT (symbol, trade_date) FROM bad) THEN 'error' WHEN (symbol, trade_date) IN (SELECT (symbol, trade_date) FROM tape) THEN 'ok' ELSE 'missing' END AS status FROM cal""")
def _(spark, sf_dir):
    text, t = raw(spark, sf_dir), S.tape(spark, sf_dir)
    span = t.agg(F.min("trade_date").alias("a"), F.date_add(F.max("trade_date"), 3).alias("b"))
    calendar = t.select("symbol").distinct().join(F.broadcast(span)).select("symbol", F.explode(F.sequence("a", "b")).alias("trade_date"))
    before = calendar.where("day(trade_date) % 7 = 0")
    return S.ingest_status(calendar, before, S.parse_trades(text), S.poisoned_days(text))


@query("src11_verify_days", """now AS (SELECT symbol, trade_date, count(*) AS n, count(*) FILTER (trade_id % 499 = 4) AS off FROM tape WHERE trade_id % 499 <> 3 GROUP BY 1, 2), was AS (SELECT symbol, trade_date, count(*) AS n FROM tape GROUP BY 1, 2)
  SELECT symbol, trade_date, was.n AS row_count, now.n AS row_count_now, coalesce(off, 0) AS off_tick FROM was LEFT JOIN now USING (symbol, trade_date) WHERE was.n <> now.n OR off > 0 OR now.n IS NULL""")
def _(spark, sf_dir):
    t = S.tape(spark, sf_dir)
    changed = t.where("trade_id % 499 <> 3").withColumn("px", F.col("px") + F.when(F.col("trade_id") % 499 == 4, 1).otherwise(0))
    return S.verify_days(changed, S.day_manifest(t), tick=1_000_000).select("symbol", "trade_date", "row_count", "row_count_now", "off_tick")


@query("src12_bars_round_trip", f"WITH RECURSIVE {oracles.BARS} SELECT symbol, trade_date, bar_no, round(open, 6) AS open, round(close, 6) AS close, round(vol, 6) AS vol, round(delta, 6) AS delta FROM bars")
def _(spark, sf_dir):
    path = fresh_path(spark, "bars")
    S.write_bars(B.delta_bars(S.tape(spark, sf_dir), 1.0), path)
    return rounded(S.read_bars(spark, path).select("symbol", "trade_date", "bar_no", "open", "close", "vol", "delta"))


@query("src13_write_features", f"WITH {BASE}, g AS (SELECT *, sum(qty * sign) OVER (PARTITION BY symbol ORDER BY i ROWS 63 PRECEDING) / 1e8 AS ofi, coalesce(v / sqrt(greatest(dt, 0.001)), 0) AS spd FROM f) SELECT symbol, trade_date, trade_id, 0e0 + round(0.75 * ({_zo('ofi', REF['medium'])}) + 0.25 * ({_zo('spd', REF['medium'])}), 3) AS alpha FROM g")
def _(spark, sf_dir):
    path = fresh_path(spark, "features")
    S.write_features(T.kernels(features(spark, sf_dir), **REF, online=True, which=["k1"]).withColumnRenamed("k1", "alpha"), path)
    return rounded(spark.read.parquet(path).select("symbol", "trade_date", "trade_id", "alpha"), 3)


@query("src14_stream_trades", f"SELECT {TRADES} FROM tape")
def _(spark, sf_dir):
    path, t = fresh_path(spark, "trades"), S.tape(spark, sf_dir)
    S.write_trades(t, path)
    return streaming.run(S.stream_trades(spark, path, t.schema)).select(*TRADES.split(", "))


@query("src14_ingest_replayed", "SELECT symbol, trade_date, count(*) AS row_count, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, sum(('0x' || substr(md5(concat_ws(',', trade_id, px, qty, first_id, trade_count, flags, ts_ms)), 1, 8))::BIGINT)::BIGINT AS checksum, count(*) AS stored FROM tape GROUP BY 1, 2")
def _(spark, sf_dir):
    """Half of the rows, then all of them, then all once more under another checkpoint."""
    t = S.tape(spark, sf_dir)
    arrived, path, manifest = (fresh_path(spark, n) for n in ("arrived", "trades", "manifest"))
    for part, checkpoint in ((t.where("trade_id % 2 = 0"), "a"), (t.where("trade_id % 2 = 1"), "a"), (None, "b")):
        if part is not None:
            part.coalesce(2).write.mode("append").parquet(arrived)
        S.ingest_stream(S.stream_trades(spark, arrived, t.schema), path, manifest, f"{path}-{checkpoint}").awaitTermination()
    stored = spark.read.parquet(path).groupBy("symbol", "trade_date").agg(F.count("*").alias("stored"))
    return spark.read.parquet(manifest).join(stored, ["symbol", "trade_date"]).select("symbol", "trade_date", "row_count", "min_ts", "max_ts", "checksum", "stored")


@query("src1_mixed_headers", f"SELECT {TRADES} FROM tape")
def _(spark, sf_dir):
    """Files of three headers in one path: in order, in another order under other spellings, and named by nothing but their places."""
    path = fresh_path(spark, "csv")
    d = raw(spark, sf_dir).where("price <> 'nan' and price <> 'inf' and agg_trade_id <> 'x1' and (last_trade_id <> '0' or first_trade_id = '0')").drop("trade_date")
    kind = F.pmod(F.xxhash64("agg_trade_id"), F.lit(3))
    other = ["price", "is_buyer_maker", "agg_trade_id", "transact_time", "quantity", "last_trade_id", "first_trade_id"]
    for k, part in enumerate((d, d.select("symbol", *[F.col(c).alias(c.replace("_", "").upper()) for c in other]), d.select("symbol", *[F.col(c).alias(f"x{i}") for i, c in enumerate(S.RAW_NAMES)]))):
        made = part.where(kind == k) if k == 0 else part.withColumn("_k", F.pmod(F.xxhash64("AGGTRADEID" if k == 1 else "x0"), F.lit(3))).where(f"_k = {k}").drop("_k")
        made.write.mode("append").partitionBy("symbol").option("header", True).csv(path)
    return S.read_agg_trades_csv(spark, path)


@query("src15_upgrade_agg2", f"SELECT {TRADES.replace('trade_count', 'least(trade_count, 65535) AS trade_count')} FROM tape")
def _(spark, sf_dir):
    t = S.tape(spark, sf_dir)
    old = t.select("symbol", "trade_date", "trade_id", "px", "qty", "first_id", F.least("trade_count", F.lit(65535)).cast("int").alias("count"), F.lit(0).alias("flags"), "ts_ms", (1 - F.col("flags")).alias("side"))
    return S.upgrade_agg2(old)
