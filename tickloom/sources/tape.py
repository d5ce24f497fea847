"""Trade tapes: the adapter from the event table, raw daily files, day manifests and verification."""

from __future__ import annotations

import csv
import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.shared import written

SCALE = 100_000_000
MAX_COUNT = 2**32 - 1
KEYS = ["symbol", "trade_date"]
RAW_NAMES = ["agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker"]


#: The event table's columns as those of a trade tape.
TAPE_COLUMNS = [
    "event_type as symbol", "cast(ts as date) as trade_date", "event_id as trade_id",
    "cast(round((1000 + value) * 100) as bigint) * 1000000 as px",
    "(cast(get_json_object(props, '$.k') as bigint) + 1) * 1000000 as qty",
    "event_id * 10 as first_id", "1 + event_id % 4 as trade_count",
    "cast(if(user_id % 2 = 0, 1, 0) as int) as flags",
    "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ts_ms",
]


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a trade tape: narrow, only the needed columns are read."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*TAPE_COLUMNS)


def normalised(columns: list[str]) -> dict[str, str]:
    """Maps a raw header to RAW_NAMES: by name without '_', lower-cased and trimmed, else by position."""
    plain = [c.replace("_", "").strip().lower() for c in columns]
    wanted = {n: n.replace("_", "") for n in RAW_NAMES}
    first = next((plain.index(n) for n in ("aggtradeid", "id") if n in plain), 0)
    out = {RAW_NAMES[0]: columns[first]}
    for k, name in enumerate(RAW_NAMES[1:], 1):
        out[name] = columns[plain.index(wanted[name])] if wanted[name] in plain else columns[k]
    return out


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of each file; files are read as lines, and only those that begin one are looked at."""

    def first(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in frames:
            files = b.column(0).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[files[0] != last, files[1:] != files[:-1]]) if len(files) else []
            last = files[-1] if len(files) else last
            yield b.take(pa.array(new, pa.int64()))

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("header"))
    return lines.where("at = 0").select("file", "header").mapInArrow(first, "file string, header string")


def read_agg_trades_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """CSV files, each read by its own header (columns may stand in another order or have other names in each); without ``symbol``
    the path has it (symbol=...). The different headers come to the driver, not the files' names."""
    heads = written(file_headers(spark, path), "headers")
    kinds = [r["header"] for r in heads.select("header").distinct().orderBy("header").collect()]
    named = [next(csv.reader([k])) for k in kinds]
    width = max(map(len, named), default=len(RAW_NAMES))
    raw = spark.read.option("header", True).schema(", ".join(f"c{k} string" for k in range(width))).csv(path)
    places = [{n: columns.index(c) for n, c in normalised(columns).items()} for columns in named] or [dict(zip(RAW_NAMES, range(width)))]
    if len(kinds) > 1:
        kind = F.coalesce(*[F.when(F.col("header") == k, i) for i, k in enumerate(kinds)])
        raw = raw.withColumn("_file", F.col("_metadata.file_path")).join(heads.select(F.col("file").alias("_file"), kind.alias("_kind")), "_file")
    cell = lambda n: F.coalesce(*[F.when(F.col("_kind") == i, F.col(f"c{at[n]}")) for i, at in enumerate(places)]) if len(kinds) > 1 else F.col(f"c{places[0][n]}")
    kept = [cell(n).alias(n) for n in RAW_NAMES]
    return parse_trades(raw.select(*kept) if symbol else raw.select("symbol", *kept), symbol)


def unzipped(files: DataFrame, content: str = "content", keep: list[str] = ()) -> DataFrame:
    """The raw text columns of the first .csv member of each zip in a binary column, with the ``keep`` columns of its row.
    Quoted cells are read as such; a file that is no zip, has no .csv member or is empty gives no rows."""
    import csv
    import io
    import zipfile

    import pyarrow as pa

    keep = list(keep)
    schema = files.select(*keep).schema
    for n in RAW_NAMES:
        schema = schema.add(n, "string")

    def rows_of(data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                member = next((n for n in z.namelist() if n.endswith(".csv")), None)
                if member is None:
                    return
                with io.TextIOWrapper(z.open(member), "utf-8", "replace", newline="") as f:
                    reader = csv.reader(f)
                    header = next(reader, None)
                    if not header:
                        return
                    at = [header.index(c) for c in normalised(header).values()]
                    for cells in reader:
                        if len(cells) > max(at):
                            yield [cells[i] for i in at]
        except zipfile.BadZipFile:
            return

    def run(frames):
        for batch in frames:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                rows: list = []
                for cells in rows_of(own.column(0)[0].as_py() or b""):
                    rows.append(cells)
                    if len(rows) == 50_000:
                        yield pack(own, rows)
                        rows = []
                if rows:
                    yield pack(own, rows)

    def pack(own, rows):
        same = pa.Table.from_batches([own.select(list(range(1, own.num_columns)))]).take(pa.array([0] * len(rows), pa.int64())).combine_chunks() if keep else None
        left = [same.column(i).combine_chunks() for i in range(same.num_columns)] if keep else []
        left = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in left]
        return pa.RecordBatch.from_arrays([*left, *(pa.array(c, pa.string()) for c in zip(*rows))], schema.names)

    return files.select(content, *keep).mapInArrow(run, schema)


def read_agg_trades_zip(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Daily zips; files are opened in the tasks and read line by line."""
    return parse_trades(unzipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)), symbol)


def _parsed(raw: DataFrame, symbol: str | None) -> DataFrame:
    """Typed rows with ``fate``: keep, skip (a malformed field, no price or quantity, a count <= 0) or poison."""
    rows = raw.selectExpr(
        *([] if symbol else ["symbol"]), "try_cast(agg_trade_id as bigint) as trade_id", "try_cast(price as double) as p", "try_cast(quantity as double) as q",
        "try_cast(first_trade_id as bigint) as first_id", "try_cast(last_trade_id as bigint) as last_id", "try_cast(transact_time as bigint) as ts_ms",
        "lower(is_buyer_maker) in ('true', '1', 't') as maker",
    )
    if symbol:
        rows = rows.withColumn("symbol", F.lit(symbol))
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    endless = lambda c: F.abs(c) * SCALE >= 2.0**63
    base = F.col("ts_ms").isNotNull() & F.col("first_id").isNotNull() & F.col("last_id").isNotNull() & (F.col("last_id") >= F.col("first_id")) & F.col("maker").isNotNull()
    poison = base & number("p") & (endless("p") | number("q") & (endless("q") | F.col("trade_id").isNotNull() & (F.rint(F.col("p") * SCALE) < 0) | F.col("trade_id").isNotNull() & ((F.rint(F.col("q") * SCALE) < 0) | (F.col("trade_id") < 0) | (F.col("first_id") < 0))))
    good = base & number("p") & number("q") & F.col("trade_id").isNotNull()
    return rows.withColumns({"trade_date": F.to_date(F.timestamp_millis("ts_ms")), "fate": F.when(poison, "poison").when(good, "keep").otherwise("skip")})


def poisoned_days(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """(symbol, trade_date) of the days that are given up whole: an endless price or quantity, or a negative number."""
    return _parsed(raw, symbol).where("fate = 'poison'").select(*KEYS).distinct()


def parse_trades(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Typed rows: malformed ones are skipped, poisoned days left out; counts are clamped; 1e8 scale, half even."""
    rows = _parsed(raw, symbol)
    bad = rows.where("fate = 'poison'").select(*KEYS).distinct()
    return rows.where("fate = 'keep'").join(bad, KEYS, "left_anti").select(
        "symbol", "trade_date", "trade_id", F.expr(f"cast(rint(p * {SCALE}) as bigint)").alias("px"), F.expr(f"cast(rint(q * {SCALE}) as bigint)").alias("qty"), "first_id",
        F.least(F.col("last_id") - F.col("first_id") + 1, F.lit(MAX_COUNT)).alias("trade_count"), F.col("maker").cast("int").alias("flags"), "ts_ms",
    )


def ingest_status(calendar: DataFrame, before: DataFrame, parsed: DataFrame, poisoned: DataFrame) -> DataFrame:
    """(symbol, trade_date, status) of each calendar day: skip (in the manifest before), error (poisoned), ok (has rows) or missing."""
    flag = lambda df, name: df.select(*KEYS).distinct().withColumn(name, F.lit(True))
    j = calendar.join(flag(before, "old"), KEYS, "left").join(flag(poisoned, "bad"), KEYS, "left").join(flag(parsed, "has"), KEYS, "left")
    return j.select(*KEYS, F.when(F.col("old"), "skip").when(F.col("bad"), "error").when(F.col("has"), "ok").otherwise("missing").alias("status"))


def upgrade_agg2(old: DataFrame) -> DataFrame:
    """Rows of the old layout (count of 16 bits, side) in the present one: a side of 0 is the buyer as maker, flag 1."""
    return old.select(*KEYS, "trade_id", "px", "qty", "first_id", F.col("count").cast("long").alias("trade_count"), F.col("flags").bitwiseOR(F.when(F.col("side") == 0, 1).otherwise(0)).cast("int").alias("flags"), "ts_ms")


def write_trades(df: DataFrame, path: str) -> None:
    """One folder for each symbol and day; a written day is replaced whole."""
    df.repartition(*KEYS).sortWithinPartitions("trade_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder for each symbol and day, in bar order; a written day is replaced whole."""
    bars.repartition(*KEYS).sortWithinPartitions(*KEYS, "bar_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_bars(spark: SparkSession, path: str, symbols=None, years=None, months=None) -> DataFrame:
    return read_trades(spark, path, symbols, years, months)


def write_features(sig: DataFrame, path: str, columns=("symbol", "trade_date", "trade_id", "alpha")) -> None:
    """Keeps the alpha column (or ``columns``) of a tick panel, by symbol and day."""
    write_days = sig.select(*columns).repartition(*KEYS).sortWithinPartitions("trade_id")
    write_days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_trades(spark: SparkSession, path: str, symbols=None, years=None, months=None) -> DataFrame:
    """Partition-pruned; ``months`` [(year, month)] win over ``years``."""
    df = spark.read.parquet(path)
    if symbols:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if months:
        df = df.where(F.date_format("trade_date", "yyyy-MM").isin([f"{y:04d}-{m:02d}" for y, m in months]))
    elif years:
        df = df.where(F.year("trade_date").isin(list(years)))
    return df


def day_manifest(trades: DataFrame) -> DataFrame:
    """Row count, first and last time, and an order-free checksum for each symbol and day."""
    row = F.concat_ws(",", "trade_id", "px", "qty", "first_id", "trade_count", "flags", "ts_ms")
    part = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    return trades.groupBy(*KEYS).agg(F.count("*").alias("row_count"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.sum(part).alias("checksum"))


def verify_days(trades: DataFrame, manifest: DataFrame, tick: int = 1) -> DataFrame:
    """Days whose rows do not agree with the manifest, with off_tick: how many prices are no multiple of ``tick`` (in units of
    1e-8) or not above 0. Days with such prices are listed too."""
    now = day_manifest(trades)
    names = ["row_count", "min_ts", "max_ts", "checksum"]
    off = trades.groupBy(*KEYS).agg(F.count_if((F.col("px") % tick != 0) | (F.col("px") <= 0)).alias("off_tick"))
    j = now.select(*KEYS, *[F.col(c).alias(f"{c}_now") for c in names]).join(manifest, KEYS, "full_outer").join(off, KEYS, "left").withColumn("off_tick", F.coalesce("off_tick", F.lit(0)))
    bad = F.col("off_tick") > 0
    for c in names:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"{c}_now"))
    return j.where(bad)


def stream_trades(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def day_calendar(spark: SparkSession, start: str = "2020-01-01", end: str | None = None) -> DataFrame:
    """(trade_date): every day from ``start`` to ``end`` (yesterday, UTC, if not given), both included; none if it lies before."""
    first = datetime.date.fromisoformat(start)
    last = datetime.date.fromisoformat(end) if end else datetime.datetime.now(datetime.timezone.utc).date() - datetime.timedelta(days=1)
    return spark.range(max(0, (last - first).days + 1)).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("trade_date"))


def merge_days(batch: DataFrame, path: str, manifest: str) -> None:
    """Brings the batch's days up to date: a day is its stored rows and the batch's, of a trade id the batch's row (of several, the
    last by all columns); the day's files and its manifest row are replaced. So a batch that comes twice changes nothing."""
    spark = batch.sparkSession
    rows = batch.withColumn("_new", F.lit(1))
    days = written(batch.select(*KEYS).distinct(), "days")
    stored = _stored(spark, path)
    if stored is not None:
        rows = rows.unionByName(stored.join(days, KEYS, "left_semi").withColumn("_new", F.lit(0)).select(*rows.columns))
    values = [c for c in batch.columns if c not in (*KEYS, "trade_id")]
    one = rows.groupBy(*KEYS, "trade_id").agg(F.max(F.struct("_new", *values)).alias("v"))
    merged = written(one.select(*[F.col(f"v.{c}").alias(c) if c in values else F.col(c) for c in batch.columns]), "merged")
    write_trades(merged, path)
    day_manifest(merged).repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(manifest)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def ingest_stream(trades: DataFrame, path: str, manifest: str, checkpoint: str):
    """Starts a query that takes in what has arrived, batch by batch, and ends; it goes on from ``checkpoint`` when started again."""
    return trades.writeStream.foreachBatch(lambda batch, _: merge_days(batch, path, manifest)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
