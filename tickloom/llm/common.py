"""What the corpus operators share: the shared folder, written tables, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.shared import fresh_path, shared_dir  # noqa: F401

#: Ids of at most this many rows may be broadcast (16 bytes a row); above, Spark's shuffled join is used.
BROADCAST_ROWS = 200_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key():
    """A number for each different pair of doc_id and text; ids may be null or repeat with other texts."""
    return F.xxhash64(F.col("doc_id").cast("long").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text"))


def row_keys():
    """Two such numbers, k1 and k2: 128 bits, so that no two of 10^12 different rows agree."""
    parts = [F.col("doc_id").cast("long").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text")]
    return F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")


def slices(frames, rows: int = 1000):
    """The batches in parts of some rows, so that a task holds few texts at a time as Python objects."""
    for batch in frames:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def only_ids(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key is in ``ids`` (a written table); ids are broadcast only up to BROADCAST_ROWS."""
    small = ids.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(ids) if small else ids, key, "left_semi")


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """Connected components: (node, component), component = the smallest node reachable.

    Alternates large-star and small-star steps until the edge set no longer changes; every node ends
    linked to its component's minimum (some 2 log n rounds; an error after ``most_rounds``). The least neighbours of a step
    are partial aggregates: broadcast where the edges are few, which a few tasks then do, else a written table, so that Spark
    can split the join of a node with very many neighbours.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = lambda: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state()
    for _ in range(most_rounds if before[0] else 0):
        few = 2 * before[0] <= BROADCAST_ROWS
        less = (lambda df: df.coalesce(8)) if few else (lambda df: df)
        with_low = lambda rows, low: rows.join(F.broadcast(low) if few else written(low, "low"), "u")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_low(both, less(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not few:
            large = written(large.distinct(), "large")
        low = less(large.groupBy("u").agg(F.min("v").alias("m")))
        small = with_low(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = written(less(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
        now = state()
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
