"""Mixing sources to target weights by Pfair scheduling (DataFrame and SQL functions only).

A source's documents, in a fixed hashed order, are cut into blocks of ``block_chars`` characters. A source of
weight w = share/total releases its k-th block (k from 1) at slot floor((k-1)/w), with deadline ceil(k/w).
Earliest deadline first, among released blocks, fills one slot after the other; as the weights add up to 1 every
block is served inside its window, so up to every slot a source's served blocks differ from weight * slots by less
than one block. The schedule repeats after ``total`` slots, so only one period is computed (a fold over its
slots on one small row) and joined to the blocks. A source that runs out leaves its slots empty; no row is dropped.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Slots in one period for each SOURCES sources begun; shares are whole numbers of it, at least 1 for each source, which
#: takes a tenth of the slots at most. The fold's work grows with the square of the sources; the driver finds the same schedule
#: with a heap where there are more than FOLDED.
TOTAL, SOURCES, FOLDED = 360, 36, 600
#: Characters in a block.
BLOCK_CHARS = 65536
SEED = "mix"


def sqrt_targets(docs: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share): shares in proportion to the square root of a source's characters (temperature 2),
    rounded by largest remainder to add up to ``total``; 1 at least. One row for each source, however many."""
    size = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).alias("chars"))
    return shares(common.written(size.select("source", F.sqrt(F.col("chars").cast("double")).alias("weight")), "weights"), total)


def shares(weights: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share) from (source, weight > 0) by largest remainder; the period follows the number of sources."""
    total = total or TOTAL * max(1, -(-weights.count() // SOURCES))
    everything = Window.partitionBy(F.lit(0))
    w = weights.withColumn("sources", F.count("*").over(everything)).withColumn("exact", F.col("weight") / F.sum("weight").over(everything))
    w = w.withColumn("exact", F.round(F.col("exact") * (F.lit(total) - F.col("sources")), 9)).withColumn("base", F.floor("exact"))
    left = F.lit(total) - F.col("sources") - F.sum("base").over(everything)
    w = w.withColumn("left", left).withColumn("rank", F.row_number().over(everything.orderBy(F.desc(F.col("exact") - F.col("base")), "source")))
    w = w.withColumn("checked", F.when(F.col("sources") > total, F.raise_error(F.lit("too many sources for the period"))).otherwise(F.lit(1)))
    return w.select("source", (F.col("checked") + F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("int").alias("share"))


def served(share: list[int]) -> list[int]:
    """The number of the source served in each slot of one period; earliest deadline, then source, first."""
    total, done, later = sum(share), [0] * len(share), defaultdict(list)
    ready = [(-(-total // x), i) for i, x in enumerate(share)]
    heapq.heapify(ready)
    out = []
    for t in range(total):
        for job in later.pop(t, ()):
            heapq.heappush(ready, job)
        i = heapq.heappop(ready)[1]
        out.append(i)
        done[i] += 1
        if done[i] < share[i]:
            later[max(t + 1, done[i] * total // share[i])].append((-(-(done[i] + 1) * total // share[i]), i))
    return out


def period(targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, turn, at): the slot ``at`` of each source's turn-th block (from 0) within one period. The shares must add up to
    ``total``, if it is given: only then every slot has one block and every block its window."""
    n, slots = targets.agg(F.count("*"), F.sum("share")).first()
    total = total or slots or TOTAL
    if n and total != slots:
        raise ValueError(f"the shares add up to {slots}, not to the period of {total} slots")
    if n > FOLDED:  # in the fold below each slot looks at all sources
        rows = sorted((r["source"], r["share"]) for r in targets.select("source", "share").toLocalIterator())
        pick, turn, turns = served([x for _, x in rows]), [], [0] * n
        for i in pick:
            turn.append(turns[i])
            turns[i] += 1
        plan = [(*rows[i], at, k) for at, (i, k) in enumerate(zip(pick, turn))]
        return targets.sparkSession.createDataFrame(plan, "source string, share int, at int, turn long")
    one = targets.agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"))
    fold = f"""
        aggregate(
            sequence(0, {total - 1}),
            named_struct('done', transform(s, x -> 0), 'picks', cast(array() as array<int>)),
            (st, t) -> transform(
                array(array_min(filter(
                    transform(s, (x, i) -> named_struct(
                        'deadline', cast(ceil((st.done[i] + 1) * {total}D / x.share) as int),
                        'i', i,
                        'release', cast(floor(st.done[i] * {total}D / x.share) as int))),
                    c -> c.release <= t)).i),
                p -> named_struct('done', transform(st.done, (d, i) -> if(i = p, d + 1, d)), 'picks', concat(st.picks, array(p))))[0],
            st -> st.picks)
    """
    slots = one.selectExpr("s", f"posexplode({fold}) as (at, pick)").selectExpr("s[pick].source as source", "s[pick].share as share", "at")
    return slots.withColumn("turn", (F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1).cast("long"))


PLACE = ("chars_before", "block_no", "slot", "release", "deadline")


def mix(docs: DataFrame, targets: DataFrame | None = None, total: int | None = None, block_chars: int = BLOCK_CHARS, chars: str | None = None) -> DataFrame:
    """The rows of ``docs`` with chars_before (in their source's order), block_no, slot, release and deadline; where ``docs`` has a column
    of such a name it stays, and the new one gets an underscore before its name.

    Reading by (slot, chars_before) gives the mix. A null source is the source ''; null and empty texts count
    one character (``chars`` names a column with the lengths, if there is one); repeated rows are placed one after the other; a
    source missing in ``targets`` raises no error but gets null slots. A text longer than a block uses up the following block
    numbers too. A source's order is cut into 4,096 hash ranges, whose sums are added up first: no task holds a whole source.
    """
    t = "_"
    while any(c.lower().startswith(t) for c in docs.columns):
        t += "_"
    name = {c: common.spare_name(docs, c) for c in PLACE}
    length = F.col(chars) if chars else F.coalesce(F.length("text"), F.lit(0))
    hashed = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumns({f"{t}source": F.coalesce("source", F.lit("")), f"{t}order": hashed, f"{t}chars": F.greatest(length, F.lit(1)).cast("long")})
    rows = rows.withColumn(f"{t}part", F.substring(f"{t}order", 1, 3))
    keys = [f"{t}source", f"{t}part"]
    sums = rows.groupBy(*keys).agg(F.sum(f"{t}chars").alias(f"{t}sum"))
    before = Window.partitionBy(f"{t}source").orderBy(f"{t}part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum(f"{t}sum").over(before), F.lit(0)).alias(f"{t}offset"))
    inside = Window.partitionBy(*keys).orderBy(f"{t}order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{t}inside", F.coalesce(F.sum(f"{t}chars").over(inside), F.lit(0))).join(offsets, keys)
    rows = rows.withColumn(name["chars_before"], F.col(f"{t}offset") + F.col(f"{t}inside")).withColumn(name["block_no"], F.floor(F.col(name["chars_before"]) / block_chars))
    targets = targets if targets is not None else sqrt_targets(docs, total)
    total = total or targets.agg(F.sum("share")).first()[0] or TOTAL
    plan = period(targets, total)
    small = F.broadcast if total <= common.BROADCAST_ROWS else lambda x: x
    plan = plan.select(*[F.col(c).alias(f"{t}{c}") for c in ("source", "share", "turn", "at")])
    share = plan.groupBy(f"{t}source").agg(F.max(f"{t}share").alias(f"{t}s"))
    block, s = F.col(name["block_no"]), F.col(f"{t}s")
    rows = rows.join(small(share), f"{t}source", "left").withColumn(f"{t}turn", F.pmod(block, s)).join(small(plan), [f"{t}source", f"{t}turn"], "left")
    rows = rows.withColumns({name["slot"]: F.floor(block / s) * total + F.col(f"{t}at"), name["release"]: F.floor(block * total / s), name["deadline"]: F.ceil((block + 1) * total / s)})
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *name.values())


def op2(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = docs.select("doc_id", "source", F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long").alias("_chars"))
    return mix(slim, sqrt_targets(docs), chars="_chars").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "chars_before", "block_no", "slot", "release", "deadline")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's place in the mix; every document stays."""
    return mix(docs)


ORACLE_OP2 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(greatest(coalesce(length(text), 0), 1) AS BIGINT) AS chars,
         md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
size AS (SELECT source, sqrt(CAST(sum(chars) AS DOUBLE)) AS weight FROM d GROUP BY source),
ex AS (SELECT source, round(weight / sum(weight) OVER () * ({TOTAL} - count(*) OVER ()), 9) AS exact, count(*) OVER () AS n FROM size),
ba AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, source) AS rk FROM ex),
sh AS (SELECT source, CAST(1 + base + CASE WHEN rk <= {TOTAL} - n - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM ba),
edf(t, source, share, done, pick) AS (
  SELECT -1, source, share, CAST(0 AS BIGINT), false FROM sh
  UNION ALL
  SELECT t + 1, source, share, done + CASE WHEN best THEN 1 ELSE 0 END, best FROM (
    SELECT *, ok AND row_number() OVER (ORDER BY ok DESC, deadline, source) = 1 AS best FROM (
      SELECT *, (done * {TOTAL}) // share <= t + 1 AS ok, ((done + 1) * {TOTAL} + share - 1) // share AS deadline FROM edf WHERE t < {TOTAL - 1}))),
plan AS (SELECT source, done - 1 AS turn, t AS spot FROM edf WHERE pick),
o AS (SELECT d.doc_id, d.source, share, CAST(coalesce(sum(chars) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before
      FROM d JOIN sh ON d.source = sh.source),
b AS (SELECT *, chars_before // {BLOCK_CHARS} AS block_no FROM o)
SELECT b.doc_id, b.source, chars_before, block_no, (block_no // share) * {TOTAL} + spot AS slot,
       (block_no * {TOTAL}) // share AS release, ((block_no + 1) * {TOTAL} + share - 1) // share AS deadline
FROM b JOIN plan ON b.source = plan.source AND block_no % share = turn
"""
