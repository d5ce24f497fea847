"""MinHash near-deduplication by a multi-index Hamming join.

A text's set is that of its distinct k-word shingles. Its signature has SYMBOLS symbols of 16 bits (of as many
min-hashes), so two sets of Jaccard similarity J differ in about (1-J)*SYMBOLS symbols. The signature is cut into CHUNKS
chunks; by pigeonhole two signatures that differ in at most MAX_DISTANCE symbols have a chunk with at most
ERRORS = 1 differing symbol. Each chunk is indexed once for each symbol left out, so all pairs within MAX_DISTANCE
share an index key of 48 bits or more: the join is complete for that distance, and texts that have nothing in common do not
meet. A pair of similarity 0.8 or more lies beyond MAX_DISTANCE with a probability under 1e-5. Pairs that meet are
confirmed by their signatures' distance, then on the full shingle sets, which are recomputed from the texts.

Nothing grows with the square of a group: sets that are equal are one class; a key's first LEADERS members
are paired with each other, later ones with the first HUBS only, and a task does so with its own rows before they are
shuffled, so that a key of very many rows sends a few of each task. Members of a large bucket that are then outside of its
largest component meet COMPONENT_HUBS members of that, and what is still apart goes through an exact prefix-filter join on
those members' shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .hashing import hashed_words, mix, shingles

SYMBOLS = 64
MAX_DISTANCE = 29
ERRORS = 1
CHUNKS = MAX_DISTANCE // (ERRORS + 1) + 1
LEADERS, HUBS = 16, 1
#: Members of a large bucket's largest component that the bucket's members of other components meet.
COMPONENT_HUBS = 4
#: Texts compared with one hub in one task; sets that a task brings together before the shuffle.
HUB_SHARE, BLOCK = 256, 8192
MEMBER, LEADER, PAIR, CROWD = 0, 1, 2, 3

_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 2**31, SYMBOLS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_SET_SCHEMA = "doc_id long, row_key long, n_shingles long, set_hash binary, signature binary"


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """SYMBOLS numbers of 16 bits; the same ones for every empty set."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        np.minimum(low, ((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row_key, n_shingles, a 128-bit hash of the set, and the signature, one row for each input row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(frames):
            n, digest, sig = [], [], []
            for words in hashed_words(batch.column(2).to_pylist()):
                s = shingles(words, k)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "row_key", "n_shingles", "set_hash", "signature"])

    return docs.select(F.col("doc_id").cast("long"), common.row_key().alias("row_key"), "text").mapInArrow(run, _SET_SCHEMA)


def signatures_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each row of signatures the SYMBOLS index keys: each chunk with each of its symbols left out."""
    out = np.empty((len(signatures), SYMBOLS), np.uint64)
    column = 0
    for c, part in enumerate(np.array_split(np.arange(SYMBOLS), CHUNKS)):
        for left_out in part:
            value = np.full(len(signatures), c * 64 + (left_out - part[0]) + 1, np.uint64)
            for p in part:
                if p != left_out:
                    value = mix((value << np.uint64(16)) ^ (value >> np.uint64(48)) ^ signatures[:, p].astype(np.uint64))
            out[:, column] = value
            column += 1
    return out


def _index(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows (key, id, other, kind) of (id, signature) rows: MEMBER of a key, or LEADER if this task has more members
    of the key than LEADERS. Those beyond the leaders leave here: as PAIR with the first HUBS, and CROWD (other = the key)."""

    def flush(ids, signatures):
        ids = np.concatenate(ids)
        key = chunk_keys(np.concatenate(signatures)).ravel()
        row = np.repeat(np.arange(len(ids)), SYMBOLS)
        order = np.lexsort((ids[row], key)) if len(ids) > LEADERS else np.argsort(key)
        key, id_ = key[order].view(np.int64), ids[row[order]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        run = np.repeat(np.arange(len(first)), count)
        rank = np.arange(len(key)) - first[run]
        large = (count > LEADERS)[run]
        stays = rank < LEADERS
        yield key[stays], id_[stays], np.zeros(int(stays.sum()), np.int64), np.where(large[stays], LEADER, MEMBER)
        late = np.flatnonzero(~stays)
        if len(late):
            pair = np.unique(np.concatenate([np.stack([id_[first[run[late]] + h], id_[late]], axis=1) for h in range(HUBS)]), axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            yield mix((pair[:, 0] ^ (pair[:, 1] << 1)).view(np.uint64)).view(np.int64), pair[:, 0], pair[:, 1], np.full(len(pair), PAIR)
            yield mix((key[late] ^ id_[late]).view(np.uint64)).view(np.int64), id_[late], key[late], np.full(len(late), CROWD)

    def batches(ids, signatures):
        for columns in flush(ids, signatures):
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), pa.array(columns[3].astype(np.int8))], ["key", "id", "other", "kind"])

    ids, signatures, n = [], [], 0
    for batch in frames:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            signatures.append(signatures_of(part.column(1)))
            n += part.num_rows
            if n >= BLOCK:
                yield from batches(ids, signatures)
                ids, signatures, n = [], [], 0
    if n:
        yield from batches(ids, signatures)


def _bucket_pairs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams index rows sorted by (key, leaders first, id); (a, b, crowded): pairs of members, and (member, key) of large buckets."""
    names = ["key", "id", "kind"]
    kept = {c: np.empty(0, np.int64) for c in names}  # the last key's first members
    seen = 0  # and how many it had
    for batch in frames:
        cols = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*names, "other"]}
        through = cols["kind"] >= PAIR
        left, right, big = [cols["id"][through]], [cols["other"][through]], [cols["kind"][through] == CROWD]
        new = {c: cols[c][~through] for c in names}
        if len(new["key"]):
            same = len(kept["key"]) and kept["key"][0] == new["key"][0]
            head = len(kept["key"]) if same else 0
            a = {c: np.concatenate([kept[c][:head], new[c]]) for c in names}
            key, ids = a["key"], a["id"]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            run_of = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            start, at = first[run_of], np.arange(len(key))
            fresh = at >= head
            skipped = seen - head if same else 0  # members of the first key that are not kept
            rank = at - start + np.where((run_of == 0) & fresh, skipped, 0)
            for back in range(1, LEADERS):
                i = at[fresh & (rank >= back) & (rank < LEADERS)]
                left.append(ids[i - back])
                right.append(ids[i])
            late = at[fresh & (rank >= LEADERS)]
            for hub in range(HUBS):
                left.append(ids[start[late] + hub])
                right.append(ids[late])
            count = np.diff(np.r_[first, len(key)])
            count[0] += skipped
            led = a["kind"][start] == LEADER
            crowd = at[(led & fresh) | (~led & (count[run_of] > LEADERS) & (fresh | (seen <= LEADERS)))]
            n = sum(map(len, left)) - len(left[0])
            left.append(ids[crowd])
            right.append(key[crowd])
            big += [np.zeros(n, bool), np.ones(len(crowd), bool)]
            last = first[-1]
            seen = int(count[-1])
            kept = {c: a[c][last : last + LEADERS] for c in names}
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right)), pa.array(np.concatenate(big))], ["a", "b", "crowded"])


def near_signatures(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures are within MAX_DISTANCE and whose set sizes allow the similarity. sets: (doc_id,
    n_shingles, signature), a written table."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}")), side)
    pairs = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            near = (signatures_of(batch.column(2)) != signatures_of(batch.column(3))).sum(axis=1) <= MAX_DISTANCE
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _set_of(texts, k: int) -> Iterator[np.ndarray]:
    return (shingles(w, k) for w in hashed_words(texts))


def similar(x: int, y: int, common_size: int, percent: int) -> bool:
    return 100 * common_size >= percent * (x + y - common_size)


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose full shingle sets are similar enough.

    A text meets its hub's text once for each pair. A hub with many partners is dealt over tasks in shares of HUB_SHARE; a
    task streams its rows.
    """
    ids = common.written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = common.only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id")
    large = common.written(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SHARE).alias("shares")).where("shares > 1"), "hubs")
    small = F.broadcast if large.count() <= common.BROADCAST_ROWS else lambda x: x
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    sides = pairs.join(small(large), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), shares).alias("share"), F.lit(1).alias("kind"))
    hubs = pairs.select("a").distinct().join(small(large), "a", "left")
    sides = sides.unionByName(hubs.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), F.lit(0).alias("kind")))
    rows = sides.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "share", "kind", "b", "text")
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", "kind")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, hub_set = None, None
        for f in frames:
            a, b, out = f["a"].to_numpy(), f["b"].to_numpy(), []
            for i, s in enumerate(_set_of(f["text"], k)):
                if f["kind"].iat[i] == 0:
                    hub, hub_set = a[i], s
                elif hub == a[i]:
                    shared = len(np.intersect1d(hub_set, s, assume_unique=True))
                    if shared and similar(len(hub_set), len(s), shared, percent):
                        out.append((a[i], b[i]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(run, "a long, b long")


def _shingle_rows(docs: DataFrame, k: int) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(frames):
            ids, comps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, s in enumerate(_set_of(batch.column(2).to_pylist(), k)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[i])), pa.array(np.full(len(s), comps[i])), pa.array(np.full(len(s), len(s), np.int32)), pa.array(s.view(np.int64))], ["id", "component", "n", "shingle"])

    return docs.mapInArrow(run, "id long, component long, n int, shingle long")


def prefix_pairs(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidate pairs of members of different components by the prefix filter: two sets that are similar
    enough share one of their n - ceil(percent/100 * n) + 1 rarest shingles. Exact; members: (id, component)."""
    ids = common.written(members, "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = texts.join(F.broadcast(ids) if ids.count() <= common.BROADCAST_ROWS else ids, "id").select("id", "component", "text")
    rows = common.written(_shingle_rows(texts, k), "shingles")
    # of shingles that one component alone has, no pair comes; they come first in the order and are not joined
    count = common.written(rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("shingle", "df"), "shared")
    ranked = rows.join(count, "shingle", "left").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "shingle")))
    # how many of the set's shingles, from this one on, other components have at all
    ranked = ranked.withColumn("rest", F.sum(F.col("df").isNotNull().cast("int")).over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)).desc(), F.desc("shingle"))))
    prefix = ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & F.col("df").isNotNull()).select("id", "component", "n", "rest", "shingle")
    prefix = common.written(prefix, "prefix")
    x, y = (prefix.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n", "rest"))) for s in "ab")
    near = x.join(y, "shingle").where("component_a < component_b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    # at a pair's first common shingle, no more than the rest of either set can be common
    near = near.where(f"{100 + percent} * least(rest_a, rest_b) >= {percent} * (n_a + n_b)")
    return near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _met_largest(crowd: DataFrame) -> DataFrame:
    """Pairs (a, b): b is a member of a bucket outside of its largest component, a one of COMPONENT_HUBS members of that.

    A component's members of a bucket are one row (their number and the hubs) before they meet the other components'."""
    part = F.pmod(F.xxhash64("id"), F.lit(COMPONENT_HUBS))
    parts = crowd.groupBy("key", "component").agg(F.count("*").alias("n"), F.array_compact(F.array(*[F.min(F.when(part == c, F.col("id"))) for c in range(COMPONENT_HUBS)])).alias("hubs"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "component", "hubs")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    hubs = common.written(largest.select("key", F.col("m.component").alias("of"), F.col("m.hubs").alias("hubs")), "hubs")
    outside = crowd.join(hubs, "key").where("component <> of").select("id", "hubs").distinct()
    return outside.select(F.explode("hubs").alias("a"), F.col("id").alias("b")).distinct()


def _open(crowd: DataFrame) -> DataFrame:
    """The rows (id, key, component) of large buckets that hold more than one component."""
    parts = crowd.groupBy("key", "component").agg(F.lit(1).alias("one"))  # a key's many members are one row before they meet
    mixed = common.written(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "mixed")
    return common.written(common.only_ids(crowd, mixed, "key"), "open")


def _still_open(open_: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component) of ``open_``'s members after their components have grown (``found``), of those components that share a bucket with
    another one. Members are few next to their places in buckets, and components next to members: only these are joined."""
    members = common.written(open_.select("id", "component").distinct(), "members")
    one = members.groupBy("component").agg(F.min("id").alias("doc_id"))
    now = common.written(one.join(found.withColumnRenamed("component", "new"), "doc_id").select("component", "new"), "grown")
    parts = open_.groupBy("key", "component").agg(F.lit(1).alias("one")).join(now, "component").groupBy("key", "new").agg(F.lit(1).alias("one"))
    parts = common.written(parts.select("key", "new"), "parts")
    mixed = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = common.written(parts.join(mixed, "key").select("new").distinct(), "shared")
    return common.written(members.join(now, "component").join(shared, "new").select("id", F.col("new").alias("component")), "apart")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, component) with the components that new links (a, b) join."""
    for side in "ab":
        links = links.join(found.select(F.col("doc_id").alias(side), F.col("component").alias(f"c{side}")), side)
    joined = common.components(links.where("ca <> cb"), "ca", "cb")
    out = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    return common.written(out.select("doc_id", F.coalesce("new", "component").alias("component")), "components")


def _linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets of ``docs`` (see shingle_sets), and one row for each different set with words: set_hash, best (the struct last, doc_id,
    row_key of its first row, null ids last), first_id (its smallest doc_id) and component (a number that linked sets share)."""
    if percent < 80:
        raise ValueError("the signature's distance bound holds for a similarity of 80 % or more")
    sets = common.written(shingle_sets(docs, k), "sets")
    live = sets.where("n_shingles > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("best")
    # a set's smallest key stands for it
    reps = live.groupBy("set_hash").agg(F.min("row_key").alias("key"), F.min("doc_id").alias("first_id"), best, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    reps = common.written(reps.withColumnRenamed("key", "doc_id"), "reps")
    # rows that repeat id and text have one key, and one text is enough
    texts = docs.select(common.row_key().alias("doc_id"), "text")
    again = common.written(live.join(reps.select(F.col("doc_id").alias("row_key")), "row_key", "left_semi").groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias("doc_id")), "repeated")
    few = again.count()
    if few:
        small = F.broadcast(again) if few <= common.BROADCAST_ROWS else again
        texts = texts.join(small, "doc_id", "left_anti").unionByName(texts.join(small, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return common.written(verified(common.written(near_signatures(pairs, reps, percent), "near"), texts, k, percent), "links")

    index = reps.select("doc_id", "signature").mapInArrow(_index, "key long, id long, other long, kind byte")
    met = index.repartition("key").sortWithinPartitions("key", F.desc("kind"), "id").mapInArrow(_bucket_pairs, "a long, b long, crowded boolean").distinct()
    met = common.written(met, "met")
    found = _merged(reps.select("doc_id", F.col("doc_id").alias("component")), confirmed(met.where("not crowded and a <> b").select("a", "b")))
    members = met.where("crowded").select(F.col("a").alias("id"), F.col("b").alias("key"))

    def crowd(members: DataFrame) -> DataFrame:
        return members.join(found.withColumnRenamed("doc_id", "id"), "id").select("id", "key", "component")

    if not members.isEmpty():
        open_ = _open(common.written(crowd(members), "crowd"))
        if not open_.isEmpty():
            found = _merged(found, confirmed(common.written(_met_largest(open_), "met")))
            rest = _still_open(open_, found)
            if not rest.isEmpty():
                near = common.written(prefix_pairs(rest, texts, k, percent), "near")
                found = _merged(found, common.written(verified(near, texts, k, percent), "links"))
    return sets, common.written(reps.select("doc_id", "set_hash", "best", "first_id").join(found, "doc_id").drop("doc_id"), "classes")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs`` (doc_id, text; others are ignored).

    Texts are linked if their sets of k-word shingles have 100 * intersection >= percent * union; component_id
    is the smallest doc_id of a row reachable. Null and word-less texts have n_shingles 0 and are linked with nothing.
    Rows that repeat a doc_id each give a row, with the component of their own text. A row with a null doc_id links
    others but is not kept; its component is null if all of it have null ids. percent must be at least 80: the index is
    complete for that. An empty table gives no rows; texts of any length are read whole.
    """
    sets, classes = _linked(docs, k, percent)
    names = common.written(classes.groupBy("component").agg(F.min("first_id").alias("name")), "names")
    named = common.written(classes.join(names, "component").select("set_hash", "name"), "named")
    # sets without words are all equal but linked with nothing
    out = sets.where("n_shingles > 0").join(named, "set_hash", "left").select("doc_id", "n_shingles", F.col("name").alias("component_id"))
    out = out.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=2, percent=80)


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8): the one of the smallest id
    (null last). Rows with a null id or an id that others have too are judged by their own texts. Of word-less texts all
    rows stay but those that repeat both id (not null) and text. An empty table gives no rows; other columns, of
    whatever name, are kept as they are."""
    sets, classes = _linked(docs, 5, 80)
    key = common.spare_name(docs, "_key")
    one = classes.groupBy("component").agg(F.min("best").alias("m")).select(F.col("m.row_key").alias(key))
    named = sets.where("n_shingles = 0 and doc_id is not null").select(F.col("row_key").alias(key)).distinct()
    keep = common.written(one.unionByName(named), "kept")
    free = common.written(sets.where("n_shingles = 0 and doc_id is null").select(F.col("row_key").alias(key)).distinct(), "kept")
    keyed = docs.withColumn(key, common.row_key())
    # a copy with the same id and text has the same key, so that one row of each kept key stays
    kept = keyed.join(keep, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(keyed.join(free, key, "left_semi")).drop(key)


ORACLE_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id,
       n.doc_id = least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS kept
FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
