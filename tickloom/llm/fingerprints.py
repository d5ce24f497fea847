"""Document fingerprints by consistent weighted sampling.

A text's weighted set is its lower-cased words (hashed to TERMS terms) with their counts. For each of SAMPLES
samples a term draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), the same in every text (tables from a fixed seed); with
weight w: t = floor(ln w / r + b), a = c / exp(r * (t - b) + r). The term of least a, with its t, is the sample. Two
texts agree in a sample with the probability of their generalised Jaccard similarity, sum(min w) / sum(max w).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import hashed_words

TERMS, SAMPLES, SEED = 1 << 16, 64, 17
#: Rows that one range of neighbouring ids is meant to hold, the most ranges (a task streams its range, however many rows that
#: has), and sampled ids for each.
RANGE_ROWS, MAX_RANGES, RANGE_SAMPLE = 2500, 100_000, 20
_TABLES: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """1/r, b, r and ln c, TERMS x SAMPLES each."""
    if not _TABLES:
        g = np.random.default_rng(SEED)
        shape = (TERMS, SAMPLES)
        r = g.gamma(2.0, 1.0, shape).astype(np.float32)
        _TABLES.extend([1 / r, g.random(shape, np.float32), r, np.log(g.gamma(2.0, 1.0, shape)).astype(np.float32)])
    return _TABLES


def sample(words: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit marks of (term, t); empty for a text without words."""
    if not len(words):
        return np.empty(0, np.uint16)
    term, count = np.unique((words >> np.uint64(48)).astype(np.int64), return_counts=True)
    inverse, b, r, log_c = tables()
    log_w = np.log(count.astype(np.float32))
    best, mark = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    for lo in range(0, len(term), 1024):
        i = term[lo : lo + 1024]
        t = np.floor(log_w[lo : lo + 1024, None] * inverse[i] + b[i])
        log_a = log_c[i] - r[i] * (t - b[i] + 1)
        k = log_a.argmin(axis=0)
        col = np.arange(SAMPLES)
        new = log_a[k, col]
        code = (i[k].astype(np.uint64) << np.uint64(24)) + (t[k, col] + 4096).astype(np.uint64)
        mark = np.where(new < best, code, mark)
        best = np.minimum(best, new)
    x = (mark + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; two texts without words are alike (1), one is not like any other text (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def fingerprints(texts) -> list[np.ndarray]:
    return [sample(w) for w in hashed_words(texts)]


def _ranges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that cut the ids into ranges of like size, from a bounded sample of the ids, and each range's first id."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    rows = ids.count()
    n = min(MAX_RANGES, max(1, rows // RANGE_ROWS))
    share = min(1.0, RANGE_SAMPLE * n / max(rows, 1))
    drawn = ids.where(F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(1_000_000)) < int(share * 1e6)).distinct().toPandas()["id"].to_numpy() if n > 1 else np.empty(0, np.int64)
    bounds = np.unique(np.sort(drawn)[np.linspace(0, len(drawn), n, endpoint=False).astype(np.int64)[1:]]) if len(drawn) else np.empty(0, np.int64)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for batch in frames:
            id_ = batch.column(0).to_numpy()
            where = np.searchsorted(bounds, id_, "right")
            for k in np.unique(where).tolist():
                low[k] = min(low.get(k, 2**63 - 1), int(id_[where == k].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array(list(low.values()), pa.int64())], ["k", "low"])

    rows = ids.mapInArrow(run, "k long, low long").groupBy("k").agg(F.min("low").alias("low")).orderBy("k").collect()
    return bounds, np.array([(r["k"], r["low"]) for r in rows], np.int64).reshape(-1, 2)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next higher doc_id (after the last: the first; a lone row is its own next); rows that
    repeat a doc_id follow one another by text. Null texts count as empty, null doc_ids come first. Texts are shuffled
    once, by ranges of ids; the first rows of a range go to the range before it too. An empty table gives no rows.
    """
    bounds, first = _ranges(docs)
    before = {int(first[i, 1]): int(first[i - 1, 0]) for i in range(len(first))}  # the first of all follows the last range

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            id_ = batch.column(0).to_numpy()
            part = np.searchsorted(bounds, id_, "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(id_), np.int32)), *batch.columns], ["part", "extra", "id", "text", "none"])
            again = [i for i, x in enumerate(id_.tolist()) if x in before]
            if again:
                some = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array([before[x] for x in id_[again].tolist()], pa.int64()), pa.array(np.ones(len(again), np.int32)), *some.columns], ["part", "extra", "id", "text", "none"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("none"))
    dealt = rows.mapInArrow(deal, "part long, extra int, id long, text string, none boolean").repartition("part").sortWithinPartitions("part", "extra", "id", "text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text, fingerprint, none) of a row whose next one has not come yet
        for batch in frames:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                part, extra, id_, text, none = (c.to_pylist() for c in piece.columns)
                marks, out = fingerprints(text), []
                for i in range(len(part)):
                    if held and held[0] == part[i]:
                        out.append((held, text[i], marks[i]))
                        held = None
                    if not extra[i]:
                        held = (part[i], id_[i], text[i], marks[i], none[i])
                if out:
                    edited = [h[2][: len(h[2]) - len(h[2]) // 2] + t[: len(h[2]) // 2] for h, t, _ in out]
                    new = fingerprints(edited)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if h[4] else h[1] for h, _, _ in out], pa.int64()),
                            pa.array([len(h[2]) for h, _, _ in out], pa.int64()),
                            pa.array([hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited]),
                            pa.array([h[3].astype(">u2").tobytes().hex() for h, _, _ in out]),
                            pa.array([m.astype(">u2").tobytes().hex() for m in new]),
                            pa.array([likeness(h[3], m) for (h, _, _), m in zip(out, new)]),
                            pa.array([likeness(h[3], m) for h, _, m in out]),
                        ],
                        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8(spark, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(common.table(spark, sf_dir, "documents"))
