"""Grouping of spelling variants by blocked Gram matrices.

Two words that differ by one code point agree in the first half of the shorter one's length or in the rest of it. So words
are dealt into blocks by the shorter length, the side and the code points there; a block holds the words of that length and of
the next one. Of a block's words the letter counts form a matrix; its Gram matrix gives all squared distances between counts.
One inserted or deleted code point makes a distance of 1, a replaced one of 2; pairs that have it are verified on the words.
A pair that agrees on both sides counts in the block of the first half alone.

Blocks beyond TILE words are cut by a hash of the word, and each pair of parts is a group of its own: no task holds a block.
What leaves a task is a row for each word and group, not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_COUNT, TYPO_MOD = 5, 3, 97
#: Words of a block that are one part; small blocks of one length that are multiplied together.
TILE, PACK = 1024, 512
#: Candidates times code points verified at once.
VERIFY = 1 << 22
#: Fixed value: the code points of a word once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = 26 + 64


def word_counts(docs: DataFrame, typo_mod: int = TYPO_MOD) -> DataFrame:
    """word, n: the runs of letters of all texts, one code point deleted in every ``typo_mod``-th run of a document."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({RUN})"), 1)).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(h % typo_mod == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def blocks(words: DataFrame, tile: int = TILE, least: int = 1) -> DataFrame:
    """m, side, part, a, b, own, word, n: each word once for each group that it belongs to, groups of one word left out.
    No word has fewer than ``least`` code points."""
    size = F.length("word")

    def keys(m):
        half = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("part")), F.struct(m.alias("m"), F.lit(1).alias("side"), F.substring(F.col("word"), size - (m - half) + 1, m - half).alias("part"))]

    member = words.select("word", "n", F.explode(F.concat(F.array(*keys(size)), F.array(*keys(size - 1)))).alias("k")).select("k.*", "word", "n").where(F.col("m") >= least)
    key = ["m", "side", "part"]
    held = member.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).drop("size")
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    met = member.join(held, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select(*key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "word", "n")


def _codes(words: list[str], width: int) -> np.ndarray:
    """The code points, a row for each word, filled up with zeros."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), width), np.uint8)  # no code point is above 255
    out[np.arange(width)[None, :] < length[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return out


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter stands in each word; float32 where all squares are exact in it."""
    column = np.where(codes >= 0xC0, codes.astype(np.int64) - 0xC0 + 26, codes.astype(np.int64) - ord("a"))
    row = np.repeat(np.arange(len(codes)), codes.shape[1])
    inside = codes.ravel() > 0
    flat = np.bincount((row * LETTERS + column.ravel())[inside], minlength=len(codes) * LETTERS)
    return flat.reshape(-1, LETTERS).astype(np.float32 if codes.shape[1] <= 2000 else np.float64)


def near_pairs(m: int, side: np.ndarray, group: np.ndarray, own: np.ndarray, split: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of one group that differ by one code point; of ``split`` groups only pairs of different parts."""
    codes = _codes(words, m + 1)
    counts = letter_counts(codes)
    square = np.einsum("ij,ij->i", counts, counts)
    long = codes[:, m] > 0
    found = []
    for lo in range(0, len(words), PACK):
        i = slice(lo, lo + PACK)
        distance = square[i, None] + square[None, lo:] - 2 * (counts[i] @ counts[lo:].T)
        ok = (distance == np.where(long[i, None] != long[None, lo:], 1, 2)) & (group[i, None] == group[None, lo:]) & ~(long[i, None] & long[None, lo:])
        ok &= ~(split[i, None] & (own[i, None] == own[None, lo:]))
        x, y = np.nonzero(np.triu(ok, 1))
        found.append(np.stack([x + lo, y + lo]))
    x, y = np.concatenate(found, axis=1)
    half, keep = m // 2, []
    for lo in range(0, len(x), step := max(1, VERIFY // (m + 1))):
        a, b = x[lo : lo + step], y[lo : lo + step]
        a, b = np.where(long[a], b, a), np.where(long[a], a, b)  # the longer one, if any, is b
        s, t = codes[a], codes[b]
        same = s[:, :m] == t[:, :m]
        lead = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        trail = np.logical_and.accumulate(s[:, m - 1 :: -1] == t[:, m:0:-1], axis=1).sum(axis=1)
        near = np.where(long[b], lead + trail >= m, same.sum(axis=1) == m - 1)
        keep.append(near & ((side[a] == 0) | (lead < half)))  # with the first half in common it counts there
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return x[ok], y[ok]


def _near(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> (word, n_near, form_n, form): the near words that the word has in a group, and the first of them."""

    def solve(m, side, group, own, split, words, n):
        x, y = near_pairs(m, side, group, own, split, words)
        if not len(x):
            return None
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        best = np.full(len(words), len(words))
        np.minimum.at(best, np.r_[x, y], place[np.r_[y, x]])
        near = np.bincount(np.r_[x, y], minlength=len(words))
        some = np.flatnonzero(near).tolist()
        form = [order[best[k]] for k in some]
        return pa.RecordBatch.from_arrays([pa.array([words[k] for k in some]), pa.array(near[some], pa.int64()), pa.array([int(n[k]) for k in form], pa.int64()), pa.array([words[k] for k in form])], ["word", "n_near", "form_n", "form"])

    def packs(t: pa.Table):
        """Whole groups of one length, PACK rows or one group at a time."""
        m, side, a, b, own, n = (t.column(c).to_numpy() for c in ("m", "side", "a", "b", "own", "n"))
        part, words = t.column("part").to_pylist(), t.column("word").to_pylist()
        first = np.flatnonzero(new(t))
        ends, at = np.r_[first[1:], len(m)], 0
        number = np.cumsum(new(t))
        for k, end in enumerate(ends.tolist()):
            if k + 1 == len(ends) or m[end] != m[at] or ends[k + 1] - at > PACK:
                s = slice(at, end)
                yield solve(int(m[at]), side[s], number[s], own[s], (a != b)[s], words[s], n[s])
                at = end

    def new(t: pa.Table) -> np.ndarray:
        """Where a group begins."""
        part = t.column("part").to_numpy(zero_copy_only=False)
        out = np.ones(t.num_rows, bool)
        out[1:] = part[1:] != part[:-1]
        for c in ("m", "side", "a", "b"):
            v = t.column(c).to_numpy()
            out[1:] |= v[1:] != v[:-1]
        return out

    held: pa.Table | None = None
    for batch in frames:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        cut = int(np.flatnonzero(new(t))[-1]) if t.num_rows else 0
        held = t.slice(cut)
        yield from filter(None, packs(t.slice(0, cut)) if cut else ())
    if held is not None and held.num_rows:
        yield from filter(None, packs(held))


def near_words(words: DataFrame, tile: int = TILE, least: int = 1) -> DataFrame:
    """word, n_near, form_n, form for each word that has a near one: their number, and the one of largest n (then least word).

    Words are different, of the letters of RUN, and have ``least`` code points or more.
    """
    grouped = blocks(words, tile, least)
    key = ["m", "side", "part", "a", "b"]
    parts = grouped.repartition(*key).sortWithinPartitions(*key)
    found = parts.mapInArrow(_near, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(links: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """word, root: the last word on the way from word over forms. A form has at least twice its word's count, so a way has
    fewer than 63 steps and each round of pointer doubling halves what is left: seven rounds at most."""
    ways = common.written(links.select(F.col(word).alias("word"), F.col(form).alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        next_ = common.written(ways.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "ways")
        if next_.where("moved").isEmpty():
            return next_.drop("moved")
        ways = next_.drop("moved")


def spelling_variants(docs: DataFrame, typo_mod: int = TYPO_MOD, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least ``min_chars`` code points and ``min_count`` occurrences.

    Null texts have no words and a null doc_id counts as empty text where runs are chosen; rows that repeat count each time;
    ties between near words go to the least in code-point order; words of any length are compared whole; an empty table, or
    one without such words, gives no rows. Other columns are not looked at.
    """
    words = common.written(word_counts(docs, typo_mod).where((F.length("word") >= min_chars) & (F.col("n") >= min_count)), "words")
    near = near_words(words, tile, min_chars)
    formed = (F.col("form_n") >= 2 * F.col("n")).alias("formed")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    rows = common.written(rows, "near")
    return rows.join(roots(rows.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(common.table(spark, sf_dir, "documents"))


ORACLE_OP11 = r"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS b, 0 AS k, b::BIGINT AS c FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), steps AS (SELECT list(c ORDER BY b) AS s FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(x) * 2, 2), lambda i: ('0x' || hex(x)[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, s[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM (SELECT run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM counted), steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), near AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS m FROM pairs GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN form END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN near USING (word)
), ways AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT w.word, w.next, f.form FROM ways w JOIN forms f ON f.word = w.next
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON w.word = f.word AND w.next IS NULL
"""
