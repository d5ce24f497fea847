"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of WINDOW words; words hash to FEATURES terms. Weights are tf * idf; document
frequencies count every passage of the corpus. A distributed randomised SVD gives the latent basis: each task
adds A^T(A G) of its passages for a fixed Gaussian G, the driver takes the eigenvectors of the Nystroem
approximation of A^T A. (Every passage of every text and item is in that sum, as every one is counted, indexed and searched.)
Items, or overlapping parts of long ones, are the queries; each text passage whose cosine with one reaches CANDIDATE and which has enough of the item's weight in terms is a candidate, which is
confirmed on the words: the longest common subsequence of the item and the surrounding words, and a check of the item's
answer (its closing words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import batches, word_hashes

WINDOW = 16
#: Words of a query, and the step between two of one item. An item of 15 words or more that stands in a text fills half of a
#: passage at least, which has a cosine of about 0.5 with a query of so many words.
QUERY, STEP = 40, 20
FEATURES, RANK = 1 << 15, 128
#: Passages whose products are added up at once, of as many texts as it takes; tasks that add up (as many as cores, if that is more),
#: each with a sum of its own.
GRAM_PASSAGES, BASIS_TASKS = 1 << 13, 12
#: Terms whose rows a task adds, or passes on, at once: what it holds is the sum and the terms' own numbers, little else.
TERMS = 4096
#: Entries of a sum beyond which it is added up in parts of so many (under 128); sums that are kept in the cache while they are added up.
OFTEN, SUMS = 40, 256
#: Of a passage and a query. A guard with room, which costs little: the README has what is lost at higher ones.
CANDIDATE = 0.1
#: A candidate passage shares words of the item that weigh as much as this many of the item's mean word, or half the item.
SHARED = 6
#: An item is found if this share of its words is a common subsequence, or the lower one with the answer found.
FOUND, FOUND_WITH_ANSWER, ANSWER = 0.75, 0.55, 0.6
#: Terms that more than a sixteenth of the items hold, at most so many: these are a dense product, the others a list of items each.
USUAL = 256
#: Items searched in one pass over the corpus; passages that are multiplied with all their queries at once, and products of those.
ITEM_BLOCK, PASSAGES, PRODUCTS = 4000, 512, 1 << 19


#: ASCII characters other than letters and digits part words, so that marks added to words change nothing.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 15)).astype(np.int64)


class Group:
    """Some neighbouring texts, read together: the lower-cased words (joined bytes, starts, ends), their terms and passages."""

    def __init__(self, first: int, joined: bytes, start, end, h, cut):
        self.first, self.joined, self.start, self.end, self.term, self.cut = first, joined, start, end, terms(h), cut
        length = np.diff(cut)
        self.base = np.r_[0, np.cumsum(-(-length // WINDOW))]  # each text's first passage
        inside = np.arange(len(h)) - np.repeat(cut[:-1], length)
        self.passage = np.repeat(self.base[:-1], length) + inside // WINDOW
        self.at = np.searchsorted(self.passage, np.arange(self.base[-1] + 1))  # each passage's first word

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.joined[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


def _spans(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, between which _PLAIN leaves nothing but spaces."""
    word = np.frombuffer(b" %b " % plain, np.uint8) != 32
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def groups(texts) -> Iterator[Group]:
    """Texts by about a megabyte; nulls count as empty."""
    for first, group in batches(t.lower() if t else "" for t in texts):
        joined = b" ".join(group).translate(_PLAIN)
        h, start, end = word_hashes(joined, _spans(joined))
        yield Group(first, joined, start, end, h, np.searchsorted(start, np.cumsum([0, *(len(b) + 1 for b in group)])))


def _term_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, passages = np.zeros(FEATURES, np.int64), 0
    for batch in common.slices(frames):
        for g in groups(batch.column(0).to_pylist()):
            pair = np.sort(g.passage * FEATURES + g.term)
            pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
            count += np.bincount(pair % FEATURES, minlength=FEATURES)
            passages += int(g.base[-1])
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[count[used], passages])], ["term", "n"])


def idf(docs: DataFrame) -> np.ndarray:
    """Of each term over all passages, above 0 however common it is (an item may be in most texts); FEATURES numbers come
    to the driver, whatever the corpus."""
    rows = docs.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    total = max(df[FEATURES], 1)
    return np.log1p((total + 1) / (df[:FEATURES] + 1)).astype(np.float32)


def added_up(rows: np.ndarray, at: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each group, ``length`` entries of ``at`` from ``first`` on (one or more), the sum of the ``rows`` they name."""
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    long = length > OFTEN
    if long.any():  # parts of OFTEN entries, then these parts
        n = -(-length[long] // OFTEN)
        base = np.cumsum(n) - n
        before = OFTEN * (np.arange(n.sum()) - np.repeat(base, n))
        parts = added_up(rows, at, np.repeat(first[long], n) + before, np.minimum(OFTEN, np.repeat(length[long], n) - before))
        out[long] = added_up(parts, np.arange(len(parts)), base, n)
    short = np.flatnonzero(~long)
    short = short[np.argsort(-length[short].astype(np.int8), kind="stable")]
    sums, more = np.empty((2, SUMS, rows.shape[1]), rows.dtype)
    for lo in range(0, len(short), SUMS):
        some = short[lo : lo + SUMS]
        start, left, s = first[some], -length[some], sums[: len(some)]
        np.take(rows, at[start], axis=0, out=s, mode="clip")
        for k in range(1, -int(left[0])):  # the k-th entries of all these groups that have as many
            n = int(np.searchsorted(left, -k))
            np.take(rows, at[start[:n] + k], axis=0, out=more[:n], mode="clip")
            s[:n] += more[:n]
        out[some] = s
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-9)


def project(term: np.ndarray, first: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of passages, whose words ``term`` stand one after the other, each passage from ``first`` on."""
    return unit(added_up(basis, term, first, np.diff(np.r_[first, len(term)])))


def _passages(texts_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms and the lengths of the passages of some lists of texts, GRAM_PASSAGES or more (the last time fewer) at once."""
    held, n = [], 0
    for texts in texts_of:
        for group in groups(texts):
            for lo in range(0, int(group.base[-1]), GRAM_PASSAGES):
                at = group.at[lo : lo + GRAM_PASSAGES + 1]
                held.append((group.term[at[0] : at[-1]], np.diff(at)))
                n += len(at) - 1
                if n >= GRAM_PASSAGES:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _gram(texts_of, weighted: np.ndarray) -> np.ndarray:
    """C^T(C W) of the passages of some lists of texts, for their counts C of terms."""
    z = np.zeros(weighted.shape)
    for t, length in _passages(texts_of):
        y = added_up(weighted, t, np.cumsum(length) - length, length)
        order = np.argsort(t.astype(np.uint16), kind="stable")
        passage, t = np.repeat(np.arange(len(length)), length)[order], t[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        n = np.diff(np.r_[first, len(t)])
        for lo in range(0, len(first), TERMS):
            some = slice(lo, lo + TERMS)
            z[t[first[some]]] += added_up(y, passage, first[some], n[some])
    return z


def fit_basis(texts: DataFrame, weight: np.ndarray) -> np.ndarray:
    """FEATURES x RANK, of all passages of ``texts`` (text): maps term weights to a passage's row of U S^(1/2). (In U S a few
    directions such as the language would make all passages alike; in U an item that very many texts hold would weigh next to
    nothing in its own direction.)"""
    g = np.random.default_rng(5).standard_normal((FEATURES, RANK + 16)).astype(np.float32)
    sc = texts.sparkSession.sparkContext
    shipped, tasks = sc.broadcast((g * weight[:, None], weight)), max(BASIS_TASKS, sc.defaultParallelism)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, weight = shipped.value
        z = _gram((b.column(0).to_pylist() for b in common.slices(frames)), weighted)
        used = np.flatnonzero(z.any(axis=1))
        for lo in range(0, len(used), TERMS):
            some = used[lo : lo + TERMS]
            rows = (z[some] * weight[some, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([row.tobytes() for row in rows], pa.binary())], ["term", "row"])

    def added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each term, from rows sorted by term."""
        held, total = None, None
        for batch in frames:
            terms_, rows = [], []
            for t, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(row, np.float32)
                if t == held:
                    total = total + v
                    continue
                if held is not None:
                    terms_.append(held)
                    rows.append(total.tobytes())
                held, total = t, v
            yield pa.RecordBatch.from_arrays([pa.array(terms_, pa.int64()), pa.array(rows, pa.binary())], ["term", "row"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["term", "row"])

    schema = "term long, row binary"
    parts = texts.select("text").coalesce(tasks).mapInArrow(run, schema).repartition(BASIS_TASKS, "term").sortWithinPartitions("term").mapInArrow(added, schema)
    z = np.zeros(g.shape, np.float32)
    for r in parts.toLocalIterator():
        z[r["term"]] = np.frombuffer(r["row"], np.float32)
    shipped.destroy()
    core = (g.T @ z).astype(float)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-6 * max(value.max(), 1e-9)
    b = z @ (vector[:, good] / np.sqrt(value[good])).astype(np.float32)  # A^T A is about b b^T
    sv, rot = np.linalg.eigh((b.T @ b).astype(float))
    top = np.argsort(-sv)[:RANK]
    v = b @ (rot[:, top] / np.maximum(sv[top], 1e-9) ** 0.75).astype(np.float32)  # right vectors over the roots of singular values
    return v * weight[:, None]


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def confirmed(item: list[bytes], around: list[bytes]) -> tuple[bool, float, float]:
    share = lcs(item, around) / len(item)
    answer = item[-max(3, len(item) // 4) :]
    got = lcs(answer, around) / len(answer) if share >= FOUND_WITH_ANSWER else 0.0
    return share >= FOUND or (share >= FOUND_WITH_ANSWER and got >= ANSWER), share, got


def search(docs: DataFrame, items: list[tuple[int, str]], weight: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(key, item_id, lcs_share, answer_share, word_at): confirmed items of each row of ``docs`` (key, text); a written table."""
    words, listed, query, owner, own = [], [], [], [], []
    for g in groups([t for _, t in items]):
        for i in range(len(g.cut) - 1):
            a, b = int(g.cut[i]), int(g.cut[i + 1])
            t = g.term[a:b]
            for at in sorted({*range(0, max(1, len(t) - QUERY + 1), STEP), max(0, len(t) - QUERY)}) if len(t) else ():
                query.append(project(t[at : at + QUERY], np.zeros(1, np.int64), basis)[0])
                owner.append(len(words))
            words.append(g.words(a, b))
            listed.append(t)
            own.append(np.unique(t))
    mean = np.array([weight[t].mean() if len(t) else np.inf for t in own])  # an item without words has no candidates
    need = 0.999 * np.minimum(SHARED * mean, np.array([max(1, len(w)) for w in words]) * mean / 2)
    held, item = np.concatenate([*own, np.empty(0, np.int64)]), np.repeat(np.arange(len(own)), np.array([len(t) for t in own], int))
    many = np.bincount(held, minlength=FEATURES)
    usual = np.argsort(-many, kind="stable")[:USUAL]
    usual = usual[many[usual] * 16 > len(own)]
    place = np.full(FEATURES, -1)  # among the usual terms
    place[usual] = np.arange(len(usual))
    dense, rare = np.zeros((len(usual), len(own)), np.float32), place[held] < 0
    dense[place[held[~rare]], item[~rare]] = 1
    item = item[rare][np.argsort(held[rare], kind="stable")]  # of each term, from start[term] to start[term + 1]
    start = np.r_[0, np.cumsum(np.bincount(held[rare], minlength=FEATURES))]
    shipped = docs.sparkSession.sparkContext.broadcast(
        (weight, basis, np.array(query, np.float32).reshape(-1, basis.shape[1]), np.array(owner, np.int64), words, listed, [i for i, _ in items], need, many > 0, place, dense, item, start)
    )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis, q, owner, words, listed, ids, need, of_items, place, dense, item, start = shipped.value
        hold = weight * of_items
        here = np.zeros(FEATURES, bool)
        least, at_once = 0.999 * need.min(initial=np.inf), max(1, min(PASSAGES, PRODUCTS // max(1, len(q))))

        def shared(t: np.ndarray, length: np.ndarray) -> np.ndarray:
            """Weight of the words of each passage that are in each item; the passages' words stand one after the other."""
            p, n = np.repeat(np.arange(len(length)), length), start[t + 1] - start[t]
            at = np.repeat(start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rest = np.bincount(np.repeat(p * len(words), n) + item[at], np.repeat(weight[t], n), minlength=len(length) * len(words))
            c = place[t]
            p, c, w = p[c >= 0], c[c >= 0], weight[t[c >= 0]]
            often = np.bincount(p * len(dense) + c, w, minlength=len(length) * len(dense)).astype(np.float32)
            return rest.reshape(-1, len(words)) + often.reshape(len(length), len(dense)) @ dense

        def candidates(g: Group) -> Iterator[tuple[int, int, int]]:
            """(text, the passage's first word, item)."""
            if not len(q) or not len(g.term):
                return
            # a passage whose words of any item weigh less than what each item asks for is no candidate of one
            able = np.add.reduceat(hold[g.term], g.at[:-1]) >= least
            t, length = g.term[np.repeat(able, np.diff(g.at))], np.diff(g.at)[able]
            able, at = np.flatnonzero(able), np.r_[0, np.cumsum(length)]
            for lo in range(0, len(able), at_once):
                some = able[lo : lo + at_once]
                enough = shared(t[at[lo] : at[lo + len(some)]], length[lo : lo + at_once]) >= need
                rows = np.flatnonzero(enough.any(axis=1))
                near = unit(added_up(basis, t, at[lo + rows], length[lo + rows])) @ q.T >= CANDIDATE
                p, c = np.nonzero(near & enough[rows][:, owner])
                pair = np.unique(rows[p] * len(words) + owner[c])
                p = some[pair // len(words)]
                yield from zip((np.searchsorted(g.base, p, "right") - 1).tolist(), g.at[p].tolist(), (pair % len(words)).tolist())

        def too_few(around: np.ndarray, k: int) -> bool:
            """Whether fewer of the item's words are among those around (by their terms) than a common subsequence has to have."""
            here[around] = True
            n = np.count_nonzero(here[listed[k]])
            here[around] = False
            return n / len(words[k]) < FOUND_WITH_ANSWER

        for batch in common.slices(frames):
            keys, out = batch.column(0).to_pylist(), {}
            for g in groups(batch.column(1).to_pylist()):
                for i, w0, k in candidates(g):
                    n = len(words[k])
                    lo, hi = max(int(g.cut[i]), w0 - n), min(int(g.cut[i + 1]), w0 + WINDOW + n)
                    if too_few(g.term[lo:hi], k):
                        continue
                    ok, share, got = confirmed(words[k], g.words(lo, hi))
                    found = (share, got, int(g.cut[i]) - w0)
                    if ok and found > out.get((g.first + i, k), (0,)):
                        out[g.first + i, k] = found
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[r] for r, _ in out], pa.int64()), pa.array([ids[k] for _, k in out], pa.int64()), *(pa.array([float(x[j]) for x in out.values()]) for j in range(2)), pa.array([-x[2] for x in out.values()], pa.int64())],
                    ["key", "item_id", "lcs_share", "answer_share", "word_at"],
                )

    found = common.written(docs.mapInArrow(run, "key long, item_id long, lcs_share double, answer_share double, word_at long"), "leaks")
    shipped.destroy()
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, key=None) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, word_at (the best passage's first word): one row for each row of ``docs`` and
    benchmark item found in it. With ``key``, a column of long numbers, ``key`` stands in place of doc_id.

    Items are read in blocks of ITEM_BLOCK; null, empty and word-less texts and items match nothing; repeated items and
    repeated documents give a row each; texts of any length are read whole; empty tables give no rows.
    """
    slim = docs.select((key if key is not None else F.col("doc_id")).cast("long").alias("key"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    weight, out, block = idf(slim), None, []
    basis = fit_basis(slim.select("text").unionByName(items.select("text")), weight)

    def one(block):
        nonlocal out
        found = search(slim, block, weight, basis)
        out = found if out is None else out.unionByName(found)

    for r in items.orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEM_BLOCK:
            one(block)
            block = []
    if block or out is None:
        one(block)
    return out if key is not None else out.withColumnRenamed("key", "doc_id")


def op4(spark, sf_dir: str) -> DataFrame:
    found = leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share"))


def leak_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item. Null and repeated ids are judged by their own texts; other
    columns, of whatever name, are kept as they are."""
    key = common.spare_name(docs, "_key")
    found = leaks(docs, common.table(spark, sf_dir, "benchmark"), common.row_key()).select(F.col("key").alias(key)).distinct()
    bad = common.written(found, "leaks")
    small = bad.count() <= common.BROADCAST_ROWS
    return docs.withColumn(key, common.row_key()).join(F.broadcast(bad) if small else bad, key, "left_anti").drop(key)
