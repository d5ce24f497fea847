"""Scoring texts by a class-based bigram model whose classes are found by exchange.

P(word | word before) = P(class | class before) * P(word | class). What is moved between classes are units: each of the CLUSTERED
most frequent training words is one, all other words are one with those of the same ending (ENDINGS hashed endings), and the
end of a text is one with a class to itself. So every word, in training or not, has a class, and counts of neighbouring units
are bounded by the number of units. An exchange round counts each unit's neighbours by class in tasks, over all training
texts; the driver holds a unit's counts by class and moves one unit after another to the class that raises the likelihood most.

Transitions are smoothed after Witten and Bell; a word's probability in its class is (count - d) / tokens of the class, with
Ney's d = n1 / (n1 + 2 n2), and what is taken off goes to unseen words of the class. Counts of all training words stand in a table.
Up to FREQUENT of the most frequent go to all tasks; all others, which are rarer than each of these, are joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import batches, mix, word_hashes

CLASSES, CLUSTERED, ENDINGS, FREQUENT = 64, 2048, 1024, 1 << 18
ROUNDS = 6
HELD_MOD, HELD = 7, 2
#: Different words that a task gathers before they leave it.
GATHER = 1 << 20


def words_of(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts: (first index, hashes of all words, their endings, where each text's words begin)."""
    for first, group in batches(texts):
        data = b" ".join(group).lower()
        h, start, end = word_hashes(data)
        a = np.frombuffer(data, np.uint8).astype(np.uint64)
        last = np.full(len(h), 1, np.uint64)
        for k in (1, 2, 3):
            last = np.where(end - k >= start, (last << np.uint64(8)) | a[np.maximum(end - k, 0)], last)
        at = np.cumsum([0, *(len(b) + 1 for b in group)])
        yield first, h.view(np.int64), (mix(last) % np.uint64(ENDINGS)).astype(np.int32), np.searchsorted(start, at)


def held_out():
    """Texts that nothing is learned from; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_MOD == HELD


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """h, ending, n of all words; counts are added up in tasks first."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def packed():
            h, e, n = (np.concatenate(x) for x in zip(*parts))
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, e[at], np.bincount(inv, n, len(u)).astype(np.int64)

        def batch():
            return pa.RecordBatch.from_arrays([*map(pa.array, packed())], ["h", "ending", "n"])

        for frame in frames:
            for part in common.slices([frame]):
                for _, h, e, _ in words_of(part.column(0).to_pylist()):
                    u, at, n = np.unique(h, return_index=True, return_counts=True)
                    parts.append((u, e[at], n))
                    held += len(u)
                    if held > 2 * GATHER:
                        parts[:] = [packed()]
                        held = len(parts[0][0])
                        if held > GATHER:
                            yield batch()
                            parts, held = [], 0
        if parts:
            yield batch()

    return texts.mapInArrow(run, "h long, ending int, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Units:
    """The most frequent words by hash: their counts and their units."""

    h: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    clustered: int

    @property
    def size(self) -> int:
        return self.clustered + ENDINGS + 1

    @property
    def end(self) -> int:
        return self.size - 1

    def find(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each word, and its count or 0 if it is not among the frequent ones."""
        if not len(self.h):
            return self.clustered + ending.astype(np.int64), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return np.where(known, self.unit[at], self.clustered + ending), np.where(known, self.n[at], 0)


def frequent_units(counts: DataFrame, clustered: int = CLUSTERED, frequent: int = FREQUENT) -> tuple[Units, np.ndarray, np.ndarray]:
    """The units, and the counts and endings of those words that are one each (the first ``clustered`` by count and hash).

    At most ``frequent`` words come to the driver: all whose count is above a bound, which a histogram of the counts gives."""
    bin_ = F.floor(F.log2("n") * 256)
    sizes = sorted(((r["bin"], r["words"]) for r in counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
    held = np.cumsum([k for _, k in sizes]) <= frequent
    top = counts.where(bin_ >= sizes[int(held.sum()) - 1][0]) if held.any() else counts.where("false")
    top = top.select("h", "n", "ending").toArrow()
    h, n, ending = (top.column(c).to_numpy() for c in ("h", "n", "ending"))
    order = np.lexsort((h, -n))
    h, n, ending = h[order], n[order], ending[order]
    unit = np.where(np.arange(len(h)) < clustered, np.arange(len(h)), clustered + ending).astype(np.int64)
    order = np.argsort(h)
    return Units(h[order], n[order], unit[order], clustered), n[:clustered], ending[:clustered]


def sequence(units: Units, h: np.ndarray, ending: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Some texts as one sequence of units, an end before the first and after each: (units, counts, words' places, ends' places)."""
    unit, n = units.find(h, ending)
    rows = len(cut) - 1
    place = np.arange(len(h)) + 1 + np.repeat(np.arange(rows), np.diff(cut))
    ends = np.r_[0, cut[1:] + np.arange(1, rows + 1)]
    out = np.full(len(h) + rows + 1, units.end)
    out[place] = unit
    return out, n, place, ends


def count_neighbours(texts: DataFrame, units: Units) -> DataFrame:
    """u, left, left_n, right, right_n: each unit with those before and after it; as many at most as there are units."""
    size = units.size

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size * size, np.int64)
        for frame in frames:
            for part in common.slices([frame]):
                for _, h, e, cut in words_of(part.column(0).to_pylist()):
                    s = sequence(units, h, e, cut)[0]
                    np.add.at(seen, s[:-1] * size + s[1:], 1)
        some = np.flatnonzero(seen)
        for lo in range(0, len(some), 1 << 18):
            k = some[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((k // size).astype(np.int32)), pa.array((k % size).astype(np.int32)), pa.array(seen[k])], ["u", "v", "n"])

    pairs = common.written(texts.mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n")), "pairs")
    both = pairs.select("u", "v", F.lit(True).alias("right"), "n").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("right"), "n"))
    return common.written(both.groupBy("u").agg(F.collect_list(F.struct("v", "right", "n")).alias("near")).select("u", "near.v", "near.right", "near.n"), "neighbours")


def by_class(neighbours: DataFrame, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit how often each class stands before and after it: two matrices of units x classes, which come to the driver."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            lists = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            v, right, n = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            flat = np.bincount((row * 2 + right) * classes + of[v], n, b.num_rows * 2 * classes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in flat.reshape(b.num_rows, -1)], pa.binary())], ["u", "counts"])

    left, right = np.zeros((2, len(of), classes))
    for r in neighbours.mapInArrow(run, "u int, counts binary").collect():
        left[r["u"]], right[r["u"]] = np.frombuffer(r["counts"], np.int64).reshape(2, classes)
    return left, right


def _phi(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0)
    return x * np.log(np.maximum(x, 1))


def exchange(of: np.ndarray, left: np.ndarray, right: np.ndarray, movable: np.ndarray) -> int:
    """Moves one unit after another (``of`` changes) to the class of largest likelihood; neighbours' classes are those of the
    round's beginning. Class 0 is the end's. Returns how many moved."""
    classes = left.shape[1]
    n = np.zeros((classes, classes))
    np.add.at(n, of, right)  # rows: class before, columns: class after
    moved = 0
    for u in movable.tolist():
        own, a, b = of[u], left[u], right[u]
        n[:, own] -= a
        n[own] -= b
        before, after = n.sum(axis=1), n.sum(axis=0)
        total = a.sum()
        i, j = np.flatnonzero(a), np.flatnonzero(b)
        gain = (_phi(n[i] + a[i, None]) - _phi(n[i])).sum(axis=0) + (_phi(n[:, j] + b[j]) - _phi(n[:, j])).sum(axis=1)
        gain -= _phi(before + total) - _phi(before) + _phi(after + total) - _phi(after)
        gain[0] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= gain[own] + 1e-9:
            best = own
        n[:, best] += a
        n[best] += b
        moved += best != own
        of[u] = best
    return moved


@dataclass
class Model:
    """What the tasks need: units, classes, log10 probabilities; and the corpus's totals."""

    units: Units
    of: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    seen: np.ndarray  # log10 of a class's tokens
    unseen: np.ndarray  # log10 of what is taken off in a class
    discount: float
    tokens: int
    types: int
    texts: int


def start_classes(units: Units, weight: np.ndarray, classes: int) -> np.ndarray:
    """By rank of frequency, in turn; the end alone in class 0."""
    of = np.zeros(units.size, np.int64)
    words = np.argsort(-weight[:-1], kind="stable")
    of[words] = 1 + np.arange(len(words)) % (classes - 1)
    return of


def learn(docs: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, frequent: int = FREQUENT, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the table (h, n) of all training words."""
    texts = training(docs)
    frequent = max(frequent, clustered)
    counts = common.written(count_words(texts), "counts")
    endings = counts.groupBy("ending").agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).toPandas()
    rows = texts.count()
    units, own, own_ending = frequent_units(counts, clustered, frequent)
    weight, types = np.zeros(units.size), np.zeros(units.size)
    at = clustered + endings["ending"].to_numpy(np.int64)
    weight[at], types[at] = endings["n"], endings["types"]
    np.subtract.at(weight, clustered + own_ending, own)
    np.subtract.at(types, clustered + own_ending, 1)
    weight[: len(own)], types[: len(own)] = own, 1
    weight[-1] = types[-1] = rows
    once, twice = int(endings["once"].sum()), int(endings["twice"].sum())
    of = start_classes(units, weight, classes)
    neighbours = count_neighbours(texts, units)
    movable = np.argsort(-weight[:-1], kind="stable")[: int((weight[:-1] > 0).sum())]
    for _ in range(rounds):
        if not exchange(of, *by_class(neighbours, of, classes), movable):
            break
    n = np.zeros((classes, classes))
    np.add.at(n, of, by_class(neighbours, of, classes)[1])
    types[-1] = float(rows > 0)
    tokens_of, types_of = np.bincount(of, weight, classes), np.bincount(of, types, classes)
    of[:-1][weight[:-1] == 0] = int(types_of[1:].argmax()) + 1  # units without a token: the class of most words
    alone = (n.sum(axis=0) + 1) / (n.sum() + classes)
    kinds = (n > 0).sum(axis=1, keepdims=True) + 1
    step = np.log10((n + kinds * alone) / (n.sum(axis=1, keepdims=True) + kinds))
    discount = (once + 1) / (once + 2 * twice + 2)
    model = Model(units, of, step, np.log10(np.maximum(tokens_of, 1)), np.log10(np.where(tokens_of > 0, discount * np.maximum(types_of, 1), 1)), discount, int(weight.sum()), int(types.sum()), rows)
    return model, counts.select("h", "n")


def score_texts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    A task adds up a text's transitions and frequent words; each other word of a text is joined with its count.
    """
    m, low = model, float(np.log10(model.tokens + model.types + 1))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in common.slices([frame]):
                one, two, id_ = (part.column(k) for k in range(3))
                for first, h, e, cut in words_of(part.column(3).to_pylist()):
                    rows = len(cut) - 1
                    s, n, place, ends = sequence(m.units, h, e, cut)
                    c = m.of[s]
                    row = np.repeat(np.arange(rows), np.diff(cut))
                    value, base = np.zeros(len(s)), np.zeros(len(s))
                    value[1:] = m.step[c[:-1], c[1:]]
                    value[place] -= m.seen[c[place]]
                    known = n > 0
                    value[place[known]] += np.log10(n[known] - m.discount)
                    base[place[known]] = np.log10(n[known] + 1)
                    base[ends[1:]] = np.log10(m.texts + 1)
                    whose = np.repeat(np.arange(rows), np.diff(ends))
                    sums = np.bincount(whose, value[1:], rows), np.bincount(whose, base[1:], rows)
                    seen = np.bincount(row[known], minlength=rows) + (m.texts > 0)
                    at = pa.array(np.arange(first, first + rows))
                    zero = np.zeros(rows)
                    yield pa.RecordBatch.from_arrays([one.take(at), two.take(at), id_.take(at), one.take(at), pa.array(np.zeros(rows, np.int32)), pa.array(zero.astype(np.int32)), pa.array(np.diff(cut) + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(sums[1]), pa.array(sums[0])], names)
                    rare = np.flatnonzero(~known)
                    if len(rare):
                        order = rare[np.lexsort((h[rare], row[rare]))]
                        new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])
                        times = np.diff(np.r_[new, len(order)]).astype(np.int32)
                        w = order[new]
                        at = pa.array(first + row[w])
                        none = pa.nulls(len(w), pa.int64())
                        yield pa.RecordBatch.from_arrays([one.take(at), two.take(at), none, pa.array(h[w]), pa.array(times), pa.array(c[place[w]].astype(np.int32)), none, none, pa.nulls(len(w), pa.float64()), pa.nulls(len(w), pa.float64())], names)

    names = ["k1", "k2", "doc_id", "h", "times", "class", "n_tokens", "n_known", "base", "value"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*common.row_keys(), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = rows.mapInArrow(run, "k1 long, k2 long, doc_id long, h long, times int, class int, n_tokens long, n_known long, base double, value double")
    met = found.join(counts.select("h", "n", F.lit(True).alias("word")), (found["h"] == counts["h"]) & (found["times"] > 0), "left")
    rare, known = F.col("times") > 0, F.col("n").isNotNull()
    unseen = F.element_at(F.array(*(F.lit(float(x)) for x in m.unseen)), F.col("class") + 1)
    terms = met.select(
        "k1", "k2", "doc_id", "n_tokens",
        F.when(rare, F.when(known, F.col("times")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(rare, F.when(known, F.col("times") * F.log10(F.col("n") + 1)).otherwise(0.0)).otherwise(F.col("base")).alias("base"),
        F.when(rare, F.col("times") * F.when(known, F.log10(F.col("n") - m.discount)).otherwise(unseen)).otherwise(F.col("value")).alias("value"),
    )
    per = terms.groupBy("k1", "k2").agg(F.max("doc_id").alias("doc_id"), F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("value").alias("value"))
    each = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies") - F.col("n_tokens") * low).alias("base_score"), (F.col("value") / F.col("copies")).alias("score"))


def score(docs: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """Learns from the rows of ``docs`` that are not held out and scores them all (see ``score_texts``).

    Null texts count as empty (one token, the end); rows that repeat are learned from and scored each; very long texts are
    read whole; an empty table gives no rows, and with nothing to learn from all words are unseen. Other columns are not looked at.
    """
    return score_texts(docs, *learn(docs, classes, clustered, frequent, rounds))


def op13(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
