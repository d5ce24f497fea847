"""A quality classifier as a sparse rule ensemble.

Statistics of a text are Spark column expressions. On a bounded labelled sample small trees are grown on resampled
rows and pseudo-residuals; every path from a root to a node is a conjunctive rule. A lasso logistic regression over the rules keeps few
of them, which are compiled back into one Spark expression: scoring is JVM-side and narrow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of the sample, trees, their depth and leaf size, candidate thresholds, the lasso penalty.
SAMPLE, TREES, DEPTH, LEAF_ROWS, THRESHOLDS, LASSO = 20_000, 40, 3, 40, 24, 0.0015
PASS_SCORE = 0.3


def statistics() -> dict[str, Column]:
    """Per text, never null: null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text).cast("double")
    per_char = lambda c: c.cast("double") / F.greatest(n, F.lit(1.0))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.split(text, r"[ \n\t]+")
    n_words = F.size(words).cast("double")
    lines = F.split(text, "\n")
    return {
        "log_chars": F.log1p(n),
        "word_chars": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_words_by_root": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_chars": F.log1p(n / F.size(lines)),
        "upper": per_char(without("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÑÓÔÖÚÜ")),
        "shouts": per_char(without("!")),
        "bars": per_char(without("|")),
        "symbols": per_char(without("#%$&*<>{}[]\\^~@")),
        "digits": per_char(without("0123456789")),
        "stops": per_char(without(".,;:?")),
    }


class Rules:
    def __init__(self, names: list[str], rules: list[tuple], coef: np.ndarray, bias: float):
        self.names, self.rules, self.coef, self.bias = names, rules, coef, bias

    def score(self) -> Column:
        """P(label 1) from the statistics' columns."""
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.coef):
            held = F.lit(True)
            for feature, above, value in rule:
                c = F.col(self.names[feature])
                held = held & ((c > value) if above else (c <= value))
            total = total + F.when(held, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree_rules(x, target, cuts, rng, path, rows, depth, out):
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * LEAF_ROWS:
        return
    t, best = target[rows], None
    for f in rng.choice(x.shape[1], max(1, int(np.ceil(x.shape[1] * 0.6))), replace=False):
        v = x[rows, f]
        for c in cuts[f]:
            left = v <= c
            k = int(left.sum())
            if LEAF_ROWS <= k <= len(rows) - LEAF_ROWS:
                a, b = t[left].sum(), t[~left].sum()
                gain = a * a / k + b * b / (len(rows) - k)
                if best is None or gain > best[0]:
                    best = (gain, f, c)
    if best is None:
        return
    _, f, c = best
    left = x[rows, f] <= c
    _tree_rules(x, target, cuts, rng, [*path, (int(f), False, float(c))], rows[left], depth - 1, out)
    _tree_rules(x, target, cuts, rng, [*path, (int(f), True, float(c))], rows[~left], depth - 1, out)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 3) -> Rules:
    if not len(y) or y.min() == y.max():  # one label only
        return Rules(names, [], np.empty(0), 4.0 if not len(y) or y[0] else -4.0)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, THRESHOLDS))) for f in range(x.shape[1])]
    found: set = set()
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for k in range(TREES):
        rows = rng.choice(len(y), min(len(y), 3000), replace=True, p=balance / balance.sum())
        grown: set = set()
        mean = np.average(y, weights=balance)
        _tree_rules(x, (y - mean), cuts, rng, [], rows, 1 + k % DEPTH, grown)
        found |= grown
    rules = sorted(found)
    m = np.ones((len(y), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, above, c in rule:
            m[:, j] *= (x[:, f] > c) if above else (x[:, f] <= c)
    m, keep = np.unique(m, axis=1, return_index=True)
    rules = [rules[i] for i in keep]
    w, b = np.zeros(m.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
    z, zb, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(m, 2) ** 2 / len(y) + 1)
    for _ in range(400):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-np.clip(m @ z + zb, -30, 30))) - y
        nw = z - step * (m.T @ r.astype(np.float32)) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        nb = zb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(names, [rules[i] for i in used], w[used].astype(float), float(b))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, names: dict[str, Column], most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled rows outside the held-out fold, chosen by a hash of doc_id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000))
    some = known.where(draw < int(min(1.0, 1.2 * most / max(n, 1)) * 1e6)).orderBy(draw, "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", *[c.alias(k) for k, c in names.items()], "quality").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return rows[list(names)].to_numpy(float), (rows["quality"].to_numpy(float) > 0).astype(float)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; an empty text gets a score like any other."""
    names = statistics()
    model = fit(*labelled(docs, labels, names), list(names))
    rows = docs.select("doc_id", held_out().alias("held_out"), *[c.alias(k) for k, c in names.items()])
    return rows.withColumn("score", model.score()).select("doc_id", "held_out", "score", (F.col("score") >= PASS_SCORE).cast("int").alias("predicted"))


def op6(spark, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
