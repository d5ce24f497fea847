"""Language identification by string kernels.

A text's letters, lower-cased, with each run of other characters as one space, give its blended spectrum: the
set of its 1- to 4-grams. The kernel of two texts is the number of n-grams that both have (presence, not
counts), over the geometric mean of their own numbers; n-grams count that two landmarks have, or one of
a language with FEW landmarks (hashed to 20 bits), however many these are. Nystroem: landmarks l give the features k(x, l) K_ll^(-1/2); kernel ridge regression, one
language against the rest, is solved on these. A batch of texts is scored by matrix products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_N = 4
HASH_BITS = 20
#: The bounds of the labelled sample: rows of a language and in all, landmarks of a language and in all. Every language has a row at
#: least, as long as there are no more of them than rows in all; where there are more than landmarks, the most frequent have one.
TRAIN_PER_LANG, TRAIN, LANDMARKS_PER_LANG, LANDMARKS = 250, 50_000, 32, 1024
FEW = 8
RIDGE = 1e-2
SHARPNESS = 6.0
_WEIGHTS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def points(text: str) -> np.ndarray:
    """Code points with each run of non-letters as one space; empty if there is no letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return np.empty(0, np.uint32)
    a = np.where(letter, a, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return a[keep]


def grams(text: str | None):
    """Hash codes (20 bits) of the n-grams, one array for each n."""
    a = points(text or "")
    if len(a):
        code = np.zeros(len(a), np.uint32)
        for n in range(1, MAX_N + 1):
            if len(a) < n:
                break
            code = (code[: len(a) - n + 1] + a[n - 1 :]) * _WEIGHTS[n - 1]
            code ^= code >> np.uint32(15)
            yield (code * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


@dataclass
class LanguageModel:
    langs: list[str]  # none, if there was nothing to learn from
    slots: np.ndarray  # of a hash code; 0 if no two landmarks have it
    landmarks: np.ndarray  # a row of bits, one for each landmark, for each slot
    sizes: np.ndarray  # n-grams of each landmark
    whiten: np.ndarray
    ridge: np.ndarray
    least_coverage: float = 0.0

    def kernel(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """k(text, landmark), and the share of a text's n-grams (by place) that landmarks have; -1 without a letter."""
        k, cover = np.zeros((len(texts), len(self.sizes)), np.float32), np.full(len(texts), -1.0)
        seen = np.zeros(len(self.landmarks), bool)
        for i, t in enumerate(texts):
            known = total = 0
            for codes in grams(t):
                slot = self.slots[codes]
                seen[slot] = True
                known, total = known + int(np.count_nonzero(slot)), total + len(slot)
            if total:
                seen[0] = False
                own = np.flatnonzero(seen)
                seen[own] = False
                cover[i] = known / total
                if len(own):
                    shared = np.zeros(len(self.sizes), np.int64)
                    for lo in range(0, len(own), 8192):
                        shared += np.unpackbits(self.landmarks[own[lo : lo + 8192]], axis=1, count=len(self.sizes)).sum(axis=0, dtype=np.int64)
                    k[i] = shared / np.sqrt(len(own) * np.maximum(self.sizes, 1.0))
        return k, cover

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        k, cover = self.kernel(texts)
        m = SHARPNESS * (k @ self.whiten @ self.ridge)
        e = np.exp(m - m.max(axis=1, keepdims=True))
        best, top = m.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)
        letters = cover >= 0
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, top, 0.0).astype(float), np.maximum(cover, 0.0)


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (lang, text) rows; the first rows of each language are its landmarks. Without a row with a letter nothing is learned."""
    rows = [(lang, t) for lang, t in rows if len(points(t or ""))]
    if not rows:
        return LanguageModel([], np.zeros(1, np.int32), np.zeros((1, 1), np.uint8), np.empty(0), np.empty(0), np.empty(0))
    of_lang = Counter(lang for lang, _ in rows)
    langs = sorted(of_lang)
    each = max(1, min(LANDMARKS_PER_LANG, LANDMARKS // len(langs)))
    first: dict[str, list[str]] = {lang: [] for lang in langs}
    for lang, t in rows:
        if len(first[lang]) < each:
            first[lang].append(t)
    marked = langs if len(langs) <= LANDMARKS else sorted(sorted(langs, key=lambda lang: -of_lang[lang])[:LANDMARKS])
    marks = [t for lang in marked for t in first[lang]]
    codes_of = [np.unique(np.concatenate(list(grams(t)))) for t in marks]
    count = np.zeros(1 << HASH_BITS, np.int32)
    few = {lang for lang in marked if min(each, of_lang[lang]) < FEW}
    for c, lang in zip(codes_of, [lang for lang in marked for _ in range(min(each, of_lang[lang]))]):
        count[c] += 2 if lang in few else 1
    codes = np.flatnonzero(count >= 2)
    slots = np.zeros(1 << HASH_BITS, np.int32)
    slots[codes] = np.arange(1, len(codes) + 1)
    bits = np.zeros((len(codes) + 1, len(marks)), np.uint8)
    for j, c in enumerate(codes_of):
        bits[slots[c], j] = 1
    bits[0] = 0
    sizes = bits.sum(axis=0).astype(float)
    model = LanguageModel(langs, slots, np.packbits(bits, axis=1), sizes, np.empty(0), np.empty(0))
    del bits
    own = model.kernel(marks)[0].astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-6 * value.max()
    model.whiten = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)
    k, cover = model.kernel([t for _, t in rows])
    f = (k @ model.whiten).astype(float)
    place = {lang: j for j, lang in enumerate(langs)}
    own_lang = np.array([place[lang] for lang, _ in rows])
    weighted = f * (len(rows) / (len(langs) * np.array([of_lang[lang] for lang in langs])))[own_lang][:, None]
    of_class = np.zeros((len(langs), f.shape[1]))
    np.add.at(of_class, own_lang, weighted)  # against labels of 1 for the own language and -1 for all others
    model.ridge = np.linalg.solve(weighted.T @ f + RIDGE * np.eye(f.shape[1]), 2 * of_class.T - weighted.sum(axis=0)[:, None]).astype(np.float32)
    rest = cover[len(marks) :] if len(rows) > 2 * len(marks) else cover
    model.least_coverage = 0.5 * float(np.quantile(rest, 0.01))
    return model


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, label: str = "lang", each: int = TRAIN_PER_LANG) -> list[tuple[str, str]]:
    """At most ``each`` rows of each label and TRAIN in all, chosen by a hash of doc_id; never rows of the held-out fold."""
    rows = docs.where(~held_out() & F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(label).alias("_label"), "text")
    count = rows.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(TRAIN)
    each = max(1, min(each, TRAIN // max(1, count.count())))
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1e6
    some = rows.join(F.broadcast(count), "_label").where(draw * F.col("count") <= 3 * each)
    order = Window.partitionBy("_label").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    return [(r[0], r[1]) for r in some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).orderBy("_label", "r").select("_label", "text").toLocalIterator()]


def classify(docs: DataFrame, model: LanguageModel, keep: list[str], names=("lang_pred", "score", "coverage")) -> DataFrame:
    """The ``keep`` columns with language, score and coverage under ``names``, one row for each input row; narrow, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(names[0], "string").add(names[1], "double").add(names[2], "double")

    others = [c for c in keep if c != "text"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for part in common.slices(frames, 128):
            lang, score, cover = m.predict(part.column(0).to_pylist())
            own = dict(zip(["text", *others], part.columns))
            yield pa.RecordBatch.from_arrays([*(own[c] for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cover, pa.float64())], schema.names)

    return docs.select("text", *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)]).mapInArrow(run, schema)


def identify(docs: DataFrame, keep: list[str] | None = None, names=("lang_pred", "score", "coverage")) -> DataFrame:
    """lang_pred, score and coverage of every whole text. `und` with score 0 for null texts, texts without a letter, and all
    texts if no labelled row has a letter; an empty table gives no rows, repeated rows give a row each."""
    return classify(docs, fit(labelled_sample(docs)), keep or ["doc_id"], names)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts of which learned languages know too few n-grams: half of what all but a
    hundredth of the labelled texts have. The rest is unchanged, with all its columns, whatever their names; where nothing
    can be learned, all texts with a letter stay."""
    columns = docs.columns
    model = fit(labelled_sample(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = [common.spare_name(docs, n) for n in ("lang_pred", "score", "coverage")]
    scored = classify(docs, model, columns, names)
    return scored.where((F.col(names[0]) != "und") & (F.col(names[2]) >= model.least_coverage)).select(*[F.col(f"`{c}`") for c in columns])
