"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

The patterns (see BASE) find the base spans. Candidates are all further tokens that could be a secret by
their characters (CANDIDATE); the network reads each with its surroundings. It is trained on labelled findings of a bounded
sample of the texts: tokens inside a base span, some with their key words blanked, and secrets of other shapes (see
``made_secret``) set into the texts are positive; the texts' other tokens, and names, constants, paths, addresses, sequences,
numbers and ids (see ``made_name``) of their words and of made ones, are negative. A fifth of the texts, with all that was set into them, is held out: on it scores are calibrated (Platt),
and the threshold is the highest one that keeps RECALL of its positives. A token longer than TOKEN is read in windows and
has the score of the highest one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens of a key's characters, and of other marks too if these do not stand at an end; shorter ones are no key by themselves.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_=-]|[!@#$%^&*~.:]+(?=[A-Za-z0-9+/_=-])){11,}")
RECALL = 0.99
#: Texts that are looked at for the sample, texts and tokens of it, and secrets and names set into each of its texts.
POOL, TRAIN_TEXTS, TRAIN_TOKENS, SET_IN = 20_000, 2000, 20_000, 5
LEFT, TOKEN, WIDTH, FILTERS, HIDDEN = 16, 40, 5, 24, 24
SPAN = LEFT + TOKEN + 8
MASK = "[REDACTED]"
_CLASS = np.zeros(128, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
    _CLASS[ord(_c)], _CLASS[ord(_c.upper())] = _i, 26 + _i
for _i in range(10):
    _CLASS[48 + _i] = 53 + _i
for _i, _c in enumerate(" \n\"'=:+/_-.,@", 63):
    _CLASS[ord(_c)] = _i
CLASSES = 77


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start and then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens of 12 characters or more, whole."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The token itself or, if it is longer than TOKEN, windows of TOKEN characters by half of it, the last at its end."""
    if end - start <= TOKEN:
        return [(start, end)]
    return [(a, a + TOKEN) for a in [*range(start, end - TOKEN, TOKEN // 2), end - TOKEN]]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of the context before, the token or window and after."""
    token = text[start:end]
    s = text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + token.ljust(TOKEN, "\0") + text[end : end + 8].ljust(8, "\0")
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points == 0, CLASSES - 1, _CLASS[np.minimum(points, 127)] * (points < 128)).astype(np.uint8)


class CharNet:
    """Embedding by position in the filter, convolution, ReLU, maximum over positions of the context before, the token and the context
    after, mean over the token's own, one hidden layer, logit."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.k = (r.standard_normal((WIDTH, CLASSES, FILTERS)) * 0.3).astype(np.float32)
        self.kb = np.zeros(FILTERS, np.float32)
        self.h = (r.standard_normal((4 * FILTERS, HIDDEN)) / np.sqrt(4 * FILTERS)).astype(np.float32)
        self.hb = np.zeros(HIDDEN, np.float32)
        self.o = (r.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
        self.ob = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = float("nan")  # held-out, at the threshold
        self.parts = ((0, LEFT - 2), (LEFT - 2, LEFT + TOKEN - 2), (LEFT + TOKEN - 2, SPAN - WIDTH + 1))

    def forward(self, x: np.ndarray):
        n = SPAN - WIDTH + 1
        z = self.kb + sum(self.k[j][x[:, j : j + n]] for j in range(WIDTH))
        # the context before, the token and the context after are pooled apart
        at = [z[:, a:b].argmax(axis=1) + a for a, b in self.parts]
        a, b = self.parts[1]
        own = (x[:, a + WIDTH // 2 : b + WIDTH // 2] != CLASSES - 1).astype(np.float32)
        own /= np.maximum(own.sum(axis=1, keepdims=True), 1)
        token = z[:, a:b]
        mean = np.einsum("ij,ijk->ik", own, np.maximum(token, 0))
        pooled = np.concatenate([*(np.take_along_axis(z, i[:, None, :], 1)[:, 0] for i in at), mean], axis=1)
        p = np.maximum(pooled, 0)
        u = p @ self.h + self.hb
        r = np.maximum(u, 0)
        return r @ self.o + self.ob[0], (at, pooled, p, u, r, own, token)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 0.01, batch: int = 128, seed: int = 2):
        names = ["k", "kb", "h", "hb", "o", "ob"]
        m = {n: np.zeros_like(getattr(self, n)) for n in names}
        v = {n: np.zeros_like(getattr(self, n)) for n in names}
        r, step = np.random.default_rng(seed), 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                i = order[lo : lo + batch]
                xb = x[i]
                z, (at, pooled, p, u, hid, own, token) = self.forward(xb)
                d = ((1 / (1 + np.exp(-z)) - y[i]) * weight[i] / len(i)).astype(np.float32)
                g = {"o": hid.T @ d, "ob": d.sum(keepdims=True)}
                du = d[:, None] * self.o * (u > 0)
                g["h"], g["hb"] = p.T @ du, du.sum(0)
                dp = (du @ self.h.T) * (pooled > 0)
                every = own[:, :, None] * dp[:, None, 3 * FILTERS :] * (token > 0)
                g["kb"] = sum(dp[:, s * FILTERS : (s + 1) * FILTERS].sum(0) for s in range(3)) + every.sum(axis=(0, 1))
                g["k"] = np.zeros_like(self.k)
                f = np.broadcast_to(np.arange(FILTERS), (len(i), FILTERS))
                for s in range(3):
                    for j in range(WIDTH):
                        np.add.at(g["k"][j], (np.take_along_axis(xb, at[s] + j, 1), f), dp[:, s * FILTERS : (s + 1) * FILTERS])
                first, flat = self.parts[1][0], every.reshape(-1, FILTERS)
                for j in range(WIDTH):
                    seen = xb[:, first + j : first + j + TOKEN].ravel()
                    g["k"][j] += (np.arange(CLASSES)[:, None] == seen).astype(np.float32) @ flat
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                    setattr(self, n, (getattr(self, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray):
        """Platt's two numbers by Newton steps, then the recall-constrained threshold."""
        self.scale, self.shift = 1.0, 0.0
        z = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)
        pos, neg = float((y > 0).sum()), float((y <= 0).sum())
        if pos and neg:
            t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
            a, b = 1.0, 0.0
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
                w = p * (1 - p) + 1e-6
                grad = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
                hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
                da = np.clip(np.linalg.solve(hess, grad), -1, 1)
                a, b = a - da[0], b - da[1]
            self.scale, self.shift = float(max(a, 1e-3)), float(b)
            score = self.score(x)
            self.threshold = float(np.quantile(score[y > 0], 1 - RECALL, method="lower"))
            found = score >= self.threshold
            self.recall, self.precision = float(found[y > 0].mean()), float(y[found].mean())
        else:
            self.threshold = 2.0  # nothing to learn from: the patterns alone
        return self


_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_secret(r: np.random.Generator) -> str:
    """A random key: letters and digits (short ones too), base64, its URL form, hexadecimal in upper case, a password with other marks, three
    parts joined by points, or one of the first behind a short prefix."""
    draw = lambda alphabet, n: "".join(alphabet[i] for i in r.integers(0, len(alphabet), n))
    kind = r.integers(12)
    if kind < 2:  # a password: some of each kind of character
        parts = list(draw(_BASE62, int(r.integers(8, 18))) + draw("0123456789", 2) + draw("!@#$%^&*~", int(r.integers(1, 4))))
        return draw(_BASE62, 1) + "".join(parts[i] for i in r.permutation(len(parts))) + draw(_BASE62, 1)
    if kind == 2:
        return ".".join("eyJ" * (k < 2) + draw(_BASE62 + "-_", int(n)) for k, n in enumerate(r.integers(12, 60, 3)))
    alphabet = (_BASE62, _BASE62 + "+/", _BASE62 + "-_", "0123456789ABCDEF", _BASE62[26:], _BASE62, _BASE62[26:], _BASE62, _BASE62)[kind - 3]
    body = draw(alphabet, int(r.integers(16, 26) if kind > 6 else r.integers(18, 72)))
    if r.random() < 0.5:
        body = "".join(draw(_BASE62[26:52], int(r.integers(2, 7)))) + ("_", "-", "_live_", "-", "-")[r.integers(5)] + body
    return body + "=" * int(r.integers(0, 3) if r.random() < 0.2 else 0)


def spoken(r: np.random.Generator) -> str:
    """A word that could be said, of all letters: consonants and vowels in turn, some of them doubled or in pairs."""
    out, vowel = "", r.random() < 0.4
    for _ in range(int(r.integers(2, 7))):
        out += "aeiou"[r.integers(5)] if vowel else "bcdfghjklmnpqrstvwxyz"[r.integers(21)] + ("", "", "", "r", "l", "s", "t", "h")[r.integers(8)]
        vowel = not vowel
    return out


def made_name(r: np.random.Generator, words: list[str]) -> str:
    """What looks like a key but is none: words joined as names, paths or slugs, numbers, dates, ids and rules."""
    n = int(r.integers(2, 6))
    w = [words[i] if r.random() < 0.5 else spoken(r) for i in r.integers(0, len(words), 6)]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    digits = lambda k: draw("0123456789", k)
    kind = r.integers(21)
    if kind < 3:
        return "_-/"[kind].join(w[:n])
    if kind == 3:
        return "".join(x.capitalize() for x in w[:n])
    if kind == 4:
        return digits(int(r.integers(12, 24)))
    if kind == 5:
        return f"20{digits(2)}-{digits(2)}-{digits(2)}/{w[0]}-{digits(4)}"
    if kind == 6:
        return "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
    if kind == 7:
        return "-=_"[r.integers(3)] * int(r.integers(12, 40))
    if kind < 10 or kind > 18:  # constants
        return "_".join(w[: n + 1]).upper() + ("", "_" + digits(1), "_V" + digits(1))[r.integers(3)]
    if kind == 10:  # sequences of a few letters
        return draw(("ACGT", "acgt", "ACDEFGHIKLMNPQRSTVWY", "01", "xX.-")[r.integers(5)], int(r.integers(14, 80)))
    if kind == 11:  # the alphabet, or a part of it, and counting
        run = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz0123456789"
        at = int(r.integers(0, 26))
        part = run[at : at + int(r.integers(12, 36))]
        return (part, part.upper(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + part, "0123456789" * 2 + part)[r.integers(4)]
    if kind == 12:  # addresses of media
        return ("watch", "v", "id", "img", "video")[r.integers(5)] + ("/", "=", "/v=")[r.integers(3)] + draw(_BASE62 + "-_", 11)
    if kind == 13:  # names of substances and their like: words with places
        return "-".join([",".join(digits(1) for _ in range(int(r.integers(1, 4)))).replace(",", "-"), *[x.lower() + y.lower() for x, y in zip(w[:n], w[1:])]])
    if kind == 14:  # camel case, a number behind
        return w[0].lower() + "".join(x.capitalize() for x in w[1:n]) + ("", digits(1), digits(2))[r.integers(3)]
    if kind == 15:
        return f"{w[0].lower()}.{w[1].lower()}@{w[2].lower()}.{('com', 'org', 'de')[r.integers(3)]}"
    if kind == 16:
        return f"www.{w[0].lower()}.{('com', 'org', 'net')[r.integers(3)]}/{w[1].lower()}-{w[2].lower()}-{digits(int(r.integers(1, 7)))}"
    if kind == 17:  # one long word
        return w[0].capitalize() + "".join(x.lower() for x in w[1 : n + 1])
    return f"{w[0]}-{w[1]}-{digits(4)}-{digits(2)}.{('jpg', 'html', 'pdf', 'csv')[r.integers(4)]}"


def training_rows(texts: list[str], seed: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encoded tokens, their labels, and the number of the text that each one comes from; at most TRAIN_TOKENS, evenly of both labels."""
    r, rows, labels, owner = np.random.default_rng(seed), [], [], []

    def add(text, start, end, label, own, blank=False):
        for s, e in windows(start, end):
            x = encode(text, s, e)
            if blank:
                x[:LEFT] = _CLASS[32]
            rows.append(x)
            labels.append(label)
            owner.append(own)

    for own, t in enumerate(texts):
        spans = base_spans(t)
        found = candidates(t)
        for k in r.permutation(len(found))[:40]:
            s, e = found[k]
            inside = any(a < e and s < b for a, b, _ in spans)
            add(t, s, e, float(inside), own)
            if inside:
                add(t, s, e, 1.0, own, blank=True)
        words = [w for w in re.findall(r"[A-Za-z]{2,12}", t)[:400]] or ["name"]
        for _ in range(SET_IN):
            for label, token in ((1.0, made_secret(r)), (0.0, made_name(r, words))):
                at = int(r.integers(0, len(t) + 1))
                lead = (" ", " ", "=", ": ", ' "', " key ", " Bearer ", "\n", "(", " ref ")[r.integers(10)]
                around = t[max(0, at - LEFT) : at] + lead
                add(around + token + (" ", '"', "\n", ", ", ".")[r.integers(5)] + t[at : at + 8], len(around), len(around) + len(token), label, own)
    if not rows:
        return np.empty((0, SPAN), np.uint8), np.empty(0), np.empty(0, np.int64)
    x, y, o = np.array(rows), np.array(labels), np.array(owner)
    pick = r.permutation(len(x))
    pos, neg = pick[y[pick] > 0][: TRAIN_TOKENS // 2], pick[y[pick] <= 0][: TRAIN_TOKENS // 2]
    i = r.permutation(np.r_[pos, neg])
    return x[i], y[i], o[i]


def learn(texts: list[str]) -> CharNet:
    """Trained on four fifths of the texts, calibrated on the rest."""
    x, y, own = training_rows(texts)
    train, net = own % 5 > 0, CharNet()
    if len(x) and 0 < y[train].mean() < 1:
        net.train(x[train], y[train])
    return net.calibrate(x[~train], y[~train])


def fit(docs: DataFrame) -> CharNet:
    """From at most TRAIN_TEXTS of some POOL texts drawn by a hash: half of them with a base finding, half any."""
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1_000_000))
    n = max(docs.count(), 1)
    pool = docs.where("text is not null").where(draw < int(1e6 * min(1.0, POOL / n))).select("text", draw.alias("draw"))
    hit = pool.where(F.col("text").rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    return learn([t for part in (hit, pool) for (t,) in part.orderBy("draw", "text").limit(TRAIN_TEXTS // 2).select("text").toLocalIterator()])


def scan_texts(net: CharNet, texts) -> list[list[tuple[int, int, int]]]:
    """Spans of each text by start and kind: the base spans and candidates that the network adds outside them."""
    out, where, rows, first = [], [], [], []
    for i, t in enumerate(texts):
        spans = base_spans(t)
        out.append(spans)
        starts, reach = [a for a, _, _ in spans], list(accumulate((b for _, b, _ in spans), max))
        for s, e in candidates(t):
            before = bisect_left(starts, e)
            if not before or reach[before - 1] <= s:  # no base span overlaps it
                where.append((i, s, e))
                first.append(len(rows))
                rows += [encode(t, *w) for w in windows(s, e)]
    if rows:
        score = np.maximum.reduceat(net.score(np.array(rows)), first)
        for (i, s, e), p in zip(where, score):
            if p >= net.threshold:
                out[i] = [*out[i], (s, e, 3)]
    return [sorted(s, key=lambda x: (x[0], x[2])) for s in out]


def written_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


FOUND = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "redacted": "string"}


def scan(docs: DataFrame, net: CharNet, keep: list[str], mark: str = "_") -> DataFrame:
    """The ``keep`` columns and those of FOUND, with ``mark`` before their names: the counts, base_sha256, spans, and redacted (the
    text with each finding as MASK)."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in FOUND.items():
        schema = schema.add(f"{mark}{name}", kind)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for part in common.slices(frames, 256):
            texts = part.column(0).to_pylist()
            found = scan_texts(net, [t or "" for t in texts])
            base = [[x for x in s if x[2] < 3] for s in found]
            count = [pa.array([sum(x[2] == k for x in b) for b in base], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(written_spans(b).encode()).hexdigest() for b in base], pa.string())
            redacted = pa.array([t if not s else redact(t, s) for t, s in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *count, digest, pa.array([written_spans(s) for s in found], pa.string()), redacted], schema.names)

    return docs.select("text", *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep)]).mapInArrow(run, schema)


def redact(text: str, spans) -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, keep: list[str] | None = None, mark: str = "_") -> DataFrame:
    """One row for each input row, repeated ones too; null texts count as empty (no spans), texts of any length are read whole.
    Where nothing can be learned (no text has a candidate) only the patterns find."""
    return scan(docs, fit(docs), keep or ["doc_id"], mark)


def op9(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")))


def secret_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every finding in the text; all documents stay, with all their columns, whatever their names. n_chars follows the
    new text."""
    mark = common.spare_name(docs, "_")
    while any(f"{mark}{n}" in docs.columns for n in FOUND):
        mark += "_"
    found = find_secrets(docs, [c for c in docs.columns if c != "text"], mark)
    text, changed = F.col(f"{mark}redacted"), F.col(f"{mark}spans") != ""

    def kept(c: str):
        if c == "text":
            return text.alias("text")
        if c == "n_chars":
            return F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(f"`{c}`")

    return found.select(*map(kept, docs.columns))
