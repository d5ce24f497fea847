"""Spelling variants, fill-in-the-middle forms and the class-based language model against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, word string, n long, h1 string, form string, k1 string"


def frame(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, "y", "z", "k") for i, t in rows], SCHEMA)


# -- spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def plain_variants(rows, min_chars=5, min_count=3):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_chars and n >= min_count}
    out, form = {}, {}
    for w, n in words.items():
        some = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        form[w] = some[0] if some and words[some[0]] >= 2 * n else None
        out[w] = (n, len(some), form[w], words[some[0]] if form[w] else None)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (*x, root(w)) for w, x in out.items()}


def got_variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.fixture(scope="module")
def misspelled():
    r, rows = random.Random(5), []
    base = ["".join(r.choice("aberéüstÀ") for _ in range(r.randrange(5, 9))) for _ in range(60)] + ["erenen" * 900]
    for i in range(240):
        text = []
        for _ in range(60):
            w = r.choice(base[: 1 + r.randrange(len(base))])
            if r.random() < 0.35:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abeÿ") + w[k:], w[:k] + r.choice("abeé") + w[k + 1 :]])
            text.append(w.title() if r.random() < 0.1 else w)
        rows.append((None if i % 50 == 0 else i % 200, r.choice([" ", ", ", "1", "_"]).join(text)))
    return [*rows, (7, None), (8, ""), (9, "123 __"), rows[3], rows[3]]


@pytest.mark.parametrize("tile", [7, 1024])
def test_variants_equal_all_pairs(spark, misspelled, tile):
    from tickloom.llm.variants import spelling_variants

    want = plain_variants(misspelled)
    assert len(want) > 200 and sum(x[2] is not None for x in want.values()) > 50 and any(x[2] not in (None, x[4]) for x in want.values())
    assert got_variants(spelling_variants(frame(spark, misspelled).repartition(5), tile=tile)) == want


def test_variants_of_nothing(spark):
    from tickloom.llm.variants import spelling_variants

    assert got_variants(spelling_variants(frame(spark, []))) == {}
    assert got_variants(spelling_variants(frame(spark, [(1, None), (None, "ab cd"), (2, "alone")]))) == {}
    alone = got_variants(spelling_variants(frame(spark, [(i, "Wörter") for i in range(4)])))
    assert alone == plain_variants([(i, "Wörter") for i in range(4)])


def test_a_chain_of_forms_ends_at_its_root(spark):
    from tickloom.llm.variants import roots

    n = 60
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(n)], "word string, form string")
    assert {r["word"]: r["root"] for r in roots(links).collect()} == {f"w{i}": f"w{n}" for i in range(n)}


# -- fill in the middle


def plain_fim(i, text, rate=100, spm=50):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 100)])
def test_fill_in_middle_equals_plain_code(spark, rate, spm):
    from tickloom.llm.infill import fill_in_middle

    r = random.Random(1)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb c\x00\n", "<P> in", "x<S>", "<M>", "<p>\n<\nP>", "S>\n<", "<P\n<S\n<M\n>", "é\U0001f600\n" * 9, "line\n" * 30_000]
    texts += ["".join(r.choice("ab<PSM>\n\né") for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [(None if k % 97 == 5 else k % 350, t) for k, t in enumerate(texts)] + [(3, texts[14])] * 3
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["restored"]) for r in fill_in_middle(frame(spark, rows), rate, spm).collect())
    want = []
    for i, t in rows:
        n, form, p, m, out = plain_fim(i, t, rate, spm)
        want.append((-1 if i is None else i, n, form, p or 0, m or 0, out, t or ""))
    assert got == sorted(want)
    assert fill_in_middle(frame(spark, [])).count() == 0


# -- class-based language model


def tokens(text):
    return re.findall("[^ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def phrases():
    """Two kinds of text whose words follow one another by kind."""
    r, rows = random.Random(3), []
    kinds = [[[f"{k}{part}{j}" for j in range(30)] for part in ("nom", "ver", "adj")] for k in "ab"]
    for i in range(600):
        parts = kinds[i % 2]
        rows.append((i, " ".join(r.choice(parts[j % 3]).title() for j in range(r.randrange(3, 40)))))
    return [*rows, (None, "anom1 aver2"), (1001, None), (1002, ""), (1003, " \t"), rows[5], rows[5], (1004, " ".join(f"new{j} anom1" for j in range(8000)))]


@pytest.fixture(scope="module")
def learned(spark, phrases):
    from tickloom.llm import brown

    docs = frame(spark, phrases).repartition(3)
    model, counts = brown.learn(docs, classes=8, clustered=60, frequent=90)
    return docs, model, counts, brown.score_texts(docs, model, counts).collect()


def test_counts_and_base_score_equal_plain_code(phrases, learned):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in phrases:
        if not held(i):
            count.update([*tokens(t), None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in phrases:
        w = [*tokens(t), None]
        want.append((-1 if i is None else i, held(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in learned[3]]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_model_score_equals_plain_code_and_sums_to_one(phrases, learned):
    """The score, word by word from the model's classes; and that probabilities after a word add up to one."""
    from tickloom.llm import brown

    _, model, counts, rows = learned
    count = {r["h"]: r["n"] for r in counts.collect()}

    def parts(text):
        _, h, e, _ = next(brown.words_of([text]))
        return h, model.of[model.units.find(h, e)[0]]

    def emit(h, c):
        return math.log10(count[h] - model.discount) - model.seen[c] if h in count else model.unseen[c] - model.seen[c]

    got = {r["doc_id"]: r["score"] for r in rows}
    for i, t in phrases[:40] + phrases[-7:]:
        h, c = parts(t or "") if tokens(t) else ([], [])
        way = [0, *c, 0]
        want = sum(model.step[a, b] for a, b in zip(way, way[1:])) + sum(emit(x, k) for x, k in zip(h, c))
        assert got[i] == pytest.approx(want, rel=1e-9), i
    words = sorted({w for i, t in phrases for w in tokens(t)})
    h, c = parts(" ".join(words))
    for before in range(3):
        total = 10 ** model.step[before, 0]
        for k in range(1, 8):
            inside = sum(10 ** emit(x, k) for x, y in zip(h.tolist(), c.tolist()) if y == k and x in count)
            total += 10 ** model.step[before, k] * (inside + 10 ** (model.unseen[k] - model.seen[k]) if inside else 1)
        assert total == pytest.approx(1, rel=1e-6)


def test_exchange_finds_the_kinds_and_lowers_perplexity(spark, phrases, learned):
    from tickloom.llm import brown

    docs, _, _, rows = learned
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 3 and r["doc_id"] != 1004]
    per = lambda name: 10 ** (-sum(r[name] for r in held) / sum(r["n_tokens"] for r in held))
    assert per("score") < 0.4 * per("base_score")
    start, counts = brown.learn(docs, classes=8, clustered=60, frequent=90, rounds=0)
    first = [r["score"] for r in brown.score_texts(docs, start, counts).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(first)
    model, _ = brown.learn(docs, classes=8, clustered=200, frequent=200)
    _, h, e, _ = next(brown.words_of([" ".join(f"anom{j} bnom{j}" for j in range(30))]))
    c = model.of[model.units.find(h, e)[0]]
    assert not set(c[::2].tolist()) & set(c[1::2].tolist())  # words of one kind never share a class with those of the other


def test_brown_of_nothing(spark):
    from tickloom.llm import brown

    assert brown.score(frame(spark, [])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = brown.score(frame(spark, [(held, "Only words held out")]), classes=4).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (5, 0, 0, 0.0)
    assert r["score"] == pytest.approx(5 * math.log10(1 / 4)) and np.isfinite(r["score"])
