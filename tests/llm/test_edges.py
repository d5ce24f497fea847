"""Dotted column names, many languages, periods that do not fit, and secrets of named shapes."""

import random

import numpy as np
import pytest


def test_language_stage_keeps_dotted_columns(spark):
    from tickloom.llm.langid import language_stage

    rows = [(i, f"the quick brown fox number {i} jumps" if i % 2 else f"der schnelle braune fuchs {i} springt", "en" if i % 2 else "de", i) for i in range(60)] + [(99, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` long")
    kept = language_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 60


def test_more_languages_than_landmarks(monkeypatch):
    from tickloom.llm import langid

    monkeypatch.setattr(langid, "LANDMARKS", 20)
    r = random.Random(1)
    names = ["".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(30)]
    text = lambda k: " ".join(f"{names[k]}{r.choice(['', 'n', 's'])}" for _ in range(12))
    model = langid.fit([(f"l{k:02}", text(k)) for k in range(30) for _ in range(8 if k < 25 else 3)])
    assert len(model.langs) == 30 and model.whiten.shape[0] == 20
    got = model.predict([text(k) for k in range(20)])[0]
    assert np.mean([g == f"l{k:02}" for k, g in enumerate(got)]) > 0.5


def test_kernel_equals_brute_force():
    """The landmarks' kernel of presence vectors by sets of n-grams."""
    from tickloom.llm import langid

    r = random.Random(2)
    rows = [(lang, " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(20))) for lang, letters in (("a", "abcde "), ("b", "cdefg ")) for _ in range(12)]
    model = langid.fit(rows)
    marks = [t for _, t in rows]
    sets = [set(np.concatenate(list(langid.grams(t))).tolist()) & set(np.flatnonzero(model.slots).tolist()) for t in marks]
    got = model.kernel(marks)[0]
    for i in range(0, len(marks), 5):
        for j in range(0, got.shape[1], 7):
            assert got[i, j] == pytest.approx(len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j])), rel=1e-5)


def test_a_period_that_the_shares_do_not_fill_is_an_error(spark):
    from tickloom.llm.mixing import period

    targets = spark.createDataFrame([("a", 3), ("b", 5)], "source string, share int")
    assert period(targets).count() == 8
    with pytest.raises(ValueError):
        period(targets, 16)


@pytest.fixture(scope="module")
def net():
    """The secrets' network, trained on a few thousand words of plain prose and some base findings."""
    from tickloom.llm import secrets

    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(120)) + (f" password = {'%032x' % r.getrandbits(128)}" if k % 9 == 0 else "") for k in range(600)]
    return texts, secrets.learn(texts)


def test_named_shapes_are_found_and_named_others_are_not(net):
    from tickloom.llm import secrets

    texts, model = net
    r = random.Random(7)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda a, n: "".join(r.choice(a) for _ in range(n))
    some = lambda: r.choice("buffer size max bytes image default value user service request handler parser index total queue memory".split())
    shapes = {
        "ghp": lambda: "ghp_" + draw(base62, 36), "AIza": lambda: "AIza" + draw(base62 + "-_", 35), "npm": lambda: "npm_" + draw(base62, 36), "base64": lambda: draw(base62 + "+/", 40),
        "token": lambda: f"eyJ{draw(base62, 33)}.eyJ{draw(base62, 60)}.{draw(base62 + '-_', 43)}", "lower": lambda: draw(base62[26:], 24), "marks": lambda: draw(base62, 6) + "!" + draw(base62, 5) + "@" + draw("0123456789", 3) + "x", "dash": lambda: "glpat-" + draw(base62, 20),
    }
    others = {
        "constant": lambda: "_".join(some() for _ in range(4)).upper(), "bases": lambda: draw("ACGT", 40), "alphabet": lambda: "abcdefghijklmnopqrstuvwxyz", "camel": lambda: "get" + "".join(some().title() for _ in range(3)), "path": lambda: "/".join(some() for _ in range(4)),
        "uuid": lambda: "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), "address": lambda: f"{some()}.{some()}@{some()}.com", "page": lambda: f"www.{some()}.com/{some()}-{some()}-{draw('0123456789', 4)}", "number": lambda: draw("0123456789", 16),
    }

    def rate(make):
        found = 0
        for _ in range(150):
            head, v = r.choice(texts)[:200] + r.choice([" use ", ": ", ' "', "\n"]), make()
            spans = secrets.scan_texts(model, [head + v + r.choice([" ", '"', "\n"]) + "and so on"])[0]
            found += any(a < len(head) + len(v) and b > len(head) for a, b, _ in spans)
        return found / 150

    low = {k: x for k, f in shapes.items() if (x := rate(f)) < 0.9}
    high = {k: x for k, f in others.items() if (x := rate(f)) > 0.03}
    assert not low and not high, (low, high)
    assert sum(any(k == 3 for *_, k in s) for s in secrets.scan_texts(model, texts)) <= 6


def test_model_spans_equal_one_look_at_each_candidate(net):
    from tickloom.llm import secrets

    texts, model = net
    r = random.Random(8)
    noisy = [t[:90] + " " + secrets.made_secret(np.random.default_rng(k)) + " " + t[90:] for k, t in enumerate(texts[:60])]
    noisy += [" ".join(f"token={'%020x' % r.getrandbits(80)} {'%020x' % r.getrandbits(80)}" for _ in range(300)), ""]
    for t, got in zip(noisy, secrets.scan_texts(model, noisy)):
        base = secrets.base_spans(t)
        want = list(base)
        for a, b in secrets.candidates(t):
            if all(e <= a or b <= s for s, e, _ in base) and max(float(model.score(secrets.encode(t, *w)[None])[0]) for w in secrets.windows(a, b)) >= model.threshold:
                want.append((a, b, 3))
        assert got == sorted(want, key=lambda x: (x[0], x[2]))
