"""The whole pipeline on a small corpus against a plain computation, and queries against brute force."""

import base64
import hashlib
import random
import re

import numpy as np

VOWELS, SOUNDS = "aeiou", {"aa": "k t m s r d l".split(), "bb": "gr sch pf tz br kl st".split()}


def text_of(lang, r, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) + r.choice(VOWELS) for _ in range(r.randint(1, 4))) for _ in range(n))


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(docs, k):
    """The smallest id reachable by links of similarity 0.8, by comparing all pairs."""
    name = {d: d for d, _ in docs}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    sets = [(d, shingles(t or "", k)) for d, t in docs]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {d: top(d) for d, _ in docs}


def test_pipeline_equals_plain_computation(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    items = [text_of("aa", r, 40) for _ in range(3)]
    rows = []
    for i in range(150):
        lang = ("aa", "bb")[i % 2]
        rows.append([i, text_of(lang, r, r.randint(40, 90)), lang, f"site{i % 5}"])
    for i in range(150, 190):  # near copies, exact copies
        words = rows[i - 150][1].split()
        if i % 2:
            words[r.randrange(len(words))] = "kuku"
        rows.append([i, " ".join(words), rows[i - 150][2], "mirror"])
    for i in range(190, 196):  # benchmark items within texts
        rows.append([i, f"{text_of('aa', r, 30)} {items[i % 3]} {text_of('aa', r, 30)}", "aa", "site1"])
    rows += [[196, None, "aa", "x"], [197, "12 34 !!", None, "x"], [198, "", "bb", None]]
    secret = "password: " + "Zq7" * 6
    rows += [[199, f"{text_of('bb', r, 50)} {secret} {text_of('bb', r, 20)}", "bb", "site2"]]
    data = [(*x, len(x[1]) if x[1] is not None else None) for x in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    name = groups(kept, 5)
    kept = [(d, t) for d, t in kept if name[d] == d]
    kept = [(d, t) for d, t in kept if not any(i in t for i in items)]
    want = {d: t.replace(secret, "[REDACTED]") for d, t in kept}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["text"] for x in got} == want
    assert all(x["n_chars"] == len(x["text"]) and x["release"] <= x["slot"] < x["deadline"] for x in got)
    before = {}
    for x in sorted(got, key=lambda x: (x["source"], x["chars_before"])):
        assert x["chars_before"] == before.get(x["source"], 0)
        before[x["source"]] = x["chars_before"] + len(x["text"])


def test_near_duplicates_with_large_groups_equals_brute_force(spark):
    """A third of the rows are near copies of one text, so that buckets are large and hold several components."""
    from tickloom.llm import neardup

    r = random.Random(2)
    base = text_of("aa", r, 60).split()
    rows = []
    for i in range(240):
        if i % 3 == 0:
            words = list(base)
            for _ in range(r.randint(0, 14)):
                words[r.randrange(60)] = text_of("bb", r, 1)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, text_of("bb", r, r.randint(1, 50))))
    name = groups(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == name
    assert all(x["n_shingles"] == len(shingles(t, 2)) for x, (_, t) in zip(sorted(got, key=lambda x: x["doc_id"]), rows))


def test_pairs_within_the_distance_meet_in_tasks_and_buckets():
    """What a task pairs up before the shuffle and what buckets pair up afterwards link all that share a key."""
    import pyarrow as pa

    from tickloom.llm.neardup import CROWD, HUBS, LEADERS, MAX_DISTANCE, SYMBOLS, _bucket_pairs, _index

    r = np.random.default_rng(3)
    near = np.tile(r.integers(0, 1 << 16, SYMBOLS, dtype=np.uint16), (80, 1))
    for row in near[1:]:
        at = r.choice(SYMBOLS, int(r.integers(1, MAX_DISTANCE // 2)), replace=False)
        row[at] = r.integers(0, 1 << 16, len(at), dtype=np.uint16)
    far = r.integers(0, 1 << 16, (40, SYMBOLS), dtype=np.uint16)
    sig = np.concatenate([near, far])
    ids = r.permutation(1000)[: len(sig)].astype(np.int64)
    parts = [pa.RecordBatch.from_arrays([pa.array(ids[i::3]), pa.array([x.tobytes() for x in sig[i::3]], pa.binary())], ["id", "signature"]) for i in range(3)]
    rows = [b for p in parts for b in _index(iter([p]))]
    t = pa.Table.from_batches(rows).sort_by([("key", "ascending"), ("kind", "descending"), ("id", "ascending")])
    out = pa.concat_tables([pa.Table.from_batches([b]) for b in _bucket_pairs(iter(t.to_batches(max_chunksize=37)))]).to_pylist()
    pairs = {tuple(sorted((x["a"], x["b"]))) for x in out if not x["crowded"] and x["a"] != x["b"]}
    crowd = {}
    for x in out:
        if x["crowded"]:
            crowd.setdefault(x["b"], set()).add(x["a"])
    for i in range(len(sig)):
        for j in range(i):
            if (sig[i] != sig[j]).sum() <= MAX_DISTANCE:
                a, b = int(ids[i]), int(ids[j])
                assert tuple(sorted((a, b))) in pairs or any({a, b} <= m for m in crowd.values())
    assert not {p for p in pairs if set(p) & set(ids[80:].tolist())} and HUBS < LEADERS < CROWD + LEADERS


def test_quality_rules_compiled_equal_plain_rules(spark):
    """The Spark expression of a fitted ensemble against its rules in numpy; nulls, repeated rows and an empty table."""
    from pyspark.sql import functions as F

    from tickloom.llm import quality

    r = random.Random(1)
    rows = [(i, text_of("aa", r, r.randint(3, 80)) + ("!!! BUY | NOW #1 " * r.randint(1, 9) if i % 3 == 0 else "."), i % 3) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, None), (None, ""), (7, rows[7][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k > 0)) for i, _, k in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    names = quality.statistics()
    x, y = quality.labelled(docs, labels, names)
    model = quality.fit(x, y, list(names))
    stats = docs.select("doc_id", *[c.alias(k) for k, c in names.items()]).withColumn("score", model.score()).toPandas()
    v = stats[list(names)].to_numpy(float)
    total = np.full(len(v), model.bias)
    for rule, w in zip(model.rules, model.coef):
        held = np.ones(len(v), bool)
        for f, above, c in rule:
            held &= (v[:, f] > c) if above else (v[:, f] <= c)
        total += w * held
    assert np.allclose(stats["score"], 1 / (1 + np.exp(-total))) and len(model.rules) > 3
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 603 and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3) for g in got)
    assert quality.score_quality(docs.limit(0), labels).count() == 0 and quality.score_quality(docs, labels.limit(0)).where(F.col("score").isNull()).count() == 0


def test_warc_equals_plain_hashing(spark, tmp_path):
    from tickloom.llm import warc

    r = random.Random(3)
    bodies = ["", "x", "é" * 40, "<p>a</p>\r\n\r\n<p>b</p>", "z" * 5000]
    rows = [(i, f"http://h{i % 3}/{i}", r.choice(bodies + [None])) for i in range(90)] + [(7, "http://h/7", "own")] * 3 + [(None, None, "own")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    got = warc.op7(spark, str(tmp_path)).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert sorted((str(x["page_id"]), x["payload_bytes"], x["payload_digest"]) for x in got) == sorted((str(i), len((h or "").encode()), digest(h or "")) for i, _, h in rows)
    by = {digest(h): (h, n) for h, n in best.items()}
    for d, (_, n) in by.items():
        part = [x for x in got if x["payload_digest"] == d]
        response = [x for x in part if x["record_type"] == "response"]
        assert len(response) == 1 and response[0]["page_id"] == n and response[0]["refers_to"] is None
        assert all(x["refers_to"] == n for x in part if x["record_type"] == "revisit")
    assert warc.op7(spark, str(tmp_path / "none")).count() == 0


def test_warc_records_are_handed_over_in_small_parts():
    """A batch of many pages is not held as a whole: its records come in parts, in order, each page's digest its own."""
    import pyarrow as pa

    from tickloom.llm import warc

    html = ["é" * 150_000 + str(i) for i in range(60)] + [""]
    n = len(html)
    batch = pa.RecordBatch.from_pydict({"row": [f"r{i}" for i in range(n)], "page_id": [str(i) for i in range(n)], "url": ["http://h/x"] * n, "html": html, "key": ["k"] * n, "bytes": [len(h.encode()) for h in html], "keeper": pa.array([None] * n, pa.string())})
    parts = list(warc.records_of(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 5 and max(p.nbytes for p in parts) < 3 << 20
    text = warc.END.join(v for p in parts for v in p.column(0).to_pylist()) + warc.END
    got = [(h["warc-record-id"], h["warc-payload-digest"], len(b)) for h, b in warc.parse(text.encode()) if h["warc-type"] == "response"]
    head = got[-1][2]
    assert got == [(f"<urn:capture:r{i}:{i}>", f"sha1:{warc.payload_digest(h.encode())}", head + len(h.encode())) for i, h in enumerate(html)]


def test_fingerprints_equal_plain_edits_and_similarity(spark):
    """Edited texts and digests exactly; likeness within what the number of samples allows."""
    from tickloom.llm import fingerprints

    r = random.Random(5)
    rows = [(i * 3, text_of("aa", r, r.randint(0, 120)) + ("é\U0001f600" if i % 4 == 0 else "")) for i in range(80)] + [(1, None), (4, rows_text := text_of("bb", r, 30)), (5, rows_text)]
    docs = sorted(((d, t or "") for d, t in rows), key=lambda x: x[0])
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    error = []
    for k, (d, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        x = got[d]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = ({w: c for w, c in zip(*np.unique(s.lower().split(), return_counts=True))} for s in (t, edited))
        if a and b:
            keys = set(a) | set(b)
            error.append(x["near_edited"] - sum(min(a.get(w, 0), b.get(w, 0)) for w in keys) / sum(max(a.get(w, 0), b.get(w, 0)) for w in keys))
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and abs(np.mean(error)) < 0.03 and np.std(error) < 0.09


def test_token_query_equals_encoding_the_edited_texts(spark, tmp_path):
    import tiktoken

    from tickloom.llm import tokens

    r = random.Random(8)
    rows = [(i, text_of("aa", r, r.randint(0, 200)) + "  don't\n\n x9") for i in range(40)] + [(40, None), (40, ""), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(), special_tokens={})
    want = []
    for d, t in rows:
        t = t or ""
        n, head = len(t), t[:12]
        first = len(enc.encode_ordinary(t))
        for at, k, new in ((n // 4, 8, head), (n // 4 * 2, 5, ""), (n // 4 * 3, 0, f" {head}'s ")):
            at = min(at, len(t))
            t = t[:at] + new + t[at + k :]
        want.append((str(d), first, len(t), len(enc.encode_ordinary(t))))
    got = [(str(x["doc_id"]), x["n_tokens"], x["edited_chars"], x["edited_tokens"]) for x in tokens.op3(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
