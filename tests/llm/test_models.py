"""Classifiers by held-out accuracy, secrets and personal data by brute force, decontamination by planted edits."""

import random
import re

import numpy as np
import regex
import pyarrow as pa

from tidemark.llm import decontaminate, pii, quality, secrets, toxicity
from tidemark.llm.labelled import held_out

WORDS = [f"word{k}" for k in range(300)]


def labelled(spark, n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 60))
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "scummy", "idiotic"])
        if not good:
            words = [w + "!!" for w in words]
        docs.append((i, " ".join(words), "en", i))
        labels.append((i, int(good), int(toxic), "z"))
    docs += [(n, None, None, None), (n + 1, "", "en", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def check(out, truth):
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = toxicity.toxicity_scores(docs, labels, ["doc_id"]).withColumn("held_out", held_out(3, 1)).collect()
    assert len(out) == 602
    check(out, {r.doc_id: bool(r.toxic) for r in labels.collect()})


def test_quality(spark):
    docs, labels = labelled(spark)
    out = quality.quality_scores(docs, labels, ["doc_id"]).withColumn("held_out", held_out(4, 2)).collect()
    assert len(out) == 602
    check(out, {r.doc_id: bool(r.quality) for r in labels.collect()})


def test_no_labels_and_no_rows(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0), ["doc_id"]).collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), ["doc_id"]).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_machine_learns_pairs():
    """Labels that hang on two terms together, and on neither alone."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    x = []
    for t in y:
        a = int(rng.integers(0, 2))
        terms = [11 + a, 13 + (a if t else 1 - a)]
        x.append((np.array(terms), np.ones(2)))
    m = toxicity.fit(x, y.astype(float), epochs=80)
    p = [m.logits(1, np.zeros(2, np.int64), m.slot[i].astype(np.int64))[0] > 0 for i, _ in x]
    assert np.mean(p == y) > 0.9


def test_machine_learns_pairs_as_set():
    """Pairs among other terms, on rows not learnt from, with everything as in production."""
    rng = np.random.default_rng(1)

    def rows(n):
        y = rng.integers(0, 2, n)
        a = rng.integers(0, 2, n)
        return [np.concatenate([[11 + k, 13 + (k if t else 1 - k)], 100 + rng.choice(300, 30, replace=False)]) for k, t in zip(a, y, strict=True)], y

    (x, y), (unseen, truth) = rows(3000), rows(500)
    m = toxicity.fit([(i, np.ones(len(i))) for i in x], y.astype(float))
    p = [m.logits(1, np.zeros(len(i), np.int64), m.slot[i].astype(np.int64))[0] > 0 for i in unseen]
    assert np.mean(p == truth) > 0.95


def test_secrets(spark):
    rows = ["token = abc123", "password: 'hunter22'", "secret=short token: longer_one", None, "", "AKIA" + "A1" * 8, "AKIA123", "0123456789abcdef01234567 x", "deadbeef", "éé API_KEY=\"zzzzzz\" and hex " + "ab" * 20, "x" * 20000 + " token=q1w2e3r4t5 " + "f" * 30, "key Zq8vKx0PwLr4TnB7sYd2 end"]
    docs = spark.createDataFrame([(i, t, "v") for i, t in enumerate(rows)] + [(None, "token=abcdefg", "v")], "doc_id long, text string, start string")
    prose = spark.createDataFrame([(i, " ".join("".join(random.Random(50 * i + k).choices(["the", "sta", "tion", "run", "ning", "un", "der", "peo", "ple", "na"], k=3)) for k in range(50))) for i in range(50)], "doc_id long, text string")
    out = {r.doc_id: r for r in secrets.find_secrets(docs, secrets.train(prose)).collect()}
    for i, text in enumerate(rows):
        text = text or ""
        want = [(m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        assert [(x.start, x.end) for x in out[i]._assign] == want
        assert [(x.start, x.end) for x in out[i]._access] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        assert [(x.start, x.end) for x in out[i]._hex] == [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert [x.text for x in out[11]._random] == ["Zq8vKx0PwLr4TnB7sYd2"]
    assert len(out[None]._assign) == 1


def test_secret_model_on_strings_not_learnt(spark):
    rng = random.Random(7)
    prose = spark.createDataFrame([(i, " ".join("".join(rng.choices(["the", "sta", "tion", "run", "ning", "un", "der", "peo", "ple", "na", "gre", "mo"], k=3)) for _ in range(80)), 1, 2) for i in range(200)], "doc_id long, text string, _text int, `a.b` int")
    model = secrets.train(prose)
    rates = secrets.evaluate(prose, model)
    print(rates)
    assert min(rates["random_16"], rates["random_20"], rates["random_24"]) >= 0.95 and rates["letters"] >= 0.8 and rates["identifiers"] <= 0.01
    docs = spark.createDataFrame([(1, "=" * 40 + " and " + "-" * 60), (2, "internationalisation_of_the_station_1"), (3, "key QwErTyZxKvPlMnBgHjRd")], "doc_id long, text string")
    out = {r.doc_id: r._random for r in secrets.find_secrets(docs, model).collect()}
    assert not out[1] and len(out[3]) == 1
    assert secrets.find_secrets(prose, model).columns == ["doc_id", "text", "a.b", "_assign", "_access", "_hex", "_random"]


def test_pii(spark):
    rows = ["mail a.b@c.de, x@y", "a@b.c_d@e.fg", "1.2.3.4 and 1.2.3.400 and 01.002.3.4.5.6.7.8", "4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (555) 123-4567 and +12", None, "", "call me: (212) 555-7788 now", "é" * 30 + "q@r.st", " ".join(f"u{k}@h{k}.io" for k in range(700)), "order 2024-01-05"]
    docs = spark.createDataFrame([(i, t, "v") for i, t in enumerate(rows)], "doc_id long, text string, p string")
    out = {r.doc_id: r for r in pii.find_pii(docs, pii.train(docs)).collect()}
    luhn = lambda d: sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0
    for i, text in enumerate(rows):
        text = text or ""
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        span = lambda xs: [(x.start, x.end) for x in xs]
        assert span(out[i]._email) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert span(out[i]._ip) == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert span(out[i]._card) == [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
        assert span(out[i]._phone) == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    assert [(x.kind, x.start) for x in out[7]._added] == [("phone", 9)]
    assert out[10]._added == []


def test_pii_on_spellings_not_learnt(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=40))) for i in range(60)], "doc_id long, text string")
    rates = {r.kind: r for r in pii.evaluate(docs, pii.train(docs)).collect()}
    print(rates)
    assert set(rates) == {k for k, _ in pii.GENERATORS}
    assert all((r.precision or 0) >= 0.7 and r.recall >= 0.4 for r in rates.values())


def test_pii_in_very_long_runs(spark):
    """A million characters that the patterns could recurse or retry on."""
    texts = ["1" * 10**6, "1 " * 500_000, "1-" * 500_000, "." * 10**6, "a@b" + ".c" * 500_000, "a" * 10**6, "f" * 10**6 + ":", "+" + "1 (" * 300_000, "1." * 500_000, "a(at)b" + "(dot)c" * 150_000, " at " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_pii(docs, pii.train(docs)).select("doc_id", *[f"_{k}" for k in pii.KINDS]).collect()}
    assert [(x.start, x.end) for x in out[4]._email] == [(0, len(texts[4]))]
    assert len(out[8]._ip) == 125_000 and not out[0]._card and not out[1]._card


def test_very_many_spans_in_one_text(spark):
    """Forty thousand of each kind side by side: the added ones are held against the fixed ones in blocks."""
    prose = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=60))) for i in range(100)], "doc_id long, text string")
    n = 20_000
    one = spark.createDataFrame([(1, "call me: 212-555-7788 or a@b.co " * n)], "doc_id long, text string")
    r = pii.find_pii(one, pii.train(prose)).select("_email", "_added").first()
    assert [x.start for x in r._email] == [25 + 32 * k for k in range(n)] and [x.start for x in r._added] == [9 + 32 * k for k in range(n)]
    one = spark.createDataFrame([(1, "password=hunter2x aK9dk2LmQ8zPw0RtY3vB " * n)], "doc_id long, text string")
    rng = random.Random(7)
    prose = spark.createDataFrame([(i, " ".join("".join(rng.choices(["the", "sta", "tion", "run", "ning", "un", "der", "peo", "ple", "na", "gre", "mo"], k=3)) for _ in range(80))) for i in range(100)], "doc_id long, text string")
    r = secrets.find_secrets(one, secrets.train(prose)).select("_assign", "_random").first()
    assert [x.start for x in r._assign] == [39 * k for k in range(n)] and [x.start for x in r._random] == [18 + 39 * k for k in range(n)]


def test_added_spans_against_plain_python(spark):
    """Spellings planted in prose: what is added are the candidates over their threshold that touch no fixed span, the likelier of two that overlap."""
    rng = random.Random(3)
    said = ["(212) 555-7788", "030 1234 5678", "anna5 (at) mail3 (dot) com", "12ab:34cd:56ef:78ab:9abc:def0", "4111.1111.1111.1111", "a.b@c.de", "10.0.0.1", "+1 555 123 4567", "order 2024-01-05", "12:30:45:10"]
    rows = [(i, " ".join(rng.choices(WORDS, k=6)) + " call me: " + rng.choice(said) + rng.choice([" ", ", ", ". ", "/"]) + rng.choice(said) + " " + rng.choice(WORDS)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    out = {r.doc_id: r for r in pii.find_pii(docs, model).collect()}
    from pyspark.sql import functions as F

    flat = spark.createDataFrame([(i, g, m.start(), m.end(), m[0], t[max(0, m.start() - pii.BEFORE) : m.start()], t[m.end() : m.end() + 1]) for i, t in rows for g, (_, p) in enumerate(pii.GENERATORS) for m in regex.finditer(p, t)], "doc_id long, g int, a int, b int, text string, before string, after string")
    x = pii._features(F.col("g"), F.col("text"), F.col("before"), F.col("after"))
    p = {(r.doc_id, r.g, r.a, r.b): r.p for r in flat.withColumn("f", x).select("doc_id", "g", "a", "b", model.probability(F.col("f")).alias("p")).collect()}
    digits = lambda t: re.sub("[^0-9]", "", t)
    luhn = lambda d: sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0
    fits = {"phone": lambda t: 7 <= len(digits(t)) <= 15, "card": lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))}
    texts, kinds = dict(rows), [k for k, _ in pii.GENERATORS]
    for i, r in out.items():
        base = [(s.start, s.end) for k in pii.KINDS for s in r[f"_{k}"]]
        apart = lambda a, b, of: all(b <= c or a >= d for c, d in of)
        mine = [(q, g, a, b) for (j, g, a, b), q in p.items() if j == i and fits.get(kinds[g], lambda t: True)(texts[i][a:b]) and apart(a, b, base) and q >= model.thresholds[g]]
        kept = [(kinds[g], a, b) for q, g, a, b in mine if not any((c < b and a < d) and h != g and (z > q or z == q and h < g) for z, h, c, d in mine)]
        assert sorted((s.kind, s.start, s.end) for s in r._added) == sorted(kept), texts[i]
    assert sum(len(r._added) for r in out.values()) > 60


def plain_distance(item, words):
    """The least edit distance of item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    items = [[f"i{k}x{rng.randrange(50)}" for _ in range(n)] for k, n in enumerate([1, 2, 3, 5, 5, 6, 9, 10, 14, 20, 31, 45])]
    docs = []
    for i in range(240):
        words = [f"p{rng.randrange(2000)}" for _ in range(rng.randint(0, 80))]
        if i % 2:
            leak = list(rng.choice(items))
            for _ in range(rng.randint(0, 12)):
                at, how = rng.randrange(len(leak)), rng.randrange(3)
                leak[at : at + 1] = [[], ["new"], [leak[at], "new"]][how]
                leak = leak or ["gone"]
            words[len(words) // 2 : len(words) // 2] = leak
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "the " * 400), (503, "he said two words only"), (504, "word " * 200_000)]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "two words"), (92, "the the the the the")]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for i, text in docs:
        for k, item in bench:
            words = (item or "").split()
            d = plain_distance(words, (text or "").split())
            if words and d <= int(0.2 * len(words) + 1e-9):
                want[i, k] = d
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and len(want) > 30
    assert np.mean([got[k] == want[k] for k in got]) > 0.95


def test_leaks_in_scripts_without_spaces(spark):
    item = "人工知能は質問に答えるために文章を読む機械である"
    docs = [(1, f"ところで{item}。"), (2, f"ところで{item[:10]}と{item[11:]}"), (3, "まったく別の文章がここにある"), (4, "mixed 人工 text")]
    bench = spark.createDataFrame([(1, item, 3)], "item_id long, text string, doc_id long")
    got = decontaminate.leaks(spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item_id long"), bench).collect()
    assert {(r.doc_id, r.distance) for r in got} == {(1, 0), (2, 1)}
    words, first = next(decontaminate.words_of(pa.array(["mixed 人工text, x", ""])))
    assert first.tolist() == [0, 5, 5]


def test_lsh_alone_reaches_its_recall():
    """Windows at every place and no seeds: items at the full number of edits meet in some hash."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(400):
        m = int(rng.integers(12, 40))
        item = rng.integers(0, 1 << 62, m).astype(np.uint64)
        words = item.tolist()
        for _ in range(int(0.2 * m)):
            at, how = int(rng.integers(len(words))), int(rng.integers(3))
            new = int(rng.integers(0, 1 << 62))
            words[at : at + 1] = [[], [new], [words[at], new]][how]
        text = np.concatenate([rng.integers(0, 1 << 62, 20), np.array(words, np.int64), rng.integers(0, 1 << 62, 20)]).astype(np.uint64)
        samples = decontaminate.samples_for(0.99)
        keys = decontaminate.lsh_keys(np.lib.stride_tricks.sliding_window_view(text, m), samples)
        met += bool((keys == decontaminate.lsh_keys(item[None], samples)).any())
    assert met >= 0.99 * 400


def test_cgk_keeps_equal_rows_together():
    x = np.random.default_rng(1).integers(0, 1 << 62, (3, 20)).astype(np.uint64)
    keys = decontaminate.lsh_keys(np.concatenate([x, x]), 12)
    assert np.array_equal(keys[:3], keys[3:]) and not np.array_equal(keys[0], keys[1])
    assert list(decontaminate.words_of(pa.array([None, "A b"])))[0][1].tolist() == [0, 0, 2]


def test_threshold_of_secrets_comes_from_all_words(spark):
    words = spark.range(25_000).selectExpr("translate(lpad(id, 18, '0'), '0123456789', 'abcdefghij') AS w", "1L AS n")
    assert secrets.calibration(words).count() == 5 * 25_000
