"""URL filter, hard negatives and source divergence against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, hard_negatives, urls


# --- URL filter


def judged(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    hits = [t for t in sorted(urls.VOCABULARY) if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", low)]
    weight = sum(urls.VOCABULARY[t] for t in hits)
    return host, path, rule, verdict or ("block" if weight >= urls.LIMIT else "allow"), weight, ",".join(hits)


def test_urls_against_plain_python(spark):
    rng = random.Random(3)
    parts = ["http://", "https://", "://", "/", "?", "#", ".", "-", "net", "org", "com", "example", "/en/", "/fr/", "/de/", "WWW.", "xxx", "Cheap", "pills", "win", "window", "CASINO", "1", "é", "\n", "@", ":80", "poker"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    made += [None, "", "x", "http://a.b.example.net/en/", "http://example.net/en", "http://notexample.net/fr/", "HTTP://EXAMPLE.ORG/fr/x://y", "http://net", "http://net/", "http://.net/", "http://net./", "://", "a?://net/", "ftp://example.com/de/#/en/"]
    made += ["http://" + "a." * 100_000 + "net/x", "http://h/" + "cheap-" * 50_000, "http://h/" + "q" * 500_000 + "/casino"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "weight", "terms").collect()}
    assert len(got) == len(made)
    for k, url in enumerate(made):
        assert got[k] == judged(url), url[:200] if url else url


def test_urls_with_clashing_columns_repeats_and_no_rows(spark):
    pages = spark.createDataFrame([("h", None, "http://a.net/", 1), ("h", None, "http://a.net/", 1)], "Host string, `c.d` string, url string, terms int")
    out = urls.filter_urls(pages)
    assert out.columns == ["c.d", "url", "host", "path", "rule", "verdict", "weight", "terms"]
    assert [(r.host, r.rule, r.verdict) for r in out.collect()] == [("a.net", "net/", "block")] * 2
    assert urls.filter_urls(pages.limit(0)).collect() == []


def test_urls_take_other_rules_and_words(spark):
    pages = spark.createDataFrame([("http://a.b/x/y",), ("http://b/x",), ("http://c/hot-stuff",), ("http://c/hot",)], "url string")
    got = urls.filter_urls(pages, rules=(("b", "/x", "allow"), ("a.b", "/", "block"), ("b", "/x/y", "block")), weights={"hot": 1, "stuff": 1}, limit=2)
    assert [(r.rule, r.verdict) for r in got.collect()] == [("b/x/y", "block"), ("b/x", "allow"), (None, "block"), (None, "allow")]
    assert [r.verdict for r in urls.filter_urls(pages, rules=(), weights={}).collect()] == ["allow"] * 4
    with pytest.raises(ValueError):
        urls.Vocabulary({"Upper": 1})


# --- hard negatives


def mined(rows, anchors, positives=5, negatives=5, percent=80):
    """rows: (id, label, vector), each row once."""
    out = []
    rows = sorted({(i, c, tuple(v)) for i, c, v in rows})
    width = max((len(v) for *_, v in rows), default=0)
    rows = [(i, c, [*v, *[0] * (width - len(v))]) for i, c, v in rows]
    for a, label, q in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, c) for i, c, v in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    # Small blocks and leaves, so that trees have several levels and regions several blocks.
    for name, value in (("SAMPLE", 300), ("SHARE", 32), ("BLOCK", 60), ("LEAF", 8), ("TOGETHER", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 60, (6, 8))
    rows = [(int(k), int(rng.integers(3)), np.floor(centres[k % 6] + rng.normal(0, 20, 8)).astype(int).tolist()) for k in range(700)]
    rows += [(1000 + k, k % 4, [50] * 8) for k in range(300)]  # one vector many times over: equal distances, equal scores
    rows += [(2000, 1, [0] * 8), (2010, 1, []), (2020, 2, [7]), (2030, 5, [-90] * 8), rows[0], rows[10], (20, 2, [3] * 8)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>")
    got = collected(hard_negatives.hard_negatives(df, F.col("id") % 10 == 0))
    assert got == mined(rows, lambda i: i % 10 == 0) and len(got) > 1000
    got = collected(hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, 2, 3, 50))
    assert got == mined(rows, lambda i: i % 10 == 0, 2, 3, 50)


def test_hard_negatives_leave_rows_out(spark):
    """Leaves are skipped, which is what the tree is for, and none that holds a result."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (40, 16))
    rows = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 3, (4000, 16))).astype(np.int64)
    square = float((rows**2).sum(1).max())
    tree = hard_negatives.VpTree(rows, square, 16)  # leaves smaller than what lies together
    ids = np.arange(4000)
    labels = ids % 2
    far = np.full(50, hard_negatives.HIGHEST)
    touched = []
    real = hard_negatives.products
    try:
        hard_negatives.products = lambda a, b: touched.append(len(a) * len(b)) or real(a, b)
        q, i, s = hard_negatives.nearest(tree, rows, ids, labels, rows[:50], ids[:50], labels[:50], -far, far, True, 5)
    finally:
        hard_negatives.products = real
    score = rows[:50] @ rows.T
    for a in range(50):
        want = sorted((-score[a, k], k) for k in range(4000) if k != a and labels[k] == labels[a])[:5]
        assert [(-x, y) for x, y in zip(s[q == a], i[q == a], strict=True)] == want
    assert sum(touched) < 0.3 * 50 * 4000


def test_hard_negatives_of_odd_rows(spark):
    assert collected(hard_negatives.hard_negatives(spark.createDataFrame([], "id long, label int, vector array<long>"), F.lit(True))) == []
    nan, inf = float("nan"), float("inf")
    rows = [(100, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.2], 0), (7, [0.5, 0.25], 0), (3, [nan, 1.0], 0), (4, [1.0, inf], 0), (5, [None, 1.0], 0), (6, None, 0), (8, [0.5, 0.25], None), (None, [0.5, 0.25], 0), (14, [-0.5, 0.0], 9)]
    raw = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("vector", F.lit(1))
    kept = hard_negatives.vectors_of(raw, "vec_id", "embedding", "label", 256.0)
    assert sorted((r.id, r.label, tuple(r.vector)) for r in kept.collect()) == [(1, 1, (128, 64)), (2, 0, (128, 51)), (7, 0, (128, 64)), (14, 9, (-128, 0)), (100, 1, (128, 64))]
    got = collected(hard_negatives.hard_negatives(kept, F.col("id") % 100 == 0))
    assert got == [(100, 1, 1, 7, 20480, 20480), (100, 1, 2, 2, 20480, 19648)]
    large = spark.createDataFrame([(100, 1, [3 << 28, 1]), (1, 1, [3 << 28, 2]), (2, 0, [3 << 28, 1])], "id long, label int, vector array<long>")
    assert collected(hard_negatives.hard_negatives(large, F.col("id") == 100)) == [(100, 1, 1, 2, (9 << 56) + 2, (9 << 56) + 1)]


# --- source divergence


def audited(rows, top=200):
    """rows: (text, lang, source)."""
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for w in words:
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang in {x for x, _ in groups}:
        kept, sources = sorted(w for (x, w), n in docs.items() if x == lang and n >= 3), sorted(s for x, s in groups if x == lang)
        share = lambda n, total: 1 + 1_000_000_000 * (n + 1) // (total + len(kept))  # noqa: B023, E731
        total = {s: sum(counts.get((lang, s, w), 0) for w in kept) for s in sources}
        p = {(s, w): share(counts.get((lang, s, w), 0), total[s]) for s in sources for w in kept}
        q = {w: share(sum(counts.get((lang, s, w), 0) for s in sources), sum(total.values())) for w in kept}
        for s in sources:
            pairs = [(sum((p[s, w] - p[o, w]) ** 2 // p[o, w] for w in kept), o) for o in sources if o != s]
            terms = [((p[s, w] - q[w]) ** 2 // q[w], w) for w in kept if (lang, s, w) in counts and p[s, w] > q[w]]
            for part, values, last in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


def test_divergence_against_plain_python(spark):
    rng = random.Random(4)
    words = ["The", "the", "of", "Ünder", "ünder", "a1b", "x_y", "zu", "été", "日本", "\U0001f600", "end.", "it's"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(15)]
    rows = [(" ".join(rng.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=rng.randint(0, 60))), rng.choice(["en", "de", "fr"]), f"s{rng.randint(0, 6)}") for _ in range(250)]
    rows += rows[:20] * 3 + [("the " * 100_000 + "end", "en", "s0")]
    rows += [(None, "en", "s1"), ("", "en", "only empty"), ("x y z", "it", "one"), (None, None, None), ("Les les LES", None, "s"), ("les", None, None), ("les", "", ""), ("1 2 3", "xx", "a"), (None, "xx", "b")]
    df = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int").repartition(5)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    for top in (200, 3):
        got = sorted(tuple(r) for r in divergence.source_divergence(df, top).select(cols).collect())
        assert got == audited(rows, top)
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_divergence_shares_are_exact(spark):
    """Digit by digit, also where the plain product leaves 64 bits."""
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        total = rng.randint(0, rng.choice([10, 10**6, 8 * 10**15]))
        rows.append((rng.randint(0, total), total, rng.randint(1, 1000)))
    df = spark.createDataFrame(rows, "n long, total long, v long")
    got = [r.p for r in df.select(F.expr(divergence._share("n", "total")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + v) for n, total, v in rows]
