"""Exact dedup, line dedup and the Jaccard join on small cases and against brute force."""

import random
import uuid

import pytest

from tidemark.llm import exact_dedup, line_dedup, ngram_jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, component long, rep long"


def frame(spark, rows):
    """Rows (doc_id, text) with further columns, some named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, 2) for i, t in rows], SCHEMA)


def index(spark, path=None):
    return exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", path, buckets=4)


def test_second_load_meets_the_first(spark, tmp_path):
    """Of equal texts over both loads the longest row stays, then the least id, whichever load brought it; compaction changes nothing."""
    first = [(5, "a b"), (6, "c"), (7, "d  d"), (None, "n"), (9, None)]
    second = [(3, "ab"), (4, "a  b"), (2, "c"), (8, "d d"), (1, "n"), (10, ""), (11, "new"), (12, " ")]
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", str(tmp_path / "better"), buckets=3)
    schema = "doc_id long, text string"
    keep = lambda out: {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()}
    assert keep(exact_dedup.exact_dedup(spark.createDataFrame(first, schema), index, better=True)) == {(5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (None, None, 1, True), (9, 9, 1, True)}
    want = {(3, 4, 2, False), (4, 4, 2, True), (2, 2, 1, True), (8, 7, 1, False), (1, 1, 1, True), (10, 12, 2, False), (11, 11, 1, True), (12, 12, 2, True)}
    rows = spark.createDataFrame(second, schema)
    assert keep(exact_dedup.exact_dedup(rows, index, better=True)) == want
    assert spark.table(index.name).count() > index.rows().count() == 6
    assert keep(exact_dedup.exact_dedup(rows, index, better=True)) == want
    index.compact()
    assert spark.table(index.name).count() == index.rows().count() == 6
    assert keep(exact_dedup.exact_dedup(rows, index)) == want
    again = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", str(tmp_path / "other"), expected=10**9)
    assert again.buckets == 500
    plan = index.unseen(exact_dedup._groups(exact_dedup.digests(rows)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan



def test_exact_groups_ties_and_nulls(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " "), (7, "c"), (8, "a  b"), (None, "c")]
    out = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows), index(spark)).collect()}
    assert [out[i].keep_id for i in (1, 2, 3, 8)] == [3] * 4 and out[3].kept and not out[8].kept
    assert out[1].group_size == 4
    assert [out[i].keep_id for i in (4, 5, 6)] == [6] * 3
    assert out[7].kept and not out[None].kept


def test_exact_index_persists(spark, tmp_path):
    path = str(tmp_path / "index")
    exact_dedup.exact_dedup(frame(spark, [(1, "one"), (2, "two")]), index(spark, path)).collect()
    again = exact_dedup.exact_dedup(frame(spark, [(9, "o n e"), (10, "three")]), index(spark, path))
    out = {r.doc_id: (r.keep_id, r.kept) for r in again.collect()}
    assert out == {9: (1, False), 10: (10, True)}
    assert index(spark, path).rows().count() == 3


def test_exact_hot_group_and_empty(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(900)]
    out = exact_dedup.exact_dedup(frame(spark, rows), index(spark)).collect()
    assert len(out) == 900 and sum(r.kept for r in out) == 601
    assert exact_dedup.exact_dedup(frame(spark, []), index(spark)).count() == 0


def reference_lines(rows):
    """Chunks and cut lines by plain loops."""
    import hashlib

    seen, cut = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in lines]
        found = set()
        for k in range(line_dedup.SETS):
            last = {}
            for at, x in enumerate(h):
                bit = x >> k & 1
                if bit in last:
                    found.add((last[bit], at))
                last[bit] = at
        gone = set()
        for start, end in sorted(found):
            part = tuple(lines[start : end + 1])
            if part in seen:
                gone |= set(range(start, end + 1))
            seen.add(part)
        cut[i] = gone
    return {i: "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut[i]) for i, text in rows}, {i: len(x) for i, x in cut.items() if x}


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    passage = "\n".join(f"shared line {k} {rng.random()}" for k in range(14))
    rows = []
    for i in range(40):
        own = [f"own {i} {k}" for k in range(rng.randint(0, 6))]
        rows.append((i, "\n".join([*own, passage, *own[:2]]) if i % 2 else "\n".join(own)))
    rows += [(100, passage), (101, passage), (102, "\n\n\n\n"), (103, "x\n" * 500)]
    want, cut = reference_lines(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert {i: r._cut_lines for i, r in got.items() if r._cut_lines} == cut
    assert sum(cut.values()) > 100


def test_short_passages_in_foreign_lines(spark):
    """Passages of 2 to 6 lines and over 50 words amid lines of two documents; all other lines stay."""
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    rows, passages = [], {}
    for k in range(60):
        passages[k] = [line() for _ in range(2 + k % 5)]
        for side in (0, 1):
            rows.append((2 * k + side, "\n".join([line(), line(), *passages[k], line()])))
    rows.append((1000, "\n".join(passages[4])))
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    texts = dict(rows)
    assert all("\n".join(out[2 * k]) == texts[2 * k] for k in range(60))
    left = {k: sum(x in out[2 * k + 1] for x in p) for k, p in passages.items()}
    assert all(x in out[2 * k + 1] for k in range(60) for x in texts[2 * k + 1].split("\n") if x not in passages[k])
    two = [n for k, n in left.items() if k % 5 == 0]
    assert sum(n == 0 for n in two) >= len(two) - 3 and sum(n for k, n in left.items() if k % 5) <= 2
    assert out[1000] == [""] or len(out[1000]) <= 1


def test_lines_of_equal_hash_stay(spark, monkeypatch):
    """Lines whose hashes agree but not their bytes are no repeats."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "line_hashes", lambda text: F.transform(F.split(text, "\n", -1), lambda x: F.length(x).cast("long")))
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "a\nb"), (4, "xxx\nyyyyy"), (5, "xxx\nyyyyy")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out == dict(rows) | {5: ""}


def test_lines_nulls_and_columns(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "a\nb\nc"), (4, "a\nb\nc"), (None, "a\nb\nc"), (4, "a\nb\nc")])
    out = line_dedup.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in rows and (2, "") in rows and (3, "a\nb\nc") in rows and (None, "a\nb\nc") in rows and (4, "") in rows
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    named = df.selectExpr("doc_id", "text", "lang AS _cut", "n_chars AS _of", "digest AS _lines", "rep AS _n_lines", "n_chars AS `a.b`", "rep AS _rest")
    out = line_dedup.dedup_lines(named)
    assert out.columns == ["doc_id", "text", "_cut", "_of", "_lines", "a.b", "_rest", *line_dedup.COUNTS]
    assert {(r["_cut"], r["_lines"], r["_rest"]) for r in out.collect()} == {("en", "x", 2)}


def test_lookup_join_deals_hot_keys_out(spark):
    """One key with half of the rows, and null keys with a quarter, fill no partition."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import lookup_join

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 4 == 1, F.col("id")).alias("u"), F.col("id").alias("v"))
        lookup = rows.filter("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("w"), F.min("v").alias("m"))
        out = lookup_join(rows, lookup, ["u"], "w", 40_000, F.col("v"))
        sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("m")).collect()]
        assert len(sizes) == 16 and sum(sizes) == 40_000 and max(sizes) < 1.5 * 40_000 / 16
        assert out.filter("u = 0 AND m = 0").count() == 20_000 and out.filter("u IS NULL AND m IS NULL").count() == 10_000
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def shingles(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_jaccard_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choices(vocabulary, k=rng.randint(1, 160)) for _ in range(25)]
    common = rng.choices(vocabulary, k=40)
    rows = []
    for i in range(260):
        words = list(base[i % 25] if i % 3 else base[0])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if i % 5 == 0:
            words += common
        rows.append((i, (" " if i % 2 else "\n").join(words)))
    rows += [(1000, "Only Three words"), (1001, "only three\twords "), (1002, ""), (1003, None), (1004, " \n"), (1005, "ÀB cd"), (1006, "àb cd")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_classes(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_edges(spark):
    out = ngram_jaccard.jaccard_classes(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (2, "A B c d e f"), (2, "q r s t u v"), (5, "q r s t u v"), (2, "q r s t u v")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == sorted([("None", "None"), ("3", "2"), ("2", "2"), ("2", "2"), ("5", "2"), ("2", "2")])
    assert ngram_jaccard.jaccard_classes(frame(spark, [])).count() == 0


def test_word_hashes_tell_words_apart():
    """Words of every length, of 1024 letters and more in the orders that defeat polynomials, and both cases of a letter."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import textwords

    def folded(n, a, b):
        out = a
        while len(out) < n:
            out += out.translate({ord(a): b, ord(b): a})
        return out

    words = [x for n in (1024, 2048, 4096) for x in (folded(n, "a", "b"), folded(n, "b", "a"))] + ["q" * k for k in range(1, 40)] + ["q\0", "q\0\0", "é", "É"]
    data, at = textwords.text_bytes(pa.array([" ".join(words), None, " ".join(words).upper()]))
    starts, ends, first = textwords.boundaries(data, at)
    h = textwords.hashes(data, starts, ends)
    n = len(words)
    assert first.tolist() == [0, n, n, 2 * n] and len(np.unique(h[:n])) == n
    assert [k for k in range(n) if h[k] != h[n + k]] == [n - 2]  # upper() also changes é, which is no ASCII letter


def test_jaccard_tells_folded_words_apart(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate({97: "b", 98: "a"})
    b = a.translate({97: "b", 98: "a"})
    out = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_classes(frame(spark, [(1, a), (2, b), (3, a)])).collect()}
    assert out == {1: 1, 2: 2, 3: 1}


def test_full_columns_are_streamed(spark, monkeypatch):
    """Columns beyond FULL entries, and columns cut into tiles, give the same classes."""
    monkeypatch.setattr(ngram_jaccard, "FULL", 8)
    monkeypatch.setattr(ngram_jaccard, "TILE", 5)
    monkeypatch.setattr(ngram_jaccard, "HUBS", (2,))
    rng = random.Random(12)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(90)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_classes(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_prefix_bound_holds(percent):
    """Two sets at the threshold share the prefix shingles that the bounds promise, under a common order."""
    rng = random.Random(percent)
    for _ in range(300):
        n = rng.randint(1, 80)
        a = set(rng.sample(range(400), n))
        b = set(list(a)[: rng.randint(0, n)]) | set(rng.sample(range(400), rng.randint(0, 10)))
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            prefix = [set(sorted(x)[: len(x) - ngram_jaccard.least_overlap(len(x), percent) + len(x) // 10 + 1]) for x in (a, b)]
            least = -(-len(a) * percent // 100) // 10 + 1
            assert len(prefix[0] & prefix[1]) >= least
