"""The pipeline's stages on a small corpus, each against what it has to keep."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    item = " ".join(word() for _ in range(30))
    near = [word() for _ in range(120)]
    passage = "\n".join(" ".join(word() for _ in range(8)) for _ in range(12))
    docs = {i: " ".join(word() for _ in range(80)) for i in range(60)}
    for i in range(0, 60, 6):
        docs[i] += " vile scummy"
    docs |= {100: " ".join(near), 101: " ".join([*near[:60], "edit", *near[61:]]), 102: f"{docs[1]} {item}", 103: f"start a\n{passage}\nend a", 104: f"start b\n{passage}\nend b"}
    labels = [(i, 1, int(i % 6 == 0)) for i in range(60)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, left, d)
        assert out.columns == left.columns
        out.write.parquet(f"{d}/{name}")
        left = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r.doc_id: r for r in left.collect()}
    toxic = {i for i in range(0, 60, 6)}
    assert toxic.isdisjoint(seen["toxicity"]) and len(seen["toxicity"]) == len(docs) - len(toxic)
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    assert seen["line_dedup"][103].text == docs[103] and len(seen["line_dedup"][104].text) < len(docs[104])
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    assert set(seen["line_dedup"]) - set(seen["ngram_jaccard"]) == {101}
    assert set(seen["ngram_jaccard"]) - set(seen["decontaminate"]) == {102}
    pieces = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in pieces} == set(seen["decontaminate"])


def test_run_matches_plain_loops(spark, tmp_path):
    """run()'s rows against loops over each stage: every piece of every document that is left, and no other."""
    import random
    import re
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tidemark.llm import packing

    from .test_dedup import brute_components, reference_lines
    from .test_models import plain_distance

    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(3000)}"
    line = lambda: " ".join(word() for _ in range(rng.randint(5, 12)))
    items = {k: " ".join(word() for _ in range(n)) for k, n in ((1, 2), (2, 5), (3, 24))}
    passages = [[line() for _ in range(n)] for n in (2, 3, 6)]
    texts = {}
    for i in range(90):
        lines = [line() for _ in range(rng.randint(1, 8))]
        if i % 7 == 0:
            lines[len(lines) // 2 : len(lines) // 2] = rng.choice(passages)
        if i % 9 == 0:
            lines[-1] += " " + rng.choice(list(items.values()))
        if i % 8 == 0:
            lines[0] += " vile scummy"
        texts[i] = "\n".join(lines)
    for i in range(100, 130):  # near copies on one line, which line dedup leaves alone
        words = re.split(r"\s+", texts[i % 20])
        words[rng.randrange(len(words))] = word()
        texts[i] = " ".join(words)
    texts |= {200: "", 201: None, 202: texts[3], 203: " \n"}
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    # The machine's scores are taken as they are; all that follows is plain.
    left = {r.doc_id: r.text for r in pipeline.drop_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()}
    assert 60 < len(left) < len(texts)
    cut, _ = reference_lines([(i, t) for i, t in left.items() if t is not None])
    left = {i: cut.get(i) for i in left}
    groups = brute_components(list(left.items()))
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    words = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
    leaks = {i for i, t in left.items() for x in items.values() if plain_distance(words(x), words(t)) <= int(0.2 * len(words(x)) + 1e-9)}
    assert leaks
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in left.items() if i not in leaks}
    got = {}
    for r in pipeline.run(spark, d).collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        got.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {i: sorted(x) for i, x in got.items()} == {i: list(range(len(x))) for i, x in want.items()}


def test_documents_with_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own pass through every stage."""
    d = str(tmp_path)
    rows = [(i, f"text {i} of w{i * 7} and more w{i * 11}", "en", "s", 9, 0.99, 1, 2, "z") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _gone int, _text int, `a.b` string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "not in there at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, step) in enumerate(pipeline.STAGES[:-1]):
        out = step(spark, left, d)
        assert out.columns == left.columns
        out.write.parquet(f"{d}/{k}")
        left = spark.read.parquet(f"{d}/{k}")
    assert {(r["score"], r["_gone"], r["_text"], r["a.b"]) for r in left.collect()} == {(0.99, 1, 2, "z")}


def test_empty_corpus(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert pipeline.run(spark, d).count() == 0
