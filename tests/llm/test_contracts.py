"""The opN_ queries on the smallest tables, against plain Python over the same rows."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import exact_dedup, packing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return queries()[name](spark, SF).collect()


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def luhn(digits):
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


def added_apart(base, spans):
    """The spans of a row hold all base ones, and the others overlap none of them."""
    got = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
    assert set(base) <= set(got)
    more = [x for x in got if x not in base]
    assert all(a >= y or b <= x for _, a, b in more for _, x, y in base)
    return more


def test_op2(spark, documents):
    rows = result(spark, "op2_pii")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        found = personal(documents[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(x) for x in found.values())
        base = [(k, a, b) for k, xs in found.items() for a, b in xs]
        assert r.base_sha256 == digest(base)
        added_apart(base, r.spans)


def test_op10(spark, documents):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rows = result(spark, "op10_secrets")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r.doc_id]
        found = {"assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6], "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20], "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(x) for x in found.values())
        order = list(found)
        base = sorted(((k, a, b) for k, xs in found.items() for a, b in xs), key=lambda x: (x[1], order.index(x[0])))
        assert r.base_sha256 == digest(base)
        added_apart(base, r.spans)


def test_op7(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = result(spark, "op7_packing")
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in documents.items()}
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in pieces.items():
        assert sorted(p for a, n in parts for p in range(a, a + n)) == list(range(len(ids[i])))
    assert set(pieces) == set(documents)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_op7_instructions(spark):
    """A prompt and an answer: only answers bear loss, and its limit binds before that on tokens."""
    rows = [(k, "prompt word " * (k % 7), "answer text " * (1 + k % 5), "x") for k in range(60)] + [(90, None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, reply string, response string").repartition(1)
    limits = packing.Limits(tokens=64, segments=6, loss_tokens=20, window=16)
    out = packing.pack_documents(df, packing.default_tokenizer(), limits=limits, response="reply").collect()
    from tokenizers import Tokenizer

    count = lambda t: len(Tokenizer.from_file(packing.default_tokenizer()).encode(t or "", add_special_tokens=False).ids)
    prompt = {r[0]: count(r[1]) for r in rows}
    used, covered = {}, {}
    for r in out:
        loss = max(0, r.start + r.length - max(r.start, prompt[r.doc_id]))
        s = used.setdefault(r.sequence_id, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r.length, s[1] + 1, s[2] + loss
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert all(t <= 64 and n <= 6 and loss <= 20 for t, n, loss in used.values()) and max(s[2] for s in used.values()) == 20
    assert covered == {r[0]: prompt[r[0]] + count(r[2]) + 1 for r in rows}


@pytest.mark.parametrize(("name", "folds", "fold"), [("op8_quality", 4, 2), ("op9_toxicity", 3, 1)])
def test_scores(spark, documents, name, folds, fold):
    rows = result(spark, name)
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op3_rows(spark, documents):
    rows = result(spark, "op3_decontaminate")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t)
    found = {(r.doc_id, r.item_id): r for r in rows}
    for i, text in documents.items():
        for k, item in items.items():
            w = words(item)
            if w and " ".join(w).lower() in " ".join(words(text)).lower():
                assert found[i, k].distance == 0
    assert all(0 <= r.distance <= 0.2 * len(words(items[r.item_id])) for r in rows)


def test_loads_are_idempotent(spark, tmp_path):
    """The same load again gives the same rows and leaves the index alone; the query drops its own."""
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (None, "d"), (4, "a  b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, "idem", str(tmp_path / "index"), buckets=2)
    first = sorted(map(str, exact_dedup.exact_dedup(docs, index).collect()))
    assert sorted(map(str, exact_dedup.exact_dedup(docs, index).collect())) == first and index.rows().count() == 3
    result(spark, "op6_exact_dedup")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]
