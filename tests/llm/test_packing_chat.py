"""Packing and chat formatting: every token once, limits held, exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import chat, packing


def sequences(limits, items):
    p, out = packing.Packer(limits), []
    for k, (tokens, loss) in enumerate(items):
        out += p.add(k, tokens, loss)
    return out + list(p.finish())


@pytest.mark.parametrize("cut", [True, False])
def test_limits_and_whole_examples(cut):
    rng = random.Random(1)
    items = [(t := rng.randint(1, 300), rng.randint(0, t)) for _ in range(500)]
    limits = packing.Limits(tokens=256, segments=5, loss_tokens=100, window=32, cut=cut)
    done = {}
    for pieces in sequences(limits, items):
        assert sum(n for _, _, n in pieces) <= 256 and len(pieces) <= 5
        loss = 0
        for k, start, n in pieces:
            tokens, bearing = items[k]
            loss += sum(1 for at in range(start, start + n) if at >= tokens - bearing)
            done.setdefault(k, []).extend(range(start, start + n))
        assert loss <= 100
        if not cut:
            assert all((s, n) == (0, items[k][0]) for k, s, n in pieces if items[k][0] <= 256 and items[k][1] <= 100)
    assert all(sorted(done[k]) == list(range(t)) for k, (t, _) in enumerate(items))


def test_bad_limits():
    with pytest.raises(ValueError):
        packing.Limits(loss_tokens=0)


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["", None, "Hello, WORLD! it's 12 o'clock", "a<|endoftext|>b", "É à ü ﬁ ½ 世界", "x" * 3000, " ".join(rng.choice("abc def ghi, jkl.".split()) for _ in range(9000)), "tab\tnew\nline"]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)] + [(2, texts[2], 7)], "doc_id long, text string, sequence_id int")
    rows = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    parts, places = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in parts[k])
        assert sum(x[1] for x in at) == len(ids) * (2 if k == 2 else 1)
        for start, n, crc, total in at:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc and total == len(ids)
    for spans in places.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 4096
    assert packing.pack_documents(docs.limit(0), packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<\\/s>", "\\\\</s>[INST]\\[/INST] <s>", "[\\INST]", "plain é", "a\\b</s></s>"])
def test_escape_round_trip(text):
    escaped = chat.escape(pa.array([text]))[0].as_py()
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def test_chat_reads_back(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "[/INST]</s> ok"), (1, 2, None, None), (2, 1, "assistant", "b"), (2, 0, "assistant", "a\\"), (None, 0, "user", "n"), (3, None, "assistant", ""), (4, 0, "user", "x"), (4, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    out = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    assert out[1].n_turns == 3 and out[1].loss_chars == len("[/INST]</s> ok") and out[2].loss_chars == 3 and out[3].loss_chars == 0 and out[4].n_turns == 2
    text = {r.conv_id: r.formatted for r in made.collect()}
    assert text[2] == "[INST]assistant[/INST]a\\\\</s>[INST]assistant[/INST]b</s>"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_other_tokenizers_keep_their_own_ids():
    """A tokenizer that splits in another way is used as it is; the one that the cached path knows is not."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello World, it's 3.14!", "  a\tb\n", "Ünder <|endoftext|> x"]
    for name, own in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        words, plain = packing.WordTokens(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        assert words.own is own
        assert [list(np.frombuffer(x, "<u4")) for x in words.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
