"""Vector bin packing of tokenised examples under simultaneous limits on tokens, segments and loss-bearing tokens.

Each Spark partition is packed on its own, as a stream with a bounded window, by the dot-product heuristic: the open
sequence takes the fitting example whose demand vector has the largest dot product with what is left of its limits.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; window: examples that wait for a place at a time; cut: whether examples may be cut."""

    tokens: int = 4096
    segments: int = 512
    loss_tokens: int = 4096
    window: int = 256
    cut: bool = True

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.window) < 1:
            raise ValueError("every limit must be 1 at least")


class Packer:
    """Places examples (row, tokens, loss tokens: the last ones of the example) and yields whole sequences.

    A sequence is a list of (row, start, length). An example over the limits is cut even where ``cut`` is off, as no
    sequence could hold it. With ``cut``, the next example is cut to fill what the fitting ones leave of a sequence,
    and the last sequence is split at powers of two, which need no padding.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        # The waiting examples by slot; a slot without tokens is free.
        self.rows: list = [None] * (limits.window + 1)
        self.start = np.zeros(limits.window + 1, np.int64)
        self.tokens, self.loss = self.start.copy(), self.start.copy()
        self.free = list(range(limits.window + 1))
        self.count = 0

    def add(self, row: object, tokens: int, loss: int) -> Iterator[list[tuple]]:
        slot = self.free.pop()
        self.rows[slot], self.start[slot], self.tokens[slot], self.loss[slot] = row, 0, tokens, loss
        self.count += 1
        while self.count >= self.limits.window:
            yield self._sequence()

    def finish(self) -> Iterator[list[tuple]]:
        while self.count:
            pieces = self._sequence()
            size = sum(p[2] for p in pieces)
            if self.count or not self.limits.cut or size & (size - 1) == 0:
                yield pieces
                continue
            queue = deque(pieces)
            while queue:
                room, part = 1 << (sum(p[2] for p in queue).bit_length() - 1), []
                while room:
                    row, start, length = queue.popleft()
                    taken = min(room, length)
                    part.append((row, start, taken))
                    room -= taken
                    if taken < length:
                        queue.appendleft((row, start + taken, length - taken))
                yield part

    def _take(self, slot: int, most: int, loss_most: int) -> tuple[tuple, int]:
        """A first piece of at most so many tokens and loss tokens; what is left of the example waits on."""
        row, start, tokens, loss = self.rows[slot], int(self.start[slot]), int(self.tokens[slot]), int(self.loss[slot])
        taken = min(tokens, most, tokens - loss + loss_most)
        spent = max(0, taken - (tokens - loss))
        self.start[slot], self.tokens[slot], self.loss[slot] = start + taken, tokens - taken, loss - spent
        if taken == tokens:
            self.rows[slot] = None
            self.free.append(slot)
            self.count -= 1
        return (row, start, taken), spent

    def _sequence(self) -> list[tuple]:
        x = self.limits
        tokens, segments, loss, out = x.tokens, x.segments, x.loss_tokens, []
        while self.count and tokens and segments:
            # Demands times what is left, both as shares of the limits. Every example is one segment, which adds the same to all.
            score = self.tokens * (tokens / x.tokens**2) + self.loss * (loss / max(1, x.loss_tokens) ** 2) + segments / x.segments**2
            fits = (self.tokens > 0) & (self.tokens <= tokens) & (self.loss <= loss)
            if fits.any():
                best = int(np.argmax(np.where(fits, score, -1)))
            elif x.cut or not out:
                best = int(np.argmax(np.where(self.tokens > 0, score, -1)))
            else:
                break
            piece, spent = self._take(best, tokens, loss)
            if not piece[2]:  # its loss-bearing tokens come next, and that limit is met
                break
            out.append(piece)
            tokens, segments, loss = tokens - piece[2], segments - 1, loss - spent
        return out


#: Texts of these characters only are split here as the tokenizer would; it normalises all others itself.
_PLAIN = re.compile("[^\t-\r -~¡-į]")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Texts that tell whether a tokenizer splits as the cached path does: cases, digits, marks, apostrophes, white space, other scripts.
PROBES = ("Hello, World. it's WE'LL don't", "a1b22 3.14 x_y-z (ok) [q] {r} #t @u", " two  spaces\ttabs\nlines ", "Ünder ÉTÉ straße naïve", "日本語 текст ελ", "!!! ... -- 's 'S", "", "end.", "A,b;c:d", "3rd 4TH 1,000")


class WordTokens:
    """Ids of texts, as little-endian 32-bit words, by a tokenizer file with word ends and lower case; words met before come from a bounded cache."""

    def __init__(self, path: str, cached: int = 600_000):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(_SPLIT)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 0x130)}
        self.cached, self.words, self.parts = cached, {}, {}
        self.own = False
        try:
            fast = self.encode(list(PROBES))
        except Exception:  # its model takes no parts, or lacks the byte alphabet
            fast = []
        self.own = fast != [self._whole(p) for p in PROBES]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        split = {}
        for k, text in enumerate(texts):
            if self.own or "<|" in text or _PLAIN.search(text):
                out[k] = self._whole(text)
            else:
                split[k] = text.lower().split()
        if len(self.words) > self.cached:
            self.words.clear()
        if len(self.parts) > 2 * self.cached:
            self.parts.clear()
            self.words.clear()
        new = set().union(*split.values()).difference(self.words)
        pieces = {w: (w,) if w.isalpha() else (w[:-1], w[-1]) if w[-1] in ",." and w[:-1].isalpha() else self.split.findall(w) for w in new}
        self._learn(list(dict.fromkeys(p for ps in pieces.values() for p in ps if p not in self.parts)))
        parts, words = self.parts, self.words
        for w, ps in pieces.items():
            words[w] = parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])
        for k, ws in split.items():
            out[k] = b"".join([words[w] for w in ws])
        return out

    def _learn(self, parts: list[str]) -> None:
        """The ids of parts that the tokenizer would not split any more: their bytes, written in its byte alphabet, go to its model."""
        model = self.tokenizer.model
        for p in parts:
            ids = [t.id for t in model.tokenize(p.translate(self.alphabet))]
            self.parts[p] = struct.pack(f"<{len(ids)}I", *ids)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits = Limits(), response: str | None = None) -> DataFrame:
    """Tokenise docs (doc_id, text; other columns are not read), add end_id and pack, one row per piece.

    Columns: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset. Without
    ``response`` all ids bear loss, so that the limits on tokens and loss tokens are one. With it, each row is an
    instruction: ``text`` is the prompt, the column of that name the answer that follows, and only the answer's ids and
    the end id bear loss, so that all three limits count. Null and empty texts are the end id alone; null doc_ids and
    repeated rows are packed like others. sequence_id holds the partition and a running number, so a task that runs again
    gives the same ids. No rows give no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer, end = WordTokens(tokenizer), Packer(limits), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def place(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc_id, ids), start, length in pieces:
                rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [x or "" for x in part.column("text").to_pylist()]
                answers = words.encode([x or "" for x in part.column("response").to_pylist()]) if response else [b""] * len(texts)
                for doc_id, ids, answer in zip(part.column("doc_id").to_pylist(), words.encode(texts), answers, strict=True):
                    ids += answer + end
                    for pieces in packer.add((doc_id, ids), len(ids) // 4, (len(answer) + 4 if response else len(ids)) // 4):
                        place(pieces)
            if len(rows) > 10_000:
                yield flush()
        for pieces in packer.finish():
            place(pieces)
        if rows:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([docs[f"`{response}`"].alias("response")] if response else []))
    return rows.mapInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
