"""Chat formatting by columnar byte assembly.

The texts of a batch become one Arrow buffer: lengths of all segments (markers, roles, texts) in output order, their
running sum as offsets, and scatter indices that copy every byte to its place in a preallocated array.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textwords
from .common import table

#: A turn is OPEN role CLOSE text END. These strings do not occur in escaped roles and texts.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", END, OPEN, CLOSE)
LOSS_ROLE = "assistant"
_ESCAPE = [("\\", "\\\\"), *((c, f"{c[0]}\\{c[1:]}") for c in CONTROLS)]


def escape(column: pa.Array) -> pa.Array:
    """Backslashes doubled and one put into each control string; null is empty. ``unescape`` takes it back."""
    column = pc.fill_null(column, "")
    for what, by in _ESCAPE:
        column = pc.replace_substring(column, what, by)
    return column


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _scatter(out: np.ndarray, data: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """Copy consecutive segments of data to the places ``to``."""
    if len(data):
        out[np.arange(len(data)) + np.repeat(to - (np.cumsum(lengths) - lengths), lengths)] = data


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted conversations, begin and end byte of each turn's text within its conversation).

    first: the first row of each conversation and the number of rows.
    """
    role, role_at = textwords.text_bytes(escape(roles))
    text, text_at = textwords.text_bytes(escape(texts))
    n = len(roles)
    marks = [np.frombuffer(x.encode(), np.uint8) for x in (OPEN, CLOSE, END)]
    lengths = np.stack([np.full(n, len(marks[0])), np.diff(role_at), np.full(n, len(marks[1])), np.diff(text_at), np.full(n, len(marks[2]))], 1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, mark in zip((0, 2, 4), marks, strict=True):
        out[begins[:, k, None] + np.arange(len(mark))] = mark
    _scatter(out, role, lengths[:, 1], begins[:, 1])
    _scatter(out, text, lengths[:, 3], begins[:, 3])
    at = np.r_[begins[:, 0], len(out)][first]
    formatted = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(out))
    base = np.repeat(at[:-1], np.diff(first))
    return formatted, begins[:, 3] - base, ends[:, 3] - base


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss: array of (begin, end) bytes of formatted) of each conversation.

    turns: conv_id, turn, role, text; other columns are not read. Turns go by turn, then role, then text, so ties and
    repeated rows have one order; null roles and texts count as empty, null turns come first, and a null conv_id is one
    conversation. The loss covers the texts of LOSS_ROLE, without markers. No rows give no rows. The turns of a
    conversation meet in one task, in a sorted stream that holds one batch and one conversation.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, roles, texts = (x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in (t.column("conv_id"), t.column("role"), t.column("text")))
            first = np.r_[_starts(ids), len(ids)]
            formatted, begin, end = assemble(roles, texts, first)
            loss = pc.fill_null(pc.equal(roles, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
            n = np.add.reduceat(loss.astype(np.int64), first[:-1])
            spans = pa.StructArray.from_arrays([pa.array(begin[loss], pa.int64()), pa.array(end[loss], pa.int64())], ["begin", "end"])
            return pa.RecordBatch.from_arrays([ids.take(pa.array(first[:-1])), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), spans)], ["conv_id", "formatted", "loss"])

        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                t = pa.Table.from_batches([batch.slice(at, 2000)])
                t = pa.concat_tables([held, t]) if held is not None else t
                last = int(_starts(t.column("conv_id").combine_chunks())[-1])
                if last:
                    yield emit(t.slice(0, last))
                held = t.slice(last)
        if held is not None and len(held):
            yield emit(held)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(build, "conv_id long, formatted string, loss array<struct<begin: long, end: long>>")


def _starts(ids: pa.Array) -> np.ndarray:
    """The first row of each run of equal ids; nulls are equal."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (none[1:] != none[:-1])]) if len(ids) else np.zeros(0, np.int64)


_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(CLOSE)}(.*?){re.escape(END)}", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: the digests of their turns and of the text under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
                raw = text.encode()
                loss = "".join(unescape(raw[s["begin"] : s["end"]].decode()) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv_id, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = f"{END}{OPEN} ok {CLOSE}"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")).select("conv_id", "x.*", F.lit(said).alias("text"))
    return read_back(format_chats(turns.unionByName(extra)))


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS er,
             replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS et FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
