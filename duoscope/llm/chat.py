"""Chat formatting by columnar byte assembly, and the reader of the formatted text.

A turn is written as ``### Role: text </turn>`` and a newline. In roles and texts a backslash goes before every
backslash, ``#`` and ``<`` (and, in roles, before ``:``), so neither mark can stand in them and the reader can take the
backslashes away again. The loss mask is a list of spans of code points: the escaped text of each assistant turn.

Rows of a conversation are ordered by turn, then role, then text (nulls first), so ties have one result; repeated
rows are turns of their own. A null text or role counts as empty, a null conversation is a conversation by itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import col, from_bytes, spread, utf8

HEAD, MIDDLE, TAIL = b"### ", b": ", b" </turn>\n"
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(buf: np.ndarray, offs: np.ndarray, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """buf with a backslash before each byte in marks, and the new offsets."""
    special = np.zeros(256, bool)
    special[list(marks)] = True
    odd = special[buf]
    shift = np.concatenate([[0], np.cumsum(odd)])
    out = np.full(len(buf) + int(shift[-1]), ord("\\"), np.uint8)
    out[np.arange(len(buf)) + shift[1:]] = buf
    return out, offs + shift[offs]


def code_points(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many code points each row has."""
    total = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return np.diff(total[offs])


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of each formatted turn; its code points, and where its escaped text begins and ends in them."""
    role_buf, role_at = escape(*utf8(role), b"\\#<:")
    text_buf, text_at = escape(*utf8(text), b"\\#<")
    n = len(role)
    fixed = [np.frombuffer(x, np.uint8) for x in (HEAD, MIDDLE, TAIL)]
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    sizes = np.stack([np.full(n, len(HEAD)), role_n, np.full(n, len(MIDDLE)), text_n, np.full(n, len(TAIL))], axis=1)
    ends = np.cumsum(sizes.ravel())
    at = (ends - sizes.ravel()).reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, part in zip((0, 2, 4), fixed):
        out[(at[:, k, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    out[spread(at[:, 1], role_n)] = role_buf
    out[spread(at[:, 3], text_n)] = text_buf
    offs = np.concatenate([at[:, 0], [len(out)]]).astype(np.int64)
    begin = len(HEAD) + code_points(role_buf, role_at) + len(MIDDLE)
    end = begin + code_points(text_buf, text_at)
    return out, offs, end + len(TAIL), begin, end


def format_conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row for each conversation: its id, n_turns (long), formatted (string) and loss (array of start and end in
    code points, the turns whose role is trained). Other columns are left out.

    Turns are formatted where they lie, before the shuffle; the shuffle then brings the turns of a conversation
    together in order and strings them up. A conversation is one output row, so its turns must fit in one task.
    """

    @arrow_udf("struct<body:binary,chars:bigint,start:bigint,stop:bigint>")
    def turns(r: pa.Array, t: pa.Array) -> pa.Array:
        out, offs, chars, begin, end = assemble(r, t)
        return pa.StructArray.from_arrays([from_bytes(out, offs), pa.array(chars, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["body", "chars", "start", "stop"])

    rows = df.select(col(conversation).alias("c"), col(turn).alias("turn"), col(role).alias("r"), col(text).alias("t"))
    rows = rows.select("c", "turn", "r", "t", turns("r", "t").alias("x"), F.coalesce(F.col("r") == trained, F.lit(False)).alias("mask"))
    # the array is sorted by turn, role and text; whatever follows them cannot decide
    part = F.struct("turn", "r", "t", F.col("x.body").alias("body"), F.col("x.chars").alias("chars"), F.col("x.start").alias("start"), F.col("x.stop").alias("stop"), "mask")
    whole = rows.groupBy("c").agg(F.array_sort(F.collect_list(part)).alias("p"))

    @arrow_udf("struct<formatted:string,loss:array<struct<start:bigint,stop:bigint>>>")
    def string_up(p: pa.Array) -> pa.Array:
        flat = p.flatten()
        offs = np.concatenate([[0], np.cumsum(pc.list_value_length(p).to_numpy(zero_copy_only=False))]).astype(np.int64)
        body, at = utf8(flat.field("body"))
        chars = flat.field("chars").to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(chars)])
        base = before[:-1] - np.repeat(before[offs[:-1]], np.diff(offs))
        mask = flat.field("mask").to_numpy(zero_copy_only=False).astype(bool)
        start = (base + flat.field("start").to_numpy(zero_copy_only=False))[mask]
        stop = (base + flat.field("stop").to_numpy(zero_copy_only=False))[mask]
        per = np.concatenate([[0], np.cumsum(mask)])[offs]
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["start", "stop"])
        loss = pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans)
        return pa.StructArray.from_arrays([from_bytes(body, at[offs], pa.string()), loss], names=["formatted", "loss"])

    done = whole.select("c", F.size("p").cast("bigint").alias("n_turns"), string_up("p").alias("s"))
    return done.select(F.col("c").alias(conversation), "n_turns", "s.formatted", "s.loss")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation; text that is not of this form is an error."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from code point {at} on")
    return turns


def read_back(formatted: Column, loss: Column) -> Column:
    """turns (array of role and text) and trained (string: the unescaped text under the loss mask), from the output alone."""

    @arrow_udf("struct<turns:array<struct<role:string,text:string>>,trained:string>")
    def read(f: pa.Array, spans: pa.Array) -> pa.Array:
        turns, trained = [], []
        for text, mask in zip(f.to_pylist(), spans.to_pylist()):
            turns.append([{"role": r, "text": t} for r, t in parse(text)])
            trained.append("".join(unescape(text[s["start"] : s["stop"]]) for s in mask))
        return pa.StructArray.from_arrays([pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(trained, pa.string())], names=["turns", "trained"])

    return read(formatted, loss)
