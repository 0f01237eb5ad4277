"""Chat formatting by columnar byte assembly.

A conversation becomes ``<|im_start|>role\\n text <|im_end|>\\n`` for each turn. Inside roles
and texts a control string's ``<|`` gets a backslash, ``<\\|``; backslashes already there get
one more, so the change can be undone whatever a text holds. A line break ends a role, so
inside roles it is written ``\\n``, and a backslash twice.

For each batch of turns the headers, roles, contents and ends are segments: their lengths
give cumulative offsets, the offsets scatter indices, and all bytes are copied into one
preallocated buffer, which becomes the Arrow column. Offsets inside the conversation run on
from batch to batch, so a conversation of any length streams through with bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import batch_of, ragged, schema, utf8

START, END = b"<|im_start|>", b"<|im_end|>"
BREAK, CLOSE = b"\n", b"<|im_end|>\n"
#: Roles whose text is trained on.
LEARNED = ("assistant",)
TURNS = schema("conv_id bigint, position bigint, formatted string, start_char bigint, loss_start bigint, loss_stop bigint")
DIGESTS = schema("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
SLICE = 1 << 22


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(escape(column), "\\", "\\\\"), "\n", "\\n")


def unescape_role(text: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


def characters(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of each UTF-8 string."""
    ends = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return np.diff(ends[at])


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns as one Arrow array; characters before, in and of each content."""
    n = len(roles)
    columns = [utf8(c) for c in (roles, texts)]
    (role, role_at), (text, text_at) = columns
    marks = np.frombuffer(START + BREAK + CLOSE, np.uint8)
    cuts = np.cumsum([0, len(START), len(BREAK), len(CLOSE)])
    # segments of a turn: start mark, role, break, text, close mark
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(START), len(BREAK), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    place = offsets[:-1].reshape(n, 5)
    out = np.empty(offsets[-1], np.uint8)
    for k, mark in ((0, 0), (2, 1), (4, 2)):
        piece = marks[cuts[mark]:cuts[mark + 1]]
        out[(place[:, k, None] + np.arange(len(piece))).ravel()] = np.tile(piece, n)
    out[ragged(place[:, 1], lengths[:, 1])] = role
    out[ragged(place[:, 3], lengths[:, 3])] = text
    ends = np.append(place[:, 0], offsets[-1])
    kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    column = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(out)])
    before = len(START) + characters(role, role_at) + len(BREAK)
    inside = characters(text, text_at)
    return column, before, inside, before + inside + len(CLOSE)


def _format(learned: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, turns = None, 0, 0
        for whole in batches:
            _, at = utf8(whole.column("text"))
            group = at[:-1] // SLICE
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                conv = batch.column("conv").to_numpy()
                role = batch.column("role").fill_null("")
                column, before, inside, size = assemble(escape_role(role), escape(batch.column("text").fill_null("")))
                new = np.ones(len(conv), bool)
                new[1:] = conv[1:] != conv[:-1]
                new[0] = last is None or conv[0] != last
                total = np.cumsum(size) - size
                head = np.flatnonzero(new)
                which = np.cumsum(new) - 1
                index = np.arange(len(conv))
                start = np.where(which >= 0, total - total[head][which] if len(head) else 0, total + done)
                position = np.where(which >= 0, index - head[which] if len(head) else 0, index + turns)
                last, done, turns = conv[-1], int(start[-1] + size[-1]), int(position[-1] + 1)
                mask = pc.is_in(role, pa.array(learned, pa.string())).to_numpy(zero_copy_only=False)
                none = pa.array(~mask)
                yield batch_of(TURNS, batch.column("conv_id"), position, column.cast(pa.string()), start,
                               pc.if_else(none, None, pa.array(start + before)), pc.if_else(none, None, pa.array(start + before + inside)))
    return run


def format_turns(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text), in order inside partitions.

    conv_id, position (from 0), formatted, start_char (characters of the conversation before
    it), loss_start and loss_stop (the trained span in the conversation's characters, or
    null). Rows are ordered by turn, then role and text; repeated rows stay. Null texts and
    roles are empty, null ids are one conversation, null turns come first. One conversation
    is in one task, where it streams; other columns are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("conv"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(_format(learned), TURNS)


def conversation(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string; its control strings are its only ones."""
    out = []
    for part in formatted.split(START.decode())[1:]:
        body, end, rest = part.partition(CLOSE.decode())
        role, line, text = body.partition("\n")
        if not (end and line) or rest:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(role), unescape(text)))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, state = [], None

    def close():
        conv, n, turns, chars, loss, size = state
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for r in batch.to_pylist():
            if r["position"] == 0:
                if state:
                    close()
                state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted = r["formatted"]
            for role, text in conversation(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            if r["loss_start"] is not None:
                a = r["loss_start"] - r["start_char"]
                learned = unescape(formatted[a:a + r["loss_stop"] - r["loss_start"]])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(formatted)
        if len(rows) >= 5000:
            yield batch_of(DIGESTS, *map(list, zip(*rows)))
            rows.clear()
    if state:
        close()
    if rows:
        yield batch_of(DIGESTS, *map(list, zip(*rows)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation of ``format_turns``: digests of what its formatted turns hold.

    Reads the partitions as ``format_turns`` left them, so nothing is shuffled again.
    """
    return formatted.mapInArrow(_digest, DIGESTS)
