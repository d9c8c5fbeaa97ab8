"""Chat formatting: turns assembled byte by byte in numpy, into one buffer that is the batch's Arrow column.

Template of a turn: "### Role:\\n", the text, "\\n</turn>\\n". A marker stands at the start of its line,
never after a backslash. Inside a text, each "###" and "</turn>" that follows a run of k backslashes
(k >= 0) gets one more backslash, so no text can hold a marker and taking one backslash away again
gives the text back. A role's backslashes and line ends are written as "\\\\\\\\" and "\\\\n".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pubmetrics.llm import text as tx

OPEN, CLOSE, COLON = "### ", "\n</turn>\n", ":\n"
CONTROLS = (b"###", b"</turn>")
TURN = re.compile(r"### ((?:[^\\\n]|\\.)*):\n(.*?)\n</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(\\*(?:###|</turn>))")
FORMATTED = "key long, part int, formatted string, n_turns int, loss array<struct<start:int,length:int>>"
#: Bytes after which a conversation goes on in another row.
PART_BYTES = 1 << 26


def role_text(role: str | None) -> str:
    return (role or "").replace("\\", "\\\\").replace("\n", "\\n")


def escapes(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of one more backslash: before the run of backslashes that a control string follows."""
    at = []
    for control in CONTROLS:
        hit = np.ones(max(len(body) - len(control) + 1, 0), bool)
        for j, byte in enumerate(control):
            hit &= body[j : j + len(hit)] == byte
        found = np.flatnonzero(hit)
        ends = offsets[np.searchsorted(offsets, found, side="right")]
        at.append(found[found + len(control) <= ends])
    places = np.sort(np.concatenate(at))
    # "####" holds "###" twice: a run of # is escaped at its first only.
    places = places[~((places > 0) & (body[places - 1] == 35) & (body[places] == 35) & ~np.isin(places, offsets))] if len(places) else places
    back = body == 92
    run = np.arange(len(body) + 1)
    run[1:][back] = 0
    run = np.maximum.accumulate(run)  # after the last byte that is no backslash
    if len(places):
        begin = offsets[np.searchsorted(offsets, places, side="right") - 1]
        places = np.maximum(run[places], begin)
    return places


def assemble(column: pa.Array, roles: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch in one buffer: bytes, offsets of turns, and where each text starts and ends."""
    body, offsets = tx.utf8(column)
    heads = [f"{OPEN}{role_text(r)}{COLON}".encode() for r in roles]
    head, close = np.frombuffer(b"".join(heads), np.uint8), np.frombuffer(CLOSE.encode(), np.uint8)
    head_sizes = np.fromiter(map(len, heads), np.int64, len(heads))
    more = escapes(body, offsets)
    extra = np.bincount(np.searchsorted(offsets, more, side="right") - 1, minlength=len(heads)) if len(more) else np.zeros(len(heads), np.int64)
    text_sizes = np.diff(offsets) + extra
    ends = np.cumsum(head_sizes + text_sizes + len(close))
    begins = ends - head_sizes - text_sizes - len(close)
    out = np.full(int(ends[-1]) if len(ends) else 0, 92, np.uint8)  # what nothing is copied to are the backslashes
    out[tx.ranges(begins, head_sizes)] = head
    texts = begins + head_sizes
    shift = np.zeros(len(body) + 1, np.int64)
    np.add.at(shift, more, 1)
    shift = np.cumsum(shift)[:-1]
    first = np.concatenate([[0], np.cumsum(extra)])[:-1]
    sizes = np.diff(offsets)
    out[np.arange(len(body)) + shift + np.repeat(texts - offsets[:-1] - first, sizes)] = body
    out[tx.ranges(texts + text_sizes, np.full(len(heads), len(close)))] = np.tile(close, len(heads))
    return out, np.concatenate([begins, ends[-1:]]), texts, texts + text_sizes


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learns: str = "assistant", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per conversation: its formatted text and, in code points, the spans of the texts to learn from.

    Rows are sorted by turn, nulls first, equal turns by role and text; repeated rows stay. A null text or
    role is empty; rows with a null key are one conversation. One of more than ``part_bytes`` bytes
    goes on in further rows (``part``), cut between turns, so no task holds a whole one.
    """
    kinds = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("n_turns", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])
    limit = min(part_bytes, 1 << 20)

    def conversations(turns: pa.Table, part: int) -> pa.RecordBatch:
        """A row for each run of equal keys; the first one is that part of its conversation."""
        turns = turns.combine_chunks()
        role = turns.column("role").combine_chunks()
        out, at, starts, stops = assemble(turns.column("text").combine_chunks(), role.to_pylist())
        first = np.flatnonzero(changes(turns.column("key")))
        edges = np.append(first, turns.num_rows)
        points = np.concatenate([[0], np.cumsum(tx.code_points(out))])
        learnt = np.flatnonzero(pc.fill_null(pc.equal(role, learns), False).to_numpy(zero_copy_only=False))
        begins = points[at[edges]][np.searchsorted(first, learnt, side="right") - 1]
        spans = [pa.array(x.astype(np.int32)) for x in (points[starts[learnt]] - begins, points[stops[learnt]] - points[starts[learnt]])]
        parts = np.zeros(len(first), np.int32)
        parts[0] = part
        columns = [
            turns.column("key").combine_chunks().take(pa.array(first)),
            pa.array(parts),
            pa.StringArray.from_buffers(len(first), pa.py_buffer(at[edges].astype(np.int32)), pa.py_buffer(out)),
            pa.array(np.diff(edges).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(learnt, edges).astype(np.int32)), pa.StructArray.from_arrays(spans, ["start", "length"])),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, part, going_on = 0, 0, None  # going_on: key column of one row, of a conversation that was cut

        def number(turns: pa.Table) -> int:
            return part if going_on is not None and turns.column("key")[0] == going_on else 0

        for batch in batches:
            for piece in tx.slices(batch, "text", limit):
                held.append(piece)
                size += int(tx.utf8(piece.column("text"))[1][-1])
                if size < limit:
                    continue
                turns = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(changes(turns.column("key")))[-1])  # where the last conversation begins
                if cut:
                    yield conversations(turns.slice(0, cut), number(turns))
                    held = turns.slice(cut).to_batches()
                    size = sum(int(tx.utf8(b.column("text"))[1][-1]) for b in held)
                    part, going_on = 0, None
                if size >= part_bytes:
                    turns = pa.Table.from_batches(held)
                    now = number(turns)
                    yield conversations(turns, now)
                    part, going_on = now + 1, turns.column("key")[0]
                    held, size = [], 0
        if held:
            turns = pa.Table.from_batches(held)
            yield conversations(turns, number(turns))

    rows = turns.select(F.col(key).cast("long").alias("key"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return rows.select("key", "role", "text").mapInArrow(run, FORMATTED)


def changes(keys: pa.ChunkedArray) -> np.ndarray:
    """True at the first row and wherever a key differs from the one before; nulls are equal."""
    keys = keys.combine_chunks()
    null = keys.is_null().to_numpy(zero_copy_only=False)
    values = keys.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.ones(len(keys), bool)
    new[1:] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return new


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], found[1]), unescape(found[2])))
        at = found.end()
    return turns


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)
