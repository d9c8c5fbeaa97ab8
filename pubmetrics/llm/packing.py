"""Cost-balanced packing: descending pieces go to the sequence of the lowest attention cost that has room."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pubmetrics.llm import text as tx
from pubmetrics.llm.vocab import KEPT_BYTES, encoder, with_end

PIECES = "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Rests of documents that a task packs together: at most so many, bounding its memory.
WINDOW = 40_000
#: Pieces of documents that leave a task at once.
ROWS_OUT = 1000


class Rooms:
    """Sequences by their free tokens: the lowest cost among those with at least so many free."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.best: list[tuple[float, int, int]] = [(float("inf"), -1, -1)] * (2 * self.size)

    def update(self, free: int) -> None:
        heap = self.heaps[free]
        i = free + self.size
        self.best[i] = (*heap[0], free) if heap else (float("inf"), -1, -1)
        while i > 1:
            i >>= 1
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])

    def add(self, cost: float, sequence: int, free: int) -> None:
        heapq.heappush(self.heaps[free], (cost, sequence))
        self.update(free)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, free) of the lowest cost with ``least`` free or more."""
        found, lo, hi = (float("inf"), -1, -1), least + self.size, 2 * self.size
        while lo < hi:
            if lo & 1:
                found = min(found, self.best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                found = min(found, self.best[hi])
            lo >>= 1
            hi >>= 1
        if found[1] < 0:
            return None
        heapq.heappop(self.heaps[found[2]])
        self.update(found[2])
        return found

    def largest(self) -> int:
        """The most free tokens of any sequence."""
        i = 1
        while i < self.size:
            i = 2 * i + (self.best[2 * i + 1][1] >= 0)
        return i - self.size


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (piece, cut, length, sequence, offset) of pieces shorter than ``capacity``, and the number of sequences.

    There are as few sequences as hold all tokens. Pieces descend by length, so by cost; each goes to the
    sequence of the lowest cost with room for it. Where none has room, it is cut at the largest room
    and its rest takes its place in the descending order. Ties go to the first piece and sequence.
    """
    total = sum(lengths)
    n = -(-total // capacity)
    rooms = Rooms(capacity)
    for s in range(n):
        rooms.heaps[capacity].append((0.0, s))
    rooms.update(capacity)
    waiting = [(-size, i, 0) for i, size in enumerate(lengths)]
    heapq.heapify(waiting)
    rows = []
    while waiting:
        size, piece, cut = heapq.heappop(waiting)
        size = -size
        found = rooms.take(size)
        if found is None:
            part = rooms.largest()
            found = rooms.take(part)
            heapq.heappush(waiting, (part - size, piece, cut + part))
            size = part
        cost, sequence, free = found
        rows.append((piece, cut, size, sequence, capacity - free))
        if free > size:
            rooms.add(cost + linear * size + quadratic * size * size, sequence, free - size)
    return rows, n


def narrow(ids: np.ndarray) -> np.ndarray:
    """A copy of ids in two bytes each if all fit."""
    return ids.astype(np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32)


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    end: int | None = 0,
    capacity: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    drops_space: bool = False,
    window: int = WINDOW,
    kept: int = KEPT_BYTES,
) -> DataFrame:
    """Encode whole texts, append ``end`` and pack them; a row per piece with its ids (u32, little-endian).

    A document's full sequences are cut off first; the rests of up to ``window`` documents of a task
    are packed together by ``assign``, which leaves less than one sequence free for all of them. A
    sequence's cost is the sum of linear * length + quadratic * length ** 2 over its pieces, as
    attention stays inside a piece. Nothing is shuffled: numbers of sequences start anew in
    each task's own range. A null text is empty; one without any id gives no piece. Repeated rows are
    packed again each. ``kept``: bytes of known pieces that a worker holds; fewer take more time.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer, drops_space, kept), TaskContext.get().partitionId() << 40
        rests: list[tuple] = []

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + ROWS_OUT]), kinds)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, rests
            rows, n = assign([len(r[2]) for r in rests], capacity, linear, quadratic)
            held, first = rests, base
            base, rests = base + n, []
            # Bytes of pieces are made as they leave, not for all rests at once.
            for at in range(0, len(rows), ROWS_OUT):
                some = rows[at : at + ROWS_OUT]
                yield from out([(held[p][0], held[p][1] + cut, size, held[p][2][cut : cut + size].astype(np.uint32).tobytes(), held[p][3], first + s, offset) for p, cut, size, s, offset in some])

        for batch in batches:
            for part in tx.slices(batch, "text", 1 << 20):
                ids, offsets = enc.encode(part.column("text"))
                if end is not None:
                    ids, offsets = with_end(ids, offsets, end)
                full = []
                for k, a, b in zip(part.column("key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    whole = (b - a) // capacity * capacity
                    for at in range(a, a + whole, capacity):
                        full.append((k, at - a, capacity, ids[at : at + capacity].tobytes(), b - a, base, 0))
                        base += 1
                    if a + whole < b:
                        rests.append((k, whole, narrow(ids[a + whole : b]), b - a))
                yield from out(full)
                if len(rests) >= window:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, PIECES)
