"""Fill-in-middle by secondary sort: texts leave as pieces and come together again in the order of the output.

Pieces of bounded length are keyed by row and output position, dealt by row and sorted within partitions (the
DataFrame form of repartitionAndSortWithinPartitions), then stream into incremental digests: no task ever holds a
whole text after it was cut. Restoration reads the output's pieces in order, finds the marks, sorts the pieces within
the same partitions by their place in the text, and streams them once more; nothing is shuffled a second time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.llm import text as tx

MARKS = ("<P>", "<S>", "<M>")
MARK = re.compile(rb"<([PSM])>")
#: What may be the beginning of a mark that goes on in the next piece.
CUT_MARK = re.compile(rb"<[PSM]?\Z")
#: Order of the sections in the text.
PLACE = {b"P": 0, b"M": 1, b"S": 2}
CHUNK = 2048
#: Bytes of pieces after which a task hands a batch on.
BATCH_BYTES = 1 << 22
OWN = "row long, key long, n long, form string, prefix_chars long, middle_chars long"
PIECES = f"{OWN}, pos long, piece binary"
OUTPUTS = f"{PIECES}, output_sha256 string"
DONE = f"{OWN}, output_sha256 string, restored_sha256 string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
N_OWN = OWN.count(",") + 1


def arrow_schema(fields: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in fields.split(", ")])


class Rows:
    """Rows of pieces, handed on in batches of bounded bytes."""

    def __init__(self, fields: str):
        self.schema, self.rows, self.size = arrow_schema(fields), [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size + 64

    def full(self) -> bool:
        return self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def choices(key: Column, text: Column, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> dict[str, Column]:
    """Length, form and cuts of a text, from four numbers in the digest of ``seed``:key; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    n = F.char_length(text).cast("long")
    marked = text.contains(MARKS[0]) | text.contains(MARKS[1]) | text.contains(MARKS[2])
    plain = (n == 0) | marked | (h[2] % 100 >= 100 - plain_percent)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = F.least(one, two), F.greatest(one, two)
    return {
        "n": n,
        "form": F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm"),
        "prefix_chars": F.when(~plain, low),
        "middle_chars": F.when(~plain, high - low),
    }


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, **options) -> DataFrame:
    """Pieces of up to ``chunk`` code points (PIECES) of every output, not in order; an empty text is one empty piece."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "key", *(c.alias(k) for k, c in choices(F.col("key"), F.col("text"), **options).items()), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(PIECES)
        for batch in batches:
            for part in tx.slices(batch, "text"):
                for *own, text in zip(*(c.to_pylist() for c in part.columns)):
                    form, a, b = own[3], own[4] or 0, (own[4] or 0) + (own[5] or 0)
                    spans = {"P": (0, a), "M": (a, b), "S": (b, len(text))}
                    order = {"psm": "PSM", "spm": "SPM", "plain": " "}[form]
                    pos = 0
                    for section in order:
                        start, end = spans.get(section, (0, len(text)))
                        mark = f"<{section}>" if section != " " else ""
                        for at in range(start, max(end, start + 1), chunk):
                            piece = (mark + text[at : min(at + chunk, end)]).encode()
                            out.add((*own, pos, piece), len(piece))
                            pos, mark = pos + 1, ""
                            if out.full():
                                yield out.batch()
        yield out.batch()

    return rows.mapInArrow(cut, PIECES)


def ordered(found: DataFrame) -> DataFrame:
    """Pieces dealt by row, in output order."""
    return found.repartition("row").sortWithinPartitions("row", "pos")


def outputs(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, **options) -> DataFrame:
    """Every output as its pieces (OUTPUTS), all of a row in one partition and in order; the last one has the output's digest.

    A text is cut into prefix, middle and suffix by its key's digest and becomes ``<P>prefix<S>suffix<M>middle`` (psm),
    ``<S>suffix<P>prefix<M>middle`` (spm), or stays (plain): empty texts, texts that hold a mark, and ``plain_percent``
    of the others. A null text is an empty one. Rows are told apart by a number of their own, so repeated rows, ties
    and null keys stay apart and one key's rows spread over all tasks; other columns are left out. An empty table gives no row.
    """
    found = ordered(pieces(docs, text, key, chunk, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, digest = Rows(OUTPUTS), None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None:
                    new = last[0] != row[0]
                    out.add((*last, digest.hexdigest() if new else None), len(last[-1]))
                    digest = hashlib.sha256() if new else digest
                else:
                    digest = hashlib.sha256()
                digest.update(row[-1])
                last = row
                if out.full():
                    yield out.batch()
        if last is not None:
            out.add((*last, digest.hexdigest()), len(last[-1]))
        yield out.batch()

    return found.mapInArrow(run, OUTPUTS)


def sections(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int, bytes]]:
    """(row, place of the section, text) of one or more outputs' pieces in order; marks may lie across pieces, a row's last text may be empty."""
    last, place, held = None, 0, b""
    for row in rows:
        if last is not None and last[0] != row[0]:
            yield last, place, held
            held = b""
        if last is None or last[0] != row[0]:
            place = 0
        last = row
        body = held + row[7]
        held = b""
        if row[3] == "plain":
            yield row, 0, body
            continue
        at = 0
        for mark in MARK.finditer(body):
            if mark.start() > at:
                yield row, place, body[at : mark.start()]
            place, at = PLACE[mark[1]], mark.end()
        cut = CUT_MARK.search(body, at)
        end = cut.start() if cut else len(body)
        held = body[end:]
        if end > at:
            yield row, place, body[at:end]
    if last is not None:
        yield last, place, held


def restored(found: DataFrame) -> DataFrame:
    """One row per output (DONE): the digests of the output and of the text rebuilt from its pieces and form.

    ``found`` has a row's pieces in one partition and in order, as ``outputs`` leaves them; give those read from a table to
    ``ordered`` first.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(f"{OUTPUTS}, place int")
        counter = 0
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for row, at, body in sections(rows):
            out.add((*row[:N_OWN], counter, body, row[8], at), len(body))
            counter += 1
            if out.full():
                yield out.batch()
        yield out.batch()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, digest, sha = Rows(DONE), None, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or own[0] != row[0]:
                    if own is not None:
                        out.add((*own, sha, digest.hexdigest()), 256)
                    own, digest, sha = row[:N_OWN], hashlib.sha256(), None
                digest.update(row[7])
                sha = row[8] or sha
                if out.full():
                    yield out.batch()
        if own is not None:
            out.add((*own, sha, digest.hexdigest()), 256)
        yield out.batch()

    placed = found.mapInArrow(place, f"{OUTPUTS}, place int").sortWithinPartitions("row", "place", "pos")
    return placed.mapInArrow(rebuild, DONE)
