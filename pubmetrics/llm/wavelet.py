"""Token ids as wavelet matrices: one compressed file per shard, with access, rank and select.

File: b"WVMX", a little-endian u32 header length, a JSON header, then sections. Each bit plane of
the ids, from the highest bit down, is cut into pages of PAGE bits, compressed one by one; the
header has each page's place and the ones before it. Ids of a plane are ordered as in a wavelet
matrix: zeros of the plane above first, in order, then ones. Document ids and first tokens are two
more sections.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from pubmetrics.llm import text as tx
from pubmetrics.llm.store import put, shared_folder, stored
from pubmetrics.llm.vocab import encoder, with_end

MAGIC = b"WVMX"
PAGE = 1 << 18
SHARD_TOKENS = 1 << 22
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


def encode(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """File bytes of one shard; ``starts`` has a first token for each document, in order."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    sections: list[bytes] = []
    header = {"n": len(ids), "bits": bits, "page": PAGE, "planes": []}
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits - 1, -1, -1):
        pages, ones, total = [], [], 0
        below: tuple[list, list] = [x[:0]], []
        for at in range(0, len(x), PAGE):
            part = x[at : at + PAGE]
            page = part & x.dtype.type(1 << b) != 0
            pages.append(len(sections))
            ones.append(total)
            # By places: a mask of random bits takes three times as long.
            below[0].append(part[np.flatnonzero(~page)])
            below[1].append(part[np.flatnonzero(page)])
            total += len(below[1][-1])
            sections.append(pack(np.packbits(page, bitorder="little").tobytes()))
        header["planes"].append({"pages": pages, "ones": ones, "zeros": len(x) - total})
        x = np.concatenate(below[0] + below[1])
    header["docs"] = len(doc_ids)
    sections += [pack(json.dumps(doc_ids).encode()), pack(np.asarray(starts, np.int64).tobytes())]
    header["places"] = np.concatenate([[0], np.cumsum([len(s) for s in sections])]).tolist()
    head = json.dumps(header).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(sections)


class Shard:
    """Reads one file's bytes; pages are decompressed when first needed."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = struct.unpack("<I", data[4:8])[0]
        self.h = json.loads(data[8 : 8 + size])
        self.body = memoryview(data)[8 + size :]
        self.n, self.bits = self.h["n"], self.h["bits"]
        self.pages: dict[int, np.ndarray] = {}
        last = len(self.h["places"]) - 3
        self.doc_ids = json.loads(self.section(last))
        self.starts = np.frombuffer(self.section(last + 1), np.int64)

    def section(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.body[self.h["places"][i] : self.h["places"][i + 1]])

    def page(self, plane: int, p: int) -> np.ndarray:
        i = self.h["planes"][plane]["pages"][p]
        if i not in self.pages:
            self.pages[i] = np.frombuffer(self.section(i), np.uint8)
        return self.pages[i]

    def bit(self, plane: int, i: int) -> int:
        return int(self.page(plane, i // PAGE)[i % PAGE >> 3] >> (i & 7) & 1)

    def ones(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        p, rest = divmod(i, PAGE)
        known = self.h["planes"][plane]
        if p == len(known["pages"]):
            return self.n - known["zeros"]
        page = self.page(plane, p)
        total = known["ones"][p] + int(np.bitwise_count(page[: rest >> 3]).sum())
        return total + (int(page[rest >> 3] & (1 << (rest & 7)) - 1).bit_count() if rest & 7 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, known in enumerate(self.h["planes"]):
            one = self.bit(p, i)
            before = self.ones(p, i)
            value = value << 1 | one
            i = known["zeros"] + before if one else i - before
        return value

    def span(self, token: int, i: int) -> tuple[int, int]:
        """Where copies of the token start below the last plane, and how many stand before place i."""
        lo, hi = 0, i
        if token >> self.bits:
            return 0, 0
        for p, known in enumerate(self.h["planes"]):
            a, b = self.ones(p, lo), self.ones(p, hi)
            lo, hi = (known["zeros"] + a, known["zeros"] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi - lo

    def rank(self, token: int, i: int) -> int:
        """Copies of the token before place i."""
        return self.span(token, i)[1]

    def count(self, token: int, lo: int, hi: int) -> int:
        return self.rank(token, hi) - self.rank(token, lo)

    def select(self, token: int, k: int) -> int:
        """Place of the token's copy number k, from 0."""
        lo, copies = self.span(token, self.n)
        if not 0 <= k < copies:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            zeros = self.h["planes"][p]["zeros"]
            one = token >> (self.bits - 1 - p) & 1
            want, left, right = (i - zeros if one else i) + 1, 0, self.n
            while left < right:  # the shortest prefix with so many ones or zeros
                mid = (left + right) // 2
                ones = self.ones(p, mid)
                if (ones if one else mid - ones) < want:
                    left = mid + 1
                else:
                    right = mid
            i = left - 1
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token, self.n))]

    def ids(self) -> np.ndarray:
        """All ids in order."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            known = self.h["planes"][p]
            x[known["zeros"] :] |= x.dtype.type(1 << (self.bits - 1 - p))
            above = np.empty_like(x)
            for i, before in enumerate(known["ones"]):
                part = above[i * PAGE : (i + 1) * PAGE]
                bit = np.unpackbits(self.page(p, i), count=len(part), bitorder="little").view(bool)
                zero, one = np.flatnonzero(~bit), np.flatnonzero(bit)
                part[zero] = x[i * PAGE - before :][: len(zero)]
                part[one] = x[known["zeros"] + before :][: len(one)]
            x = above
            for i in known["pages"]:
                self.pages.pop(i, None)
        return x.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", key: str = "doc_id", end: int | None = 1, drops_space: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts, append ``end``, and write shard files in ascending key order; a row per file.

    Rows are dealt out by key range and sorted; a task writes a new file whenever it has
    ``shard_tokens`` ids, so memory is bounded by that and one document. A null text has the end id
    only, a null key comes first, equal keys are ordered by text. An empty table gives no file.
    Files get their names when complete, so a repeated task only writes the same file again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context, files = encoder(tokenizer, drops_space), TaskContext.get(), 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal files, held, doc_ids, counts
            shard = context.partitionId() << 32 | files
            starts = np.cumsum([0, *counts])
            data = encode(np.concatenate(held) if held else np.zeros(0, np.uint32), doc_ids, starts[:-1])
            path = put(folder, f"{shard:016x}.wvmx", data, str(context.taskAttemptId()))
            row = {"shard": shard, "path": path, "n_docs": len(doc_ids), "n_tokens": int(starts[-1]), "n_bytes": len(data)}
            files, held, doc_ids, counts = files + 1, [], [], []
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for part in tx.slices(batch, "text", 1 << 21):
                ids, offsets = enc.encode(part.column("text"))
                if end is not None:
                    ids, offsets = with_end(ids, offsets, end)
                held.append(ids)
                doc_ids += part.column("key").to_pylist()
                counts += np.diff(offsets).tolist()
                if sum(map(len, held)) >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return stored(rows.mapInArrow(write, MANIFEST), "wavelet-manifest")


def read_shards(manifest: DataFrame, folder: str, visit, schema: str) -> DataFrame:
    """``visit(shard number, Shard)`` of every file, which yields record batches of ``schema``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from visit(int(path.as_py().rpartition("/")[2].split(".")[0], 16), Shard(content.as_py()))

    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvmx").load(folder)
    return files.select("path", "content").mapInArrow(read, schema)


def document_ids(manifest: DataFrame, folder: str, key_type: str = "long") -> DataFrame:
    """Per document, read back: key, start (ids of all documents before it), n_tokens, ids (u32, little-endian)."""
    schema = f"shard long, key {key_type}, local long, n_tokens long, ids binary"
    kinds = [pa.int64(), pa.string() if key_type == "string" else pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def visit(shard: int, file: Shard) -> Iterator[pa.RecordBatch]:
        ids = file.ids()
        ends = np.append(file.starts[1:], len(ids))
        for at in range(0, len(ends), 2000):
            s, e = file.starts[at : at + 2000], ends[at : at + 2000]
            blobs = [ids[a:b].tobytes() for a, b in zip(s, e)]
            columns = [[shard] * len(s), file.doc_ids[at : at + 2000], s, e - s, blobs]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

    found = read_shards(manifest, folder, visit, schema)
    # One row per file: a running sum over the manifest, not over documents.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(bases, "shard").select("key", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def new_folder(spark, name: str = "wavelet") -> str:
    return shared_folder(spark, name)


def ids_crc32(ids: Column) -> Column:
    return F.crc32(ids)
