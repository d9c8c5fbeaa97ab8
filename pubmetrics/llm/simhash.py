"""SimHash fingerprints, and all pairs of fingerprints within a Hamming radius by block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pubmetrics.llm import text as tx

SHINGLE = 5
#: Terms whose votes are held at once, of long texts or of many.
PART_TERMS = 1 << 15
NEIGHBOURS = "key long, n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, next_fingerprint long"


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: every occurrence of a word shingle votes, with the number of its bytes, on each bit.

    Bit b is 1 where the signed votes of all terms' hashes are above 0. A text of fewer words is one term; one
    without words, or null, has fingerprint 0. Equal texts have equal fingerprints.
    """
    body, offsets = tx.utf8(column)
    starts, ends, first = tx.words(body, offsets)
    hashes = tx.span_hashes(body, starts, ends)
    weights = (ends - starts).astype(np.float32)
    short = np.flatnonzero((np.diff(first) < shingle) & (np.diff(first) > 0))
    terms, term_first = tx.windows(hashes, first, shingle)
    at = tx.ranges(first[:-1], np.diff(term_first))
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.float64)])
    weight = (sums[at + shingle] - sums[at]).astype(np.float32) if len(at) else np.zeros(0, np.float32)
    votes = np.zeros((len(column), 64), np.float64)
    for lo in range(0, len(terms), PART_TERMS):  # some hundred bytes for each term
        hi = min(lo + PART_TERMS, len(terms))
        bits = np.unpackbits(terms[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        signed = (bits.astype(np.float32) * 2 - 1) * weight[lo:hi, None]
        a, b = np.searchsorted(term_first, [lo, hi], side="right") + [-1, 0]
        b = min(b, len(column))
        votes[a:b] += tx.segment_sums(signed, np.clip(term_first[a : b + 1], lo, hi) - lo)
    for i in short:
        whole = np.array([first[i + 1] - first[i]], np.uint64)
        for h in hashes[first[i] : first[i + 1]]:  # in order, as jaccard.shingle_sets
            whole = tx.mixed(whole * np.uint64(tx.STEP) + h)
        votes[i] = np.unpackbits(whole.view(np.uint8), bitorder="little").astype(float) * 2 - 1
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def likeness(a, b):
    """1 - Hamming distance / 64 of two fingerprint columns."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def as_hex(column):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def with_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text by descending key.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    text (all of it if shorter); after the last text comes the first. Rows are dealt out by key range at
    approximate quantiles; the highest row of each range is copied to the range above it, whose last
    row it follows, so each text is shuffled once. Null keys come last, equal keys are ordered by text;
    a null text is an empty one; a single row follows itself.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.agg(F.expr(f"percentile_approx(key, array({', '.join(str(i / n) for i in range(1, n + 1))}), {50 * n})").alias("q"), F.max("key").alias("top")).first()
    # At most as many numbers as partitions.
    bounds = np.array(sorted({*(found["q"] or []), *([found["top"]] if found["top"] is not None else [])}), np.int64)
    dealt_schema = "part int, guest boolean, key long, text string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, keys)
            heads = np.flatnonzero(np.isin(keys, bounds)) if len(bounds) else np.arange(len(keys))
            rows = np.concatenate([np.arange(len(keys)), heads])
            to = np.concatenate([part, (part[heads] + 1) % max(len(bounds), 1)]).astype(np.int32)
            guest = np.arange(len(rows)) >= len(keys)
            taken = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guest), taken.column("key"), taken.column("text")], ["part", "guest", "key", "text"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in NEIGHBOURS.split(", ")]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: part, key, text, fingerprint
        done = None  # the part whose guest has come
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                prints = fingerprints(piece.column("text"), shingle)
                pairs, edited = [], []
                for part, guest, k, t, p in zip(*(piece.column(c).to_pylist() for c in ("part", "guest", "key", "text")), prints):
                    if held is not None and held[0] == part and done != part:
                        half = len(held[2]) // 2
                        edited.append(held[2][: len(held[2]) - half] + t[:half])
                        pairs.append((held[1], len(held[2]), held[3], p))
                    if guest:
                        done, held = part, None
                    else:
                        held = (part, k, t, p)
                shas = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
                changed = fingerprints(pa.array(edited, pa.string()), shingle)
                if pairs:
                    k, n_chars, own, nxt = zip(*pairs)
                    own, nxt = (np.array(x, np.uint64).view(np.int64) for x in (own, nxt))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((k, n_chars, shas, own, changed.view(np.int64), nxt), kinds)], names)

    dealt = rows.mapInArrow(deal, dealt_schema)
    # Each part is a partition of its own.
    placed = dealt.repartitionById(n, "part").sortWithinPartitions("part", "guest", F.col("key").desc_nulls_last(), "text")
    return placed.mapInArrow(follow, NEIGHBOURS)


def tables(radius: int, blocks: int) -> list[int]:
    """Masks of the permuted tables: any fingerprints within the radius agree on one of them."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below the number of blocks")
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts[:-1], cuts[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def dealt_cells(found: DataFrame, queries: DataFrame, masks: list[int], block_rows: int) -> DataFrame:
    """Rows (t, cell, p, q, fingerprint, n, least, asks) of distinct fingerprints under the bits of each mask, where one asks.

    Those searched stand in one part p of their cell and all q, those that ask in one q and all p; each p and q has about ``block_rows``.
    """
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    least = F.min("key") if "key" in found.columns else F.lit(None).cast("long")
    counted = found.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("n"), least.alias("least"))
    asked = queries.where("fingerprint IS NOT NULL").select("fingerprint").distinct().withColumn("asked", F.lit(True))
    both = counted.join(asked, "fingerprint", "full").select("fingerprint", F.coalesce("n", F.lit(0)).alias("n"), "least", F.coalesce("asked", F.lit(False)).alias("asked"))
    cells = F.posexplode(F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.col("fingerprint").bitwiseAND(m)))
    rows = both.select("fingerprint", "n", "least", "asked", cells.alias("t", "cell"))
    sizes = rows.groupBy("t", "cell").agg(F.count("*").alias("m"), F.sum(F.col("asked").cast("int")).alias("k")).where("m > 1 AND k > 0")
    rows = rows.join(sizes, ["t", "cell"]).withColumns({c: F.ceil(F.col(x) / block_rows).cast("int") for c, x in (("ps", "m"), ("qs", "k"))})
    own = lambda n: F.pmod(F.xxhash64("fingerprint"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = rows.select("t", "cell", own("ps").alias("p"), every("qs").alias("q"), "fingerprint", "n", "least", F.lit(False).alias("asks"))
    there = rows.where("asked").select("t", "cell", every("ps").alias("p"), own("qs").alias("q"), "fingerprint", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("least"), F.lit(True).alias("asks"))
    return here.unionByName(there).repartition("t", "cell", "p", "q").sortWithinPartitions("t", "cell", "p", "q", F.col("asks").desc())


def hits(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[tuple]:
    """(fingerprint, n, least, those asking within the radius but not equal) of dealt cells; a pair in the first table that has it."""
    cell, asking, ask = None, [], None
    for b in batches:
        for t, c, p, q, f, n, least, asks in zip(*(b.column(x).to_pylist() for x in ("t", "cell", "p", "q", "fingerprint", "n", "least", "asks"))):
            if (t, c, p, q) != cell:
                cell, asking, ask = (t, c, p, q), [], None
            if asks:
                asking.append(f)
                continue
            if ask is None:
                ask = np.array(asking, np.int64).view(np.uint64)
            apart = ask ^ np.int64(f).view(np.uint64)
            near = (np.bitwise_count(apart) <= radius) & (apart != 0)
            for m in masks[:t]:
                near &= (apart & np.uint64(m)) != 0
            if n and near.any():
                yield f, n, least, ask[near].view(np.int64).tolist()


def near_pairs(found: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6, block_rows: int = 4096) -> DataFrame:
    """(fingerprint, near): every ``fingerprint`` of queries with each other one of ``found`` within the radius, once."""
    masks = tables(radius, blocks)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, list] = ([], [])
        for f, _, _, ask in hits(batches, masks, radius):
            rows[0].extend(ask)
            rows[1].extend([f] * len(ask))
            if len(rows[0]) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["fingerprint", "near"])
                rows = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["fingerprint", "near"])

    return dealt_cells(found, queries, masks, block_rows).mapInArrow(pairs, "fingerprint long, near long")


def near_counts(found: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6, block_rows: int = 4096) -> DataFrame:
    """For each distinct ``fingerprint`` of queries: rows of ``found`` within the radius, itself included, and their least ``key``, if there is one.

    Fingerprints are counted first, so copies are one row. Both sides go to every table under the bits
    of its mask; a pair counts in the first table on which it agrees. A table cell with many
    fingerprints, or many that ask, is dealt over several tasks. No pair is written. Nulls are left out.
    """
    masks = tables(radius, blocks)
    kinds = pa.schema([(c, pa.int64()) for c in ("fingerprint", "near", "least")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple] = {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"fingerprint": f, "near": n, "least": k} for f, (n, k) in sums.items()], kinds)

        for _, n, least, ask in hits(batches, masks, radius):
            for f in ask:
                m, k = sums.get(f, (0, None))
                sums[f] = (m + n, least if k is None else k if least is None else min(k, least))
            if len(sums) >= 1 << 16:
                yield done()
                sums.clear()
        yield done()

    parts = dealt_cells(found, queries, masks, block_rows).mapInArrow(count, "fingerprint long, near long, least long")
    least = F.min("key") if "key" in found.columns else F.lit(None).cast("long")
    asked = queries.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    own = found.join(asked, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.count("*").alias("near"), least.alias("least"))
    none = asked.select("fingerprint", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("least"))
    return parts.unionByName(own).unionByName(none).groupBy("fingerprint").agg(F.sum("near").alias("near"), F.min("least").alias("least"))
