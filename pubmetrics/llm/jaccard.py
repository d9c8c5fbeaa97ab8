"""Jaccard join of documents on word shingles, size-aware: heavy sets by inverted lists, light ones by subsets.

A document is the set of its distinct word shingles, as 40-bit hashes in one order for all documents: rare
ones first. Two sets of enough overlap share at least one of the first floor((1 - t) n) + 1 shingles of each,
and at least two of the first floor((1 - t) n) + 2. Heavy sets therefore meet in the inverted lists of
single shingles, light sets in those of 2-subsets, which are many but select far better; the boundary
is where the estimated costs cross. Equal sets are one class before anything else.

Each list is parted into bands of size, and rows that no other one matches in size leave it. Candidates pass exact bounds (sizes, the differences of a coarse and then a finer histogram) before
their whole sets are read and compared. Lists that are long even so are compared in blocks, by histograms only,
which write as many of the possible pairs as join their rows. Rows joined by these pairs that are still in different components
once the pairs are tested are compared by whole sets, which write only links that join components. So a
group of many copies is not expanded into all pairs, whole sets are moved for few rows of long lists, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from pubmetrics.llm import text as tx
from pubmetrics.llm.store import BLOBS, blob_rows, counted, stored, summed_blobs

TOKEN_BITS = 40
SKETCH_BITS = 20
CELLS = 32
#: Lists up to this length are compared at once, longer ones in blocks.
SHORT_LIST = 8
BLOCK_ROWS = 4096
#: Bytes of whole sets in a block, where that is fewer rows; a longer set is a block's only one or nearly so.
BLOCK_BYTES = 1 << 23
SHINGLE_BYTES = TOKEN_BITS // 8
#: Hashes of other sets that one set is compared with at once.
TESTED_AT_ONCE = 1 << 20
U = np.uint64
PAIRS = "a long, b long, apart int, shared int"
LINKS = "a long, b long"
#: What names the rows a class is read from: its smallest key (0 where all are null) and its set.
OWN = ["doc", "nameless", "n", "s1", "s2"]


def needed(total, percent: int):
    """Least overlap of two sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


def prefix(n, percent: int, share: int):
    """How many of n shingles in order hold ``share`` common ones of any two similar sets."""
    return np.minimum(n, n + (-percent * n // 100) + share)


def shares(n, light: int):
    """How many lists a set of n shingles must share with a similar one as large: more for large sets, one for light ones."""
    return np.where(n > light, 1 + n // 50, 1)


def shingle_sets(column: pa.Array, shingle: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (40 bits) of each text and offsets; in order of level, if given, and hash.

    A text of fewer words is one shingle, one without words or null has none. A-Z are lowered.
    """
    body, offsets = tx.utf8(column)
    body = tx.LOWER[body]
    starts, ends, first = tx.words(body, offsets)
    hashes = tx.span_hashes(body, starts, ends)
    grams, gram_first = tx.windows(hashes, first, shingle)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    owner = np.repeat(np.arange(len(counts)), np.diff(gram_first))
    if len(short):
        whole = []
        for i in short:
            total = U(int(counts[i]))
            for h in hashes[first[i] : first[i + 1]]:
                total = tx.mixed(np.array([total], U) * U(tx.STEP) + h)[0]
            whole.append(total)
        grams, owner = np.concatenate([grams, np.array(whole, U)]), np.concatenate([owner, short])
    # One sort of text, level and as many hash bits as fit: at least 40, and enough that no two meet by chance.
    text_bits = max(int(len(counts)).bit_length(), 1)
    hash_bits = min(60 - text_bits, 52)
    level = (levels[grams >> U(64 - SKETCH_BITS)] if levels is not None else np.zeros(len(grams), np.uint8)).astype(U)
    key = (owner.astype(U) << U(64 - text_bits)) | (level << U(hash_bits)) | (grams >> U(64 - hash_bits))
    key = tx.distinct(key)
    at = np.searchsorted(key >> U(64 - text_bits), np.arange(len(counts) + 1, dtype=U))
    return (key & U((1 << hash_bits) - 1)) >> U(hash_bits - TOKEN_BITS), at


def set_sums(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes per set, whatever the order of its shingles: with the size they name a class."""
    rolled = [np.concatenate([np.zeros(1, U), np.cumsum(tx.mixed(tokens + U(c)), dtype=U)]) for c in (1, 1 << 50)]
    return [(r[at[1:]] - r[at[:-1]]).view(np.int64) for r in rolled]


def own_columns(keys: pa.Array, tokens: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """The columns of OWN."""
    return [keys.fill_null(0), keys.is_null(), pa.array(np.diff(at).astype(np.int32)), *map(pa.array, set_sums(tokens, at))]


def histogram(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit words per set: 32 cells of token counts, modulo 16."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(owner * CELLS + (tokens & U(CELLS - 1)).astype(np.int64), minlength=n * CELLS).reshape(n, 2, 16)
    return np.bitwise_or.reduce((counts & 15).astype(U) << (U(4) * np.arange(16, dtype=U)), axis=2)


def fine_histogram(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Token counts modulo 4, four cells to a byte: 256 cells or, for large sets, the power of two of half their size."""
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        cells = max(256, 1 << ((b - a) // 2).bit_length())
        counts = np.bincount((tokens[a:b] & U(cells - 1)).astype(np.int64), minlength=cells).reshape(4, -1) & 3
        out.append((counts[0] | counts[1] << 2 | counts[2] << 4 | counts[3] << 6).astype(np.uint8).tobytes())
    return out


def fine_apart(x: bytes, y: bytes) -> int:
    """Elements in which two sets differ at least, by their fine histograms; the longer one is folded."""
    cells = []
    for blob in (x, y):
        packed = np.frombuffer(blob, np.uint8)
        cells.append(np.concatenate([packed >> s & 3 for s in (0, 2, 4, 6)]))
    least = min(map(len, cells))
    p, q = (c.reshape(-1, least).sum(axis=0, dtype=np.uint8) for c in cells)
    apart = (p - q) & np.uint8(3)
    return int(np.minimum(apart, np.uint8(4) - apart).sum(dtype=np.int64))


def nibbles(words: np.ndarray) -> np.ndarray:
    return ((words[..., None] >> (U(4) * np.arange(16, dtype=U))) & U(15)).astype(np.uint8)


def possible(n1, h1, n2, h2, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may be similar, and for each a number of elements in which they differ at least.

    Others cannot be: their sizes or histograms differ too much.
    """
    total = n1 + n2
    room = total - 2 * needed(total, percent)
    at = np.flatnonzero(np.abs(n1 - n2) <= room)
    apart = np.zeros(len(at), np.int64)
    for w in range(2):
        d = (nibbles(h1[at, w]) - nibbles(h2[at, w])) & np.uint8(15)
        apart += np.minimum(d, np.uint8(16) - d).sum(axis=1, dtype=np.int64)
    ok = apart <= room[at]
    return at[ok], apart[ok]


def scanned(docs: DataFrame, shingle: int, carry: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """One pass over the texts: (key, n, s1, s2, h1, h2, fine) and ``carry`` of every document, count blobs of shingle hashes, and how many rows that are."""
    carried = StructType([StructField(f.name, f.dataType) for f in docs.select(*carry).schema])
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), *((c, pa.int64()) for c in ("s1", "s2", "h1", "h2")), ("fine", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary()), *to_arrow_schema(carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in tx.slices(batch, "text"):
                tokens, at = shingle_sets(part.column("text"), shingle)
                bins = (tokens >> U(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)
                np.add.at(counts, bins, 1)
                s1, s2 = set_sums(tokens, at)
                hist = histogram(tokens, at).view(np.int64)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(at).astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(hist[:, 0]), pa.array(hist[:, 1]), pa.array(fine_histogram(tokens, at), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *map(part.column, carry)], schema=schema)
        rows = [{"piece": i, "counts": c} for _, i, c in blob_rows(None, counts, 16)] if counts.any() else []
        yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = StructType(StructType.fromDDL("key long, n int, s1 long, s2 long, h1 long, h2 long, fine binary, piece int, counts binary").fields + carried.fields)
    rows, seen = counted(docs.mapInArrow(run, kinds), "jaccard-scan")
    return rows.where("piece IS NULL").select("key", "n", "s1", "s2", "h1", "h2", "fine", *carry), rows.where("piece IS NOT NULL").select(F.lit(None).cast("string").alias("name"), "piece", "counts"), seen["n"]


def shingle_levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """A level for each hash bin, 0 for what is no more frequent than chance, and the length of a usual inverted list."""
    load = counts.sum() / len(counts)
    over = counts - (load + 4 * np.sqrt(load) + 1)
    levels = np.where(over > 0, np.minimum(15, 1 + np.log2(np.maximum(over, 1)).astype(np.int64)), 0).astype(np.uint8)
    order = np.sort(counts)
    reached = np.cumsum(order)
    middle = order[np.searchsorted(reached, reached[-1] / 2)] if reached[-1] else 0
    return levels, max(1.0, middle - load + 1)


def boundary(usual_list: float, percent: int) -> int:
    """The largest size up to which a set's 2-subsets cost no more than its shingles with their lists."""
    size = 1
    while True:
        pairs, single = prefix(size + 1, percent, 2), prefix(size + 1, percent, 1)
        if pairs * (pairs - 1) / 2 > single * (1 + usual_list) or size >= 1 << 16:
            return size
        size += 1


def posted(docs: DataFrame, shingle: int, percent: int, levels: np.ndarray, light: int) -> DataFrame:
    """Rows (OWN, lists): every document's set, and its inverted lists as hashes; copies that come together give one row.

    Lists are parted by size: the first half are those of the set's own band, the others those of the next
    one. Sizes of similar sets lie in one band or in neighbouring ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    # Bands a little wider than the ratio of similar sizes, so that rounding parts none of them.
    width = 1.0001 * float(np.log(100 / percent))
    least = percent / (100 - percent)  # no smaller set has a similar one but its equals
    kinds = pa.schema([("doc", pa.int64()), ("nameless", pa.bool_()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("lists", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                tokens, at = shingle_sets(part.column("text"), shingle, shared.value)
                n = np.diff(at)
                own = own_columns(part.column("key"), tokens, at)
                # Lights meet heavies in single lists too, as far as their sizes can be similar.
                single = np.where((n >= least) & (100 * n >= percent * (light + 1)), prefix(n, percent, shares(n, light)), 0)
                double = np.where((n >= least) & (n <= light), prefix(n, percent, 2), 0)
                owner = np.arange(len(n))
                owners, lists = [np.repeat(owner, single)], [tx.mixed(tokens[tx.ranges(at[:-1], single)] + U(1))]
                for d in range(1, int(double.max(initial=0))):
                    more = np.maximum(double - d, 0)
                    i = tx.ranges(at[:-1], more)
                    owners.append(np.repeat(owner, more))
                    lists.append(tx.mixed(tx.mixed(tokens[i] + U(1)) * U(tx.STEP) + tokens[i + d]))
                owners, lists = np.concatenate(owners), np.concatenate(lists)
                band = np.floor(np.log(np.maximum(n, 1)) / width).astype(U)
                lists = np.concatenate([tx.mixed(lists + tx.mixed(band + U(d))[owners]) for d in (1, 2)])
                owners = np.concatenate([owners, owners])
                order = np.argsort(owners, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(n)))]).astype(np.int32)
                rows = pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[order].view(np.int64)))], schema=kinds)
                seen = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in own], axis=1)
                yield rows.take(pa.array(np.sort(np.unique(seen, axis=0, return_index=True)[1])))

    return docs.mapInArrow(run, "doc long, nameless boolean, n int, s1 long, s2 long, lists array<long>")


def sized(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (list, n, own, ..) that are next to one of fitting size in their list, and m, how many of them the list has.

    A similar set's size fits, and so does every size between. Lists without an ``own`` row repeat another one and go.
    """
    same = Window.partitionBy("list")
    order = same.orderBy("n")
    rows = rows.withColumn("below", F.lag("n").over(order)).withColumn("above", F.lead("n").over(order))
    near = F.coalesce(100 * F.col("below") >= percent * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * F.col("above"), F.lit(False))
    rows = rows.where(near).drop("below", "above")
    return rows.withColumn("m", F.count("*").over(same)).withColumn("some", F.max("own").over(same)).where("some").drop("some")


def columns_of(table: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in names]


def distinct_pairs(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    """Each pair once, the smaller key first, with how often it came."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((apart, hi, lo))
    lo, hi, apart = lo[order], hi[order], apart[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    at = np.flatnonzero(new)
    shared = np.diff(np.append(at, len(lo)))
    at, shared = at[lo[at] != hi[at]], shared[lo[at] != hi[at]]
    return pa.RecordBatch.from_arrays([pa.array(lo[at]), pa.array(hi[at]), pa.array(apart[at].astype(np.int32)), pa.array(shared.astype(np.int32))], ["a", "b", "apart", "shared"])


def short_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Possible pairs of lists of up to SHORT_LIST rows; two rows out of band meet in another list."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        lists, keys, n, own = columns_of(t, ("list", "key", "n", "own"))
        hist = np.stack(columns_of(t, ("h1", "h2")), axis=1).view(U)
        found: list[tuple[np.ndarray, ...]] = [(keys[:0], keys[:0], keys[:0])]
        for d in range(1, min(SHORT_LIST, len(lists))):
            i = np.flatnonzero(lists[d:] == lists[:-d])
            if not len(i):
                break
            i = i[own[i] | own[i + d]]
            some, apart = possible(n[i].astype(np.int64), hist[i], n[i + d].astype(np.int64), hist[i + d], percent)
            found.append((keys[i[some]], keys[i[some] + d], apart))
        return distinct_pairs(*map(np.concatenate, zip(*found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:  # all but the last list, which may go on
                t = pa.Table.from_batches(held)
                lists = t.column("list").to_numpy()
                cut = int(np.searchsorted(lists, lists[-1]))
                yield pairs(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if held:
            yield pairs(pa.Table.from_batches(held))

    dealt = rows.repartition("list").sortWithinPartitions("list")
    found = dealt.select("list", "key", "n", "h1", "h2", "own").mapInArrow(run, PAIRS)
    return found.groupBy("a", "b").agg(F.max("apart").alias("apart"), F.sum("shared").cast("int").alias("shared"))


def sharing(pairs: DataFrame, short: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that can share enough lists: the short ones they are known to share and all their long ones.

    ``sets``: key, needs (``shares`` of its size) and longs (number of its long lists).
    """
    one, two = (sets.select(F.col("key").alias(c), F.col("needs").alias(f"needs_{c}"), F.col("longs").alias(f"longs_{c}")) for c in "ab")
    known = pairs.select("a", "b", "apart").join(short.select("a", "b", "shared"), ["a", "b"], "left").join(one, "a").join(two, "b")
    most = F.coalesce("shared", F.lit(0)) + F.least("longs_a", "longs_b")
    return known.where(most >= F.least("needs_a", "needs_b")).select("a", "b", "apart")


def fine_cells(blobs: list[bytes]) -> np.ndarray:
    """Fine histograms as rows of token counts modulo 4, all folded to the cells of the shortest one, 2048 at most."""
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    least = int(min(4 * sizes.min(), 2048))
    out = np.empty((len(blobs), least), np.uint8)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for some in np.array_split(rows, -(-len(rows) * int(size) // (1 << 20))):
            packed = np.frombuffer(b"".join([blobs[i] for i in some]), np.uint8).reshape(len(some), size)
            cells = np.concatenate([packed >> shift & 3 for shift in (0, 2, 4, 6)], axis=1)
            out[some] = cells.reshape(len(some), -1, least).sum(axis=1, dtype=np.uint8) & 3
    return out


def unpacked(body: np.ndarray) -> np.ndarray:
    """Shingle hashes from the bytes of whole sets."""
    tokens = np.zeros((len(body) // SHINGLE_BYTES, 8), np.uint8)
    tokens[:, :SHINGLE_BYTES] = body.reshape(-1, SHINGLE_BYTES)
    return tokens.view("<u8").ravel()


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows in tables, one for each run of rows that agree in ``names``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = columns_of(batch, names)
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in found])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            here = tuple(c[a] for c in found)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def closest(x: int, y: np.ndarray, n: np.ndarray, cells: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Those of rows y that row x may be similar to by fine histograms: place, least overlap, difference, and which are the likeliest of their component."""
    apart = (cells[y] - cells[x]) & np.uint8(3)
    apart = np.minimum(apart, np.uint8(4) - apart).sum(axis=1, dtype=np.int64)
    least = needed(n[x] + n[y], percent)
    ok = np.flatnonzero(apart <= n[x] + n[y] - 2 * least)
    ok = ok[np.lexsort((apart[ok], label[y[ok]]))]
    y = y[ok]
    first = np.append(True, label[y[1:]] != label[y[:-1]]) if len(y) else np.zeros(0, bool)
    return y, least[ok], apart[ok], first


def hoped(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Possible pairs (tie, a, b, apart) of long lists, compared block against block by sizes, coarse and fine histograms.

    Of all possible pairs of two blocks only those are written that join rows no other one has joined, fewer than there are
    rows. Rows that possible pairs join, over others too, have one ``tie``: similar rows always do.
    """
    lists = rows.groupBy("list").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("total") * SHINGLE_BYTES / BLOCK_BYTES)).cast("int")
    rows = rows.join(lists.select("list", blocks.alias("blocks")), "list").join(classes.select(F.col("id").alias("key"), "fine"), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "h1", "h2", "own", "fine")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lists, i, j, keys, n, block, own = columns_of(t, ("list", "i", "j", "key", "n", "block", "own"))
        n, label, cells = n.astype(np.int64), np.arange(len(keys)), None
        hist = np.stack(columns_of(t, ("h1", "h2")), axis=1).view(U)
        last = np.searchsorted(n, 100 * n // percent, side="right")
        same = i[0] == j[0]
        found: list[tuple[int, int, int]] = []
        for x in range(len(keys)):
            y = np.arange(x + 1, last[x])
            # Two rows out of band meet in another list.
            y = y[(label[y] != label[x]) & ((block[y] != block[x]) | same) & (own[y] | own[x])]
            if not len(y):
                continue
            y = y[possible(np.broadcast_to(n[x], len(y)), np.broadcast_to(hist[x], (len(y), 2)), n[y], hist[y], percent)[0]]
            if not len(y):
                continue
            if cells is None:
                cells = fine_cells(t.column("fine").to_pylist())
            y, _, apart, first = closest(x, y, n, cells, label, percent)
            for z, d in zip(y[first].tolist(), apart[first].tolist()):
                label[label == label[z]] = label[x]
                found.append((x, z, d))
        if found:
            x, z, apart = (np.array(c) for c in zip(*found))
            columns = [lists[x], i[x], j[x], keys[label[x]], np.minimum(keys[x], keys[z]), np.maximum(keys[x], keys[z]), apart.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["list", "i", "j", "root", "a", "b", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("list", "i", "j")):
            yield from compare(t)
        tx.give_back()

    dealt = rows.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "n", "key")
    found = dealt.mapInArrow(run, "list long, i int, j int, root long, a long, b long, apart int")
    return found.select(F.xxhash64("list", "i", "j", "root").alias("tie"), "a", "b", "apart")


def across(docs: DataFrame, owned: DataFrame, hopes: DataFrame, labels: DataFrame, n_hopes: int, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of similar rows that have one tie (``hoped``) and are in different components.

    The rows of such a tie are compared by whole sets, and a link is written only if it joins components that no link of
    the tie has joined. So a tie writes fewer links than it has rows, however many of its pairs are possible, and no
    connection is lost. Ties whose rows are in one component already are not read again, nor are those of the same rows as another.
    """
    rows = hopes.select("tie", F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = rows.join(labels, rows["key"] == labels["node"], "left").select("tie", "key", F.coalesce("label", "key").alias("label"))
    marks = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.count("*").alias("m")]
    mixed = rows.groupBy("tie").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *marks).where("lo <> hi")
    # Copies share many lists, so one tie stands for all of the same rows.
    mixed = mixed.groupBy("x", "y", "m").agg(F.min("tie").alias("tie")).select("tie")
    rows, seen = counted(rows.join(mixed, "tie"), "jaccard-mixed", 2 * n_hopes)
    if not seen["n"]:
        return docs.sparkSession.createDataFrame([], LINKS)
    sets = whole_sets(docs, owned.join(rows.select("key").distinct(), "key", "left_semi"), seen["n"], shingle)
    rows = rows.join(sets, "key").select("tie", "key", "label", "set", F.length("set").alias("size"))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, label = columns_of(t, ("key", "label"))
        label = label.copy()
        body, at = tx.utf8(t.column("set").combine_chunks())
        tokens, at = unpacked(body), at // SHINGLE_BYTES
        n, cells = np.diff(at), fine_cells(fine_histogram(tokens, at))
        last = np.searchsorted(n, 100 * n // percent, side="right")
        links: list[tuple[int, int]] = []
        for x in range(len(keys)):
            y = np.arange(x + 1, last[x])
            y = y[label[y] != label[x]]
            if not len(y):
                continue
            # The likeliest row of each component is tested first, the others only if it does not link.
            y, least, _, first = closest(x, y, n, cells, label, percent)
            mine = tokens[at[x] : at[x + 1]]
            for chosen in (first, ~first):
                chosen = chosen & (label[y] != label[x])
                tested, wanted = y[chosen], least[chosen]
                ends = np.cumsum(n[tested])
                while len(tested):  # a bounded number of hashes at a time, one set at least
                    k = max(1, int(np.searchsorted(ends, TESTED_AT_ONCE, side="right")))
                    theirs = tokens[tx.ranges(at[tested[:k]], n[tested[:k]])]
                    common = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    for z in tested[:k][tx.segment_sums(common, np.concatenate([[0], ends[:k]])) >= wanted[:k]].tolist():
                        if label[z] != label[x]:
                            label[label == label[z]] = label[x]
                            links.append((keys[x], keys[z]))
                    tested, wanted, ends = tested[k:], wanted[k:], ends[k:] - ends[k - 1]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("tie",)):
            yield from compare(t)
        tx.give_back()

    return rows.repartition("tie").sortWithinPartitions("tie", "size", "key").mapInArrow(run, LINKS)


def whole_sets(docs: DataFrame, ends: DataFrame, most: int, shingle: int) -> DataFrame:
    """(key, set) of the classes ``ends`` (key, OWN), at most so many, which are distinct: 5 bytes for each shingle."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {c: np.zeros(1 << SKETCH_BITS, np.int64) for c in ("doc", "s1")}
        for b in batches:
            for c in counts:
                counts[c][bin_of(b.column(c))] = 1
        found = [r for c in counts for r in blob_rows(c, counts[c], 4)]
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "piece", "counts"), r)) for r in found], pa.schema([("name", pa.string()), ("piece", pa.int32()), ("counts", pa.binary())]))

    def bin_of(keys: pa.Array) -> np.ndarray:
        return (tx.mixed(keys.to_numpy(zero_copy_only=False).view(U)) >> U(64 - SKETCH_BITS)).astype(np.int64)

    # Which texts need their sets: one bit per hash of a key, and one per hash of a set for keys of many texts.
    wanted = summed_blobs(ends.select("doc", "s1").mapInArrow(mark, BLOBS))
    shared = docs.sparkSession.sparkContext.broadcast({c: np.packbits(wanted.get(c, np.zeros(1 << SKETCH_BITS)) > 0) for c in ("doc", "s1")})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {c: np.unpackbits(x).astype(bool) for c, x in shared.value.items()}
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(bits["doc"][bin_of(batch.column("key").fill_null(0))])))
            for part in tx.slices(batch, "text"):
                tokens, at = shingle_sets(part.column("text"), shingle)
                own = own_columns(part.column("key"), tokens, at)
                packed = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES].tobytes()
                some = np.flatnonzero(bits["s1"][bin_of(own[3])])
                at = at * SHINGLE_BYTES
                blobs = [packed[a:b] for a, b in zip(at[some].tolist(), at[some + 1].tolist())]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in own), pa.array(blobs, pa.binary())], [*OWN, "set"])

    found = docs.mapInArrow(sets, "doc long, nameless boolean, n int, s1 long, s2 long, set binary").join(ends, OWN)
    # Sets are long rows: a tenth of the usual number to a file.
    return stored(found.dropDuplicates(OWN).select("key", "set"), "jaccard-sets", 10 * most)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def likely(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The possible pairs that are still possible by their finer histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (x.astype(np.int64) for x in columns_of(batch, ("n_a", "n_b")))
            fine = [batch.column(c).to_pylist() for c in ("fine_a", "fine_b")]
            apart = np.fromiter(map(fine_apart, *fine), np.int32, batch.num_rows)
            ok = pa.array(apart <= n1 + n2 - 2 * needed(n1 + n2, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(apart).filter(ok)], ["a", "b", "apart"])

    a, b = (classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}")) for x in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(run, "a long, b long, apart int")


def similar(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar, by their whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, sizes = [], []
                for side in ("set_a", "set_b"):
                    body, offsets = tx.utf8(part.column(side))
                    sizes.append(np.diff(offsets) // SHINGLE_BYTES)
                    keys.append((np.repeat(np.arange(part.num_rows, dtype=U), sizes[-1]) << U(TOKEN_BITS)) | unpacked(body))
                both = np.sort(np.concatenate(keys))
                twice = both[1:][both[1:] == both[:-1]] >> U(TOKEN_BITS)
                overlap = np.bincount(twice.astype(np.int64), minlength=part.num_rows)
                ok = overlap >= needed(sizes[0] + sizes[1], percent)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    a = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, LINKS)


def verified(docs: DataFrame, owned: DataFrame, pairs: DataFrame, n_pairs: int, shingle: int, percent: int) -> DataFrame:
    """(node, label) of the components that the similar ones of possible pairs (a, b, apart) make.

    ``owned``: key and OWN of every class. Whole sets are made of classes in these pairs only.

    Every class first tries the likeliest pair in which its key is the smaller one, and that in which it
    is the larger; then all pairs whose ends have not met meanwhile are tried, which repeats only
    those that were not similar. So copies of one text cost few tests each, and no connection is lost.
    """
    labels = docs.sparkSession.createDataFrame([], "node long, label long")
    for first in (True, False):
        one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        now = pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "apart")
        if first:  # combined within tasks, so a class with very many pairs is no task of its own
            best = [now.groupBy(end).agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b") for end in "ab"]
            now = best[0].unionByName(best[1]).distinct()
        now, seen = counted(now.select("a", "b"), "jaccard-tests", n_pairs)
        if not seen["n"]:
            continue
        links = similar(whole_sets(docs, owned.join(ends_of(now), "key", "left_semi"), 2 * seen["n"], shingle), now, percent)
        labels = joined(labels, links)
    return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, label), joined further by links (a, b)."""
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, label): the least node that each one reaches, by large and small stars until nothing moves.

    ``most``: a bound of the rows of ``edges``, where one is known.
    """
    marks = (F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"))
    edges, now = counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars", most, *marks)
    mark = None
    while now["n"] and now != mark:
        mark, most = now, now["n"]  # neither star has more edges than there were
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.explode(ways).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "stars", most)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # Of a node's edges the one to its least neighbour stays, the others lead there from their other ends.
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, now = counted(small.distinct(), "stars", most, *marks)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles and component, the smallest key reachable by links.

    Documents link when 100 * overlap >= percent * union of their shingle sets; documents without words
    link with nothing. Rows are told apart by their texts: rows with the same key link by their own text only,
    and rows with a null key as all others. A component of null keys only is null. Equal
    texts, and texts that differ in the case of A-Z or white space only, are one class. An empty table gives no row.
    Shingles are known by 40 bits of their hashes: of two sets of n shingles, about n * n / 2 ** 40 more than they have in common agree.
    """
    return groups(docs, text, key, shingle, percent).select("key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80, carry: list[str] | None = None) -> DataFrame:
    """Per document: key, n, the columns ``carry``, a group of its own for each set of linked documents, and component.

    ``component`` is the smallest key of the group, which other groups may have too; documents without words have neither.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent must be from 60 to 100")
    carry = carry or []
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *carry)
    rows, blobs, n_docs = scanned(docs, shingle, carry)
    docs = docs.select("key", "text")
    classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("first"), F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.first("fine").alias("fine"))
    # Ids of classes are written once, so that all that follows reads the same ones.
    classes, seen = counted(classes.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes", n_docs)
    named = classes.select("n", "s1", "s2", F.col("id").alias("group"), F.col("first").alias("component"))
    if percent < 100:
        labels = linked(docs, classes, seen["n"], blobs, shingle, percent)
        named = classes.join(labels, classes["id"] == labels["node"], "left").select("n", "s1", "s2", F.coalesce("label", "id").alias("group"), "first")
        named = stored(named, "jaccard-named", seen["n"])
        named = named.join(named.groupBy("group").agg(F.min("first").alias("component")), "group").drop("first")
    return rows.select("key", "n", "s1", "s2", *carry).join(named, ["n", "s1", "s2"], "left").select("key", "n", *carry, "group", "component")


def own_of(key: str) -> list:
    """The columns of OWN by a key that may be null."""
    return [F.coalesce(F.col(key), F.lit(0).cast("long")).alias("doc"), F.col(key).isNull().alias("nameless"), "n", "s1", "s2"]


def linked(docs: DataFrame, classes: DataFrame, n_classes: int, blobs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) of all classes, known by their ids, that link with another."""
    counts = summed_blobs(blobs).get(None, np.zeros(1 << SKETCH_BITS, np.int64))
    levels, usual_list = shingle_levels(counts)
    light = boundary(usual_list, percent)
    owned = classes.select(F.col("id").alias("key"), *own_of("first"))
    post = posted(docs, shingle, percent, levels, light).join(owned, OWN).dropDuplicates(OWN)
    # Most lists have one row: histograms join the others only.
    rows = post.select("key", "n", F.size("lists").alias("all"), F.posexplode("lists").alias("at", "list"))
    rows = sized(rows.select("list", "key", "n", (2 * F.col("at") < F.col("all")).alias("own")), percent)
    rows = rows.join(classes.select(F.col("id").alias("key"), "h1", "h2"), "key")
    is_long = F.col("m") > SHORT_LIST
    rows, seen = counted(rows.select("list", "key", "n", "h1", "h2", "own", "m"), "jaccard-lists", None, F.count_if(is_long).alias("long"))
    needs = F.when(F.col("n") > light, 1 + F.floor(F.col("n") / 50)).otherwise(1)
    sets = rows.groupBy("key").agg(F.min(needs).alias("needs"), F.sum(is_long.cast("int")).alias("longs"))
    sets = stored(sets, "jaccard-needs", n_classes)
    long = rows.where(is_long).drop("m")
    # A row of a short list is in fewer pairs than SHORT_LIST.
    short, short_seen = counted(short_pairs(rows.where(~is_long), percent), "jaccard-short", SHORT_LIST * (seen["n"] - seen["long"]))
    some_long = seen["long"] > 0
    found = short.select("a", "b", "apart")
    n_hopes = 0
    if some_long:
        hopes, hopes_seen = counted(hoped(long, classes, percent), "jaccard-hopes")
        n_hopes = hopes_seen["n"]
        found = found.unionByName(hopes.select("a", "b", "apart")).groupBy("a", "b").agg(F.max("apart").alias("apart"))
    first, pairs = counted(likely(classes, sharing(found, short, sets), percent), "jaccard-pairs", short_seen["n"] + n_hopes)
    labels = verified(docs, owned, first, pairs["n"], shingle, percent)
    if some_long:
        links, met = counted(across(docs, owned, hopes, labels, n_hopes, shingle, percent), "jaccard-links")
        if met["n"]:
            labels = joined(labels, links)
    return labels
