"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.llm import text as tx
from pubmetrics.llm.store import BLOBS, blob_rows, stored, summed_blobs

#: Labelled rows that a classifier is fitted on at most.
MAX_ROWS = 6000
GRAMS = (4, 5, 6)
BITS = 18
#: Entries of the sparse matrix that one product handles at once.
MATRIX_PART = 1 << 20
BLOB_SCHEMA = pa.schema([("name", pa.string()), ("piece", pa.int32()), ("counts", pa.binary())])


@dataclass(frozen=True)
class ToxicityModel:
    """``weights[bin]`` counts once for a text that has the n-gram; bins whose weight is 0 are never looked up."""

    weights: np.ndarray
    bias: float
    grams: tuple[int, ...]
    bits: int


def normal(body: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters, one kind of white space."""
    body = tx.LOWER[body]
    return np.where(tx.SEPARATOR[body], np.uint8(0x20), body)


def present(column: pa.Array, grams: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bin) pairs of a column, sorted, as two arrays; of ``wanted`` bins only, if given."""
    body, offsets = tx.utf8(column)
    body = normal(body)
    keys = []
    for n in grams:
        bins = tx.gram_bins(body, offsets, n, bits)
        keep = np.flatnonzero((bins < 1 << bits) if wanted is None else wanted[bins])
        text = np.searchsorted(offsets, keep, side="right") - 1
        keys.append((text << bits) | bins[keep])
    pairs = tx.distinct(np.concatenate(keys))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, shape: tuple[int, int], label: np.ndarray, strength: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on a sparse 0-1 matrix with scaled columns, by accelerated gradient steps.

    ``rows`` ascend; the products run over a bounded number of entries at once.
    """
    n, m = shape
    parts = [slice(i, i + MATRIX_PART) for i in range(0, len(rows), MATRIX_PART)]

    def forth(v: np.ndarray) -> np.ndarray:
        v = scale * v
        return sum((np.bincount(rows[s], v[cols[s]], n) for s in parts), np.zeros(n))

    def back(u: np.ndarray) -> np.ndarray:
        return scale * sum((np.bincount(cols[s], u[rows[s]], m) for s in parts), np.zeros(m))

    # A bound of the largest curvature: power iteration on the scaled matrix.
    v = np.ones(m) / np.sqrt(max(m, 1))
    top = 1.0
    for _ in range(12):
        v = back(forth(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1.0 / (0.25 * (1.1 * top + n) / n + strength)
    w, b, w0, b0 = np.zeros(m), 0.0, np.zeros(m), 0.0
    for t in range(steps):
        k = t / (t + 3)
        yw, yb = w + k * (w - w0), b + k * (b - b0)
        gap = (1 / (1 + np.exp(-np.clip(forth(yw) + yb, -40, 40))) - label) / n
        w0, b0 = w, b
        w = yw - rate * (back(gap) + strength * yw)
        b = yb - rate * gap.sum()
    return w, b


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "toxic",
    key: str = "doc_id",
    grams: tuple[int, ...] = GRAMS,
    bits: int = BITS,
    max_rows: int = MAX_ROWS,
    smoothing: float = 1.0,
    least_texts: int = 3,
    least_ratio: float = 0.7,
    strength: float = 1e-4,
    steps: int = 300,
    least: float = 0.02,
) -> ToxicityModel:
    """Learn from at most ``max_rows`` labels (those with the smallest hash of ``key``) and their texts.

    Each n-gram's presence is scaled by log((p / |p|) / (q / |q|)), where p and q are its smoothed
    counts in texts with label 1 and 0; then a regularised logistic regression is fitted over the
    n-grams of at least ``least_texts`` texts whose ratio's size is at least ``least_ratio``. Weights
    below ``least`` of the largest are set to 0. Rows with a null key, label or text are left out, a
    repeated key counts once with its smallest text; without rows of both labels the model scores
    every text with the share of label 1 (0.5 without any row).

    The driver holds the n-grams in use of the chosen texts, four bytes each: ``max_rows`` bounds the texts, not
    their length, but a text has 2 ** bits different n-grams at most.
    """
    chosen = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .dropna()
        .orderBy(F.xxhash64("key"), "key", "label")
        .limit(max_rows)
        .groupBy("key")
        .agg(F.max("label").alias("label"))
    )
    # The chosen labels are max_rows at most, so they can be sent to all tasks.
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna().join(F.broadcast(chosen), "key")
    texts = texts.groupBy("key", "label").agg(F.min("text").alias("text")).select("label", "text")
    texts = stored(texts, "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros(1 << bits, np.int64) for name in ("texts", "ones")}
        for batch in batches:
            for part in tx.slices(batch, "text"):
                row, bins = present(part.column("text"), grams, bits)
                one = part.column("label").to_numpy(zero_copy_only=False) > 0
                np.add.at(sums["texts"], bins, 1)
                np.add.at(sums["ones"], bins[one[row]], 1)
        rows = [dict(zip(BLOB_SCHEMA.names, r)) for name, c in sums.items() if c.any() for r in blob_rows(name, c, 4)]
        yield pa.RecordBatch.from_pylist(rows, BLOB_SCHEMA)

    n, ones = texts.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()

    def constant(share: float) -> ToxicityModel:
        return ToxicityModel(np.zeros((1 << bits) + 1, np.float32), float(np.log(share / (1 - share))), tuple(grams), bits)

    if not 0 < ones < n:
        return constant(min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6))
    sums = summed_blobs(texts.mapInArrow(count, BLOBS))
    none = np.zeros(1 << bits, np.int64)
    seen, p = sums.get("texts", none), sums.get("ones", none) + smoothing
    q = seen + 2 * smoothing - p
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    use = np.flatnonzero((seen >= least_texts) & (np.abs(ratio) >= least_ratio))
    if not len(use):
        return constant(ones / n)
    # Only the n-grams in use come to the driver: at most max_rows rows of them.
    wanted = np.zeros((1 << bits) + 1, bool)
    wanted[use] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def chosen_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                row, bins = present(part.column("text"), grams, bits, shared.value)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                blobs = [bins[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(blobs, pa.binary())], ["label", "bins"])

    place = np.zeros(1 << bits, np.int32)
    place[use] = np.arange(len(use))
    labelled, cols = [], []
    for r in texts.mapInArrow(chosen_bins, "label int, bins binary").toLocalIterator():
        labelled.append(r["label"] > 0)
        cols.append(place[np.frombuffer(r["bins"], np.int32)])
    label_of = np.array(labelled, float)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in cols])
    col = np.concatenate(cols)
    del cols
    weight, bias = logistic(row, col, ratio[use], (n, len(use)), label_of, strength, steps)
    weight *= ratio[use]
    weight[np.abs(weight) < least * np.abs(weight).max()] = 0
    full = np.zeros((1 << bits) + 1, np.float32)
    full[use] = weight
    return ToxicityModel(full, float(bias), tuple(grams), bits)


def score(text: Column, model: ToxicityModel, spark) -> Column:
    """Probability of label 1 for a text column; a null text is an empty one. Whole texts count.

    The broadcast model has 2 ** bits weights, whatever it was fitted on.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        wanted = m.weights != 0
        for column in columns:
            out = []
            for part in tx.slices(pa.RecordBatch.from_arrays([column], ["t"]), "t"):
                row, bins = present(part.column("t"), m.grams, m.bits, wanted)
                z = np.bincount(row, m.weights[bins], part.num_rows) + m.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)
