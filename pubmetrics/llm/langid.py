"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.llm import text as tx
from pubmetrics.llm.store import BLOBS, blob_rows, summed_blobs

UNKNOWN = "und"
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` has a row for each n-gram bin and a column for each language, and a zero row at the end.

    Its size is bounded by 2 ** bits rows and the number of languages: 4 bytes each.
    """

    languages: list[str]
    weights: np.ndarray
    grams: tuple[int, ...]
    bits: int


def fit(df: DataFrame, text: str = "text", lang: str = "lang", grams: tuple[int, ...] = (2, 3, 4), bits: int = 16, smoothing: float = 0.5) -> LanguageModel:
    """Learn from every row with a text and a language, counting n-grams in tasks.

    Tasks send one count vector per language, which are added by piece before the sums, whose size
    does not depend on the rows, reach the driver: 2 ** bits counts for each language, so ``lang`` is meant to have
    some hundred values at most. An empty table gives a model without languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in tx.slices(batch, "text"):
                body, offsets = tx.utf8(part.column("text"))
                body = tx.LOWER[body]
                codes = part.column("lang").dictionary_encode()
                names = codes.dictionary.to_pylist()
                owner = np.repeat(codes.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
                total = np.zeros(len(names) * ((1 << bits) + 1), np.int64)
                for n in grams:
                    total += np.bincount(owner * ((1 << bits) + 1) + tx.gram_bins(body, offsets, n, bits), minlength=len(total))
                for name, c in zip(names, total.reshape(len(names), -1)):
                    if name in counts:
                        counts[name] += c[:-1]
                    else:
                        counts[name] = c[:-1].copy()
        rows = [r for name, c in counts.items() for r in blob_rows(name, c, 16)]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "piece", "counts"), r)) for r in rows[i : i + 64]], pa.schema([("name", pa.string()), ("piece", pa.int32()), ("counts", pa.binary())]))

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    found = summed_blobs(rows.mapInArrow(count, BLOBS))
    languages = sorted(found)
    weights = np.zeros(((1 << bits) + 1, len(languages)), np.float32)
    for j, name in enumerate(languages):
        weights[:-1, j] = np.log((found[name] + smoothing) / (found[name].sum() + smoothing * (1 << bits)))
    return LanguageModel(languages, weights, tuple(grams), bits)


def has_letter(column: pa.Array, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    some = tx.segment_sums(LETTER[body].astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
        some[i] = any(map(str.isalpha, column[int(i)].as_py()))
    return some


def predict(text: Column, model: LanguageModel, spark) -> Column:
    """Struct (lang_pred, score): the likeliest language of a text and its posterior.

    A batch's n-gram counts are a sparse matrix (a row for each text, ones at the bins of its
    n-grams); it is multiplied with the broadcast log probabilities by gathering and adding them.
    ``und`` with score 0 for a null text, one without a letter, or a model without languages.
    Equal scores go to the first language by name.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in columns:
            names, scores = [], []
            for part in tx.slices(pa.RecordBatch.from_arrays([column], ["t"]), "t"):
                body, offsets = tx.utf8(part.column("t"))
                known = has_letter(part.column("t"), body, offsets)
                body = tx.LOWER[body]
                total = np.zeros((len(known), len(m.languages)))
                for n in m.grams:
                    total += tx.segment_sums(m.weights[tx.gram_bins(body, offsets, n, m.bits)], offsets)
                if not m.languages:
                    known[:] = False
                    total = np.zeros((len(known), 1))
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                best = total.argmax(axis=1)
                names += [m.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores.append(np.where(known, 1 / odds.sum(axis=1), 0.0))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang_pred string, score double")(text)
