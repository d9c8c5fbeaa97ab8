"""Quality rules by repetition coverage: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from pubmetrics.llm import text as tx

#: Largest share of word characters inside repeated n-grams of each length, and of line characters
#: inside repeated lines, that a kept text may have.
GRAM_LIMITS = {5: 0.40, 8: 0.30, 10: 0.25}
LINE_LIMIT = 0.35
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def covered(repeated: np.ndarray, starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """True for each of n words that lies in a marked window of k words."""
    depth = np.zeros(n + 1, np.int32)
    depth[starts[repeated]] += 1
    depth[starts[repeated] + k] -= 1
    return np.cumsum(depth[:-1]) > 0


def equal_lines(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line whether an earlier one of its text equals it, and whether any other does."""
    spans = tx.Blocks(body, starts, ends)
    keys = tx.text_keys(spans.hashes(), bounds)
    order = np.argsort(keys, kind="stable")
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    one, two = order[again], order[again + 1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[two], twice[one], twice[two] = True, True, True
    odd = ~spans.same(one, two)
    if odd.any():  # lines that met by hash only: those of their texts are compared as they are
        for i in np.unique(np.searchsorted(bounds, one[odd], side="right") - 1):
            lines = [body[a:b].tobytes() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])]
            count, seen = Counter(lines), set()
            for at, line in enumerate(lines, bounds[i]):
                later[at], twice[at] = line in seen, count[line] > 1
                seen.add(line)
    return later, twice


def measure(column: pa.Array, lengths: Sequence[int]) -> dict[str, np.ndarray]:
    """Counts and coverages of each text, by rolling hashes over all texts at once."""
    body, offsets = tx.utf8(column)
    starts, ends, first = tx.words(body, offsets)
    n = len(starts)
    points = np.concatenate([[0], np.cumsum(tx.code_points(body))])
    chars = points[ends] - points[starts]
    hashes = tx.span_hashes(body, starts, ends)
    out = {"n_words": np.diff(first), "word_chars": tx.segment_sums(chars, first)}
    out["n_symbols"] = tx.segment_sums(SYMBOLS[body].astype(np.int64), offsets)

    breaks = np.flatnonzero(body == 0x0A)
    edges = np.searchsorted(breaks, offsets)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    owner = np.repeat(np.arange(len(column)), np.diff(edges) + 1)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, owner = line_starts[worded], line_ends[worded], owner[worded]
    bounds = np.searchsorted(owner, np.arange(len(column) + 1))
    later, twice = equal_lines(body, line_starts, line_ends, bounds)
    out["n_dup_lines"] = tx.segment_sums(later.astype(np.int64), bounds)
    long = points[line_ends] - points[line_starts]
    out["line_cover"] = tx.segment_sums(long * twice, bounds) / np.maximum(tx.segment_sums(long, bounds), 1)

    for k in sorted({3, *lengths}):
        grams, gram_first = tx.windows(hashes, first, k)
        at = tx.ranges(first[:-1], np.diff(gram_first))
        inside = covered(tx.repeated(tx.text_keys(grams, gram_first)), at, k, n)
        if k == 3:
            out["n_repeat_words"] = tx.segment_sums(inside.astype(np.int64), first)
        if k in lengths:
            out[f"cover_{k}"] = tx.segment_sums(chars * inside, first) / np.maximum(out["word_chars"], 1)
    return out


def quality(
    text: Column,
    gram_limits: dict[int, float] = GRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> Column:
    """Struct of counts, coverages, ``base_failed`` and ``kept`` for a text column.

    A text fails the base rules with fewer than ``min_words`` words or with more than
    ``max_repeat_percent`` percent of its words in repeated 3-word windows. Of the others, one is
    kept unless repeated n-grams of some length cover more of its word characters, or repeated
    lines more of its line characters, than the limit. Null and empty texts have no words and fail.
    Equal texts get equal results; texts of any length are measured whole.
    """
    lengths = sorted(gram_limits)
    covers = [f"cover_{k}" for k in lengths]
    schema = f"{FIELDS}, line_cover double, {', '.join(f'{c} double' for c in covers)}, base_failed boolean, kept boolean"

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = []
            for part in tx.slices(pa.RecordBatch.from_arrays([column], ["t"]), "t"):
                m = measure(part.column("t"), lengths)
                m["base_failed"] = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
                over = m["line_cover"] > line_limit
                for k in lengths:
                    over |= m[f"cover_{k}"] > gram_limits[k]
                m["kept"] = ~m["base_failed"] & ~over
                names = [f.split()[0] for f in schema.split(", ")]
                parts.append(pa.StructArray.from_arrays([pa.array(m[c]) for c in names], names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([]))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema)(text)
