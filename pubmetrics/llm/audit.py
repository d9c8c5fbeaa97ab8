"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Rows are counted once per part and combination of failed filters; a part is then a tensor with one axis of
(passes, fails) per filter. Every figure of every step of every order is a contraction of that tensor: each axis is
weighted by pass, fail or all, so no row is read again however many orders there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pubmetrics.llm.store import stored

PASS, FAIL, ALL = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
WORD_GAPS = r"[\x20\x09-\x0D]+"
MAX_FILTERS = 6
FIGURES = ("kept", "removed", "redundant", "unique_fails")


def text_rules(text: Column, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, symbols: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions A to D of a text: few words, few distinct words, many capitals A-Z, any of the symbols."""
    words = F.filter(F.split(text, WORD_GAPS), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words),
        "C": 100 * capitals > upper_percent * F.char_length(text),
        "D": text.rlike(rf"[\Q{symbols}\E]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source", **limits) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row; E: the same text stands under a smaller key.

    A null text is an empty one, a null part is empty text. A null key is not smaller than any and has no smaller one. A row is good (toxic) if
    any label of its key has quality (toxic) 1. Texts are known by their SHA-256; one scan stores 40 bytes
    and the flags of each row, and only texts that occur twice or more are looked up again, without a group per text in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("same"),
        *(c.alias(k) for k, c in text_rules(body, **limits).items()),
    )
    rows = stored(rows, "audit-rows")
    copies = rows.groupBy("same").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("key")).agg((F.max(F.col("quality")) == 1).alias("good"), (F.max(F.col("toxic")) == 1).alias("toxic"))
    found = rows.join(copies, "same", "left").join(marks, "key", "left")
    no = F.lit(False)
    return found.select("part", "A", "B", "C", "D", F.coalesce(F.col("key") > F.col("least"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def chains(filters: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Orders as text, the filter of each step (orders x steps), and which filters come before it (orders x steps x filters)."""
    orders = np.array(list(permutations(range(len(filters)))))
    names = ["".join(filters[i] for i in order) for order in orders]
    place = np.argsort(orders, axis=1)  # of each filter in each order
    before = place[:, None, :] < np.arange(len(filters))[None, :, None]
    return names, orders, before


def contracted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` (parts, 2, 2, ..) weighted on each axis by ``weights`` (steps, filters, 2): (parts, steps)."""
    k = counts.ndim - 1
    axes = ascii_lowercase[:k]
    return np.einsum(f"P{axes}," + ",".join(f"S{x}" for x in axes) + "->PS", counts, *(weights[:, i] for i in range(k)), optimize=True)


def figures(counts: Mapping[str, np.ndarray], filters: Sequence[str], losses: Mapping[str, str]) -> dict[str, np.ndarray]:
    """Every figure of all steps, parts x (orders * steps); ``counts`` has "n" and one tensor for each loss."""
    k = len(filters)
    _, orders, before = chains(filters)
    here = np.eye(k, dtype=bool)[orders].reshape(-1, k)
    before = before.reshape(-1, k)

    def axes(at_here: np.ndarray, at_before: np.ndarray, else_: np.ndarray) -> np.ndarray:
        return np.where(here[..., None], at_here, np.where(before[..., None], at_before, else_))

    removing = axes(FAIL, PASS, ALL)
    removed = contracted(counts["n"], removing)
    out = {
        "kept": contracted(counts["n"], axes(PASS, PASS, ALL)),
        "removed": removed,
        "redundant": contracted(counts["n"], axes(FAIL, ALL, ALL)) - removed,
        "unique_fails": contracted(counts["n"], axes(FAIL, PASS, PASS)),
        **{name: contracted(counts[c], removing) for name, c in losses.items()},
    }
    total = np.stack([removed[:, here[:, f]].sum(axis=1) for f in range(k)], axis=1)
    out["shapley"] = total[:, orders.ravel()]
    return out


def interactions(rows: DataFrame, filters: Sequence[str], losses: Mapping[str, str], part: str = "part") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, one count for each of ``losses``, shapley.

    ``filters`` are boolean columns, true where a row fails, with one-letter names; ``losses`` maps a result column to a boolean
    column whose removed rows it counts. Nulls count as false. kept: rows left after the step; removed: by it; redundant: fail its
    filter but went earlier; unique_fails: fail no other; shapley: removed by its filter, added up over all orders. A part has 2^filters
    counts at most, made within tasks before the shuffle, so a hot part is one small row. An empty table gives no row.
    """
    if not 1 <= len(filters) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    k = len(filters)
    fails = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") * (1 << (k - 1 - i)) for i, f in enumerate(filters)), F.lit(0))
    sums = [F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(f"_{name}") for name, c in losses.items())]
    cells = rows.groupBy(F.col(part).alias("part"), fails.alias("cell")).agg(*sums)
    kinds = ["n", *(f"_{name}" for name in losses)]
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("cell", *kinds)).alias("cells"))
    names, orders, _ = chains(filters)
    label, step = np.repeat(names, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))
    columns = [*FIGURES, *losses, "shapley"]
    fields = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):  # at most 16 * filters! * filters rows at once
                batch = whole.slice(at, 16)
                here = batch.column("cells")
                owner = np.repeat(np.arange(batch.num_rows), here.value_lengths().to_numpy())
                flat = here.flatten()
                cell = flat.field("cell").to_numpy()
                counts = {}
                for kind in kinds:
                    tensor = np.zeros((batch.num_rows, 1 << k), np.int64)
                    tensor[owner, cell] = flat.field(kind).to_numpy()
                    counts[kind] = tensor.reshape(batch.num_rows, *[2] * k)
                found = figures(counts, filters, {name: f"_{name}" for name in losses})
                part_of = batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), len(label))))
                yield pa.RecordBatch.from_arrays([part_of, pa.array(np.tile(label, batch.num_rows)), pa.array(np.tile(step, batch.num_rows)), *(pa.array(found[c].ravel()) for c in columns)], schema=fields)

    return parts.mapInArrow(run, ", ".join(["part string", "filter_order string", "step int", *(f"{c} long" for c in columns)]))
