"""Rows that share an id, or have none, are told apart by their texts."""

import random

import corpus_pipeline
import numpy as np
from pubmetrics.llm import jaccard, packing


def words(seed, n=60):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(seed, *places):
    found = words(seed)
    for p in places:
        found[p] = f"x{p}"
    return " ".join(found)


#: One id with four texts, a link through null ids, copies without an id, and documents without words.
ROWS = [(7, edited(1)), (7, edited(2)), (7, edited(3)), (7, edited(3)), (9, edited(2, 30)), (8, edited(4)), (None, edited(4, 0)), (12, edited(4, 0, 59)), (None, edited(5)), (None, edited(5, 59)), (7, ""), (7, None), (5, edited(1).upper())]


def test_components_of_shared_and_null_ids(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {(r.key, r["_at"]): (r.n, r.group, r.component) for r in jaccard.groups(frame.selectExpr("doc_id", "text", "md5(text) AS _at"), carry=["_at"]).collect()}
    marks = {t: r[0] for t in {t for _, t in ROWS} for r in spark.createDataFrame([(t,)], "t string").selectExpr("md5(t)").collect()}
    of = {(k, t): got[k, marks[t]] for k, t in ROWS}
    components = [of[x][2] for x in ROWS]
    assert components == [5, 7, 7, 7, 7, 8, 8, 8, None, None, None, None, 5]
    linked = [(0, 12), (1, 4), (2, 3), (5, 6), (6, 7), (8, 9)]
    assert all(of[ROWS[a]][1] == of[ROWS[b]][1] for a, b in linked)
    assert len({of[x][1] for x in ROWS if x[1]}) == 5 and of[7, ""][1] is None
    assert sorted(map(str, (r.component for r in jaccard.join(frame).collect()))) == sorted(map(str, [*components[:10], 7, 7, 5]))


def test_distinct_keeps_one_row_of_each_group(spark):
    frame = spark.createDataFrame([(k, t, "s") for k, t in [*ROWS, *ROWS]], "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.distinct(spark, frame, "").collect())))
    kept = [(5, edited(1).upper()), (7, edited(2)), (7, edited(3)), (8, edited(4)), (None, min(edited(5), edited(5, 59))), *[(7, ""), (7, None)] * 2]
    assert got == sorted(str((k, t, "s")) for k, t in kept)


def test_waiting_ids_are_held_in_two_bytes_if_they_fit():
    small, large = np.array([0, 65535], np.uint32), np.array([65536], np.uint32)
    assert packing.narrow(small).nbytes == 4 and packing.narrow(small).tolist() == [0, 65535]
    assert packing.narrow(large).tolist() == [65536]
    assert packing.narrow(small[:0]).tolist() == []
