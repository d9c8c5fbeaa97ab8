"""The search for near fingerprints: pairs and least keys, inside the query too, and short texts in order."""

import numpy as np
import pyarrow as pa

from pubmetrics.llm import simhash
from pubmetrics.llm.queries import QUERIES


def test_pairs_and_least_keys_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    some = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    values = [x ^ (1 << int(b)) ^ (1 << int(c)) for x in some for b, c in rng.integers(0, 62, (6, 2))] + some
    rows = [(k, v) for k, v in enumerate(values, 100)]
    frame = spark.createDataFrame(rows, "key long, fingerprint long")
    asks = frame.where("key % 2 = 0")
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    asking = {v for k, v in rows if k % 2 == 0}
    pairs = sorted((a, b) for a in asking for b in set(values) if a != b and distance(a, b) <= 3)
    assert pairs and sorted(map(tuple, simhash.near_pairs(frame, asks, 3, 5, 4).collect())) == pairs
    near = {a: [k for k, v in rows if distance(a, v) <= 3] for a in asking}
    assert {r.fingerprint: (r.near, r.least) for r in simhash.near_counts(frame, asks, 3, 5, 4).collect()} == {a: (len(x), min(x)) for a, x in near.items()}


def test_short_texts_are_hashed_in_order():
    prints = simhash.fingerprints(pa.array(["no no", "yes yes", "a b", "b a", "a  b", "", None])).tolist()
    assert len(set(prints[:4])) == 4 and prints[2] == prints[4] and prints[5:] == [0, 0]


def test_query_returns_near_rows(spark, tmp_path):
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words[:299], "other"]), "a b", "b a", "a b", " ".join(reversed(words)), None]
    rows = [(7 * k if k != 6 else None, t) for k, t in enumerate(texts)] + [(20, texts[0]), (40, "b a"), (60, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = simhash.fingerprints(pa.array([t for _, t in rows])).tolist()
    near = {k: [j for (j, _), q in zip(rows, prints) if (p ^ q).bit_count() <= 3] for (k, _), p in zip(rows, prints)}
    got = {r.doc_id: (r.near_rows, r.near_first) for r in QUERIES["op3_simhash"](spark, str(tmp_path)).collect()}
    least = lambda x: min((k for k in x if k is not None), default=None)
    assert got == {k: (len(near[k]), least(near[k])) if k is not None and k % 20 == 0 else (None, None) for k, _ in rows}
    assert got[20][0] >= 2 and got[40][0] == 2 and got[60] == (2, 60)
