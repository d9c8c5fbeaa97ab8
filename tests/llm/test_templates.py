"""Documents of one template, just under and just over the threshold, through join, query and pipeline stages with clashing columns."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pubmetrics.llm import jaccard
from pubmetrics.llm.queries import QUERIES

from .conftest import WORD


def templates(n, changes, seed=1):
    """n copies of a 120-word text with some words changed in each, and as many texts of their own."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(120), changes):
            words[at] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows + [(n + i, " ".join(f"v{rng.randrange(10**5)}" for _ in range(rng.randrange(4, 60)))) for i in range(n)]


def components(rows, shingle, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(t.lower())
        sets.append(frozenset(zip(*[w[j:] for j in range(shingle)])))
    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in held[g] if j < i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("changes", [1, 2, 3])
def test_template_components(spark, tmp_path, changes):
    rows = templates(400, changes)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.component_id for r in QUERIES["op9_jaccard_join"](spark, str(tmp_path)).collect()}
    assert got == components(rows, 3, 90)


def test_templates_under_the_threshold_write_few_pairs(spark, monkeypatch):
    """Rows of pairs grow with the documents of a template, not with their square."""
    seen = []
    plain = jaccard.across

    def counted(*args):
        found = plain(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "across", counted)
    for n in (300, 900):
        docs = spark.createDataFrame(templates(n, 3), "doc_id long, text string")
        jaccard.join(docs, shingle=3, percent=90).count()
    assert seen[1] <= 3 * max(seen[0], 30)


def test_fine_cells_fold():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**40, n)).astype(np.uint64) for n in (5, 300, 900, 4000)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    blobs = jaccard.fine_histogram(np.concatenate(sets), at)
    cells = jaccard.fine_cells(blobs)
    for s, row in zip(sets, cells):
        assert row.tolist() == (np.bincount((s & np.uint64(255)).astype(int), minlength=256) & 3).tolist()


def test_stages_take_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, None, None), (3, "x y z", "t"), (3, "x y z", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("key", "copies", "n", "component", "group", "_row", "_same", "_group", "_order", "list", "label")
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)}).withColumn("lang", F.create_map(F.lit("k"), F.lit(1)))
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.key, r._row) for r in kept.where("text IS NOT NULL").collect()) == [(1, "a b c d e f g", 0, 5), (3, "x y z", 0, 5)]
    assert kept.where("text IS NULL").count() == 1
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and {r.copies for r in mixed.collect()} <= {1}
    for stage in (corpus_pipeline.distinct, corpus_pipeline.mixture, corpus_pipeline.quality):
        assert stage(spark, docs.where("false"), "").count() == 0
