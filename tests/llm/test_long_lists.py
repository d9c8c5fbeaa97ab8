"""Links of long lists grow with their rows, not with their pairs."""

import random

from pubmetrics.llm import jaccard


def test_long_lists_write_links_by_rows(spark, monkeypatch):
    """Similar rows that nothing linked before: fewer links than rows of long lists, not one for each pair."""
    random.seed(3)
    seen = []
    plain = jaccard.across

    def counted(*args):
        found = plain(*args).cache()
        seen.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "across", counted)
    monkeypatch.setattr(jaccard, "verified", lambda docs, *_: docs.sparkSession.createDataFrame([], "node long, label long"))
    base = [f"w{i}" for i in range(120)]
    for n in (80, 240):
        rows = []
        for i in range(n):
            words = list(base)
            words[random.randrange(10, 110)] = f"u{i}"
            rows.append((i, " ".join(words)))
        found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=90).collect()
    # Three times the rows have nine times the pairs.
    assert seen[1] < 4 * seen[0]
    assert {r.component for r in found} == {0}
