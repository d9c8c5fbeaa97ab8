"""Whole sets are read of rows that can be similar, not of every row of a long list."""

from pubmetrics.llm import jaccard


def test_unlike_rows_of_long_lists_need_no_whole_sets(spark, monkeypatch):
    asked = []
    plain = jaccard.whole_sets

    def counted(docs, ends, *more):
        asked.append(ends.count())
        return plain(docs, ends, *more)

    monkeypatch.setattr(jaccard, "whole_sets", counted)
    rows = []
    for i in range(40):
        words = [f"w{j}" for j in range(300)]
        for j in range(5):
            words[j * 58 + 10 + i] = f"u{i}x{j}"
        rows.append((i, " ".join(words)))
    # Two rows have 82 % in common or a little more, so the lists are long; only the last row links with another.
    rows.append((40, rows[7][1] + " end"))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=90).collect()
    assert {r.key: r.component for r in found} == {**{i: i for i in range(40)}, 40: 7}
    assert max(asked) < 10
