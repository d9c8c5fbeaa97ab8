import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def documents(spark):
    """Texts with nulls, repeats, marks, code and a long one; a clashing extra column."""
    texts = [None, "", "  \n ", "a", "a b c a b c", "One\nOne\n\nOne \ntwo", "É x ́y ΑΣ. it's 12 ½", "w " * 30_000, "<|endoftext|> hi"]
    texts += [" ".join(f"w{(i * j) % 37}" for j in range(60 + i)) for i in range(40)]
    texts += [texts[9], texts[9] + " end", "der die und das " * 20, "the and of it " * 20]
    return spark.createDataFrame([(i, t, "xy"[i % 2], None if i == 3 else f"s{i % 3}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score int")
