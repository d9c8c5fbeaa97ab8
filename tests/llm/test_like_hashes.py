"""Texts that polynomial hashes modulo a power of two take for one, through every query that hashes texts; tiny and odd texts."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pubmetrics.llm import jaccard, langid, repetition, simhash, text as tx, toxicity, vocab
from pubmetrics.llm.queries import QUERIES, tokenizer_path


def thue_morse(letters):
    bits = np.array([int(i).bit_count() & 1 for i in range(1024)])
    return "".join(letters[b] for b in bits)


ONE, TWO = thue_morse("ab"), thue_morse("ba")


@pytest.fixture
def folder(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, ONE), (2, TWO), (3, f"{ONE}\n{TWO}\n{words}"), (4, f"{words} {ONE}"), (5, f"{words} {TWO}")]
    spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), dict(rows)


@pytest.mark.parametrize("query,name,drops,end", [("op1_wavelet_tokens", "word_bpe_49k.json", True, 1), ("op7_packing", "byte_bpe_50k.json", False, 0)])
def test_ids_of_like_words(spark, folder, query, name, drops, end):
    tokenizer = vocab.Encoder(tokenizer_path(name), drops).tokenizer
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, end] for k, t in folder[1].items()}
    for r in QUERIES[query](spark, folder[0]).collect():
        part = ids[r.doc_id] if query.startswith("op1") else ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_lines_fingerprints_and_sets_of_like_words(spark, folder):
    assert {r.doc_id: r.n_dup_lines for r in QUERIES["op4_repetition_quality"](spark, folder[0]).collect()} == dict.fromkeys(folder[1], 0)
    found = QUERIES["op3_simhash"](spark, folder[0]).collect()
    assert len({r.fingerprint for r in found if r.doc_id < 3}) == 2
    got = {r.doc_id: r.component_id for r in QUERIES["op9_jaccard_join"](spark, folder[0]).collect()}
    assert got[1] == 1 and got[2] == 2


def test_what_meets_by_hash_only_is_compared(monkeypatch):
    """With hashes of no use at all, ids and line counts are still right."""
    monkeypatch.setattr(tx.Blocks, "hashes", lambda spans: spans.lengths.astype(np.uint64) % np.uint64(3))
    texts = ["the cat sat on a mat", "dog pig cow", "", "a a b\na a c\na a b\n\nx"]
    encoder = vocab.Encoder(tokenizer_path("word_bpe_49k.json"), True)
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = repetition.measure(pa.array(["ab\ncd\nab\nef\ncd\nab", "xy\nyx"]), [5])
    assert got["n_dup_lines"].tolist() == [3, 0]
    assert got["line_cover"].tolist() == [10 / 12, 0]


def test_span_hashes_follow_contents():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 100, 3000).astype(np.uint8)
    edges = np.sort(rng.choice(3000, 800, replace=False))
    starts, ends = edges[:-1:2], edges[1::2]
    starts, ends = np.append(starts[:-1], starts[-1]), np.append(ends[:-1], 3000)
    hashes = tx.span_hashes(body, starts, ends).tolist()
    by = collections.defaultdict(set)
    for h, a, b in zip(hashes, starts, ends):
        by[h].add(body[a:b].tobytes())
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({body[a:b].tobytes() for a, b in zip(starts, ends)})
    long = np.tile(np.frombuffer((ONE + TWO).encode(), np.uint8), 2)
    a, b, c, d = tx.span_hashes(long, np.arange(0, 4096, 1024), np.arange(1024, 5120, 1024)).tolist()
    assert a == c and b == d and a != b


def test_encoder_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(vocab, "KEPT_BYTES", 50_000)
    encoder = vocab.Encoder(tokenizer_path("byte_bpe_50k.json"), False)
    for i in range(30):
        encoder.encode(pa.array([chr(0x4E00 + i) * 500 + str(i), f"latin {i} " * 9]))
        assert encoder.kept < 60_000


TINY = ["hi", "h", "", None, "é", "a b", "hey", "four", "hello", "好"]


def test_tiny_texts(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TINY)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    for some in (docs.where("doc_id = 0").coalesce(1), docs.coalesce(1), docs.where("false")):
        language, toxic = langid.fit(some), toxicity.fit(some, labels)
        rows = some.select("doc_id", langid.predict(some["text"], language, spark).alias("p"), toxicity.score(some["text"], toxic, spark).alias("s")).collect()
        assert len(rows) == some.count() and all(0 <= r.s <= 1 and 0 <= r.p.score <= 1 for r in rows)
        for r in rows:
            assert r.p.lang_pred == ("und" if not any(c.isalpha() for c in TINY[r.doc_id] or "") else "en")
        assert some.select(repetition.quality(some["text"]).alias("q")).where("q.kept").count() == 0
        assert simhash.with_neighbours(some, partitions=2).count() == len(rows)
        assert jaccard.join(some).count() == len(rows)


@pytest.mark.parametrize("n,body", [(5, b"hi"), (3, b"hi"), (3, b""), (4, b"abc"), (2, b"a")])
def test_grams_of_bodies_shorter_than_they_are(n, body):
    bins = tx.gram_bins(np.frombuffer(body, np.uint8), np.array([0, len(body)]), n, 8)
    assert (bins[max(len(body) - n + 1, 0) :] == 256).all() and len(bins) == len(body)
