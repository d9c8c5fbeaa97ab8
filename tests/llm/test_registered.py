"""Registered queries on a small folder of odd tables against plain Python versions."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from pubmetrics.llm import vocab, warc
from pubmetrics.llm.queries import QUERIES, tokenizer_path

from .conftest import WORD


@pytest.fixture
def folder(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def found(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("query,name,drops,end", [("op1_wavelet_tokens", "word_bpe_49k.json", True, 1), ("op7_packing", "byte_bpe_50k.json", False, 0)])
def test_token_digests(spark, documents, folder, query, name, drops, end):
    tokenizer = vocab.Encoder(tokenizer_path(name), drops).tokenizer
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, end] for r in documents.collect()}
    rows = found(spark, query, folder)
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        part = ids[r.doc_id] if query.startswith("op1") else ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == crc(part) and len(part) == (r.n_tokens if query.startswith("op1") else r.length)
    if query.startswith("op7"):
        assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_warc_rows(spark, tmp_path):
    pages = [(1, "u", "same"), (5, "u", "same"), (3, None, None), (2, "v\n", ""), (4, "w", "é\r\n\r\nother"), (None, "x", "no id")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plain = {k: (t or "").encode() for k, _, t in pages}
    repeats = {1: 5, 2: 3}
    got = {r.page_id: tuple(r)[1:] for r in found(spark, "op6_warc", str(tmp_path))}
    assert got == {k: (len(b), warc.sha1(b), "revisit" if k in repeats else "response", repeats.get(k)) for k, b in plain.items()}


def test_chat_digests(spark, tmp_path):
    turns = [(3, 1, "assistant", "b </turn>"), (3, 0, "user", "### a"), (None, 0, "assistant", "\\n"), (8, 0, "user", None), (8, 2, "assistant", "x" * 9000), (8, 1, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "\\### Assistant: </turn> ok"
    by = collections.defaultdict(list)
    for k, t, role, text in [*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        by[k].append((t, role, text or ""))
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    wanted = {}
    for k, v in by.items():
        learnt = [t for _, role, t in sorted(v) if role == "assistant"]
        wanted[k] = (len(v), sha(f"{role}\n{t}\n" for _, role, t in sorted(v)), sum(map(len, learnt)), sha(learnt))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found(spark, "op8_chat_format", str(tmp_path))} == wanted


def test_quality_and_language_rows(spark, documents, folder):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert {r.doc_id: r.n_words for r in found(spark, "op4_repetition_quality", folder)} == {k: len(WORD.findall(t)) for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in texts}
    assert {r.doc_id: r.held_out for r in found(spark, "op10_language_id", folder)} == held


def test_source_mix_takes_its_targets(spark, tmp_path):
    rows = [(i, "w" * (1 + i * 7 % 50), f"s{i % 3}" if i % 10 else None) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sources = {k: s for k, _, s in rows}
    got = found(spark, "op5_source_mix", str(tmp_path))
    assert sorted(r.doc_id for r in got) == sorted(sources)
    for s in set(sources.values()):
        some = [r for r in got if sources[r.doc_id] == s]
        assert {r.source_size for r in some} == {sum(r.size for r in some)} and all(r.taken % r.size == 0 for r in some)
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r.size for r in some)
