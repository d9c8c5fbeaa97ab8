"""Every operator against a brute-force version or an exact round trip, on small odd tables and empty ones."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from pubmetrics.llm import balance, chat, jaccard, langid, packing, repetition, simhash, toxicity, vocab, warc, wavelet
from pubmetrics.llm.queries import QUERIES, tokenizer_path
from pubmetrics.llm.text import slices

from .conftest import WORD


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


@pytest.mark.parametrize("name,drops,end", [("word_bpe_49k.json", True, 1), ("byte_bpe_50k.json", False, 0)])
def test_ids_equal_the_tokenizer(name, drops, end):
    random.seed(3)
    parts = list(" \t\n\r ab'stÉ́\xa0\x1c.,!1½<|>Σ😀") + ["'ll", "'re", "  "]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    encoder = vocab.Encoder(tokenizer_path(name), drops)
    ids, at = encoder.encode(pa.array(texts))
    assert all(ids[a:b].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, at[:-1], at[1:]))


def test_wavelet_access_rank_select():
    ids = np.random.default_rng(0).integers(0, 300, 5000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.encode(ids, [1, 2], [0, 40]))
    assert (shard.ids() == ids).all() and [shard.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for token in (0, 7, 299, 1000):
        at = np.flatnonzero(ids == token)
        assert shard.occurrences(token)[:20] == at.tolist()[:20] and shard.count(token, 100, 4000) == ((at >= 100) & (at < 4000)).sum()


def test_wavelet_files_and_packing_cover_all_ids(spark, documents):
    path = tokenizer_path("word_bpe_49k.json")
    folder = wavelet.new_folder(spark)
    rows = wavelet.document_ids(wavelet.write_shards(documents, path, folder, shard_tokens=500), folder).orderBy("key").collect()
    encoder, at = vocab.Encoder(path, True), 0
    for r, text in zip(rows, texts_of(documents).values()):
        ids = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (at, len(ids)) and np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        at += len(ids)
    pieces = packing.pack(documents, tokenizer_path("byte_bpe_50k.json"), window=7).collect()
    used, placed = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
        placed[p.key].append((p.start, p.length, p.doc_tokens))
    for spans in [*used.values(), *[[s[:2] for s in v] for v in placed.values()]]:
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:])) and min(spans)[0] == 0
    assert all(sum(x[1] for x in v) <= 1024 for v in used.values())
    assert all(sum(x[1] for x in v) == v[0][2] for v in placed.values()) and len(placed) == documents.count()


def test_quality_counts(documents):
    got = {r.doc_id: r.q for r in documents.select("doc_id", repetition.quality(documents["text"]).alias("q")).collect()}
    for k, text in texts_of(documents).items():
        w = WORD.findall(text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        q = got[k]
        assert (q.n_words, q.word_chars, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(inside))
        assert q.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (q.kept and q.base_failed)


def test_language_and_toxicity(spark, documents):
    rows = [(i, f"{w} " * 12 + str(i), lang) for i in range(60) for w, lang in (("the and of", "en"), ("der und das", "de"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    found = {r.doc_id: r.p for r in documents.select("doc_id", langid.predict(documents["text"], model, spark).alias("p")).collect()}
    assert found[0].lang_pred == found[2].lang_pred == "und" and found[51].lang_pred == "de" and found[52].lang_pred == "en"
    docs = spark.createDataFrame([(i, ("you idiot " if i % 3 == 0 else "") + f"word{i} other text{i % 7}") for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic")
    toxic = toxicity.fit(docs, labels)
    probe = spark.createDataFrame([("you idiot word5 other text3",), ("nothing of it",), (None,)], "text string")
    scores = [r[0] for r in probe.select(toxicity.score(probe["text"], toxic, spark)).collect()]
    assert scores[0] > 0.7 > scores[1] and 0 <= scores[2] < 0.7
    assert toxicity.fit(docs, labels.where("false")).bias == 0


def test_simhash_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    some = rng.integers(0, 2**62, 100)
    values = [int(x) for x in some] + [int(x) ^ (1 << int(b)) for x in some[:50] for b in rng.integers(0, 62, 4)] + [int(some[0])] * 9
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = {r[0]: r[1] for r in simhash.near_counts(frame, frame.limit(60), 3, 6, 32).collect()}
    assert got == {v: int((np.bitwise_count(np.array(values) ^ v) <= 3).sum()) for v in values[:60]}
    with pytest.raises(ValueError):
        simhash.tables(6, 6)


def test_simhash_neighbours(documents):
    found = {r.key: r for r in simhash.with_neighbours(documents, partitions=5).collect()}
    texts = texts_of(documents)
    order = sorted(texts, reverse=True)
    prints = dict(zip(texts, simhash.fingerprints(pa.array(list(texts.values()))).view(np.int64).tolist()))
    for k, following in zip(order, order[1:] + order[:1]):
        r = found[k]
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + texts[following][:half]
        own, other = prints[k], prints[following]
        assert (r.n_chars, r.fingerprint, r.next_fingerprint) == (len(texts[k]), own, other)
        assert r.edited_fingerprint == int(simhash.fingerprints(pa.array([edited])).view(np.int64)[0])


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, monkeypatch, shingle, percent):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 20)
    random.seed(5)
    base = [f"w{random.randrange(300)}" for _ in range(120)]
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO")]
    for i in range(4, 160):
        words = list(base) if i % 3 else [f"v{random.randrange(90)}" for _ in range(random.randint(1, 40))]
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = f"u{random.randrange(500)}"
        rows.append((i, " ".join(words)))
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append(set(zip(*[w[j:] for j in range(shingle)])) if len(w) >= shingle else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for _ in range(8):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.key: (r.n_shingles, r.component) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle, percent=percent).collect()}
    assert got == {k: (len(s), c) for (k, _), s, c in zip(rows, sets, label)}


def test_mix_meets_targets(documents):
    rows = balance.mix(documents).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    assert len(rows) == documents.count() and sum(dict((r.source, r.target) for r in rows).values()) == pytest.approx(sum(r.size for r in rows))
    assert balance.mix(documents.where("false")).count() == 0


def test_warc_salvage():
    records = [warc.record(i, f"http://x/{i}\n", b"body %d" % i, 0 if i == 2 else None, i == 2) for i in range(5)]
    broken = bytearray(b"".join(records))
    at = len(records[0]) + 40
    broken[at : at + 4] = b"zzzz"
    found = list(warc.salvage(bytes(broken) + records[1][:50]))
    assert [f.fields.get("warc-page-id") for f in found if not f.reason] == ["0", "2", "3", "4"]
    gaps = [(f.at, f.size) for f in found if f.reason]
    assert gaps == [(len(records[0]), len(records[1])), (len(broken), 50)]


def test_warc_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (5, "u", "same"), (3, None, None), (2, "v", ""), (4, "w", "other")], "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    warc.write(warc.with_revisits(pages), folder)
    got = {r.record_id: (r.type, r.refers_to, r.payload_bytes) for r in warc.read(spark, folder).collect()}
    assert got == {"1": ("revisit", "5", 4), "5": ("response", None, 4), "2": ("revisit", "3", 0), "3": ("response", None, 0), "4": ("response", None, 5)}


def test_chat_round_trip(spark):
    random.seed(1)
    parts = ["#", "##", "###", "\\", "</turn>", "\n", "a", "</", "turn>", "😀", "### assistant:\n"]
    rows = [(None, None, None, None), (3, None, "assistant", None)]
    rows += [(random.randint(0, 40), random.randint(0, 9), random.choice(["user", "assistant", "a\\\nb"]), "".join(random.choice(parts) for _ in range(random.randint(0, 9)))) for _ in range(600)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_bytes=200).orderBy("key", "part").collect()
    turns, learnt = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        turns[r.key] += chat.parse(r.formatted)
        learnt[r.key] += [chat.unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss]
    wanted = collections.defaultdict(list)
    for k, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        wanted[k].append((role or "", text or ""))
    assert dict(turns) == dict(wanted)
    assert all(learnt[k] == [t for r, t in v if r == "assistant"] for k, v in wanted.items())


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 9, None, "", "b" * 50, "c"])], ["t"])
    assert [x for p in slices(batch, "t", 10) for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
