"""Registered queries against plain Python: toxicity, language, fingerprints and quality figures, on a folder of odd texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pubmetrics.llm import langid, repetition, simhash, store, text as tx, toxicity, warc
from pubmetrics.llm.queries import QUERIES

from .conftest import WORD

MASK = (1 << 64) - 1


def plain_bin(gram, bits):
    h = 0
    for byte in gram:
        h = (h * 0x01000193 + byte + 1) & 0xFFFFFFFF
    h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
    return h >> (32 - bits)


def grams(body, sizes, bits):
    return [plain_bin(body[i : i + n], bits) for n in sizes for i in range(len(body) - n + 1)]


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(3)
    words = {"en": ["the", "and", "of", "to", "IN"], "de": ["der", "und", "das", "nicht", "Für"], "fr": ["les", "des", "été", "où"]}
    rows = []
    for i in range(360):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 25)))
        if i % 3 == 0:
            text += rng.choice([" you idiot", " stupid\tfool", " Idiot!"])
        rows.append((i, text, None if i % 50 == 0 else lang, "s"))
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (402, "12 - 34", "en", "s"), (403, "hi", "de", None), (None, "the end", "en", "s"), (5, "the fool", "en", "s")]
    labels = [(k, 0, int(bool(t) and bool(re.search("idiot|fool", t.lower())))) for k, t, _, _ in rows if k is not None and k % 7]
    spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, lang string, source string, score double, label string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, labels


def crc(k):
    return zlib.crc32(str("" if k is None else k).encode())


def test_toxicity_scores(spark, folder):
    path, rows, labels = folder
    normal = lambda t: bytes(32 if b == 32 or 9 <= b <= 13 else b for b in (t or "").encode().lower())
    chosen = {}
    for k, _, mark in labels:
        if crc(k) % 3 != 1:
            chosen[k] = max(chosen.get(k, 0), mark)
    texts = {}
    for k, t, _, _ in rows:
        if k in chosen and t is not None:
            texts[k] = min(texts.get(k, t), t)
    bits, size = toxicity.BITS, 1 << toxicity.BITS
    sets = {k: set(grams(normal(t), toxicity.GRAMS, bits)) for k, t in texts.items()}
    seen, ones = collections.Counter(), collections.Counter()
    for k, s in sets.items():
        seen.update(s)
        if chosen[k]:
            ones.update(s)
    p_all = sum(ones.values()) + size
    q_all = sum(seen.values()) - sum(ones.values()) + size
    ratio = {b: math.log(((ones[b] + 1) / p_all) / ((seen[b] - ones[b] + 1) / q_all)) for b in seen}
    use = sorted(b for b in seen if seen[b] >= 3 and abs(ratio[b]) >= 0.7)
    keys = list(sets)
    x = np.array([[ratio[b] if b in sets[k] else 0.0 for b in use] for k in keys])
    label = np.array([chosen[k] for k in keys], float)
    n = len(keys)
    v, top = np.ones(len(use)) / math.sqrt(len(use)), 1.0
    for _ in range(12):
        v = x.T @ (x @ v)
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.25 * (1.1 * top + n) / n + 1e-4)
    w, b, w0, b0 = np.zeros(len(use)), 0.0, np.zeros(len(use)), 0.0
    for t in range(300):
        yw, yb = w + t / (t + 3) * (w - w0), b + t / (t + 3) * (b - b0)
        gap = (1 / (1 + np.exp(-(x @ yw + yb))) - label) / n
        w0, b0 = w, b
        w, b = yw - rate * (x.T @ gap + 1e-4 * yw), yb - rate * gap.sum()
    weight = w * np.array([ratio[i] for i in use])
    weight[np.abs(weight) < 0.02 * np.abs(weight).max()] = 0
    weight = dict(zip(use, weight))
    wanted = collections.defaultdict(list)
    for k, t, _, _ in rows:
        z = b + sum(weight.get(i, 0.0) for i in set(grams(normal(t), toxicity.GRAMS, bits)))
        wanted[k].append(round(1 / (1 + math.exp(-z)), 3))
    got = collections.defaultdict(list)
    for r in QUERIES["op2_toxicity"](spark, path).collect():
        got[r.doc_id].append(r.score)
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    assert set(got) == set(wanted)
    for k in got:
        assert sorted(got[k]) == pytest.approx(sorted(wanted[k]), abs=2e-3)


def test_language_predictions(spark, folder):
    path, rows, _ = folder
    size = 1 << 16
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    counts = collections.defaultdict(collections.Counter)
    for k, t, lang, _ in rows:
        if crc(k) % 5 and t is not None and lang is not None:
            counts[lang].update(grams(low(t), (2, 3, 4), 16))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    wanted = collections.defaultdict(list)
    for k, t, _, _ in rows:
        held = crc(k) % 5 == 0
        if not any(map(str.isalpha, t or "")):
            wanted[k].append((held, "und", 0.0))
            continue
        found = grams(low(t), (2, 3, 4), 16)
        logs = {lang: sum(math.log((c[g] + 0.5) / (total[lang] + 0.5 * size)) for g in found) for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        wanted[k].append((held, best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    got = collections.defaultdict(list)
    for r in QUERIES["op10_language_id"](spark, path).collect():
        got[r.doc_id].append((r.held_out, r.lang_pred, r.score))
    assert set(got) == set(wanted)
    for k in got:
        for a, b in zip(sorted(got[k]), sorted(wanted[k])):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3)


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_fingerprint(text):
    words = [w.encode() for w in WORD.findall(text or "")]
    if not words:
        return 0

    def word_hash(w):
        blocks = [int.from_bytes(w[i : i + 8].ljust(8, b"\0"), "little") for i in range(0, len(w), 8)]
        total = sum(mixed((b * tx.STEP + mixed((i + 1) * tx.STEP & MASK)) & MASK) for i, b in enumerate(blocks))
        return mixed((total + len(w)) & MASK)

    hashes = [word_hash(w) for w in words]
    votes = [0] * 64
    k = simhash.SHINGLE
    if len(words) < k:
        h = len(words)
        for x in hashes:
            h = mixed((h * tx.STEP + x) & MASK)
        return h
    for i in range(len(words) - k + 1):
        h = 0
        for x in hashes[i : i + k]:
            h = (h * tx.STEP + x) & MASK
        h = mixed(h)
        weight = sum(map(len, words[i : i + k]))
        for bit in range(64):
            votes[bit] += weight if h >> bit & 1 else -weight
    return sum(1 << bit for bit in range(64) if votes[bit] > 0)


def test_fingerprints(spark, folder, monkeypatch):
    path, rows, _ = folder
    monkeypatch.setattr(simhash, "PART_TERMS", 7)
    rows = [r for r in rows if r[0] is not None and r[0] != 5]
    long = ("word " * 4000 + "end. " * 20, "é" * 3000)
    rows += [(900 + i, t, "en", "s") for i, t in enumerate(long)]
    path += "/more"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{path}/documents.parquet")
    texts = {k: t or "" for k, t, _, _ in rows}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op3_simhash"](spark, path).collect()}
    assert set(got) == set(texts)
    for k, following in zip(order, order[1:] + order[:1]):
        t, r = texts[k], got[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[following][:half]
        own, changed, other = map(plain_fingerprint, (t, edited, texts[following]))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), f"{own:016x}", f"{changed:016x}")
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == 1 - (own ^ changed).bit_count() / 64 and r.near_next == 1 - (own ^ other).bit_count() / 64


def test_quality_figures(spark, tmp_path):
    rng = random.Random(2)
    lines = ["a b c d e f g h i j k", "é # $ <x> | & % *", "", " ", "one line of words that may come again", "w" * 40]
    rows = [(i, "\n".join(rng.choice(lines) + (f" {rng.randrange(99)}" if rng.random() < 0.6 else "") for _ in range(rng.randrange(25)))) for i in range(120)]
    rows += [(200, None), (201, " ".join(f"w{i}" for i in range(80))), (None, "w " * 60)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {k: t or "" for k, t in rows}
    kept = 0
    for r in QUERIES["op4_repetition_quality"](spark, str(tmp_path)).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        chars = sum(map(len, w))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        over = False
        for n, limit in repetition.GRAM_LIMITS.items():
            seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            inside = {i + j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(n)}
            cover = sum(len(w[i]) for i in inside) / max(chars, 1)
            assert r[f"cover_{n}"] == pytest.approx(cover)
            over |= cover > limit
        some = [x for x in t.split("\n") if WORD.search(x)]
        count = collections.Counter(some)
        cover = sum(len(x) for x in some if count[x] > 1) / max(sum(map(len, some)), 1)
        assert r.line_cover == pytest.approx(cover)
        assert r.kept == (not r.base_failed and not over and cover <= repetition.LINE_LIMIT)
        kept += r.kept
    assert 0 < kept < len(rows)


def test_warc_members_are_read_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_PIECE", 7)
    records = [warc.record(i, f"http://x/{i}", b"body %d " % i * i) for i in range(30)]
    assert [f.fields["warc-page-id"] for f in warc.salvage(b"".join(records))] == [str(i) for i in range(30)]
    found = list(warc.salvage(b"".join(records[:3]) + records[5][:-9] + records[4]))
    assert [bool(f.reason) for f in found] == [False, False, False, True, False]


def test_folders_have_a_file_system(spark, tmp_path):
    folder = store.qualified(spark, str(tmp_path))
    assert folder.startswith("file:")
    store.put(folder, "a.bin", b"x", "0")
    assert (tmp_path / "a.bin").read_bytes() == b"x" and [p.name for p in tmp_path.iterdir()] == ["a.bin"]


def test_empty_tables(spark, tmp_path):
    kinds = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn long, role string, text string",
    }
    for name, schema in kinds.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {name: f(spark, str(tmp_path)).count() for name, f in QUERIES.items()}
    assert rows == {name: int(name.startswith("op8")) for name in QUERIES}
