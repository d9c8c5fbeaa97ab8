"""The whole pipeline on a small folder."""

import collections
import random
import zlib

import numpy as np

import corpus_pipeline
from pubmetrics.llm import vocab
from pubmetrics.llm.queries import tokenizer_path


def test_pipeline_rows(spark, tmp_path):
    random.seed(8)
    texts = {i: " ".join(f"w{random.randrange(9000)}" for _ in range(80 + i)) for i in range(12)}
    rows = [*texts.items(), (20, texts[3] + " end"), (21, texts[4].upper()), (22, "too short"), (23, None), (None, texts[5])]
    texts[30] = "another text " + texts[6].replace("w", "v")
    rows += [(30, texts[30]), (7, texts[30] + " more")]  # an id of two texts, the second the smaller id of its group
    texts[7, 2] = rows[-1][1]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tokenizer = vocab.Encoder(tokenizer_path("byte_bpe_50k.json"), False).tokenizer
    wanted = collections.Counter()
    for k, t in [*((i, texts[i]) for i in range(12)), (7, texts[7, 2])]:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        wanted[k] += len(ids)
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(ids.tobytes())
        got[r.doc_id] += r.length
    assert got == wanted
