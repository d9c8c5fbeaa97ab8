"""Ids of one-byte texts and wider ones; one thread for each task."""

import os

import pyarrow as pa
import pytest

from pubmetrics.llm import vocab
from pubmetrics.llm.queries import tokenizer_path


@pytest.mark.parametrize("name,drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_of_one_byte_characters(name, drops, monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encoder = vocab.Encoder(tokenizer_path(name), drops)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    narrow = ["", None, "ÀÉ \xb5\xdf\xff\xd7\xf7 don't \x85\xa0 it's'll 12\xbd", "a", "\xaa\xba" * 20, "A long-word " * 40]
    for texts in (narrow, [*narrow, "œuvre Ł\xf3dź"], [*narrow, "中文 İx"], [None], [""]):
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, at[:-1], at[1:]):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
