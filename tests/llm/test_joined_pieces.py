"""Words are encoded many in one text, with the ids of each alone; bit planes are split and joined by pages."""

import numpy as np
import pyarrow as pa
import pytest

from pubmetrics.llm import vocab, wavelet
from pubmetrics.llm.queries import tokenizer_path


class Counting:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


ODD = [None, "", "</w> <w></w>", "<|endoftext|> it's'll DON'T", "\xaa\xba \xb5\xdf\xff\xd7 12\xbd", "a" * 3000, "œuvre Ł\xf3dź ʼː", "中文 don't, ́x İx"]


def alone(encoder, texts):
    return [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_many_in_one_text():
    encoder = vocab.Encoder(tokenizer_path("word_bpe_49k.json"), True)
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}lich" for j in range(300)) for i in range(30)]
    wanted = alone(encoder, texts)
    counting = encoder.tokenizer = Counting(encoder.tokenizer)
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == wanted
    assert len(encoder.slots) > 5000
    assert counting.texts == -(-len(encoder.slots) // vocab.ENCODED_AT_ONCE)


@pytest.mark.parametrize("name,drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("ends", ["known", "wrong"])
def test_ids_are_those_of_each_text_alone(name, drops, ends):
    encoder = vocab.Encoder(tokenizer_path(name), drops)
    assert (encoder.last is not None) == drops
    if drops and ends == "wrong":  # then words are encoded one by one
        encoder.last[:] = True
    for texts in (ODD, ODD[:6], ODD[:2]):
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == alone(encoder, texts)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
@pytest.mark.parametrize("top", [1, 2, 1 << 16, (1 << 16) + 1, 1 << 20])
def test_planes_of_several_pages(n, top, monkeypatch):
    monkeypatch.setattr(wavelet, "PAGE", 64)
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    shard = wavelet.Shard(wavelet.encode(ids, [7], np.zeros(1, np.int64)))
    assert [shard.access(i) for i in range(n)] == ids.tolist()
    found = shard.ids()
    assert found.dtype == np.uint32 and found.tolist() == ids.tolist()
