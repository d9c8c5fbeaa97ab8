"""What an encoder holds is bounded by its bytes of known pieces, and its ids stay the same."""

import pyarrow as pa

from pubmetrics.llm import vocab
from pubmetrics.llm.queries import tokenizer_path


def test_encoders_keep_what_they_are_given():
    path = tokenizer_path("byte_bpe_50k.json")
    small, usual = vocab.encoder(path, False, 1 << 16), vocab.encoder(path, False)
    for i in range(4):
        texts = pa.array([f"{i * 6000 + j}" for j in range(6000)])
        found, wanted = small.encode(texts), usual.encode(texts)
        assert all((a == b).all() for a, b in zip(found, wanted))
        # The pieces of this batch only.
        assert len(small.slots) <= 6000
    assert len(usual.slots) > 18_000
