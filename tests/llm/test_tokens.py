"""Encoders kept by a worker process."""

import public_tokenizers

from valora.llm import tokens


def test_encoders_are_dropped_with_their_caches():
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = tokens.encoder(path)
    assert tokens.encoder(path) is first
    tokens.forget()
    assert not tokens._ENCODERS and tokens.encoder(path) is not first
