"""Token ids of all kinds of characters against the public library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from steerframe.llm import bpe, catalog


@pytest.fixture(scope="module")
def both():
    path = catalog.vocabulary()
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(path)

    def differing(texts):
        found = library.encode_batch_fast(texts, add_special_tokens=False)
        return [
            t for t, e in zip(texts, found)
            if np.frombuffer(encoder.text_ids(t.encode()), np.int32).tolist() != e.ids
        ]

    return differing


def test_every_code_point(both):
    """All of the first two planes, and every 97th behind them."""
    points = [*range(1, 0x20000), *range(0x20000, 0x110000, 97)]
    texts = [f"a{chr(c)}b {chr(c)}1" for c in points if not 0xD800 <= c < 0xE000]
    assert both(texts) == []


def test_compositions(both):
    rng = random.Random(3)
    letters = "aeiouAEIOUçñßΣσςЙйİıǅŉ̧́̈̀͂ͅกำक्षㄱ각가😀"
    texts = [
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", "'s", " 1"])
        for _ in range(5000)
    ]
    assert both(texts) == []


def test_very_long_words(both):
    assert both(["ab" * 30_000, "é" * 20_000, "🙂" * 5_000, "word " * 20_000]) == []
