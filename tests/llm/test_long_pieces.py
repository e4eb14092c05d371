"""Pieces without a break, of many kinds and lengths, against the library."""

from __future__ import annotations

import random
import string
import time

import numpy as np
import pytest

from quarrymill.llm import bpe


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.load_ranks(f.read())
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    yield codec, tiktoken.Encoding("long", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec.close()


def same(both, text):
    codec, library = both
    return np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("letters", [string.ascii_lowercase, "ab", "abc", "aeiou", "ACGT", "éèa", "日本語中文", string.ascii_letters + string.digits, "thein", "!?.,;-_"])
def test_random_pieces(both, letters):
    rng = random.Random(letters)
    for n in [*range(24, 130), 500, 2000, 20_000]:
        assert same(both, "".join(rng.choices(letters, k=n)))


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 30_000, "aab" * 5000, "é" * 20_000, "the" * 2000 + "x" * 333, "ha" * 333 + "he" * 500, " " * 5000 + "x", "\n" * 3000, "x" * 61, "x" * 60])
def test_repetitive_pieces(both, text):
    assert same(both, text)


def test_a_hundred_thousand_random_letters_in_time(both):
    text = "".join(random.Random(7).choices(string.ascii_lowercase, k=100_000))
    began = time.time()
    assert same(both, text) and time.time() - began < 30


def test_merge_order_that_neighbours_cannot_tell(both):
    """A contraction to the left makes a pair that is smaller than the one to the right."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"cd": 258, b"bc": 259, b"dd": 260, b"dab": 261}
    codec = bpe.Codec(ranks, r"[a-d]+")
    import tiktoken

    library = tiktoken.Encoding("small", pat_str=r"[a-d]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    for n in [3, 4, 5, *range(20, 400, 7)]:
        assert same((codec, library), "".join(rng.choices("abcd", k=n)))
    codec.close()


def test_pieces_met_lately_outlast_the_cache(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(bpe, "CACHE_BYTES", 40_000)
    learned, learn = [], codec.learn
    monkeypatch.setattr(codec, "learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    rng = random.Random(3)
    codec.encode([" qzxwvk"])
    for _ in range(30):
        text = " qzxwvk" + "".join(" " + "".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(40))
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
        assert codec.held < 40_000
    assert learned.count(" qzxwvk") == 1 and len(codec.cache) + len(codec.older) < 400
