"""Whether tokens can be neighbours is told by undoing their merges, not by merging their bytes anew for each pair."""

import random

import public_tokenizers
import pytest
import tiktoken
from cloudloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def vocabulary(rng, shuffled):
    """Ranks of random byte strings of a few letters, built by joining known ones; in any order if ``shuffled``."""
    known = [bytes([i]) for i in range(256)]
    while len(known) < 300:
        new = rng.choice(known[97:100] + known[256:]) + rng.choice(known[97:100] + known[256:])
        if new not in known and len(new) < 9:
            known.append(new)
    if shuffled:
        rng.shuffle(known)
    return {b: i for i, b in enumerate(known)}


@pytest.mark.parametrize("shuffled", [False, True])
def test_neighbours_of_random_vocabularies(shuffled):
    rng, ordered = random.Random(4), 0
    for _ in range(30):
        ranks = vocabulary(rng, shuffled)
        own = bpe.Codec(ranks, r"\S+")
        tokens = [i for b, i in own.own.items() if b.strip(b"abc") == b""]
        ordered += own.ordered
        for a in tokens:
            for b in tokens:
                assert own.agree(a, b) == (own.merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b])
        plain = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(100):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
            assert own.encode(text) == plain.encode_ordinary(text), text
    assert shuffled or ordered


def test_new_words_make_no_merges(monkeypatch):
    ranks = bpe.read_ranks(PATH)
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(own, "merged", None)
    rng = random.Random(6)
    for _ in range(300):
        text = " ".join("".join(rng.choice(["tion", "er", "é", "sch", "the", "qu", "中", "9"]) for _ in range(rng.randrange(1, 6))) for _ in range(20))
        assert own.encode(text) == plain.encode_ordinary(text)


def test_words_met_again_outlast_the_others(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 20)
    own, made = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN), []
    encode = own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda raw: made.append(raw) or encode(raw))
    for i in range(200):
        own.encode(f" frequentlymetword{'abcdefghij'[i % 10]}x{'klmnopqrst'[i // 10 % 10]} again")
        assert len(own.pieces) <= 10 and len(own.older) <= 10
    assert made.count(b" again") == 1
