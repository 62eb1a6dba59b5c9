import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from cloudloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "a" * 5000, "=" * 4000, " " * 999 + "x", "中" * 700, "0123456789" * 90, "<|endoftext|>", "don't I'LL\r\n\t é́ 😀 हिन्दी \x00\x7f"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_as_the_library_does(ranks, plain):
    own, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(1)
    tokens = [b for b in ranks if len(b) > 2]
    texts = ["".join(rng.choice("aabé中文अก😀 '\n\tzZ09.,!#́ß") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randrange(6))).decode("utf-8", "ignore") for _ in range(3000)]
    for t in texts + [x or "" for x in ODD]:
        got = own.encode(t)
        assert got == plain.encode_ordinary(t), t
        assert own.decode(got) == t.encode()


def test_tokens_that_do_not_merge_to_themselves_count_whole_only():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"abcbc": 259, b"xyz": 260}
    plain = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    own, rng = bpe.Codec(ranks, r"\S+"), random.Random(2)
    assert b"xyz" not in own.own
    for t in ["xyz", "axyz", "xyzxyz"] + ["".join(rng.choice("abcxyz") for _ in range(rng.randrange(12))) for _ in range(500)]:
        assert own.encode(t) == plain.encode_ordinary(t), t


def test_query_and_decoding_on_odd_rows(spark, tmp_path, plain):
    rows = [(i, t, "c") for i, t in enumerate(ODD)] + [(3, ODD[3], "c"), (None, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _ in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.op10_byte_bpe(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
    coded = bpe.encode_documents(df, PATH, public_tokenizers.PATTERN, ["doc_id", "text"])
    for r in bpe.decode_documents(coded, PATH, ["k1"]).collect():
        assert bytes(r.content) == (r.k0 or "").encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(df, PATH, public_tokenizers.PATTERN, ["doc_id"]).collect() == []
