import random

import public_tokenizers
import pytest
from cloudloom.llm import unigram
from tokenizers.models import Unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "  two  blanks ", "The CAT sat.", "中文字 अक्षर 😀 ▁x", "x" * 3000, "a\n\n\tb\x0bc\x00", "é" * 500, "ab " * 20000]


def library(pieces):
    """The public tokenizer's unigram model over the same pieces; unknown characters fall back to bytes."""
    low = min(s for _, s in pieces)
    extra = [("<unk>", low)] + [(f"<0x{i:02X}>", low) for i in range(256)]
    model = Unigram(extra + pieces, 0, True)
    return lambda t: len(model.tokenize(unigram.MARK + t.replace(" ", unigram.MARK))) if t else 0


@pytest.fixture(scope="module")
def pieces():
    return unigram.read_pieces(PATH)


def test_counts_are_the_library_s(pieces):
    own, plain, rng = unigram.Counter(pieces), library(pieces), random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("theanrsé中 \n'1.,😀ß") for _ in range(rng.randrange(90))) for _ in range(1500)]
    for t in texts:
        assert own.count(t)[0] == plain(t), t[:80]


def test_ties_go_as_in_the_library():
    rng = random.Random(2)
    for _ in range(60):
        pieces = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), -float(rng.randrange(1, 4))) for _ in range(12)]
        pieces = list(dict(pieces).items()) + [(unigram.MARK, -1.0)]
        own, plain = unigram.Counter(pieces), library(pieces)
        for _ in range(40):
            t = "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 14)))
            assert own.count(t)[0] == plain(t), (pieces, t)


def test_pieces_across_marks_switch_cutting_off():
    pieces = [("a▁b", -1.0), ("a", -1.0), ("b", -1.0), ("▁", -1.0)]
    assert unigram.Counter(pieces).count("a b a")[0] == library(pieces)("a b a") == 4


def test_query_on_odd_rows(spark, tmp_path, pieces):
    plain = library(pieces)
    rows = [(i, t, 1.5) for i, t in enumerate(ODD)] + [(2, "x", 1.5), (None, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = unigram.op6_unigram_token_counts(spark, str(tmp_path)).collect()
    assert sorted(str((i, plain(t or ""))) for i, t, _ in rows) == sorted(str((r.doc_id, r.n_tokens)) for r in got)


def test_empty_table(spark, pieces):
    assert unigram.count_tokens(spark.createDataFrame([], "doc_id long, text string"), pieces, ["doc_id"]).collect() == []
