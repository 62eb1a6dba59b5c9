import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cloudloom.llm import simple8b as s8
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "The CAT sat", "é É café́  x", "中文字 अक्षर 😀", "x" * 3000, "don't <|endoftext|> 12 34", "a\n\n\tb\x0bc", "w " * 70000, "#$% !!??", "A<|ENDOFTEXT|>B <|endoftext|>c", "ÀÉ İI K"]


def round_trip(ids):
    words, offsets, escaped = s8.encode(np.array(ids, np.uint64))
    assert s8.decode(words, offsets, escaped, len(ids)).tolist() == list(ids)
    return words, offsets, escaped


def test_round_trips():
    rng = random.Random(1)
    round_trip([])
    for n in (1, 2, 59, 60, 61, 1023, 1024, 1025, 5000):
        for top in (0, 1, 3, 16, 50000, 1 << 31, (1 << 60) - 1, (1 << 64) - 1):
            round_trip([rng.randint(0, top) for _ in range(n)])
            round_trip([rng.choice((0, top, 7)) for _ in range(n)])


def test_packing_is_dense_and_blocks_decode_alone():
    assert len(round_trip([1] * 600)[0]) == 10 and len(round_trip([40000] * 300)[0]) == 100
    assert round_trip([1 << 60, 5, (1 << 64) - 1])[2].tolist() == [1 << 60, (1 << 64) - 1]
    ids = np.random.default_rng(2).integers(0, 49408, 5000).astype(np.uint64)
    words, offsets, _ = s8.encode(ids)
    for b in range(len(offsets)):
        part = words[offsets[b] : offsets[b + 1] if b + 1 < len(offsets) else None]
        want = ids[b * s8.BLOCK : (b + 1) * s8.BLOCK]
        assert (s8.decode(part, np.array([0]), np.empty(0, np.uint64), len(want)) == want).all()


def test_words_are_encoded_as_whole_texts_are():
    with open(PATH, encoding="utf-8") as f:
        own = s8.WordTokenizer(f.read())
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aBé中İΣς́ \n  '1.,!sté😀ß") for _ in range(60)) for _ in range(2000)]
    plain = Tokenizer.from_file(PATH)
    for end in ([], [1]):
        ids, n = own.encode(pa.array(texts), end)
        for t, got, e in zip(texts, np.split(ids, np.cumsum(n)[:-1]), plain.encode_batch(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == e.ids + end, t


def test_forgetting_and_slicing_change_nothing(spark, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    rng = random.Random(5)
    texts = pa.array([" ".join("".join(rng.choice("aeinrst,é") for _ in range(6)) for _ in range(rng.randrange(50))) for _ in range(300)])
    want = s8.WordTokenizer(spec).encode(texts, [1])
    monkeypatch.setattr(s8, "WORDS_KEPT", 500)
    monkeypatch.setattr(s8, "TEXT_BYTES", 2000)
    own, runs = s8.WordTokenizer(spec), list(s8._slices(texts))
    assert len(runs) > 20 and sum(n for _, n in runs) == 300
    got = [own.encode(texts.slice(at, n), [1]) for at, n in runs]
    assert [np.concatenate(x).tolist() for x in zip(*got, strict=True)] == [x.tolist() for x in want]


def test_query_reads_back_what_was_written(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i * 7 - 20, t, "c") for i, t in enumerate(ODD)] + [(1, "again", "c"), (1, "again", "c"), (None, "no id", "c")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = s8.op2_simple8b_ids(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    start, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and (last is None or r.doc_id >= last)
        start, last = start + r.n_tokens, r.doc_id


def test_ids_can_be_read_back(spark, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        s8.write_token_files(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), f.read(), f"{tmp_path}/ids", None)
    plain = Tokenizer.from_file(PATH)
    for r in s8.read_token_files(spark, f"{tmp_path}/ids").collect():
        assert r.ids == plain.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, tmp_path, n):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert s8.op2_simple8b_ids(spark, str(tmp_path)).collect() == []
