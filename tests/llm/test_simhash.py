import random

import numpy as np
import xxhash
from cloudloom.llm import simhash
from cloudloom.llm.words import lower_words


def plain_fingerprint(text, size):
    words = lower_words(text)
    cut = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in cut) * 2 > len(cut) for k in range(64)]
    return sum(b << k for k, b in enumerate(bits))


def plain_components(prints, radius):
    low = dict(enumerate(range(len(prints))))
    for _ in prints:
        for i in low:
            low[i] = min(low[j] for j in low if (prints[i] ^ prints[j]).bit_count() <= radius)
    return low


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))


def test_fingerprint_matches_plain_definition():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "one TWO", "É é ok\x0bx", words(rng, 700), *(words(rng, k) for k in range(12))]:
        assert simhash.text_fingerprint(text, 3) == plain_fingerprint(text, 3)


def test_ball_hashing_finds_every_link_of_three_bits(spark):
    rng = random.Random(2)
    prints = []
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 7)):
            prints.append(at)
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4))):
                at ^= 1 << b
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    got = {r.fp: r.root for r in simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = plain_components(prints, 3)
    groups = lambda label: sorted(sorted(i for i in want if label(i) == x) for x in {label(i) for i in want})
    assert groups(lambda i: want[i]) == groups(lambda i: prints.index(np.uint64(np.int64(got[signed[i]]).view(np.uint64))) if signed[i] in got else i)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    base = words(rng, 150)
    texts = [None, "", base, base, base.upper(), base + " x", words(rng, 90), "\t", "solo", words(rng, 30000)]
    rows = [(i * 3 + 5, t, "f", "r") for i, t in enumerate(texts)] + [(None, base, "f", "r"), (5, None, "f", "r")]
    spark.createDataFrame(rows, "doc_id long, text string, fp string, root string").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op3_simhash_near_dedup(spark, str(tmp_path)).collect()
    prints = [plain_fingerprint(r[1], 3) for r in rows]
    low = plain_components(prints, 3)
    want = [(r[0], f"{p:016x}", min(rows[j][0] for j in low if low[j] == low[i] and rows[j][0] is not None)) for i, (r, p) in enumerate(zip(rows, prints, strict=True))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op3_simhash_near_dedup(spark, str(tmp_path)).collect() == []
