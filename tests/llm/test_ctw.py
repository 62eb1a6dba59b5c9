import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cloudloom.llm import ctw
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
D = ctw.DEPTH


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def raw(text):
    return b"\xff" * D + low(text).encode() + b"\xff"


class Tree:
    """The definition: one tree of contexts for each node of a byte, probabilities by recursion."""

    def __init__(self, texts):
        self.count = {}
        for t in texts:
            b = raw(t)
            for i in range(D, len(b)):
                for m in range(8):
                    for d in range(D + 1):
                        k = (1 << m | b[i] >> 8 - m, b[i - d : i])
                        self.count.setdefault(k, [0, 0])[b[i] >> 7 - m & 1] += 1
        self.longer, self.known = {}, {}
        for node, ctx in self.count:
            if ctx:
                self.longer.setdefault((node, ctx[1:]), set()).add(ctx)

    def weighted(self, node, ctx, add=None):
        """log weighted probability of a context's decisions, with one more decision (full context, bit) if given."""
        here = add is not None and add[0][D - len(ctx) :] == ctx
        if not here and (node, ctx) in self.known:
            return self.known[node, ctx]
        n0, n1 = self.count.get((node, ctx), (0, 0))
        n0, n1 = n0 + (here and add[1] == 0), n1 + (here and add[1] == 1)
        out = math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)
        if len(ctx) < D:
            longer = set(self.longer.get((node, ctx), ()))
            if here:
                longer.add(add[0][D - len(ctx) - 1 :])
            out = np.logaddexp(out, sum(self.weighted(node, c, add if here else None) for c in longer)) - math.log(2)
        if not here:
            self.known[node, ctx] = out
        return out

    def score(self, text):
        b, total = raw(text), 0.0
        for i in range(D, len(b)):
            for m in range(8):
                node, bit = 1 << m | b[i] >> 8 - m, b[i] >> 7 - m & 1
                total += self.weighted(node, b"", (b[i - D : i], bit)) - self.weighted(node, b"")
        return total / math.log(10)


def plain_base(train, text):
    c = Counter(w for t in train for w in [*re.findall(WORD, low(t)), ""])
    n, v = c.total(), len(c)
    words = [*re.findall(WORD, low(text)), ""]
    return len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(1)
    texts = [None, "", " ", "Abc abd\nabc", "é中😀 é"] + [" ".join(rng.choice(["the", "Then", "théâtre", "x", "rare%d" % rng.randrange(40)]) for _ in range(rng.randrange(1, 9))) for _ in range(35)]
    return [(i * 5 - 3, t) for i, t in enumerate(texts)] + [(2, "the x"), (2, "the x"), (None, "null id")]


def is_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_scores_are_those_of_the_definition(spark, made, monkeypatch):
    train = [t for i, t in made if not is_out(i)]
    assert 0 < len(train) < len(made)
    tree = Tree(train)
    # every row has a number of its own, by which it is found again; the ids repeat
    want = {k: (i, is_out(i), *plain_base(train, t), tree.score(t)) for k, (i, t) in enumerate(made)}
    df = spark.createDataFrame([(f"{k}:{'' if i is None else i}", i, t) for k, (i, t) in enumerate(made)], "of string, doc_id long, text string")
    monkeypatch.setattr(ctw, "FREQUENT", 5)
    monkeypatch.setattr(ctw, "held_out", lambda c: F.coalesce(F.crc32(F.split(c, ":")[1]) % 7 == 2, F.lit(False)))
    by_path = []
    for most, rows in ((1 << 21, df.repartition(3)), (50, df.orderBy("text")), (0, df.repartition(5, "text"))):  # all grams broadcast, some, none; files or shuffles
        monkeypatch.setattr(ctw, "FREQUENT_GRAMS", most)
        got = {int(r.doc_id.split(":")[0]): r for r in ctw.score_texts(rows, "of").collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[k][1:5]
            assert np.allclose((r.base_score, r.score), want[k][5:], rtol=0, atol=1e-7), made[k]
        by_path.append([(got[k].base_score, got[k].score) for k in sorted(got)])
    assert np.allclose(by_path[0], by_path[1], rtol=0, atol=1e-10) and np.allclose(by_path[0], by_path[2], rtol=0, atol=1e-10)


def test_probabilities_of_all_bytes_sum_to_one(spark, made):
    df = spark.createDataFrame([(t, False) for _, t in made], "text string, held_out boolean")
    grams = ctw.count_grams(df)
    seen = {r.key: r.n for r in grams.collect()}
    contexts = random.Random(3).sample(sorted({k >> 8 for k in seen}), 30) + [0x7A << 32, 0x6162636465]  # two never seen
    every = [(c << 8 | b, seen.get(c << 8 | b, 0), 1) for c in contexts for b in range(256)]
    rest = [(k, n, 1) for k, n in seen.items() if k >> 8 not in set(contexts)]
    logs = {r.key: r.logp for r in ctw.gram_logs(spark.createDataFrame(every + rest, "key long, n long, m long")).collect()}
    assert len(logs) == len(every) + len(rest)
    for c in contexts:
        assert abs(sum(10 ** logs[c << 8 | b] for b in range(256)) - 1) < 1e-9


def test_long_texts_are_laid_out_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 500, 99, 100, 101, 7)]
    whole = [(k.tolist(), np.delete(k, s).tolist()) for _, _, k, s in ctw.layouts(iter(texts))]
    monkeypatch.setattr(ctw, "LAYOUT", 100)
    parts = list(ctw.layouts(iter(texts)))
    assert len(parts) > 5 and [x for _, _, k, s in parts for x in np.delete(k, s).tolist()] == whole[0][1]
    sums = np.zeros(len(texts))
    for of, at, k, s in parts:
        ones = np.ones(len(k))
        ones[s] = 0
        np.add.at(sums, of, np.add.reduceat(ones, at))
    assert sums.tolist() == [len(t) + 1 for t in texts]


def test_held_out_texts_are_likelier_than_noise(spark):
    got = ctw.op9_context_tree_scores(spark, "/root/testdata/sf0.001").where("held_out").toPandas()
    bits = -got.score.sum() * math.log2(10) / (got.n_bytes + 1).sum()
    assert len(got) > 10 and bits < 3.3


def test_empty_and_untrained_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score_texts(none).collect() == []
    out = next(i for i in range(100) if is_out(i))
    (r,) = ctw.score_texts(spark.createDataFrame([(out, "ab")], "doc_id long, text string")).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and abs(r.score + 3 * math.log10(256)) < 1e-5
