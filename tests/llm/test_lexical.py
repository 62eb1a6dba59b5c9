import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from cloudloom.llm import lexical

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    """All scores of all pairs."""
    counts = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := plain_terms(t))]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 10 + 90 * n * n_docs // length
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, x[2], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    words = ["the", "of", "Été", "naïve", "x1", "中文", "A", "b"] + [f"w{i}" for i in range(60)]
    text = lambda n: rng.choice((" ", "-", ", ")).join(rng.choices(words, [200, 80, 9, 9, 9, 9, 9, 9] + [60 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.choice((1, 3, 20, 80)))) for i in range(400)] + [(400, None), (401, ""), (402, "?! ..."), (403, text(5000)), (None, "w7 w8 w9"), (None, "w7 w8 w9")]
    docs += [(1000 + i, "w50 w51 same text for all") for i in range(200)] + [(3, docs[3][1]), (3, docs[3][1])]
    items = [(i, text(n)) for i, n in enumerate((1, 2, 5, 30, 300))] + [(9, "w50 w51"), (9, "w50 w51"), (None, "w7 W8"), (10, None), (11, ""), (12, "nowhere"), (13, "the"), (14, "w7 w7 w7 w8")]
    return docs, items


SCHEMA = "{} long, text string, n string, item string, ids string, `a.b` string"


def tables(spark, docs, items):
    more = ("p", "q", "r", "s")
    return spark.createDataFrame([(*r, *more) for r in docs], SCHEMA.format("doc_id")).repartition(5), spark.createDataFrame([(*r, *more) for r in items], SCHEMA.format("item_id"))


@pytest.mark.parametrize(("k", "pairs"), [(10, lexical.PAIRS), (1, lexical.PAIRS), (50, 60)])
def test_equals_scoring_every_pair(spark, k, pairs):
    docs, items = corpus()
    got = lexical.search(*tables(spark, docs, items), k=k, pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, k)


def test_empty_tables(spark):
    docs, items = corpus()
    for d, i in (([], items), (docs, []), ([], []), ([(1, None), (2, "-")], items)):
        assert lexical.search(*tables(spark, d, i)).collect() == []


def test_bytes_bound_impacts():
    rng = np.random.default_rng(6)
    tf, m = rng.integers(1, 2000, 5000), rng.integers(10, 100_000, 5000)
    exact = lexical.impacts(tf, m)
    packed = -(-exact // lexical.STEP)
    assert packed.max() <= 255 and (packed * lexical.STEP >= exact).all() and ((packed - 1) * lexical.STEP <= exact).all()
    assert lexical.impacts(np.array([10**7]), np.array([10]))[0] <= 255 * lexical.STEP


def test_index_has_both_levels_of_every_document(spark):
    docs, _ = corpus()
    known = spark.sparkContext.broadcast({b"w7": 0, "中文".encode(): 1, b"none": 2})
    index, weight = lexical.build_index(tables(spark, docs, [])[0], known)
    with_terms = [t for _, t in docs if plain_terms(t)]
    rows = index.collect()
    assert len(rows) == len(with_terms)
    assert sum(sum(r.tfs) for r in rows) == sum(plain_terms(t).count("w7") + plain_terms(t).count("中文") for t in with_terms)
    for r in rows:
        exact = lexical.impacts(np.array(r.tfs, np.int64), np.full(len(r.tfs), r.m))
        assert [int(x) for x in bytes(r.impacts)] == (-(-exact // lexical.STEP)).tolist()
    assert weight[2] == math.floor(1000 * math.log(2 * len(with_terms) + 2))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con, folder = duckdb.connect(), f"/root/testdata/{sf}"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(folder, t)}.parquet')")
    got = lexical.op13_lexical_search(spark, folder)
    cur = con.execute(lexical.SQL)
    assert got.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
