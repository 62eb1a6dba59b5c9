import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from cloudloom.llm import exact


def plain_groups(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        first = min(m[:3] for m in members)
        for m in members:
            out.append((rows[m[3]][0], None if first[1] else first[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def shape(found):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.sha256.hex()) for r in found), key=repr)


def rows():
    rng = random.Random(2)
    pool = ["", " ", None, "\t\n", "a b c", "ab c", "a  b\x0bc", "abc ", "é t é", "été", "x" * 40_000, "x " * 20_000, "y\x0c" * 3]
    out = [(i, rng.choice(pool)) for i in range(300)] + [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(300, 500)]
    return out + [(5, "abc"), (5, "abc"), (None, "abc"), (None, "only"), (None, "only"), (None, None), (7, "z z"), (6, "zz ")]


SCHEMA = "doc_id long, text string, entry string, `key` string, at string, `a.b` string"


def table(spark, found):
    return spark.createDataFrame([(*r, "p", "q", "r", "s") for r in found], SCHEMA).repartition(5)


#: Hashes of one value and of few chain unequal texts under a key.
HASHES = {"real": None, "one": lambda text: 77, "few": lambda text: (len(text) % 3) << 62}


@pytest.mark.parametrize("kind", HASHES)
@pytest.mark.parametrize("held", [1 << 25, 50])
def test_groups_are_those_of_equal_bytes(spark, kind, held):
    more = {} if kind == "real" else {"hashed": HASHES[kind]}
    found = exact.exact_groups(table(spark, rows()), limit=200, held=held, **more).collect()
    assert shape(found) == plain_groups(rows())
    kept = {}
    for r in found:
        kept.setdefault(r.sha256, []).append((r.kept, r.doc_id, r.keep_id))
    for group in kept.values():  # one row each, under the name that all of them give
        assert [(d, k) for yes, d, k in group if yes] == [(group[0][2], group[0][2])]


def test_dropping_keeps_columns_and_longest_rows(spark):
    docs = table(spark, rows())
    out = exact.drop_exact_copies(docs)
    assert out.columns == docs.columns
    stay = sorted({(r[1], r[3]) for r in plain_groups(rows())}, key=repr)
    assert sorted(((r.doc_id, hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r.text or "").encode()).hexdigest()) for r in out.collect()), key=repr) == stay


def test_empty_table(spark):
    assert exact.exact_groups(table(spark, [])).collect() == []
    assert exact.drop_exact_copies(table(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [1, 10, 100, 1000])
def test_only_buckets_over_the_limit_split(limit):
    cells = np.random.default_rng(4).integers(0, 60, 64)
    cells[10] = 500
    depths = exact.split_depths(cells, limit)
    for c in range(64):
        d = int(depths[c])
        mine = lambda k: cells[(np.arange(64) >> (6 - k)) == c >> (6 - k)].sum()  # noqa: E731, B023
        assert d == 6 or mine(d) <= limit
        assert all(mine(k) > limit for k in range(d))
        assert (depths[(np.arange(64) >> (6 - d)) == c >> (6 - d)] == d).all()


def test_a_task_writes_one_entry_a_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, "copy" if i % 3 else f"own {i}") for i in range(900)], "doc_id long, text string").repartition(4)
    entries = exact.write_index(docs, f"{tmp_path}/index")
    assert entries.where("text = encode('copy', 'UTF-8')").count() <= 4
    assert entries.groupBy().sum("n").first()[0] == 900 and entries.select("entry").distinct().count() == entries.count()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join('/root/testdata', sf)}/documents.parquet')")
    got = exact.op12_exact_dedup(spark, f"/root/testdata/{sf}")
    cur = con.execute(exact.SQL)
    assert got.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
