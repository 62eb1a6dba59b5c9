import os
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from cloudloom.llm import audit

SCHEMA = "doc_id long, text string, lang string, n string, part string, same string, good string, `a.b` string"
FIELDS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, ids, mine):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)), "E": mine is not None and any(i is not None and i < mine for i in ids),
    }


def plain_audit(docs, labels):
    """Every order filtered step by step."""
    same, rows, known = {}, [], [x for x in labels if x[0] is not None]
    for i, t, *_ in docs:
        same.setdefault(t or "", []).append(i)
    for i, t, lang, *_ in docs:
        rows.append((lang or "", fails(t or "", same[t or ""], i), any(a == i and q == 1 for a, q, _ in known), any(a == i and x == 1 for a, _, x in known)))
    out, shares = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in rows if r[0] == part and r[1][f]]
                shares[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "q", "w") for r in rows], SCHEMA)


def texts():
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcdé") for _ in range(k))
    long = [" ".join(word(6) for _ in range(rng.choice((199, 200, 230)))) for _ in range(4)]
    return [None, "", " \t\n", *long, long[0] + " #", long[1].upper(), "to be to be " * 60, "A$ b", "A B   c", long[2] + "\x0b\x0c", "AB" * 3 + "中" * 200]


def test_equals_filtering_in_every_order(spark):
    rng, pool = random.Random(5), texts()
    docs = [(i // 2 if i % 9 == 0 else i, rng.choice(pool), rng.choice(("en", "fr", None, ""))) for i in range(150)]
    docs += [(None, pool[3], "en"), (None, None, "fr"), (7, pool[4], "en"), (7, pool[4], "en"), (7, pool[4], "de")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(audit.joint_failures(audit.failures(table(spark, docs), marks)))
    assert got.columns == list(FIELDS)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


def test_many_copies_and_unlabelled(spark):
    docs = [(i, "same text", "en") for i in range(300)] + [(500, "other", "en")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {(r.filter_order, r.step): r for r in audit.audit(audit.joint_failures(audit.failures(table(spark, docs), none))).collect()}
    assert len(rows) == 600
    assert (rows["EABCD", 1].removed, rows["EABCD", 2].removed, rows["EABCD", 2].redundant, rows["EABCD", 5].kept) == (299, 2, 299, 0)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.joint_failures(audit.failures(table(spark, []), none))).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con, folder = duckdb.connect(), f"/root/testdata/{sf}"
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(folder, t)}.parquet')")
    cur = con.execute(audit.SQL)
    assert [d[0] for d in cur.description] == list(FIELDS)
    assert sorted(map(tuple, audit.op11_filter_audit(spark, folder).collect())) == sorted(cur.fetchall())
