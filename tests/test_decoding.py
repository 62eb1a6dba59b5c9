"""Sweeps by ranges, trees decoded from their sequences, counts rescaled: against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from cloudloom.functions import codecs
from cloudloom.functions import geometry as G
from cloudloom.operators import places, symbols, trees
from cloudloom.plans.decoding import stored
from pyspark.sql import functions as F

FRAMES = {
    "one leaf": [(5, 5, 5)] * 3,
    "two": [(0, 0, 0), (9, 0, 0)],
    "power of two": [(0, 0, 0), (64, 64, 64), (63, 1, 0)],
    "negative": [(-100, -7, -3), (-1, -90, -50)],
    "crowd": [tuple(random.Random(i).randrange(-500, 500) for _ in range(3)) for i in range(900)],
    "line": [(i, 0, 0) for i in range(0, 4000, 3)],
}


@pytest.mark.parametrize("axes", [("xi", "yi", "zi"), ("xi", "yi")])
def test_sequences_give_the_leaves_back(spark, axes):
    rows = [(f, i, *p) for f, points in enumerate(FRAMES.values()) for i, p in enumerate(points)]
    points = trees.placed(spark.createDataFrame(rows, "frame_id long, point_id long, xi int, yi int, zi int").repartition(6), axes)
    names = [f"l{a[0]}" for a in axes]
    got = trees.decoded_leaves(*stored(points, names), len(axes)).select("frame_id", *G.unmorton("morton", len(axes)), "n").collect()
    want = Counter()
    for f, each in enumerate(FRAMES.values()):
        low = [min(p[k] for p in each) for k in range(len(axes))]
        want.update((f, *((p[k] - low[k] + 1) >> 1 for k in range(len(axes)))) for p in each)
    assert {tuple(r[:-1]): r[-1] for r in got} == want


def test_children_follow_the_bits_before_them(spark):
    occupancy = [0b10000001, 0b00000010, 0b01010000]
    seq = spark.createDataFrame([(4, i, o) for i, o in enumerate(occupancy)], "frame_id long, place long, occupancy int")
    assert sorted(tuple(r)[1:] for r in trees.children(seq, 3).collect()) == [(1, 0, 0), (2, 0, 7), (3, 1, 1), (4, 2, 4), (5, 2, 6)]


def test_codes_keep_all_bits_or_fail(spark):
    top = (1 << 31) - 1
    df = spark.createDataFrame([(top, 0), (0, top), (top, 1 << 30), (5, 9)], "a long, b long")
    back = df.withColumn("m", F.expr(G.morton(["a", "b"]))).select("a", "b", *[c.alias(n) for n, c in zip("xy", G.unmorton("m", 2), strict=True)]).collect()
    assert all((r.a, r.b) == (r.x, r.y) for r in back)
    with pytest.raises(Exception, match="21 bits"):
        df.select(F.expr(G.morton(["a", "b", "b"]))).collect()


def test_sweeps_equal_running_over_each_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab") if rng.random() < 0.9 else None, k, rng.choice((None, *range(-5, 6)))) for k in rng.sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "key string, o long, v int").where("key is not null").repartition(5)
    got = {(r.key, r.o): (r.place, r.total_v, r.last_v, r.last_o) for r in places.swept(df, ["key"], ["o"], ("v",), ("v", "o")).collect()}
    want = {}
    for key in "ab":
        total, last = 0, (None, None)
        for place, (o, v) in enumerate(sorted((o, v) for k, o, v in rows if k == key)):
            total += v or 0
            want[key, o] = place, total, *last
            last = v, o
    assert got == want
    assert places.swept(df.where("false"), ["key"], ["o"], ("v",), ("v",)).count() == 0


@pytest.mark.parametrize("limit", [1 << 6, 1 << 16, 1 << 48])
def test_rescaling_halves_as_often_as_it_takes(spark, limit):
    rng = np.random.default_rng(3)
    tables = {0: [1], 1: [1 << 55, 3], 2: rng.integers(1, 1 << 40, 50).tolist(), 3: [limit - 1] if limit < 1 << 40 else [7], 4: [1] * 64}
    df = spark.createDataFrame([(k, s, n) for k, t in tables.items() for s, n in enumerate(t)], "k int, symbol int, n long")
    got = {}
    for r in symbols.rescaled(df, ["k"], limit).orderBy("k", "symbol").collect():
        got.setdefault(r.k, []).append(r.scaled)
    for k, t in tables.items():
        if len(t) < limit:
            assert got[k] == codecs._scaled(np.array(t, np.int64), limit).tolist()
        else:
            assert got[k] == [None] * len(t)


def test_streams_that_fit_bytes(spark):
    df = spark.createDataFrame([(1, 255), (1, -3), (2, 256), (2, 0)], "k int, v int")
    assert {r.k: (r.n, r.largest, r.narrow, r.bytes) for r in symbols.narrow_streams(df, ["k"], "v").collect()} == {1: (2, 255, True, 2), 2: (2, 256, False, 8)}


def test_counts_fall_on_the_symbols_of_their_ranges(spark):
    table = spark.createDataFrame([(k, s, n, c) for k, rows in {1: [(0, 3, 0), (5, 0, 3), (7, 2, 3)], 2: [(9, 1, 0)]}.items() for s, n, c in rows], "k int, symbol int, n long, cum long")
    counts = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 0), (2, 1), (3, 0)], "k int, count long").withColumn("tag", F.lit("t"))
    got = {(r["k"], r["count"]): (r.symbol, r.low) for r in symbols.symbols_at(counts, table, ["k"], "count").collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (0, 0), (1, 2): (0, 0), (1, 3): (7, 3), (1, 4): (7, 3), (1, 5): (None, None), (2, 0): (9, 0), (2, 1): (None, None), (3, 0): (None, None)}
    stream = spark.createDataFrame([(1, 7), (1, 8)], "k int, s int")
    assert sorted(map(tuple, symbols.ranges(stream, table, ["k"], "s").collect()), key=str) == [(1, 7, 3, 5), (1, 8, None, None)]
