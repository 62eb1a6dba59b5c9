"""Edge frames: clustering, splits, trees, lines and whole round trips."""

import math
import random

import numpy as np
import pytest
from cloudloom import schema as S
from cloudloom.functions import geometry as G
from cloudloom.operators import components, density, lines, neighbours, polylines, trees
from cloudloom.plans import compress as C
from pyspark.sql import functions as F

P = "frame_id long, point_id long, x double, y double, z double"


def cloud(spark, xyz, frame=0):
    return spark.createDataFrame([(frame, i, *map(float, p)) for i, p in enumerate(xyz)], P)


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, -0.5, 1.5, -1.5, 2.5, -2.5, 0.49)], "v double")
    assert [r[0] for r in df.select(G.quantise("v", 1.0)).collect()] == [1, -1, 2, -2, 3, -3, 0]


def test_bands_include_their_upper_edge(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.001, 25.0, 25.1, 50.0, 100.0, 100.01)], "v double")
    assert [r[0] for r in df.select(G.band(F.col("v"))).collect()] == [None, 0, 0, 1, 1, 2, None]


def test_neighbours_are_strictly_nearer(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 0.999, 0), (-0.5, -0.5, 0), (0, 0, 0)])
    got = {(r.src, r.dst) for r in neighbours.eps_pairs(df, 1.0).collect()}
    pts = [(0, 0, 0), (1, 0, 0), (0, 0.999, 0), (-0.5, -0.5, 0), (0, 0, 0)]
    assert got == {(i, k) for i, a in enumerate(pts) for k, b in enumerate(pts) if i != k and math.dist(a, b) < 1}
    assert {r.point_id: r.degree for r in neighbours.degrees(df, 0.1).collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(a, a + rng.randrange(1, 4)) for a in range(0, 400) if rng.random() < 0.6] + [(900, 900), (5, 5)] + [(1000 + i, 1001 + i) for i in range(60)]
    rng.shuffle(edges)
    low = {v: v for e in edges for v in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == low
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def blob_at(n, x, rng):
    return [(x + rng.random() * 0.2, rng.random() * 0.2, 0) for _ in range(n)]


def test_cluster_and_core_sizes_at_their_limits(spark):
    rng = random.Random(2)
    xyz = blob_at(301, 20, rng) + blob_at(300, 40, rng) + blob_at(79, 60, rng) + blob_at(78, 80, rng) + blob_at(301, 120, rng)
    df = cloud(spark, xyz)
    labels = density.clusters(df, 1.0)
    assert {r.cluster_id: r.n for r in density.cluster_sizes(labels).collect()} == {0: 301, 1: 300, 2: 79, 3: 301}
    assert labels.where("cluster_id = -1").count() == 78
    dense = density.dense_flags(df, labels).where("dense")
    assert {r.point_id for r in dense.collect()} == set(range(301))


def test_rate_split_takes_the_nearest(spark):
    df = cloud(spark, [(i, 0, 0) for i in (5, 1, 4, 2, 3)])
    assert sorted(r.x for r in density.rate_split(df, 0.5).where("dense").collect()) == [1, 2, 3]


@pytest.mark.parametrize("extent", [0, 1, 2, 3, 4, 7, 8])
def test_tree_depth_and_leaves(spark, extent):
    df = spark.createDataFrame([(0, 0, -extent, 5, 9), (0, 1, 0, 5, 9), (0, 2, 0, 5, 9)], "frame_id long, point_id long, xi int, yi int, zi int")
    strict, closed = trees.placed(df), trees.placed(df, ("xi", "yi"), closed=True)
    assert strict.first().levels == max(1, (extent + 1).bit_length()) and closed.first().levels == max(1, extent.bit_length())
    for placed, names in ((strict, ["lx", "ly", "lz"]), (closed, ["lx", "ly"])):
        rows = placed.collect()
        assert all(0 <= r.lx < 1 << r.levels - 1 or r.levels == 1 and r.lx == 0 for r in rows)
        cells = trees.cells(trees.leaves(placed, names), names).groupBy("level").agg(F.sum("n").alias("n")).collect()
        assert {c.n for c in cells} == {3}


def test_lines_need_six_points_and_do_not_wrap():
    at = lambda n, x0: (x0 + np.arange(n) * 0.003, np.zeros(n), np.full(n, 10.0))
    assert [len(x) for x in lines.grow_lines(*at(6, 1.0))] == [6] and lines.grow_lines(*at(5, 1.0)) == []
    over = tuple(np.concatenate(p) for p in zip(at(6, 0.0), at(6, 2 * np.pi - 0.016), strict=True))
    assert sorted(len(x) for x in lines.grow_lines(*over)) == [6, 6]
    mixed = np.random.default_rng(1).permutation(12)
    (line,) = lines.grow_lines(*(p[mixed] for p in at(12, 1.0)))
    assert mixed[line].tolist() == list(range(12))


def test_leftovers_are_tried_in_the_next_band(spark):
    near = [(0, i, 0, 1.0 + 0.003 * i, 0.0, 24.0) for i in range(4)]
    far = [(0, 10 + i, 1, 1.0 + 0.003 * (i + 4), 0.0, 26.0) for i in range(4)]
    df = spark.createDataFrame(near + far + [(0, 99, 2, 3.0, 0.0, 70.0)], "frame_id long, point_id long, band int, xy_ang double, z_ang double, depth double")
    got = polylines.find_lines(df).collect()
    assert {(r.point_id, r.band) for r in got if r.line_id >= 0} == {(r[1], 1) for r in near + far}
    assert [r.point_id for r in got if r.line_id < 0] == [99]


def test_as_of_takes_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 5, "c")], "k long, t long, v string")
    right = spark.createDataFrame([(1, 5, 50), (1, 2, 20), (1, 12, 120)], "k long, t long, w long")
    back = {r.v: (r.r_t, r.r_w) for r in lines.as_of(left, right, ["k"], "t", ["w"], 3).collect()}
    assert back == {"a": (5, 50), "b": (None, None), "c": (None, None)}
    ahead = {r.v: r.r_w for r in lines.as_of(left, right, ["k"], "t", ["w"], 3, forward=True).collect()}
    assert ahead == {"a": 50, "b": 120, "c": None}


@pytest.mark.parametrize("options", [S.CompressOptions(0.2), S.CompressOptions(0.1, rate=0.2, codec="lzma"), S.CompressOptions(0.1, rate=0, intra_only=True)])
def test_frames_round_trip_within_the_bound(spark, options):
    rng = np.random.default_rng(5)
    th = np.tile(np.arange(300) * 2 * np.pi / 2000, 3)
    ring = np.stack((12 * np.cos(th), 12 * np.sin(th), np.repeat([-1.0, -0.9, -0.8], 300)), 1)
    frames = [np.concatenate((ring, rng.normal(8, 0.4, (400, 3)), rng.normal(0, 40, (60, 3)), [[0, 0, 0], [130, 0, 0]])), np.array([[1.0, 2, 3]])]
    df = cloud(spark, frames[0]).union(cloud(spark, frames[1], 1))
    blobs = C.compress(df, options)
    pairs = C.decompress(blobs).join(C.coding_order(df, options), ["frame_id", "seq"]).collect()
    assert len(pairs) == len(frames[0]) + 1
    for r in pairs:
        gap = np.abs(np.array([r.x, r.y, r.z]) - frames[r.frame_id][r.point_id])
        assert (gap.max() if "tree" in r.path else np.linalg.norm(gap) / math.sqrt(3)) <= options.resolution / 2 + 1e-9
    assert C.metrics(blobs).where("ratio > 0").count() == 2
    assert C.compress(df.where("false"), options).collect() == []


@pytest.mark.parametrize("core_degree", [4, 12])
def test_full_cells_cluster_like_all_pairs(spark, core_degree):
    """Clumps whose cells are core by their numbers alone, thin bridges, borders and noise, against all pairs."""
    rng = np.random.default_rng(core_degree)
    clump = lambda at, n, wide: np.array(at) + rng.uniform(-wide, wide, (n, 3))
    frames = [
        np.concatenate([clump((0, 0, 0), 60, 0.2), clump((1.3, 0, 0), 40, 0.2), clump((5, 5, 5), 30, 0.3), rng.uniform(-4, 8, (60, 3)), np.linspace((5, 5, 5), (8, 5, 5), 9)]),
        np.concatenate([clump((i * 0.9, 0, 0), 12, 0.25) for i in range(7)] + [rng.uniform(-2, 9, (80, 3))]),
    ]
    rows = [(f, i, *map(float, p)) for f, points in enumerate(frames) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double").repartition(5)
    got = {(r.frame_id, r.point_id): r.cluster_id for r in density.clusters(df, 1.0, core_degree).collect()}
    cores = {(r.frame_id, r.point_id) for r in density.core_points(df, 1.0, core_degree).collect()}
    for f, p in enumerate(frames):
        near = ((p[:, None] - p[None]) ** 2).sum(2) < 1.0
        np.fill_diagonal(near, False)
        core = near.sum(1) >= core_degree
        assert {i for g, i in cores if g == f} == set(np.flatnonzero(core).tolist())
        label, names = np.full(len(p), -1), 0
        for i in np.flatnonzero(core):
            if label[i] < 0:
                todo, label[i] = [i], names
                while todo:
                    for k in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                        label[k] = names
                        todo.append(k)
                names += 1
        for i in np.flatnonzero(~core):
            beside = label[near[i] & core]
            label[i] = beside.min() if len(beside) else -1
        assert [got[f, i] for i in range(len(p))] == label.tolist()
