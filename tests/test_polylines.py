"""Lines by rounds of joins against the sequential rule."""

import numpy as np
import pytest
from cloudloom import schema as S
from cloudloom.operators import lines, polylines
from cloudloom.sources.fixtures import scan
from pyspark.sql import functions as F

SCHEMA = "frame_id long, p long, xy_ang double, z_ang double, depth double"


def plain_lines(frames):
    """(frame, seed, pos, p) by lines.grow_lines."""
    out = []
    for f, (x, z, d) in frames.items():
        seen = set()
        for line in lines.grow_lines(x, z, d):
            out += [(f, pos, p) for pos, p in enumerate(line)]
            assert not seen & set(line)
    return sorted(out)


def frames():
    rng = np.random.default_rng(12)
    made = {}
    for f in range(6):  # crowds: lines compete for points, and many stay short
        n = 250
        made[f] = rng.uniform(0, 0.25, n), rng.uniform(0, 0.004, n), rng.uniform(5, 6, n)
    at = rng.permutation(700) * 0.003  # long lines, side by side, with gaps
    made[6] = np.concatenate((at[at % 0.5 > 0.02], at)), np.concatenate((np.zeros((at % 0.5 > 0.02).sum()), np.full(700, 0.0015))), np.full(700 + (at % 0.5 > 0.02).sum(), 9.0)
    made[7] = np.repeat(np.arange(40) * 0.004, 3), np.tile([0.0, 0.0005, 0.0], 40), np.full(120, 7.0)  # ties and points of one azimuth
    made[8] = np.array([1.0]), np.array([0.0]), np.array([3.0])
    made[9] = np.arange(5) * 0.004, np.zeros(5), np.full(5, 8.0)
    return made


def test_equals_the_sequential_rule(spark):
    made = frames()
    rows = [(f, i, float(x), float(z), float(d)) for f, (xs, zs, ds) in made.items() for i, (x, z, d) in enumerate(zip(xs, zs, ds, strict=True))]
    got = polylines.lines_of(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted((r.frame_id, r.pos, r.p) for r in got) == plain_lines(made)
    assert len({(r.frame_id, r.seed) for r in got}) > 20
    for f in made:
        for line in lines.grow_lines(*made[f]):
            assert len({r.seed for r in got if r.frame_id == f and r.p in set(line)}) == 1


def test_jumps_grow_with_the_logarithm(spark):
    links = spark.range(1000).select(F.lit(0).cast("long").alias("frame_id"), F.lit(1).alias("side"), F.col("id").alias("p"), (F.col("id") + 1).alias("q"))
    tables = polylines.jumps(links)
    assert len(tables) == 5  # 4^4 <= 1000 < 4^5
    points = links.select("frame_id", "p")
    assert {r.end for r in polylines.chain_ends(points, tables).collect()} == {1000}
    got = polylines.chain_points(points.where("p = 17"), tables).collect()
    assert sorted((r.place, r.p) for r in got) == [(i, 17 + i) for i in range(984)]


def test_empty_and_unbanded(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert polylines.lines_of(none).count() == 0
    far = spark.createDataFrame([(0, 1, None, 0.0, 0.0, 300.0)], "frame_id long, point_id long, band int, xy_ang double, z_ang double, depth double")
    assert polylines.find_lines(far).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_bands_of_the_sweep(spark, sf):
    """Band after band over a whole sweep, by the sequential rule on arrays."""
    from cloudloom.functions import geometry as G

    cloud = scan(spark, f"/root/testdata/{sf}").select("frame_id", "point_id", *G.spherical())
    cloud = cloud.withColumn("band", G.band(F.col("depth")))
    rows = [r for r in cloud.collect() if r.band is not None]
    want, rest = set(), []
    for b in range(len(S.BANDS) - 1):
        here = sorted((r for r in rows if r.band == b), key=lambda r: r.point_id) + rest
        used = set()
        for k, line in enumerate(lines.grow_lines(*(np.array([getattr(r, c) for r in here]) for c in ("xy_ang", "z_ang", "depth")))):
            want |= {(b, k, pos, here[i].point_id) for pos, i in enumerate(line)}
            used |= set(line)
        rest = [r for i, r in enumerate(here) if i not in used]
    want |= {(-1, -1, 0, r.point_id) for r in rest}
    assert {(r.band, r.line_id, r.pos, r.point_id) for r in polylines.find_lines(cloud).collect()} == want
