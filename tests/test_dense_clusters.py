"""Clusters of dense clouds: cells are linked by their outermost cores, cores are compared where that leaves cells apart."""

import random

import pytest
from cloudloom.operators import density

SCHEMA = "frame_id long, point_id long, x double, y double, z double"


def brute(rows, eps, least):
    """Labels by pairs of all points, for small frames."""
    near = {a[:2]: [b[:2] for b in rows if b[0] == a[0] and b[1] != a[1] and sum((v - u) ** 2 for u, v in zip(a[2:], b[2:], strict=True)) < eps * eps] for a in rows}
    core = {k for k, v in near.items() if len(v) >= least}
    label, numbers = {}, {}
    for k in sorted(core):
        if k not in label:
            label[k] = numbers[k[0]] = numbers.get(k[0], -1) + 1
            todo = [k]
            while todo:
                for o in near[todo.pop()]:
                    if o in core and o not in label:
                        label[o] = label[k]
                        todo.append(o)
    return {k: label[k] if k in core else min((label[o] for o in near[k] if o in core), default=-1) for k in near}


@pytest.mark.parametrize("spread,least", [(2.2, 3), (3.5, 3), (6.0, 4), (9.0, 2)])
def test_equals_all_pairs(spark, spread, least):
    rng = random.Random(spread)
    rows = [(f, 1000 - i, *(rng.gauss(0, spread) for _ in "xyz")) for f in range(3) for i in range(260)]
    got = density.clusters(spark.createDataFrame(rows, SCHEMA), 2.0, least).collect()
    want = brute(rows, 2.0, least)
    assert len(got) == len(want) and {(r.frame_id, r.point_id): r.cluster_id for r in got} == want


def test_cells_that_outermost_cores_leave_apart(spark):
    """Facing outermost cores are at opposite ends of two cells, inner ones are near."""
    wall = [(0.0, 0.0), (1.0, 1.0), (0.5, 0.5)]
    rows = [(0, i, 0.9 if i == 0 else 0.8, y, z) for i, (y, z) in enumerate(wall)]
    rows += [(0, 10 + i, (2.51, 2.65, 2.7)[i], *((1.0, 1.0), (0.0, 0.0), (0.5, 0.5))[i]) for i in range(3)]
    got = density.clusters(spark.createDataFrame(rows, SCHEMA), 1.95, 1).collect()
    assert {(r.frame_id, r.point_id): r.cluster_id for r in got} == brute(rows, 1.95, 1)


def test_rows_shuffled_grow_with_the_points(spark):
    """A denser cloud of the same extent: before, each point went to all cells around its own, and all pairs of cores were made."""
    rng = random.Random(5)
    rows = [(0, i, *(rng.uniform(0, 7) for _ in "xyz")) for i in range(8000)]
    cloud, sc = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert density.clusters(cloud, 2.0, 20).where("cluster_id = 0").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled() - before < 20 * len(rows)
