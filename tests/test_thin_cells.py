"""Cores of thin cells: one join counts the points around, and points are sent only to cells that they can reach."""

import random

import pytest
from cloudloom.operators import density

SCHEMA = "frame_id long, point_id long, x double, y double, z double"


def clouds():
    rng = random.Random(8)
    grid = [(0, i, float(i % 6), float(i // 6 % 6), float(i // 36) - 3) for i in range(216)]  # many distances are just 2
    clumps = [(1, i, *(9.0 * (i % 7) + rng.gauss(0, (i % 7) / 4) for _ in "xyz")) for i in range(400)]
    copies = [(2, i, *(rng.choice((-4.0, -2.0, 0.0, 2.0, 4.0)) for _ in "xyz")) for i in range(300)]
    return grid + clumps + copies


@pytest.mark.parametrize("least", [1, 6, 18, 32, 57])
def test_equals_all_pairs(spark, least):
    rows = clouds()
    degree = {a[:2]: sum(a[0] == b[0] and a[1] != b[1] and sum((v - u) ** 2 for u, v in zip(a[2:], b[2:], strict=True)) < 4.0 for b in rows) for a in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.frame_id, r.point_id) for r in density.core_points(df, 2.0, least).collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k, n in degree.items() if n >= least}


def test_points_of_thin_cells_are_sent_around_once(spark):
    """Before, they went to 14 cells for each other and to 27 for the full cells."""
    rng = random.Random(9)
    rows = [(0, i, *(rng.uniform(0, 36) for _ in "xyz")) for i in range(5000)] + [(0, 5000 + i, 1.0, 1.0, 1.0 + i / 1000) for i in range(50)]
    cloud, sc = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert density.core_points(cloud, 2.0, 20).count() >= 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled() - before < 32 * len(rows)
