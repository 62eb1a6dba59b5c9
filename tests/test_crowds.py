"""Frames fall apart into crowds of near cells, whose lines are grown whole."""

import math

import numpy as np
import pytest
from cloudloom import schema as S
from cloudloom.operators import lines, polylines

SCHEMA = "frame_id long, point_id long, band int, xy_ang double, z_ang double, depth double"


def frames():
    rng, rows = np.random.default_rng(8), []
    for f in range(3):  # competing lines, of which many points are left to the next band
        ids = rng.permutation(900)
        for k in range(3):
            part = ids[300 * k : 300 * (k + 1)]
            rows += [(f, int(i), int(d > 25), float(x), float(z), float(d)) for i, x, z, d in zip(part, rng.uniform(k, k + 0.3 + 0.6 * f, 300), rng.uniform(0, 0.004, 300), rng.uniform(23, 27, 300), strict=True)]
    rows += [(5, i, 2, 0.02 * i, 0.0, 60.0) for i in range(20)]  # near cells, but no near points
    return rows + [(5, 100, 2, math.nan, 0.0, 60.0), (5, 101, 1, None, 0.0, 30.0)]


def sequential(rows):
    want = set()
    for f in {r[0] for r in rows}:
        rest, mine = [], [r for r in rows if r[0] == f and r[3] is not None and r[3] == r[3]]
        for b in range(len(S.BANDS) - 1):
            here, used = sorted(r for r in mine if r[2] == b) + rest, set()
            for k, line in enumerate(lines.grow_lines(*(np.array([r[c] for r in here]) for c in (3, 4, 5)))):
                want |= {(f, b, k, pos, here[i][1]) for pos, i in enumerate(line)}
                used |= set(line)
            rest = [r for i, r in enumerate(here) if i not in used]
        lost = [r for r in rows if r[0] == f and r not in mine]
        want |= {(f, -1, -1, 0, r[1]) for r in rest + lost}
    return want


@pytest.mark.parametrize("crowd,together", [(1 << 15, 1 << 16), (1 << 15, 100), (310, 1 << 16), (1, 1)])
def test_equals_the_sequential_rule(spark, monkeypatch, crowd, together):
    """Whole crowds, in shares, larger ones by rounds of joins beside smaller ones, and all by rounds."""
    monkeypatch.setattr(polylines, "CROWD", crowd)
    monkeypatch.setattr(polylines, "TOGETHER", together)
    rows = frames()
    got = [(r.frame_id, r.band, r.line_id, r.pos, r.point_id) for r in polylines.find_lines(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    want = sequential(rows)
    assert len(got) == len(rows) and set(got) == want
    assert len({x[:3] for x in want if x[1] == 1}) > 5 and len({x[:3] for x in want if x[1] == 0}) > 5


def test_crowds_of_bounded_size_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(polylines, "lines_of", None)
    assert polylines.find_lines(spark.createDataFrame(frames(), SCHEMA)).where("line_id >= 0").count() > 0
