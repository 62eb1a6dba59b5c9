"""Coding a frame by several codecs."""

import dataclasses

import numpy as np
from cloudloom import schema as S
from cloudloom.plans import compress as C


def test_all_codecs_of_a_frame_from_one_pass_over_it(spark, monkeypatch):
    """The same blobs as codec by codec, while a frame's lines are found once."""
    rng = np.random.default_rng(8)
    th = np.tile(np.arange(80) * 0.003, 4)
    rho = 20 + rng.random(320) * 0.05 + 30 * (np.arange(320) % 160 > 80)
    xyz = np.stack((rho * np.cos(th), rho * np.sin(th), rho * np.repeat(np.arange(4) * 0.0075, 80)), 1)
    df = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)], "frame_id long, point_id long, x double, y double, z double")
    keep = ["frame_id", "codec", "n_points", "n_dropped", "blob", "octree_bytes", "line_bytes", "quadtree_bytes"]
    o = S.CompressOptions(0.03, rate=0.05)
    want = sorted(map(tuple, (r for c in S.CODECS for r in C.compress(df, dataclasses.replace(o, codec=c)).select(keep).collect())))
    assert sorted(map(tuple, C.compress_by_codecs(df, o).select(keep).collect())) == want and len(want) == 2 * len(S.CODECS)
    calls, grow = [], C.grow_lines
    monkeypatch.setattr(C, "grow_lines", lambda *a: calls.append(1) or grow(*a))
    C.encode_by_codecs(np.arange(320), xyz, np.zeros(320, bool), o, list(S.CODECS))
    assert len(calls) == 3  # once a band, with what the band before left
