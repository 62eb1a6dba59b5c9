import numpy as np
import pytest
from cloudloom import schema as S
from cloudloom.functions import blocks as B
from cloudloom.functions import codecs as C
from cloudloom.plans.compress import decode_frame, encode_frame


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
@pytest.mark.parametrize("top", [1, 2, 20, 256])
def test_codecs_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    for v in (rng.integers(0, top, n), np.minimum(top - 1, rng.geometric(0.4, n) - 1)):
        assert (C.decode_bytes(C.encode_bytes(v)) == v).all()
        wide = (v - 7) * int(rng.integers(1, 1 << 40))
        assert (C.decode_ints(C.encode_ints(wide)) == wide).all()
        for enc, dec in C.REGISTRY.values():
            assert (dec(enc(v - 3)) == v - 3).all()
    assert C.encode_ints(np.empty(0)) == b""


def test_range_coder_is_near_the_entropy():
    v = np.minimum(255, np.random.default_rng(1).geometric(0.3, 20000))
    p = np.bincount(v) / len(v)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(v)
    assert len(C.encode_bytes(v)) * 8 < bits * 1.02 + 9000


@pytest.mark.parametrize("axes", [2, 3])
@pytest.mark.parametrize("extent", [0, 1, 2, 3, 7, 8, 255, 256, 100000])
def test_trees_keep_every_point_within_half_a_unit(axes, extent):
    cells = np.random.default_rng(extent).integers(-extent, 1, (300, axes))
    cells[0], cells[1] = -extent, 0
    data, order = B.tree_block(cells)
    back = B.tree_points(data, axes)
    assert np.abs(back - cells[order]).max() <= 0.5
    assert B.tree_points(B.tree_block(cells[:0])[0], axes).shape == (0, axes)


def sweep(rng):
    th, ph = np.meshgrid(np.arange(400) * 2 * np.pi / 2000, np.radians(-20 + np.arange(8) * 0.43))
    rho = np.where(th > 0.6, 12.0, 30.0) + rng.normal(0, 0.01, th.shape)
    return np.stack((rho * np.cos(ph) * np.cos(th), rho * np.cos(ph) * np.sin(th), rho * np.sin(ph)), -1).reshape(-1, 3)


@pytest.mark.parametrize("codec", S.CODECS)
@pytest.mark.parametrize("intra", [False, True])
def test_frames_keep_points_and_bound(codec, intra):
    rng = np.random.default_rng(3)
    xyz = np.concatenate((sweep(rng), rng.normal(0, 30, (200, 3)), rng.normal(0, 1, (150, 3)), [[0, 0, 0], [150, 0, 0], [25, 0, 0], [0, 50, 0]]))
    dense = np.zeros(len(xyz), bool)
    dense[-154:-4] = True
    o = S.CompressOptions(0.04, codec=codec, intra_only=intra)
    blob, sizes, order, dropped = encode_frame(np.arange(len(xyz)), xyz, dense, o)
    parts = decode_frame(blob, 0.04)
    back = np.concatenate([p for _, p in parts])
    assert dropped == 0 and sorted(order) == list(range(len(xyz)))
    assert sum(len(p) for n, p in parts if n.startswith("band")) > 2500
    at = 0
    for name, p in parts:
        gap, at = np.abs(p - xyz[order[at : at + len(p)]]), at + len(p)
        assert not len(p) or (gap.max() if "tree" in name else np.linalg.norm(gap, axis=1).max() / np.sqrt(3)) <= 0.02 + 1e-9
    if not intra:
        assert len(blob) < 12 * len(xyz) / 2


def test_compat_drops_far_points_and_small_frames_work():
    xyz = np.array([[150.0, 0, 0], [0, 0, 0], [3, 4, 0]])
    blob, _, order, dropped = encode_frame(np.arange(3), xyz, np.zeros(3, bool), S.CompressOptions(compat=True))
    assert dropped == 2 and order.tolist() == [2]
    for n in (0, 1):
        blob, _, order, _ = encode_frame(np.arange(n), xyz[:n], np.zeros(n, bool), S.CompressOptions())
        assert sum(len(p) for _, p in decode_frame(blob, 0.04)) == n


def test_options():
    assert S.CompressOptions(codec="BZ2").codec == "bzip2" and S.CompressOptions(codec="Entropy").codec == "arithmetic"
    assert S.CompressOptions().by_density and not S.CompressOptions(rate=0.5).by_density
    with pytest.raises(ValueError):
        S.CompressOptions(codec="zip")
