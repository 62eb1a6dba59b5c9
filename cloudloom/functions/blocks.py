"""One frame's parts as bytes: tree blocks and line blocks, and back."""

from __future__ import annotations

import math
import struct

import numpy as np

from cloudloom import schema as S
from cloudloom.functions.codecs import REGISTRY, decode_bytes, decode_ints, encode_bytes, encode_ints

BL, UR, UM, UL = range(4)


def half_away(v: np.ndarray) -> np.ndarray:
    """Rounded half away from zero, as integers."""
    return np.trunc(v + np.copysign(0.5, v)).astype(np.int64)


def pack(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<q", len(p)) + p for p in parts)


def unpack(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<q", data, at)
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


# --- trees ---------------------------------------------------------------------------------------


def interleave(cells: np.ndarray, bits: int) -> np.ndarray:
    """Morton codes of (n x axes) cells, the first axis most significant."""
    axes, out = cells.shape[1], np.zeros(len(cells), np.int64)
    for i in range(bits):
        for k in range(axes):
            out |= ((cells[:, k] >> i) & 1) << (axes * i + axes - 1 - k)
    return out


def separate(codes: np.ndarray, axes: int, bits: int) -> np.ndarray:
    out = np.zeros((len(codes), axes), np.int64)
    for i in range(bits):
        for k in range(axes):
            out[:, k] |= ((codes >> (axes * i + axes - 1 - k)) & 1) << i
    return out


def tree_block(cells: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Occupancy and leaf counts of integer points, and the order in which a decoder will see them."""
    if not len(cells):
        return b"", np.empty(0, np.int64)
    low, axes = cells.min(0), cells.shape[1]
    levels = max(1, int((cells.max(0) - low).max() + 1).bit_length())
    codes = interleave((cells - low + 1) >> 1, levels)
    order = np.argsort(codes, kind="stable")
    leaf, counts = np.unique(codes, return_counts=True)
    bytes_, at = [], leaf
    for _ in range(levels - 1):
        parent, of = np.unique(at >> axes, return_inverse=True)
        bits = np.zeros(len(parent), np.int64)
        np.bitwise_or.at(bits, of, 1 << (at & ((1 << axes) - 1)))
        bytes_.insert(0, bits)
        at = parent
    tree = encode_bytes(np.concatenate(bytes_)) if bytes_ else b""
    many = encode_ints(counts) if (counts > 1).any() else b""
    return pack(struct.pack(f"<{axes}qi", *low.tolist(), levels), tree, many), order


def tree_points(data: bytes, axes: int, compat: bool = False) -> np.ndarray:
    """Decoded coordinates in units: leaf centres, or their parents' in ``compat`` mode."""
    if not data:
        return np.empty((0, axes))
    head, tree, many = unpack(data)
    *low, levels = struct.unpack(f"<{axes}qi", head)
    occupied, codes, at = decode_bytes(tree), np.zeros(1, np.int64), 0
    for _ in range(levels - 1):
        here = occupied[at : at + len(codes)]
        at += len(codes)
        child = (here[:, None] >> np.arange(1 << axes)) & 1 == 1
        codes = ((codes << axes)[:, None] | np.arange(1 << axes))[child]
    counts = decode_ints(many) if many else np.ones(len(codes), np.int64)
    leaf = separate(codes, axes, levels)
    centre = (leaf >> 1) * 4 + 2 if compat else leaf * 2 + 0.5
    return np.repeat(np.array(low) - 1 + centre, counts, axis=0)


# --- lines ---------------------------------------------------------------------------------------


def thresholds(resolution: float, max_depth: float) -> tuple[int, int, int]:
    """Azimuth and elevation steps between the sensor's neighbours, and the depth difference that asks for a reference."""
    step = resolution / max_depth
    across = half_away(np.array(math.radians(S.THETA_RANGE) / S.WIDTH / step))
    along = half_away(np.array(math.radians(S.PHI_MAX - S.PHI_MIN) / S.HEIGHT / step))
    return int(across), int(along), int(S.DEPTH_DIFF / resolution)


class References:
    """The consensus of earlier lines near the current one: later lines replace the azimuths they span."""

    def __init__(self, along: int):
        self.along, self.lines = along, []

    def consensus(self, elevation: int) -> tuple[np.ndarray, np.ndarray]:
        self.lines = [x for x in self.lines if elevation - x[1][0] <= self.along]
        xy, depth = np.empty(0, np.int64), np.empty(0, np.int64)
        for axy, _, ad in self.lines:
            outside = (xy < axy[0]) | (xy > axy[-1])
            xy, depth = np.concatenate((xy[outside], axy)), np.concatenate((depth[outside], ad))
            order = np.argsort(xy, kind="stable")
            xy, depth = xy[order], depth[order]
        return xy, depth

    def add(self, line: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.lines.append(line)


def before(xy: np.ndarray, at: int, across: int) -> int:
    """The last reference at or before ``at``, near enough and not the final one; -1 for none."""
    left = int(np.searchsorted(xy, at, "right")) - 1
    return left if 0 <= left < len(xy) - 1 and at - xy[left] <= across else -1


def candidates(xy: np.ndarray, depth: np.ndarray, at: int, then: int, here: int, across: int, jump: int) -> tuple[int, int, int, int] | None:
    """Depths (BL, UR, UM, UL) to choose from for the point at ``then``, if the references' depths disagree."""
    left = before(xy, at, across)
    if left < 0:
        return None
    right = max(left + 1, int(np.searchsorted(xy, then, "left")))
    if right >= len(xy) or xy[right] - then > across:
        return None
    ul, um, ur = int(depth[left]), int(depth[right - 1]), int(depth[right])
    if max(abs(ur - ul), abs(ur - here), abs(ul - here)) <= jump:
        return None
    return here, ur, um, ul


def choose(options: tuple[int, int, int, int], depth: int) -> int:
    """The nearest in depth; UL only if strictly nearest, then UM, then UR, else BL."""
    d = [abs(o - depth) for o in options]
    if d[UL] < min(d[UM], d[UR], d[BL]):
        return UL
    if d[UM] < min(d[UR], d[BL]):
        return UM
    return UR if d[UR] < d[BL] else BL


def routes(codec: str) -> dict[str, str]:
    """Which codec codes which stream."""
    wide = "deflate" if codec == "arithmetic" else codec
    return {"lengths": "arithmetic", "head_dx": wide, "head_dy": "arithmetic", "head_dd": codec, "dx": wide, "dy": "arithmetic", "dd": codec, "refs": "arithmetic"}


def line_blocks(lines: list[np.ndarray], max_depth: float, resolution: float, codecs: list[str], intra: bool) -> tuple[list[bytes], list[int]]:
    """Quantised lines (points x 3: azimuth, elevation, depth) as bytes by each codec, and the order of the lines in them."""
    if not lines:
        return [b""] * len(codecs), []
    order = sorted(range(len(lines)), key=lambda i: (lines[i][0, 1], lines[i][0, 0]))
    across, along, jump = thresholds(resolution, max_depth)
    out: dict[str, list[int]] = {k: [] for k in routes(codecs[0])}
    refs, last = References(along), np.zeros(3, np.int64)
    for i in order:
        xy, z, d = lines[i].T
        rxy, rd = refs.consensus(int(z[0])) if not intra else (np.empty(0), np.empty(0))
        left = before(rxy, int(xy[0]), across)
        out["lengths"].append(len(xy))
        out["head_dx"].append(int(xy[0] - last[0]))
        out["head_dy"].append(int(z[0] - last[1]))
        out["head_dd"].append(int(d[0] - (rd[left] if left >= 0 else last[2])))
        out["dx"] += np.diff(xy).tolist()
        out["dy"] += np.diff(z).tolist()
        for j in range(len(xy) - 1):
            options = candidates(rxy, rd, int(xy[j]), int(xy[j + 1]), int(d[j]), across, jump)
            base = int(d[j])
            if options:
                pick = choose(options, int(d[j + 1]))
                out["refs"].append(pick)
                base = options[pick]
            out["dd"].append(int(d[j + 1]) - base)
        refs.add((xy, z, d))
        last = lines[i][0]
    coded = {(k, c): REGISTRY[c][0](np.array(out[k], np.int64)) for k, c in dict.fromkeys(r for codec in codecs for r in routes(codec).items())}
    return [pack(struct.pack("<d?", max_depth, intra), *[coded[r] for r in routes(codec).items()]) for codec in codecs], order


def line_block(lines: list[np.ndarray], max_depth: float, resolution: float, codec: str, intra: bool) -> tuple[bytes, list[int]]:
    """``line_blocks`` by one codec."""
    (block,), order = line_blocks(lines, max_depth, resolution, [codec], intra)
    return block, order


def block_lines(data: bytes, resolution: float, codec: str) -> tuple[list[np.ndarray], float]:
    """The quantised lines of a block, and its maximal depth."""
    if not data:
        return [], 0.0
    head, *streams = unpack(data)
    max_depth, intra = struct.unpack("<d?", head)
    s = {k: REGISTRY[c][1](x).tolist() for (k, c), x in zip(routes(codec).items(), streams, strict=True)}
    across, along, jump = thresholds(resolution, max_depth)
    refs, last, out, at, ref_at = References(along), [0, 0, 0], [], 0, 0
    for i, n in enumerate(s["lengths"]):
        x0, z0 = last[0] + s["head_dx"][i], last[1] + s["head_dy"][i]
        xy = np.cumsum([x0, *s["dx"][at : at + n - 1]])
        z = np.cumsum([z0, *s["dy"][at : at + n - 1]])
        rxy, rd = refs.consensus(int(z0)) if not intra else (np.empty(0), np.empty(0))
        left = before(rxy, int(x0), across)
        d = [s["head_dd"][i] + int(rd[left] if left >= 0 else last[2])]
        for j in range(n - 1):
            options = candidates(rxy, rd, int(xy[j]), int(xy[j + 1]), d[j], across, jump)
            base = d[j]
            if options:
                base = options[s["refs"][ref_at]]
                ref_at += 1
            d.append(base + s["dd"][at + j])
        at += n - 1
        line = np.stack((xy, z, np.array(d, np.int64)), 1)
        refs.add(tuple(line.T))
        last = line[0].tolist()
        out.append(line)
    return out, max_depth
