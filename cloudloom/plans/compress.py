"""Error-bounded compression of frames: table of points to table of blobs, and back.

Clustering, the dense/sparse split and all statistics are joins and aggregations
on Spark. A frame is one sweep of the sensor, so what is left per frame (growing
lines, coding) is of bounded size and runs as one grouped function a frame.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cloudloom import schema as S
from cloudloom.functions import blocks as B
from cloudloom.functions import geometry as G
from cloudloom.operators import density
from cloudloom.operators.lines import grow_lines

BLOBS = "frame_id long, n_points long, n_dropped long, resolution double, codec string, blob binary, octree_bytes long, line_bytes long, quadtree_bytes long, seconds double"
DECODED = "frame_id long, seq long, path string, x double, y double, z double"
ORDER = "frame_id long, seq long, point_id long"


def split(points: DataFrame, options: S.CompressOptions) -> DataFrame:
    """``points`` with ``dense``."""
    if not options.by_density:
        return density.rate_split(points, options.rate)
    return density.dense_flags(points, density.clusters(points, S.EPS_SCALE * options.resolution))


def encode_frame(ids: np.ndarray, xyz: np.ndarray, dense: np.ndarray, o: S.CompressOptions) -> tuple[bytes, list[int], np.ndarray, int]:
    """(blob, bytes of octree, lines and quadtree, ids in decoding order, dropped points) of one frame in id order."""
    ((blob, sizes),), kept, dropped = encode_by_codecs(ids, xyz, dense, o, [o.codec])
    return blob, sizes, kept, dropped


def encode_by_codecs(ids: np.ndarray, xyz: np.ndarray, dense: np.ndarray, o: S.CompressOptions, codecs: list[str]) -> tuple[list[tuple[bytes, list[int]]], np.ndarray, int]:
    """(blob and bytes of octree, lines and quadtree by each codec, ids in decoding order, dropped points) of one frame in id order: its lines are found once."""
    r, kept = o.resolution, []
    octree, order = B.tree_block(B.half_away(xyz[dense] * (2 / r)))
    kept.append(ids[dense][order])
    sparse, left = np.flatnonzero(~dense), np.empty(0, np.int64)
    x, y, z = xyz.T
    rho = np.sqrt(x * x + y * y + z * z)
    xy_ang, z_ang = np.mod(np.arctan2(y, x) + 2 * np.pi, 2 * np.pi), np.arctan2(z, np.sqrt(x * x + y * y))
    line_blocks = []
    for low, high in zip(S.BANDS, S.BANDS[1:], strict=False):
        here = np.concatenate((sparse[(rho[sparse] > low) & (rho[sparse] <= high)], left))
        deepest = float(rho[here].max()) if len(here) else 1.0
        found = grow_lines(xy_ang[here], z_ang[here], rho[here]) if len(here) else []
        q = np.stack((B.half_away(xy_ang[here] / (r / deepest)), B.half_away(z_ang[here] / (r / deepest)), B.half_away(rho[here] / r)), 1)
        coded, order = B.line_blocks([q[i] for i in found], deepest, r, codecs, o.intra_only)
        line_blocks.append(coded)
        kept += [ids[here[found[i]]] for i in order]
        left = np.delete(here, np.concatenate(found)) if found else here
    far = sparse[(rho[sparse] > S.BANDS[-1]) | (rho[sparse] == 0)]
    rest = left if o.compat else np.concatenate((left, far))
    cells = B.half_away(xyz[rest] * np.array([2 / r, 2 / r, 1 / r]))
    quadtree, order = B.tree_block(cells[:, :2])
    heights = B.encode_ints(np.diff(cells[order, 2], prepend=0))
    kept.append(ids[rest][order])
    out = []
    for codec, lines in zip(codecs, zip(*line_blocks, strict=True), strict=True):
        body = B.pack(struct.pack("<f?", r, o.compat), codec.encode(), octree, *lines, quadtree, heights)
        out.append((body, [len(octree), sum(map(len, lines)), len(quadtree) + len(heights)]))
    return out, np.concatenate(kept), len(far) if o.compat else 0


def decode_frame(blob: bytes, r: float) -> list[tuple[str, np.ndarray]]:
    """(path, points) in decoding order; ``r`` is the resolution the frame was coded with."""
    head, codec, octree, *bands, quadtree, heights = B.unpack(blob)
    _, compat = struct.unpack("<f?", head)
    out = [("octree", B.tree_points(octree, 3, compat) / (2 / r))]
    for i, block in enumerate(bands):
        found, deepest = B.block_lines(block, r, codec.decode())
        q = np.concatenate(found) if found else np.empty((0, 3))
        t, p, d = q[:, 0] * (r / deepest if found else 1), q[:, 1] * (r / deepest if found else 1), q[:, 2] * r
        out.append((f"band{i}", np.stack((d * np.cos(p) * np.cos(t), d * np.cos(p) * np.sin(t), d * np.sin(p)), 1)))
    flat = B.tree_points(quadtree, 2, compat) / (2 / r)
    z = np.cumsum(B.decode_ints(heights)) * r
    return [*out, ("quadtree", np.column_stack((flat, z)) if len(flat) else np.empty((0, 3)))]


def _encoded(pdf: pd.DataFrame, o: S.CompressOptions) -> tuple[bytes, list[int], np.ndarray, int]:
    pdf = pdf.sort_values("point_id", kind="stable")
    return encode_frame(pdf.point_id.to_numpy(), pdf[["x", "y", "z"]].to_numpy(float), pdf.dense.to_numpy(bool), o)


def compress(points: DataFrame, options: S.CompressOptions = S.CompressOptions()) -> DataFrame:
    """One BLOBS row for each frame of ``points`` (frame_id, point_id, x, y, z); no points, no rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.time()
        blob, sizes, _, dropped = _encoded(pdf, options)
        return pd.DataFrame([[pdf.frame_id.iloc[0], len(pdf), dropped, options.resolution, options.codec, blob, *sizes, time.time() - began]])

    rows = split(points.select("frame_id", "point_id", *G.XYZ), options)
    return rows.groupBy("frame_id").applyInPandas(one, BLOBS)


def compress_by_codecs(points: DataFrame, options: S.CompressOptions, codecs: tuple[str, ...] = S.CODECS) -> DataFrame:
    """BLOBS rows of every codec for each frame, as ``compress`` gives one by one; ``seconds`` are those of all together."""

    def all_of(pdf: pd.DataFrame) -> pd.DataFrame:
        began, pdf = time.time(), pdf.sort_values("point_id", kind="stable")
        coded, _, dropped = encode_by_codecs(pdf.point_id.to_numpy(), pdf[["x", "y", "z"]].to_numpy(float), pdf.dense.to_numpy(bool), options, list(codecs))
        spent = time.time() - began
        return pd.DataFrame([[pdf.frame_id.iloc[0], len(pdf), dropped, options.resolution, codec, blob, *sizes, spent] for codec, (blob, sizes) in zip(codecs, coded, strict=True)])

    return split(points.select("frame_id", "point_id", *G.XYZ), options).groupBy("frame_id").applyInPandas(all_of, BLOBS)


def coding_order(points: DataFrame, options: S.CompressOptions = S.CompressOptions()) -> DataFrame:
    """``(frame_id, seq, point_id)``: which point each decoded one was; for checking errors."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = _encoded(pdf, options)[2]
        return pd.DataFrame({"frame_id": pdf.frame_id.iloc[0], "seq": range(len(ids)), "point_id": ids})

    return split(points.select("frame_id", "point_id", *G.XYZ), options).groupBy("frame_id").applyInPandas(one, ORDER)


def decompress(blobs: DataFrame) -> DataFrame:
    """DECODED rows of ``blobs`` (frame_id, resolution, blob), frame by frame without a shuffle; a null blob has no points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, r, blob in b.itertuples(index=False):
                if blob is None:
                    continue
                parts = decode_frame(blob, r)
                xyz = np.concatenate([p for _, p in parts])
                path = np.repeat([n for n, _ in parts], [len(p) for _, p in parts])
                yield pd.DataFrame({"frame_id": frame, "seq": range(len(xyz)), "path": path, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return blobs.select("frame_id", "resolution", "blob").mapInPandas(run, DECODED)


def metrics(blobs: DataFrame) -> DataFrame:
    """Sizes in bits and the ratio of 12 bytes a point to the blob."""
    size = F.octet_length("blob")
    return blobs.select("frame_id", "n_points", (F.col("n_points") * 96).alias("raw_bits"), (size * 8).cast("long").alias("comp_bits"), (F.col("n_points") * 12 / size).alias("ratio"), "octree_bytes", "line_bytes", "quadtree_bytes", "seconds")


def write_measured(blobs: DataFrame, path: str) -> dict[str, float]:
    """Write BLOBS rows over ``path``; what was written in all is observed by the pass that writes, so nothing is coded or read twice.

    Sizes before and after are in bits, those of the paths in bytes; ``seconds`` are those of all frames' coding.
    """
    seen, size = Observation(), F.octet_length("blob")
    sums = {"frames": F.lit(1), "n_points": F.col("n_points"), "n_dropped": F.col("n_dropped"), "raw_bits": F.col("n_points") * 96, "comp_bits": size * 8} | {c: F.col(c) for c in ("octree_bytes", "line_bytes", "quadtree_bytes", "seconds")}
    blobs.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]).write.mode("overwrite").parquet(path)
    got = seen.get
    return got | {"ratio": got["raw_bits"] / got["comp_bits"] if got["comp_bits"] else 0.0}
