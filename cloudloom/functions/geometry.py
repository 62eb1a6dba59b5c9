"""Geometry as Column expressions, so all of it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudloom import schema as S

XYZ = ("x", "y", "z")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantise(c: Column | str, scale: float) -> Column:
    """v * scale, rounded half away from zero."""
    return F.round(col(c).cast("double") * scale).cast("int")


def dequantise(c: Column | str, scale: float) -> Column:
    return col(c).cast("double") / scale


def quantised(scale: float | tuple[float, float, float]) -> list[Column]:
    """xi, yi, zi with one scale or one an axis."""
    scales = scale if isinstance(scale, tuple) else (scale,) * 3
    return [quantise(c, s).alias(f"{c}i") for c, s in zip(XYZ, scales, strict=True)]


def norm2(x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
    a, b, c = (col(v).cast("double") for v in (x, y, z))
    return a * a + b * b + c * c


def depth(x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> Column:
    return F.sqrt(norm2(x, y, z))


def spherical(x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> list[Column]:
    """xy_ang in [0, 2 pi), z_ang and depth."""
    a, b, c = (col(v).cast("double") for v in (x, y, z))
    turn = F.lit(2 * math.pi)
    return [((F.atan2(b, a) + turn) % turn).alias("xy_ang"), F.atan2(c, F.sqrt(a * a + b * b)).alias("z_ang"), depth(x, y, z).alias("depth")]


def cartesian(xy_ang: Column | str = "xy_ang", z_ang: Column | str = "z_ang", rho: Column | str = "depth") -> list[Column]:
    t, p, r = col(xy_ang), col(z_ang), col(rho)
    return [(r * F.cos(p) * F.cos(t)).alias("x"), (r * F.cos(p) * F.sin(t)).alias("y"), (r * F.sin(p)).alias("z")]


def band(rho: Column, bands: tuple[float, ...] = S.BANDS) -> Column:
    """Index i with bands[i] < rho <= bands[i + 1]; null outside all of them."""
    out = F.when(rho <= bands[0], F.lit(None).cast("int"))
    for i, high in enumerate(bands[1:]):
        out = out.when(rho <= high, F.lit(i))
    return out


def quantised_spherical(resolution: float, max_depth: Column) -> list[Column]:
    """Angles in steps of resolution / max_depth, depth in steps of resolution."""
    step = F.lit(resolution) / max_depth
    return [F.round(F.col("xy_ang") / step).cast("int").alias("qxy"), F.round(F.col("z_ang") / step).cast("int").alias("qz"), F.round(F.col("depth") / resolution).cast("int").alias("qdepth")]


def dequantised_spherical(resolution: float, max_depth: Column) -> list[Column]:
    """xy_ang, z_ang and depth again, from their steps."""
    step = F.lit(resolution) / max_depth
    return [(F.col("qxy") * step).alias("xy_ang"), (F.col("qz") * step).alias("z_ang"), (F.col("qdepth") * resolution).alias("depth")]


def line_thresholds(resolution: float, max_depth: Column) -> list[Column]:
    """Steps between neighbouring points and lines of the sensor, and the depth difference that asks for a reference."""
    step = F.lit(resolution) / max_depth
    across = F.round(F.lit(math.radians(S.THETA_RANGE) / S.WIDTH) / step).cast("int")
    along = F.round(F.lit(math.radians(S.PHI_MAX - S.PHI_MIN) / S.HEIGHT) / step).cast("int")
    return [across.alias("ref_point_th"), along.alias("z_ang_th"), F.lit(int(S.DEPTH_DIFF / resolution)).alias("depth_diff_th")]


def line_distance(dxy: Column, dz: Column, ddepth: Column) -> Column:
    """The anisotropic distance of the line finder."""
    return F.sqrt(dxy * dxy + dz * dz * S.PHI_FACTOR**2 + ddepth * ddepth * S.DEPTH_FACTOR**2)


def cell(c: Column | str, size: float) -> Column:
    return F.floor(col(c).cast("double") / size).cast("long")


def morton(axes: list[str]) -> str:
    """SQL that interleaves non-negative cell numbers, the first axis most significant; it fails on numbers that don't fit 63 bits together."""
    n, bits = len(axes), 63 // len(axes)
    terms = " | ".join(f"shiftleft(shiftright({a}, bit_) & 1L, {n} * bit_ + {n - 1 - k})" for k, a in enumerate(axes))
    fit = " and ".join(f"shiftright({a}, {bits}) = 0" for a in axes)
    return f"if({fit}, aggregate(sequence(0, {bits - 1}), 0L, (code_, bit_) -> code_ | {terms}), raise_error('cell numbers of over {bits} bits'))"


def unmorton(code: str, axes: int) -> list[Column]:
    """The cell numbers of a code, the most significant axis first."""
    return [F.expr(f"aggregate(sequence(0, {63 // axes - 1}), 0L, (cell_, bit_) -> cell_ | shiftleft(shiftright({code}, {axes} * bit_ + {axes - 1 - k}) & 1L, bit_))") for k in range(axes)]
