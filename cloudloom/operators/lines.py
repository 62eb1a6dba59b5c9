"""Scan lines: growing them, delta coding them, and the reference points they lean on."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom import schema as S

def grow_lines(xy: np.ndarray, z: np.ndarray, rho: np.ndarray, max_dis: float = S.MAX_DIS, least: int = S.LEAST_LINE) -> list[list[int]]:
    """Greedy lines over one frame's points of a band, in input order.

    A seed grows to the right and then to the left by its nearest unused point
    in that direction, as long as one is nearer than ``max_dis``. Candidates lie
    in the azimuth cells up to ``max_dis`` ahead and in the point's own and the
    nearer neighbouring elevation row; of points of one azimuth later ones lie to the
    right; angles don't wrap. Lines of fewer than
    ``least`` points give theirs back.
    """
    return [line for _, line in seeded_lines(xy, z, rho, max_dis, least)]


def seeded_lines(xy: np.ndarray, z: np.ndarray, rho: np.ndarray, max_dis: float = S.MAX_DIS, least: int = S.LEAST_LINE) -> list[tuple[int, list[int]]]:
    """The lines of ``grow_lines``, each behind its seed."""
    cells: dict[tuple[int, int], list[int]] = defaultdict(list)
    low_x, low_z = (float(a.min()) if len(a) else 0.0 for a in (xy, z))
    cx, cz = ((xy - low_x) // max_dis).astype(int), ((z - low_z) // max_dis).astype(int)
    nearer = np.where((z - low_z) % max_dis < max_dis / 2, -1, 1)
    for i, key in enumerate(zip(cx.tolist(), cz.tolist(), strict=True)):
        cells[key].append(i)
    used = np.zeros(len(xy), bool)

    def step(i: int, sign: int) -> int:
        rows = sorted((int(cz[i]), int(cz[i] + nearer[i])))
        near = [k for a in sorted((int(cx[i]), int(cx[i]) + sign)) for b in rows for k in cells.get((a, b), ())]
        ids = np.array(near, int)
        ids = np.sort(ids[~used[ids]])  # the first of equally near ones
        dx, dz, dd = xy[ids] - xy[i], z[ids] - z[i], rho[ids] - rho[i]
        ahead = ((dx > 0) | (dx == 0) & (ids > i) if sign > 0 else dx < 0) & (np.abs(dx) <= max_dis) & (np.abs(dz) <= S.PHI_FACTOR * max_dis)
        d = np.sqrt(dx * dx + (dz * S.PHI_FACTOR) ** 2 + (dd * S.DEPTH_FACTOR) ** 2)
        d[~ahead] = np.inf
        best = int(np.argmin(d)) if len(d) else -1
        return int(ids[best]) if best >= 0 and d[best] < max_dis else -1

    lines = []
    for seed in range(len(xy)):
        if used[seed]:
            continue
        used[seed] = True
        right, left = [seed], []
        while (k := step(right[-1], 1)) >= 0:
            used[k] = True
            right.append(k)
        while (k := step(left[-1] if left else seed, -1)) >= 0:
            used[k] = True
            left.append(k)
        line = left[::-1] + right
        if len(line) >= least:
            lines.append((seed, line))
        else:
            used[line] = False
    return lines


def deltas(points: DataFrame, line: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each column less the point before on the line; a line's first point keeps its values."""
    by = Window.partitionBy(*line).orderBy(order)
    return points.select(*line, order, *[(F.col(c) - F.lag(c, 1, 0).over(by)).alias(f"d_{c}") for c in columns])


def line_heads(points: DataFrame, line: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each line's first values."""
    return points.groupBy(*line).agg(*[F.min_by(c, order).alias(c) for c in columns])


def head_deltas(heads: DataFrame, keys: list[str], columns: list[str], tie: str) -> DataFrame:
    """Differences of consecutive heads, lines in order of elevation and then azimuth."""
    by = Window.partitionBy(*keys).orderBy("qz", "qxy", tie)
    return heads.select(*keys, tie, *[(F.col(c) - F.lag(c).over(by)).alias(f"d_{c}") for c in columns])


def references_within(heads: DataFrame, keys: list[str], tie: str, reach: str) -> DataFrame:
    """``(keys, tie, references)``: how many lines before each, in order of elevation and then azimuth, start at most ``reach`` below it.

    ``heads`` has qz, qxy and ``reach``, one value for all lines of a key. Lines meet
    on their elevation's step of that length or the next one, so it is an equi-join.
    """
    step = F.floor(F.col("qz") / F.col(reach))
    low = heads.select(*keys, F.col("qz").alias("z0"), F.struct("qz", "qxy", tie).alias("before"), F.explode(F.array(step, step + 1)).alias("step"))
    high = heads.select(*keys, tie, "qz", reach, F.struct("qz", "qxy", tie).alias("here"), step.alias("step"))
    met = high.join(low, [*keys, "step"]).where((F.col("before") < F.col("here")) & (F.col("qz") - F.col("z0") <= F.col(reach)))
    counts = met.groupBy(*keys, tie).agg(F.count("*").alias("references"))
    return heads.select(*keys, tie).join(counts, [*keys, tie], "left").withColumn("references", F.coalesce("references", F.lit(0).cast("long")))


def as_of(points: DataFrame, reference: DataFrame, keys: list[str], on: str, values: list[str], tolerance: Column | int, forward: bool = False) -> DataFrame:
    """``points`` with r_<on> and r_<value> of the last reference at or before their ``on`` (or the first at or after).

    A union of both sides and one window, so it is a sort by (keys, on) and no
    join; references farther away than ``tolerance`` count as none.
    """
    names = [c for c in points.columns if c not in keys and c != on]
    left = points.select(*keys, on, F.lit(0 if forward else 1).alias("_s"), F.lit(None).alias("_r"), F.struct(*names).alias("_p"))
    right = reference.select(*keys, on, F.lit(1 if forward else 0).alias("_s"), F.struct(F.col(on).alias("k"), *values).alias("_r"), F.lit(None).alias("_p"))
    by = Window.partitionBy(*keys)
    by = by.orderBy(on, "_s").rowsBetween(Window.unboundedPreceding, 0) if not forward else by.orderBy(F.desc(on), F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_r", F.last("_r", ignorenulls=True).over(by)).where("_p is not null")
    near = F.abs(F.col(on) - F.col("_r.k")) <= tolerance
    return found.select(*keys, on, "_p.*", F.when(near, F.col("_r.k")).alias(f"r_{on}"), *[F.when(near, F.col(f"_r.{v}")).alias(f"r_{v}") for v in values])
