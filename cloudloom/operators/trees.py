"""Octrees and quadtrees without trees: cells are bit prefixes, nodes are groups.

A frame's root starts one unit below its smallest coordinates; D is the number of
levels. At level l (1 is the root, D the leaves) a point with offset u has cell
u >> (D - l + 1). Breadth-first order is the order of (level, Morton code).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators.places import swept
from cloudloom.workspace import materialise, release


def bit_length(e: str) -> str:
    return f"cast(length(bin({e})) as int)"


def placed(ipoints: DataFrame, axes: tuple[str, ...] = ("xi", "yi", "zi"), closed: bool = False) -> DataFrame:
    """Points with ``depth`` (levels) and leaf cells lx, ly(, lz).

    ``closed`` is the quadtree's original bound, under which the largest
    coordinate may fall on the root's far edge; its leaf is clamped.
    """
    box = ipoints.groupBy("frame_id").agg(*[F.min(a).cast("long").alias(f"{a}_min") for a in axes], *[F.max(a).cast("long").alias(f"{a}_max") for a in axes])
    extent = F.greatest(*[F.col(f"{a}_max") - F.col(f"{a}_min") for a in axes], F.lit(0))
    levels = bit_length("e") if closed else bit_length("e + 1")
    box = box.withColumn("e", extent).withColumn("levels", F.greatest(F.lit(1), F.expr(levels)))
    names = [f"l{a[0]}" for a in axes]
    leaf = [F.least(F.shiftright(F.col(a) - F.col(f"{a}_min") + 1, 1), F.expr("shiftleft(1L, levels - 1) - 1")).cast("long").alias(n) for a, n in zip(axes, names, strict=True)]
    return ipoints.join(box, "frame_id").select(ipoints["*"], "levels", *[F.col(f"{a}_min") for a in axes], *leaf)


def leaves(points: DataFrame, names: list[str]) -> DataFrame:
    """``(frame_id, levels, leaf cell, n)``."""
    return points.groupBy("frame_id", "levels", *names).agg(F.count("*").alias("n"))


def cells(leaf_rows: DataFrame, names: list[str]) -> DataFrame:
    """Every level's occupied cells: ``(frame_id, levels, level, cell, n)`` in one aggregation over exploded leaves."""
    up = leaf_rows.withColumn("level", F.explode(F.expr("sequence(1L, cast(levels as bigint))")))
    return up.groupBy("frame_id", "levels", "level", *[F.expr(f"shiftright({n}, cast(levels - level as int))").alias(n) for n in names]).agg(F.sum("n").alias("n"))


def occupancy(leaf_rows: DataFrame, names: list[str]) -> DataFrame:
    """``(frame_id, level, morton, occupancy)`` for levels 1 to D - 1: bit j set if child j holds a point."""
    child = cells(leaf_rows, names).where("level > 1")
    code = " + ".join(f"{1 << (len(names) - 1 - k)} * ({n} & 1)" for k, n in enumerate(names))
    parents = [F.shiftright(n, 1).alias(n) for n in names]
    grouped = child.groupBy("frame_id", (F.col("level") - 1).alias("level"), *parents).agg(F.bit_or(F.expr(f"shiftleft(1, cast({code} as int))")).cast("int").alias("occupancy"))
    return grouped.select("frame_id", "level", F.expr(G.morton(names)).alias("morton"), "occupancy")


def leaf_counts(leaf_rows: DataFrame, names: list[str]) -> DataFrame:
    """``(frame_id, morton, n)``."""
    return leaf_rows.select("frame_id", F.expr(G.morton(names)).alias("morton"), "n")


def z_deltas(points: DataFrame) -> DataFrame:
    """``(frame_id, morton, point_id, dz)``: zi less the one before, in leaf order and then input order."""
    coded = points.select("frame_id", F.expr(G.morton(["lx", "ly"])).alias("morton"), "point_id", "zi")
    rows = swept(coded, ["frame_id"], ["morton", "point_id"], lasts=("zi",))
    return rows.select("frame_id", "morton", "point_id", (F.col("zi") - F.coalesce("last_zi", F.lit(0))).cast("long").alias("dz"))


def from_z_deltas(deltas: DataFrame) -> DataFrame:
    """``(frame_id, morton, point_id, zi)`` again, by running sums."""
    rows = swept(deltas.select("frame_id", "morton", "point_id", "dz"), ["frame_id"], ["morton", "point_id"], totals=("dz",))
    return rows.select("frame_id", "morton", "point_id", F.col("total_dz").cast("int").alias("zi"))


def breadth_first(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``(frame_id, place, <value>)``: a frame's rows as the sequence that is stored, without what they are ordered by."""
    return swept(rows.select("frame_id", *order, value), ["frame_id"], order).select("frame_id", "place", value)


def children(sequence: DataFrame, axes: int) -> DataFrame:
    """``(frame_id, node, parent, child)``: every node but the roots, by places in breadth-first order, from the occupancy ``(frame_id, place, occupancy)``.

    Set bits are nodes in just this order, so a node's children follow those of all
    nodes before it: their places are the rank of set bits, a prefix sum of bit counts.
    """
    ones = sequence.withColumn("ones", F.expr("cast(bit_count(occupancy) as bigint)"))
    ranked = swept(ones.withColumnRenamed("place", "at"), ["frame_id"], ["at"], totals=("ones",))
    held = F.expr(f"filter(sequence(0, {(1 << axes) - 1}), j -> shiftright(occupancy, j) & 1 = 1)")
    each = ranked.select("frame_id", F.col("at").alias("parent"), (F.col("total_ones") - F.col("ones") + 1).alias("first"), F.posexplode(held).alias("k", "child"))
    return each.select("frame_id", (F.col("first") + F.col("k")).alias("node"), "parent", F.col("child").cast("long").alias("child"))


def decoded_leaves(sequence: DataFrame, counts: DataFrame, axes: int) -> DataFrame:
    """``(frame_id, morton, n)`` from the stored occupancy and counts ``(frame_id, place, n)`` of leaves in order.

    A leaf's code is the path to it: paths to the root double in length each round.
    A frame whose only leaf is the root has no occupancy.
    """
    paths = materialise(children(sequence, axes).select("frame_id", "node", F.col("parent").alias("up"), F.col("child").alias("code"), F.lit(1).alias("steps")), "paths")
    while not paths.where("up > 0").isEmpty():
        over = paths.select("frame_id", F.col("node").alias("up"), F.col("up").alias("far"), F.col("code").alias("high"), F.col("steps").alias("more"))
        met = paths.join(over, ["frame_id", "up"], "left")
        code = F.coalesce(F.expr(f"shiftleft(high, {axes} * steps) | code"), F.col("code"))
        before = paths
        paths = materialise(met.select("frame_id", "node", F.coalesce("far", F.lit(0)).alias("up"), code.alias("code"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "paths")
        release(before)
    inner = sequence.groupBy("frame_id").agg(F.count("*").alias("inner"))
    leaf = paths.join(inner, "frame_id").where("node >= inner").select("frame_id", (F.col("node") - F.col("inner")).alias("place"), F.col("code").alias("morton"))
    return counts.join(leaf, ["frame_id", "place"], "left").select("frame_id", F.coalesce("morton", F.lit(0)).alias("morton"), "n")


def reconstruct(points: DataFrame, axes: tuple[str, ...], scales: tuple[float, ...], compat: bool = False) -> list:
    """Columns of decoded coordinates: the leaf's centre, or its parent's in ``compat`` mode."""
    out = []
    for a, s in zip(axes, scales, strict=True):
        low = F.col(f"{a}_min") - 1
        leaf = F.col(f"l{a[0]}")
        centre = low + F.shiftright(leaf, 1) * 4 + 2 if compat else low + leaf * 2 + 0.5
        out.append((centre / s).alias(f"r{a[0]}"))
    return out
