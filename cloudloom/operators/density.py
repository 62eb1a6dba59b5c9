"""Density clustering and the split of a frame into dense and sparse points."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom import schema as S
from cloudloom.functions import geometry as G
from cloudloom.operators.components import connected_components
from cloudloom.operators.neighbours import at_positions, degrees, near_between, positions, square_distance
from cloudloom.operators.places import swept
from cloudloom.workspace import materialise, materialise_counting

KEYS, CELL = ["frame_id", "point_id"], ["frame_id", "fx", "fy", "fz"]


def fine_cells(points: DataFrame, eps: float) -> DataFrame:
    """``points`` with cells fx, fy, fz whose diagonal is ``eps``, so that points of one cell are near each other."""
    fine = eps / math.sqrt(3) * (1 - 1e-9)
    return points.select("*", *[G.cell(c, fine).alias(f"f{c}") for c in G.XYZ])


def core_points(points: DataFrame, eps: float, core_degree: int = S.CORE_DEGREE) -> DataFrame:
    """``(frame_id, point_id)`` of the points with ``core_degree`` others closer than ``eps``."""
    places = materialise(positions(points), "places")
    return at_positions(points, places.join(core_places(places, eps, core_degree), KEYS).select("frame_id", *G.XYZ))


def core_places(places: DataFrame, eps: float, core_degree: int) -> DataFrame:
    """``(frame_id, point_id)`` of the places (see ``positions``) whose points are core.

    A fine cell of more points than ``core_degree`` is all core, and no pairs are made in it;
    only the places of other cells have the points around them counted, all in one join.
    """
    base = fine_cells(places, eps)
    full = base.groupBy(*CELL).agg(F.sum("n").alias("all")).where(F.col("all") > core_degree).select(*CELL, F.lit(True).alias("full"))
    marked = materialise(base.join(full, CELL, "left").select(*KEYS, *G.XYZ, "n", F.coalesce("full", F.lit(False)).alias("full")), "cells")
    counted = near_between(marked.where("not full"), marked, eps, ("n",)).groupBy("frame_id", F.col("src").alias("point_id")).agg(F.sum("n").alias("all"))
    return counted.where(F.col("all") > core_degree).select(*KEYS).unionByName(marked.where("full").select(*KEYS))


def core_cells(marked: DataFrame) -> DataFrame:
    """``(frame_id, fx, fy, fz, head, ends)`` of the cells that hold cores: the smallest of them, and the outermost one down and up each axis."""
    place = F.struct(*G.XYZ)
    ends = F.struct(*[f(place, c).alias(f"{n}{c}") for c in G.XYZ for n, f in (("low", F.min_by), ("high", F.max_by))])
    return marked.where("core").groupBy(*CELL).agg(F.min("head").alias("head"), ends.alias("ends"))


def met_cells(cells: DataFrame, eps: float) -> DataFrame:
    """All pairs of ``core_cells`` whose cores may be closer than ``eps``, each once: ``a_`` columns of one, those of the other, and ``near``.

    ``near`` is whether facing outermost cores are closer, which proves a link; the boxes around the cores of any pair are.
    """
    # cells up to two steps away: those behind, of which a corner can be near enough
    ahead = [(i, j, k) for i in range(3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0) and sum(max(0, abs(x) - 1) ** 2 for x in (i, j, k)) < 3]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(t, "xyz", strict=True)]) for t in ahead]))
    spread = cells.select("frame_id", *[F.col(c).alias(f"a_{c}") for c in [*CELL[1:], "head", "ends"]], step.alias("step")).select("*", *[(F.col(f"a_f{c}") + F.col(f"step.{c}")).alias(f"f{c}") for c in G.XYZ])
    off = lambda a, b: sum(((F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) * (F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) for c in G.XYZ), F.lit(0.0))
    facing = [(F.col(f"step.{c}") * sign > 0) & (off(f"a_ends.{a}{c}", f"ends.{b}{c}") < eps * eps) for c in G.XYZ for sign, a, b in ((1, "high", "low"), (-1, "low", "high"))]
    gap = [F.greatest(F.col(f"{one}.low{c}.{c}") - F.col(f"{other}.high{c}.{c}"), F.lit(0.0)) for c in G.XYZ for one, other in (("a_ends", "ends"), ("ends", "a_ends"))]
    boxes = sum((g * g for g in gap), F.lit(0.0))
    return spread.join(cells, CELL).where(boxes < eps * eps * (1 + 1e-9)).withColumn("near", reduce(or_, facing)).drop("step")


def cell_components(marked: DataFrame, eps: float) -> DataFrame:
    """``(frame_id, head, root)``: the cells that hold cores, by their heads, and the smallest head that chains of cores closer than ``eps`` reach.

    ``marked`` has fine cells, ``head`` (the smallest core of the point's cell, null without any) and ``core``. Most
    cells are connected by their outermost cores; only cells that are not connected so have their cores compared, and
    of these only such as lie beside the other cell's.
    """
    cells = materialise(core_cells(marked), "core_cells")
    met = materialise(met_cells(cells, eps), "met_cells")
    node = lambda c: F.struct("frame_id", F.col(c).alias("id"))
    linked = met.where("near").select(node("a_head").alias("src"), node("head").alias("dst")).union(cells.select(node("head").alias("src"), node("head").alias("dst")))
    parts = materialise(connected_components(linked).select("node.frame_id", F.col("node.id").alias("head"), F.col("root.id").alias("root")), "parts")
    of = lambda p: parts.select("frame_id", F.col("head").alias(f"{p}head"), F.col("root").alias(f"{p}root"))
    apart, some = materialise_counting(met.where("not near").join(of("a_"), ["frame_id", "a_head"]).join(of(""), ["frame_id", "head"]).where("a_root <> root"), "apart")
    if not some:
        return parts
    cores = marked.where("core").select(*CELL, *G.XYZ)

    def beside(ends: str) -> Column:
        out = [F.greatest(F.col(f"{ends}.low{c}.{c}") - F.col(c), F.col(c) - F.col(f"{ends}.high{c}.{c}"), F.lit(0.0)) for c in G.XYZ]
        return sum((o * o for o in out), F.lit(0.0)) < eps * eps * (1 + 1e-9)

    ours = apart.join(cores.select("frame_id", *[F.col(f).alias(f"a_{f}") for f in CELL[1:]], *G.XYZ), ["frame_id", *[f"a_{f}" for f in CELL[1:]]]).where(beside("ends"))
    ours = ours.select(*CELL, "a_ends", "a_root", "root", *[F.col(c).alias(f"a_{c}") for c in G.XYZ])
    pairs = ours.join(cores, CELL).where(beside("a_ends") & (square_distance("a_") < eps * eps))
    more = connected_components(pairs.select(node("a_root").alias("src"), node("root").alias("dst")).distinct())
    more = more.select("node.frame_id", F.col("node.id").alias("root"), F.col("root.id").alias("first"))
    return parts.join(more, ["frame_id", "root"], "left").select("frame_id", "head", F.coalesce("first", "root").alias("root"))


def clusters(points: DataFrame, eps: float, core_degree: int = S.CORE_DEGREE) -> DataFrame:
    """``(frame_id, point_id, cluster_id)``; -1 is noise.

    Core points have ``core_degree`` neighbours; connected ones share a cluster,
    named by its rank among the frame's clusters in the order of their smallest
    core ids; a border point joins the first cluster that has a core next to it.

    A fine cell's cores are one node, named by the smallest of them, and only
    edges between such cells are connected. Copies of a point are one place.
    """
    places = materialise(positions(points), "places")
    core = core_places(places, eps, core_degree).withColumn("core", F.lit(True))
    flagged = fine_cells(places.drop("n"), eps).join(core, KEYS, "left").withColumn("core", F.coalesce("core", F.lit(False)))
    flagged = materialise(flagged, "flagged")
    heads = flagged.where("core").groupBy(*CELL).agg(F.min("point_id").alias("head"))
    marked = materialise(flagged.join(heads, CELL, "left"), "marked")
    roots = materialise(cell_components(marked, eps), "roots")
    names = roots.select("frame_id", "root").distinct()
    names = names.withColumn("cluster_id", (F.dense_rank().over(Window.partitionBy("frame_id").orderBy("root")) - 1).cast("long"))
    named = materialise(roots.join(names, ["frame_id", "root"]).select("frame_id", "head", "cluster_id"), "named")
    beside = near_between(marked.where("not core"), marked.where("core"), eps, ("head",)).select("frame_id", F.col("src").alias("point_id"), "head").distinct()
    border = beside.join(named, ["frame_id", "head"]).groupBy(*KEYS).agg(F.min("cluster_id").alias("cluster_id"))
    found = marked.where("core").select("frame_id", *G.XYZ, "head").join(named, ["frame_id", "head"]).select("frame_id", *G.XYZ, "cluster_id")
    found = found.unionByName(marked.where("not core").select(*KEYS, *G.XYZ).join(border, KEYS).select("frame_id", *G.XYZ, "cluster_id"))
    return at_positions(points, found, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("long")))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """``(frame_id, cluster_id, n)`` without noise."""
    return labels.where("cluster_id >= 0").groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n"))


def dense_flags(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``points`` with ``dense``: in a cluster of over 300 points, and nearer than 100 m."""
    large = cluster_sizes(labels).where(F.col("n") > S.DENSE_SIZE).select("frame_id", "cluster_id", F.lit(True).alias("large"))
    flagged = labels.join(large, ["frame_id", "cluster_id"], "left").select(*KEYS, F.coalesce("large", F.lit(False)).alias("large"))
    return points.join(flagged, KEYS).withColumn("dense", F.col("large") & (G.depth() < S.DENSE_DEPTH)).drop("large")


def rate_split(points: DataFrame, rate: float) -> DataFrame:
    """``points`` with ``dense`` for the nearest ones of each frame, as many as come before n * rate."""
    sizes = points.groupBy("frame_id").agg(F.count("*").alias("_all"))
    ranked = swept(points.withColumn("_far", G.norm2()), ["frame_id"], ["_far", "point_id"])
    return ranked.join(sizes, "frame_id").select(*points.columns, (F.col("place") < F.col("_all") * rate).alias("dense"))


def approximate_core_cells(points: DataFrame, eps: float, core_degree: int = S.CORE_DEGREE) -> DataFrame:
    """``(frame_id, cx, cy, cz, n, around)``: cells whose 27 neighbouring cells hold ``core_degree`` points or more."""
    counts = points.groupBy("frame_id", *[G.cell(c, eps).alias(f"c{c}") for c in G.XYZ]).agg(F.count("*").alias("n"))
    spread = counts
    for c in G.XYZ:
        spread = spread.withColumn("s", F.explode(F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)]))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("s")).drop("s")
    key = ["frame_id", "cx", "cy", "cz"]
    around = spread.groupBy(*key).agg(F.sum("n").alias("around"))
    return counts.join(around, key).where(F.col("around") >= core_degree)


__all__ = ["approximate_core_cells", "cell_components", "cluster_sizes", "clusters", "core_points", "degrees", "dense_flags", "rate_split"]
