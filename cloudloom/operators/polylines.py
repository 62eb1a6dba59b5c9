"""Scan lines of frames of any size, with no frame gathered anywhere.

Lines only run along near points, so points that no chain of near cells connects
don't know of each other, in any band. Frames fall apart into such crowds, which
are found by cells alone; crowds of a bounded size are dealt out to tasks whole,
several together, and their lines grown there. Larger ones go by rounds of joins.

The rule is greedy and sequential: seeds in input order, each grows to the right
and then to the left by its nearest free point in that direction, and a line that
stays too short gives its points back. What makes it parallel:

* While no line is taken, each point has one successor to either side, so every
  seed's line is a chain of these links. Chains are followed by jumps of 1, 2, 3
  and 4 times a power of four, each power one join of the one before with itself.
* A seed that fails leaves everything as it was, and a line can only change the
  lines of points that chains of near points connect with it. So in each such
  component the smallest seed whose line is long enough is final, and all seeds
  before it have failed for good. All components take their line at once; those
  without one are finished.

So a round's joins grow with the logarithm of the longest line, and the rounds
with the most lines of a component, after the first in a fraction of the points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom import schema as S
from cloudloom.functions import geometry as G
from cloudloom.operators.components import connected_components
from cloudloom.operators.lines import seeded_lines
from cloudloom.workspace import materialise, materialise_counting, release, superseded

#: A point's number in a pass: how many bands ago it was left over, above its id.
ID_BITS = 56
CHAIN = ["frame_id", "side"]
ANGLES = ["xy_ang", "z_ang", "depth"]
#: Points of a crowd whose lines one task grows, and of the crowds of a frame that are sent together.
CROWD, TOGETHER = 1 << 15, 1 << 16
ROW, PLACE = ["frame_id", "cp", "cd"], ["frame_id", "cp", "cd", "ct"]
GROWN = "frame_id long, band int, seed long, pos int, point_id long, xy_ang double, z_ang double, depth double"


def reach(points: DataFrame, max_dis: float) -> DataFrame:
    """``(frame_id, a, b, d)``: all pairs nearer than ``max_dis``, ``b`` on the right; of points of one azimuth the larger number is.

    ``points`` has frame_id, p (a number that is unique in the frame), xy_ang, z_ang and depth.
    """
    tall = max_dis / S.PHI_FACTOR  # nothing farther up or down is near
    keyed = points.select("frame_id", "p", "xy_ang", "z_ang", "depth", F.floor(F.col("xy_ang") / max_dis).alias("ct"), F.floor(F.col("z_ang") / tall).alias("cp"))
    spread = keyed.withColumn("ct", F.explode(F.array("ct", F.col("ct") + 1))).withColumn("cp", F.explode(F.array(F.col("cp") - 1, F.col("cp"), F.col("cp") + 1)))
    left = spread.select("frame_id", "ct", "cp", F.col("p").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("xy_ang", "z_ang", "depth")])
    dxy, dz, dd = (F.col(c) - F.col(f"a_{c}") for c in ("xy_ang", "z_ang", "depth"))
    met = left.join(keyed.withColumnRenamed("p", "b"), ["frame_id", "ct", "cp"]).where((dxy > 0) | ((dxy == 0) & (F.col("b") > F.col("a"))))
    return met.select("frame_id", "a", "b", G.line_distance(dxy, dz, dd).alias("d")).where((F.col("d") < max_dis) & (dxy <= max_dis))


def nearest_links(edges: DataFrame) -> DataFrame:
    """``(frame_id, side, p, q)``: each point's nearest to the right (side 1) and to the left (-1), the smaller number on ties."""
    ends = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.lit(-1).alias("side"), F.col("b").alias("p"), F.col("a").alias("q"))))
    each = edges.where("a <> b").select("frame_id", "d", ends.alias("e"))
    return each.groupBy("frame_id", "e.side", "e.p").agg(F.min(F.struct("d", "e.q")).alias("m")).select(*CHAIN, "p", F.col("m.q").alias("q"))


def jumps(links: DataFrame) -> list[DataFrame]:
    """Tables ``(frame_id, side, p, q1, q2, q3, q4)``: at k, the points 1 to 4 times 4^k links on, as far as the chain goes."""
    tables = []
    step, more = materialise_counting(links, "links")
    while more:
        table = step.withColumnRenamed("q", "q1")
        for i in (1, 2, 3):
            table = table.join(step.select(*CHAIN, F.col("p").alias(f"q{i}"), F.col("q").alias(f"q{i + 1}")), [*CHAIN, f"q{i}"], "left")
        table, more = materialise_counting(table.select(*CHAIN, "p", "q1", "q2", "q3", "q4"), "jumps", "q4 is not null")
        tables.append(table)
        step = table.where("q4 is not null").select(*CHAIN, "p", F.col("q4").alias("q"))
    return tables


def seeds(tables: list[DataFrame], least: int) -> DataFrame:
    """``(frame_id, p)`` of the points whose lines have ``least`` points or more."""
    steps = tables[0].select(*CHAIN, "p", "q4", F.expr("int(q1 is not null) + int(q2 is not null) + int(q3 is not null) + int(q4 is not null)").alias("n"))
    # as many links as it takes, from the first table alone: four at a time
    for _ in range(0, least - 1, 4):
        on = tables[0].select(*CHAIN, F.col("p").alias("q4"), F.col("q4").alias("next"), F.expr("int(q1 is not null) + int(q2 is not null) + int(q3 is not null) + int(q4 is not null)").alias("more"))
        steps = steps.join(on, [*CHAIN, "q4"], "left").select(*CHAIN, "p", F.col("next").alias("q4"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return steps.groupBy("frame_id", "p").agg(F.sum("n").alias("n")).where(F.col("n") + 1 >= least).select("frame_id", "p")


def chain_ends(points: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``(frame_id, p, end)``: where the chain to the right of each point ends."""
    at = points.select("frame_id", "p", F.col("p").alias("end"))
    for t in reversed(tables):
        on = t.where("side = 1").select("frame_id", F.col("p").alias("end"), F.coalesce("q3", "q2", "q1").alias("far"))
        at = at.join(on, ["frame_id", "end"], "left").select("frame_id", "p", F.coalesce("far", "end").alias("end"))
    return at


def chain_points(starts: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``(frame_id, seed, place, p)``: all points of the seeds' lines, places counted from the seed, to the left negative."""
    at = starts.select("frame_id", F.col("p").alias("seed"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), "p", F.lit(0).alias("place"))
    for k, t in reversed(list(enumerate(tables))):
        here = F.array(F.struct("p", "place"), *[F.struct(F.col(f"q{i}").alias("p"), (F.col("place") + F.col("side") * (i * 4**k)).alias("place")) for i in (1, 2, 3)])
        at = at.join(t.drop("q4"), [*CHAIN, "p"], "left").select(*CHAIN, "seed", F.explode(here).alias("x")).where("x.p is not null").select(*CHAIN, "seed", "x.p", "x.place")
    return at.where("side = 1 or place < 0").select("frame_id", "seed", "place", "p")


def components_of(edges: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``(frame_id, p, part)``: components of near points, by the ends of their chains, so that few are left to connect."""
    points = edges.select("frame_id", F.explode(F.array("a", "b")).alias("p")).distinct()
    ends = materialise(chain_ends(points, tables), "ends")
    end = lambda c: ends.select("frame_id", F.col("p").alias(c), F.struct("frame_id", "end").alias(f"{c}_end"))
    met = edges.join(end("a"), ["frame_id", "a"]).join(end("b"), ["frame_id", "b"]).where("a_end <> b_end")
    left, some = materialise_counting(met.select("a_end", "b_end").distinct(), "ends")
    if not some:
        return ends.withColumnRenamed("end", "part")
    roots = connected_components(left, "a_end", "b_end").select("node.frame_id", F.col("node.end").alias("end"), F.col("root.end").alias("root"))
    return materialise(ends.join(roots, ["frame_id", "end"], "left").select("frame_id", "p", F.coalesce("root", "end").alias("part")), "parts")


def lines_of(points: DataFrame, max_dis: float = S.MAX_DIS, least: int = S.LEAST_LINE) -> DataFrame:
    """``(frame_id, seed, pos, p)``: every frame's lines, each named by its seed.

    ``points`` has frame_id, p, xy_ang, z_ang and depth; seeds are tried in order of p. Equal to
    ``lines.grow_lines`` over each frame's points in that order. An empty table has no lines.
    """
    taken, parts, done = None, None, None
    edges, some = materialise_counting(reach(points, max_dis), "reach")
    while some:
        tables = jumps(nearest_links(edges))
        if parts is None:
            parts = components_of(edges, tables)
        found = seeds(tables, least).join(parts, ["frame_id", "p"])
        if done is not None:
            found = found.join(done, ["frame_id", "part"]).where("p > last").drop("last")
        first = materialise(found.groupBy("frame_id", "part").agg(F.min("p").alias("p")), "first")
        line = materialise(chain_points(first, tables), "line")
        taken = line if taken is None else taken.unionByName(line)
        used = line.select("frame_id", "p")
        live = parts.join(first.select("frame_id", "part"), ["frame_id", "part"], "left_semi").join(used, ["frame_id", "p"], "left_anti").select("frame_id", "p")
        free = edges.join(live.withColumnRenamed("p", "a"), ["frame_id", "a"], "left_semi").join(live.withColumnRenamed("p", "b"), ["frame_id", "b"], "left_semi")
        before, done = edges, first.select("frame_id", "part", F.col("p").alias("last"))
        edges, some = materialise_counting(free, "reach")
        release(before, *tables)
    if taken is None:
        return points.where("false").select("frame_id", F.col("p").alias("seed"), F.lit(0).alias("pos"), "p")
    first = taken.groupBy("frame_id", "seed").agg(F.min("place").alias("low"))
    return taken.join(first, ["frame_id", "seed"]).select("frame_id", "seed", (F.col("place") - F.col("low")).alias("pos"), "p")


def placed(points: DataFrame, max_dis: float) -> DataFrame:
    """``points`` with cells ct, cp and cd, so that near points are in one or in adjacent cells; null for those that are near none."""
    wide = max_dis * (1 + 1e-9)
    finite = F.expr(" and ".join(f"{c} - {c} = 0" for c in ANGLES))
    sizes = zip(("ct", "cp", "cd"), ANGLES, (wide, wide / S.PHI_FACTOR, wide / S.DEPTH_FACTOR), strict=True)
    return points.select("*", *[F.when(finite, F.floor(F.col(c) / size).cast("long")).alias(n) for n, c, size in sizes])


def crowds(points: DataFrame, max_dis: float = S.MAX_DIS) -> DataFrame:
    """``(frame_id, cp, cd, ct, crowd, size)``: what connected crowd of adjacent cells each cell of ``placed`` points is in, and its number of points.

    Cells of one elevation and depth that follow each other in azimuth are one run, and only runs are connected.
    """
    cells = points.where("ct is not null").groupBy(*PLACE).agg(F.count("*").alias("n"))
    around = Window.partitionBy(*ROW).orderBy("ct")  # as many cells as azimuths have, 629
    begins = F.when(F.coalesce(F.col("ct") - F.lag("ct").over(around) > 1, F.lit(True)), F.col("ct"))
    cells = materialise(cells.withColumn("begins", begins).withColumn("start", F.last("begins", True).over(around)).drop("begins"), "cells")
    runs = materialise(cells.groupBy(*ROW, "start").agg(F.max("ct").alias("end"), F.sum("n").alias("n")), "runs")
    ahead = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("p"), F.lit(j).cast("long").alias("d")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    spread = runs.select("frame_id", F.col("cp").alias("a_cp"), F.col("cd").alias("a_cd"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), ahead.alias("s"))
    spread = spread.withColumn("cp", F.col("a_cp") + F.col("s.p")).withColumn("cd", F.col("a_cd") + F.col("s.d"))
    met = spread.join(runs, ROW).where("a_start <= end + 1 and start <= a_end + 1")
    node = lambda a: F.struct("frame_id", *[F.col(f"{a}{c}").alias(c) for c in ("cp", "cd", "start")])
    edges = met.select(node("a_").alias("src"), node("").alias("dst")).union(runs.select(node("").alias("src"), node("").alias("dst")))
    roots = connected_components(edges).select("node.*", F.struct("root.cp", "root.cd", "root.start").alias("crowd"))
    named = materialise(runs.join(roots, [*ROW, "start"]).select(*ROW, "start", "n", "crowd"), "roots")
    sizes = named.groupBy("frame_id", "crowd").agg(F.sum("n").alias("size"))
    named = named.drop("n").join(sizes, ["frame_id", "crowd"])
    return cells.drop("n").join(named, [*ROW, "start"]).select(*PLACE, "crowd", "size")


def _grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """GROWN rows of whole crowds of a frame: band after band, what one leaves behind the next one's points; -1 without a line."""
    band, ids, at = pdf.band.to_numpy(), pdf.point_id.to_numpy(), pdf[ANGLES].to_numpy(float).T
    of, seed, pos, rest = np.full(len(pdf), -1, np.int32), np.full(len(pdf), -1), np.zeros(len(pdf), np.int32), np.empty(0, int)
    for b in range(len(S.BANDS) - 1):
        here = np.concatenate((np.flatnonzero(band == b), rest))
        p = (b - band[here].astype(np.int64)) << ID_BITS | ids[here]
        order = np.argsort(p)
        here, p = here[order], p[order]
        for first, line in seeded_lines(*(a[here] for a in at)):
            of[here[line]], seed[here[line]], pos[here[line]] = b, p[first], np.arange(len(line))
        rest = here[of[here] < 0]
    return pd.DataFrame({"frame_id": pdf.frame_id, "band": of, "seed": seed, "pos": pos, "point_id": ids} | dict(zip(ANGLES, at, strict=True)))


def _by_rounds(points: DataFrame) -> DataFrame:
    """GROWN rows of crowds of any size, a band after the other."""
    out, rest = None, points.where("false")
    for b in range(len(S.BANDS) - 1):
        here = points.where(F.col("band") == b).union(rest)
        here = here.withColumn("p", F.shiftleft((b - F.col("band")).cast("long"), ID_BITS).bitwiseOR(F.col("point_id")))
        both = materialise(here.join(lines_of(here), ["frame_id", "p"], "left").drop("p"), "lines")
        found = both.where("seed is not null").select("frame_id", F.lit(b).alias("band"), "seed", "pos", "point_id", *ANGLES)
        out = found if out is None else out.unionByName(found)
        rest = both.where("seed is null").select(*points.columns)
    return out.unionByName(_lineless(rest))


def _lineless(points: DataFrame) -> DataFrame:
    """GROWN rows of points that are in no line."""
    return points.select("frame_id", F.lit(-1).alias("band"), F.lit(-1).cast("long").alias("seed"), F.lit(0).alias("pos"), "point_id", *ANGLES)


def find_lines(spoints: DataFrame) -> DataFrame:
    """Lines of every frame, band after band: what one band leaves is tried again with the next, after its own points.

    ``spoints`` has frame_id, point_id (0 to 2^56 - 1, unique in the frame), band (0 to 2 or null), xy_ang, z_ang and depth.
    Gives ``(frame_id, band, line_id, pos, point_id, xy_ang, z_ang, depth)``; lines are numbered
    within their band in order of their seeds. Points without a line have band and line_id -1 and
    pos 0; points without a band are left out.
    """
    with superseded() as keep:
        columns = ["frame_id", "point_id", F.col("band").cast("int"), *[F.col(c).cast("double") for c in ANGLES]]
        points = materialise(spoints.where(F.col("band").between(0, len(S.BANDS) - 2)).select(*columns), "spoints")
        points = placed(points, S.MAX_DIS)
        parts, large = materialise_counting(crowds(points), "crowds", f"size > {CROWD}")
        shares = points.groupBy("frame_id").agg(F.ceil(F.count("*") / TOGETHER).alias("share"))
        each = points.join(parts, PLACE, "left").drop("ct", "cp", "cd").withColumn("few", F.coalesce(F.col("size") < S.LEAST_LINE, F.lit(True)))
        if large:
            each = materialise(each, "crowded")
        dealt = each.where(f"not few and size <= {CROWD}").join(shares, "frame_id").withColumn("share", F.pmod(F.hash("crowd"), F.col("share"))).drop("crowd", "size", "few")
        out = dealt.groupBy("frame_id", "share").applyInPandas(_grown, GROWN).unionByName(_lineless(each.where("few")))
        if large:
            out = out.unionByName(_by_rounds(each.where(f"not few and size > {CROWD}").drop("crowd", "size", "few")))
        out = materialise(out, "grown")
        order = Window.partitionBy("frame_id", "band").orderBy("seed")
        names = out.where("band >= 0").select("frame_id", "band", "seed").distinct().withColumn("line_id", F.row_number().over(order) - 1)
        named = out.join(names, ["frame_id", "band", "seed"], "left").withColumn("line_id", F.coalesce("line_id", F.lit(-1)))
        keep.append(materialise(named.select("frame_id", "band", "line_id", "pos", "point_id", *ANGLES), "polylines"))
    return keep[0]
