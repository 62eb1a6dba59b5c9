"""Queries on trees, symbols, scan lines and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import lines, symbols, trees
from cloudloom.plans.clouds import RS, SCAN_Q, quantised_scan
from cloudloom.sources.fixtures import EMB_SQL, emb

#: Steps of 5 cm: a few levels more than the cloud's extent needs.
RT = 0.1
OCT, QUAD = ["lx", "ly", "lz"], ["lx", "ly"]


def octree(spark: SparkSession, sf: str) -> DataFrame:
    points = emb(spark, sf).select("frame_id", "point_id", "x", "y", "z", *G.quantised(2 / RT))
    return trees.placed(points)


def quadtree(spark: SparkSession, sf: str) -> DataFrame:
    points = emb(spark, sf).select("frame_id", "point_id", "x", "y", "z", *G.quantised((2 / RT, 2 / RT, 1 / RT)))
    return trees.placed(points, ("xi", "yi"))


def q_octree_depth(spark: SparkSession, sf: str) -> DataFrame:
    return octree(spark, sf).groupBy("frame_id").agg(F.max("levels").alias("levels"))


def q_octree_cells_per_level(spark: SparkSession, sf: str) -> DataFrame:
    cells = trees.cells(trees.leaves(octree(spark, sf), OCT), OCT)
    return cells.groupBy("frame_id", "level").agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


def q_octree_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return trees.occupancy(trees.leaves(octree(spark, sf), OCT), OCT)


def q_octree_leaf_counts(spark: SparkSession, sf: str) -> DataFrame:
    return trees.leaf_counts(trees.leaves(octree(spark, sf), OCT), OCT)


def q_octree_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    axes, scales = ("xi", "yi", "zi"), (2 / RT,) * 3
    fine, coarse = (trees.reconstruct(octree(spark, sf), axes, scales, c) for c in (False, True))
    both = [F.round(f, 6).alias(f"r{a}") for f, a in zip(fine, "xyz", strict=True)] + [F.round(c, 6).alias(f"compat_{a}") for c, a in zip(coarse, "xyz", strict=True)]
    return octree(spark, sf).select("point_id", *both)


def q_octree_error(spark: SparkSession, sf: str) -> DataFrame:
    """The largest error of an axis; the bound is half the resolution."""
    back = trees.reconstruct(octree(spark, sf), ("xi", "yi", "zi"), (2 / RT,) * 3)
    worst = F.max(F.greatest(*[F.abs(F.col(a) - r) for a, r in zip("xyz", back, strict=True)]))
    return octree(spark, sf).groupBy("frame_id").agg(F.round(worst, 6).alias("max_error"), (worst <= RT / 2 + 1e-9).alias("in_bound"))


def q_quadtree_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return trees.occupancy(trees.leaves(quadtree(spark, sf), QUAD), QUAD)


def q_quadtree_leaf_counts(spark: SparkSession, sf: str) -> DataFrame:
    return trees.leaf_counts(trees.leaves(quadtree(spark, sf), QUAD), QUAD)


def q_quadtree_z_delta(spark: SparkSession, sf: str) -> DataFrame:
    return trees.z_deltas(quadtree(spark, sf))


def q_quadtree_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf centres, and z from the running sum of its deltas."""
    points = quadtree(spark, sf)
    z = trees.from_z_deltas(trees.z_deltas(points)).select("frame_id", "point_id", F.round(F.col("zi") * RT, 6).alias("rz"))
    xy = [F.round(c, 6).alias(f"r{a}") for c, a in zip(trees.reconstruct(points, ("xi", "yi"), (2 / RT,) * 2), "xy", strict=True)]
    return points.select("frame_id", "point_id", *xy).join(z, ["frame_id", "point_id"])


def q_symbol_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.histogram(q_octree_occupancy(spark, sf), ["frame_id"], "occupancy")


def q_cumulative_freq(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.cumulative(q_symbol_histogram(spark, sf), ["frame_id"])


def q_entropy_bits(spark: SparkSession, sf: str) -> DataFrame:
    e = symbols.entropy_bits(q_symbol_histogram(spark, sf), ["frame_id"])
    return e.select("frame_id", "total", F.round("bits", 3).alias("bits"))


RING = ["frame_id", "band", "ring"]


def q_ring_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return lines.deltas(quantised_scan(spark, sf), RING, "az", ["qdepth"])


def ring_heads(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_heads(quantised_scan(spark, sf), RING, "az", ["qxy", "qz", "qdepth"])


def q_line_heads_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in order of their heads' elevation, then azimuth."""
    rank = F.row_number().over(Window.partitionBy("frame_id", "band").orderBy("qz", "qxy", "ring"))
    return ring_heads(spark, sf).select(*RING, "qdepth", rank.alias("rank"))


def q_ring_head_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return lines.head_deltas(ring_heads(spark, sf), ["frame_id", "band"], ["qxy", "qz", "qdepth"], "ring")


def _rings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The sweep's points, and the ring below each as reference: ring k leans on ring k - 1."""
    q = quantised_scan(spark, sf).select("frame_id", "band", "ring", "az", "qdepth")
    return q, q.withColumn("ring", F.col("ring") + 1)


def q_asof_reference(spark: SparkSession, sf: str) -> DataFrame:
    """The last point at or before each azimuth on the ring below, at most 3 azimuths away."""
    points, below = _rings(spark, sf)
    return lines.as_of(points, below, RING, "az", ["qdepth"], 3)


def q_two_sided_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Points whose references on both sides disagree in depth, and the nearest candidate's depth."""
    points, below = _rings(spark, sf)
    left = lines.as_of(points, below, RING, "az", ["qdepth"], 3).withColumnsRenamed({"r_az": "l_az", "r_qdepth": "l_qdepth"})
    both = lines.as_of(left, below, RING, "az", ["qdepth"], 3, forward=True).where("l_qdepth is not null and r_qdepth is not null")
    jump = F.abs(F.col("r_qdepth") - F.col("l_qdepth")) > int(2.0 / RS)
    pick = F.when(F.abs(F.col("l_qdepth") - F.col("qdepth")) < F.abs(F.col("r_qdepth") - F.col("qdepth")), F.col("l_qdepth")).otherwise(F.col("r_qdepth"))
    return both.where(jump).select(*RING, "az", pick.alias("ref_qdepth"))


def q_reference_window(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines before each start within one ring's elevation of it."""
    most = quantised_scan(spark, sf).groupBy("frame_id", "band").agg(F.max("max_depth").alias("max_depth"))
    reach = most.select("frame_id", "band", *G.line_thresholds(RS, F.col("max_depth"))).select("frame_id", "band", "z_ang_th")
    return lines.references_within(ring_heads(spark, sf).join(reach, ["frame_id", "band"]), ["frame_id", "band"], "ring", "z_ang_th")


def q_union_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All bands and the far points again as one bag, with where they came from."""
    q = emb(spark, sf).withColumn("depth", G.depth())
    near, far = q.where("depth <= 100").withColumn("path", F.lit("near")), q.where("depth > 100").withColumn("path", F.lit("far"))
    return near.unionByName(far).groupBy("frame_id", "path").agg(F.count("*").alias("n"))


def q_anti_leftovers(spark: SparkSession, sf: str) -> DataFrame:
    """Points that no band takes, by anti join on their ids."""
    q = emb(spark, sf).withColumn("depth", G.depth())
    return q.join(q.where("depth > 0 and depth <= 50").select("point_id"), "point_id", "left_anti").select("frame_id", "point_id")


OCT_SQL = f"""{EMB_SQL}, i AS (SELECT frame_id, point_id, x, y, z, CAST(round(x*{2 / RT}) AS BIGINT) AS xi, CAST(round(y*{2 / RT}) AS BIGINT) AS yi, CAST(round(z*{2 / RT}) AS BIGINT) AS zi FROM emb),
box AS (SELECT frame_id, min(xi) AS x0, min(yi) AS y0, min(zi) AS z0, length(bin(greatest(max(xi)-min(xi), max(yi)-min(yi), max(zi)-min(zi)) + 1)) AS levels FROM i GROUP BY 1),
t AS (SELECT i.*, levels, x0, y0, z0, (xi-x0+1)>>1 AS lx, (yi-y0+1)>>1 AS ly, (zi-z0+1)>>1 AS lz FROM i JOIN box USING (frame_id)),
lv AS (SELECT CAST(unnest(range(1, 25)) AS BIGINT) AS level),
cells AS (SELECT frame_id, level, lx>>(levels-level) AS cx, ly>>(levels-level) AS cy, lz>>(levels-level) AS cz, count(*) AS n FROM t JOIN lv ON level <= levels GROUP BY ALL)"""
QUAD_SQL = f"""{EMB_SQL}, i AS (SELECT frame_id, point_id, CAST(round(x*{2 / RT}) AS BIGINT) AS xi, CAST(round(y*{2 / RT}) AS BIGINT) AS yi, CAST(round(z*{1 / RT}) AS BIGINT) AS zi FROM emb),
box AS (SELECT frame_id, min(xi) AS x0, min(yi) AS y0, length(bin(greatest(max(xi)-min(xi), max(yi)-min(yi)) + 1)) AS levels FROM i GROUP BY 1),
t AS (SELECT i.*, levels, x0, y0, (xi-x0+1)>>1 AS lx, (yi-y0+1)>>1 AS ly FROM i JOIN box USING (frame_id)),
lv AS (SELECT CAST(unnest(range(1, 25)) AS BIGINT) AS level),
cells AS (SELECT frame_id, level, lx>>(levels-level) AS cx, ly>>(levels-level) AS cy, count(*) AS n FROM t JOIN lv ON level <= levels GROUP BY ALL)"""
M3 = "CAST(list_sum(list_transform(range(0, 21), lambda i: ((({0}>>i)&1)<<(3*i+2)) + ((({1}>>i)&1)<<(3*i+1)) + ((({2}>>i)&1)<<(3*i)))) AS BIGINT)"
M2 = "CAST(list_sum(list_transform(range(0, 21), lambda i: ((({0}>>i)&1)<<(2*i+1)) + ((({1}>>i)&1)<<(2*i)))) AS BIGINT)"
OCC_SQL = f"""{OCT_SQL}, occ AS (SELECT frame_id, level-1 AS level, {M3.format('(cx>>1)', '(cy>>1)', '(cz>>1)')} AS morton, bit_or(CAST(1<<(4*(cx&1)+2*(cy&1)+(cz&1)) AS INT)) AS occupancy FROM cells WHERE level > 1 GROUP BY 1, 2, 3)"""
Z_SQL = f"""{QUAD_SQL}, m AS (SELECT *, {M2.format('lx', 'ly')} AS morton FROM t),
dz AS (SELECT frame_id, morton, point_id, zi - lag(zi, 1, 0) OVER (PARTITION BY frame_id ORDER BY morton, point_id) AS dz FROM m)"""
HEADS = f"{SCAN_Q}, h AS (SELECT frame_id, band, ring, arg_min(qxy, az) AS qxy, arg_min(qz, az) AS qz, arg_min(qdepth, az) AS qdepth FROM q GROUP BY 1, 2, 3)"
ASOF = f"""{SCAN_Q}, l AS (SELECT p.frame_id, p.band, p.ring, p.az, p.qdepth, CASE WHEN p.az - b.az <= 3 THEN b.az END AS r_az, CASE WHEN p.az - b.az <= 3 THEN b.qdepth END AS r_qdepth
  FROM q p ASOF LEFT JOIN q b ON b.frame_id = p.frame_id AND b.band = p.band AND b.ring + 1 = p.ring AND b.az <= p.az)"""

SQL = {
    "q_octree_depth": f"WITH {OCT_SQL} SELECT frame_id, levels FROM box",
    "q_octree_cells_per_level": f"WITH {OCT_SQL} SELECT frame_id, level, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points FROM cells GROUP BY 1, 2",
    "q_octree_occupancy": f"WITH {OCC_SQL} SELECT * FROM occ",
    "q_octree_leaf_counts": f"WITH {OCT_SQL} SELECT frame_id, {M3.format('lx', 'ly', 'lz')} AS morton, count(*) AS n FROM t GROUP BY 1, 2",
    "q_octree_reconstruct": f"WITH {OCT_SQL} SELECT point_id, " + ", ".join(f"round(({a}0-1+2*l{a}+0.5)/{2 / RT}, 6) AS r{a}, round(({a}0-1+4*(l{a}>>1)+2)/{2 / RT}, 6) AS compat_{a}" for a in "xyz") + " FROM t",
    "q_octree_error": f"WITH {OCT_SQL}, e AS (SELECT frame_id, greatest(" + ", ".join(f"abs({a}-({a}0-1+2*l{a}+0.5)/{2 / RT})" for a in "xyz") + f") AS err FROM t) SELECT frame_id, round(max(err), 6) AS max_error, max(err) <= {RT / 2} + 1e-9 AS in_bound FROM e GROUP BY 1",
    "q_quadtree_occupancy": f"WITH {QUAD_SQL} SELECT frame_id, level-1 AS level, {M2.format('(cx>>1)', '(cy>>1)')} AS morton, bit_or(CAST(1<<(2*(cx&1)+(cy&1)) AS INT)) AS occupancy FROM cells WHERE level > 1 GROUP BY 1, 2, 3",
    "q_quadtree_leaf_counts": f"WITH {QUAD_SQL} SELECT frame_id, {M2.format('lx', 'ly')} AS morton, count(*) AS n FROM t GROUP BY 1, 2",
    "q_quadtree_z_delta": f"WITH {Z_SQL} SELECT * FROM dz",
    "q_quadtree_reconstruct": f"WITH {Z_SQL} SELECT frame_id, point_id, round((x0-1+2*lx+0.5)/{2 / RT}, 6) AS rx, round((y0-1+2*ly+0.5)/{2 / RT}, 6) AS ry, round(zi*CAST({RT} AS DOUBLE), 6) AS rz FROM t",
    "q_symbol_histogram": f"WITH {OCC_SQL} SELECT frame_id, occupancy AS symbol, count(*) AS n FROM occ GROUP BY 1, 2",
    "q_cumulative_freq": f"WITH {OCC_SQL}, hs AS (SELECT frame_id, occupancy AS symbol, count(*) AS n FROM occ GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY frame_id ORDER BY symbol) - n AS BIGINT) AS cum FROM hs",
    "q_entropy_bits": f"WITH {OCC_SQL}, hs AS (SELECT frame_id, occupancy AS symbol, count(*) AS n FROM occ GROUP BY 1, 2) SELECT frame_id, CAST(sum(n) AS BIGINT) AS total, round(sum(n)*log2(sum(n)) - sum(n*log2(n)), 3) AS bits FROM hs GROUP BY 1",
    "q_ring_deltas": f"WITH {SCAN_Q} SELECT frame_id, band, ring, az, qdepth - lag(qdepth, 1, 0) OVER (PARTITION BY frame_id, band, ring ORDER BY az) AS d_qdepth FROM q",
    "q_line_heads_sorted": f"WITH {HEADS} SELECT frame_id, band, ring, qdepth, CAST(row_number() OVER (PARTITION BY frame_id, band ORDER BY qz, qxy, ring) AS INT) AS rank FROM h",
    "q_ring_head_deltas": f"WITH {HEADS} SELECT frame_id, band, ring, " + ", ".join(f"{c} - lag({c}) OVER (PARTITION BY frame_id, band ORDER BY qz, qxy, ring) AS d_{c}" for c in ("qxy", "qz", "qdepth")) + " FROM h",
    "q_asof_reference": f"WITH {ASOF} SELECT * FROM l",
    "q_two_sided_reference": f"""WITH {ASOF}, f AS (SELECT p.frame_id, p.band, p.ring, p.az, CASE WHEN b.az - p.az <= 3 THEN b.qdepth END AS f_qdepth FROM q p ASOF LEFT JOIN q b ON b.frame_id = p.frame_id AND b.band = p.band AND b.ring + 1 = p.ring AND b.az >= p.az)
      SELECT frame_id, band, ring, az, CASE WHEN abs(r_qdepth-qdepth) < abs(f_qdepth-qdepth) THEN r_qdepth ELSE f_qdepth END AS ref_qdepth FROM l JOIN f USING (frame_id, band, ring, az) WHERE abs(f_qdepth-r_qdepth) > {int(2.0 / RS)}""",
    "q_reference_window": f"""WITH {HEADS}, th AS (SELECT frame_id, band, CAST(round(radians(27.4)/64/({RS}/max_depth)) AS INT) AS z_ang_th FROM most)
      SELECT h.frame_id, h.band, h.ring, count(b.ring) AS "references" FROM h JOIN th USING (frame_id, band)
      LEFT JOIN h b ON b.frame_id = h.frame_id AND b.band = h.band AND (b.qz, b.qxy, b.ring) < (h.qz, h.qxy, h.ring) AND h.qz - b.qz <= z_ang_th GROUP BY 1, 2, 3""",
    "q_union_paths": f"WITH {EMB_SQL}, d AS (SELECT *, sqrt(x*x+y*y+z*z) AS depth FROM emb) SELECT frame_id, path, count(*) AS n FROM (SELECT frame_id, 'near' AS path FROM d WHERE depth <= 100 UNION ALL SELECT frame_id, 'far' FROM d WHERE depth > 100) GROUP BY 1, 2",
    "q_anti_leftovers": f"WITH {EMB_SQL}, d AS (SELECT *, sqrt(x*x+y*y+z*z) AS depth FROM emb) SELECT frame_id, point_id FROM d WHERE NOT (depth > 0 AND depth <= 50)",
}
QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
