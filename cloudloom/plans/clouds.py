"""Queries on derived point clouds: geometry, neighbours, density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import density, neighbours
from cloudloom.sources.fixtures import EMB_SQL, SCAN_SQL, emb, scan

R, EPS, NEAR = 0.04, 20.0, 10.0
#: For the sweep, whose depths are multiples of a centimetre: no depth is half a step.
RS = 0.03
SPH = "(atan2(y, x) + 2*pi()) % (2*pi()) AS xy_ang, atan2(z, sqrt(x*x + y*y)) AS z_ang, sqrt(x*x + y*y + z*z) AS depth"
BAND = "CASE WHEN depth > 0 AND depth <= 25 THEN 0 WHEN depth > 25 AND depth <= 50 THEN 1 WHEN depth > 50 AND depth <= 100 THEN 2 END"


def with_depth(points: DataFrame) -> DataFrame:
    return points.withColumn("depth", G.depth())


def banded(points: DataFrame) -> DataFrame:
    return with_depth(points).withColumn("band", G.band(F.col("depth")))


def q_load_points(spark: SparkSession, sf: str) -> DataFrame:
    p = emb(spark, sf).select("frame_id", *G.quantised(50.0))
    return p.groupBy("frame_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in ("xi", "yi", "zi")])


def q_frame_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).groupBy("frame_id").agg(*[f(c).alias(f"{n}_{c}") for c in G.XYZ for n, f in (("min", F.min), ("max", F.max))])


def q_raw_size_bits(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf).groupBy("frame_id").agg((F.count("*") * 96).alias("raw_bits"))


def q_depth(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("point_id", F.round(G.depth(), 6).alias("depth"))


def q_depth_bands(spark: SparkSession, sf: str) -> DataFrame:
    return banded(scan(spark, sf)).groupBy("frame_id", "band").agg(F.count("*").alias("n"))


def q_dropped_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points that no band takes: farther than 100 m, or at the sensor."""
    return banded(scan(spark, sf)).where("band is null").groupBy("frame_id").agg(F.count("*").alias("n_dropped"))


def q_max_depth_per_band(spark: SparkSession, sf: str) -> DataFrame:
    return banded(scan(spark, sf)).where("band is not null").groupBy("frame_id", "band").agg(F.round(F.max("depth"), 6).alias("max_depth"))


def q_quantise_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("point_id", *G.quantised(2 / R))


def q_quantise_per_axis(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("point_id", *G.quantised((2 / R, 2 / R, 1 / R)))


def q_dequantise_error(spark: SparkSession, sf: str) -> DataFrame:
    err = [F.max(F.abs(F.col(c) - G.dequantise(G.quantise(c, 2 / R), 2 / R))) for c in G.XYZ]
    return emb(spark, sf).groupBy("frame_id").agg(F.round(F.greatest(*err), 9).alias("max_error"), (F.greatest(*err) <= R / 4 + 1e-9).alias("in_bound"))


def q_to_spherical(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("point_id", *[F.round(c, 6).alias(n) for c, n in zip(G.spherical(), ("xy_ang", "z_ang", "depth"), strict=True)])


def q_to_cartesian_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    back = emb(spark, sf).select("point_id", *G.spherical()).select("point_id", *G.cartesian())
    return back.select("point_id", *[F.round(c, 5).alias(c) for c in G.XYZ])


def spherical_scan(spark: SparkSession, sf: str) -> DataFrame:
    s = scan(spark, sf).select("frame_id", "point_id", "ring", "az", *G.spherical())
    return s.where((F.col("depth") > G.S.BANDS[0]) & (F.col("depth") <= G.S.BANDS[-1])).withColumn("band", G.band(F.col("depth")))


def quantised_scan(spark: SparkSession, sf: str) -> DataFrame:
    s = spherical_scan(spark, sf)
    most = s.groupBy("frame_id", "band").agg(F.max("depth").alias("max_depth"))
    return s.join(most, ["frame_id", "band"]).select("frame_id", "band", "point_id", "ring", "az", "max_depth", *G.quantised_spherical(RS, F.col("max_depth")))


def q_quantise_spherical(spark: SparkSession, sf: str) -> DataFrame:
    q = quantised_scan(spark, sf)
    return q.groupBy("frame_id", "band", "ring").agg(F.count("*").alias("n"), F.min("qdepth").alias("min_qdepth"), F.max("qdepth").alias("max_qdepth"), F.sum("qdepth").alias("sum_qdepth"))


def q_line_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    most = spherical_scan(spark, sf).groupBy("frame_id", "band").agg(F.max("depth").alias("max_depth"))
    return most.select("frame_id", "band", *G.line_thresholds(RS, F.col("max_depth")))


def q_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.celled(emb(spark, sf), EPS).select("point_id", "cx", "cy", "cz")


def q_grid_histogram(spark: SparkSession, sf: str) -> DataFrame:
    c = neighbours.celled(emb(spark, sf), EPS).groupBy("frame_id", "cx", "cy", "cz").agg(F.count("*").alias("points"))
    return c.groupBy("frame_id", "points").agg(F.count("*").alias("cells"))


def q_eps_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    millionths = F.col("d2") * 1e6  # rounded as doubles, half away from zero, as in SQL: Spark's round takes decimals, which cost most of a pair's time
    rounded = (F.floor(millionths) + F.when(millionths - F.floor(millionths) >= 0.5, 1).otherwise(0)) / 1e6
    return neighbours.eps_pairs(emb(spark, sf), NEAR).select("frame_id", "src", "dst", rounded.alias("d2"))


def q_degree(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.degrees(emb(spark, sf), EPS)


def q_core_points(spark: SparkSession, sf: str) -> DataFrame:
    return density.core_points(emb(spark, sf), EPS)


def q_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return density.clusters(emb(spark, sf), EPS)


def q_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return density.cluster_sizes(density.clusters(emb(spark, sf), EPS))


def q_dense_sparse(spark: SparkSession, sf: str) -> DataFrame:
    p = emb(spark, sf)
    return density.dense_flags(p, density.clusters(p, EPS)).groupBy("frame_id", "dense").agg(F.count("*").alias("n"))


def q_rate_split(spark: SparkSession, sf: str) -> DataFrame:
    return density.rate_split(emb(spark, sf), 0.3).where("dense").select("frame_id", "point_id")


def q_approximate_core_cells(spark: SparkSession, sf: str) -> DataFrame:
    return density.approximate_core_cells(emb(spark, sf), EPS)


def q_nearest_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    n = neighbours.nearest(emb(spark, sf), NEAR)
    return n.select("frame_id", "point_id", "nearest_id", F.round("d2", 6).alias("d2"))


def q_directional_nn(spark: SparkSession, sf: str) -> DataFrame:
    s = spherical_scan(spark, sf).withColumn("xy_ang", F.round("xy_ang", 9))  # points of one azimuth differ by rounding only
    return neighbours.directional_nearest(s, digits=9)


Q = lambda v, s, n: f"CAST(round({v}*{s}) AS INT) AS {n}"
SCAN_S = f"{SCAN_SQL}, sph AS (SELECT frame_id, point_id, ring, az, {SPH} FROM scan), s AS (SELECT *, {BAND} AS band FROM sph WHERE {BAND} IS NOT NULL)"
SCAN_Q = f"""{SCAN_S}, most AS (SELECT frame_id, band, max(depth) AS max_depth FROM s GROUP BY ALL),
q AS (SELECT frame_id, band, point_id, ring, az, max_depth, CAST(round(xy_ang/({RS}/max_depth)) AS INT) AS qxy,
  CAST(round(z_ang/({RS}/max_depth)) AS INT) AS qz, CAST(round(depth/{RS}) AS INT) AS qdepth FROM s JOIN most USING (frame_id, band))"""
PAIRS = "pairs AS (SELECT a.frame_id, a.point_id AS src, b.point_id AS dst, (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) AS d2 FROM emb a JOIN emb b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id AND (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) < {0})"
DEG = f"{EMB_SQL}, {PAIRS.format(EPS * EPS)}, deg AS (SELECT emb.frame_id, emb.point_id, count(src) AS degree FROM emb LEFT JOIN pairs ON src = emb.point_id AND pairs.frame_id = emb.frame_id GROUP BY ALL)"
CLUSTER = f"""{DEG.replace(EMB_SQL, 'RECURSIVE ' + EMB_SQL, 1)}, core AS (SELECT frame_id, point_id FROM deg WHERE degree >= 78),
e AS (SELECT p.frame_id, src, dst FROM pairs p JOIN core a ON a.frame_id = p.frame_id AND a.point_id = src JOIN core b ON b.frame_id = p.frame_id AND b.point_id = dst),
firsts AS (SELECT c.frame_id, c.point_id AS root FROM core c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.frame_id = c.frame_id AND e.src = c.point_id AND e.dst < c.point_id)),
reach(frame_id, root, point_id) AS (SELECT frame_id, root, root FROM firsts UNION SELECT r.frame_id, r.root, e.dst FROM reach r JOIN e ON e.frame_id = r.frame_id AND e.src = r.point_id),
cr AS (SELECT frame_id, point_id, min(root) AS root FROM reach GROUP BY ALL),
cc AS (SELECT frame_id, point_id, dense_rank() OVER (PARTITION BY frame_id ORDER BY root) - 1 AS cluster_id FROM cr),
bb AS (SELECT p.frame_id, p.src AS point_id, min(cluster_id) AS cluster_id FROM pairs p JOIN cc ON cc.frame_id = p.frame_id AND cc.point_id = p.dst
  WHERE NOT EXISTS (SELECT 1 FROM core k WHERE k.frame_id = p.frame_id AND k.point_id = p.src) GROUP BY ALL),
lab AS (SELECT emb.frame_id, emb.point_id, emb.x, emb.y, emb.z, coalesce(cc.cluster_id, bb.cluster_id, -1) AS cluster_id FROM emb
  LEFT JOIN cc ON cc.frame_id = emb.frame_id AND cc.point_id = emb.point_id LEFT JOIN bb ON bb.frame_id = emb.frame_id AND bb.point_id = emb.point_id),
sizes AS (SELECT frame_id, cluster_id, count(*) AS n FROM lab WHERE cluster_id >= 0 GROUP BY ALL)"""
CELL = f"CAST(floor(x/{EPS}) AS BIGINT) AS cx, CAST(floor(y/{EPS}) AS BIGINT) AS cy, CAST(floor(z/{EPS}) AS BIGINT) AS cz"

SQL = {
    "q_load_points": f"WITH {EMB_SQL} SELECT frame_id, count(*) AS n, CAST(sum(CAST(round(x*50) AS INT)) AS BIGINT) AS sum_xi, CAST(sum(CAST(round(y*50) AS INT)) AS BIGINT) AS sum_yi, CAST(sum(CAST(round(z*50) AS INT)) AS BIGINT) AS sum_zi FROM emb GROUP BY frame_id",
    "q_frame_bbox": f"WITH {EMB_SQL} SELECT frame_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM emb GROUP BY frame_id",
    "q_raw_size_bits": f"WITH {SCAN_SQL} SELECT frame_id, count(*)*96 AS raw_bits FROM scan GROUP BY frame_id",
    "q_depth": f"WITH {EMB_SQL} SELECT point_id, round(sqrt(x*x+y*y+z*z), 6) AS depth FROM emb",
    "q_depth_bands": f"WITH {SCAN_SQL}, d AS (SELECT frame_id, sqrt(x*x+y*y+z*z) AS depth FROM scan) SELECT frame_id, {BAND} AS band, count(*) AS n FROM d GROUP BY 1, 2",
    "q_dropped_points": f"WITH {SCAN_SQL}, d AS (SELECT frame_id, sqrt(x*x+y*y+z*z) AS depth FROM scan) SELECT frame_id, count(*) AS n_dropped FROM d WHERE {BAND} IS NULL GROUP BY 1",
    "q_max_depth_per_band": f"WITH {SCAN_SQL}, d AS (SELECT frame_id, sqrt(x*x+y*y+z*z) AS depth FROM scan) SELECT frame_id, {BAND} AS band, round(max(depth), 6) AS max_depth FROM d WHERE {BAND} IS NOT NULL GROUP BY 1, 2",
    "q_quantise_uniform": f"WITH {EMB_SQL} SELECT point_id, {Q('x', 2 / R, 'xi')}, {Q('y', 2 / R, 'yi')}, {Q('z', 2 / R, 'zi')} FROM emb",
    "q_quantise_per_axis": f"WITH {EMB_SQL} SELECT point_id, {Q('x', 2 / R, 'xi')}, {Q('y', 2 / R, 'yi')}, {Q('z', 1 / R, 'zi')} FROM emb",
    "q_dequantise_error": f"WITH {EMB_SQL}, e AS (SELECT frame_id, greatest(" + ", ".join(f"abs({c} - CAST(round({c}*{2 / R}) AS INT)/{2 / R})" for c in "xyz") + f") AS err FROM emb) SELECT frame_id, round(max(err), 9) AS max_error, max(err) <= {R / 4} + 1e-9 AS in_bound FROM e GROUP BY 1",
    "q_to_spherical": f"WITH {EMB_SQL}, s AS (SELECT point_id, {SPH} FROM emb) SELECT point_id, round(xy_ang, 6) AS xy_ang, round(z_ang, 6) AS z_ang, round(depth, 6) AS depth FROM s",
    "q_to_cartesian_roundtrip": f"WITH {EMB_SQL} SELECT point_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM emb",
    "q_quantise_spherical": f"WITH {SCAN_Q} SELECT frame_id, band, ring, count(*) AS n, min(qdepth) AS min_qdepth, max(qdepth) AS max_qdepth, CAST(sum(qdepth) AS BIGINT) AS sum_qdepth FROM q GROUP BY 1, 2, 3",
    "q_line_thresholds": f"WITH {SCAN_Q} SELECT frame_id, band, CAST(round(radians(360.0)/2000/({RS}/max_depth)) AS INT) AS ref_point_th, CAST(round(radians(27.4)/64/({RS}/max_depth)) AS INT) AS z_ang_th, CAST(66 AS INT) AS depth_diff_th FROM most",
    "q_grid_cells": f"WITH {EMB_SQL} SELECT point_id, {CELL} FROM emb",
    "q_grid_histogram": f"WITH {EMB_SQL}, c AS (SELECT frame_id, {CELL}, count(*) AS points FROM emb GROUP BY ALL) SELECT frame_id, points, count(*) AS cells FROM c GROUP BY 1, 2",
    "q_eps_neighbours": f"WITH {EMB_SQL}, {PAIRS.format(NEAR * NEAR)} SELECT frame_id, src, dst, round(d2, 6) AS d2 FROM pairs",
    "q_degree": f"WITH {DEG} SELECT * FROM deg",
    "q_core_points": f"WITH {DEG} SELECT frame_id, point_id FROM deg WHERE degree >= 78",
    "q_clusters": f"WITH {CLUSTER} SELECT frame_id, point_id, cluster_id FROM lab",
    "q_cluster_sizes": f"WITH {CLUSTER} SELECT * FROM sizes",
    "q_dense_sparse": f"WITH {CLUSTER} SELECT l.frame_id, coalesce(n > 300, false) AND sqrt(x*x+y*y+z*z) < 100 AS dense, count(*) AS n FROM lab l LEFT JOIN sizes USING (frame_id, cluster_id) GROUP BY 1, 2",
    "q_rate_split": f"WITH {EMB_SQL}, r AS (SELECT frame_id, point_id, row_number() OVER (PARTITION BY frame_id ORDER BY x*x+y*y+z*z, point_id) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM emb) SELECT frame_id, point_id FROM r WHERE i < n*0.3",
    "q_approximate_core_cells": f"WITH {EMB_SQL}, c AS (SELECT frame_id, {CELL}, count(*) AS n FROM emb GROUP BY ALL) SELECT a.frame_id, a.cx, a.cy, a.cz, a.n, CAST(sum(b.n) AS BIGINT) AS around FROM c a JOIN c b ON a.frame_id = b.frame_id AND abs(a.cx-b.cx) <= 1 AND abs(a.cy-b.cy) <= 1 AND abs(a.cz-b.cz) <= 1 GROUP BY ALL HAVING sum(b.n) >= 78",
    "q_nearest_neighbour": f"WITH {EMB_SQL}, {PAIRS.format(NEAR * NEAR)}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, src ORDER BY d2, dst) AS k FROM pairs) SELECT frame_id, src AS point_id, dst AS nearest_id, round(d2, 6) AS d2 FROM r WHERE k = 1",
    "q_directional_nn": f"""WITH {SCAN_S.replace("atan2(y, x) + 2*pi()) % (2*pi()) AS xy_ang", "atan2(y, x) + 2*pi()) % (2*pi()) AS xy_raw, round(xy_raw, 9) AS xy_ang")}, p AS (SELECT a.frame_id, a.point_id, b.point_id AS right_id, sqrt((b.xy_ang-a.xy_ang)*(b.xy_ang-a.xy_ang) + 25*(b.z_ang-a.z_ang)*(b.z_ang-a.z_ang) + 1e-6*(b.depth-a.depth)*(b.depth-a.depth)) AS d
      FROM s a JOIN s b ON a.frame_id = b.frame_id AND b.xy_ang BETWEEN a.xy_ang AND a.xy_ang + 0.01 AND a.point_id <> b.point_id WHERE abs(b.z_ang - a.z_ang) <= 0.05)
      SELECT frame_id, point_id, right_id, round(d, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, point_id ORDER BY round(d, 9), right_id) AS k FROM p) WHERE k = 1""",
}
QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
