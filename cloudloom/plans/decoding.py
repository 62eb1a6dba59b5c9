"""Queries that decode what the trees and lines store, and that prepare streams for coding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import density, symbols, trees
from cloudloom.operators.places import swept
from cloudloom.plans.clouds import RS, SCAN_Q, quantised_scan
from cloudloom.plans.structures import OCC_SQL, OCT, OCT_SQL, QUAD, QUAD_SQL, RT, octree, quadtree
from cloudloom.sources.fixtures import EMB_SQL, emb

#: Share of a frame's points, nearest first, that go to the octree; limits of the counts of a byte and an integer coder, and a low one.
RATE, LIMITS = 0.2, (1 << 8, 1 << 16, 1 << 48)


def stored(points: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a tree stores: occupancy and counts of leaves, as sequences."""
    leaves = trees.leaves(points, names)
    return trees.breadth_first(trees.occupancy(leaves, names), ["level", "morton"], "occupancy"), trees.breadth_first(trees.leaf_counts(leaves, names), ["morton"], "n")


def q_octree_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The occupancy bytes of every frame's octree in breadth-first order."""
    return stored(octree(spark, sf), OCT)[0]


def q_octree_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf cells and counts again, from the two sequences alone."""
    leaves = trees.decoded_leaves(*stored(octree(spark, sf), OCT), 3)
    return leaves.select("frame_id", *[c.alias(n) for c, n in zip(G.unmorton("morton", 3), OCT, strict=True)], "n")


def q_quadtree_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The same for quadtrees."""
    leaves = trees.decoded_leaves(*stored(quadtree(spark, sf), QUAD), 2)
    return leaves.select("frame_id", *[c.alias(n) for c, n in zip(G.unmorton("morton", 2), QUAD, strict=True)], "n")


def q_shared_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any leaf holds several points, so that counts must be stored."""
    leaves = trees.leaves(octree(spark, sf), OCT)
    return leaves.groupBy("frame_id").agg((F.max("n") > 1).alias("shared"), F.count("*").alias("leaves"))


def q_rescaled_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of occupancy bytes under three coders' limits, and large ones (in units of 2^-40) as well."""
    hist = symbols.histogram(trees.occupancy(trees.leaves(octree(spark, sf), OCT), OCT), ["frame_id"], "occupancy")
    both = hist.withColumn("large", F.lit(False)).union(hist.select("frame_id", "symbol", F.shiftleft("n", 40), F.lit(True)))
    return reduce(DataFrame.unionByName, [symbols.rescaled(both, ["frame_id", "large"], limit).withColumn("limit", F.lit(limit).cast("long")) for limit in LIMITS])


def occupancy_table(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The occupancy stream of the octrees, and its cumulative counts."""
    stream = trees.occupancy(trees.leaves(octree(spark, sf), OCT), OCT)
    return stream, symbols.cumulative(symbols.histogram(stream, ["frame_id"], "occupancy"), ["frame_id"])


def q_symbol_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The range of counts of every node's occupancy, as a coder looks it up."""
    return symbols.ranges(*occupancy_table(spark, sf), ["frame_id"], "occupancy")


def q_symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol that a count falls on, as a decoder searches it: a count for every node, and one beyond the last."""
    stream, table = occupancy_table(spark, sf)
    total = table.groupBy("frame_id").agg(F.sum("n").alias("total"))
    counts = stream.join(total, "frame_id").select("frame_id", "level", "morton", F.expr("(morton * 7919 + level) % (total + 1)").alias("count"))
    return symbols.symbols_at(counts, table, ["frame_id"], "count")


def q_narrow_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Azimuth differences along the rings: which bands' streams fit bytes."""
    q = swept(quantised_scan(spark, sf).select("frame_id", "band", "ring", "az"), ["frame_id", "band", "ring"], ["az"], lasts=("az",))
    return symbols.narrow_streams(q.where("place > 0").withColumn("dx", F.col("az") - F.col("last_az")), ["frame_id", "band"], "dx")


def q_spherical_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Angles and depths from their steps, and the largest error of a depth in steps."""
    q = quantised_scan(spark, sf)
    return q.select("point_id", *[F.round(c, 7).alias(n) for c, n in zip(G.dequantised_spherical(RS, F.col("max_depth")), ("xy_ang", "z_ang", "depth"), strict=True)])


def q_decoded_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every point as it is decoded, path after path: 0 octree, 1 to 3 bands of lines, 4 quadtree."""
    split = density.rate_split(emb(spark, sf).select("frame_id", "point_id", *G.XYZ), RATE)
    dense = trees.placed(split.where("dense").select("frame_id", "point_id", *G.quantised(2 / RT)))
    rest = split.where("not dense").withColumn("band", G.band(G.depth()))
    flat = trees.placed(rest.where("band is null").select("frame_id", "point_id", *G.quantised((2 / RT, 2 / RT, 1 / RT))), ("xi", "yi"))
    sphere = rest.where("band is not null").select("frame_id", "point_id", "band", *G.spherical())
    most = sphere.groupBy("frame_id", "band").agg(F.max("depth").alias("max_depth"))
    steps = sphere.join(most, ["frame_id", "band"]).select("frame_id", "point_id", "band", "max_depth", *G.quantised_spherical(RT, F.col("max_depth")))
    back = steps.select("frame_id", "point_id", "band", *G.dequantised_spherical(RT, F.col("max_depth"))).select("frame_id", "point_id", (F.col("band") + 1).alias("path"), *G.cartesian())
    out = dense.select("frame_id", "point_id", F.lit(0).alias("path"), *trees.reconstruct(dense, ("xi", "yi", "zi"), (2 / RT,) * 3))
    far = flat.select("frame_id", "point_id", F.lit(4).alias("path"), *trees.reconstruct(flat, ("xi", "yi"), (2 / RT,) * 2), (F.col("zi") * RT).alias("rz"))
    named = ["frame_id", "point_id", "path", "rx", "ry", "rz"]
    return reduce(DataFrame.union, [d.toDF(*named) for d in (out, back, far)]).select(*named[:3], *[F.round(c, 5).alias(c) for c in named[3:]])


TABLE = f"{OCC_SQL}, hs AS (SELECT frame_id, occupancy AS symbol, count(*) AS n FROM occ GROUP BY 1, 2), tb AS (SELECT *, CAST(sum(n) OVER (PARTITION BY frame_id ORDER BY symbol) - n AS BIGINT) AS cum FROM hs)"
RESCALE = "SELECT h.frame_id, h.large, h.symbol, h.n, s.shift, CASE WHEN s.shift IS NOT NULL THEN greatest(1, h.n >> s.shift) END AS scaled, CAST({0} AS BIGINT) AS \"limit\" FROM b h LEFT JOIN (SELECT frame_id, large, min(shift) AS shift FROM sums WHERE total < {0} GROUP BY 1, 2) s ON s.frame_id = h.frame_id AND s.large = h.large"
PATHS = f"""{EMB_SQL}, k AS (SELECT *, sqrt(x*x + y*y + z*z) AS depth, row_number() OVER (PARTITION BY frame_id ORDER BY x*x + y*y + z*z, point_id) - 1 < count(*) OVER (PARTITION BY frame_id) * {RATE} AS dense FROM emb),
di AS (SELECT frame_id, point_id, CAST(round(x*{2 / RT}) AS BIGINT) AS xi, CAST(round(y*{2 / RT}) AS BIGINT) AS yi, CAST(round(z*{2 / RT}) AS BIGINT) AS zi FROM k WHERE dense),
db AS (SELECT frame_id, min(xi) AS x0, min(yi) AS y0, min(zi) AS z0 FROM di GROUP BY 1),
fi AS (SELECT frame_id, point_id, CAST(round(x*{2 / RT}) AS BIGINT) AS xi, CAST(round(y*{2 / RT}) AS BIGINT) AS yi, CAST(round(z*{1 / RT}) AS BIGINT) AS zi FROM k WHERE NOT dense AND NOT (depth > 0 AND depth <= 100)),
fb AS (SELECT frame_id, min(xi) AS x0, min(yi) AS y0 FROM fi GROUP BY 1),
sp AS (SELECT frame_id, point_id, CASE WHEN depth <= 25 THEN 0 WHEN depth <= 50 THEN 1 ELSE 2 END AS band, (atan2(y, x) + 2*pi()) % (2*pi()) AS t, atan2(z, sqrt(x*x + y*y)) AS p, depth FROM k WHERE NOT dense AND depth > 0 AND depth <= 100),
st AS (SELECT *, {RT} / max(depth) OVER (PARTITION BY frame_id, band) AS step FROM sp),
ba AS (SELECT frame_id, point_id, band, CAST(round(t/step) AS INT)*step AS t, CAST(round(p/step) AS INT)*step AS p, CAST(round(depth/{RT}) AS INT)*CAST({RT} AS DOUBLE) AS d FROM st)"""
CENTRE = "(({0}0 - 1 + 2*(({0}i - {0}0 + 1)>>1) + 0.5)/{1})"

SQL = {
    "q_octree_sequence": f"WITH {OCC_SQL} SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY level, morton) - 1 AS place, occupancy FROM occ",
    "q_octree_decode": f"WITH {OCT_SQL} SELECT frame_id, lx, ly, lz, count(*) AS n FROM t GROUP BY 1, 2, 3, 4",
    "q_quadtree_decode": f"WITH {QUAD_SQL} SELECT frame_id, lx, ly, count(*) AS n FROM t GROUP BY 1, 2, 3",
    "q_shared_leaves": f"WITH {OCT_SQL}, l AS (SELECT frame_id, lx, ly, lz, count(*) AS n FROM t GROUP BY 1, 2, 3, 4) SELECT frame_id, max(n) > 1 AS shared, count(*) AS leaves FROM l GROUP BY 1",
    "q_rescaled_counts": f"""WITH {OCC_SQL}, hs AS (SELECT frame_id, occupancy AS symbol, count(*) AS n FROM occ GROUP BY 1, 2),
      b AS (SELECT frame_id, false AS large, symbol, n FROM hs UNION ALL SELECT frame_id, true, symbol, n << 40 FROM hs),
      sums AS (SELECT frame_id, large, shift, sum(greatest(1, n >> shift)) AS total FROM b, (SELECT CAST(unnest(range(0, 63)) AS INT) AS shift) GROUP BY 1, 2, 3)
      """ + " UNION ALL ".join(RESCALE.format(limit) for limit in LIMITS),
    "q_symbol_ranges": f"WITH {TABLE} SELECT o.*, cum AS low, cum + n AS high FROM occ o JOIN tb ON tb.frame_id = o.frame_id AND symbol = occupancy",
    "q_symbol_search": f"""WITH {TABLE}, tot AS (SELECT frame_id, CAST(sum(n) AS BIGINT) AS total FROM tb GROUP BY 1),
      c AS (SELECT frame_id, level, morton, (morton * 7919 + level) % (total + 1) AS "count" FROM occ JOIN tot USING (frame_id))
      SELECT c.*, symbol, cum AS low FROM c LEFT JOIN tb ON tb.frame_id = c.frame_id AND cum <= "count" AND "count" < cum + n""",
    "q_narrow_streams": f"""WITH {SCAN_Q}, d AS (SELECT frame_id, band, az - lag(az) OVER (PARTITION BY frame_id, band, ring ORDER BY az) AS dx, row_number() OVER (PARTITION BY frame_id, band, ring ORDER BY az) AS k FROM q)
      SELECT frame_id, band, count(*) AS n, max(dx) AS largest, max(dx) < 256 AS narrow, count(*) * CASE WHEN max(dx) < 256 THEN 1 ELSE 4 END AS bytes FROM d WHERE k > 1 GROUP BY 1, 2""",
    "q_spherical_restored": f"WITH {SCAN_Q} SELECT point_id, round(qxy*({RS}/max_depth), 7) AS xy_ang, round(qz*({RS}/max_depth), 7) AS z_ang, round(qdepth*CAST({RS} AS DOUBLE), 7) AS depth FROM q",
    "q_decoded_paths": f"""WITH {PATHS}, o AS (
      SELECT frame_id, point_id, 0 AS path, """ + ", ".join(f"{CENTRE.format(a, 2 / RT)} AS r{a}" for a in "xyz") + """ FROM di JOIN db USING (frame_id)
      UNION ALL SELECT frame_id, point_id, band + 1, d*cos(p)*cos(t), d*cos(p)*sin(t), d*sin(p) FROM ba
      UNION ALL SELECT frame_id, point_id, 4, """ + ", ".join(CENTRE.format(a, 2 / RT) for a in "xy") + f""", zi*CAST({RT} AS DOUBLE) FROM fi JOIN fb USING (frame_id))
      SELECT frame_id, point_id, path, round(rx, 5) AS rx, round(ry, 5) AS ry, round(rz, 5) AS rz FROM o""",
}
QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
