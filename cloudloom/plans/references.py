"""Queries on reference lines of the sweep: sessions, overlays and the choice of a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import overlay
from cloudloom.plans.clouds import RS, SCAN_Q, quantised_scan, spherical_scan
from cloudloom.sources.fixtures import SCAN_SQL
from cloudloom.workspace import materialise

BAND, LINE = ["frame_id", "band"], ["ring", "run"]
#: In azimuth numbers: a line ends before a larger gap, a reference is at most so far away. Depth steps that ask for a choice.
GAP, ACROSS, JUMP = 3, 3, int(2.0 / RS)


def scan_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked points, spans and references of the sweep's lines: runs of a ring's points of a band."""
    q = materialise(quantised_scan(spark, sf).select(*BAND, "ring", F.col("az").alias("qxy"), "qz", "qdepth", "max_depth"), "sweep")
    lines = overlay.runs(q, [*BAND, "ring"], "qxy", GAP)
    points, spans = overlay.ranked_lines(lines, BAND, LINE, "qxy")
    spans = materialise(spans, "spans")
    reach = q.groupBy(*BAND).agg(F.max("max_depth").alias("max_depth")).select(*BAND, *G.line_thresholds(RS, F.col("max_depth"))).select(*BAND, "z_ang_th")
    pairs = overlay.references(spans.join(reach, BAND), BAND, "z_ang_th")
    return materialise(points, "points"), spans, materialise(pairs, "pairs")


def q_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep's lines: runs without a gap, ranked by elevation and azimuth."""
    _, spans, _ = scan_lines(spark, sf)
    return spans.select(*BAND, *LINE, "rank", "qz", "front", "back", "n")


def q_consensus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All points of every line's consensus: later references painted over earlier ones."""
    points, spans, pairs = scan_lines(spark, sf)
    return overlay.consensus(points, spans, BAND, pairs)


def q_reference_choice(spark: SparkSession, sf: str) -> DataFrame:
    """For every point with references on both sides: which of the four candidates predicts the next depth, if the depths disagree."""
    points, spans, pairs = scan_lines(spark, sf)
    painted = materialise(overlay.consensus(points, spans, BAND, pairs), "painted")
    return overlay.predicted_from(points.withColumns({"across": F.lit(ACROSS), "jump": F.lit(JUMP)}), painted, BAND, "across", "jump")


def q_tolerant_order(spark: SparkSession, sf: str) -> DataFrame:
    """Points of each band by azimuth, equal up to a millionth, and then by elevation."""
    s = spherical_scan(spark, sf).select(*BAND, "point_id", "xy_ang", "z_ang")
    return overlay.tolerant_order(s, BAND, "xy_ang", "z_ang").select(*BAND, "point_id", "place")


LINES_SQL = f"""{SCAN_Q}, far AS (SELECT *, CAST(coalesce(az - lag(az) OVER (PARTITION BY frame_id, band, ring ORDER BY az) > {GAP}, false) AS INT) AS far FROM q),
r AS (SELECT *, CAST(sum(far) OVER (PARTITION BY frame_id, band, ring ORDER BY az) AS INT) AS run FROM far),
sp AS (SELECT frame_id, band, ring, run, arg_min(qz, az) AS qz, min(az) AS front, max(az) AS back, count(*) AS n FROM r GROUP BY ALL),
sr AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id, band ORDER BY qz, front, ring, run) AS INT) AS rank FROM sp),
pt AS (SELECT frame_id, band, rank, CAST(row_number() OVER (PARTITION BY frame_id, band, rank ORDER BY az) - 1 AS INT) AS j, az AS qxy, qdepth FROM r JOIN sr USING (frame_id, band, ring, run)),
th AS (SELECT frame_id, band, CAST(round(radians(27.4)/64/({RS}/max_depth)) AS INT) AS z_ang_th FROM most),
pr AS (SELECT a.frame_id, a.band, a.rank, b.rank AS ref FROM sr a JOIN th USING (frame_id, band) JOIN sr b ON b.frame_id = a.frame_id AND b.band = a.band AND b.rank < a.rank AND a.qz - b.qz <= z_ang_th)"""
CONSENSUS_SQL = f"""{LINES_SQL}, con AS (
  SELECT pr.frame_id, pr.band, pr.rank, pr.ref, p.j, p.qxy, p.qdepth FROM pr JOIN pt p ON p.frame_id = pr.frame_id AND p.band = pr.band AND p.rank = pr.ref
  WHERE NOT EXISTS (SELECT 1 FROM pr p2 JOIN sr s2 ON s2.frame_id = p2.frame_id AND s2.band = p2.band AND s2.rank = p2.ref
    WHERE p2.frame_id = pr.frame_id AND p2.band = pr.band AND p2.rank = pr.rank AND p2.ref > pr.ref AND s2.front < p.qxy AND p.qxy <= s2.back)),
painted AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id, band, rank ORDER BY qxy, ref, j) - 1 AS INT) AS place FROM con)"""

SQL = {
    "q_line_runs": f"WITH {LINES_SQL} SELECT frame_id, band, ring, run, rank, qz, front, back, n FROM sr",
    "q_consensus_lines": f"WITH {CONSENSUS_SQL} SELECT frame_id, band, rank, place, ref, j, qxy, qdepth FROM painted",
    "q_reference_choice": f"""WITH {CONSENSUS_SQL},
      st AS (SELECT *, lead(qxy) OVER w AS nxt, lead(qdepth) OVER w AS thn FROM pt WINDOW w AS (PARTITION BY frame_id, band, rank ORDER BY j)),
      lf AS (SELECT s.frame_id, s.band, s.rank, s.j, max(p.place) AS l
        FROM st s JOIN painted p ON p.frame_id = s.frame_id AND p.band = s.band AND p.rank = s.rank AND p.qxy <= s.qxy WHERE s.nxt IS NOT NULL GROUP BY 1, 2, 3, 4),
      rt AS (SELECT s.frame_id, s.band, s.rank, s.j, count(*) AS before
        FROM st s JOIN painted p ON p.frame_id = s.frame_id AND p.band = s.band AND p.rank = s.rank AND p.qxy < s.nxt GROUP BY 1, 2, 3, 4),
      ends AS (SELECT frame_id, band, rank, j, l, greatest(l + 1, rt.before) AS r FROM lf JOIN rt USING (frame_id, band, rank, j)),
      met AS (SELECT s.*, a.qdepth AS ul, b.qdepth AS um, c.qdepth AS ur FROM st s JOIN ends USING (frame_id, band, rank, j)
        JOIN painted a ON a.frame_id = s.frame_id AND a.band = s.band AND a.rank = s.rank AND a.place = l
        JOIN painted b ON b.frame_id = s.frame_id AND b.band = s.band AND b.rank = s.rank AND b.place = r - 1
        JOIN painted c ON c.frame_id = s.frame_id AND c.band = s.band AND c.rank = s.rank AND c.place = r
        WHERE s.qxy - a.qxy <= {ACROSS} AND c.qxy - s.nxt <= {ACROSS}),
      k AS (SELECT *, CASE WHEN greatest(abs(ur - ul), abs(ur - qdepth), abs(ul - qdepth)) <= {JUMP} THEN NULL
        WHEN abs(ul - thn) < least(abs(um - thn), abs(ur - thn), abs(qdepth - thn)) THEN 'UL'
        WHEN abs(um - thn) < least(abs(ur - thn), abs(qdepth - thn)) THEN 'UM'
        WHEN abs(ur - thn) < abs(qdepth - thn) THEN 'UR' ELSE 'BL' END AS kind FROM met)
      SELECT frame_id, band, rank, j, kind, CASE kind WHEN 'UL' THEN ul WHEN 'UM' THEN um WHEN 'UR' THEN ur WHEN 'BL' THEN qdepth END AS ref_qdepth FROM k""",
    "q_tolerant_order": f"""WITH {SCAN_SQL}, s AS (SELECT frame_id, point_id, (atan2(y, x) + 2*pi()) % (2*pi()) AS xy_ang, atan2(z, sqrt(x*x + y*y)) AS z_ang, sqrt(x*x + y*y + z*z) AS depth FROM scan),
      b AS (SELECT *, CASE WHEN depth <= 25 THEN 0 WHEN depth <= 50 THEN 1 ELSE 2 END AS band FROM s WHERE depth > 0 AND depth <= 100),
      g AS (SELECT *, CAST(coalesce(xy_ang - lag(xy_ang) OVER (PARTITION BY frame_id, band ORDER BY xy_ang) > 1e-6, false) AS INT) AS far FROM b),
      t AS (SELECT *, sum(far) OVER (PARTITION BY frame_id, band ORDER BY xy_ang) AS run FROM g)
      SELECT frame_id, band, point_id, row_number() OVER (PARTITION BY frame_id, band ORDER BY run, z_ang, xy_ang) - 1 AS place FROM t""",
}
QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
