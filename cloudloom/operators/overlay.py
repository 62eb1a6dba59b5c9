"""Reference lines painted over each other, and the candidates that a point's depth is predicted from.

A line leans on the lines before it, in order of elevation and azimuth, that start
within one ring's elevation below it. Painted in that order they make up its
consensus line: a later line takes the azimuths that it spans, behind its first
one up to its last, from all earlier ones. Nothing is painted: spans of a line's
references are cut into elementary intervals at their ends, the latest span over
an interval owns it, and a reference's point stays if no later line owns its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of candidates: left above, middle above, right above, left below.
KINDS = ("UL", "UM", "UR", "BL")


def runs(points: DataFrame, keys: list[str], order: str, gap: float) -> DataFrame:
    """``points`` with ``run``: a session of its key's points, numbered from 0; a new one starts where ``order`` grows by more than ``gap``."""
    by = Window.partitionBy(*keys).orderBy(order)
    far = F.coalesce(F.col(order) - F.lag(order).over(by) > gap, F.lit(False)).cast("int")
    return points.withColumn("_far", far).withColumn("run", F.sum("_far").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_far")


def tolerant_order(points: DataFrame, keys: list[str], first: str, then: str, tolerance: float = 1e-6) -> DataFrame:
    """``points`` with ``place`` (from 0) by ``first`` and then ``then``, where values of ``first`` in steps of at most ``tolerance`` count as one.

    Comparing with a tolerance is no order; sessions of close values are, and differ from it in chains of such values only.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("run", then, first)) - 1
    return runs(points, keys, first, tolerance).withColumn("place", number.cast("long")).drop("run")


def ranked_lines(points: DataFrame, keys: list[str], line: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Points and spans of lines: both with ``rank``, the line's place among its key's lines.

    ``points`` has qxy, qz and qdepth; lines are ordered by their first point's
    elevation and azimuth, then by ``line``. Spans are ``(keys, line, rank, qz, front, back, n)``.
    """
    ends = points.groupBy(*keys, *line).agg(F.min_by("qz", order).alias("qz"), F.min_by("qxy", order).alias("front"), F.max_by("qxy", order).alias("back"), F.count("*").alias("n"))
    spans = ends.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("qz", "front", *line)))
    placed = points.join(spans.select(*keys, *line, "rank"), [*keys, *line])
    placed = placed.withColumn("j", F.row_number().over(Window.partitionBy(*keys, "rank").orderBy(order)) - 1)
    return placed.select(*keys, "rank", "j", "qxy", "qdepth"), spans


def references(spans: DataFrame, keys: list[str], reach: str) -> DataFrame:
    """``(keys, rank, ref)``: the lines before each that start at most ``reach`` (a column, one value a key) below it."""
    step = F.floor(F.col("qz") / F.col(reach))
    low = spans.select(*keys, F.col("qz").alias("z0"), F.col("rank").alias("ref"), F.explode(F.array(step, step + 1)).alias("step"))
    met = spans.select(*keys, "rank", "qz", reach, step.alias("step")).join(low, [*keys, "step"])
    return met.where((F.col("ref") < F.col("rank")) & (F.col("qz") - F.col("z0") <= F.col(reach))).select(*keys, "rank", "ref")


def owned_intervals(spans: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """``(keys, rank, low, owner)``: where each elementary interval of a line's references starts (up to the next), and its latest line, if any."""
    here = pairs.join(spans.select(*keys, F.col("rank").alias("ref"), "front", "back"), [*keys, "ref"])
    cuts = here.select(*keys, "rank", F.explode(F.array("front", "back")).alias("low")).distinct()
    over = cuts.join(here, [*keys, "rank"]).where("front <= low and low < back").groupBy(*keys, "rank", "low").agg(F.max("ref").alias("owner"))
    return cuts.join(over, [*keys, "rank", "low"], "left")


def consensus(points: DataFrame, spans: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """``(keys, rank, place, ref, j, qxy, qdepth)``: each line's consensus, its points numbered from 0 by azimuth.

    An interval starts behind its cut, so a point is in that of the last cut before it.
    """
    by = Window.partitionBy(*keys, "rank")
    own = points.select(*keys, F.col("rank").alias("ref"), "j", "qxy", "qdepth")
    candidates = pairs.join(own, [*keys, "ref"]).select(*keys, "rank", "qxy", F.lit(0).alias("cut"), "ref", "j", "qdepth", F.lit(None).cast("int").alias("owner"))
    cuts = owned_intervals(spans, keys, pairs).select(*keys, "rank", F.col("low").alias("qxy"), F.lit(1).alias("cut"), F.lit(None).cast("int").alias("ref"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("int").alias("qdepth"), F.coalesce("owner", F.lit(0)).alias("owner"))
    swept = candidates.unionByName(cuts).withColumn("owner", F.last("owner", ignorenulls=True).over(by.orderBy("qxy", "cut").rowsBetween(Window.unboundedPreceding, 0)))
    stay = swept.where("cut = 0 and ref >= coalesce(owner, 0)")
    place = F.row_number().over(by.orderBy("qxy", "ref", "j")) - 1
    return stay.select(*keys, "rank", place.alias("place"), "ref", "j", "qxy", "qdepth")


def predicted_from(points: DataFrame, painted: DataFrame, keys: list[str], across: str, jump: str) -> DataFrame:
    """``(keys, rank, j, kind, ref_qdepth)`` for each point that has a next one on its line and references on both sides.

    On the left it is the last of the consensus at or before point ``j``, but not its very
    last; on the right the first from the next point on, behind the left one; both at
    most ``across`` away. Where two of these depths and the point's own differ by more
    than ``jump``, the next point's depth is predicted from one of four (KINDS): the left if
    it is nearer than all others, else the one before the right if it is nearer than the right
    and the point itself, else the nearer of these two, on ties the point itself.
    ``kind`` is null where the depths agree. ``across`` and ``jump`` are columns of ``points``.
    """
    line = [*keys, "rank"]
    ahead = Window.partitionBy(*line).orderBy("j")
    steps = points.withColumn("next", F.lead("qxy").over(ahead)).withColumn("then", F.lead("qdepth").over(ahead)).where("next is not null")
    # how many of the consensus lie before: one sweep for the points and the next ones
    here = steps.select(*line, "j", F.explode(F.array(F.struct(F.col("qxy").alias("at"), F.lit(1).alias("turn")), F.struct(F.col("next").alias("at"), F.lit(-1).alias("turn")))).alias("e"))
    events = here.select(*line, "e.at", "e.turn", "j").unionByName(painted.select(*line, F.col("qxy").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("j")))
    counted = events.withColumn("n", F.count(F.when(F.col("turn") == 0, 1)).over(Window.partitionBy(*line).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)))
    at = counted.where("turn <> 0").groupBy(*line, "j").agg(F.max(F.when(F.col("turn") == 1, F.col("n") - 1)).alias("left"), F.max(F.when(F.col("turn") == -1, F.col("n"))).alias("right"))
    at = at.withColumn("right", F.greatest(F.col("right"), F.col("left") + 1)).where("left >= 0")
    end = lambda c: painted.select(*line, F.col("place").alias(c), F.col("qxy").alias(f"{c}_at"), F.col("qdepth").alias(f"{c}_depth"))
    found = at.withColumn("middle", F.col("right") - 1)
    for c in ("left", "middle", "right"):  # a right one exists only if the left one isn't the last
        found = found.join(end(c), [*line, c])
    met = steps.join(found, [*line, "j"]).where((F.col("qxy") - F.col("left_at") <= F.col(across)) & (F.col("right_at") - F.col("next") <= F.col(across)))
    names = {"UL": "left_depth", "UM": "middle_depth", "UR": "right_depth", "BL": "qdepth"}
    off = {k: F.abs(F.col(c) - F.col("then")) for k, c in names.items()}
    apart = lambda a, b: F.abs(F.col(a) - F.col(b)) > F.col(jump)
    differ = apart("right_depth", "left_depth") | apart("right_depth", "qdepth") | apart("left_depth", "qdepth")
    pick = F.when(off["UL"] < F.least(off["UM"], off["UR"], off["BL"]), "UL").when(off["UM"] < F.least(off["UR"], off["BL"]), "UM").when(off["UR"] < off["BL"], "UR").otherwise("BL")
    kind = F.when(differ, pick)
    depth = F.coalesce(*[F.when(kind == k, F.col(c)) for k, c in names.items()])
    return met.select(*line, "j", kind.alias("kind"), depth.alias("ref_qdepth"))
