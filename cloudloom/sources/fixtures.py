"""Point clouds derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.workspace import materialise


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 points from each embedding, 10 frames, metres in -200..200."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select(F.col("label").cast("long").alias("frame_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    at = lambda k: (F.get("embedding", F.col("i") * 3 + k).cast("double") * 200)
    return rows.select("frame_id", (F.col("vec_id") * 21 + F.col("i")).alias("point_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def _turned(f: str, number: str, angles: list[float], angle: str) -> Column:
    """The sine or cosine of the sensor's numbered angles, by the C library as in SQL: the JVM's differ in the last bit; computed for other numbers."""
    return F.coalesce(F.get(F.lit([getattr(math, f)(a) for a in angles]), F.col(number)), F.expr(f"{f}({angle})"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensor sweep of 64 rings by 2000 azimuths a frame, from the orders.

    Depths lie on the ends of bands, so the last bit counts: all sums are of doubles in the order of the SQL; only its products are decimals.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    o = o.select(k.alias("point_id"), F.floor(k / 128000.0).cast("long").alias("frame_id"), F.floor((k % 128000) / 2000.0).cast("int").alias("ring"), (k % 2000).cast("int").alias("az"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    rho = F.expr("5 + 10 * double(floor(az / 125.0)) + double((az % 125) * 0.01) + double((cents % 7) * 0.01) + case when cents % 97 = 0 then 20 else 0 end")
    o = o.select("*", F.expr("az * 2 * pi() / 2000").alias("th"), F.expr("radians(-24.9D + double(ring * 27.4) / 64)").alias("ph"), rho.alias("rho"))
    th, ph = [az * 2 * math.pi / 2000 for az in range(2000)], [(-24.9 + ring * 274 / 10 / 64) * (math.pi / 180) for ring in range(64)]
    across = F.col("rho") * _turned("cos", "ring", ph, "ph")
    cloud = o.select("frame_id", "point_id", "ring", "az", (across * _turned("cos", "az", th, "th")).alias("x"), (across * _turned("sin", "az", th, "th")).alias("y"), (F.col("rho") * _turned("sin", "ring", ph, "ph")).alias("z"))
    return materialise(cloud, "scan")  # as a file of points would be; else every use repeats the trigonometry


EMB_SQL = """emb AS (
  SELECT CAST(label AS BIGINT) AS frame_id, vec_id*21 + i AS point_id,
         CAST(embedding[3*i+1] AS DOUBLE)*200 AS x, CAST(embedding[3*i+2] AS DOUBLE)*200 AS y, CAST(embedding[3*i+3] AS DOUBLE)*200 AS z
  FROM embeddings, range(0, 21) t(i))"""
SCAN_SQL = """scan_k AS (
  SELECT o_orderkey AS point_id, CAST(floor(o_orderkey/128000.0) AS BIGINT) AS frame_id,
         CAST(floor((o_orderkey % 128000)/2000.0) AS INT) AS ring, CAST(o_orderkey % 2000 AS INT) AS az,
         CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders),
scan_d AS (
  SELECT *, az*2*pi()/2000 AS th, radians(-24.9 + ring*27.4/64) AS ph,
         CAST(5 + 10*floor(az/125.0) + (az % 125)*0.01 + (cents % 7)*0.01 + CASE WHEN cents % 97 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS rho
  FROM scan_k),
scan AS (
  SELECT frame_id, point_id, ring, az, rho*cos(ph)*cos(th) AS x, rho*cos(ph)*sin(th) AS y, rho*sin(ph) AS z FROM scan_d)"""
