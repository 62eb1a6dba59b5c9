"""Readers and writers of point clouds.

A file is a frame; frames are numbered by the rank of their file's name, points
by their place in the file. ``.bin`` files have a data source of their own
(``records``), all else goes through Spark's readers and writers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudloom.sources.records import read_records, write_frames
from cloudloom.workspace import materialise


def frame_numbers(files: DataFrame, path: str = "path") -> DataFrame:
    """``(path, frame_id)``: one row a file, numbered by name."""
    names = files.select(path).distinct()
    return names.withColumn("frame_id", (F.row_number().over(Window.orderBy(path)) - 1).cast("long"))


def read_bin(spark: SparkSession, path: str, stride: int = 16) -> DataFrame:
    """Points of headerless little-endian float records; 16 bytes have an intensity, trailing bytes are ignored."""
    return read_records(spark, path, stride)


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``(file, line_no, line)``: all lines of text files, numbered from 0 in each file, however many tasks read it.

    A line's number is its place in its block of the file and the lines of the blocks before.
    """
    text = spark.read.option("pathGlobFilter", glob).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = materialise(text.select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")), "lines")  # numbers of one reading
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Points of ``x y z intensity`` lines; a file ends at its first line that isn't numbers."""
    lines = numbered_lines(spark, path)
    parts = F.split(F.trim("line"), "\\s+")
    value = lambda i: F.expr(f"try_cast(get(p, {i}) as float)")
    rows = lines.where("trim(line) <> ''").withColumn("p", parts).select("file", F.col("line_no").alias("point_id"), *[value(i).alias(c) for i, c in enumerate(("x", "y", "z", "intensity"))])
    bad = rows.where("x is null or y is null or z is null").groupBy("file").agg(F.min("point_id").alias("stop"))
    kept = rows.join(bad, "file", "left").where("stop is null or point_id < stop").drop("stop")
    return kept.join(frame_numbers(lines, "file"), "file").select("frame_id", "point_id", "x", "y", "z", "intensity")


def read_points(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Points of a file or a folder, by its extension or by ``fmt``."""
    kind = fmt or path.rsplit(".", 1)[-1]
    if kind not in ("bin", "txt", "parquet"):
        raise ValueError(f"unknown point format: {kind}")
    return {"bin": read_bin, "txt": read_txt}[kind](spark, path) if kind != "parquet" else spark.read.parquet(path)


def txt_lines(points: DataFrame) -> Column:
    """One text line a point, six significant digits as C++ streams print them, intensity zero."""
    return F.format_string("%s %s %s 0.0", *[shortest(c) for c in ("x", "y", "z")])


def shortest(c: str) -> Column:
    """Up to six significant digits without trailing zeros, with an exponent below 0.0001 and from a million on."""
    v = F.col(c).cast("double")
    size = F.abs(v)
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(size, F.lit(1e-4)))).cast("int"))
    text = F.lit(None).cast("string")
    for d in range(10):
        text = F.when(digits == d, F.format_string(f"%.{d}f", F.bround(v, d))).otherwise(text)  # ties go to even digits, as in C
    fixed = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    far = F.regexp_replace(F.format_string("%.5e", v), r"\.?0+e", "e")
    return F.when(size == 0, "0").when((size < 1e-4) | (size >= 1e6), far).otherwise(fixed)


def ply_lines(points: DataFrame) -> DataFrame:
    """``(frame_id, line_no, line)`` of ASCII PLY files: a header, then the vertices."""
    head = ["ply", "format ascii 1.0", "element vertex ", "property float x", "property float y", "property float z", "element face 0", "property list uchar int vertex_indices", "end_header"]
    counts = points.groupBy("frame_id").agg(F.count("*").alias("n"))
    lines = counts.select("frame_id", "n", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("i", "h"))
    headers = lines.select("frame_id", (F.col("i") - len(head)).cast("long").alias("line_no"), F.when(F.col("i") == 2, F.concat("h", F.col("n").cast("string"))).otherwise(F.col("h")).alias("line"))
    body = points.select("frame_id", F.col("point_id").alias("line_no"), F.concat_ws(" ", *[shortest(c) for c in ("x", "y", "z")]).alias("line"))
    return headers.unionByName(body)


def write_points(points: DataFrame, path: str, fmt: str = "bin", stride: int = 16) -> None:
    """Write ``<frame_id>.bin`` files for ``bin``, in place of all that were there, or a folder for each frame (``frame_id=<n>``): text or PLY lines in order, or Parquet rows."""
    if fmt == "parquet":
        points.write.partitionBy("frame_id").parquet(path)
    elif fmt == "bin":
        write_frames(points, path, stride)
    elif fmt in ("txt", "ply"):
        lines = points.select("frame_id", F.col("point_id").alias("line_no"), txt_lines(points).alias("line")) if fmt == "txt" else ply_lines(points)
        ordered = lines.repartition("frame_id").sortWithinPartitions("frame_id", "line_no")
        ordered.select("frame_id", "line").write.partitionBy("frame_id").text(path)
    else:
        raise ValueError(f"unknown point format: {fmt}")


def blob_rows(blobs: DataFrame) -> DataFrame:
    """``(id, hex)``: blobs as lower-case hex, as a database's byte literal takes them."""
    return blobs.select(F.col("frame_id").alias("id"), F.lower(F.hex("blob")).alias("hex"))


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Append blobs (id, blob) or points (x, y, z, frame) to a database table."""
    df.write.mode("append").jdbc(url, table, properties=properties or {})


def point_rows(points: DataFrame) -> DataFrame:
    """``(x, y, z, frame)`` rows for a database."""
    return points.select("x", "y", "z", F.col("frame_id").alias("frame"))
