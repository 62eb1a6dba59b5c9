import glob
import struct

import pytest
from cloudloom import __main__ as cli
from cloudloom import schema as S
from cloudloom.plans import compress as C
from cloudloom.sources import points as P
from cloudloom.streaming import frames
from pyspark.sql import functions as F

XYZ = [(1.5, -2.25, 0.125, 9.0), (0.0, 3.0, -7.5, 1.0), (100.25, 0.5, 0.0, 0.0)]


def write_bins(folder, names=("0.bin", "1.bin")):
    folder.mkdir(exist_ok=True)
    for k, n in enumerate(names):
        (folder / n).write_bytes(b"".join(struct.pack("<4f", x + k, y, z, i) for x, y, z, i in XYZ) + b"xx")
    return str(folder)


def test_bin_files_are_read_with_trailing_bytes_ignored(spark, tmp_path):
    rows = P.read_points(spark, write_bins(tmp_path / "in"), "bin").orderBy("frame_id", "point_id").collect()
    assert [(r.frame_id, r.point_id, r.x, r.y, r.z, r.intensity) for r in rows] == [(k, i, x + k, y, z, t) for k in (0, 1) for i, (x, y, z, t) in enumerate(XYZ)]


def test_txt_files_end_at_the_first_bad_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 0.5\n  4   5 6 0\n\nx y z\n7 8 9 0\n")
    rows = P.read_points(spark, f"{tmp_path}/a.txt").orderBy("point_id").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(1, 2, 3), (4, 5, 6)]


@pytest.mark.parametrize("stride", [12, 16])
def test_bin_round_trip(spark, tmp_path, stride):
    points = P.read_bin(spark, write_bins(tmp_path / "in"))
    P.write_points(points, f"file://{tmp_path}/out", "bin", stride)
    assert len(glob.glob(f"{tmp_path}/out/*.bin")) == 2
    back = P.read_bin(spark, f"{tmp_path}/out", stride)
    key = lambda df: sorted((r.frame_id, r.point_id, r.x, r.y, r.z) for r in df.collect())
    assert key(back) == key(points)


def test_text_and_ply_output(spark, tmp_path):
    points = spark.createDataFrame([(0, i, x, y, z) for i, (x, y, z, _) in enumerate([(0.1, -1234.5678, 1e-5, 0), (100000.0, 2.5e7, -0.5, 0)])], "frame_id long, point_id long, x double, y double, z double")
    P.write_points(points, f"{tmp_path}/t", "txt")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t/frame_id=0").collect()] == ["0.1 -1234.57 1e-05 0.0", "100000 2.5e+07 -0.5 0.0"]
    P.write_points(points, f"{tmp_path}/p", "ply")
    got = [r.value for r in spark.read.text(f"{tmp_path}/p/frame_id=0").collect()]
    assert got[0] == "ply" and got[2] == "element vertex 2" and got[8] == "end_header" and len(got) == 11
    with pytest.raises(ValueError):
        P.write_points(points, f"{tmp_path}/x", "las")


def test_stream_of_files_becomes_blobs_and_points_once(spark, tmp_path):
    source = write_bins(tmp_path / "land", ("7.bin", "8.bin"))
    o = S.CompressOptions(0.04, rate=0.5)
    for _ in range(2):  # a second run finds nothing new
        frames.compress_stream(spark, source, f"{tmp_path}/blobs", f"{tmp_path}/c1", o).awaitTermination()
        frames.store_stream(spark, f"{tmp_path}/blobs", f"{tmp_path}/points", f"{tmp_path}/c2").awaitTermination()
    blobs = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/blobs")
    assert sorted(r.frame_id for r in blobs.collect()) == [7, 8]
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/points")
    assert got.columns == ["x", "y", "z", "frame"] and got.groupBy("frame").count().where(F.col("count") == 3).count() == 2


def test_command_line(spark, tmp_path, capsys):
    source = write_bins(tmp_path / "in")
    assert cli.main(["compress", "-i", source, "-o", f"{tmp_path}/b", "-r", "0.04", "--rate", "0.5", "--off-the-shelf", "BZ2"]) == 0
    assert spark.read.parquet(f"{tmp_path}/b").first().codec == "bzip2"
    assert cli.main(["decompress", "-i", f"{tmp_path}/b", "-o", f"{tmp_path}/t", "--format", "parquet"]) == 0
    assert spark.read.parquet(f"{tmp_path}/t").count() == 6


def test_long_files_arrive_too(spark, tmp_path):
    """A file of over 64 MB is a frame like any other."""
    (tmp_path / "land").mkdir()
    with open(tmp_path / "land" / "5.bin", "wb") as f:
        f.truncate((65 << 20) + 32)
    (tmp_path / "land" / "6.bin").write_bytes(bytes(24))
    seen = frames.landing(spark, f"{tmp_path}/land").groupBy("frame_id").agg(F.count("*").alias("n"))
    seen.writeStream.format("memory").queryName("landed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.frame_id: r.n for r in spark.table("landed").collect()} == {5: (65 << 16) + 2, 6: 1}


def test_text_of_several_blocks(spark, tmp_path):
    """Files longer than a task's share: numbers go on from block to block, and a bad line in a later block ends the file."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("".join(f"{i} 2 3 0\n" if i % 50 else f"\r\n{i} 2 3 0\n" for i in range(1, 4001)))
    (tmp_path / "t" / "b.txt").write_text("".join("end\n" if i == 2500 else f"{i} 2 3 0\n" for i in range(4000)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert P.numbered_lines(spark, f"{tmp_path}/t").groupBy("file").agg(F.count_distinct("line_no").alias("n"), F.max("line_no").alias("m")).where("n = m + 1").count() == 2
        got = P.read_txt(spark, f"{tmp_path}/t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    one = sorted((r.point_id, r.x) for r in got if r.frame_id == 0)
    assert [x for _, x in one] == list(range(1, 4001)) and all(p == x - 1 + x // 50 for p, x in one)
    assert sorted((r.point_id, r.x) for r in got if r.frame_id == 1) == [(i, float(i)) for i in range(2500)]


def test_bin_files_are_written_by_tasks(spark, tmp_path):
    points = spark.createDataFrame([(k, i, float(i), -float(k), 0.5) for k in range(5) for i in range(4)], "frame_id long, point_id long, x float, y float, z float").repartition(3)
    for _ in range(2):  # again over what is there
        P.write_points(points, f"{tmp_path}/out", "bin", 12)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{k}.bin" for k in range(5)]
    assert (tmp_path / "out" / "3.bin").read_bytes() == b"".join(struct.pack("<3f", i, -3, 0.5) for i in range(4))
    back = P.read_bin(spark, f"{tmp_path}/out", 12)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, points.collect()))


def test_database_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    blobs = spark.createDataFrame([(3, bytearray(b"\x00\xffA")), (4, None)], "frame_id long, blob binary")
    points = spark.createDataFrame([(7, 0, 1.5, -2.0, 0.25), (7, 1, 0.0, 3.0, 4.0)], "frame_id long, point_id long, x double, y double, z double")
    P.write_jdbc(blobs.select(F.col("frame_id").alias("id"), "blob"), url, "pc", driver)
    for _ in range(2):  # rows are added to what is there
        P.write_jdbc(P.point_rows(points), url, "points", driver)
    got = {r.ID: r.BLOB and bytes(r.BLOB) for r in spark.read.jdbc(url, "pc", properties=driver).toDF("ID", "BLOB").collect()}
    assert got == {3: b"\x00\xffA", 4: None}
    assert sorted(map(tuple, spark.read.jdbc(url, "points", properties=driver).collect())) == [(0.0, 3.0, 4.0, 7)] * 2 + [(1.5, -2.0, 0.25, 7)] * 2


def test_hex_rows(spark):
    df = spark.createDataFrame([(3, bytearray(b"\x00\xffA"))], "frame_id long, blob binary")
    assert P.blob_rows(df).first().hex == "00ff41"
    assert C.decompress(spark.createDataFrame([(1, 0.1, None)], "frame_id long, resolution double, blob binary")).count() == 0


def test_sizes_are_observed_by_the_pass_that_writes(spark, tmp_path):
    points = P.read_bin(spark, write_bins(tmp_path / "in"))
    got = C.write_measured(C.compress(points, S.CompressOptions(0.04, rate=0.5)), f"{tmp_path}/b")
    back = C.metrics(spark.read.parquet(f"{tmp_path}/b")).agg(*[F.sum(c).alias(c) for c in ("n_points", "raw_bits", "comp_bits", "octree_bytes", "line_bytes", "quadtree_bytes", "seconds")]).first()
    assert got["frames"] == 2 and all(got[c] == back[c] for c in back.asDict())
    assert got["ratio"] == got["raw_bits"] / got["comp_bits"] > 0
    none = C.write_measured(C.compress(points.where("false")), f"{tmp_path}/none")
    assert none["frames"] == 0 and none["ratio"] == 0


def test_frames_of_a_stream_are_numbered_by_arrival(spark, tmp_path):
    source = write_bins(tmp_path / "land", ("left_1.bin", "right_1.bin"))
    frames.compress_stream(spark, source, f"{tmp_path}/blobs", f"{tmp_path}/c1", S.CompressOptions(0.04, rate=0.5), numbers="arrival").awaitTermination()
    assert sorted(r.frame_id for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/blobs").collect()) == [0, 1]
