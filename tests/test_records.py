"""The data source of point records: ranges, commits, streams."""

import os
import struct

import pytest
from cloudloom.sources import records
from pyspark.sql import functions as F


def bins(folder, frames):
    folder.mkdir(exist_ok=True)
    for name, n in frames.items():
        (folder / name).write_bytes(b"".join(struct.pack("<4f", i, -i, n, 0.5) for i in range(n)))
    return str(folder)


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def rows(df):
    return sorted(map(tuple, df.select("frame_id", "point_id", "x", "y", "z").collect()))


def test_ranges_are_whole_records_and_give_what_one_task_gives(spark, tmp_path):
    path = bins(tmp_path / "in", {"b.bin": 1000, "a.bin": 7, "c.bin": 0, "d.bin": 333})
    with open(f"{path}/d.bin", "ab") as f:
        f.write(b"tail")
    (tmp_path / "in" / "note.txt").write_text("no frame")
    small = records.read_records(spark, path, split=1000)
    assert small.rdd.getNumPartitions() > 15
    assert rows(small) == sorted((k, i, float(i), float(-i), float(n)) for k, n in enumerate((7, 1000, 0, 333)) for i in range(n))
    assert records.cut([("p", 3, 16 * 10 + 5)], 16, 16 * 4) == [records.Ranges([("p", 3, 0, 4)]), records.Ranges([("p", 3, 4, 8)]), records.Ranges([("p", 3, 8, 10)])]
    assert records.cut([("p", 0, 32), ("q", 1, 32), ("r", 2, 16)], 16, 64) == [records.Ranges([("p", 0, 0, 2), ("q", 1, 0, 2)]), records.Ranges([("r", 2, 0, 1)])]
    one = records.read_records(spark, f"{path}/b.bin", 16, 4096)
    assert one.count() == 1000 and one.agg(F.max("point_id")).first()[0] == 999
    assert records.read_records(spark, bins(tmp_path / "none", {})).count() == 0


def test_a_file_of_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "0.bin", "wb") as f:
        f.truncate(3 << 30)  # sparse, longer than a row can be
        f.seek((3 << 30) - 16)
        f.write(struct.pack("<4f", 1, 2, 3, 4))
    df = records.read_records(spark, str(tmp_path / "in"), split=256 << 20)
    assert df.rdd.getNumPartitions() == 12
    last = df.where("x = 1").collect()
    assert [(r.point_id, r.y, r.intensity) for r in last] == [((3 << 30) // 16 - 1, 2, 4)]


def cloud(spark, frames, n=50):
    return spark.range(frames * n).select((F.col("id") % frames).alias("frame_id"), (F.col("id") / frames).cast("long").alias("point_id"), *[(F.col("id") * k).cast("float").alias(c) for k, c in ((1, "x"), (-2, "y"), (0.5, "z"))])


@pytest.mark.parametrize("stride", [12, 16])
def test_frames_written_come_back(spark, tmp_path, stride):
    points = cloud(spark, 9).repartition(4)
    records.write_frames(points, str(tmp_path / "out"), stride)
    assert names(tmp_path / "out") == [f"{k}.bin" for k in range(9)]
    assert rows(records.read_records(spark, str(tmp_path / "out"), stride)) == rows(points)


def test_overwriting_leaves_no_stale_frame_and_appending_none_twice(spark, tmp_path):
    out = tmp_path / "out"
    records.write_frames(cloud(spark, 6), str(out))
    records.write_frames(cloud(spark, 2), str(out))
    assert names(out) == ["0.bin", "1.bin"]
    records.write_frames(cloud(spark, 3).where("frame_id = 2"), str(out), mode="append")
    assert names(out) == ["0.bin", "1.bin", "2.bin"]
    with pytest.raises(Exception, match="exist already"):
        records.write_frames(cloud(spark, 4), str(out), mode="append")
    assert names(out) == ["0.bin", "1.bin", "2.bin"]
    records.write_frames(cloud(spark, 4).where("false"), str(out))
    assert names(out) == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    records.write_frames(cloud(spark, 3), str(out))
    before = {n: (out / n).read_bytes() for n in names(out)}
    bad = cloud(spark, 8).withColumn("x", F.expr("if(frame_id = 5 and point_id = 40, raise_error('lost'), x)").cast("float"))
    with pytest.raises(Exception, match="lost"):
        records.write_frames(bad, str(out))
    assert {n: (out / n).read_bytes() for n in names(out)} == before
    records.register(spark)
    apart = cloud(spark, 2).repartition(3).select("frame_id", "x", "y", "z")
    with pytest.raises(Exception, match="frame"):
        apart.write.format("point_records").option("stride", 12).mode("overwrite").save(str(out))
    assert {n: (out / n).read_bytes() for n in names(out)} == before


def run(spark, path, tmp_path, trigger, **options):
    stream = records.register(spark).readStream.format("point_records").options(**options).load(path)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/seen").option("checkpointLocation", f"{tmp_path}/check").trigger(**trigger).start()
    if "availableNow" in trigger:
        query.awaitTermination()
    else:
        query.processAllAvailable()
        query.stop()
    return {r.frame_id: (r.n, r.z) for r in spark.read.parquet(f"{tmp_path}/seen").groupBy("frame_id").agg(F.count("*").alias("n"), F.max("z").alias("z")).collect()}


def test_a_restart_goes_on_counting_and_takes_each_file_once(spark, tmp_path):
    path = bins(tmp_path / "land", {"left_1.bin": 5, "right_1.bin": 6})
    os.utime(tmp_path / "land" / "right_1.bin", (1, 1))  # arrived first
    assert run(spark, path, tmp_path, {"availableNow": True}) == {0: (6, 6.0), 1: (5, 5.0)}
    bins(tmp_path / "land", {"0.bin": 3, ".part.bin": 9})
    os.utime(tmp_path / "land" / "0.bin", (0, 0))  # older than what has been read, but new
    assert run(spark, path, tmp_path, {"availableNow": True}) == {0: (6, 6.0), 1: (5, 5.0), 2: (3, 3.0)}
    assert run(spark, path, tmp_path, {"availableNow": True}) == {0: (6, 6.0), 1: (5, 5.0), 2: (3, 3.0)}


def test_batches_admit_bytes_and_repeat_alike(spark, tmp_path):
    path = bins(tmp_path / "land", {f"{k}.bin": 10 + k for k in range(6)})
    for k in range(6):
        os.utime(tmp_path / "land" / f"{k}.bin", (k, k))
    got = run(spark, path, tmp_path, {"processingTime": "0 seconds"}, bytes_a_batch="400", numbers="name")
    assert got == {k: (10 + k, 10.0 + k) for k in range(6)}
    lots = sorted(os.listdir(tmp_path / "land" / ".admitted"))
    assert [int(n.split(".")[0]) for n in lots] == [0, 2, 4, 5]
    reader = records.RecordStream(path, 16, 1 << 20, f"{path}/.admitted", "arrival", 400)
    assert reader.latestOffset() == {"files": 6}
    for _ in range(2):
        assert [r[:2] for p in reader.partitions({"files": 2}, {"files": 4}) for r in p.ranges] == [(f"{path}/2.bin", 2), (f"{path}/3.bin", 3)]


def test_names_that_differ_are_frames_that_differ():
    of = records.name_number
    assert of("/in/000017.bin") == 17
    assert len({of(p) for p in ("/in/left_1.bin", "/in/right_1.bin", "/in/1.bin", f"/in/{'9' * 25}.bin", "/a/left_1.bin")}) == 5
    assert all(-(1 << 63) <= of(p) < 1 << 63 for p in ("/in/x.bin", "/in/y.bin", "/in/z.bin"))
