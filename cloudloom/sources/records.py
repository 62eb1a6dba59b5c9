"""A Spark data source of point records: ``.bin`` files read by ranges, written with a commit, followed as a stream.

Records are little-endian floats of 16 bytes (x, y, z, intensity) or 12 (x, y, z);
a file is a frame. ``register(spark)`` makes the format ``point_records`` known:

* ``spark.read.format("point_records").load(folder)`` cuts files into ranges of whole
  records, so one long file is read by many tasks and many short ones by few.
* ``points.write.format("point_records").mode(...).save(folder)`` writes one file a frame
  under a staging folder and moves them into place when every task has succeeded;
  nothing is left of a job that failed. ``overwrite`` removes frames that were not
  written, ``append`` refuses frames that exist. Rows of a frame must be together in
  one task and in order (``write_frames`` deals them out so).
* ``spark.readStream.format("point_records").load(folder)`` takes each file in once.
  Offsets count files in order of admission, and a log beside them says which
  file has which number, so a batch that is repeated reads the same files and
  numbers go on after a restart.

Paths are local ones or URIs of stores that pyarrow opens.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RECORD = {16: ("x", "y", "z", "intensity"), 12: ("x", "y", "z")}
#: Bytes of a task's ranges, records in a batch.
SPLIT, BATCH = 64 << 20, 1 << 16


def place(path: str) -> str:
    """A path as a URI."""
    if "://" in path:
        return path
    return "file://" + os.path.abspath(re.sub("^file:", "", path))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, folder = pafs.FileSystem.from_uri(place(path))
    return fs, folder.rstrip("/")


def frame_files(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """The ``.bin`` files of a folder (or the one file) by name; hidden ones are not there yet."""
    top = fs.get_file_info(folder)
    found = [top] if top.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".bin") and f.base_name[0] not in "._"), key=lambda f: f.path)


def name_number(path: str) -> int:
    """A file's frame by its name: the number, if the name is one that fits, else a hash of the whole path."""
    stem = path.rsplit("/", 1)[-1].removesuffix(".bin")
    if re.fullmatch("[0-9]{1,18}", stem):
        return int(stem)
    return int(np.uint64(xxhash.xxh3_64_intdigest(path)).view(np.int64))


@dataclass
class Ranges(InputPartition):
    """Ranges (path, frame, first record, end) that one task reads."""

    ranges: list[tuple[str, int, int, int]]


def cut(files: list[tuple[str, int, int]], stride: int, split: int) -> list[Ranges]:
    """Tasks for (path, frame, bytes) files: ranges of whole records, about ``split`` bytes a task. Trailing bytes are ignored."""
    each, tasks, held = max(1, split // stride), [Ranges([])], 0
    for path, frame, size in files:
        for first in range(0, size // stride, each):
            end = min(first + each, size // stride)
            if held and held + end - first > each:
                tasks.append(Ranges([]))
                held = 0
            tasks[-1].ranges.append((path, frame, first, end))
            held += end - first
    return tasks


def read_ranges(folder: str, stride: int, part: Ranges) -> Iterator[pa.RecordBatch]:
    fs, _ = opened(folder)
    names = RECORD[stride]
    for path, frame, first, end in part.ranges:
        with fs.open_input_file(path) as f:
            f.seek(first * stride)
            for at in range(first, end, BATCH):
                n = min(BATCH, end - at)
                v = np.frombuffer(f.read(n * stride), "<f4").reshape(n, len(names))
                columns = [pa.array(np.full(n, frame)), pa.array(np.arange(at, at + n)), *(pa.array(np.ascontiguousarray(v[:, i])) for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays(columns, ["frame_id", "point_id", *names])


class RecordReader(DataSourceReader):
    def __init__(self, path: str, stride: int, split: int) -> None:
        self.path, self.stride, self.split = path, stride, split

    def partitions(self) -> list[Ranges]:
        files = frame_files(*opened(self.path))
        return cut([(f.path, k, f.size) for k, f in enumerate(files)], self.stride, self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_ranges(self.path, self.stride, partition)


@dataclass
class Staged(WriterCommitMessage):
    """Frames that a task has written, and under which name."""

    frames: list[tuple[int, str]]


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, stride: int, overwrite: bool) -> None:
        self.path, self.stride, self.overwrite = path, stride, overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, folder = opened(self.path)
        fs.create_dir(f"{folder}/{self.staging}")
        names, staged, out, seen = RECORD[self.stride], [], None, set()
        try:
            for b in iterator:
                frames = np.asarray(b.column(b.schema.get_field_index("frame_id")))
                v = np.zeros((len(b), len(names)), "<f4")
                for i, c in enumerate(names):
                    at = b.schema.get_field_index(c)
                    v[:, i] = np.asarray(b.column(at).cast(pa.float32()).fill_null(np.nan)) if at >= 0 else 0
                starts = np.flatnonzero(np.concatenate(([True], frames[1:] != frames[:-1]))) if len(b) else []
                for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
                    frame = int(frames[s])
                    if not staged or staged[-1][0] != frame:
                        if frame in seen:
                            raise ValueError(f"rows of frame {frame} are not together")
                        if out is not None:
                            out.close()
                        seen.add(frame)
                        staged.append((frame, f"{folder}/{self.staging}/{frame}-{uuid.uuid4().hex}"))
                        out = fs.open_output_stream(staged[-1][1])
                    out.write(v[s:e].tobytes())
        finally:
            if out is not None:
                out.close()
        return Staged(staged)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, folder = opened(self.path)
        fs.create_dir(folder)
        staged = [x for m in messages if m is not None for x in m.frames]
        there = {f.base_name for f in frame_files(fs, folder)}
        names = {f"{frame}.bin" for frame, _ in staged}
        if len(names) < len(staged):
            raise ValueError("rows of a frame are in more than one task")
        if not self.overwrite and names & there:
            raise ValueError(f"{len(names & there)} frames exist already")
        for frame, path in staged:
            target = f"{folder}/{frame}.bin"
            if f"{frame}.bin" in there and not isinstance(fs, pafs.LocalFileSystem):
                fs.delete_file(target)  # only local files are replaced by a move
            fs.move(path, target)
        for name in there - names if self.overwrite else ():
            fs.delete_file(f"{folder}/{name}")
        self._clear(fs, folder)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(f"{folder}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.staging}")


class RecordStream(DataSourceStreamReader):
    """Files in order of admission: a log file for each lot that was admitted, named by the number of its first file.

    ``bytes_a_batch`` admits files up to so many bytes at a time, but at least one.
    """

    def __init__(self, path: str, stride: int, split: int, log: str, numbers: str, most: int | None) -> None:
        self.path, self.stride, self.split, self.log, self.numbers, self.most = path, stride, split, log, numbers, most

    def initialOffset(self) -> dict:
        return {"files": 0}

    def _admitted(self) -> list[tuple[str, int]]:
        fs, log = opened(self.log)
        lots = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(log, allow_not_found=True)) if f.base_name.endswith(".json") and f.base_name[0] != ".")
        found = []
        for lot in lots:
            with fs.open_input_stream(lot) as f:
                found += [tuple(x) for x in json.loads(f.read())]
        return found

    def latestOffset(self) -> dict:
        fs, folder = opened(self.path)
        old = self._admitted()
        known, new, held = {p for p, _ in old}, [], 0
        for f in sorted(frame_files(fs, folder), key=lambda f: (f.mtime_ns or 0, f.path)):
            if f.path in known:
                continue
            if new and self.most is not None and held + f.size > self.most:
                break
            new.append((f.path, f.size))
            held += f.size
        if new:
            to, log = opened(self.log)
            to.create_dir(log)
            part = f"{log}/.{uuid.uuid4().hex}"
            with to.open_output_stream(part) as out:
                out.write(json.dumps(new).encode())
            to.move(part, f"{log}/{len(old):012d}.json")
        return {"files": len(old) + len(new)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        files = [(p, k if self.numbers == "arrival" else name_number(p), size) for k, (p, size) in enumerate(self._admitted())]
        return cut(files[start["files"] : end["files"]], self.stride, self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_ranges(self.path, self.stride, partition)


class PointRecords(DataSource):
    """Options: ``path``; ``stride`` (16 or 12); ``split``, bytes a task reads; for streams ``numbers`` (of frames: ``arrival``
    or ``name``), ``bytes_a_batch`` and ``log``, a folder (``.admitted`` in ``path``)."""

    @classmethod
    def name(cls) -> str:
        return "point_records"

    @property
    def stride(self) -> int:
        return int(self.options.get("stride", 16))

    def schema(self) -> str:
        return "frame_id long, point_id long, x float, y float, z float" + ", intensity float" * (self.stride == 16)

    def _split(self) -> int:
        return int(self.options.get("split", SPLIT))

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], self.stride, self._split())

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], self.stride, overwrite)

    def streamReader(self, schema: StructType) -> RecordStream:
        path, most = self.options["path"], self.options.get("bytes_a_batch")
        log = self.options.get("log", f"{path.rstrip('/')}/.admitted")
        return RecordStream(path, self.stride, self._split(), log, self.options.get("numbers", "arrival"), int(most) if most else None)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session."""
    spark.dataSource.register(PointRecords)
    return spark


def read_records(spark: SparkSession, path: str, stride: int = 16, split: int = SPLIT) -> DataFrame:
    """Points of a ``.bin`` file or a folder of them: frames numbered by the order of names, points by their place."""
    return register(spark).read.format("point_records").option("stride", stride).option("split", split).load(place(path))


def write_frames(points: DataFrame, path: str, stride: int = 12, mode: str = "overwrite") -> None:
    """``<frame_id>.bin`` for every frame, all of them or none; points in order of their ids."""
    register(points.sparkSession)
    kept = [c for c in RECORD[stride] if c in points.columns]
    ordered = points.select("frame_id", "point_id", *kept).repartition("frame_id").sortWithinPartitions("frame_id", "point_id")
    ordered.select("frame_id", *kept).write.format("point_records").option("stride", stride).mode(mode).save(place(path))
