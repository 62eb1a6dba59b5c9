"""Frames that arrive as files: compress, store and decompress them as a stream.

The landing folder takes the place of a socket: a sender drops whole files, the
source admits each once, and the checkpoint gives each an effect once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cloudloom import schema as S
from cloudloom.plans import compress as C
from cloudloom.sources.points import point_rows
from cloudloom.sources.records import place, register


def landing(spark: SparkSession, folder: str, numbers: str = "name", bytes_a_batch: int | None = None, stride: int = 16) -> DataFrame:
    """A stream of the points of every file of a folder, however long; frames are numbered by ``name`` or by ``arrival``.

    A name that isn't a number is a frame by its path's hash, so different files are different frames.
    """
    stream = register(spark).readStream.format("point_records").option("numbers", numbers).option("stride", stride)
    return (stream.option("bytes_a_batch", bytes_a_batch) if bytes_a_batch else stream).load(place(folder))


def compress_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, options: S.CompressOptions = S.CompressOptions(), trigger: dict | None = None, numbers: str = "name", bytes_a_batch: int | None = None
) -> StreamingQuery:
    """Compress every file of ``folder`` into blob rows (Parquet, one folder a batch, so a repeated batch replaces itself)."""

    def batch(points: DataFrame, number: int) -> None:
        C.compress(points, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return landing(spark, folder, numbers, bytes_a_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def store_stream(spark: SparkSession, blobs: str, out: str, checkpoint: str, compressed: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Take in blob rows as they arrive, and store them as they are or as (x, y, z, frame) rows."""
    schema = spark.createDataFrame([], C.BLOBS).schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(blobs)

    def batch(df: DataFrame, number: int) -> None:
        kept = df if compressed else point_rows(C.decompress(df))
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
