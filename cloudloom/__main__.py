"""Command line: compress, decompress, and the two streaming ends.

python -m cloudloom compress -i FOLDER|FILE.bin -o BLOBS [-r 0.04] [--rate R] [--off-the-shelf CODEC] [--intra-line-coding-only]
python -m cloudloom decompress -i BLOBS -o OUT [--format bin|txt|ply|parquet]
python -m cloudloom send -d LANDING -o BLOBS --checkpoint C [--numbers name|arrival] [--bytes-a-batch N]
python -m cloudloom receive -d BLOBS -o OUT --checkpoint C [--store-compressed]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cloudloom import schema as S
from cloudloom.plans import compress as C
from cloudloom.sources import points as P
from cloudloom.streaming import frames


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("cloudloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name, source in (("compress", "-i"), ("decompress", "-i"), ("send", "-d"), ("receive", "-d")):
        p = sub.add_parser(name)
        p.add_argument(source, dest="source", required=True)
        p.add_argument("-o", dest="out", required=True)
        if name in ("compress", "send"):
            p.add_argument("-r", type=float, default=0.04, help="twice the error bound")
            p.add_argument("--rate", type=float, default=-1.0)
            p.add_argument("--off-the-shelf", default="arithmetic")
            p.add_argument("--intra-line-coding-only", action="store_true")
        if name in ("send", "receive"):
            p.add_argument("--checkpoint", required=True)
        if name == "send":
            p.add_argument("--numbers", default="name", choices=("name", "arrival"), help="what frames are numbered by")
            p.add_argument("--bytes-a-batch", type=int, help="how much a batch takes in at most")
        if name == "decompress":
            p.add_argument("--format", default="bin", choices=("bin", "txt", "ply", "parquet"))
        if name == "receive":
            p.add_argument("--store-compressed", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"cloudloom {a.command}").getOrCreate()
    if a.command in ("compress", "send"):
        o = S.CompressOptions(a.r, a.rate, a.off_the_shelf, a.intra_line_coding_only)
    if a.command == "compress":
        kind = "txt" if a.source.endswith(".txt") else "bin"
        print(json.dumps(C.write_measured(C.compress(P.read_points(spark, a.source, kind), o), a.out)))
    elif a.command == "decompress":
        points = C.decompress(spark.read.parquet(a.source)).withColumn("point_id", F.col("seq"))
        P.write_points(points.select("frame_id", "point_id", *[F.col(c).cast("float").alias(c) for c in "xyz"]), a.out, a.format)
    elif a.command == "send":
        frames.compress_stream(spark, a.source, a.out, a.checkpoint, o, numbers=a.numbers, bytes_a_batch=a.bytes_a_batch).awaitTermination()
    else:
        frames.store_stream(spark, a.source, a.out, a.checkpoint, a.store_compressed).awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
