"""Shards under a byte limit by extendible hashing, with DataFrame operations only.

A document's shard is a prefix of its hash's bits. One shard holds everything
until it is over the limit; only shards over it split, on their next bit. Here
sizes are first summed in cells, prefixes a few bits longer than an average shard
needs (with map-side combining, so no hot key is dealt out), and the split levels
are found on the cells: a cell's shard is its shortest prefix whose sum fits. The
cells with their depths are the directory; documents look their cell up. Cells
that are over the limit themselves go a round further with their next bits, and
those of repeated keys, once the hash is used up, with the bits of another one
that tells rows apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.columns import unused, whole_row
from cloudloom.workspace import materialise

LIMIT = 16 << 20
#: Bits of one hash, and bits that cells have beyond the average shard's.
HASH_BITS, FINER = 60, 6
#: Prefixes of up to this many bits are short; cells are dealt out under them in so many ways.
SHORT, SALTS = 12, 256


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def assign_shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(row, doc_id, shard, depth, n_bytes, shard_bytes, shard_docs)`` for every row of ``docs``.

    ``shard`` is ``s`` and the prefix's bits, ``depth`` their number. Sizes are
    UTF-8 bytes of the texts; null texts have none, null keys hash like empty
    ones. Every shard fits the limit but one that holds a single larger
    document. Repeated rows and keys share a shard as long as they fit one, then
    they are told apart by ``row``, a number of the row (``row_col`` if the table
    has one). Other columns are ignored, an empty table gives an empty table.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = materialise(rows, "sizes")
    own = ["row", "doc_id", "n_bytes"]  # carried along, so that nothing is joined by row
    live = rows.select(*own, hash_bits(key).alias("bits"), F.lit("s").alias("stem"))
    done, turn, left = [], 0, HASH_BITS
    while (total := live.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).first()).n:
        bits = min(left, max(0, math.ceil(math.log2(max(1, total.b) / limit))) + FINER)
        left -= bits
        places = live.withColumn("cell", F.shiftrightunsigned("bits", left))
        # written, so that Spark knows its size and never takes the rows for the smaller side
        found = places.join(materialise(_directory(places, bits, limit, first=turn == 0), "directory"), ["stem", "cell"])
        prefix = F.expr(f"if(depth = 0, '', lpad(conv(shiftrightunsigned(cell, {bits} - depth), 10, 2), depth, '0'))")
        done.append(found.where("depth is not null").select(*own, F.concat("stem", prefix).alias("shard")))
        turn += 1
        deeper = found.where("depth is null").withColumn("stem", F.concat("stem", F.lpad(F.conv("cell", 10, 2), bits, "0")))
        if left:
            deeper = deeper.withColumn("bits", F.col("bits").bitwiseAND((1 << left) - 1))
        else:  # the hash is used up: rows of one key are left, told apart by their numbers
            left = HASH_BITS
            deeper = deeper.withColumn("bits", hash_bits(F.concat_ws("#", key, "row", F.lit(turn))))
        live = materialise(deeper.select(*own, "bits", "stem"), "live")
    named = done[0] if done else rows.withColumn("shard", F.lit("s"))
    for d in done[1:]:
        named = named.union(d)
    sums = materialise(named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs")), "shards")
    out = named.join(sums, "shard")
    return out.select("row", "doc_id", "shard", (F.length("shard") - 1).cast("long").alias("depth"), "n_bytes", "shard_bytes", "shard_docs")


def _directory(places: DataFrame, bits: int, limit: int, first: bool) -> DataFrame:
    """Each cell's depth (null: the cell itself is too large to be a shard)."""
    cells = materialise(places.groupBy("stem", "cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "cells")
    levels = F.explode(F.sequence(F.lit(0 if first else 1), F.lit(bits))).alias("depth")
    spread = cells.select("stem", "cell", "b", "n", levels).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
    sums = spread.groupBy("stem", "depth", "prefix").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
    # many cells share a short prefix: they are dealt out by their last bits, and short prefixes that fit, few as they are, go to each
    # in no more ways than they have cells
    short, ways = F.col("depth") <= SHORT, F.expr(f"int(least({SALTS}L, shiftleft(1L, {bits} - depth)))")
    salts = F.explode(F.when(short, F.sequence(F.lit(0), ways - 1)).otherwise(F.array(F.lit(0)))).alias("salt")
    fits = sums.where((F.col("sb") <= limit) | (F.col("sn") == 1)).select("stem", "depth", "prefix", salts, F.lit(True).alias("ok"))
    dealt = spread.withColumn("salt", F.when(short, (F.col("cell") % ways).cast("int")).otherwise(0))
    joined = dealt.join(fits, ["stem", "depth", "prefix", "salt"], "left")
    return joined.groupBy("stem", "cell").agg(F.min(F.when(F.col("ok"), F.col("depth"))).alias("depth"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet with a folder ``shard=...`` for each shard; ``shard_`` if the rows have a ``shard`` already."""
    folder = unused(docs, "shard")
    tagged = materialise(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("own")), "rows")
    by_row = assign_shards(tagged.select("row", F.col("own")[id_col].alias("id"), F.col("own")[text_col].alias("text")), limit, "id", "text", "row")
    tagged.join(by_row.select("row", F.col("shard").alias("folder")), "row").select("own.*", F.col("folder").alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).drop("row")


SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes) AS b, count(*) AS n
  FROM d, (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS depth) GROUP BY 1, 2),
leaf AS (
  SELECT d.doc_id, d.h, d.n_bytes, min(s.depth) AS depth
  FROM d JOIN s ON s.prefix = d.h >> ({HASH_BITS} - s.depth) WHERE s.b <= {LIMIT} OR s.n = 1 GROUP BY 1, 2, 3)
SELECT l.doc_id, 's' || CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.h >> ({HASH_BITS} - l.depth)), l.depth, '0') END AS shard,
       CAST(l.depth AS BIGINT) AS depth, l.n_bytes, CAST(s.b AS BIGINT) AS shard_bytes, s.n AS shard_docs
FROM leaf l JOIN s ON s.depth = l.depth AND s.prefix = l.h >> ({HASH_BITS} - l.depth)
"""
