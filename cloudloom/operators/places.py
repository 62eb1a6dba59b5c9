"""Places, running sums and neighbours in an order, for keys of any size.

A window over a key gathers all its rows in one task. Here rows are dealt out by
ranges of the order, each range is swept by itself, and what lies before it comes
from a row a range and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.workspace import materialise


def swept(rows: DataFrame, keys: list[str], order: list[str], totals: tuple[str, ...] = (), lasts: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``place`` (from 0 in its key), ``total_<c>`` (running sums, itself included) and ``last_<c>`` (of the row before).

    ``order`` ranks a key's rows without ties. Nulls count as zero in sums; a key's first row has no last one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = materialise(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "swept")
    ends = dealt.groupBy(*keys, "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{c}") for c in totals], *[F.max_by(c, "_at").alias(f"_end_{c}") for c in lasts]
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *[f"_sum_{c}" for c in totals])]
    lead = [F.lag(f"_end_{c}").over(Window.partitionBy(*keys).orderBy("_part")).alias(f"_end_{c}") for c in lasts]
    met = dealt.join(ends.select(*keys, "_part", "_first", *before, *lead), [*keys, "_part"])
    here = Window.partitionBy(*keys, "_part").orderBy("_at")
    place = (F.col("_n") + F.col("_at") - F.col("_first")).alias("place")
    sums = [(F.col(f"_sum_{c}") + F.coalesce(F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).alias(f"total_{c}") for c in totals]
    prior = [F.when(F.col("_at") == F.col("_first"), F.col(f"_end_{c}")).otherwise(F.lag(c).over(here)).alias(f"last_{c}") for c in lasts]
    return met.select(*rows.columns, place, *sums, *prior)
