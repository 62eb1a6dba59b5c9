"""Symbol statistics for entropy coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.lines import as_of


def histogram(symbols: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """``keys, symbol, n``."""
    return symbols.groupBy(*keys, F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``cum``, the exclusive prefix sum of n in symbol order."""
    before = Window.partitionBy(*keys).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("cum", F.coalesce(F.sum("n").over(before), F.lit(0)))


def ranges(stream: DataFrame, table: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """``stream`` with ``low`` and ``high``, each symbol's range of counts from ``cumulative``; a symbol that the table lacks has none."""
    own = table.select(*keys, F.col("symbol").alias(symbol), F.col("cum").alias("low"), (F.col("cum") + F.col("n")).alias("high"))
    return stream.join(own, [*keys, symbol], "left")


def symbols_at(counts: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``counts`` with ``symbol`` and ``low``: the symbol whose range holds the count, the one of the largest ``cum`` at or before it; null beyond the last.

    A decoder's search, for all counts at once: one order by count instead of a range join.
    """
    last = F.col("cum") + F.col("n")
    starts = table.where("n > 0").select(*keys, F.col("cum").alias(count), "symbol", F.col("cum").alias("low"), last.alias("high"))
    met = as_of(counts, starts, keys, count, ["symbol", "low", "high"], (1 << 62))
    inside = F.col(count) < F.col("r_high")
    return met.select(*counts.columns, F.when(inside, F.col("r_symbol")).alias("symbol"), F.when(inside, F.col("r_low")).alias("low"))


def entropy_bits(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, total, bits``: what an ideal coder needs with these frequencies."""
    logs = F.sum(F.col("n") * F.log2("n"))
    total = F.sum("n")
    return hist.groupBy(*keys).agg(total.alias("total"), (total * F.log2(total) - logs).alias("bits"))


def rescaled(hist: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``keys, symbol, n, shift, scaled``: counts halved, but not below one, as often as it takes for their sum to stay under ``limit``.

    Halving k times is a shift by k, so sums for all shifts come from one aggregation
    and the smallest that fits is taken; as many symbols as ``limit`` never fit (null).
    """
    shifts = F.explode(F.sequence(F.lit(0), F.lit(62))).alias("shift")
    spread = hist.select(*keys, shifts, F.col("n").cast("long").alias("n")).select(*keys, "shift", F.expr("greatest(1L, shiftright(n, shift))").alias("s"))
    fits = spread.groupBy(*keys, "shift").agg(F.sum("s").alias("total")).where(F.col("total") < limit)
    best = fits.groupBy(*keys).agg(F.min("shift").alias("shift"))
    return hist.join(best, keys, "left").select(*keys, "symbol", "n", "shift", F.expr("greatest(1L, shiftright(cast(n as bigint), shift))").alias("scaled")).withColumn("scaled", F.when(F.col("shift").isNotNull(), F.col("scaled")))


def narrow_streams(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, largest, narrow, bytes``: whether a stream of numbers fits bytes (its largest is under 256), and its length before coding."""
    seen = values.groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("largest")).withColumn("narrow", F.col("largest") < 256)
    return seen.withColumn("bytes", F.col("n") * F.when(F.col("narrow"), 1).otherwise(4))
