"""Counter and gauge functions.  Rates and derivatives compare neighbours (a window by series, or
by blocks of time of a series where few series hold most samples); increases and deltas need only a series' first and last
sample (a grouped aggregate, no sort)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import QueryError


def _pairwise(samples: DataFrame, change: Column, order: tuple[str, ...], block_ms: int | None) -> DataFrame:
    """Each sample with the one before.  A series is one task's; with ``block_ms`` it is cut into blocks of time, each of which gets the
    last sample of the block before (a grouped aggregate, a second pass over the samples) as its first row."""
    rows = samples.select("series_key", "ts_ms", "value", *order, F.lit(False).alias("carried"))
    keys = ["series_key"]
    if block_ms is not None:
        keys = ["series_key", "block"]
        rows = rows.withColumn("block", F.expr(f"ts_ms div {int(block_ms)}L"))
        by = F.struct("ts_ms", *order) if order else F.col("ts_ms")
        ends = rows.groupBy(*keys).agg(F.max_by("value", by).alias("value"), F.max("ts_ms").alias("ts_ms"))
        following = F.lead("block").over(Window.partitionBy("series_key").orderBy("block"))
        carried = ends.select("series_key", "ts_ms", "value", following.alias("block"), F.lit(True).alias("carried")).where("block IS NOT NULL")
        rows = rows.unionByName(carried, allowMissingColumns=True)
    part = Window.partitionBy(*keys).orderBy("ts_ms", *order)
    both = rows.withColumns({"dt": (F.col("ts_ms") - F.lag("ts_ms").over(part)) / F.lit(1000.0), "before": F.lag("value").over(part)})
    return both.where("dt > 0 AND NOT carried").select("series_key", "ts_ms", F.try_divide(change, "dt").alias("value"))


def rate(samples: DataFrame, range_seconds: float = 1, order: tuple[str, ...] = (), block_ms: int | None = None) -> DataFrame:
    """Change per second from each sample to the next; a value below the one before is a counter's restart from 0."""
    if range_seconds <= 0:
        raise QueryError("a range must be positive")
    change = F.col("value") - F.col("before")
    return _pairwise(samples, F.when(change < 0, F.col("value")).otherwise(change), order, block_ms)


def derivative(samples: DataFrame, order: tuple[str, ...] = (), block_ms: int | None = None) -> DataFrame:
    """Change per second from each sample to the next."""
    return _pairwise(samples, F.col("value") - F.col("before"), order, block_ms)


def _ends(samples: DataFrame) -> DataFrame:
    ends = samples.groupBy("series_key").agg(F.min_by("value", "ts_ms").alias("first"), F.max_by("value", "ts_ms").alias("last"), F.max("ts_ms").alias("ts_ms"), F.count("*").alias("n"))
    return ends.where("n >= 2")


def increase(samples: DataFrame) -> DataFrame:
    """Last minus first value of each series, at its last time; the last value if that is negative."""
    change = F.col("last") - F.col("first")
    return _ends(samples).select("series_key", "ts_ms", F.when(change < 0, F.col("last")).otherwise(change).alias("value"))


def delta(samples: DataFrame) -> DataFrame:
    """Last minus first value of each series, at its last time."""
    return _ends(samples).select("series_key", "ts_ms", (F.col("last") - F.col("first")).alias("value"))
