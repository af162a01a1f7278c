"""Aggregates over time steps and groups of labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, label_of
from ..plans.model import Aggregation, QueryError


def _spread(fn: Callable[[str], Column]) -> Callable[[str], Column]:
    return lambda v: F.when(F.count("*") < 2, F.lit(0.0)).otherwise(fn(v))


def _extreme(fn: Callable[[Column], Column], none: str) -> Callable[[str], Column]:
    """NaN takes no part; nothing but NaN gives the infinity that every number beats."""
    return lambda v: F.coalesce(fn(F.when(~F.isnan(v), F.col(v))), F.lit(float(none)))


FUNCTIONS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "max": _extreme(F.max, "-inf"),
    "min": _extreme(F.min, "inf"),
    "count": lambda v: F.count("*").cast("double"),
    "stddev": _spread(F.stddev_pop),
    "stdvar": _spread(F.var_pop),
}


def group_labels(labels: Column, by: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> Column:
    """The labels that a group keeps; missing ones are left out."""
    if by:
        return F.map_filter(labels, lambda k, v: k.isin(*by))
    if without:
        return F.map_filter(labels, lambda k, v: ~k.isin(*without))
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def aggregate(samples: DataFrame, query: Aggregation) -> DataFrame:
    """``labels`` (of the group), ``bucket_ms`` and ``value``; one shuffle, after partial sums."""
    keys = group_labels(F.col("labels"), query.by, query.without)
    return samples.groupBy(keys.alias("labels"), bucket(query.step).alias("bucket_ms")).agg(FUNCTIONS[query.fn]("value").alias("value"))


def aggregate_by(samples: DataFrame, query: Aggregation) -> DataFrame:
    """The same with a column for each label in ``by``: flat keys, which hash and compare faster than maps."""
    if query.without:
        raise QueryError("flat groups have by-labels only")
    return samples.groupBy(*[label_of(samples, x).alias(x) for x in query.by], bucket(query.step).alias("bucket_ms")).agg(FUNCTIONS[query.fn]("value").alias("value"))


def summary(samples: DataFrame) -> DataFrame:
    """Average, least, greatest and number of the values of each series."""
    return samples.groupBy("series_key").agg(*[FUNCTIONS[x]("value").alias(x) for x in ("avg", "min", "max")], F.count("*").alias("n"))


def histogram(samples: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Moments and nearest-rank quantiles (value number int((n - 1) * p) in order) of each series.

    The ranks are found by counting distinct values, so a series of any length costs a row for each distinct value."""
    counted = samples.groupBy("series_key", "value").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("series_key").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("series_key")
    ranked = counted.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(every)})
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(p)), F.col("value"))).alias(f"p{round(p * 100)}") for p in quantiles]
    total = F.sum(F.col("value") * F.col("c"))
    return ranked.groupBy("series_key").agg(F.first("n").alias("count"), total.alias("sum"), (total / F.first("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), *at)
