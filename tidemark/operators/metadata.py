"""Series, labels and their cardinalities."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import label_of, selected
from ..plans.model import Selector
from ..session import shared_dir


def series(samples: DataFrame, selector: Selector = Selector()) -> DataFrame:
    """The distinct series selected, with their labels.  The key says the labels, so both are grouped by: nothing is sorted."""
    return samples.where(selected(selector, samples)).groupBy("series_key", "labels").count().select("series_key", "labels")


def series_of_each(samples: DataFrame, *selectors: Selector) -> DataFrame:
    """The series of each selector, one after the other: one that several select is listed for each."""
    return functools.reduce(DataFrame.unionAll, [series(samples, s) for s in selectors])


def label_names(samples: DataFrame) -> DataFrame:
    """The names in use; before they are shuffled, samples shrink to the few sets of names there are."""
    sets = samples.select(F.array_sort(F.map_keys("labels")).alias("names")).distinct()
    return sets.select(F.explode("names").alias("label")).distinct()


def label_values(samples: DataFrame, name: str) -> DataFrame:
    value = label_of(samples, name)
    return samples.select(value.alias("value")).where("value IS NOT NULL").distinct()


def having_label(samples: DataFrame, name: str) -> DataFrame:
    return series(samples.where(label_of(samples, name).isNotNull()))


def postings(samples: DataFrame) -> DataFrame:
    """``label``, ``value`` and ``n_series``, the series that have them."""
    pairs = series(samples).select("series_key", F.explode("labels").alias("label", "value"))
    return pairs.groupBy("label", "value").agg(F.count("*").alias("n_series"))


def label_cardinality(samples: DataFrame) -> DataFrame:
    return postings(samples).groupBy("label").agg(F.count("*").alias("n_values"))


def series_ids(samples: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Ids from 1 in the order of the keys; ``known`` (``series_key``, ``series_id``) keep theirs and new ones follow.

    Ranges of keys are written in order and numbered by themselves, then shifted by the sizes of the ranges before, so no task sees all
    series, and a lost executor changes no number; only these sizes, one for each partition, go through the driver."""
    keys, base = samples.select("series_key").distinct(), 0
    if known is not None:
        keys = keys.join(known, "series_key", "left_anti")
        base = known.agg(F.coalesce(F.max("series_id"), F.lit(0))).first()[0]
    ordered = keys.repartitionByRange("series_key").sortWithinPartitions("series_key").withColumn("place", F.monotonically_increasing_id())
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    path = f"{shared_dir(keys.sparkSession)}/tidemark/series-{uuid.uuid4().hex}"
    ordered.write.parquet(path)
    ranged = keys.sparkSession.read.schema(ordered.schema).parquet(path)
    sizes = dict(map(tuple, ranged.groupBy(part.alias("part")).count().collect()))
    shifts, total = {}, base + 1
    for p in sorted(sizes):
        shifts[p], total = total, total + sizes[p]
    shift = keys.sparkSession.createDataFrame(list(shifts.items()), "part long, shift long")
    new = ranged.withColumn("part", part).join(F.broadcast(shift), "part").select("series_key", (inside + F.col("shift")).alias("series_id"))
    return new if known is None else known.select("series_key", "series_id").unionByName(new)


def series_of_ids(samples: DataFrame, ids: DataFrame, *wanted: int) -> DataFrame:
    """``series_id``, ``series_key`` and ``labels`` of the wanted ids, which ``ids`` (``series_key``, ``series_id``) holds; an id that it
    does not hold, or whose series has no sample, gives nothing."""
    some = ids.where(F.col("series_id").isin(*wanted)).select("series_key", "series_id")
    return series(samples.join(F.broadcast(some), "series_key", "left_semi")).join(F.broadcast(some), "series_key").select("series_id", "series_key", "labels")


def churn(samples: DataFrame, now: int, stale: int) -> DataFrame:
    """Series that were ever made up to ``now``, those of them without a sample in the last ``stale`` ms, the others, and the share
    of the former in all (0 without series)."""
    last = samples.where(F.col("ts_ms") <= now).groupBy("series_key").agg(F.max("ts_ms").alias("last"))
    counts = last.agg(F.count("*").alias("n_created"), F.count_if(F.col("last") < now - stale).alias("n_deleted"))
    share = F.when(F.col("n_created") > 0, F.col("n_deleted") / F.col("n_created")).otherwise(0.0)
    return counts.select((F.col("n_created") - F.col("n_deleted")).alias("n_active"), "n_created", "n_deleted", share.alias("churn"))


def cardinality(samples: DataFrame, exact: bool = True) -> DataFrame:
    return samples.agg((F.count_distinct("series_key") if exact else F.approx_count_distinct("series_key")).alias("n_series"))


def stats(samples: DataFrame) -> DataFrame:
    """Series, samples, and the first and last time."""
    each = samples.groupBy("series_key").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    return each.agg(F.count("*").alias("n_series"), F.sum("n").alias("n_samples"), F.min("a").alias("min_ts_ms"), F.max("b").alias("max_ts_ms"))


def time_bounds(samples: DataFrame) -> DataFrame:
    return samples.groupBy("series_key").agg(F.min("ts_ms").alias("min_ts_ms"), F.max("ts_ms").alias("max_ts_ms"), F.count("*").alias("n_samples"))
