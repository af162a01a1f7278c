"""Selection, latest samples, step alignment, duplicates and merging."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_range, near_range, selected
from ..plans.model import Query, QueryError, Selector

#: Grid points of one series that are made at most; a finer grid is taken for a mistake.
GRID_LIMIT = 10_000_000


def select(samples: DataFrame, query: Query) -> DataFrame:
    """Samples of the selected series in the range.  Where the table is partitioned by ``metric`` and blocks of ``block_ms`` from
    ``block_start``, predicates on these are added, so that only the partitions in question are listed."""
    out = samples
    if "metric" in samples.columns and query.selector.metric is not None:
        out = out.where(F.col("metric") == query.selector.metric)
    if "block_start" in samples.columns and not query.unbounded:
        out = out.where((F.col("block_start") <= query.end) & (F.col("block_start") > query.start - F.col("block_ms")))
    return out.where(selected(query.selector, samples) & in_range(query) & near_range(samples, query))


def instant(samples: DataFrame, selector: Selector, time: int, lookback: int = 0) -> DataFrame:
    """The last sample of each series at ``time`` (or up to ``lookback`` ms before)."""
    near = near_range(samples, Query(selector, time - lookback, time))
    return latest(samples.where(selected(selector, samples) & F.col("ts_ms").between(time - lookback, time) & near))


def latest(samples: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """The last sample of each series; of several at that time, the one written last."""
    last = F.max_by(F.struct("labels", "ts_ms", "value"), F.struct("ts_ms", order))
    return samples.groupBy("series_key").agg(last.alias("s")).select("series_key", "s.labels", "s.ts_ms", "s.value")


def head(samples: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` samples of each series."""
    rank = F.row_number().over(Window.partitionBy("series_key").orderBy("ts_ms", *order))
    return samples.withColumn("rank", rank).where(F.col("rank") <= n)


def dedup_last(samples: DataFrame, order: Column | str = "ingest_seq") -> DataFrame:
    """One sample for each series and time, the one written last: a grouped maximum, summed up before the shuffle."""
    return samples.groupBy("series_key", "ts_ms").agg(F.max_by("value", order).alias("value"))


def merge(*sources: DataFrame) -> DataFrame:
    """Several sources in one order of time; of the samples of a series at one time, the one of the first source."""
    ranked = [s.select("series_key", "ts_ms", "value").withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    every = functools.reduce(DataFrame.unionByName, ranked)
    return every.groupBy("series_key", "ts_ms").agg(F.min_by("value", "source").alias("value"))


def align(samples: DataFrame, query: Query) -> DataFrame:
    """Samples on the grid start, start + step, ... of the range: each grid time takes the first sample not yet taken that is not
    before it, stamped with the grid time.

    In closed form: with c(k) samples before grid time k, the sample taken there is number k + max over j <= k of (c(j) - j), if
    there is one.  That maximum only goes up where samples are, so it is kept for the times from one such k to the next, and of
    these only those are made that a sample is left for: the grid is never made, however many series there are."""
    if query.step <= 0:
        raise QueryError("a step must be positive")
    start, end, step = query.start, query.end, query.step
    last = (end - start) // step
    if last > GRID_LIMIT:
        raise QueryError(f"the range has {last} steps; at most {GRID_LIMIT} are made")
    inside = samples.where(in_range(query) & near_range(samples, query))
    series = Window.partitionBy("series_key").orderBy("ts_ms")
    after = F.when(F.col("ts_ms") < start, 0).otherwise(F.expr(f"(ts_ms - {start}L) div {step}L") + 1)
    rows = inside.select("series_key", "ts_ms", "value", (F.row_number().over(series) - 1).cast("long").alias("rn"), after.cast("long").alias("k"))
    by_k = Window.partitionBy("series_key").orderBy("k")
    upto, whole = by_k.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("series_key")
    steps = rows.groupBy("series_key", "k").agg((F.max("rn") + 1).alias("c")).select(
        "series_key",
        "k",
        F.greatest(F.lit(0), F.max(F.col("c") - F.col("k")).over(upto)).alias("m"),
        (F.coalesce(F.lead("k").over(by_k), F.lit(last + 1)) - 1).alias("to"),
        F.lag("k").over(by_k).isNull().alias("first"),
        F.max("c").over(whole).alias("n"),
    )
    zero = F.lit(0).cast("long")
    ahead = F.struct(zero.alias("k"), F.when(F.col("first"), F.col("k") - 1).otherwise(-1).cast("long").alias("to"), zero.alias("m"))
    spans = steps.select("series_key", "n", F.inline(F.array(F.struct("k", "to", "m"), ahead)))
    spans = spans.withColumn("to", F.least("to", F.col("n") - 1 - F.col("m"), F.lit(last))).where("k <= to")
    taken = spans.select("series_key", "m", F.explode(F.sequence("k", "to")).alias("k")).select("series_key", "k", (F.col("k") + F.col("m")).alias("rn"))
    return taken.join(rows.select("series_key", "rn", "value"), ["series_key", "rn"]).select("series_key", (F.col("k") * step + start).alias("ts_ms"), "value")
