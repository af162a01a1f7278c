"""Write requests: JSON documents of series with labels and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import series_key

SCHEMA = "struct<timeseries: array<struct<labels: array<struct<name: string, value: string>>, samples: array<struct<timestamp: bigint, value: double>>>>>"


def label_map(pairs: Column) -> Column:
    """A map of an array of (name, value); the last of a name counts."""
    named = F.filter(pairs, lambda p: p["name"].isNotNull())
    last = lambda k: F.element_at(F.filter(named, lambda p: p["name"] == k), -1)["value"]
    names = F.array_distinct(F.transform(named, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.coalesce(last(k), F.lit(""))))


def samples(requests: DataFrame, body: str = "body", seq: Column | None = None) -> DataFrame:
    """Canonical samples of the requests in column ``body``; malformed ones, and series without samples, give none.  ``seq``: the order of
    the requests (by default none: the order of Spark's ids), to which the place of a sample in its request is added."""
    order = (F.monotonically_increasing_id() if seq is None else seq).alias("request")
    parsed = requests.select(order, F.from_json(F.col(body), SCHEMA).alias("r")).select("request", F.posexplode("r.timeseries").alias("s_pos", "s"))
    labelled = parsed.select("request", "s_pos", label_map(F.coalesce(F.col("s.labels"), F.array().cast("array<struct<name:string,value:string>>"))).alias("labels"), "s.samples")
    rows = labelled.select("request", "s_pos", "labels", F.posexplode("samples").alias("pos", "x")).where("x.timestamp IS NOT NULL AND x.value IS NOT NULL")
    return rows.select(series_key(F.col("labels")).alias("series_key"), "labels", F.col("x.timestamp").alias("ts_ms"), F.col("x.value").alias("value"), F.struct("request", "s_pos", "pos").alias("ingest_seq"))


def last_written(rows: DataFrame) -> DataFrame:
    """The last written of the samples of a series and time."""
    return rows.groupBy("series_key", "labels", "ts_ms").agg(F.max_by("value", "ingest_seq").alias("value"))


def requests(samples: DataFrame, per_series: int = 1000) -> DataFrame:
    """The inverse: a request (column ``body``) for at most ``per_series`` samples of a series, so that a long series is many requests."""
    part = F.floor(F.row_number().over(Window.partitionBy("series_key").orderBy("ts_ms")) / per_series)
    grouped = samples.withColumn("part", part).groupBy("series_key", "part").agg(F.first("labels").alias("labels"), F.sort_array(F.collect_list(F.struct(F.col("ts_ms").alias("timestamp"), "value"))).alias("samples"))
    pairs = F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return grouped.select("series_key", F.to_json(F.struct(F.array(F.struct(pairs.alias("labels"), "samples")).alias("timeseries"))).alias("body"))
