"""Canonical samples of ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SOURCE_TIME, promoted


def samples(df: DataFrame, metric: str, labels: dict[str, Column], ts: str, value: str, seq: Column) -> DataFrame:
    """``(series_key, labels, ts_ms, value, ingest_seq)`` of a table, a column for each label and the time as the
    table has it; null labels are missing ones, times are cut to ms.  As the labels' names are known, the key is put together from columns, without a look at the map."""
    every = {"__name__": F.lit(metric), **{k: c.cast("string") for k, c in labels.items()}}
    pairs = [x for k, c in every.items() for x in (F.lit(k), c)]
    full = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    quoted = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    key = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'{k}="'), quoted(every[k]), F.lit('"')) for k in sorted(every)]), F.lit("}"))
    return df.select(
        key.alias("series_key"),
        full.alias("labels"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"),
        F.col(value).cast("double").alias("value"),
        seq.alias("ingest_seq"),
        F.col(ts).alias(SOURCE_TIME),
        *[c.alias(promoted(k)) for k, c in every.items()],
    )


def events(spark: SparkSession, folder: str, optional: bool = False) -> DataFrame:
    """``optional``: errors have no ``event_type``, to try missing labels."""
    df = spark.read.parquet(f"{folder}/events.parquet")
    kind = F.when(F.col("event_type") != "error", F.col("event_type")) if optional else F.col("event_type")
    return samples(df, "event_value", {"event_type": kind, "user_id": F.col("user_id")}, "ts", "value", F.col("event_id"))


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    return samples(df, "lineitem_quantity", {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}, "l_shipdate", "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/orders.parquet")
    return samples(df, "order_price", {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, "o_orderdate", "o_totalprice", F.col("o_orderkey"))
