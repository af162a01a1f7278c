"""The registered queries of the time-series engine, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.columns import bucket, label_of
from .operators import aggregate as agg
from .operators import counters, metadata, select
from .plans.model import Aggregation, Query, Selector
from .plans.selector import parse
from .session import shared_dir
from .sources import requests, store, tables

DAY, HOUR = 86_400_000, 3_600_000
#: 5 and 15 January 2024, and the day after the last event.
START, END, NOW = 1_704_412_800_000, 1_705_276_800_000, 1_706_659_200_000

_E = """e AS (SELECT '{__name__="event_value", event_type="' || event_type || '", user_id="' || user_id || '"}' AS series_key, event_type, user_id::VARCHAR AS user_id,
  epoch_us(ts) // 1000 AS ts_ms, value, event_id FROM events)"""
#: Errors have no event_type.
_O = """o AS (SELECT CASE WHEN event_type = 'error' THEN '{__name__="event_value", user_id="' || user_id || '"}' ELSE '{__name__="event_value", event_type="' || event_type || '", user_id="' || user_id || '"}' END AS series_key,
  CASE WHEN event_type <> 'error' THEN event_type END AS event_type, user_id::VARCHAR AS user_id, epoch_us(ts) // 1000 AS ts_ms, value, event_id FROM events)"""
_L = """l AS (SELECT '{__name__="lineitem_quantity", linestatus="' || l_linestatus || '", returnflag="' || l_returnflag || '"}' AS series_key, epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity AS value,
  {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey} AS seq FROM lineitem)"""
_P = """p AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_us(o_orderdate) // 1000 AS ts_ms, o_totalprice AS value FROM orders)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def _selecting(name: str, selector: str, where: str, optional: bool = False) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return select.select(tables.events(spark, folder, optional), Query(parse(selector))).select("series_key", "ts_ms", "value")

    QUERIES[name] = run
    SQL[name] = f"WITH {_O if optional else _E} SELECT series_key, ts_ms, value FROM {'o' if optional else 'e'} WHERE {where}"


_selecting("select_eq", '{event_type="click"}', "event_type = 'click'")
_selecting("select_neq", '{event_type!="click"}', "event_type IS NULL OR event_type <> 'click'", optional=True)
_selecting("select_regex", '{event_type=~"^(click|vi.w)$"}', "regexp_matches(event_type, '^(click|vi.w)$')", optional=True)
_selecting("select_not_regex", '{event_type!~"i"}', "event_type IS NULL OR NOT regexp_matches(event_type, 'i')", optional=True)
_selecting("select_multi", 'event_value{event_type!="view",user_id=~"^1[0-9]*$"}', "event_type <> 'view' AND regexp_matches(user_id, '^1[0-9]*$')")


@_query(f"WITH {_E} SELECT series_key, ts_ms, value FROM e WHERE ts_ms BETWEEN {START} AND {END}")
def time_range(spark, folder):
    return select.select(tables.events(spark, folder), Query(Selector(), START, END)).select("series_key", "ts_ms", "value")


@_query(f"WITH {_E} SELECT event_type, user_id, ts_ms, value FROM e WHERE event_type = 'purchase' AND ts_ms BETWEEN {START} AND {END}")
def exec_query(spark, folder):
    rows = select.select(tables.events(spark, folder), Query(parse('event_value{event_type="purchase"}'), START, END))
    return rows.select(label_of(rows, "event_type").alias("event_type"), label_of(rows, "user_id").alias("user_id"), "ts_ms", "value")


@_query(f"WITH {_O} SELECT DISTINCT series_key FROM o WHERE event_type IS NOT NULL")
def has_label(spark, folder):
    return metadata.having_label(tables.events(spark, folder, True), "event_type").select("series_key")


@_query(f"WITH {_E} SELECT DISTINCT series_key FROM e WHERE event_type = 'view'")
def series_list(spark, folder):
    return metadata.series(tables.events(spark, folder), parse('{event_type="view"}')).select("series_key")


@_query(f"WITH {_E}, a AS (SELECT DISTINCT series_key FROM e WHERE event_type = 'view'), b AS (SELECT DISTINCT series_key FROM e WHERE regexp_matches(event_type, 'v')) SELECT * FROM a UNION ALL SELECT * FROM b")
def series_multi_match(spark, folder):
    return metadata.series_of_each(tables.events(spark, folder), parse('{event_type="view"}'), parse('{event_type=~"v"}')).select("series_key")


@_query("SELECT unnest(['__name__', 'event_type', 'user_id']) AS label")
def label_names(spark, folder):
    return metadata.label_names(tables.events(spark, folder))


@_query("SELECT DISTINCT event_type AS value FROM events WHERE event_type <> 'error'")
def label_values(spark, folder):
    return metadata.label_values(tables.events(spark, folder, True), "event_type")


_POSTINGS = f"""WITH {_O}, s AS (SELECT DISTINCT series_key, event_type, user_id FROM o),
x AS (SELECT '__name__' AS label, 'event_value' AS value FROM s UNION ALL SELECT 'event_type', event_type FROM s WHERE event_type IS NOT NULL UNION ALL SELECT 'user_id', user_id FROM s)"""


@_query(_POSTINGS + " SELECT label, value, count(*) AS n_series FROM x GROUP BY ALL")
def posting_sizes(spark, folder):
    return metadata.postings(tables.events(spark, folder, True))


@_query(_POSTINGS + " SELECT label, count(DISTINCT value) AS n_values FROM x GROUP BY ALL")
def label_cardinality(spark, folder):
    return metadata.label_cardinality(tables.events(spark, folder, True))


@_query(f"WITH {_E} SELECT series_key, row_number() OVER (ORDER BY series_key) AS series_id FROM (SELECT DISTINCT series_key FROM e)")
def series_ids(spark, folder):
    return metadata.series_ids(tables.events(spark, folder))


@_query(f"WITH {_E} SELECT count(DISTINCT series_key) AS n_series FROM e")
def cardinality(spark, folder):
    return metadata.cardinality(tables.events(spark, folder))


@_query(f"WITH {_E} SELECT count(DISTINCT series_key) AS n_series, count(*) AS n_samples, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM e")
def tsdb_stats(spark, folder):
    return metadata.stats(tables.events(spark, folder))


@_query(f"WITH {_E} SELECT series_key, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms, count(*) AS n_samples FROM e GROUP BY ALL")
def time_bounds(spark, folder):
    return metadata.time_bounds(tables.events(spark, folder))


@_query(f"WITH {_E} SELECT series_key, ts_ms, value FROM e WHERE ts_ms BETWEEN {END} - {DAY} AND {END} QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ts_ms DESC, event_id DESC) = 1")
def instant_query(spark, folder):
    return select.instant(tables.events(spark, folder), Selector(), END, DAY).select("series_key", "ts_ms", "value")


@_query(f"WITH {_L} SELECT series_key, ts_ms, value FROM l QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ts_ms DESC, seq DESC) = 1")
def latest_per_series(spark, folder):
    return select.latest(tables.lineitem(spark, folder)).select("series_key", "ts_ms", "value")


@_query(f"WITH {_E} SELECT series_key, ts_ms, value, row_number() OVER (PARTITION BY series_key ORDER BY ts_ms, event_id)::INTEGER AS rank FROM e QUALIFY rank <= 10")
def head_per_series(spark, folder):
    return select.head(tables.events(spark, folder), 10, "ingest_seq").select("series_key", "ts_ms", "value", "rank")


@_query(f"WITH {_L} SELECT series_key, ts_ms, arg_max(value, seq) AS value FROM l GROUP BY ALL")
def dedup_last(spark, folder):
    return select.dedup_last(tables.lineitem(spark, folder))


@_query(f"WITH {_L}, a AS (SELECT series_key, ts_ms, arg_max(value, seq) AS value, 0 AS s FROM l WHERE value > 25 GROUP BY ALL), b AS (SELECT series_key, ts_ms, arg_max(value, seq) AS value, 1 AS s FROM l GROUP BY ALL) SELECT series_key, ts_ms, arg_min(value, s) AS value FROM (FROM a UNION ALL FROM b) GROUP BY ALL")
def merge_sources(spark, folder):
    every = tables.lineitem(spark, folder)
    return select.merge(select.dedup_last(every.where("value > 25")), select.dedup_last(every))


@_query(f"WITH {_E} SELECT series_key, event_type, user_id FROM (SELECT DISTINCT series_key, event_type, user_id FROM e) QUALIFY row_number() OVER (ORDER BY series_key) IN (2, 5, 40)")
def series_lookup(spark, folder):
    every = tables.events(spark, folder)
    found = metadata.series_of_ids(every, metadata.series_ids(every), 2, 5, 40)
    return found.select("series_key", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"))


@_query(f"WITH {_E}, t AS (SELECT max(ts_ms) AS last FROM e WHERE ts_ms <= {START + 20 * DAY} GROUP BY series_key), c AS (SELECT count(*) AS n_created, count(*) FILTER (last < {START + 17 * DAY}) AS n_deleted FROM t) SELECT n_created - n_deleted AS n_active, n_created, n_deleted, CASE WHEN n_created > 0 THEN n_deleted / n_created ELSE 0.0 END::DOUBLE AS churn FROM c")
def series_churn(spark, folder):
    return metadata.churn(tables.events(spark, folder), START + 20 * DAY, 3 * DAY)


_STEP = 3 * HOUR
_GRID_END = START + 20 * DAY


@_query(
    f"""WITH {_E}, r AS (SELECT series_key, ts_ms, value, row_number() OVER (PARTITION BY series_key ORDER BY ts_ms) - 1 AS rn, (ts_ms - {START}) // {_STEP} + 1 AS k FROM e WHERE ts_ms BETWEEN {START} AND {_GRID_END}),
n AS (SELECT series_key, k, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT series_key, k FROM (SELECT DISTINCT series_key FROM r), range(0, ({_GRID_END} - {START}) // {_STEP} + 1) AS t(k)),
c AS (SELECT series_key, k, sum(coalesce(n, 0)) OVER (PARTITION BY series_key ORDER BY k) AS c FROM g LEFT JOIN n USING (series_key, k)),
i AS (SELECT series_key, k, k + max(c - k) OVER (PARTITION BY series_key ORDER BY k) AS rn FROM c)
SELECT i.series_key, {START} + i.k * {_STEP} AS ts_ms, value FROM i JOIN r ON r.series_key = i.series_key AND r.rn = i.rn"""
)
def step_align(spark, folder):
    return select.align(tables.events(spark, folder), Query(Selector(), START, _GRID_END, _STEP))


_DUCK = {
    "sum": "round(sum(value), 6)",
    "avg": "round(avg(value), 6)",
    "max": "max(value)",
    "min": "min(value)",
    "count": "count(*)::DOUBLE",
    "stddev": "round(stddev_pop(value), 6)",
    "stdvar": "round(var_pop(value), 6)",
}


def _rounded(df: DataFrame, fn: str) -> DataFrame:
    """Sums of floating-point numbers depend on their order."""
    return df.withColumn("value", F.round("value", 6)) if fn in ("sum", "avg", "stddev", "stdvar") else df


def _aggregating(fn: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(agg.aggregate_by(tables.events(spark, folder), Aggregation(fn, HOUR, ("event_type",))), fn)

    QUERIES[f"agg_{fn}"] = run
    SQL[f"agg_{fn}"] = f"WITH {_E} SELECT event_type, ts_ms // {HOUR} * {HOUR} AS bucket_ms, {_DUCK[fn]} AS value FROM e GROUP BY ALL"


for _fn in _DUCK:
    _aggregating(_fn)


@_query(f"WITH {_E} SELECT ts_ms // {HOUR} * {HOUR} AS bucket_ms, round(sum(value), 6) AS value FROM e GROUP BY ALL")
def agg_global(spark, folder):
    return _rounded(agg.aggregate(tables.events(spark, folder), Aggregation("sum", HOUR)).drop("labels"), "sum")


@_query(f"WITH {_E} SELECT event_type, ts_ms // {HOUR} * {HOUR} AS bucket_ms, round(avg(value), 6) AS value FROM e WHERE regexp_matches(event_type, 'p.*') AND ts_ms BETWEEN {START} AND {END} GROUP BY ALL")
def agg_avg_by(spark, folder):
    rows = select.select(tables.events(spark, folder), Query(parse('event_value{event_type=~"p.*"}'), START, END))
    return _rounded(agg.aggregate_by(rows, Aggregation("avg", HOUR, ("event_type",))), "avg")


@_query(f"WITH {_P} SELECT status, priority, ts_ms // {7 * DAY} * {7 * DAY} AS bucket_ms, round(sum(value), 4) AS value FROM p GROUP BY ALL")
def agg_by_multi(spark, folder):
    out = agg.aggregate(tables.orders(spark, folder), Aggregation("sum", 7 * DAY, ("status", "priority")))
    return out.select(F.col("labels")["status"].alias("status"), F.col("labels")["priority"].alias("priority"), "bucket_ms", F.round("value", 4).alias("value"))


@_query(f"WITH {_O} SELECT event_type, ts_ms // {DAY} * {DAY} AS bucket_ms, count(*)::DOUBLE AS value FROM o GROUP BY ALL")
def agg_without(spark, folder):
    out = agg.aggregate(tables.events(spark, folder, True), Aggregation("count", DAY, without=("user_id", "__name__")))
    return out.select(F.col("labels")["event_type"].alias("event_type"), "bucket_ms", "value")


_PAIRS = f"""WITH {_E}, w AS (SELECT series_key, ts_ms, value, (ts_ms - lag(ts_ms) OVER s) / 1000.0 AS dt, value - lag(value) OVER s AS d FROM e WINDOW s AS (PARTITION BY series_key ORDER BY ts_ms))"""


@_query(_PAIRS + " SELECT series_key, ts_ms, CASE WHEN d < 0 THEN value ELSE d END / dt::DOUBLE AS value FROM w WHERE dt > 0")
def rate(spark, folder):
    return counters.rate(tables.events(spark, folder))


@_query(_PAIRS + " SELECT series_key, ts_ms, d / dt::DOUBLE AS value FROM w WHERE dt > 0")
def derivative(spark, folder):
    return counters.derivative(tables.events(spark, folder))


_ENDS = f"WITH {_E}, w AS (SELECT series_key, arg_min(value, ts_ms) AS a, arg_max(value, ts_ms) AS b, max(ts_ms) AS ts_ms FROM e GROUP BY ALL HAVING count(*) >= 2)"


@_query(_ENDS + " SELECT series_key, ts_ms, CASE WHEN b - a < 0 THEN b ELSE b - a END AS value FROM w")
def increase(spark, folder):
    return counters.increase(tables.events(spark, folder))


@_query(_ENDS + " SELECT series_key, ts_ms, b - a AS value FROM w")
def delta(spark, folder):
    return counters.delta(tables.events(spark, folder))


@_query(_PAIRS.replace("SELECT series_key, ts_ms, value, (ts_ms", "SELECT event_type, series_key, ts_ms, value, (ts_ms") + f" SELECT event_type, ts_ms // {DAY} * {DAY} AS bucket_ms, round(sum(CASE WHEN d < 0 THEN value ELSE d END / dt::DOUBLE), 6) AS value FROM w WHERE dt > 0 GROUP BY ALL")
def sum_rate_by(spark, folder):
    samples = tables.events(spark, folder)
    kind = F.regexp_extract("series_key", 'event_type="([^"]*)"', 1)
    return counters.rate(samples).groupBy(kind.alias("event_type"), bucket(DAY).alias("bucket_ms")).agg(F.round(F.sum("value"), 6).alias("value"))


@_query(f"WITH {_E} SELECT series_key, ts_ms // {DAY} * {DAY} AS bucket_ms, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) AS n FROM e GROUP BY ALL")
def downsample(spark, folder):
    each = tables.events(spark, folder).groupBy("series_key", bucket(DAY).alias("bucket_ms"))
    return each.agg(F.round(F.avg("value"), 6).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


@_query(f"WITH {_E} SELECT series_key, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) AS n FROM e GROUP BY ALL")
def series_summary(spark, folder):
    return agg.summary(tables.events(spark, folder)).withColumn("avg", F.round("avg", 6))


@_query(
    f"""WITH {_L} SELECT series_key, count(*) AS count, sum(value) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
list_sort(list(value))[1 + floor((count(*) - 1) * 0.5)::BIGINT] AS p50, list_sort(list(value))[1 + floor((count(*) - 1) * 0.95)::BIGINT] AS p95, list_sort(list(value))[1 + floor((count(*) - 1) * 0.99)::BIGINT] AS p99 FROM l GROUP BY ALL"""
)
def hist_stats(spark, folder):
    return agg.histogram(tables.lineitem(spark, folder)).withColumn("mean", F.round("mean", 6))


_BLOCKS = f"""WITH {_E}, b AS (SELECT ts_ms // {12 * HOUR} * {12 * HOUR} AS block_start, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms, count(*) AS n_samples, count(DISTINCT series_key) AS n_series FROM e GROUP BY ALL)"""


@_query(_BLOCKS + f" SELECT *, CASE WHEN abs(max_ts_ms - min_ts_ms - {2 * HOUR}) <= {HOUR} THEN 0 WHEN abs(max_ts_ms - min_ts_ms - {12 * HOUR}) <= {HOUR} THEN 1 WHEN abs(max_ts_ms - min_ts_ms - {7 * DAY}) <= {HOUR} THEN 2 END::INTEGER AS level FROM b")
def compact_levels(spark, folder):
    found = store.blocks(tables.events(spark, folder), 12 * HOUR)
    return found.withColumn("level", store.level(F.col("max_ts_ms") - F.col("min_ts_ms")))


@_query(_BLOCKS + f" SELECT block_start, n_samples FROM b WHERE max_ts_ms < {NOW} - {20 * DAY}")
def retention_filter(spark, folder):
    return store.expired(store.blocks(tables.events(spark, folder), 12 * HOUR), NOW, 20 * DAY).select("block_start", "n_samples")


@_query(
    _BLOCKS + f""" SELECT count(*) AS n_blocks, count(*) FILTER (max_ts_ms < {NOW - 20 * DAY}) AS n_expired, coalesce(sum(n_samples) FILTER (max_ts_ms < {NOW - 20 * DAY}), 0)::BIGINT AS n_samples_expired,
{NOW} - min(min_ts_ms) AS oldest_age_ms, {NOW} - max(max_ts_ms) AS newest_age_ms FROM b"""
)
def retention_report(spark, folder):
    return store.retention_report(store.blocks(tables.events(spark, folder), 12 * HOUR), NOW, 20 * DAY)


def _stored(spark: SparkSession, folder: str) -> store.Store:
    """A new store of all events in two appends: views, and the others."""
    made = store.Store(spark, f"{shared_dir(spark)}/tidemark/store-{uuid.uuid4().hex}", 12 * HOUR)
    every = tables.events(spark, folder)
    for some in (parse('{event_type="view"}'), parse('{event_type!="view"}')):
        made.append(select.select(every, Query(some)))
    return made


_READ = " SELECT event_type, user_id, ts_ms, arg_max(value, event_id) AS value FROM e"


def _read(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), "ts_ms", "value")


@_query(f"WITH {_E}{_READ} WHERE ts_ms BETWEEN {START} AND {END} AND event_type <> 'view' GROUP BY ALL")
def store_round_trip(spark, folder):
    return _read(Engine(spark, store=_stored(spark, folder)).query_range('{event_type!="view"}', START, END))


@_query(f"WITH {_E}{_READ} GROUP BY ALL")
def store_compacted(spark, folder):
    made = _stored(spark, folder)
    made.compact()
    return _read(select.select(made.read(), Query(Selector())))


@_query(f"WITH {_E}, b AS (SELECT *, max(ts_ms) OVER (PARTITION BY event_type = 'view', ts_ms // {12 * HOUR}) AS last FROM e) SELECT series_key, ts_ms, value FROM b WHERE last >= {NOW - 20 * DAY}")
def store_retained(spark, folder):
    made = _stored(spark, folder)
    made.policy = store.Retention(20 * DAY)
    made.retain(NOW)
    return made.read().select("series_key", "ts_ms", "value")


@_query(f"WITH {_E}{_READ} GROUP BY ALL")
def ingest_json(spark, folder):
    """Every event as a write request, put into a store as a stream would, and read back."""
    made = store.Store(spark, f"{shared_dir(spark)}/tidemark/store-{uuid.uuid4().hex}", 12 * HOUR)
    bodies = requests.requests(select.dedup_last(tables.events(spark, folder)).join(metadata.series(tables.events(spark, folder)), "series_key"))
    made.append(requests.last_written(requests.samples(bodies)).withColumn("ingest_seq", F.lit(1)))
    return _read(made.read())


#: Queries that write tables before they read them.
WRITING = ("series_lookup", "store_round_trip", "store_compacted", "store_retained", "ingest_json")
