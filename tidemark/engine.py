"""The facade: what a client of the query service calls."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from time import time_ns

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import rendered
from .operators import aggregate, counters, metadata, select
from .plans.model import Aggregation, Query, QueryError
from .plans.selector import parse
from .sources import requests
from .sources.store import Retention, Store, retention_report

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration(text: str) -> int:
    """Milliseconds of ``1h30m``, ``7d``, ``500ms``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise QueryError(f"not a duration: {text!r}")
    return round(sum(float(n) * _UNITS[u] for n, u in parts))


def moment(text: str, now: int | None = None) -> int:
    """Milliseconds since the epoch of a number of them, ``now``, ``-1h``, or a date with or without time (UTC)."""
    now = now if now is not None else int(datetime.now(timezone.utc).timestamp() * 1000)
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if text == "now":
        return now
    if text.startswith("-"):
        return now - duration(text[1:])
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise QueryError(f"not a time: {text!r}") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class Engine:
    """Queries over samples: a frame of them, or a store's."""

    def __init__(self, spark: SparkSession, samples: DataFrame | None = None, store: Store | None = None):
        if (samples is None) == (store is None):
            raise QueryError("an engine has either samples or a store")
        self.spark, self._samples, self.store = spark, samples, store

    def samples(self) -> DataFrame:
        return self._samples if self.store is None else self.store.read()

    def write(self, bodies: list[str]) -> None:
        """Append the samples of JSON write requests."""
        if self.store is None:
            raise QueryError("only a store can be written to")
        rows = self.spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "request long, body string")
        found = requests.samples(rows, seq=F.col("request"))
        self.store.append(requests.last_written(found).withColumn("ingest_seq", F.lit(time_ns()).cast("long")))

    def _selected(self, selector: str, start: int, end: int, step: int = 0) -> tuple[DataFrame, Query]:
        query = Query(parse(selector), start, end, step)
        return select.select(self.samples(), query), query

    def _deduplicated(self, rows: DataFrame) -> DataFrame:
        # labels in the key: the buffers are then of numbers alone, and no rows are sorted
        return rows.groupBy("series_key", "labels", "ts_ms").agg(F.max_by("value", "ingest_seq").alias("value"))

    def query(self, selector: str, time: int, lookback: int = 0) -> DataFrame:
        return select.instant(self.samples(), parse(selector), time, lookback)

    def query_range(self, selector: str, start: int, end: int, step: int = 60_000, align: bool = False) -> DataFrame:
        rows, query = self._selected(selector, start, end, step)
        rows = self._deduplicated(rows)
        return select.align(rows, query) if align else rows

    def aggregate(self, selector: str, fn: str, start: int, end: int, step: int, by: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
        rows, _ = self._selected(selector, start, end)
        return aggregate.aggregate(self._deduplicated(rows), Aggregation(fn, step, by, without))

    def rate(self, selector: str, start: int, end: int, range_seconds: float = 1, block_ms: int | None = None) -> DataFrame:
        return counters.rate(self._deduplicated(self._selected(selector, start, end)[0]), range_seconds, block_ms=block_ms)

    def derivative(self, selector: str, start: int, end: int, block_ms: int | None = None) -> DataFrame:
        return counters.derivative(self._deduplicated(self._selected(selector, start, end)[0]), block_ms=block_ms)

    def increase(self, selector: str, start: int, end: int) -> DataFrame:
        return counters.increase(self._deduplicated(self._selected(selector, start, end)[0]))

    def delta(self, selector: str, start: int, end: int) -> DataFrame:
        return counters.delta(self._deduplicated(self._selected(selector, start, end)[0]))

    def labels(self) -> DataFrame:
        return metadata.label_names(self.samples())

    def label_values(self, name: str) -> DataFrame:
        return metadata.label_values(self.samples(), name)

    def series(self, *selectors: str) -> DataFrame:
        return metadata.series_of_each(self.samples(), *[parse(x) for x in selectors or ("{}",)])

    def status(self) -> DataFrame:
        return metadata.stats(self.samples())

    def series_of_id(self, ids: DataFrame, *wanted: int) -> DataFrame:
        """The series of ids that ``metadata.series_ids`` gave."""
        return metadata.series_of_ids(self.samples(), ids, *wanted)

    def churn(self, now: int, stale: int = 3_600_000) -> DataFrame:
        return metadata.churn(self.samples(), now, stale)

    def _stored(self) -> Store:
        if self.store is None:
            raise QueryError("only a store has blocks")
        return self.store

    def compaction_stats(self) -> DataFrame:
        return self._stored().stats()

    def trigger_compaction(self, least: int = 3) -> int:
        return self._stored().compact(least)

    def retention_stats(self, now: int) -> DataFrame:
        return retention_report(self._stored().blocks(), now, self._stored().policy.max_age)

    def retention_policy(self) -> Retention:
        return self._stored().policy

    def set_retention_policy(self, policy: Retention) -> None:
        if policy.max_age <= 0:
            raise QueryError("samples must be kept for some time")
        self._stored().policy = policy

    def matrix(self, rows: DataFrame) -> DataFrame:
        """A row of JSON for each series: its labels and its samples in order, values as strings."""
        pairs = F.sort_array(F.collect_list(F.struct("ts_ms", rendered(F.col("value")).alias("v"))))
        values = F.transform(pairs, lambda p: F.array(p["ts_ms"].cast("string"), F.concat(F.lit('"'), p["v"], F.lit('"'))))
        text = F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("["), F.array_join(v, ","), F.lit("]"))), ","), F.lit("]"))
        return rows.groupBy("series_key").agg(F.first("labels").alias("labels"), text.alias("text")).select(F.concat(F.lit('{"metric":'), F.to_json("labels"), F.lit(',"values":'), "text", F.lit("}")).alias("series"))

    def response(self, rows: DataFrame, limit: int = 10_000) -> str:
        """The service's JSON answer; more than ``limit`` series are an error, not a cut."""
        found = self.matrix(rows).limit(limit + 1).collect()
        if len(found) > limit:
            return json.dumps({"status": "error", "error": f"more than {limit} series"})
        return '{"status":"success","data":{"resultType":"matrix","result":[' + ",".join(x[0] for x in found) + "]}}"
