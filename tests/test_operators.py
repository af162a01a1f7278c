import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.columns import rendered, selected, series_key
from tidemark.operators import aggregate, counters, metadata, select
from tidemark.plans.model import AGGREGATES, Aggregation, Query, QueryError, Selector
from tidemark.plans.selector import parse
from tidemark.sources import requests, tables
from tidemark.sources.store import HOUR, Retention, Store, compaction_windows, level, level_of
from tidemark.streaming.ingest import ingest

SCHEMA = "labels map<string,string>, ts_ms long, value double, ingest_seq long"


def frame(spark, rows):
    """rows: (labels, [(ts, value), ...])."""
    flat = [(labels, t, float(v), i) for labels, points in rows for i, (t, v) in enumerate(points)]
    return spark.createDataFrame(flat, SCHEMA).withColumn("series_key", series_key(F.col("labels")))


def points(df, *extra):
    return sorted(tuple(r) for r in df.select(*extra, "ts_ms", "value").collect())


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "fn,values,expected",
    [
        ("sum", [1, 2, 3, 4, 5], 15),
        ("avg", [1, 2, 3, 4, 5], 3),
        ("max", [1, 5, 3, 2, 4], 5),
        ("min", [5, 1, 3, 2, 4], 1),
        ("count", [1, 2, 3, 4, 5], 5),
        ("stddev", [2, 4, 4, 4, 5, 5, 7, 9], 2),
        ("stdvar", [2, 4, 4, 4, 5, 5, 7, 9], 4),
        ("stddev", [7], 0),
        ("stdvar", [NAN], 0),
        ("max", [NAN, 1, 2], 2),
        ("min", [NAN, 1, 2], 1),
        ("max", [NAN], -INF),
        ("min", [NAN], INF),
        ("sum", [NAN, 1], NAN),
        ("avg", [NAN, 1], NAN),
        ("count", [NAN], 1),
    ],
)
def test_aggregates(spark, fn, values, expected):
    df = frame(spark, [({"a": "x"}, [(i, v) for i, v in enumerate(values)])])
    found = aggregate.aggregate(df, Aggregation(fn, 1000)).first().value
    assert math.isnan(found) if math.isnan(expected) else found == expected


@pytest.mark.parametrize(
    "by,without,expected",
    [
        (("host",), (), {"host": "server1"}),
        (("host", "region"), (), {"host": "server1", "region": "us-west"}),
        ((), ("region", "env"), {"__name__": "cpu_usage", "host": "server1"}),
        ((), (), {}),
        (("missing",), (), {}),
        (("host",), ("env",), {"host": "server1"}),
    ],
)
def test_groups(spark, by, without, expected):
    labels = {"__name__": "cpu_usage", "host": "server1", "region": "us-west", "env": "prod"}
    assert aggregate.aggregate(frame(spark, [(labels, [(0, 1)])]), Aggregation("sum", 10, by, without)).first().labels == expected


def test_bucketed_sum(spark):
    rows = [({"__name__": "http_requests", "host": f"server{h}"}, [(1000 + 1000 * i, h * i) for i in range(10)]) for h in (1, 2)]
    df = select.select(frame(spark, rows), Query(parse("http_requests"), 1000, 10000))
    found = aggregate.aggregate(df, Aggregation("sum", 2000)).select("bucket_ms", "value").collect()
    assert sorted(map(tuple, found)) == [(0, 0), (2000, 9), (4000, 21), (6000, 33), (8000, 45), (10000, 27)]


def test_buckets_before_the_epoch(spark):
    df = frame(spark, [({}, [(-1500, 1), (-500, 1), (500, 1)])])
    assert sorted(map(tuple, aggregate.aggregate(df, Aggregation("count", 1000)).select("bucket_ms", "value").collect())) == [(-1000, 1), (0, 2)]


@pytest.mark.parametrize(
    "fn,samples,expected",
    [
        (counters.rate, [(1000, 100), (2000, 110), (3000, 125), (4000, 145)], [(2000, 10), (3000, 15), (4000, 20)]),
        (counters.rate, [(1000, 100), (2000, 110), (3000, 10), (4000, 20)], [(2000, 10), (3000, 10), (4000, 10)]),
        (counters.increase, [(1000, 100), (2000, 150), (3000, 225)], [(3000, 125)]),
        (counters.increase, [(1000, 100), (2000, 150), (3000, 30)], [(3000, 30)]),
        (counters.delta, [(1000, 20), (2000, 25), (3000, 22)], [(3000, 2)]),
        (counters.derivative, [(1000, 10), (2000, 20), (3000, 25), (4000, 20)], [(2000, 10), (3000, 5), (4000, -5)]),
        *[(f, [(1000, 1)], []) for f in (counters.rate, counters.increase, counters.delta, counters.derivative)],
        (counters.rate, [(1000, 1), (1000, 2), (2000, 5)], [(2000, 3)]),
    ],
)
def test_counters(spark, fn, samples, expected):
    assert points(fn(frame(spark, [({"__name__": "c"}, samples)]))) == expected


def test_rate_needs_a_range(spark):
    with pytest.raises(QueryError):
        counters.rate(frame(spark, [({}, [(0, 1)])]), 0)


def test_merge_and_dedup(spark):
    a, b = frame(spark, [({}, [(1000, 1), (2000, 2)])]), frame(spark, [({}, [(2000, 2.5), (3000, 3)])])
    assert points(select.merge(a, b)) == [(1000, 1), (2000, 2), (3000, 3)]
    c = frame(spark, [({}, [(1000, 1), (2000, 2), (1000, 1.5), (3000, 3), (2000, 2.5)])])
    once = select.dedup_last(c)
    assert points(once) == [(1000, 1.5), (2000, 2.5), (3000, 3)]


def greedy(samples, start, end, step):
    out, at = [], start
    for t, v in samples:
        if at > end:
            break
        if t >= at:
            out.append((at, v))
            at += step
    return out


def test_alignment(spark):
    df = frame(spark, [({}, [(1000, 1), (1100, 1.1), (1200, 1.2), (1300, 1.3), (1400, 1.4)])])
    assert points(select.align(df, Query(Selector(), 1000, 1500, 200))) == [(1000, 1), (1200, 1.2), (1400, 1.4)]
    with pytest.raises(QueryError):
        select.align(df, Query(Selector(), 1000, 1500, 0))
    with pytest.raises(QueryError):
        select.align(df, Query(Selector(), 1, 10**12, 1))
    r = random.Random(1)
    series = {f"s{k}": sorted(r.sample(range(0, 2000), r.randint(1, 60))) for k in range(30)}
    df = frame(spark, [({"k": k}, [(t, i) for i, t in enumerate(ts)]) for k, ts in series.items()])
    found = points(select.align(df, Query(Selector(), 100, 1900, 70)), "series_key")
    inside = {k: [(t, float(i)) for i, t in enumerate(ts) if 100 <= t <= 1900] for k, ts in series.items()}
    assert found == sorted((f'{{k="{k}"}}', t, v) for k, s in inside.items() for t, v in greedy(s, 100, 1900, 70))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alignment_makes_no_grid(spark):
    df = frame(spark, [({"k": k}, [(t, t) for t in (-30, -5, 0, 3, 999_995)]) for k in "ab"])
    found = points(select.align(df, Query(Selector(), -30, 1_000_000, 10)), "series_key")
    expected = greedy([(t, float(t)) for t in (-30, -5, 0, 3, 999_995)], -30, 1_000_000, 10)
    assert found == sorted((f'{{k="{k}"}}', t, v) for k in "ab" for t, v in expected)
    assert points(select.align(df.where("false"), Query(Selector(), 0, 100, 10))) == []


def test_blocks_do_not_change_rates(spark):
    r = random.Random(3)
    times = [sorted(r.choices(range(-400, 3000), k=n)) for n in (1, 2, 60, 200)]
    df = frame(spark, [({"k": str(i)}, [(t, r.randint(0, 50)) for t in ts]) for i, ts in enumerate(times)])
    for fn in (counters.rate, counters.derivative):
        whole = points(fn(df, order=("ingest_seq",)), "series_key")
        assert whole and all(points(fn(df, order=("ingest_seq",), block_ms=b), "series_key") == whole for b in (1, 70, 1000, 10**9))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_time_ranges_reach_the_files(spark, tmp_path, kind):
    ms = [d * 86_400_000 + h * HOUR for d in range(1, 6) for h in (0, 5, 23)]
    rows = spark.createDataFrame([(x, float(x)) for x in ms], "ms long, v double").select(F.timestamp_millis("ms").cast(kind).alias("at"), "v")
    rows.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = tables.samples(spark.read.parquet(str(tmp_path / "t")), "m", {"a": F.lit("x")}, "at", "v", F.lit(0))
        every = [r.ts_ms for r in df.select("ts_ms").collect()]
        low, high = sorted(every)[4], sorted(every)[9]
        for found in (select.select(df, Query(Selector(), low, high)), select.select(df, Query(Selector(), low, 1 << 60))):
            inside = [t for t in every if low <= t <= (high if "1152921504606846976" not in plan(found) else 1 << 60)]
            assert sorted(r.ts_ms for r in found.collect()) == sorted(inside)
            assert "GreaterThanOrEqual(at," in plan(found)
        assert select.instant(df, Selector(), high, 0).first().ts_ms == high
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


INDEX = [("server1", "prod", "cpu"), ("server2", "prod", "cpu"), ("server3", "dev", "cpu"), ("server1", "prod", "memory"), ("database1", "prod", "cpu")]


@pytest.mark.parametrize("selector,ids", [('{host=~"server.*", env="prod", metric="cpu"}', [1, 2]), ('{host=~"server.*", env!="dev"}', [1, 2, 4]), ('{env="prod", metric="cpu", host!="server1"}', [2, 5]), ('{host=~"nomatch"}', []), ('{zone!="a"}', [1, 2, 3, 4, 5]), ("{}", [1, 2, 3, 4, 5])])
def test_selection(spark, selector, ids):
    rows = [(dict(zip(("host", "env", "metric"), x)), i) for i, x in enumerate(INDEX, 1)]
    df = spark.createDataFrame(rows, "labels map<string,string>, id long")
    assert [r.id for r in df.where(selected(parse(selector))).orderBy("id").collect()] == ids


def test_metadata(spark):
    df = frame(spark, [(dict(zip(("host", "env", "metric"), x)), [(1, 1), (2, 2)]) for x in INDEX])
    assert {r.label for r in metadata.label_names(df).collect()} == {"host", "env", "metric"}
    assert {r.value for r in metadata.label_values(df, "env").collect()} == {"prod", "dev"}
    assert metadata.label_values(df, "nothing").count() == 0
    assert {(r.label, r.value): r.n_series for r in metadata.postings(df).collect()}[("metric", "cpu")] == 4
    ids = metadata.series_ids(df)
    keys = sorted(r.series_key for r in ids.collect())
    assert [r.series_key for r in ids.orderBy("series_id").collect()] == keys and {r.series_id for r in ids.collect()} == set(range(1, 6))
    more = frame(spark, [({"host": "a"}, [(1, 1)])]).unionByName(df)
    again = {r.series_key: r.series_id for r in metadata.series_ids(more, ids).collect()}
    assert again['{host="a"}'] == 6 and len(again) == 6
    assert tuple(metadata.stats(df).first()) == (5, 10, 1, 2)
    assert metadata.series_of_each(df, parse('{env="dev"}'), parse("{}")).count() == 6


def test_series_keys_are_injective(spark):
    df = spark.createDataFrame([({"a": '1", b="2'},), ({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({},)], "labels map<string,string>")
    keys = [r[0] for r in df.select(series_key(F.col("labels"))).collect()]
    assert keys[0] != keys[1] == keys[2] and keys[3] == "{}"


def test_rendering(spark):
    df = spark.createDataFrame([(x,) for x in (0.75, INF, -INF, NAN)], "v double")
    assert [r[0] for r in df.select(rendered(F.col("v"))).collect()] == ["0.750000", "+Inf", "-Inf", "NaN"]


BODY = {"timeseries": [{"labels": [{"name": "__name__", "value": "test_metric"}, {"name": "host", "value": "old"}, {"name": "host", "value": "server1"}], "samples": [{"timestamp": 1000 * i, "value": i} for i in (1, 2, 3)]}]}


def test_engine_round_trip(spark, tmp_path):
    engine = Engine(spark, store=Store(spark, str(tmp_path / "s")))
    engine.write([json.dumps(BODY), "not json"])
    found = engine.query_range('test_metric{host="server1"}', 0, 5000, 1000)
    answer = json.loads(engine.response(found))
    assert answer["data"]["result"] == [{"metric": {"__name__": "test_metric", "host": "server1"}, "values": [[1000, "1.000000"], [2000, "2.000000"], [3000, "3.000000"]]}]
    assert [r.value for r in engine.query("{}", 2000).collect()] == [2.0] and engine.query("{}", 2001).count() == 0
    assert engine.query("{}", 2500, lookback=1000).first().value == 2.0
    assert tuple(engine.status().first()) == (1, 3, 1000, 3000)
    assert {r.label for r in engine.labels().collect()} == {"__name__", "host"}
    back = requests.requests(engine.samples(), per_series=2)
    again = requests.samples(back)
    assert points(again) == [(1000, 1), (2000, 2), (3000, 3)]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read().count() == 0
    row = lambda seq, pts: frame(spark, [({"__name__": "m"}, pts)]).withColumn("ingest_seq", F.lit(seq).cast("long"))
    s.append(row(1, [(1000, 1), (3 * HOUR, 2)]))
    s.append(row(2, [(1000, 10), (9 * HOUR, INF)]))
    assert s.read().count() == 4
    s.compact()
    assert points(s.read()) == [(1000, 10), (3 * HOUR, 2), (9 * HOUR, INF)]
    pruned = select.select(s.read(), Query(parse("m"), 3 * HOUR, 3 * HOUR))
    assert points(pruned) == [(3 * HOUR, 2)]
    assert "PartitionFilters: [" in pruned._jdf.queryExecution().toString() and "block_start" in pruned._jdf.queryExecution().toString()
    assert s.drop_older(9 * HOUR) == 0 and s.read().count() == 3  # blocks go whole
    assert s.drop_older(9 * HOUR + 1) == 1 and s.read().count() == 0


def test_retention_before_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append(frame(spark, [({"__name__": "m"}, [(1000, 1), (3 * HOUR, 2), (9 * HOUR, 3)])]))
    assert s.drop_older(3 * HOUR) == 1
    assert points(s.read()) == [(3 * HOUR, 2), (9 * HOUR, 3)] and s.blocks().count() == 2


def test_levels_of_a_store(spark, tmp_path):
    """Three blocks or more in a window become one of the next level; the others are not touched, and week blocks come of half-days."""
    s = Store(spark, str(tmp_path / "s"))
    row = lambda seq, pts: frame(spark, [({"__name__": "m", "i": str(t % 2)}, [(t, v)]) for t, v in pts]).withColumn("ingest_seq", F.lit(seq).cast("long"))
    half = lambda d: [(12 * HOUR * d + 2 * HOUR * i + i, i) for i in range(4)]
    s.append(row(1, half(0) + half(1) + half(2) + [(40 * 24 * HOUR, 5)]))
    s.append(row(2, [(0, 77)]))
    before = {tuple(b) for b in s.blocks().collect()}
    assert {(n, len(b)) for n, b in s.due()} == {(1, 5), (1, 4)}
    assert s.compact() == 4  # three half-days, then these as one
    found = {(b.block_start, b.block_ms, b.level, b.n_samples) for b in s.blocks().collect()}
    assert found == {(0, 7 * 24 * HOUR, 2, 12), (40 * 24 * HOUR, 2 * HOUR, 0, 1)}
    assert [b for b in s.blocks().collect() if tuple(b) in before]
    want = sorted([(t, v) for d in range(3) for t, v in half(d) if t] + [(0, 77), (40 * 24 * HOUR, 5)])
    assert points(s.read()) == want and s.due() == [] and s.compact() == 0
    assert points(select.select(s.read(), Query(parse("m"), 24 * HOUR, 27 * HOUR))) == [(24 * HOUR, 0), (26 * HOUR + 1, 1)]
    stats = {r.level: (r.n_blocks, r.n_samples) for r in s.stats().collect()}
    assert stats == {0: (1, 1), 2: (1, 12)}
    assert s.validate().count() == 0
    files = lambda: list((tmp_path / "s").rglob("*.parquet"))
    n = len(files())
    s.clean(grace_ms=0)
    assert len(files()) < n and points(s.read()) == want and not s._generation()[1].gone and s.validate().count() == 0
    for f in files():
        if "block_start=0" in str(f):
            f.unlink()
    assert [(r.n_samples, r.n_found) for r in s.validate().collect()] == [(12, 0)]
    assert [level_of(x * HOUR) for x in (1, 2, 12, 100, 168, 200)] == [0, 0, 1, 1, 2, 2]


def test_policy(spark, tmp_path):
    engine = Engine(spark, store=Store(spark, str(tmp_path / "s"), policy=Retention(enabled=False)))
    engine.store.append(frame(spark, [({"__name__": "m"}, [(1000, 1), (30 * HOUR, 2)])]))
    assert engine.store.retain(10**15) == 0
    engine.set_retention_policy(Retention(10 * HOUR))
    assert tuple(engine.retention_stats(35 * HOUR).first()) == (2, 1, 1, 35 * HOUR - 1000, 5 * HOUR)
    assert engine.store.retain(35 * HOUR) == 1 and points(engine.samples()) == [(30 * HOUR, 2)]
    assert engine.compaction_stats().first().n_blocks == 1 and engine.trigger_compaction() == 0
    assert engine.retention_policy() == Retention(10 * HOUR)
    with pytest.raises(QueryError):
        engine.set_retention_policy(Retention(0))
    with pytest.raises(QueryError):
        Engine(spark, engine.samples()).compaction_stats()


def test_churn_and_lookup(spark):
    df = frame(spark, [({"a": "x"}, [(10, 1), (500, 1)]), ({"a": "y"}, [(20, 1)]), ({"a": "z"}, [(900, 1)])])
    assert tuple(metadata.churn(df, 600, 200).first()) == (1, 2, 1, 0.5)
    assert tuple(metadata.churn(df, 5, 200).first()) == (0, 0, 0, 0.0)
    ids = metadata.series_ids(df)
    assert [(r.series_id, r.labels) for r in metadata.series_of_ids(df, ids, 2, 9).collect()] == [(2, {"a": "y"})]


def test_hash_aggregates(spark):
    """Numbers alone are in the buffers, so that nothing is sorted before it is grouped."""
    df = frame(spark, [({"a": "x"}, [(10, 1)])])
    for found in (select.dedup_last(df), metadata.series(df), metadata.label_names(df), metadata.having_label(df, "a"), metadata.postings(df), Engine(spark, df).query_range("{}", 0, 20)):
        assert "HashAggregate" in plan(found) and "SortAggregate" not in plan(found)


def test_two_writers(spark, tmp_path):
    """A writer that finds its generation taken tries again: no append is lost, and a compaction keeps what came meanwhile."""
    s, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    row = lambda seq, pts: frame(spark, [({"__name__": "m"}, pts)]).withColumn("ingest_seq", F.lit(seq).cast("long"))
    advance, calls = s._advance, []

    def late(number, *state):
        calls.append(number)
        if len(calls) in (1, 4):
            other.append(row(9, [(100 * len(calls), 9)]))
        return advance(number, *state)

    s._advance = late
    s.append(row(1, [(1000, 1)]))
    assert points(s.read()) == [(100, 9), (1000, 1)] and calls == [1, 2]
    s.append(row(2, [(1000, 3)]))
    s.compact()
    assert points(s.read()) == [(100, 9), (400, 9), (1000, 3)] and len(s._generation()[1].folders) == 2
    s.drop_older(3 * HOUR)
    assert s.read().count() == 0
    s.clean(grace_ms=0)
    assert not list((tmp_path / "s").rglob("*.parquet")) and s.read().count() == 0


def test_order_inside_a_request(spark, tmp_path):
    """Of several hundred samples of one time the last written counts, across series of equal labels and requests."""
    part = lambda n, at: {"labels": [{"name": "__name__", "value": "m"}], "samples": [{"timestamp": 5, "value": at + i} for i in range(n)]}
    bodies = [json.dumps({"timeseries": [part(300, 0), part(4, 1000)]}), json.dumps({"timeseries": [part(200, 2000), part(1, 7)]})]
    engine = Engine(spark, store=Store(spark, str(tmp_path / "e")))
    engine.write(bodies[:1])
    assert [r.value for r in engine.query("m", 5).collect()] == [1003.0]
    engine.write(bodies[1:])
    assert [r.value for r in engine.query("m", 5).collect()] == [7.0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(bodies) + "\n")
    s = Store(spark, str(tmp_path / "s"))
    ingest(spark.readStream.format("text").load(str(tmp_path / "in")).withColumnRenamed("value", "body"), s, str(tmp_path / "c"), available_now=True).awaitTermination()
    assert points(s.read()) == [(5, 7)]


def test_levels(spark):
    df = spark.createDataFrame([(2 * HOUR,), (12 * HOUR,), (7 * 24 * HOUR,), (5 * HOUR,), (3 * HOUR,)], "span long")
    assert [r[0] for r in df.select(level(F.col("span"))).collect()] == [0, 1, 2, None, 0]


def test_compaction_windows():
    two = [(2 * HOUR * i, 2 * HOUR * i + HOUR) for i in range(7)]
    assert compaction_windows(two, 12 * HOUR) == [two[:6]]
    assert compaction_windows(two, 6 * HOUR) == [two[:3], two[3:6]]
    assert compaction_windows(two[::-1], 4 * HOUR) == [] and compaction_windows([], HOUR) == []


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(BODY) + "\n")
    s = Store(spark, str(tmp_path / "s"))
    stream = spark.readStream.format("text").load(str(tmp_path / "in")).withColumnRenamed("value", "body")
    for _ in range(2):  # the second finds nothing new
        ingest(stream, s, str(tmp_path / "c"), available_now=True).awaitTermination()
    assert points(s.read()) == [(1000, 1), (2000, 2), (3000, 3)]


@pytest.mark.parametrize("fn", AGGREGATES)
def test_empty(spark, fn):
    df = spark.createDataFrame([], SCHEMA).withColumn("series_key", F.lit("{}"))
    assert aggregate.aggregate(df, Aggregation(fn, 10)).count() == 0
