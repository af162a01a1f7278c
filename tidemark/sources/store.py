"""The sample store: Parquet, partitioned by metric and time block.

Writes append.  Compaction rewrites the blocks of a window to one longer block and leaves all others alone, retention drops blocks;
every change is one small file, ``_generations/<n>``, which lists the folders that count and the blocks in them, so a reader sees
either state and never a part of one.  Of two writers of a generation the second tries again on what the first has made.  ``clean``
deletes what no longer counts.  The list has an entry for each block of each append, not for each file, series or sample."""

from __future__ import annotations

import functools
import json
import operator
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import label

HOUR = 3_600_000
#: The spans of compaction levels, and how far a block's span may be from its level's.
LEVELS = {0: 2 * HOUR, 1: 12 * HOUR, 2: 7 * 24 * HOUR}
TOLERANCE = HOUR
RETENTION = 30 * 24 * HOUR
_SCHEMA = "series_key string, labels map<string,string>, ts_ms long, value double, ingest_seq long, metric string, block_ms long, block_start long"


def level(span: Column) -> Column:
    """The compaction level of a block by its span in ms; null if it has none."""
    out = F.lit(None).cast("int")
    for n, size in LEVELS.items():
        out = F.when(F.abs(span - size) <= TOLERANCE, F.lit(n)).otherwise(out)
    return out


def level_of(length: int) -> int:
    """The level of a stored block: the last one whose span it was written for."""
    return max((n for n, size in LEVELS.items() if length >= size), default=0)


def blocks(samples: DataFrame, length: int = LEVELS[0]) -> DataFrame:
    """``block_start``, first and last time, samples and series of each block of samples."""
    start = F.expr(f"floor(ts_ms / {length}) * {length}").cast("long")
    each = samples.groupBy(start.alias("block_start"), "series_key").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"), F.count("*").alias("n"))
    return each.groupBy("block_start").agg(F.min("a").alias("min_ts_ms"), F.max("b").alias("max_ts_ms"), F.sum("n").alias("n_samples"), F.count("*").alias("n_series"))


def expired(blocks: DataFrame, now: int, max_age: int = RETENTION) -> DataFrame:
    """Blocks of which every sample is older than ``max_age``."""
    return blocks.where(F.col("max_ts_ms") < now - max_age)


def retention_report(blocks: DataFrame, now: int, max_age: int = RETENTION) -> DataFrame:
    old = F.col("max_ts_ms") < now - max_age
    return blocks.agg(
        F.count("*").alias("n_blocks"),
        F.count_if(old).alias("n_expired"),
        F.coalesce(F.sum(F.when(old, F.col("n_samples"))), F.lit(0)).alias("n_samples_expired"),
        (F.lit(now) - F.min("min_ts_ms")).alias("oldest_age_ms"),
        (F.lit(now) - F.max("max_ts_ms")).alias("newest_age_ms"),
    )


def compaction_windows(spans: list[tuple[int, int]], duration: int, least: int = 3) -> list[list[tuple[int, int]]]:
    """Blocks (first and last time) to compact together: a window opens at a block and closes at the first one that starts
    ``duration`` or more later; windows of fewer than ``least`` blocks wait.  Spans of blocks are metadata, some thousands at most."""
    windows: list[list[tuple[int, int]]] = []
    for span in sorted(spans):
        if not windows or span[0] >= windows[-1][0][0] + duration:
            windows.append([])
        windows[-1].append(span)
    return [w for w in windows if len(w) >= least]


@dataclass(frozen=True)
class Retention:
    """Blocks of which every sample is older than ``max_age`` ms go, while it is ``enabled``."""

    max_age: int = RETENTION
    enabled: bool = True


@dataclass(frozen=True, order=True)
class Block:
    """A block of a folder: the time it is for, and the first and last time and the number of its samples."""

    start: int
    length: int
    first: int
    last: int
    n: int
    run: str

    @property
    def key(self) -> tuple[str, int, int]:
        return self.run, self.length, self.start


@dataclass(frozen=True)
class State:
    """What counts: folders, the blocks in them, and the blocks of these folders that do not count any more."""

    folders: frozenset[str] = frozenset()
    blocks: frozenset[Block] = frozenset()
    gone: frozenset[tuple[str, int, int]] = frozenset()

    def without(self, dropped: set[Block] | frozenset[Block]) -> State:
        """Folders of which no block is left go whole."""
        left = self.blocks - dropped
        emptied = {b.run for b in dropped} - {b.run for b in left}
        gone = self.gone | {b.key for b in dropped}
        return State(self.folders - emptied, left, frozenset(x for x in gone if x[0] not in emptied))

    def with_run(self, run: str, found: set[Block]) -> State:
        return State(self.folders | {run}, self.blocks | found, self.gone) if found else self


class Store:
    def __init__(self, spark: SparkSession, folder: str, block_ms: int = LEVELS[0], policy: Retention = Retention()):
        self.spark, self.folder, self.block_ms, self.policy = spark, folder.rstrip("/"), block_ms, policy
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *x: path("/".join([self.folder, *x]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _generation(self) -> tuple[int, State]:
        """Number and state of the latest generation."""
        at = self._path("_generations")
        numbers = [int(x.getPath().getName()) for x in self._fs.listStatus(at) if x.getPath().getName().isdigit()] if self._fs.exists(at) else []
        if not numbers:
            return 0, State()
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/_generations/{max(numbers)}", wholetext=True).collect()))
        return max(numbers), State(frozenset(found["folders"]), frozenset(Block(*x) for x in found["blocks"]), frozenset(tuple(x) for x in found["gone"]))

    def _advance(self, number: int, state: State) -> bool:
        """Make generation ``number``; False if someone else has.  The file is renamed without overwriting, as streams commit theirs."""
        jvm, staged = self.spark._jvm, self._path("_generations", f".{number}-{uuid.uuid4().hex}")
        listed = [[b.start, b.length, b.first, b.last, b.n, b.run] for b in sorted(state.blocks)]
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps({"folders": sorted(state.folders), "blocks": listed, "gone": sorted(state.gone)}).encode()))
        out.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, self._path("_generations", str(number)), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(staged, False)
            return False
        return True

    def _change(self, change: Callable[[State], State | None]) -> bool:
        """Make what ``change`` says of the latest state; of a later generation, if another writer was first."""
        while True:
            number, state = self._generation()
            changed = change(state)
            if changed is None or changed == state:
                return False
            if self._advance(number + 1, changed):
                return True

    def append(self, samples: DataFrame) -> None:
        """Add samples, each block's sorted by series and time; what is there stays as it is."""
        start = F.expr(f"floor(ts_ms / {self.block_ms}) * {self.block_ms}").cast("long")
        run, found = self._write(samples.withColumn("block_ms", F.lit(self.block_ms).cast("long")).withColumn("block_start", start))
        self._change(lambda state: state.with_run(run, found))

    def _write(self, samples: DataFrame) -> tuple[str, set[Block]]:
        run = f"run={uuid.uuid4().hex}"
        metric = F.coalesce(label("__name__"), F.lit(""))
        rows = samples.select("series_key", "labels", "ts_ms", "value", F.col("ingest_seq").cast("long"), metric.alias("metric"), "block_ms", "block_start")
        # a third of all samples may be of one metric and block: series keep a block's files apart
        spread = rows.repartition("metric", "block_start", F.pmod(F.xxhash64("series_key"), F.lit(16)))
        spread.sortWithinPartitions("metric", "block_start", "series_key", "ts_ms").write.partitionBy("metric", "block_ms", "block_start").parquet(f"{self.folder}/{run}")
        return run, {Block(r.block_start, r.block_ms, r.a, r.b, r.n, run) for r in self._spans([run]).collect()}

    def _rows(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"{_SCHEMA}, run string")
        return self.spark.read.schema(f"{_SCHEMA}, run string").option("basePath", self.folder).parquet(*[f"{self.folder}/{x}" for x in runs])

    def _spans(self, runs: list[str]) -> DataFrame:
        """First and last time and number of samples of each block of the folders: one column is read."""
        each = self._rows(runs).groupBy("run", "block_ms", "block_start")
        return each.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"), F.count("*").alias("n"))

    def read(self) -> DataFrame:
        """The samples that count.  ``metric``, ``block_ms`` and ``block_start`` are partitions: predicates on them list files only."""
        state = self._generation()[1]
        return self._rows(sorted(state.folders)).where(~self._among(state.gone)).drop("run")

    @staticmethod
    def _among(keys: Iterable[tuple[str, int, int]]) -> Column:
        """Whether a row is of one of the blocks: a predicate on partitions alone."""
        starts: dict[tuple[str, int], list[int]] = {}
        for run, length, start in sorted(keys):
            starts.setdefault((run.removeprefix("run="), length), []).append(start)
        each = [(F.col("run") == run) & (F.col("block_ms") == length) & F.col("block_start").isin(found) for (run, length), found in starts.items()]
        return functools.reduce(operator.or_, each, F.lit(False))

    def blocks(self) -> DataFrame:
        """The blocks that count, from the list of the generation; no data are read."""
        found = [(b.run, b.start, b.length, level_of(b.length), b.first, b.last, b.n) for b in sorted(self._generation()[1].blocks)]
        return self.spark.createDataFrame(found, "run string, block_start long, block_ms long, level int, min_ts_ms long, max_ts_ms long, n_samples long")

    def due(self, least: int = 3) -> list[tuple[int, list[Block]]]:
        """What compaction would do now: the next level and the blocks, ``least`` or more of a level in a window of the next."""
        out = []
        for n, longer in list(LEVELS.items())[1:]:
            members: dict[tuple[int, int], list[Block]] = {}
            for b in self._generation()[1].blocks:
                if level_of(b.length) == n - 1:
                    members.setdefault((b.start, b.start + b.length), []).append(b)
            spans = [span for span, found in members.items() for _ in found]
            for window in compaction_windows(spans, longer, least):
                out.append((n, [b for span in sorted(set(window)) for b in members[span]]))
        return out

    def compact(self, least: int = 3) -> int:
        """Level by level, ``least`` or more blocks in a window of the next level become one block of that, with the last written value
        of each series and time; other blocks are neither read nor written, and what is appended meanwhile stays as it is.  The
        number of blocks made."""
        made = 0
        for n in list(LEVELS)[1:]:  # blocks made of one level may be due for the next
            made += sum(self._merge(window, LEVELS[n]) for to, window in self.due(least) if to == n)
        return made

    def _merge(self, members: list[Block], length: int) -> bool:
        start = min(b.start for b in members)
        length = max(length, max(b.start + b.length for b in members) - start)
        runs = sorted({b.run for b in members})
        every = self._rows(runs).where(self._among(b.key for b in members))
        names = every.groupBy("series_key").agg(F.first("labels").alias("labels"))
        last = every.groupBy("series_key", "ts_ms").agg(F.max_by("value", "ingest_seq").alias("value"), F.max("ingest_seq").alias("ingest_seq"))
        run, found = self._write(last.join(names, "series_key").withColumn("block_ms", F.lit(length).cast("long")).withColumn("block_start", F.lit(start).cast("long")))
        # another compaction or retention had one of the blocks first: this one's work counts for nothing
        return self._change(lambda state: state.without(set(members)).with_run(run, found) if set(members) <= state.blocks else None)

    def drop_older(self, cutoff: int) -> int:
        """Drop the blocks of which every sample is before ``cutoff``, and say how many; no data are read or written."""
        dropped: list[int] = []

        def drop(state: State) -> State:
            old = {b for b in state.blocks if b.last < cutoff}
            dropped.append(len(old))
            return state.without(old)

        self._change(drop)
        return dropped[-1]

    def retain(self, now: int | None = None) -> int:
        """Drop what the policy says; nothing while it is not enabled."""
        now = time.time_ns() // 1_000_000 if now is None else now
        return self.drop_older(now - self.policy.max_age) if self.policy.enabled else 0

    def stats(self) -> DataFrame:
        """Blocks, samples and the time they span, of each level."""
        each = self.blocks().groupBy("level")
        return each.agg(F.count("*").alias("n_blocks"), F.sum("n_samples").alias("n_samples"), F.min("min_ts_ms").alias("min_ts_ms"), F.max("max_ts_ms").alias("max_ts_ms"))

    def validate(self) -> DataFrame:
        """The blocks whose files do not hold what the list says (none, if all is well), with the number of samples found."""
        state = self._generation()[1]
        found = self._spans(sorted(state.folders)).where(~self._among(state.gone)).withColumn("run", F.concat(F.lit("run="), "run"))
        both = self.blocks().join(found, ["run", "block_ms", "block_start"], "full")
        same = F.col("min_ts_ms").eqNullSafe(F.col("a")) & F.col("max_ts_ms").eqNullSafe(F.col("b")) & F.col("n_samples").eqNullSafe(F.col("n"))
        return both.where(~same).select("run", "block_ms", "block_start", "n_samples", F.coalesce("n", F.lit(0)).alias("n_found"))

    def clean(self, grace_ms: int = 24 * HOUR) -> None:
        """Delete the blocks that do not count, once no reader of an earlier generation is left, and folders that no generation lists and
        that are older than ``grace_ms``: younger ones may be a writer's that is still at work."""
        state = self._generation()[1]
        before = time.time_ns() // 1_000_000 - grace_ms
        for x in self._fs.listStatus(self._path()) if self._fs.exists(self._path()) else []:
            name = x.getPath().getName()
            if name.startswith("run=") and name not in state.folders and x.getModificationTime() <= before:
                self._fs.delete(x.getPath(), True)
        for run, length, start in state.gone:
            for x in self._fs.globStatus(self._path(run, "metric=*", f"block_ms={length}", f"block_start={start}")) or []:
                self._fs.delete(x.getPath(), True)
        self._change(lambda later: State(later.folders, later.blocks, later.gone - state.gone))
