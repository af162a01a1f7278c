"""Column expressions over the canonical samples ``(series_key, labels, ts_ms, value, ingest_seq)``."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import EQ, NEQ, RE, Matcher, Query, Selector, java_pattern

#: The name of the source's own time, which a source may add to the canonical columns; bounds up to the year 9000 are put on it.
SOURCE_TIME = "source:time"
YEAR_9000 = 221_845_392_000_000


def series_key(labels: Column) -> Column:
    """``{a="1", b="2"}``, names in order, ``\\`` and ``"`` escaped: equal for equal label sets only."""
    quoted = lambda k: F.replace(F.replace(F.element_at(labels, k), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    parts = F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.concat(k, F.lit('="'), quoted(k), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def label(name: str, labels: Column | None = None) -> Column:
    """The label's value, null where it is missing."""
    return (F.col("labels") if labels is None else labels).getItem(name)


def promoted(name: str) -> str:
    """The name of a label's own column, which a source may add to the canonical ones."""
    return f"label:{name}"


def label_of(samples: DataFrame, name: str) -> Column:
    """The label's value from its own column, if there is one (predicates on it reach the files), else from the map."""
    return F.col(f"`{promoted(name)}`") if promoted(name) in samples.columns else label(name)


def matches(m: Matcher, value: Column | None = None) -> Column:
    value = label(m.name) if value is None else value
    if m.op == EQ:
        return value == m.value  # null, for a missing label, selects nothing
    if m.op == NEQ:
        return ~value.eqNullSafe(m.value)
    found = F.coalesce(value.rlike(java_pattern(m.value)), F.lit(False))
    return found if m.op == RE else ~found


def selected(selector: Selector, samples: DataFrame | None = None) -> Column:
    value = lambda name: label(name) if samples is None else label_of(samples, name)
    return functools.reduce(operator.and_, [matches(m, value(m.name)) for m in selector.matchers], F.lit(True))


def in_range(query: Query, ts: str = "ts_ms") -> Column:
    return F.lit(True) if query.unbounded else F.col(ts).between(query.start, query.end)


def near_range(samples: DataFrame, query: Query) -> Column:
    """A predicate on the source's own time, if there is one, that every sample of the range fulfils: it reaches the files, where one
    on ``ts_ms`` does not.  Times without zone get a day more on both sides, as the session's zone decides what they mean."""
    if SOURCE_TIME not in samples.columns or query.unbounded:
        return F.lit(True)
    kind = samples.schema[SOURCE_TIME].dataType.simpleString()
    if kind not in ("timestamp", "timestamp_ntz", "date"):
        return F.lit(True)
    margin = 0 if kind == "timestamp" else 86_400_000
    bound = lambda ms: F.timestamp_millis(F.lit(ms).cast("long")).cast(kind)
    out, time = F.lit(True), F.col(f"`{SOURCE_TIME}`")
    if abs(query.start) < YEAR_9000:
        out = out & (time >= bound(query.start - margin))
    if abs(query.end) < YEAR_9000:
        out = out & (time < bound(query.end + margin + (1 if margin == 0 else 86_400_000)))
    return out


def bucket(step: int, ts: str = "ts_ms") -> Column:
    """The start of the step, from the epoch; the division truncates towards zero."""
    return F.expr(f"({ts} div {int(step)}L) * {int(step)}L")


def rendered(value: Column) -> Column:
    """A value with six decimals; infinities with their sign."""
    return F.when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").when(F.isnan(value), "NaN").otherwise(F.format_string("%f", value))
