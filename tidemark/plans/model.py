"""Matchers, selectors and query descriptions, checked on the driver before any plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

EQ, NEQ, RE, NRE = "=", "!=", "=~", "!~"
AGGREGATES = ("sum", "avg", "max", "min", "count", "stddev", "stdvar")


class QueryError(ValueError):
    """A query that says nothing meaningful."""


def java_pattern(pattern: str) -> str:
    """A pattern of the RE2 dialect as Java has it; what RE2 has not (look-around, back-references) is an error."""
    if re.search(r"\(\?(?:=|!|<=|<!|>)|(?<!\\)(?:\\\\)*\\[1-9]|[*+?}]\+", pattern):
        raise QueryError(f"look-around, back-references and possessive quantifiers are not supported: {pattern!r}")
    java = re.sub(r"\(\?P<", "(?<", pattern)
    try:
        re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", re.sub(r"\\[pP](?:\{\^?\w+\}|\w)|\\[zQE]", ".", java)))
    except re.error as why:
        raise QueryError(f"invalid regular expression {pattern!r}: {why}") from None
    return java


@dataclass(frozen=True)
class Matcher:
    """``name op "value"``.  A missing label equals nothing and matches no pattern, so ``!=`` and ``!~`` hold for it; the empty string
    is a value like others.  Patterns are searched for anywhere in the value."""

    op: str
    name: str
    value: str

    def __post_init__(self) -> None:
        if self.op not in (EQ, NEQ, RE, NRE):
            raise QueryError(f"unknown operator {self.op!r}")
        if not self.name:
            raise QueryError("a matcher needs a label name")
        if self.op in (RE, NRE):
            if not self.value:
                raise QueryError("a pattern must not be empty")
            java_pattern(self.value)

    def holds(self, value: str | None) -> bool:
        """For a single value; None: the label is missing."""
        if value is None:
            return self.op in (NEQ, NRE)
        if self.op in (EQ, NEQ):
            return (value == self.value) == (self.op == EQ)
        return bool(re.search(self.value, value)) == (self.op == RE)

    def __str__(self) -> str:
        return f'{self.name}{self.op}"{escape(self.value)}"'


def escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"')


@dataclass(frozen=True)
class Selector:
    """All matchers must hold; none: everything is selected."""

    matchers: tuple[Matcher, ...] = ()

    def holds(self, labels: dict[str, str]) -> bool:
        return all(m.holds(labels.get(m.name)) for m in self.matchers)

    def validate(self) -> Selector:
        """The strict form: at least one matcher and no label twice."""
        names = [m.name for m in self.matchers]
        if not names:
            raise QueryError("at least one matcher is needed")
        if len(set(names)) < len(names):
            raise QueryError("a label name occurs twice")
        return self

    @property
    def metric(self) -> str | None:
        """The metric that every selected series has, if the selector says so."""
        return next((m.value for m in self.matchers if m.name == "__name__" and m.op == EQ), None)

    def __str__(self) -> str:
        return "{" + ", ".join(map(str, self.matchers)) + "}"


@dataclass(frozen=True)
class Query:
    """Samples of the selected series from ``start`` to ``end`` ms, both included; (0, 0): of all times."""

    selector: Selector = field(default_factory=Selector)
    start: int = 0
    end: int = 0
    step: int = 0

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise QueryError("the range ends before it starts")
        if self.step < 0:
            raise QueryError("a step must not be negative")

    @property
    def unbounded(self) -> bool:
        return self.start == 0 and self.end == 0


@dataclass(frozen=True)
class Aggregation:
    """``fn`` of each group and step.  ``by`` keeps these labels, else ``without`` drops these; neither: one group."""

    fn: str
    step: int
    by: tuple[str, ...] = ()
    without: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.fn not in AGGREGATES:
            raise QueryError(f"unknown aggregate {self.fn!r}")
        if self.step <= 0:
            raise QueryError("a step must be positive")
