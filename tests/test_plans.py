import pytest

from tidemark.engine import duration, moment
from tidemark.plans.model import Aggregation, Matcher, Query, QueryError, Selector, java_pattern
from tidemark.plans.selector import parse


#: A missing label equals nothing and no pattern finds it, so the two negations hold for it.
@pytest.mark.parametrize("value,equal,found", [("grün", True, True), ("grün-2", False, True), ("GRÜN", False, False), ("", False, False), (None, False, False)])
def test_matchers(value, equal, found):
    labels = {"zone": "b"} if value is None else {"farbe": value}
    holds = {op: Selector((Matcher(op, "farbe", x),)).holds(labels) for op, x in (("=", "grün"), ("!=", "grün"), ("=~", "^gr.n"), ("!~", "^gr.n"))}
    assert holds == {"=": equal, "!=": not equal, "=~": found, "!~": not found}


@pytest.mark.parametrize("text,expected", [('{zone="b",farbe=~"r"}', True), ('{zone="b",farbe!~"r"}', False), ('{zone!="b"}', False), ('{zone=~"^.$",ort!="x"}', True), ("{}", True)])
def test_all_matchers_must_hold(text, expected):
    assert parse(text).holds({"zone": "b", "farbe": "rot"}) is expected


@pytest.mark.parametrize("op,name,value", [("=", "", "x"), ("=~", "a", ""), ("=~", "a", "["), ("~", "a", "x"), ("=~", "a", "(?=x)"), ("=~", "a", r"(x)\1")])
def test_invalid_matchers(op, name, value):
    with pytest.raises(QueryError):
        Matcher(op, name, value)


@pytest.mark.parametrize("text,n", [('{__name__="cpu_usage"}', 1), ('{__name__="cpu_usage",host="server1"}', 2), ("{}", 0), ('{host!="server1"}', 1), ("cpu_usage", 1), ('cpu{a="x, y=~{z}\\"", b!~"d"}', 3)])
def test_selectors(text, n):
    assert len(parse(text).matchers) == n
    assert parse(str(parse(text))) == parse(text)


@pytest.mark.parametrize("text", ["", '{__name__="cpu_usage"', "{a=b}", '{a="b" c="d"}', "a b", '}{'])
def test_invalid_selectors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_checks():
    for bad in (lambda: Query(Selector(), 2, 1), lambda: Aggregation("median", 1), lambda: Aggregation("sum", 0), lambda: Selector().validate(), lambda: parse('{a="1",a="2"}').validate()):
        with pytest.raises(QueryError):
            bad()
    assert java_pattern("(?P<a>x)") == "(?<a>x)"
    assert Query(Selector()).unbounded


def test_times():
    assert duration("1h30m") == 5_400_000 and duration("7d") == 604_800_000
    assert moment("-1h", now=7_200_000) == 3_600_000 and moment("now", now=5) == 5 and moment("12") == 12
    assert moment("1970-01-02") == 86_400_000 and moment("1970-01-01T00:00:01Z") == 1000
    for bad in ("1x", ""):
        with pytest.raises(QueryError):
            duration(bad)
