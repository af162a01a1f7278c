"""PII: format-preserving Feistel pseudonyms, with DataFrame functions only.

Values are found by one pattern, validated, and replaced by a keyed permutation of the values of their kind, so that equal
values get equal pseudonyms in every document, different values different ones, and a pseudonym is again a valid value:

* card numbers (13 to 19 digits that pass the Luhn test): the payload is permuted, the check digit made anew;
* phone numbers (international with 8 to 15 digits, or with an area code): the digits after the country code, however they are
  set apart, so that a number is linked with and without its code;
* social security numbers: permuted among the valid ones;
* dates (yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy; 1900 to 2099): permuted among the days of these years;
* IPv4 addresses (octets up to 255): permuted among all addresses;
* e-mail addresses: letters among letters and digits among digits of the part before the "@", in lower case.

Blanks and marks inside a number stay where they are and do not matter for its value.  A number does not run into the value that
follows after a blank, and card numbers are found among other groups of digits.  Where numbers of a country differ in length,
a plain group of digits that follows after a blank counts as the phone number's own.  What looks alike and is not valid stays as
it is.  Each of ``ROUNDS`` double rounds adds to either half a number that SHA-256 makes of key, kind, round and other half.

The key is that given, or else the session's ``spark.tidemark.pii.key``; without either a known one, for tests.  It is a literal of
the plan: give one derived for the data set, not a master secret.  A null text stays null, an empty
text empty; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of tests and of sessions that name none: anyone can undo its pseudonyms.
KEY = "tidemark"
KEY_CONF = "spark.tidemark.pii.key"
ROUNDS = 4

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])"
_NATIONAL = r"(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Card numbers as they are printed.
_PRINTED = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})"
#: Values that a number does not run into over a blank.
_NEXT = "|".join(f"(?:{x})" for x in (_EMAIL, _IP, _DATE, _NATIONAL, _SSN))
_DIGIT = r"[ .()-]{0,2}[0-9]"
#: 8 to 15 digits, written out as a look-behind needs it.
_E164 = _DIGIT * 8 + f"(?:{_DIGIT}" * 7 + ")?" * 7
#: Countries whose numbers all have as many digits: what follows them over a blank is another number.
_PLANS = {"1": 10, "7": 10, "33": 9, "34": 9, "45": 8, "48": 9, "91": 10}
_WHOLE = "|".join(code + _DIGIT * n for code, n in _PLANS.items())
_GROUPS = rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{1,5}}(?:(?:[.-]| (?!(?<=\+{_E164} )(?:{_NEXT}|{_PRINTED}(?![0-9]))))?[0-9]{{2,5}}){{1,4}}"
_KINDS = {
    "email": _EMAIL,
    "ip": _IP,
    "date": _DATE,
    "phone": rf"(?<![0-9A-Za-z+])(?:{_GROUPS}(?<=\+(?:{_WHOLE}))(?![0-9-])|{_GROUPS}(?<=\+{_E164})(?![0-9-])|{_NATIONAL})",
    "ssn": _SSN,
    "card": rf"(?<![0-9])[0-9](?:(?:-| (?!{_NEXT}))?[0-9]){{12,}}+",
}
PATTERN = "|".join(f"(?:{x})" for x in _KINDS.values())
_DATES = (("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy"))
_DAYS = (17, 4297)  # 17 * 4297 = 73,049 days from the first of 1900 to the last of 2099
#: Numbers of areas (001 to 899 but 666), groups (01 to 99) and serials (0001 to 9999) of social security numbers.
_AREAS, _SSN_GROUPS, _SERIALS = 898, 99, 9999
#: The country codes of fewer than three digits, by the international numbering plan.
_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _draw(key: str, *parts: Column | str) -> Column:
    """60 bits of the hash of key and parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column | int, b: Column | int, tweak: Column | str = "") -> Column:
    """A permutation of the pairs of 0 <= left < a and 0 <= right < b, as a struct of both."""
    lit = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x

    def step(pair: Column, i: Column) -> Column:
        new = F.pmod(pair["l"] + F.pmod(_draw(key, kind, tweak, "l", i, pair["r"]), lit(a)), lit(a))
        return F.struct(new.alias("l"), F.pmod(pair["r"] + F.pmod(_draw(key, kind, tweak, "r", i, new), lit(b)), lit(b)).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the strings of as many digits (2 to 36)."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10), k).cast("long")
    pair = feistel(key, kind, F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long"), ten(half), ten(n - half), n)
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), n - half, F.lit("0"))))


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum; ``doubled`` 0 if the last digit counts twice, 1 if the last but one does."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _written(like: Column, digits: Column) -> Column:
    """``digits`` with the blanks and marks of ``like``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def add(x: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(x["s"], F.when(digit, F.substring(digits, x["k"], F.lit(1))).otherwise(c)).alias("s"), (x["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(like, ""), start, add, lambda x: x["s"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(key: str, value: Column) -> Column:
    """The card numbers in a run of digit groups, and how many there are.  From each group on the longest valid one counts: as
    cards are printed, or, where the run or what is left of it begins, in any groups (the longest; a shorter one without
    single digits)."""

    def made(v: Column) -> Column:
        def of(d: Column) -> Column:
            payload = permuted_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
            return _written(v, _let(payload, lambda p: F.concat(p, ((10 - _luhn(p, 0) % 10) % 10).cast("string"))))

        return _let(_digits(v), of)

    def taken(groups: Column) -> Column:
        n = F.size(groups)

        def windows(i: Column) -> Column:
            text = lambda k: F.regexp_replace(F.array_join(F.slice(groups, i, k), ""), "^[ -]", "")
            every = F.transform(F.sequence(F.least(F.lit(19), n - i + 1), F.lit(1), F.lit(-1)), lambda k: F.struct(k.alias("k"), text(k).alias("v")))
            return F.filter(every, lambda w: F.length(_digits(w["v"])) <= 19)

        def step(x: Column, i: Column) -> Column:
            def choose(ws: Column) -> Column:
                longest = F.get(ws, F.lit(0))["k"]
                begins = i == x["begin"]

                def valid(w: Column) -> Column:
                    shape = w["v"].rlike(f"^{_PRINTED}$") | (begins & ((w["k"] == longest) | ~w["v"].rlike("(?:^|[ -])[0-9](?:[ -]|$)")))
                    return (F.length(_digits(w["v"])) >= 13) & shape & (_luhn(_digits(w["v"]), 1) % 10 == 0)

                def after(w: Column) -> Column:
                    end = i + w["k"]
                    one = F.struct(x["end"].alias("from"), i.alias("at"), made(w["v"]).alias("v"))
                    none = F.struct((i + 1).alias("next"), F.when(begins, i + F.coalesce(longest, F.lit(1))).otherwise(x["begin"]).alias("begin"), x["end"].alias("end"), x["taken"].alias("taken"))
                    return F.when(w.isNull(), none).otherwise(F.struct(end.alias("next"), end.alias("begin"), end.alias("end"), F.concat(x["taken"], F.array(one)).alias("taken")))

                return _let(F.get(F.filter(ws, valid), F.lit(0)), after)

            return F.when(i < x["next"], x).otherwise(_let(windows(i), choose))

        start = F.struct(*[F.lit(1).alias(c) for c in ("next", "begin", "end")], F.array().cast("array<struct<from:int,at:int,v:string>>").alias("taken"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step)

    def shown(groups: Column) -> Column:
        part = lambda a, b: F.array_join(F.slice(groups, a, b - a), "")

        def of(x: Column) -> Column:
            changed = F.transform(x["taken"], lambda t: F.concat(part(t["from"], t["at"]), F.regexp_extract(F.element_at(groups, t["at"]), "^[ -]?", 0), t["v"]))
            text = F.concat(F.array_join(changed, ""), part(x["end"], F.size(groups) + 1))
            return F.struct(F.when(F.size(x["taken"]) > 0, text).alias("value"), F.size(x["taken"]).alias("n"))

        return _let(taken(groups), of)

    return _let(F.split(value, "(?=[ -])"), shown)


def _phone(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        kept = F.when(value.startswith("+"), F.length(F.regexp_extract(d, f"^(?:{_CODES}|[0-9]{{3}})", 0))).otherwise(0)
        rest = F.substring(d, kept + 1, F.length(d) - kept)
        return F.when(F.length(d).between(8, 15), _written(value, F.concat(F.substring(d, F.lit(1), kept), permuted_digits(key, "phone", rest))))

    return _let(_digits(value), of)


def _ssn(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        number = lambda a, n: F.substring(d, F.lit(a), F.lit(n)).cast("int")
        area = number(1, 3)
        left = (area - F.when(area > 666, 2).otherwise(1)) * _SSN_GROUPS + number(4, 2) - 1
        pair = feistel(key, "ssn", left, number(6, 4) - 1, _AREAS * _SSN_GROUPS, _SERIALS)

        def shown(p: Column) -> Column:
            i = F.floor(p["l"] / _SSN_GROUPS)
            padded = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
            return _written(value, F.concat(padded(i + F.when(i >= 665, 2).otherwise(1), 3), padded(p["l"] % _SSN_GROUPS + 1, 2), padded(p["r"] + 1, 4)))

        return F.when(~d.rlike("^(?:000|666|9)|^...00|0000$"), _let(pair, shown))

    return _let(_digits(value), of)


def _ip(key: str, value: Column) -> Column:
    def of(o: Column) -> Column:
        octet = lambda i: F.element_at(o, i).cast("long")
        pair = feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 1 << 16, 1 << 16)
        parts = lambda p: [F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256]
        return F.when(~F.exists(o, lambda x: x.cast("int") > 255), _let(pair, lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in parts(p)])))

    return _let(F.split(value, r"\."), of)


def _date(key: str, value: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")
    a, b = _DAYS

    def in_format(form: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(form))), first)
        pair = lambda d: feistel(key, "date", F.floor(d / b), d % b, a, b)
        return _let(day, lambda d: F.when(d.between(0, a * b - 1), _let(pair(d), lambda p: F.date_format(F.date_add(first, (p["l"] * b + p["r"]).cast("int")), form))))

    out = F.lit(None).cast("string")
    for mark, form in _DATES:
        out = F.when(value.contains(mark), in_format(form)).otherwise(out)
    return out


def _email(key: str, value: Column) -> Column:
    def shifted(x: Column, other: Column, i: Column, side: str) -> Column:
        def at(k: Column) -> Column:
            c = F.substring(x, k, F.lit(1))
            by = _draw(key, "email", side, i, k, other)
            low = F.when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[0-9]$"), 48)
            size = F.when(low == 97, 26).otherwise(10)
            return F.coalesce(F.char(low + (F.ascii(c) - low + F.pmod(by, size.cast("long"))) % size), c)

        return F.when(F.length(x) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), at), "")).otherwise("")

    def of(local: Column) -> Column:
        n = F.length(local)
        half = (n / 2).cast("int")

        def step(p: Column, i: Column) -> Column:
            return _let(shifted(p["l"], p["r"], i, "l"), lambda new: F.struct(new.alias("l"), shifted(p["r"], new, i, "r").alias("r")))

        start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, n - half).alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda p: F.concat(p["l"], p["r"]))

    at = F.instr(value, "@")
    return F.concat(_let(F.lower(F.substring(value, F.lit(1), at - 1)), of), F.lower(F.substring(value, at, F.length(value))))


def pseudonym(key: str, value: Column) -> Column:
    """Kind, pseudonym (null if it is not valid) and number of values of a string that the pattern has found."""
    kinds = {
        "email": (value.contains("@"), _email),
        "ip": (value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), _ip),
        "date": (value.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1[0-9]{4})$"), _date),
        "ssn": (value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn),
        "phone": (value.rlike(r"^(?:\+|\(|[0-9]{3}-[0-9]{3}-[0-9]{4}$)"), _phone),
        "card": (F.lit(True), _card),
    }
    kind, out = F.lit(None).cast("string"), F.lit(None).cast("struct<value:string,n:int>")
    for name, (test, make) in reversed(kinds.items()):
        new = make(key, value) if name == "card" else F.struct(make(key, value).alias("value"), F.lit(1).alias("n"))
        kind, out = F.when(test, F.lit(name)).otherwise(kind), F.when(test, new).otherwise(out)
    return _let(out, lambda x: F.struct(kind.alias("kind"), x["value"].alias("value"), x["n"].alias("n")))


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str | None = None, counts: str | None = None, n_chars: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``.  ``counts``: the name of a further column with the replaced values by kind (map of
    string to int); ``n_chars``: a column to which the change of length is added."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    mark = uuid.uuid4().hex
    found, between, made = f"found_{mark}", f"between_{mark}", f"made_{mark}"
    plain = F.col(text)
    some = plain.rlike("[0-9@]")
    out = docs.withColumns({found: F.when(some, F.regexp_extract_all(plain, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))})
    out = out.withColumns({between: F.when(F.size(found) > 0, F.split(plain, PATTERN, -1)), made: F.transform(found, lambda x: pseudonym(key, x))})
    shown = F.concat(F.zip_with(found, made, lambda x, y: F.coalesce(y["value"], x)), F.array(F.lit("")))
    changed = F.when(F.size(found) > 0, F.array_join(F.zip_with(between, shown, lambda x, y: F.concat(x, y)), "")).otherwise(plain)
    new = f"new_{mark}"
    out = out.withColumns({new: changed})
    columns = {text: F.col(new)}
    if n_chars:
        columns[n_chars] = (F.col(n_chars) + F.coalesce(F.length(new) - F.length(text), F.lit(0))).cast(docs.schema[n_chars].dataType)
    if counts:
        valid = F.filter(made, lambda x: x["value"].isNotNull())
        number = lambda k: F.aggregate(F.filter(valid, lambda x: x["kind"] == k), F.lit(0), lambda n, x: n + x["n"])
        columns[counts] = F.map_from_entries(F.transform(F.array_distinct(F.transform(valid, lambda x: x["kind"])), lambda k: F.struct(k, number(k))))
    return out.withColumns(columns).drop(found, between, made, new)
