"""Texts of times as instants: column expressions only, whole-stage generated code, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of zones and their minutes from UTC. An abbreviation with several lines is ambiguous.
ZONES = {
    "Z": [0],
    "UTC": [0],
    "GMT": [0],
    "WET": [0],
    "WEST": [60],
    "BST": [60],
    "CET": [60],
    "CEST": [120],
    "EET": [120],
    "EEST": [180],
    "MSK": [180],
    "IST": [330],
    "JST": [540],
    "AWST": [480],
    "AEST": [600],
    "AEDT": [660],
    "NZST": [720],
    "NZDT": [780],
    "NST": [-210],
    "NDT": [-150],
    "AST": [-240],
    "ADT": [-180],
    "BRT": [-180],
    "EST": [-300],
    "EDT": [-240],
    "CST": [-360],
    "CDT": [-300],
    "MST": [-420],
    "MDT": [-360],
    "PST": [-480],
    "PDT": [-420],
}
MARK = "\x01"
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"

_ZONE = r"(Z|[A-Z]{2,4}|(?:UTC|GMT)?[+-]\d{1,2}:?(?:\d{2})?)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: Form -> (pattern, order of year|month|day|hour|minute|second|fraction|zone|half).
FORMS = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]{_CLOCK} ?{_ZONE}?)?$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}}){_ZONE}?$", "$1|$2|$3|$4|$5|$6||$7|"),
    "slash_mdy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK} ?([AP]M)?(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    "slash_dmy": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK} ?([AP]M)?(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
    "dot_dmy": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK} ?([AP]M)?(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
    "dot_mdy": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK} ?([AP]M)?(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    "mail": (rf"^(?:[A-Z]{{3,9}},? )?(\d{{1,2}})[ -]([A-Z]{{3}})[A-Z]{{0,6}}\.?[ -](\d{{4}}),? {_CLOCK} ?([AP]M)?(?: ?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
    "long_us": (rf"^([A-Z]{{3}})[A-Z]{{0,6}}\.? (\d{{1,2}}), (\d{{4}}),?(?: at)? {_CLOCK} ?([AP]M)?(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
}
#: What TESTDATA fixes: slashes put the month first, dots the day.
CONVENTION = ("iso", "basic", "slash_mdy", "dot_dmy", "mail", "long_us")
EPOCHS = {"epoch_s": 1000, "epoch_ms": 1, "epoch_us": -1000, "epoch_ns": -1000000}
EARLIEST_MS, LATEST_MS = 631152000000, 4102444800000  # 1990 to 2100: an epoch number outside isn't read as one


def one_reading(forms) -> bool:
    """Whether no text has two readings under forms: only forms of one pattern share texts, and units of epochs none."""
    return len({FORMS[f][0] for f in forms}) == len(forms)


def clean(c: Column) -> Column:
    """Upper case, any blanks as one space, none at the ends."""
    return F.upper(F.trim(F.regexp_replace(c, r"[\s ​﻿]+", " ")))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(s: Column, form: str) -> Column:
    """The cleaned text s as year|month|day|hour|minute|second|fraction|zone|half behind a mark; without the mark if it isn't of the form."""
    pattern, order = FORMS[form]
    return F.regexp_replace(s, pattern, MARK + order)


def _offset(z: Column) -> Column:
    """Minutes from UTC of a zone text; null if unknown."""
    z = F.regexp_replace(z, "^(UTC|GMT)(?=[+-])", "")
    digits = F.rpad(F.regexp_replace(z, "[^0-9]", ""), 4, "0")
    digits = F.when(z.rlike(r"^[+-]\d(:|$)"), F.concat(F.lit("0"), F.substring(digits, 1, 3))).otherwise(digits)
    signed = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(z.startswith("-"), -1).otherwise(1)
    named = F.element_at(F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v[0])]), z)
    return F.when(z.rlike(r"^[+-]"), signed).otherwise(named)


def _instant(f: Column, tz: Column) -> Column:
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i: at(i).try_cast("int")
    place = F.call_function("locate", at(1), F.lit(MONTHS))
    month = F.coalesce(number(1), F.when((F.length(at(1)) == 3) & (place % 3 == 1), F.call_function("div", place + 2, F.lit(3)).cast("int")))
    hour = F.coalesce(number(3), F.lit(0))
    hour = F.when(at(8) == "", hour).when(hour.between(1, 12), hour % 12 + F.when(at(8) == "PM", 12).otherwise(0))
    wall = F.try_make_timestamp(number(0), month, number(2), hour, F.coalesce(number(4), F.lit(0)), F.coalesce(number(5), F.lit(0)).cast("decimal(16,6)"), F.lit("UTC"))
    millis = F.coalesce(F.substring(F.rpad(at(6), 3, "0"), 1, 3).try_cast("int"), F.lit(0))
    return millis + F.when(at(7) == "", F.unix_millis(F.to_utc_timestamp(wall, tz))).otherwise(F.unix_millis(wall) - _offset(at(7)) * 60000)


def instant_of_canonical(c: Column, tz: Column) -> Column:
    """Milliseconds of a canonical text, null where it isn't a valid time. Without zone it is local to tz: of an hour that occurs twice the earlier, a skipped one goes on by the gap."""
    return F.when(c.startswith(MARK), bound(F.split(F.substring(c, 2, 60), r"\|", 9), lambda f: _instant(f, tz)))


def instant_of_epoch(s: Column, unit: str) -> Column:
    """Milliseconds of a bare number in a unit, null outside 1990 to 2100; only seconds may have a fraction."""
    number, factor = F.regexp_extract(s, r"^(\d+)", 1).try_cast("bigint"), EPOCHS[unit]
    if factor == 1000:
        fraction = F.regexp_extract(s, r"^\d+\.(\d+)$", 1)
        ms, low, high, form = number * 1000 + F.coalesce(F.substring(F.rpad(fraction, 3, "0"), 1, 3).try_cast("int"), F.lit(0)), EARLIEST_MS // 1000, LATEST_MS // 1000, r"^\d{9,10}(\.\d+)?$"
    else:
        ms, low, high, form = F.call_function("div", number, F.lit(abs(factor))), EARLIEST_MS * abs(factor), LATEST_MS * abs(factor), r"^\d{1,19}$"
    return F.when(s.rlike(form) & number.between(low, high), ms)


FIRST = {"iso": r"^\d{4}-", "basic": r"^\d{8}T", "slash_mdy": r"^\d{1,2}/", "slash_dmy": r"^\d{1,2}/", "dot_dmy": r"^\d{1,2}\.\d{1,2}\.", "dot_mdy": r"^\d{1,2}\.\d{1,2}\.", "mail": r"^(?:[A-Z]{3,9},? )?\d{1,2}[ -][A-Z]", "long_us": r"^[A-Z]{3,9}\.? \d"}


def epoch_ms(s: Column) -> Column:
    return F.coalesce(*[instant_of_epoch(s, u) for u in EPOCHS])


def utc_ms(c: Column, tz: Column, forms=CONVENTION) -> Column:
    """The instant of a text of time in milliseconds since 1970 UTC, finer digits cut off; null if it can't be read. Where two forms fit, the earlier of forms counts."""

    def body(s):
        shape = F.when(s.rlike(FIRST[forms[0]]), canonical(s, forms[0]))
        for form in forms[1:]:
            shape = shape.when(s.rlike(FIRST[form]), canonical(s, form))
        return F.when(s.rlike(r"^\d+(\.\d+)?$"), epoch_ms(s)).otherwise(bound(shape, lambda x: instant_of_canonical(x, tz)))

    return bound(clean(c), body)
