import datetime as dt
from decimal import Decimal
from zoneinfo import ZoneInfo

import pytest

from lodestone.errors import SearchParseError
from lodestone.functions import values as V
from lodestone.functions.values import ValueType, coerce, enum, parse, parse_bound

SEOUL = ZoneInfo("Asia/Seoul")
NOON = dt.datetime(2024, 3, 5, 12, 30, 15)


@pytest.mark.parametrize("text", ["2024-03-05T12:30:15", "2024-03-05 12:30:15", "2024/03/05 12:30:15", "05-03-2024 12:30:15", "05/03/2024 12:30:15", "2024.03.05 12:30:15", "20240305123015", "2024-03-05T12:30:15.000", "2024-03-05T12:30:15Z", "2024-03-05T13:30:15+01:00", "2024-03-05T13:30:15+0100", "2024-03-05 12:30:15 Z", "2024-03-05T14:30:15+02:00[Europe/Athens]", "Tue, 5 Mar 2024 12:30:15 GMT", "﻿ 2024-03-05T12:30:15 "])
def test_datetime_formats(text):
    assert parse(text, ValueType("datetime")) == NOON


def test_datetime_zones():
    assert parse("2024-03-05T12:30:15Z", ValueType("datetime"), SEOUL) == NOON + dt.timedelta(hours=9)
    assert parse("2024-03-05T12:30:15", ValueType("timestamp"), SEOUL) == NOON.replace(tzinfo=SEOUL)
    assert parse("2024-03-05T12:30:15.123456789", ValueType("datetime")).microsecond == 123456
    assert parse("2024-03-05", ValueType("datetime")) == dt.datetime(2024, 3, 5)
    assert V.has_zone("2024-03-05T12:30:15+09:00") and not V.has_zone("2024-03-05T12:30:15") and not V.has_zone("2024-03-05")


@pytest.mark.parametrize("text", ["2024-03-05", "2024/03/05", "05-03-2024", "05/03/2024", "20240305", "2024.03.05"])
def test_date_formats(text):
    assert parse(text, ValueType("date")) == dt.date(2024, 3, 5)


@pytest.mark.parametrize(("text", "want"), [("08:05:09", dt.time(8, 5, 9)), ("08:05", dt.time(8, 5)), ("8:05", dt.time(8, 5)), ("080509", dt.time(8, 5, 9)), ("0805", dt.time(8, 5)), ("08:05:09.250", dt.time(8, 5, 9, 250000))])
def test_time_formats(text, want):
    assert parse(text, ValueType("time")) == want


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("byte", "127", 127), ("short", "-32768", -32768), ("int", "1,234", 1234), ("long", "9223372036854775807", 2**63 - 1), ("double", "1.5e3", 1500.0), ("decimal", "12.50", Decimal("12.50")), ("bigint", "123456789012345678901234567890", Decimal("123456789012345678901234567890")),
        ("boolean", "YES", True), ("boolean", "off", False), ("char", "x", "x"), ("uuid", "0000000A-0000-0000-0000-000000000001", "0000000a-0000-0000-0000-000000000001"), ("year", "2024", 2024), ("yearmonth", "2024-02", "2024-02"), ("monthday", "--02-29", "02-29"), ("string", " ａｂ ", "ab"),
    ],
)
def test_other_types(kind, text, want):
    assert parse(text, ValueType(kind)) == want


@pytest.mark.parametrize(("kind", "text"), [("byte", "128"), ("int", "1.5"), ("long", "9223372036854775808"), ("int", "x"), ("boolean", "maybe"), ("char", "ab"), ("uuid", "nope"), ("date", "2024-13-01"), ("datetime", "yesterday"), ("time", "25:00"), ("yearmonth", "2024-13"), ("monthday", "02-30"), ("decimal", "NaN"), ("bigint", "1" + "0" * 39)])
def test_rejected(kind, text):
    with pytest.raises(SearchParseError):
        parse(text, ValueType(kind))


def test_enum_and_null():
    kind = enum("DRAFT", "Published")
    assert parse("draft", kind) == "DRAFT" and parse("PUBLISHED", kind) == "Published"
    with pytest.raises(SearchParseError, match="DRAFT, Published"):
        parse("x", kind)
    assert all(parse(x, ValueType("int")) is None for x in (None, "", "  ", "null", "NULL"))


def test_bounds():
    day = ValueType("datetime")
    assert parse_bound("2024-03-05", day, False) == dt.datetime(2024, 3, 5)
    assert parse_bound("2024-03-05", day, True) == dt.datetime(2024, 3, 5, 23, 59, 59, 999999)
    assert parse_bound("2024-03-05", ValueType("date"), True) == dt.date(2024, 3, 5)
    assert parse_bound("2024-03-05", ValueType("timestamp"), True, SEOUL) == dt.datetime(2024, 3, 5, 23, 59, 59, 999999, SEOUL)
    assert parse_bound("7", ValueType("int"), True) == 7


def test_coerce():
    assert coerce("5", ValueType("long")) == 5 and coerce(5, ValueType("long")) == 5
    for value, kind in ((5, "double"), (5.0, "long"), (True, "int"), (300, "byte"), (5, "string"), (dt.datetime(2024, 1, 1), "date")):
        with pytest.raises(SearchParseError):
            coerce(value, ValueType(kind))
    assert coerce(NOON.replace(tzinfo=dt.timezone.utc), ValueType("datetime"), SEOUL) == NOON + dt.timedelta(hours=9)
    assert coerce(" a ", ValueType("string")) == " a "
