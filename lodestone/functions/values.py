"""Texts of a request as typed values.

All of this runs once per request on the driver; nothing here is a UDF.  Naive
date-times are local to the application zone, instants are aware.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
import uuid
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from email.utils import parsedate_to_datetime
from zoneinfo import ZoneInfo

from pyspark.sql import types as T

from ..errors import SearchParseError

UTC = dt.timezone.utc

#: Whole numbers and their ranges.
INTEGERS = {"byte": 8, "short": 16, "int": 32, "long": 64}
TEMPORAL = {"datetime", "date", "time", "timestamp"}
ORDERED = {*INTEGERS, *TEMPORAL, "float", "double", "decimal", "bigint", "string", "char", "boolean", "enum", "uuid", "year", "yearmonth", "monthday"}


@dataclass(frozen=True)
class ValueType:
    """Type of a field: one of the names above, with its details."""

    name: str
    precision: int = 38
    scale: int = 18
    values: tuple[str, ...] = ()

    @property
    def spark(self) -> T.DataType:
        simple = {
            "string": T.StringType(), "char": T.StringType(), "enum": T.StringType(), "uuid": T.StringType(), "json": T.StringType(), "yearmonth": T.StringType(), "monthday": T.StringType(),
            "boolean": T.BooleanType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "year": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
            "bigint": T.DecimalType(38, 0), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(),
        }
        if self.name == "decimal":
            return T.DecimalType(self.precision, self.scale)
        if self.name == "time":
            return T.TimeType(6)
        return simple[self.name]

    @property
    def is_text(self) -> bool:
        return self.name in ("string", "json")

    def __str__(self) -> str:
        return self.name


def enum(*values: str) -> ValueType:
    return ValueType("enum", values=values)


def of_spark(kind: T.DataType) -> ValueType:
    """The value type that fits a column's type."""
    table = {
        T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean",
        T.DateType: "date", T.TimestampNTZType: "datetime", T.TimestampType: "timestamp", T.StringType: "string", T.MapType: "json", T.ArrayType: "json", T.TimeType: "time",
    }
    if isinstance(kind, T.DecimalType):
        return ValueType("decimal", kind.precision, kind.scale)
    return ValueType(table.get(type(kind), "string"))


def normalise(text: str) -> str:
    """NFKC, without byte order mark and outer white space."""
    return unicodedata.normalize("NFKC", text.replace("\ufeff", "")).strip()


_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?(?::?\d{2})?)"
_CLOCK = re.compile(r"(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?")
_DATES = (
    re.compile(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})"),
    re.compile(r"(?P<y>\d{4})/(?P<m>\d{2})/(?P<d>\d{2})"),
    re.compile(r"(?P<y>\d{4})\.(?P<m>\d{2})\.(?P<d>\d{2})"),
    re.compile(r"(?P<d>\d{2})-(?P<m>\d{2})-(?P<y>\d{4})"),
    re.compile(r"(?P<d>\d{2})/(?P<m>\d{2})/(?P<y>\d{4})"),
    re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"),
)
_ZONED = re.compile(rf"(?P<date>[\d/.-]+)(?P<sep>[T ])(?P<clock>\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?)\s?(?P<offset>{_OFFSET})?(?:\[(?P<zone>[\w/+-]+)\])?")
_COMPACT = re.compile(r"\d{14}")
_RFC_1123 = re.compile(r"(?:[A-Za-z]{3},? )?\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})? (?:GMT|UT|UTC|[+-]\d{4})")


def has_zone(text: str) -> bool:
    """Whether a date-time text names an offset or a zone."""
    return bool(re.search(rf"[T ]?\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?\s?{_OFFSET}(?:\[.+\])?$|\[[\w/+-]+\]$", text)) or bool(_RFC_1123.fullmatch(text))


def _fail(text: object, kind: object) -> SearchParseError:
    return SearchParseError("parse.failed", text, kind)


def date_only(text: str) -> dt.date | None:
    """The date of a text that is nothing but a date, else None."""
    for p in _DATES:
        if m := p.fullmatch(text):
            try:
                return dt.date(int(m["y"]), int(m["m"]), int(m["d"]))
            except ValueError:
                return None
    return None


def _clock(text: str) -> dt.time:
    m = _CLOCK.fullmatch(text)
    if not m:
        raise _fail(text, "time")
    return dt.time(int(m[1]), int(m[2]), int(m[3] or 0), int((m[4] or "0").ljust(9, "0")[:6]))


def _offset(text: str) -> dt.timezone:
    if text == "Z":
        return UTC
    digits = text[1:].replace(":", "").ljust(6, "0")
    delta = dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:4]), seconds=int(digits[4:6]))
    return dt.timezone(-delta if text[0] == "-" else delta)


def parse_moment(text: str) -> dt.datetime:
    """A date-time, aware if the text names a zone; a plain date is its midnight."""
    if day := date_only(text):
        return dt.datetime.combine(day, dt.time())
    try:
        if _COMPACT.fullmatch(text):
            return dt.datetime.strptime(text, "%Y%m%d%H%M%S")
        if _RFC_1123.fullmatch(text):
            return parsedate_to_datetime(text)
        if (m := _ZONED.fullmatch(text)) and (day := date_only(m["date"])):
            moment = dt.datetime.combine(day, _clock(m["clock"]))
            if m["zone"]:
                return moment.replace(tzinfo=ZoneInfo(m["zone"]))
            return moment.replace(tzinfo=_offset(m["offset"])) if m["offset"] else moment
    except (ValueError, KeyError, OSError):
        pass
    raise _fail(text, "datetime")


def parse_datetime(text: str, zone: dt.tzinfo = UTC) -> dt.datetime:
    """Local date-time in the application zone."""
    moment = parse_moment(text)
    return moment.astimezone(zone).replace(tzinfo=None) if moment.tzinfo else moment


def parse_instant(text: str, zone: dt.tzinfo = UTC) -> dt.datetime:
    """Aware date-time; a text without zone is local to the application zone."""
    moment = parse_moment(text)
    return moment if moment.tzinfo else moment.replace(tzinfo=zone)


def parse_date(text: str) -> dt.date:
    if day := date_only(text):
        return day
    raise _fail(text, "date")


def parse_time(text: str) -> dt.time:
    for pattern in ("%H%M%S", "%H%M"):
        if re.fullmatch(r"\d{6}" if len(pattern) == 6 else r"\d{4}", text):
            try:
                return dt.datetime.strptime(text, pattern).time()
            except ValueError:
                raise _fail(text, "time") from None
    try:
        return _clock("0" + text if re.fullmatch(r"\d:\d{2}", text) else text)
    except ValueError:
        raise _fail(text, "time") from None


def parse_number(text: str, kind: ValueType):
    """A number in the type's range; commas and blanks are left out first."""
    plain = re.sub(r"[,\s]", "", text)
    try:
        if kind.name in INTEGERS:
            n, bits = int(plain), INTEGERS[kind.name]
            if not -(1 << bits - 1) <= n < 1 << bits - 1:
                raise ValueError
            return n
        if kind.name in ("float", "double"):
            return float(plain)
        n = Decimal(plain)
        if not n.is_finite():
            raise ValueError
        scale = 0 if kind.name == "bigint" else kind.scale
        if kind.name == "bigint" and n != n.to_integral_value():
            raise ValueError
        if n and n.adjusted() + 1 > (38 if kind.name == "bigint" else kind.precision) - scale:
            raise ValueError
        return n
    except (ValueError, InvalidOperation):
        raise _fail(text, kind) from None


_TRUE, _FALSE = {"true", "1", "yes", "y", "on"}, {"false", "0", "no", "n", "off"}


def parse_boolean(text: str) -> bool:
    if text.lower() in _TRUE | _FALSE:
        return text.lower() in _TRUE
    raise _fail(text, "boolean")


def parse_enum(text: str, values: tuple[str, ...]) -> str:
    """The allowed value that equals the text in upper case, else in any case."""
    if text.upper() in values:
        return text.upper()
    for v in values:
        if v.lower() == text.lower():
            return v
    raise SearchParseError("parse.enum", text, ", ".join(values))


def parse_char(text: str) -> str:
    if len(text) != 1:
        raise _fail(text, "char")
    return text


def parse_uuid(text: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]{1,8}(?:-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}", text):
        raise _fail(text, "uuid")
    return str(uuid.UUID("-".join(p.zfill(n) for p, n in zip(text.split("-"), (8, 4, 4, 4, 12), strict=True))))


def is_null(text: str | None) -> bool:
    """Null, blank and 'null' in any case stand for no value."""
    return text is None or not text.strip() or text.strip().lower() == "null"


def parse(text: str | None, kind: ValueType, zone: dt.tzinfo = UTC):
    """The typed value of a text, None for no value."""
    if is_null(text):
        return None
    t = normalise(text)
    match kind.name:
        case "enum":
            return parse_enum(t, kind.values)
        case "boolean":
            return parse_boolean(t)
        case "datetime":
            return parse_datetime(t, zone)
        case "timestamp":
            return parse_instant(t, zone)
        case "date":
            return parse_date(t)
        case "time":
            return parse_time(t)
        case "year":
            if not re.fullmatch(r"-?\d{4,9}", t):
                raise _fail(t, kind)
            return int(t)
        case "yearmonth":
            if not re.fullmatch(r"\d{4}-(?:0[1-9]|1[0-2])", t):
                raise _fail(t, kind)
            return t
        case "monthday":
            short = t.removeprefix("--")
            try:
                dt.date.fromisoformat(f"2000-{short}")
            except ValueError:
                raise _fail(t, kind) from None
            return short
        case "char":
            return parse_char(t)
        case "uuid":
            return parse_uuid(t)
        case "byte" | "short" | "int" | "long" | "float" | "double" | "decimal" | "bigint":
            return parse_number(t, kind)
    return t


def parse_bound(text: str | None, kind: ValueType, is_end: bool, zone: dt.tzinfo = UTC):
    """One end of a range: a plain date becomes the first or the last moment of
    its day for date-times and instants."""
    if not is_null(text) and kind.name in ("datetime", "timestamp") and (day := date_only(normalise(text))):
        moment = dt.datetime.combine(day, dt.time.max if is_end else dt.time.min)
        return moment.replace(tzinfo=zone) if kind.name == "timestamp" else moment
    return parse(text, kind, zone)


_PYTHON: dict[str, tuple[type, ...]] = {
    "boolean": (bool,), "byte": (int,), "short": (int,), "int": (int,), "long": (int,), "year": (int,), "float": (float,), "double": (float,),
    "decimal": (Decimal,), "bigint": (Decimal, int), "date": (dt.date,), "time": (dt.time,), "datetime": (dt.datetime,), "timestamp": (dt.datetime,),
}


def coerce(value, kind: ValueType, zone: dt.tzinfo = UTC, is_end: bool = False, bound: bool = False):
    """A request's value in the field's type: texts are parsed, values of the
    type pass, anything else is an error (there is no widening)."""
    if value is None:
        return None
    if isinstance(value, str):
        if kind.name in ("string", "json"):
            return value
        return parse_bound(value, kind, is_end, zone) if bound else parse(value, kind, zone)
    wanted = _PYTHON.get(kind.name, (str,))
    if not isinstance(value, wanted) or (isinstance(value, bool) and bool not in wanted) or (kind.name == "date" and isinstance(value, dt.datetime)):
        raise _fail(value, kind)
    if kind.name in INTEGERS:
        return parse_number(str(value), kind)
    if kind.name == "datetime" and value.tzinfo:
        return value.astimezone(zone).replace(tzinfo=None)
    if kind.name == "timestamp" and not value.tzinfo:
        return value.replace(tzinfo=zone)
    return value
