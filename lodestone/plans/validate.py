"""Checks of a request against its schema, all problems at once."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from ..errors import SearchError, SearchValidationError, message
from ..functions.values import ORDERED, UTC, coerce
from .ir import LISTS, NULLARY, ORDERINGS, PATTERNS, RANGES, Condition, Search
from .schema import FieldSpec, SearchSchema


def whitelist(schema: SearchSchema, request: Search) -> list[str]:
    """Unknown fields, operators that a field does not allow, and sorts by
    fields that are not sortable."""
    problems = []
    for c in request.conditions():
        spec = schema.get(c.field)
        if not spec:
            problems.append(message("field.unknown", c.field, schema.name))
        elif not spec.allows(c.op):
            problems.append(message("field.operator", c.field, c.op.value, ", ".join(sorted(o.value for o in spec.operators))))
    for o in request.sort:
        spec = schema.get(o.field)
        if not spec:
            problems.append(message("field.unknown", o.field, schema.name))
        elif not spec.sortable:
            problems.append(message("field.sort", o.field))
    return problems


def paging(request: Search) -> list[str]:
    problems = []
    if (request.page is None) != (request.size is None):
        problems.append(message("page.both"))
    if request.page is not None and request.page < 0:
        problems.append(message("page.negative"))
    if request.size is not None and request.size <= 0:
        problems.append(message("page.size"))
    return problems


def _now(value, zone: dt.tzinfo):
    """The present moment in the form of ``value``; None for what is no moment."""
    now = dt.datetime.now(zone)
    if isinstance(value, dt.datetime):
        return now if value.tzinfo else now.replace(tzinfo=None)
    return now.date() if isinstance(value, dt.date) else None


def _kept(rule: str, value, zone: dt.tzinfo) -> bool:
    """Whether a value keeps a rule; rules do not bind values of other kinds."""
    if rule in ("not_blank", "not_empty"):
        return not isinstance(value, str) or bool(value.strip() if rule == "not_blank" else value)
    if rule == "email":
        return not isinstance(value, str) or not value or re.fullmatch(r"[^@\s.]+(?:\.[^@\s.]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*", value) is not None
    if rule.startswith("assert_"):
        return not isinstance(value, bool) or value is (rule == "assert_true")
    if rule.startswith(("past", "future")):
        if (now := _now(value, zone)) is None:
            return True
        return value < now if rule == "past" else value <= now if rule == "past_or_present" else value > now if rule == "future" else value >= now
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        return True
    return value > 0 if rule == "positive" else value >= 0 if rule == "positive_or_zero" else value < 0 if rule == "negative" else value <= 0


def _digits(value) -> tuple[int, int]:
    """Whole and fractional digits of a number, without leading and trailing zeros."""
    sign, digits, exponent = Decimal(str(value)).normalize().as_tuple()
    return max(len(digits) + exponent, 0) if digits != (0,) else 0, max(-exponent, 0)


def _constraints(spec: FieldSpec, value, zone: dt.tzinfo = UTC) -> list[str]:
    problems = [message("value.rule", spec.name, r.replace("_", " ")) for r in spec.constraints if not _kept(r, value, zone)]
    if spec.digits and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) and any(n > most for n, most in zip(_digits(value), spec.digits, strict=True)):
        problems.append(message("value.digits", spec.name, *spec.digits))
    if spec.check and not spec.check(value):
        problems.append(message("value.check", spec.name))
    if isinstance(value, str):
        low, high = spec.min_length or 0, spec.max_length
        if len(value) < low or (high is not None and len(value) > high):
            problems.append(message("value.size", spec.name, low, high if high is not None else "*"))
        if spec.pattern and not re.fullmatch(spec.pattern, value):
            problems.append(message("value.pattern", spec.name, spec.pattern))
    elif not isinstance(value, (bool, dt.time)):
        try:
            if (spec.minimum is not None and value < spec.minimum) or (spec.maximum is not None and value > spec.maximum):
                problems.append(message("value.range", spec.name, spec.minimum, spec.maximum))
        except TypeError:
            problems.append(message("value.type", spec.name, repr(value), spec.type))
    return problems


def values(spec: FieldSpec, c: Condition, zone: dt.tzinfo = UTC) -> list[str]:
    """Problems of one condition's values: presence, shape, type, constraints."""
    name = c.op.value
    if c.op in NULLARY:
        return []
    if c.value is None:
        return [message("value.null", c.field, name)]
    if c.op in RANGES and c.value2 is None:
        return [message("value.second", c.field, name)]
    if c.op in PATTERNS:
        if not spec.type.is_text:
            return [message("pattern.type", c.field)]
        if not isinstance(c.value, str):
            return [message("value.type", c.field, repr(c.value), "string")]
        if not c.value:
            return [message("pattern.empty", name)]
    if c.op in ORDERINGS and spec.type.name not in ORDERED:
        return [message("compare.type", c.field)]
    if spec.type.name == "json":
        return []
    if c.op in LISTS:
        if not isinstance(c.value, (tuple, list, set, frozenset)):
            return [message("value.collection", c.field, name, type(c.value).__name__)]
        if not c.value:
            return [message("value.empty", c.field)]
        given = [v for v in c.value if v is not None]
    else:
        given = [c.value, c.value2] if c.op in RANGES else [c.value]
    problems = []
    for v in given:
        try:
            typed = coerce(v, spec.type, zone)
        except SearchError:
            problems.append(message("value.type", c.field, repr(v), spec.type))
            continue
        if typed is None:
            problems.append(message("value.null", c.field, name))
            continue
        problems += _constraints(spec, typed, zone)
    return problems


def validate(schema: SearchSchema, request: Search, zone: dt.tzinfo = UTC) -> None:
    """Raises one error that lists everything that is wrong."""
    problems = whitelist(schema, request) + paging(request)
    for c in request.conditions():
        if spec := schema.get(c.field):
            problems += values(spec, c, zone)
    if problems:
        raise SearchValidationError("; ".join(problems), problems=problems)
