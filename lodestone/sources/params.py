"""Requests as URL parameters: field.operator=value, sort, page, size."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from ..errors import SearchParseError, SearchValidationError
from ..functions.values import UTC, ValueType, parse, parse_bound
from ..plans.builder import search
from ..plans.ir import LISTS, NULLARY, PATTERNS, RANGES, Op, Search
from ..plans.schema import SearchSchema

_KEY = re.compile(r"(.+)\.([A-Za-z_]+)")
_SORT = re.compile(r"(.+)\.(asc|desc)")


def _number(key: str, value: str) -> int:
    if not re.fullmatch(r"\+?\d{1,9}", value):
        raise SearchParseError("param.number", key)
    return int(value)


def from_params(params: Mapping[str, str], schema: SearchSchema, zone: dt.tzinfo = UTC) -> Search:
    """A checked request whose conditions are all joined by AND.

    Only the operators that take several values split at commas; the others
    take a value as it is.  Single values are parsed by the field's type.
    """
    builder = search(schema)
    conditions = [(k, v) for k, v in params.items() if k not in ("sort", "page", "size")]

    def fill(w) -> None:
        for key, value in conditions:
            m = _KEY.fullmatch(key)
            if not m:
                raise SearchParseError("param.key", key)
            name, op = m[1], Op.named(m[2])
            if not op:
                raise SearchParseError("operator.unknown", m[2])
            spec = schema.get(name)
            kind = spec.type if spec else ValueType("string")
            if op in NULLARY:
                w.add(op, name)
            elif op in PATTERNS:
                if not value or not value.strip():
                    raise SearchValidationError("pattern.empty", op.value)
                w.add(op, name, value)
            elif op in LISTS:
                w.add(op, name, tuple(value.split(",")))
            elif op in RANGES:
                ends = value.split(",")
                if len(ends) != 2:
                    raise SearchParseError("param.two", op.value)
                w.add(op, name, parse_bound(ends[0], kind, False, zone), parse_bound(ends[1], kind, True, zone))
            else:
                w.add(op, name, parse(value, kind, zone))

    if conditions:
        builder.where(fill)
    if (text := params.get("sort")) and text.strip():

        def orders(s) -> None:
            for part in text.split(","):
                m = _SORT.fullmatch(part.strip())
                if not m:
                    raise SearchParseError("param.sort", part)
                (s.asc if m[2] == "asc" else s.desc)(m[1])

        builder.sort(orders)
    if "page" in params:
        builder.page(_number("page", params["page"]))
    if "size" in params:
        builder.size(_number("size", params["size"]))
    return builder.build()
