"""Conditions as columns.  All follow three-valued logic: a null drops out of an
operator and of its negation alike."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SearchValidationError
from ..functions.values import ORDERED, UTC, coerce, of_spark
from ..plans.ir import LISTS, ORDERINGS, PATTERNS, RANGES, Condition, Group, Logic, Node, Op


def literal(value, kind: T.DataType) -> Column:
    """A literal of exactly the column's type, so that nothing is cast per row."""
    if value is not None and isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    if value is not None and isinstance(kind, T.TimestampType):
        return F.lit(value)
    if value is not None and isinstance(kind, T.TimeType):
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value).cast(kind)


def predicate(c: Condition, column: Column, kind: T.DataType, zone: dt.tzinfo = UTC) -> Column:
    """One condition on a column of type ``kind``."""
    value_type = of_spark(kind)
    name = c.op.value
    if c.op is Op.IS_NULL:
        return column.isNull()
    if c.op is Op.IS_NOT_NULL:
        return column.isNotNull()
    if c.op in PATTERNS:
        return _pattern(c, column, kind)
    if c.op in ORDERINGS and value_type.name not in ORDERED:
        raise SearchValidationError("compare.type", c.field)

    def typed(value, is_end: bool = False) -> Column:
        return literal(coerce(value, value_type, zone, is_end, bound=c.op in RANGES), kind)

    if c.op in LISTS:
        if not isinstance(c.value, (tuple, list, set, frozenset)):
            raise SearchValidationError("value.collection", c.field, name, type(c.value).__name__)
        if not c.value:
            raise SearchValidationError("value.empty", c.field)
        inside = column.isin([typed(v) for v in c.value])
        return inside if c.op is Op.IN else ~inside
    if c.value is None:
        raise SearchValidationError("value.null", c.field, name)
    if c.op in RANGES:
        if c.value2 is None:
            raise SearchValidationError("value.second", c.field, name)
        inside = column.between(typed(c.value), typed(c.value2, True))
        return inside if c.op is Op.BETWEEN else ~inside
    v = typed(c.value)
    match c.op:
        case Op.EQUALS:
            return column == v
        case Op.NOT_EQUALS:
            return column != v
        case Op.GREATER_THAN:
            return column > v
        case Op.GREATER_THAN_OR_EQUAL_TO:
            return column >= v
        case Op.LESS_THAN:
            return column < v
    return column <= v


def _pattern(c: Condition, column: Column, kind: T.DataType) -> Column:
    """Literal, case-sensitive text search; maps and arrays are searched as JSON."""
    if c.value is None or c.value == "":
        raise SearchValidationError("pattern.empty", c.op.value)
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        column = F.to_json(column)
    elif not isinstance(kind, T.StringType):
        raise SearchValidationError("pattern.type", c.field)
    if not isinstance(c.value, str):
        raise SearchValidationError("value.type", c.field, repr(c.value), "string")
    found = {Op.CONTAINS: column.contains, Op.STARTS_WITH: column.startswith, Op.ENDS_WITH: column.endswith}
    if c.op in found:
        return found[c.op](c.value)
    return ~found[Op[c.op.name.removeprefix("NOT_")]](c.value)


def fold(nodes: tuple[Node, ...], one: Callable[[Condition], Column]) -> Column | None:
    """Left to right without precedence: a, or b, and c is (a or b) and c.  The
    first node's logic does not count; None without nodes."""

    def compile_(n: Node) -> Column:
        if isinstance(n, Group):
            inner = fold(n.nodes, one)
            if inner is None:
                raise SearchValidationError("group.empty")
            return inner
        return one(n)

    def join(left: Column | None, n: Node) -> Column:
        right = compile_(n)
        if left is None:
            return right
        return left | right if n.logic is Logic.OR else left & right

    return functools.reduce(join, nodes, None)
