"""Fluent construction of requests.

    search(schema).where(lambda w: w.equals("status", "O").or_greater_than("price", 10)) \
        .sort(lambda s: s.desc("price")).page(0).size(20).build()
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Any

from ..errors import SearchValidationError
from .ir import Condition, Group, Logic, Node, Op, Order, Search
from .schema import SearchSchema
from .validate import validate

_METHODS = {
    "equals": Op.EQUALS, "not_equals": Op.NOT_EQUALS, "greater_than": Op.GREATER_THAN, "greater_than_or_equal_to": Op.GREATER_THAN_OR_EQUAL_TO,
    "less_than": Op.LESS_THAN, "less_than_or_equal_to": Op.LESS_THAN_OR_EQUAL_TO, "contains": Op.CONTAINS, "not_contains": Op.NOT_CONTAINS,
    "starts_with": Op.STARTS_WITH, "not_starts_with": Op.NOT_STARTS_WITH, "ends_with": Op.ENDS_WITH, "not_ends_with": Op.NOT_ENDS_WITH,
    "is_null": Op.IS_NULL, "is_not_null": Op.IS_NOT_NULL, "in_": Op.IN, "not_in": Op.NOT_IN, "between": Op.BETWEEN, "not_between": Op.NOT_BETWEEN,
}


class ConditionList:
    """Collects nodes.  Each operator has a method (``equals``...) and one that
    joins by OR (``or_equals``...); the first node carries no logic."""

    def __init__(self, schema: SearchSchema | None):
        self.schema, self.nodes = schema, []

    def add(self, op: Op, field: str, value: Any = None, value2: Any = None, logic: Logic = Logic.AND) -> ConditionList:
        path = self.schema.resolve(field) if self.schema else None
        if isinstance(value, Iterable) and not isinstance(value, (str, dict)):
            value = tuple(value)
        self.nodes.append(Condition(field, op, value, value2, logic if self.nodes else None, path))
        return self

    def where(self, fill: Callable) -> ConditionList:
        """The nodes of ``fill``, in line."""
        self.nodes += _filled(self.schema, fill)
        return self

    def _group(self, logic: Logic, fill: Callable) -> ConditionList:
        if nodes := _filled(self.schema, fill):
            self.nodes.append(Group(tuple(nodes), logic))
        return self

    def and_(self, fill: Callable) -> ConditionList:
        return self._group(Logic.AND, fill)

    def or_(self, fill: Callable) -> ConditionList:
        return self._group(Logic.OR, fill)


def _method(op: Op, logic: Logic):
    return lambda self, field, *values: self.add(op, field, *values, logic=logic)


for _name, _op in _METHODS.items():
    setattr(ConditionList, _name, _method(_op, Logic.AND))
    setattr(ConditionList, "or_" + _name, _method(_op, Logic.OR))


def _filled(schema: SearchSchema | None, fill: Callable) -> list[Node]:
    inner = ConditionList(schema)
    fill(inner)
    return inner.nodes


class SortList:
    def __init__(self, schema: SearchSchema | None):
        self.schema, self.orders = schema, []

    def _add(self, field: str, ascending: bool) -> SortList:
        if not field:
            raise SearchValidationError("field.sort", field)
        self.orders.append(Order(field, ascending, self.schema.resolve_sort(field) if self.schema else None))
        return self

    def asc(self, field: str) -> SortList:
        return self._add(field, True)

    def desc(self, field: str) -> SortList:
        return self._add(field, False)


class SearchBuilder:
    """``and_`` and ``or_`` put plain conditions in line as long as no sort, page,
    size or fetch was given, and make a group afterwards."""

    def __init__(self, schema: SearchSchema | None = None, start: Search | None = None):
        self.schema, self._search, self._chained = schema, start or Search(), False

    def _append(self, *nodes: Node) -> SearchBuilder:
        self._search = replace(self._search, nodes=(*self._search.nodes, *nodes))
        return self

    def where(self, fill: Callable) -> SearchBuilder:
        return self._append(*_filled(self.schema, fill))

    def _combine(self, logic: Logic, fill: Callable) -> SearchBuilder:
        nodes = _filled(self.schema, fill)
        if not nodes:
            return self
        if self._chained or any(isinstance(n, Group) for n in nodes):
            return self._append(Group(tuple(nodes), logic))
        return self._append(*(n if n.logic else replace(n, logic=logic) for n in nodes))

    def and_(self, fill: Callable) -> SearchBuilder:
        return self._combine(Logic.AND, fill)

    def or_(self, fill: Callable) -> SearchBuilder:
        return self._combine(Logic.OR, fill)

    def _set(self, **changes) -> SearchBuilder:
        self._search, self._chained = replace(self._search, **changes), True
        return self

    def sort(self, fill: Callable) -> SearchBuilder:
        """Replaces an earlier sort."""
        orders = SortList(self.schema)
        fill(orders)
        return self._set(sort=tuple(orders.orders))

    def page(self, page: int) -> SearchBuilder:
        return self._set(page=page)

    def size(self, size: int) -> SearchBuilder:
        return self._set(size=size)

    def fetch_fields(self, *fields: str | Iterable[str]) -> SearchBuilder:
        names = [x for f in fields for x in ([f] if isinstance(f, str) else f)]
        return self._set(fetch=tuple(dict.fromkeys(names)))

    def build(self) -> Search:
        """The request, checked if there is a schema."""
        if self.schema:
            validate(self.schema, self._search)
        return self._search


def search(schema: SearchSchema | None = None) -> SearchBuilder:
    return SearchBuilder(schema)


def from_search(existing: Search, schema: SearchSchema | None = None) -> SearchBuilder:
    """A builder that goes on from a request, which itself never changes."""
    return SearchBuilder(schema, existing)
