"""A search request as an immutable tree."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any


class Op(Enum):
    """The eighteen comparison operators, by the names used on the wire."""

    EQUALS = "equals"
    NOT_EQUALS = "notEquals"
    GREATER_THAN = "greaterThan"
    GREATER_THAN_OR_EQUAL_TO = "greaterThanOrEqualTo"
    LESS_THAN = "lessThan"
    LESS_THAN_OR_EQUAL_TO = "lessThanOrEqualTo"
    CONTAINS = "contains"
    NOT_CONTAINS = "notContains"
    STARTS_WITH = "startsWith"
    NOT_STARTS_WITH = "notStartsWith"
    ENDS_WITH = "endsWith"
    NOT_ENDS_WITH = "notEndsWith"
    IS_NULL = "isNull"
    IS_NOT_NULL = "isNotNull"
    IN = "in"
    NOT_IN = "notIn"
    BETWEEN = "between"
    NOT_BETWEEN = "notBetween"

    @classmethod
    def named(cls, name: str) -> Op | None:
        """By wire name or constant name, in any case."""
        low = name.strip().lower()
        return next((o for o in cls if low in (o.value.lower(), o.name.lower())), None)


NULLARY = {Op.IS_NULL, Op.IS_NOT_NULL}
LISTS = {Op.IN, Op.NOT_IN}
RANGES = {Op.BETWEEN, Op.NOT_BETWEEN}
ORDERINGS = {Op.GREATER_THAN, Op.GREATER_THAN_OR_EQUAL_TO, Op.LESS_THAN, Op.LESS_THAN_OR_EQUAL_TO, *RANGES}
PATTERNS = {Op.CONTAINS, Op.NOT_CONTAINS, Op.STARTS_WITH, Op.NOT_STARTS_WITH, Op.ENDS_WITH, Op.NOT_ENDS_WITH}


class Logic(Enum):
    AND = "and"
    OR = "or"

    @classmethod
    def named(cls, name: str) -> Logic | None:
        return next((x for x in cls if x.value == name.strip().lower()), None)


@dataclass(frozen=True)
class Condition:
    """field op value; ``logic`` joins it to its left sibling (None: and)."""

    field: str
    op: Op
    value: Any = None
    value2: Any = None
    logic: Logic | None = None
    path: str | None = None  # where the field leads; resolved from the schema

    @property
    def target(self) -> str:
        return self.path or self.field


@dataclass(frozen=True)
class Group:
    """Nodes that are folded by their own logic; ``logic`` joins the whole."""

    nodes: tuple[Node, ...]
    logic: Logic | None = None


Node = Condition | Group


@dataclass(frozen=True)
class Order:
    field: str
    ascending: bool = True
    path: str | None = None

    @property
    def target(self) -> str:
        return self.path or self.field


@dataclass(frozen=True)
class Search:
    nodes: tuple[Node, ...] = ()
    sort: tuple[Order, ...] = ()
    page: int | None = None
    size: int | None = None
    fetch: tuple[str, ...] = field(default=())

    def with_(self, **changes) -> Search:
        return replace(self, **changes)

    def conditions(self):
        """All conditions of the tree, left to right."""

        def walk(nodes):
            for n in nodes:
                if isinstance(n, Group):
                    yield from walk(n.nodes)
                else:
                    yield n

        return walk(self.nodes)

    def paths(self) -> set[str]:
        """Relationship prefixes that conditions use (sorts not included)."""
        return {c.target.rpartition(".")[0] for c in self.conditions() if "." in c.target}
