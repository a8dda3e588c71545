"""Which fields a request may use, and where they lead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import SearchConfigurationError
from ..functions.values import ValueType
from .ir import Op

#: Rules that ``FieldSpec.constraints`` may name.
RULES = (
    "not_blank", "not_empty", "email", "past", "past_or_present", "future", "future_or_present", "positive", "positive_or_zero", "negative", "negative_or_zero", "assert_true", "assert_false",
)


@dataclass(frozen=True)
class FieldSpec:
    """One searchable field.  ``path``: column or dotted path, the name itself
    by default; ``operators`` empty: all; ``sort_path``: another path for sorts.

    ``constraints``: names of further rules for values (``RULES`` in
    ``validate``), such as not_blank, email, past or positive; ``digits``: the
    most whole and fractional digits; ``check``: any other test of a value.
    """

    name: str
    type: ValueType = ValueType("string")
    path: str | None = None
    operators: frozenset[Op] = frozenset()
    sortable: bool = False
    sort_path: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    minimum: object = None
    maximum: object = None
    description: str | None = None
    constraints: tuple[str, ...] = ()
    digits: tuple[int, int] | None = None
    check: Callable[[object], bool] | None = field(default=None, compare=False)

    def __post_init__(self):
        for c in self.constraints:
            if c not in RULES:
                raise SearchConfigurationError("rule.unknown", self.name, c, ", ".join(RULES))

    def allows(self, op: Op) -> bool:
        return not self.operators or op in self.operators


def text(name: str, path: str | None = None, *operators: Op, **more) -> FieldSpec:
    return FieldSpec(name, ValueType("string"), path, frozenset(operators), **more)


def typed(name: str, type_: str | ValueType, path: str | None = None, *operators: Op, **more) -> FieldSpec:
    return FieldSpec(name, type_ if isinstance(type_, ValueType) else ValueType(type_), path, frozenset(operators), **more)


@dataclass(frozen=True)
class SearchSchema:
    """A named whitelist; fields of ``parent`` are inherited unless redefined."""

    name: str
    fields: tuple[FieldSpec, ...] = ()
    parent: SearchSchema | None = None
    _by: dict[str, FieldSpec] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        inherited = self.parent._by if self.parent else {}
        self._by.update(inherited | {f.name: f for f in self.fields})

    def all(self) -> tuple[FieldSpec, ...]:
        return tuple(self._by.values())

    def get(self, name: str) -> FieldSpec | None:
        return self._by.get(name)

    def resolve(self, name: str) -> str:
        """Path that a condition on the field uses; unknown names stay."""
        f = self.get(name)
        return (f.path or f.name) if f else name

    def resolve_sort(self, name: str) -> str:
        f = self.get(name)
        return (f.sort_path or f.path or f.name) if f else name
