"""OpenAPI fragments generated from a search schema."""

from __future__ import annotations

import re
from typing import Any

from .functions.values import ValueType
from .plans.ir import LISTS, NULLARY, RANGES, Op
from .plans.schema import FieldSpec, SearchSchema

_TYPES: dict[str, tuple[str, str | None]] = {
    "boolean": ("boolean", None), "byte": ("integer", "int32"), "short": ("integer", "int32"), "int": ("integer", "int32"), "year": ("integer", "int32"), "long": ("integer", "int64"),
    "bigint": ("integer", None), "float": ("number", "float"), "double": ("number", "double"), "decimal": ("number", None), "date": ("string", "date"), "datetime": ("string", "date-time"),
    "timestamp": ("string", "date-time"), "time": ("string", "time"), "uuid": ("string", "uuid"), "yearmonth": ("string", "yyyy-MM"), "monthday": ("string", "MM-dd"),
}

_EXAMPLES: dict[str, tuple[str, str]] = {
    "boolean": ("true", "false"), "float": ("1.5", "9.5"), "double": ("1.5", "9.5"), "decimal": ("1.50", "9.50"), "date": ("2024-01-01", "2024-12-31"), "datetime": ("2024-01-01T00:00:00", "2024-12-31T23:59:59"),
    "timestamp": ("2024-01-01T00:00:00Z", "2024-12-31T23:59:59Z"), "time": ("08:00:00", "18:00:00"), "uuid": ("00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002"),
    "year": ("2023", "2024"), "yearmonth": ("2024-01", "2024-12"), "monthday": ("01-01", "12-31"), "char": ("A", "Z"), "string": ("text", "texts"), "json": ("text", "texts"),
}


def operators(spec: FieldSpec) -> list[Op]:
    """Allowed operators in their general order."""
    return [o for o in Op if spec.allows(o)]


def description(schema: SearchSchema) -> str:
    lines = ["**Searchable Fields:**", ""]
    for f in schema.all():
        lines.append(f"- `{f.name}` ({'|'.join(o.value for o in operators(f))})" + (" [sortable]" if f.sortable else ""))
    return "\n".join(lines)


def allowed_values(spec: FieldSpec) -> list[str]:
    """Values of an enum, or the alternatives of a pattern like A|B."""
    if spec.type.values:
        return list(spec.type.values)
    if spec.pattern and re.fullmatch(r"\^?\(?[\w-]+(?:\|[\w-]+)+\)?\$?", spec.pattern):
        return re.findall(r"[\w-]+", spec.pattern)
    return []


def value_schema(spec: FieldSpec) -> dict[str, Any]:
    kind, form = _TYPES.get(spec.type.name, ("string", None))
    out: dict[str, Any] = {"type": kind}
    if form:
        out["format"] = form
    if values := allowed_values(spec):
        out["enum"] = values
    named = {"minLength": spec.min_length, "maxLength": spec.max_length, "minimum": spec.minimum, "maximum": spec.maximum}
    out |= {k: v for k, v in named.items() if v is not None}
    if spec.pattern and "enum" not in out:
        out["pattern"] = spec.pattern
    if "email" in spec.constraints:
        out["format"] = "email"
    if {"not_blank", "not_empty"} & set(spec.constraints):
        out["minLength"] = max(1, spec.min_length or 0)
    if "positive" in spec.constraints:
        out["exclusiveMinimum"] = 0
    if "positive_or_zero" in spec.constraints:
        out.setdefault("minimum", 0)
    if "negative" in spec.constraints:
        out["exclusiveMaximum"] = 0
    if "negative_or_zero" in spec.constraints:
        out.setdefault("maximum", 0)
    return out


def parameter_schema(spec: FieldSpec, op: Op) -> dict[str, Any]:
    """isNull takes a boolean; operators of several values a text with commas."""
    if op in NULLARY:
        return {"type": "boolean"}
    if op in LISTS | RANGES:
        out: dict[str, Any] = {"type": "string", "description": "two values, comma between" if op in RANGES else "values, commas between"}
        if values := allowed_values(spec):
            out["x-enum"] = values
            out["description"] += ": " + ", ".join(values)
        return out
    return value_schema(spec)


def paging_parameters(schema: SearchSchema) -> list[dict[str, Any]]:
    sortable = [f"{f.name}.{d}" for f in schema.all() if f.sortable for d in ("asc", "desc")]
    return [
        {"name": "page", "in": "query", "required": False, "schema": {"type": "integer", "minimum": 0, "default": 0}},
        {"name": "size", "in": "query", "required": False, "schema": {"type": "integer", "minimum": 1, "default": 20}},
        {"name": "sort", "in": "query", "required": False, "explode": False, "schema": {"type": "array", "items": {"type": "string", "enum": sortable} if sortable else {"type": "string"}}},
    ]


def parameters(schema: SearchSchema) -> list[dict[str, Any]]:
    """One query parameter for each field and operator, then page, size, sort."""
    own = [
        {"name": f"{f.name}.{o.value}", "in": "query", "required": False, "description": f.description or f"{f.name} {o.value}", "schema": parameter_schema(f, o), "example": _example(f, o, text=True)}
        for f in schema.all()
        for o in operators(f)
    ]
    return own + paging_parameters(schema)


def _pair(spec: FieldSpec) -> tuple[str, str]:
    if values := allowed_values(spec):
        return values[0], values[-1]
    return _EXAMPLES.get(spec.type.name, ("1", "10"))


def _example(spec: FieldSpec, op: Op, text: bool = False) -> Any:
    low, high = _pair(spec)
    if op in NULLARY:
        return True if text else None
    if op in LISTS | RANGES:
        return f"{low},{high}" if text else [low, high]
    return low


def example(schema: SearchSchema) -> dict[str, Any]:
    """A request of the first field and its first operator."""
    fields = schema.all()
    if not fields:
        return {"page": 0, "size": 10}
    first = fields[0]
    op = operators(first)[0]
    condition: dict[str, Any] = {"field": first.name, "searchOperator": op.value}
    if op in RANGES:
        condition["value"], condition["value2"] = _pair(first)
    elif op not in NULLARY:
        condition["value"] = _example(first, op)
    out: dict[str, Any] = {"conditions": [condition]}
    if sortable := next((f for f in fields if f.sortable), None):
        out["sort"] = {"orders": [{"field": sortable.name, "direction": "asc"}]}
    return out | {"page": 0, "size": 10}


def operation(schema: SearchSchema, method: str = "get") -> dict[str, Any]:
    """An operation's generated parts: parameters for GET, a body for POST."""
    if method.lower() == "get":
        return {"description": description(schema), "parameters": parameters(schema)}
    body = {"application/json": {"schema": {"$ref": "#/components/schemas/Search"}, "example": example(schema)}}
    return {"description": description(schema), "requestBody": {"required": True, "content": body}}


def components(schema: SearchSchema | None = None) -> dict[str, Any]:
    """The component schemas that ``operation`` refers to: a request with its
    conditions, which may be groups, its sort and its page.  With a schema, only
    its fields are named."""
    names = [f.name for f in schema.all()] if schema else []
    sortable = [f.name for f in schema.all() if f.sortable] if schema else []
    logic = {"type": "string", "enum": ["and", "or"], "description": "how it is joined to what stands before it; 'and' by default"}
    any_value = {"description": "a value, or an array for operators that take several"}
    order = {"type": "object", "required": ["field"], "properties": {"field": {"type": "string"} | ({"enum": sortable} if sortable else {}), "direction": {"type": "string", "enum": ["asc", "desc"], "default": "asc"}}}
    condition = {
        "type": "object",
        "required": ["field", "searchOperator"],
        "properties": {"operator": logic, "field": {"type": "string"} | ({"enum": names} if names else {}), "searchOperator": {"type": "string", "enum": [o.value for o in Op]}, "value": any_value, "value2": {"description": "the second value of a range"}},
    }
    either = {"oneOf": [{"$ref": "#/components/schemas/SearchCondition"}, {"$ref": "#/components/schemas/SearchGroup"}]}
    group = {"type": "object", "required": ["conditions"], "properties": {"operator": logic, "conditions": {"type": "array", "items": either}}}
    request = {
        "type": "object",
        "properties": {
            "conditions": {"type": "array", "items": either},
            "sort": {"type": "object", "properties": {"orders": {"type": "array", "items": {"$ref": "#/components/schemas/SearchOrder"}}}},
            "page": {"type": "integer", "format": "int32", "minimum": 0},
            "size": {"type": "integer", "format": "int32", "minimum": 1},
        },
    }
    return {"schemas": {"Search": request, "SearchCondition": condition, "SearchGroup": group, "SearchOrder": order}}


def string_type(kind: ValueType) -> bool:
    return _TYPES.get(kind.name, ("string",))[0] == "string"
