"""Requests as JSON."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal
from typing import Any

from ..errors import SearchParseError, SearchValidationError
from ..plans.ir import Condition, Group, Logic, Node, Op, Order, Search
from ..plans.schema import SearchSchema
from ..plans.validate import validate


def _scalar(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, (dict, list)) else str(value)


def _value(value: Any):
    """Scalars become texts, arrays lists of texts, objects their JSON text."""
    return tuple(map(_scalar, value)) if isinstance(value, list) else _scalar(value)


def _logic(data: dict) -> Logic | None:
    name = data.get("operator")
    if name is None:
        return None
    if not (found := Logic.named(str(name))):
        raise SearchValidationError("operator.unknown", name)
    return found


def _node(data: Any, schema: SearchSchema | None) -> Node:
    if not isinstance(data, dict):
        raise SearchValidationError("json.field")
    if "conditions" in data:
        nodes = _nodes(data["conditions"], schema)
        if not nodes:
            raise SearchValidationError("group.empty")
        return Group(nodes, _logic(data))
    if data.get("field") is None:
        raise SearchValidationError("json.field")
    if data.get("searchOperator") is None:
        raise SearchValidationError("json.operator")
    op = Op.named(str(data["searchOperator"]))
    if not op:
        raise SearchValidationError("operator.unknown", data["searchOperator"])
    name = str(data["field"])
    # the path always comes from the schema, never from the client
    return Condition(name, op, _value(data.get("value")), _value(data.get("value2")), _logic(data), schema.resolve(name) if schema else None)


def _nodes(data: Any, schema: SearchSchema | None) -> tuple[Node, ...]:
    if not isinstance(data, list):
        raise SearchValidationError("json.conditions")
    return tuple(_node(n, schema) for n in data)


def _order(data: dict, schema: SearchSchema | None) -> Order:
    name, direction = data.get("field"), str(data.get("direction") or "asc").lower()
    if not name:
        raise SearchValidationError("json.field")
    if direction not in ("asc", "desc"):
        raise SearchValidationError("direction.unknown", data.get("direction"))
    return Order(name, direction == "asc", schema.resolve_sort(name) if schema else None)


def from_json(text: str, schema: SearchSchema | None = None) -> Search:
    """A checked request; groups keep their own logic however many nodes they hold."""
    try:
        data = json.loads(text, parse_float=Decimal)
    except ValueError as e:
        raise SearchParseError("json.invalid", e) from e
    if not isinstance(data, dict):
        raise SearchParseError("json.invalid", type(data).__name__)
    sort = data.get("sort") or {}
    orders = sort.get("orders") if isinstance(sort, dict) else sort
    for key in ("page", "size"):
        if data.get(key) is not None and (not isinstance(data[key], int) or isinstance(data[key], bool)):
            raise SearchParseError("param.number", key)
    request = Search(_nodes(data["conditions"], schema) if data.get("conditions") is not None else (), tuple(_order(o, schema) for o in orders or ()), data.get("page"), data.get("size"))
    if schema:
        validate(schema, request)
    return request


def _plain(value: Any):
    if isinstance(value, (tuple, list, set, frozenset)):
        return [_plain(v) for v in value]
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    return str(value) if isinstance(value, Decimal) else value


def to_json(request: Search) -> str:
    """Indented JSON without empty members; fetch fields stay on the server."""

    def node(n: Node) -> dict:
        if isinstance(n, Group):
            out = {"operator": n.logic and n.logic.value, "conditions": [node(x) for x in n.nodes]}
        else:
            out = {"operator": n.logic and n.logic.value, "field": n.field, "searchOperator": n.op.value, "value": _plain(n.value), "value2": _plain(n.value2)}
        return {k: v for k, v in out.items() if v is not None}

    out: dict[str, Any] = {}
    if request.nodes:
        out["conditions"] = [node(n) for n in request.nodes]
    if request.sort:
        out["sort"] = {"orders": [{"field": o.field, "direction": "asc" if o.ascending else "desc"} for o in request.sort]}
    out |= {k: v for k, v in (("page", request.page), ("size", request.size)) if v is not None}
    return json.dumps(out, indent=2, ensure_ascii=False)
