"""Left joins along dotted paths, each path once, with only the columns needed.

Conditions on one path see the same child row; conditions on different to-many
paths see the cross product of their children.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SearchJoinError
from ..plans.ir import Condition, Group, Logic, Node, Op, Search
from ..sources.catalog import Catalog, Step, column_type


def _mangled(path: str, column: str) -> str:
    return f"__{path}__{column}".replace(".", "__")


@dataclass(frozen=True)
class Joined:
    """The root joined with everything its paths need."""

    df: DataFrame
    columns: dict[str, tuple[Column, T.DataType]]
    fans_out: bool

    def column(self, path: str) -> Column:
        return self.columns[path][0]

    def type(self, path: str) -> T.DataType:
        return self.columns[path][1]


def join_paths(catalog: Catalog, root: str, paths: Iterable[str], df: DataFrame | None = None) -> Joined:
    """Resolves column paths, joining every relation on the way to the left.

    Root columns keep their names; columns of other tables get names of their
    own, so that one table can be joined many times.
    """
    df = catalog.entity(root).df if df is None else df
    wanted: dict[str, set[str]] = {}
    steps: dict[str, Step] = {}
    leaves: dict[str, tuple[str, str]] = {}
    for path in dict.fromkeys(paths):
        hops, column = catalog.walk(root, path)
        if column is None:
            raise SearchJoinError("path.relation", path)
        for s in hops:
            steps.setdefault(s.path, s)
            for own, _ in s.relation.on:
                wanted.setdefault(s.parent, set()).add(own)
        at = hops[-1].path if hops else ""
        wanted.setdefault(at, set()).add(column)
        leaves[path] = (at, column)

    def ref(at: str, column: str) -> Column:
        return F.col(column) if not at else F.col(_mangled(at, column))

    for path in sorted(steps, key=lambda p: p.count(".")):
        s = steps[path]
        target = catalog.entity(s.relation.target)
        keys = [t for _, t in (s.relation.via_on or s.relation.on)]
        columns = sorted(wanted.get(path, set()) | set(keys))
        child = target.df.select(*[F.col(c).alias(_mangled(path, c)) for c in columns])
        if s.relation.via is not None:
            bridge_columns = sorted({b for _, b in s.relation.on} | {b for b, _ in s.relation.via_on})
            # a pair that the bridge names many times still is one relation: roots are made distinct later
            bridge = s.relation.via.select(*[F.col(c).alias(_mangled(path + ".via", c)) for c in bridge_columns])
            df = df.join(bridge, _all(ref(s.parent, own) == F.col(_mangled(path + ".via", b)) for own, b in s.relation.on), "left")
            on = _all(F.col(_mangled(path + ".via", b)) == F.col(_mangled(path, t)) for b, t in s.relation.via_on)
        else:
            on = _all(ref(s.parent, own) == F.col(_mangled(path, t)) for own, t in s.relation.on)
        df = df.join(child, on, "left")
    found = {}
    for path, (at, column) in leaves.items():
        schema = catalog.entity(steps[at].relation.target).df.schema if at else catalog.entity(root).df.schema
        found[path] = (ref(at, column), column_type(schema, column))
    return Joined(df, found, any(s.relation.many for s in steps.values()))


def _all(conditions: Iterable[Column]) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def semi_joins(catalog: Catalog, root: str, request: Search, held: Iterable[str] = ()) -> tuple[dict[str, list[Condition]], list[Node]] | None:
    """Splits a request into conditions per first to-many hop and the rest, when
    each such hop can be a left-semi join: everything is joined by AND at the
    top, no condition on the hop accepts a missing child, and the hop is not
    also needed for a sort (``held`` paths)."""

    def hop(path: str) -> str | None:
        steps, _ = catalog.walk(root, path)
        return steps[0].path if steps and steps[0].relation.many else next((s.path for s in steps if s.relation.many), None)

    busy = {h for p in held if (h := hop(p))}
    by: dict[str, list[Condition]] = {}
    rest: list[Node] = []
    for i, n in enumerate(request.nodes):
        if i and n.logic is Logic.OR:
            return None
        if isinstance(n, Group):
            if any(hop(c.target) for c in Search((n,)).conditions()):
                return None
            rest.append(n)
            continue
        h = hop(n.target)
        if h is None:
            rest.append(n)
        elif "." in h or n.op is Op.IS_NULL or h in busy:
            return None  # a to-one hop before it, or a missing child that counts
        else:
            by.setdefault(h, []).append(n)
    return (by, rest) if by else None
