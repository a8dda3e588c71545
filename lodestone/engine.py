"""The search engine: compiles requests to lazy plans and runs terminals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SearchConfigurationError, SearchOperationError, SearchValidationError
from .functions.columns import bucket_of, epoch_millis
from .functions.values import UTC, coerce, of_spark
from .operators.joins import Joined, join_paths, semi_joins
from .operators.predicates import fold, literal, predicate
from .plans.ir import Condition, Order, Search
from .plans.schema import SearchSchema
from .plans.validate import validate
from .sources.catalog import Catalog, column_type

DEFAULT_SIZE = 20
MAX_BUCKETS = 512
#: A page of at most this many rows is broadcast to fetch what belongs to it.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Page:
    """One page: ``content`` in order; ``total`` counts all matches when asked."""

    content: DataFrame
    number: int
    size: int
    _engine: Engine
    _request: Search

    @cached_property
    def total(self) -> int:
        return self._engine.count(self._request)

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)


class Engine:
    """Searches one entity of a catalog.

    ``zone`` is the application zone of naive date-times and must be the
    session's time zone; ``expand_days`` lets a plain date at the end of a
    range mean the end of that day; ``auto_fetch`` adds to every page the to-one
    relations of the entity, and of the to-many relations that are fetched.
    """

    def __init__(self, catalog: Catalog, entity: str, schema: SearchSchema | None = None, zone: dt.tzinfo = UTC, expand_days: bool = True, auto_fetch: bool = False):
        self.catalog, self.name, self.schema, self.zone, self.expand_days, self.auto_fetch = catalog, entity, schema, zone, expand_days, auto_fetch
        self.entity = catalog.entity(entity)
        self.keys = catalog.keys(entity)

    # compiling

    def _one(self, joined: Joined):
        def one(c: Condition) -> Column:
            kind = joined.type(c.target)
            if not self.expand_days and c.value2 is not None:
                value_type = of_spark(kind)
                c = replace(c, value=coerce(c.value, value_type, self.zone), value2=coerce(c.value2, value_type, self.zone))
            return predicate(c, joined.column(c.target), kind, self.zone)

        return one

    def _filtered(self, request: Search, paths: Iterable[str] = ()) -> Joined:
        """Rows of the root that match, joined with ``paths``; a root may come
        several times if a to-many path had to be joined (``fans_out``)."""
        paths = list(paths)
        split = semi_joins(self.catalog, self.name, request, paths)
        df, nodes = self.entity.df, request.nodes
        if split:
            for hop, conditions in split[0].items():
                df = self._having(df, hop, conditions)
            nodes = tuple(split[1])
        joined = join_paths(self.catalog, self.name, [*(c.target for c in Search(nodes).conditions()), *paths], df)
        where = fold(nodes, self._one(joined))
        return joined if where is None else replace(joined, df=joined.df.where(where))

    def _having(self, df: DataFrame, hop: str, conditions: list[Condition]) -> DataFrame:
        """Roots with a child (along a direct to-many relation) that meets all conditions."""
        relation = self.entity.relation(hop)
        inner = [replace(c, path=c.target[len(hop) + 1 :]) for c in conditions]
        joined = join_paths(self.catalog, relation.target, [c.target for c in inner])
        children = joined.df.where(fold(tuple(replace(c, logic=None) for c in inner), self._one(joined)))
        names = [f"__key{i}" for i in range(len(relation.on))]
        if relation.via is not None:
            ends = children.select(*[F.col(t).alias(f"__end{i}") for i, (_, t) in enumerate(relation.via_on)])
            children = relation.via.join(ends, [F.col(b) == F.col(f"__end{i}") for i, (b, _) in enumerate(relation.via_on)], "left_semi")
        keys = children.select(*[F.col(t).alias(n) for (_, t), n in zip(relation.on, names, strict=True)])
        return df.join(keys, [F.col(own) == F.col(n) for (own, _), n in zip(relation.on, names, strict=True)], "left_semi")

    def orders(self, request: Search) -> tuple[Order, ...]:
        """The request's sort, made total by the primary key."""
        sort = list(request.sort)
        have = {o.target for o in sort}
        return (*sort, *(Order(k) for k in self.keys if k not in have))

    def _key_columns(self) -> list[Column]:
        return [F.col(k).alias(f"__pk{i}") for i, k in enumerate(self.keys)]

    def matched_keys(self, request: Search) -> DataFrame:
        """Distinct primary keys (__pk0, ...) of the matches."""
        joined = self._filtered(request)
        keys = joined.df.select(*self._key_columns())
        return keys.distinct() if joined.fans_out else keys

    def matches(self, request: Search) -> DataFrame:
        """The matching rows of the entity, each once, in no order."""
        joined = self._filtered(request)
        root = joined.df.select(*[F.col(f"`{c}`") for c in self.entity.df.columns])
        return self.entity.df.join(self.matched_keys(request), self._on_keys(), "left_semi") if joined.fans_out else root

    def _on_keys(self) -> list[Column]:
        return [F.col(k) == F.col(f"__pk{i}") for i, k in enumerate(self.keys)]

    # pages

    def _checked(self, request: Search) -> Search:
        if self.schema:
            validate(self.schema, request, self.zone)
        return request

    def page_of(self, request: Search) -> tuple[int, int]:
        """Page (from 0) and size with their defaults; there is no maximum."""
        page = request.page if request.page is not None and request.page >= 0 else 0
        return page, request.size if request.size is not None and request.size > 0 else DEFAULT_SIZE

    def _ranked(self, request: Search) -> tuple[DataFrame, list[Column], bool]:
        """Rows with sort keys __s0, ...; the ordering; whether rows are only keys.

        A sort along a to-many path takes each root's lowest value for ASC and
        highest for DESC, over the children that match.
        """
        orders = self.orders(request)
        joined = self._filtered(request, [o.target for o in orders])
        names = [f"__s{i}" for i in range(len(orders))]
        by = [F.col(n).asc_nulls_first() if o.ascending else F.col(n).desc_nulls_last() for n, o in zip(names, orders, strict=True)]
        values = [joined.column(o.target).alias(n) for n, o in zip(names, orders, strict=True)]
        if not joined.fans_out:
            root = [F.col(f"`{c}`") for c in self.entity.df.columns]
            return joined.df.select(*root, *values), by, False
        best = [(F.min if o.ascending else F.max)(n).alias(n) for n, o in zip(names, orders, strict=True)]
        keys = [f"__pk{i}" for i in range(len(self.keys))]
        return joined.df.select(*self._key_columns(), *values).groupBy(*keys).agg(*best), by, True

    def _content(self, request: Search, offset: int, size: int) -> DataFrame:
        rows, by, keys_only = self._ranked(request)
        rows = rows.orderBy(*by).offset(offset).limit(size)
        if keys_only:
            small = F.broadcast(rows) if size <= BROADCAST_ROWS else rows
            rows = self.entity.df.join(small, self._on_keys(), "inner")
        fetch = self._fetched(request)
        if fetch:
            # what belongs to the page is joined to its rows, not to the search again
            rows = self._fetch(_held(rows) if size <= BROADCAST_ROWS else rows, fetch, size)
        if keys_only or fetch:
            rows = rows.orderBy(*by).limit(size)  # joins do not keep an order
        made = {f"__s{i}" for i in range(len(by))} | ({f"__pk{i}" for i in range(len(self.keys))} if keys_only else set())
        return rows.drop(*made)

    def _fetched(self, request: Search) -> list[str]:
        """The request's fetch paths, with to-one relations if those are added."""
        paths = list(request.fetch)
        if self.auto_fetch:
            for path in ("", *request.fetch):
                steps, _ = self.catalog.walk(self.name, path) if path else ((), None)
                if not path or steps[-1].relation.many:
                    at = self.catalog.entity(steps[-1].relation.target) if path else self.entity
                    paths += [f"{path}.{r.name}".lstrip(".") for r in at.relations if not r.many]
        return list(dict.fromkeys(paths))

    def find_all(self, request: Search) -> Page:
        """The requested page, with fetched relations as nested columns."""
        self._checked(request)
        page, size = self.page_of(request)
        return Page(self._content(request, page * size, size), page, size, self, request)

    def find_all_projected(self, request: Search, view: Iterable[str | Column] | Mapping[str, str]) -> Page:
        """A page of chosen columns; a mapping gives names to SQL expressions."""
        if isinstance(view, Mapping):
            columns: list[Any] = [F.expr(e).alias(n) for n, e in view.items()]
        elif isinstance(view, str) or not isinstance(view, Iterable):
            raise SearchConfigurationError("view.columns", type(view).__name__)
        else:
            columns = list(view)
        page = self.find_all(request)
        return replace(page, content=page.content.select(*columns))

    def _fetch(self, rows: DataFrame, fields: Iterable[str], size: int) -> DataFrame:
        """Adds relations as structs (to-one) or arrays of structs (to-many);
        a dotted path nests inside its parent."""
        tree: dict[str, dict] = {}
        for f in fields:
            at = tree
            for part in f.split("."):
                at = at.setdefault(part, {})
        return _attach(self.catalog, self.name, rows, tree, size)

    # terminals

    def count(self, request: Search) -> int:
        """Distinct matching roots, whatever the page."""
        self._checked(request)
        return self.matched_keys(request).count()

    def exists(self, request: Search) -> bool:
        self._checked(request)
        return not self._filtered(request).df.select(F.lit(1)).isEmpty()

    def find_one(self, request: Search) -> Row | None:
        """The only match, None without one; several are an error.  Page and sort do not count."""
        self._checked(request)
        rows = self.matches(request).limit(2).collect()
        if len(rows) > 1:
            raise SearchOperationError("result.several")
        return rows[0] if rows else None

    def first(self, request: Search) -> DataFrame:
        """The first row of the requested page, as a plan."""
        self._checked(request)
        page, size = self.page_of(request)
        return self._content(request, page * size, 1)

    def find_first(self, request: Search) -> Row | None:
        rows = self.first(request).collect()
        return rows[0] if rows else None

    def _flagged(self, request: Search, counted: bool = False) -> tuple[DataFrame, Column]:
        """All rows of the entity with a flag for the matches; where it is to be
        counted, no constant that would let the optimizer drop the table."""
        if counted and not request.nodes:
            return self.entity.df, F.monotonically_increasing_id() >= 0
        plain = all("." not in c.target or not self.catalog.walk(self.name, c.target)[0] for c in request.conditions())
        if plain:
            joined = join_paths(self.catalog, self.name, [c.target for c in request.conditions()])
            where = fold(request.nodes, self._one(joined))
            return self.entity.df, F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        keys = self.matched_keys(request).withColumn("__hit", F.lit(True))
        return self.entity.df.join(keys, self._on_keys(), "left"), F.coalesce(F.col("__hit"), F.lit(False))

    def delete(self, request: Search, affected: Observation | None = None) -> tuple[DataFrame, DataFrame]:
        """(survivors, matches): the table without the matches, and them.

        ``affected`` counts while the survivors are written: afterwards its
        ``get["affected"]`` is the number deleted."""
        self._checked(request)
        df, hit = self._flagged(request, affected is not None)
        columns = [F.col(f"`{c}`") for c in self.entity.df.columns]
        return _observed(df, hit, affected).where(~hit).select(*columns), df.where(hit).select(*columns)

    def update(self, request: Search, values: Mapping[str, Any] | Any, affected: Observation | None = None) -> DataFrame:
        """The table after setting columns of all matches.  ``values``: a mapping
        or an object whose attributes name columns; None never overwrites, and
        collections are left out.  ``affected`` counts the matches as in ``delete``."""
        self._checked(request)
        data = values if isinstance(values, Mapping) else vars(values)
        df, hit = self._flagged(request, affected is not None)
        new: dict[str, Column] = {}
        for name, value in data.items():
            kind = column_type(self.entity.df.schema, name)
            if kind is None:
                raise SearchValidationError("update.column", self.name, name)
            if value is None or isinstance(value, (list, tuple, set, dict)):
                continue
            new[name] = F.when(hit, literal(coerce(value, of_spark(kind), self.zone), kind)).otherwise(F.col(f"`{name}`"))
        return _observed(df, hit, affected).select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in self.entity.df.columns])

    # time buckets

    def buckets(self, request: Search, axis: str, start: dt.datetime, end: dt.datetime, number: int) -> DataFrame:
        """(bucket, n): matching roots in ``number`` equal parts of [start, end),
        oldest first, parts without a match as 0."""
        self._checked(request)
        first, span = self._window(start, end, number)
        joined = self._filtered(request, [axis])
        millis = self._millis(joined.column(axis))
        part = F.expr(f"div((__ms - {first}L) * {number}L, {span}L)")
        rows = joined.df.select(*self._key_columns(), millis.alias("__ms")).where((F.col("__ms") >= first) & (F.col("__ms") < first + span))
        keyed = rows.select(part.alias("bucket"), *[f"__pk{i}" for i in range(len(self.keys))])
        counted = (keyed.distinct() if joined.fans_out else keyed).groupBy("bucket").agg(F.count("*").alias("n"))
        every = self.entity.df.sparkSession.range(number).withColumnRenamed("id", "bucket")
        return every.join(F.broadcast(counted), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("bucket")

    def bucket_sums(self, request: Search, axis: str, start: dt.datetime, end: dt.datetime, number: int) -> DataFrame:
        """The same counts as one row of conditional sums (b0, b1, ...)."""
        self._checked(request)
        first, span = self._window(start, end, number)
        joined = self._filtered(request, [axis])
        rows = joined.df.select(*self._key_columns(), self._millis(joined.column(axis)).alias("__ms")).where((F.col("__ms") >= first) & (F.col("__ms") < first + span))
        rows = rows.distinct() if joined.fans_out else rows
        part = F.expr(f"div((__ms - {first}L) * {number}L, {span}L)")
        return rows.select(part.alias("b")).agg(*[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(number)])

    def _millis(self, axis: Column) -> Column:
        return epoch_millis(axis)

    def _window(self, start: dt.datetime, end: dt.datetime, number: int) -> tuple[int, int]:
        def millis(t: dt.datetime) -> int:
            aware = t if t.tzinfo else t.replace(tzinfo=self.zone)
            return (aware - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(milliseconds=1)

        first, last = millis(start), millis(end)
        if first >= last:
            raise SearchOperationError("bucket.window")
        if not 1 <= number <= MAX_BUCKETS:
            raise SearchOperationError("bucket.count", MAX_BUCKETS)
        return first, last - first


def _observed(df: DataFrame, hit: Column, affected: Observation | None) -> DataFrame:
    return df.observe(affected, F.count_if(hit).alias("affected")) if affected else df


def _held(page: DataFrame) -> DataFrame:
    """A page of bounded size as a table of its own, read once; types that Arrow
    has no counterpart for stay a plan."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, T.MapType):
            return plain(kind.keyType) and plain(kind.valueType)
        if isinstance(kind, T.StructType):
            return len(kind) > 0 and all(plain(f.dataType) for f in kind)
        return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))

    if not plain(page.schema) or len(set(page.columns)) < len(page.columns):
        return page
    return page.sparkSession.createDataFrame(page.toArrow(), schema=page.schema)


def _attach(catalog: Catalog, name: str, rows: DataFrame, tree: Mapping[str, dict], size: int | None, at: str = "") -> DataFrame:
    """``size``: the most rows there can be; below the first level it is not known,
    and the joins are left to adaptive execution."""
    page = rows
    for part, below in tree.items():
        here = f"{at}__{part}"  # names that no other level of the tree uses
        (step,), _ = catalog.walk(name, part)
        relation = step.relation
        target = catalog.entity(relation.target)
        own = [F.col(o) for o, _ in relation.on]
        names = [f"{here}__f{i}" for i in range(len(own))]
        child = target.df
        wanted = page.select(*[c.alias(n) for c, n in zip(own, names, strict=True)]).distinct()
        wanted = F.broadcast(wanted) if size is not None and size <= BROADCAST_ROWS else wanted
        if relation.via is not None:
            bridge = relation.via.select(*{b: F.col(b).alias(f"{here}__v_{b}") for pair in (relation.on, [(t, b) for b, t in relation.via_on]) for _, b in pair}.values()).distinct()
            child = child.join(bridge, [F.col(t) == F.col(f"{here}__v_{b}") for b, t in relation.via_on])
            keys = [F.col(f"{here}__v_{b}") for _, b in relation.on]
        else:
            keys = [F.col(t) for _, t in relation.on]
        child = child.join(wanted, [k == F.col(n) for k, n in zip(keys, names, strict=True)], "inner")
        child = _attach(catalog, relation.target, child, below, None, here)
        value = F.struct(*[F.col(f"`{c}`") for c in [*target.df.columns, *below]])
        grouped = child.groupBy(*names).agg((F.sort_array(F.collect_list(value)) if relation.many and not below else F.collect_list(value) if relation.many else F.first(value)).alias(f"{here}__value"))
        rows = rows.join(grouped, [o == F.col(n) for o, n in zip(own, names, strict=True)], "left").drop(*names)
        filled = F.coalesce(f"{here}__value", F.array().cast(grouped.schema[f"{here}__value"].dataType)) if relation.many else F.col(f"{here}__value")
        rows = rows.withColumn(part, filled).drop(f"{here}__value")
    return rows
