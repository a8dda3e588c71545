"""Entities: tables with a primary key and declared relations."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SearchConfigurationError, SearchJoinError

Pairs = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Relation:
    """Leads from an entity to ``target``.  ``on``: (own column, target column)
    pairs; with a bridge, ``on`` is (own column, bridge column) and ``via_on``
    (bridge column, target column)."""

    name: str
    target: str
    on: Pairs
    many: bool = False
    via: DataFrame | None = field(default=None, compare=False)
    via_on: Pairs = ()


def to_one(name: str, target: str, *on: tuple[str, str]) -> Relation:
    return Relation(name, target, on)


def to_many(name: str, target: str, *on: tuple[str, str]) -> Relation:
    return Relation(name, target, on, True)


def many_to_many(name: str, target: str, bridge: DataFrame, on: Pairs, via_on: Pairs) -> Relation:
    return Relation(name, target, tuple(on), True, bridge, tuple(via_on))


@dataclass(frozen=True)
class Entity:
    """A DataFrame with its key.  Key columns may be fields of a struct ("id.line")."""

    name: str
    df: DataFrame = field(compare=False)
    pk: tuple[str, ...]
    relations: tuple[Relation, ...] = ()

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name == name), None)


@dataclass(frozen=True)
class Step:
    """One hop of a path: the relation and where it leads."""

    path: str
    parent: str
    relation: Relation


class Catalog:
    """The registered entities, and paths through their relations."""

    def __init__(self, *entities: Entity):
        self._entities: dict[str, Entity] = {}
        for e in entities:
            self.register(e)

    def register(self, entity: Entity) -> Catalog:
        for c in entity.pk:
            if column_type(entity.df.schema, c) is None:
                raise SearchConfigurationError("path.unknown", entity.name, c, c)
        self._entities[entity.name] = entity
        return self

    def entity(self, name: str) -> Entity:
        if name not in self._entities:
            raise SearchConfigurationError("entity.unknown", name)
        return self._entities[name]

    def replace(self, name: str, df: DataFrame) -> Catalog:
        """A catalog in which the entity has other rows."""
        return Catalog(*(replace(e, df=df) if e.name == name else e for e in self._entities.values()))

    def keys(self, name: str) -> tuple[str, ...]:
        pk = self.entity(name).pk
        if not pk:
            raise SearchConfigurationError("entity.key", name)
        return pk

    def walk(self, root: str, path: str) -> tuple[tuple[Step, ...], str | None]:
        """The hops of a dotted path and its column (None: it ends at a relation).

        A name is taken as a column first; what follows a struct column is a
        field of it.
        """
        steps: list[Step] = []
        entity, parts, at = self.entity(root), path.split("."), ""
        for i, part in enumerate(parts):
            rest = ".".join(parts[i:])
            if column_type(entity.df.schema, rest) is not None:
                return tuple(steps), rest
            relation = entity.relation(part)
            if relation is None:
                raise SearchJoinError("path.unknown", entity.name, part, path)
            here = f"{at}.{part}" if at else part
            steps.append(Step(here, at, relation))
            entity, at = self.entity(relation.target), here
        return tuple(steps), None

    def is_valid(self, root: str, path: str) -> bool:
        try:
            self.walk(root, path)
        except SearchJoinError:
            return False
        return True

    def is_to_many(self, root: str, path: str) -> bool:
        """Whether any hop of the path fans out."""
        return any(s.relation.many for s in self.walk(root, path)[0])


def column_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a column or of a field inside struct columns."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def parquet_catalog(spark: SparkSession, folder: str) -> Catalog:
    """The catalog of the test tables: orders, customers, parts and the rest."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    lineitem = read("lineitem")
    return Catalog(
        Entity("region", read("region"), ("r_regionkey",)),
        Entity("nation", read("nation"), ("n_nationkey",), (to_one("region", "region", ("n_regionkey", "r_regionkey")),)),
        Entity("customer", read("customer"), ("c_custkey",), (to_one("nation", "nation", ("c_nationkey", "n_nationkey")), to_many("orders", "orders", ("c_custkey", "o_custkey")))),
        Entity("supplier", read("supplier"), ("s_suppkey",), (to_one("nation", "nation", ("s_nationkey", "n_nationkey")), many_to_many("parts", "part", lineitem, (("s_suppkey", "l_suppkey"),), (("l_partkey", "p_partkey"),)))),
        Entity("part", read("part"), ("p_partkey",), (many_to_many("suppliers", "supplier", lineitem, (("p_partkey", "l_partkey"),), (("l_suppkey", "s_suppkey"),)), to_many("lineitems", "lineitem", ("p_partkey", "l_partkey")))),
        Entity("orders", read("orders"), ("o_orderkey",), (to_one("customer", "customer", ("o_custkey", "c_custkey")), to_many("lineitems", "lineitem", ("o_orderkey", "l_orderkey")))),
        Entity("lineitem", lineitem, (), (to_one("part", "part", ("l_partkey", "p_partkey")), to_one("supplier", "supplier", ("l_suppkey", "s_suppkey")), to_one("order", "orders", ("l_orderkey", "o_orderkey")))),
        Entity("events", read("events"), ("event_id",)),
        Entity("documents", read("documents"), ("doc_id",), (to_one("label", "labels", ("doc_id", "doc_id")),)),
        Entity("labels", read("labels"), ("doc_id",)),
        Entity("conversations", read("conversations"), ("conv_id", "turn"), (to_many("turns", "conversations", ("conv_id", "conv_id")),)),
    )
