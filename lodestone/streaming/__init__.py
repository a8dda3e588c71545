"""Requests on streams: the stateless part of the engine on a streaming DataFrame.

Only conditions on the stream's own columns and along to-one relations are
allowed there (a stream-static left join); pages, distinct counts and to-many
paths need state that a request does not bound.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SearchOperationError
from ..functions.values import UTC
from ..operators.joins import join_paths
from ..operators.predicates import fold, predicate
from ..plans.ir import Search
from ..sources.catalog import Catalog


def matches(catalog: Catalog, name: str, stream: DataFrame, request: Search, zone: dt.tzinfo = UTC) -> DataFrame:
    """The rows of a stream, shaped like the entity ``name``, that match."""
    joined = join_paths(catalog, name, [c.target for c in request.conditions()], stream)
    if joined.fans_out:
        raise SearchOperationError("to-many paths are not available on streams")
    where = fold(request.nodes, lambda c: predicate(c, joined.column(c.target), joined.type(c.target), zone))
    rows = joined.df if where is None else joined.df.where(where)
    return rows.select(*[F.col(f"`{c}`") for c in stream.columns])
