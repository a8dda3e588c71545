"""One query per operator of the engine on the test tables, with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import errors, openapi
from .engine import Engine
from .errors import SearchError, SearchValidationError
from .functions.columns import bucket_of, epoch_millis
from .functions.values import ValueType, date_only, enum, has_zone, parse, parse_bound
from .operators.joins import join_paths
from .plans.builder import SearchBuilder, from_search, search
from .plans.ir import Op, Search
from .plans.schema import SearchSchema, text, typed
from .sources.catalog import parquet_catalog
from .sources.json_request import from_json, to_json
from .sources.params import from_params

Query = Callable[[SparkSession, str], DataFrame]

ORDERS = SearchSchema(
    "orders",
    (
        typed("id", "long", "o_orderkey", sortable=True),
        text("status", "o_orderstatus", sortable=True),
        typed("price", "double", "o_totalprice", sortable=True),
        typed("date", "datetime", "o_orderdate", sortable=True),
        text("priority", "o_orderpriority", sortable=True),
        text("segment", "customer.c_mktsegment", sortable=True),
        text("customerName", "customer.c_name", sortable=True, sort_path="customer.c_custkey"),
        text("nation", "customer.nation.n_name", sortable=True),
        text("region", "customer.nation.region.r_name", sortable=True),
        typed("quantity", "double", "lineitems.l_quantity", sortable=True),
        text("returnFlag", "lineitems.l_returnflag"),
        typed("line", "int", "lineitems.l_linenumber"),
        text("brand", "lineitems.part.p_brand"),
        text("partName", "lineitems.part.p_name"),
        text("supplierNation", "lineitems.supplier.nation.n_name"),
    ),
)

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _engine(spark: SparkSession, folder: str, entity: str = "orders", schema: SearchSchema | None = ORDERS) -> Engine:
    return Engine(parquet_catalog(spark, folder), entity, schema if entity == "orders" else None)


def _add(name: str, query: Query, sql: str | None) -> None:
    _queries[name] = query
    if sql:
        _sql[name] = sql


def _rows(name: str, request: Callable[[], Search], where: str, entity: str = "orders", columns: str = _ORDER, source: str | None = None) -> None:
    """All matches of a request, some columns; SQL by its WHERE clause."""
    cols = [c.strip() for c in columns.split(",")]
    _add(name, lambda s, d: _engine(s, d, entity).matches(request()).select(*cols), f"SELECT {columns} FROM {source or entity} WHERE {where}")


def _w(fill) -> Callable[[], Search]:
    return lambda: search(ORDERS).where(fill).build()


def _plain(fill) -> Callable[[], Search]:
    return lambda: search().where(fill).build()


def _page(name: str, request: Callable[[], Search], sql: str, columns: str = _ORDER, entity: str = "orders") -> None:
    cols = [c.strip() for c in columns.split(",")]
    _add(name, lambda s, d: _engine(s, d, entity).find_all(request()).content.select(*cols), sql)


def _one_row(spark: SparkSession, name: str, value, kind: str = "long") -> DataFrame:
    return spark.createDataFrame([(value,)], f"{name} {kind}")


# comparison operators

_rows("op_equals", _w(lambda w: w.equals("status", "F")), "o_orderstatus = 'F'")
_rows("op_not_equals", _w(lambda w: w.not_equals("priority", "1-URGENT")), "o_orderpriority <> '1-URGENT'")
_rows("op_greater_than", _w(lambda w: w.greater_than("price", 200000.0)), "o_totalprice > 200000")
_rows("op_greater_than_or_equal", _w(lambda w: w.greater_than_or_equal_to("date", "1996-01-01")), "o_orderdate >= TIMESTAMP '1996-01-01'")
_rows("op_less_than", _w(lambda w: w.less_than("price", "50,000.5")), "o_totalprice < 50000.5")
_rows("op_less_than_or_equal", _w(lambda w: w.less_than_or_equal_to("id", 500)), "o_orderkey <= 500")
_rows("op_contains", _plain(lambda w: w.contains("p_name", "ring")), "contains(p_name, 'ring')", "part", "p_partkey, p_name")
_rows("op_not_contains", _plain(lambda w: w.not_contains("p_name", "a")), "NOT contains(p_name, 'a')", "part", "p_partkey, p_name")
_rows("op_starts_with", _plain(lambda w: w.starts_with("p_type", "S")), "starts_with(p_type, 'S')", "part", "p_partkey, p_type")
_rows("op_not_starts_with", _plain(lambda w: w.not_starts_with("p_brand", "Brand#1")), "NOT starts_with(p_brand, 'Brand#1')", "part", "p_partkey, p_brand")
_rows("op_ends_with", _plain(lambda w: w.ends_with("c_name", "7")), "suffix(c_name, '7')", "customer", "c_custkey, c_name")
_rows("op_not_ends_with", _plain(lambda w: w.not_ends_with("c_name", "0")), "NOT suffix(c_name, '0')", "customer", "c_custkey, c_name")
_rows("op_is_null", _w(lambda w: w.is_null("line")), "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_rows("op_is_not_null", _w(lambda w: w.is_not_null("line")), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_rows("op_in", _w(lambda w: w.in_("priority", ["1-URGENT", "2-HIGH"])), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_rows("op_not_in", _w(lambda w: w.not_in("segment", ["BUILDING", "MACHINERY"])), "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))")
_rows("op_between", _w(lambda w: w.between("date", "1995-01-01", "1995-06-30")), "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30 23:59:59.999999'")
_rows("op_not_between", _w(lambda w: w.not_between("price", 20000.0, 400000.0)), "NOT (o_totalprice BETWEEN 20000 AND 400000)")

# logic

_rows("bool_and", _w(lambda w: w.equals("status", "O").greater_than("price", 300000.0)), "o_orderstatus = 'O' AND o_totalprice > 300000")
_rows("bool_or", _w(lambda w: w.equals("status", "P").or_greater_than("price", 400000.0)), "o_orderstatus = 'P' OR o_totalprice > 400000")
_rows("bool_fold", _w(lambda w: w.equals("status", "P").or_greater_than("price", 100000.0).starts_with("priority", "1")), "(o_orderstatus = 'P' OR o_totalprice > 100000) AND starts_with(o_orderpriority, '1')")
_rows("bool_group", _w(lambda w: w.equals("status", "F").and_(lambda g: g.less_than("price", 30000.0).or_(lambda h: h.greater_than("price", 300000.0).starts_with("priority", "5")))), "o_orderstatus = 'F' AND (o_totalprice < 30000 OR (o_totalprice > 300000 AND starts_with(o_orderpriority, '5')))")
_rows("bool_or_flat", _w(lambda w: w.equals("id", 1).or_equals("id", 2).or_between("id", 10, 20).or_in_("id", [30, 31]).or_less_than("price", 2000.0).or_is_null("line")), "o_orderkey IN (1, 2, 30, 31) OR o_orderkey BETWEEN 10 AND 20 OR o_totalprice < 2000 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_rows("bool_not", _w(lambda w: w.not_in("status", ["O", "F"]).not_contains("priority", "LOW")), "NOT (o_orderstatus IN ('O', 'F')) AND NOT contains(o_orderpriority, 'LOW')")

# scans, sources, sinks

_add("scan_entity", lambda s, d: _engine(s, d).matches(Search()).select(*_ORDER.split(", ")), f"SELECT {_ORDER} FROM orders")
_JSON = '{"conditions": [{"searchOperator": "equals", "field": "status", "value": "O"}, {"conditions": [{"searchOperator": "greaterThan", "field": "price", "value": 350000}], "operator": "or"}, {"operator": "and", "searchOperator": "in", "field": "priority", "value": ["1-URGENT", "3-MEDIUM"]}]}'
_JSON_WHERE = "(o_orderstatus = 'O' OR o_totalprice > 350000) AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')"
_rows("source_json", lambda: from_json(_JSON, ORDERS), _JSON_WHERE)
_rows("sink_json", lambda: from_json(to_json(from_json(_JSON, ORDERS)), ORDERS), _JSON_WHERE)
_page(
    "source_params",
    lambda: from_params({"segment.equals": "BUILDING", "date.between": "1995-01-01,1995-12-31", "price.greaterThan": "150000", "sort": "price.desc", "page": "1", "size": "25"}, ORDERS),
    f"SELECT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31 23:59:59.999999' AND o_totalprice > 150000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25",
)
_rows("source_builder", lambda: search(ORDERS).where(lambda w: w.equals("status", "F")).or_(lambda g: g.equals("status", "P").greater_than("price", 250000.0)).build(), "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 250000")

# projections and names

_rows("field_resolve", _w(lambda w: w.equals("region", "ASIA").equals("status", "O")), "o_orderstatus = 'O' AND r_name = 'ASIA'", source="orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_page("sort_resolve", lambda: search(ORDERS).where(lambda w: w.equals("status", "F")).sort(lambda s: s.desc("customerName")).page(0).size(30).build(), f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey DESC NULLS LAST, o_orderkey LIMIT 30")
_add(
    "project_view",
    lambda s, d: _engine(s, d).find_all_projected(search(ORDERS).where(lambda w: w.equals("status", "O")).sort(lambda o: o.asc("date")).page(0).size(50).build(), {"id": "o_orderkey", "label": "concat(o_orderstatus, '-', o_orderpriority)", "price": "o_totalprice"}).content,
    "SELECT o_orderkey AS id, o_orderstatus || '-' || o_orderpriority AS label, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50",
)
_add("project_pk", lambda s, d: _engine(s, d).matched_keys(_w(lambda w: w.equals("returnFlag", "R").or_equals("status", "P"))()).select(F.col("__pk0").alias("o_orderkey")), "SELECT DISTINCT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' OR o_orderstatus = 'P'")
_rows("distinct_root", _w(lambda w: w.greater_than("quantity", 45.0).or_less_than("price", 3000.0)), "o_totalprice < 3000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")

# joins

_rows("join_to_one", _w(lambda w: w.equals("segment", "AUTOMOBILE")), "c_mktsegment = 'AUTOMOBILE'", source="orders JOIN customer ON o_custkey = c_custkey")
_rows("join_to_one_chain", _w(lambda w: w.in_("region", ["EUROPE", "AFRICA"]).greater_than("price", 200000.0)), "r_name IN ('EUROPE', 'AFRICA') AND o_totalprice > 200000", source="orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_rows("join_to_many", _w(lambda w: w.equals("returnFlag", "R")), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
_rows("join_many_to_many", _plain(lambda w: w.equals("suppliers.nation.n_name", "NATION_6").or_equals("p_size", 1)), "p_size = 1 OR EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey = p_partkey AND n_name = 'NATION_6')", "part", "p_partkey, p_name")
_rows("join_many_to_many_semi", _plain(lambda w: w.less_than("suppliers.s_acctbal", 0.0)), "EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal < 0)", "part", "p_partkey, p_name")
_rows("join_to_many_to_one", _w(lambda w: w.starts_with("brand", "Brand#2").equals("supplierNation", "NATION_3")), "EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey = o_orderkey AND starts_with(p_brand, 'Brand#2') AND n_name = 'NATION_3')")
_rows("join_reuse", _w(lambda w: w.equals("returnFlag", "R").greater_than("quantity", 48.0)), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 48)")
_rows("join_reuse_none", _w(lambda w: w.equals("returnFlag", "R").equals("returnFlag", "A")), "false")
_rows("join_negated_child", _w(lambda w: w.not_contains("partName", "ring")), "EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND NOT contains(p_name, 'ring'))")
_add(
    "fetch_join",
    lambda s, d: _engine(s, d).find_all(search(ORDERS).where(lambda w: w.equals("status", "P")).sort(lambda o: o.desc("price")).page(0).size(40).fetch_fields("customer.nation", "lineitems").build()).content.select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"), F.size("lineitems").cast("long").alias("items"), F.round(F.aggregate("lineitems", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("quantity")),
    "WITH p AS (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40) SELECT o_orderkey, any_value(c_name) AS c_name, any_value(n_name) AS n_name, count(l_orderkey) AS items, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM p LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
)
_add(
    "fetch_auto",
    lambda s, d: Engine(parquet_catalog(s, d), "orders", ORDERS, auto_fetch=True).find_all(search(ORDERS).where(lambda w: w.equals("status", "P")).sort(lambda o: o.desc("price")).page(1).size(40).fetch_fields("lineitems").build()).content.select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.array_max("lineitems.part.p_name").alias("part"), F.array_min("lineitems.supplier.s_suppkey").alias("supplier")),
    "WITH p AS (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 40) SELECT o_orderkey, any_value(c_name) AS c_name, max(p_name) AS part, min(s_suppkey) AS supplier FROM p LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY o_orderkey",
)
_add(
    "path_cardinality",
    lambda s, d: s.createDataFrame([(p, _engine(s, d).catalog.is_to_many("orders", p)) for p in ("customer.c_name", "customer.nation.n_name", "lineitems.l_tax", "lineitems.part.p_name", "customer.orders.o_orderkey")], "path string, many boolean"),
    "SELECT * FROM (VALUES ('customer.c_name', false), ('customer.nation.n_name', false), ('lineitems.l_tax', true), ('lineitems.part.p_name', true), ('customer.orders.o_orderkey', true)) t(path, many)",
)
_add(
    "path_validate",
    lambda s, d: s.createDataFrame([(p, _engine(s, d).catalog.is_valid("orders", p)) for p in ("customer.c_name", "customer.nope", "nope.c_name", "lineitems.part.p_brand")], "path string, valid boolean"),
    "SELECT * FROM (VALUES ('customer.c_name', true), ('customer.nope', false), ('nope.c_name', false), ('lineitems.part.p_brand', true)) t(path, valid)",
)
_add("extract_join_paths", lambda s, d: s.createDataFrame([(p,) for p in sorted(_w(lambda w: w.equals("region", "ASIA").or_(lambda g: g.equals("brand", "x").equals("status", "O")))().paths())], "path string"), "SELECT * FROM (VALUES ('customer.nation.region'), ('lineitems.part')) t(path)")
_add("pk_resolve", lambda s, d: s.createDataFrame([(n, ",".join(_engine(s, d).catalog.keys(n))) for n in ("orders", "conversations")], "entity string, pk string"), "SELECT * FROM (VALUES ('orders', 'o_orderkey'), ('conversations', 'conv_id,turn')) t(entity, pk)")
_add("join_regular_only", lambda s, d: join_paths(parquet_catalog(s, d), "orders", ["customer.nation.n_name", "o_orderkey"]).df.select("o_orderkey", F.col("__customer__nation__n_name").alias("n_name")), "SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
_page(
    "semi_by_ids",
    lambda: search(ORDERS).where(lambda w: w.equals("returnFlag", "R").or_equals("status", "P")).sort(lambda s: s.desc("price")).page(2).size(500).build(),
    f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 1000",
)
_page(
    "semi_by_composite_ids",
    lambda: search().where(lambda w: w.equals("role", "user").or_is_null("turns.text")).sort(lambda s: s.desc("turns.turn")).page(1).size(30).build(),
    "SELECT c.conv_id, c.turn, any_value(c.role) AS role FROM conversations c LEFT JOIN conversations t ON t.conv_id = c.conv_id WHERE c.role = 'user' OR t.text IS NULL GROUP BY c.conv_id, c.turn ORDER BY max(t.turn) DESC NULLS LAST, c.conv_id, c.turn LIMIT 30 OFFSET 30",
    "conv_id, turn, role",
    "conversations",
)

# counts

_add("agg_count", lambda s, d: _one_row(s, "n", _engine(s, d).count(_w(lambda w: w.greater_than("price", 100000.0))())), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
_add("agg_count_distinct_pk", lambda s, d: _one_row(s, "n", _engine(s, d).count(_w(lambda w: w.greater_than("quantity", 30.0).or_equals("status", "P"))())), "SELECT count(DISTINCT o_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 30 OR o_orderstatus = 'P'")
_add("agg_count_distinct_composite", lambda s, d: _one_row(s, "n", _engine(s, d, "conversations").count(_plain(lambda w: w.equals("turns.role", "assistant").or_equals("turn", 0))())), "SELECT count(*) AS n FROM (SELECT DISTINCT c.conv_id, c.turn FROM conversations c LEFT JOIN conversations t ON t.conv_id = c.conv_id WHERE t.role = 'assistant' OR c.turn = 0)")
for _name, _dir, _fn, _nulls in (("agg_min_sort", "asc", "min", "ASC NULLS FIRST"), ("agg_max_sort", "desc", "max", "DESC NULLS LAST")):
    _page(
        _name,
        (lambda direction: lambda: search(ORDERS).where(lambda w: w.equals("status", "F")).sort(lambda s: getattr(s, direction)("quantity")).page(0).size(60).build())(_dir),
        f"SELECT o_orderkey, any_value(o_custkey) AS o_custkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey ORDER BY {_fn}(l_quantity) {_nulls}, o_orderkey LIMIT 60",
    )
_add("agg_group_by_pk", lambda s, d: _engine(s, d)._ranked(search(ORDERS).where(lambda w: w.equals("returnFlag", "R")).sort(lambda o: o.asc("quantity")).build())[0].select(F.col("__pk0").alias("o_orderkey"), F.col("__s0").alias("lowest")), "SELECT o_orderkey, min(l_quantity) AS lowest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey")

_FROM, _TO = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 24, 7, 30)
_BUCKET = "(((epoch_us(ts) // 1000) - epoch_ms(TIMESTAMP '2024-01-03')) * {n}) // (epoch_ms(TIMESTAMP '2024-01-24 07:30:00') - epoch_ms(TIMESTAMP '2024-01-03'))"
_INSIDE = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-24 07:30:00'"
_add(
    "bucket_count_group",
    lambda s, d: _engine(s, d, "events").buckets(_plain(lambda w: w.greater_than("value", 20.0))(), "ts", _FROM, _TO, 37),
    f"SELECT b.range AS bucket, coalesce(n, 0) AS n FROM range(37) b LEFT JOIN (SELECT {_BUCKET.format(n=37)} AS bucket, count(*) AS n FROM events WHERE value > 20 AND {_INSIDE} GROUP BY 1) c ON c.bucket = b.range",
)
_add(
    "bucket_count_sums",
    lambda s, d: _engine(s, d, "events").bucket_sums(_plain(lambda w: w.greater_than("value", 20.0))(), "ts", _FROM, _TO, 4),
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE bucket = {i}) AS b{i}" for i in range(4)) + f" FROM (SELECT {_BUCKET.format(n=4)} AS bucket FROM events WHERE value > 20 AND {_INSIDE})",
)
_add(
    "bucket_count_to_many",
    lambda s, d: _engine(s, d).buckets(_w(lambda w: w.greater_than("quantity", 40.0).or_equals("status", "P"))(), "o_orderdate", dt.datetime(1995, 1, 1), dt.datetime(1997, 1, 1), 24),
    "SELECT b.range AS bucket, coalesce(n, 0) AS n FROM range(24) b LEFT JOIN (SELECT (((epoch_us(o_orderdate) // 1000) - epoch_ms(TIMESTAMP '1995-01-01')) * 24) // (epoch_ms(TIMESTAMP '1997-01-01') - epoch_ms(TIMESTAMP '1995-01-01')) AS bucket, count(DISTINCT o_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE (l_quantity > 40 OR o_orderstatus = 'P') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) c ON c.bucket = b.range",
)

# sorts and pages

_page("sort_multi", lambda: search(ORDERS).sort(lambda s: s.asc("priority").desc("price")).page(0).size(100).build(), f"SELECT {_ORDER} FROM orders ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
_page("sort_pk_tiebreak", lambda: search(ORDERS).sort(lambda s: s.asc("status")).page(3).size(25).build(), f"SELECT {_ORDER} FROM orders ORDER BY o_orderstatus NULLS FIRST, o_orderkey LIMIT 25 OFFSET 75")
_page("sort_nested", lambda: search(ORDERS).sort(lambda s: s.desc("nation").asc("price")).page(1).size(50).build(), f"SELECT {_ORDER} FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC NULLS LAST, o_totalprice NULLS FIRST, o_orderkey LIMIT 50 OFFSET 50")
_page(
    "sort_to_many",
    lambda: search(ORDERS).where(lambda w: w.equals("returnFlag", "R")).sort(lambda s: s.desc("quantity")).page(2).size(20).build(),
    "SELECT o_orderkey, any_value(o_custkey) AS o_custkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey ORDER BY max(l_quantity) DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40",
)
_page("page_offset_limit", lambda: search(ORDERS).where(lambda w: w.equals("status", "O")).sort(lambda s: s.desc("date")).page(7).size(33).build(), f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 33 OFFSET 231")
_page("page_large", lambda: search(ORDERS).sort(lambda s: s.desc("date").desc("id")).page(0).size(100).build(), f"SELECT {_ORDER} FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
_page("page_defaults", lambda: search(ORDERS).where(lambda w: w.equals("status", "O")).build(), f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20")
_add("page_total", lambda s, d: _one_row(s, "n", _engine(s, d).find_all(search(ORDERS).where(lambda w: w.equals("status", "P")).page(10_000).size(20).build()).total), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
_page("page_past_end", lambda: search(ORDERS).where(lambda w: w.equals("status", "P")).page(10_000).size(20).build(), f"SELECT {_ORDER} FROM orders WHERE false")
_add(
    "page_reorder",
    lambda s, d: _engine(s, d).find_all(search(ORDERS).where(lambda w: w.equals("returnFlag", "A").or_equals("status", "P")).sort(lambda o: o.desc("quantity")).page(0).size(30).fetch_fields("lineitems").build()).content.select(F.monotonically_increasing_id().alias("position"), "o_orderkey"),
    "SELECT row_number() OVER (ORDER BY q DESC NULLS LAST, o_orderkey) - 1 AS position, o_orderkey FROM (SELECT o_orderkey, max(l_quantity) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' OR o_orderstatus = 'P' GROUP BY o_orderkey) ORDER BY position LIMIT 30",
)

# functions

_add("fn_epoch_millis", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", epoch_millis(F.col("ts")).alias("ms")), "SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events")
_rows("fn_json_as_text", _plain(lambda w: w.contains("props", '"k": 6').ends_with("props", "}")), "contains(props, '\"k\": 6') AND suffix(props, '}')", "events", "event_id, props")
_rows("fn_like_escape", _plain(lambda w: w.contains("p_brand", "#1_").or_contains("p_brand", "%").or_contains("p_brand", "#3")), "p_brand LIKE '%#1\\_%' ESCAPE '\\' OR p_brand LIKE '%\\%%' ESCAPE '\\' OR p_brand LIKE '%#3%'", "part", "p_partkey, p_brand")

# terminals

_page("find_all", lambda: search(ORDERS).where(lambda w: w.equals("segment", "BUILDING").greater_than("price", 200000.0)).sort(lambda s: s.desc("date")).page(0).size(20).build(), f"SELECT {_ORDER} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
_add("find_all_projected", lambda s, d: _engine(s, d).find_all_projected(search(ORDERS).where(lambda w: w.equals("status", "F")).page(1).size(10).build(), ["o_orderkey", "o_totalprice"]).content, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10 OFFSET 10")
_add("find_one", lambda s, d: s.createDataFrame([_engine(s, d).find_one(_w(lambda w: w.equals("id", 42))())[0:2]], "o_orderkey long, o_custkey long"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42")
_add("find_first", lambda s, d: _engine(s, d).first(search(ORDERS).where(lambda w: w.equals("status", "O")).sort(lambda o: o.desc("price")).page(2).size(10).build()).select(*_ORDER.split(", ")), f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 20")
_add("count", lambda s, d: _one_row(s, "n", _engine(s, d).count(_w(lambda w: w.equals("returnFlag", "R").starts_with("brand", "Brand#3"))())), "SELECT count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND starts_with(p_brand, 'Brand#3')")
_add("exists", lambda s, d: s.createDataFrame([(_engine(s, d).exists(_w(lambda w: w.equals("status", "P"))()), _engine(s, d).exists(_w(lambda w: w.equals("status", "?"))()))], "some boolean, none boolean"), "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS some, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = '?') AS none")
_DELETE = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
_add("delete", lambda s, d: _engine(s, d).delete(_w(lambda w: w.equals("returnFlag", "R"))())[0].select(*_ORDER.split(", ")), f"SELECT {_ORDER} FROM orders WHERE NOT {_DELETE}")


def _affected(s: SparkSession, run: Callable[[Observation], DataFrame]) -> DataFrame:
    """Rows that a delete or an update met, counted while its result was written."""
    affected = Observation()
    run(affected).write.format("noop").mode("overwrite").save()
    return _one_row(s, "n", affected.get["affected"])


_add("delete_affected", lambda s, d: _affected(s, lambda o: _engine(s, d).delete(_w(lambda w: w.equals("returnFlag", "R"))(), o)[0]), f"SELECT count(*) AS n FROM orders WHERE {_DELETE}")
_add("update_affected", lambda s, d: _affected(s, lambda o: _engine(s, d).update(_w(lambda w: w.equals("segment", "BUILDING"))(), {"o_orderstatus": "X"}, o)), "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_add("sink_delete", lambda s, d: _engine(s, d).delete(_w(lambda w: w.less_than("price", 100000.0))())[0].groupBy("o_orderstatus").agg(F.count("*").alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT o_totalprice < 100000 GROUP BY 1")
_add("update", lambda s, d: _engine(s, d).update(_w(lambda w: w.equals("segment", "BUILDING"))(), {"o_orderstatus": "X", "o_orderpriority": None}).select("o_orderkey", "o_orderstatus", "o_orderpriority"), "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
_add("sink_update", lambda s, d: _engine(s, d).update(_w(lambda w: w.greater_than("price", 150000.0))(), {"o_totalprice": "0"}).groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") == 0).alias("n")), "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS n FROM orders GROUP BY 1")
_add("update_map_dto", lambda s, d: _engine(s, d, "documents").update(_plain(lambda w: w.is_null("label.quality"))(), type("Payload", (), {"__init__": lambda self: setattr(self, "lang", "xx")})()).select("doc_id", "lang"), "SELECT documents.doc_id, CASE WHEN labels.doc_id IS NULL THEN 'xx' ELSE lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)")

# requests

_rows("ir_and_or_top", lambda: search(ORDERS).where(lambda w: w.equals("status", "P")).and_(lambda g: g.less_than("price", 50000.0).or_greater_than("price", 300000.0)).build(), "(o_orderstatus = 'P' AND o_totalprice < 50000) OR o_totalprice > 300000")
_rows("ir_and_or_chained", lambda: search(ORDERS).where(lambda w: w.equals("status", "P")).page(0).size(5).and_(lambda g: g.less_than("price", 50000.0).or_greater_than("price", 300000.0)).build(), "o_orderstatus = 'P' AND (o_totalprice < 50000 OR o_totalprice > 300000)")
_rows("ir_params_split", lambda: from_params({"priority.in": "1-URGENT,5-LOW", "price.notBetween": "10000,300000", "status.notEquals": "P"}, ORDERS), "o_orderpriority IN ('1-URGENT', '5-LOW') AND NOT (o_totalprice BETWEEN 10000 AND 300000) AND o_orderstatus <> 'P'")
_rows("ir_json_group_flatten", lambda: from_json('{"conditions": [{"searchOperator": "equals", "field": "status", "value": "P"}, {"conditions": [{"conditions": [{"searchOperator": "lessThan", "field": "price", "value": "5000"}], "operator": "or"}], "operator": "or"}]}', ORDERS), "o_orderstatus = 'P' OR o_totalprice < 5000")


# values, requests, checks, documentation: what the driver computes, as rows


def _facts(name: str, columns: str, rows: Callable[[], list[tuple]], sql_rows: list[tuple]) -> None:
    """Rows made on the driver, against the same rows written as SQL values."""
    names = [c.split()[0] for c in columns.split(", ")]

    def value(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in sql_rows)
    casts = ", ".join(f"CAST({n} AS {'BIGINT' if c.endswith('long') else 'BOOLEAN' if c.endswith('boolean') else 'VARCHAR'}) AS {n}" for n, c in zip(names, columns.split(", "), strict=True))
    _add(name, lambda s, d: s.createDataFrame(rows(), columns), f"SELECT {casts} FROM (VALUES {body}) t({', '.join(names)})")


def _parsed(name: str, kind: str, cases: list[tuple[str | None, str | None]], parser=None) -> None:
    """A parser's results as text; an error gives '!'."""

    def run() -> list[tuple]:
        out = []
        for given, _ in cases:
            try:
                v = parser(given) if parser else parse(given, ValueType(kind))
            except SearchError:
                v = "!"
            out.append((given, None if v is None else str(v)))
        return out

    _facts(name, "given string, parsed string", run, cases)


_parsed("parse_datetime", "datetime", [("2024-03-05T12:30:15", "2024-03-05 12:30:15"), ("2024/03/05 12:30:15", "2024-03-05 12:30:15"), ("20240305123015", "2024-03-05 12:30:15"), ("2024-03-05T12:30:15+09:00", "2024-03-05 03:30:15"), ("2024-03-05", "2024-03-05 00:00:00"), ("soon", "!")])
_parsed("parse_zone_detect", "", [("2024-03-05T12:30:15Z", "True"), ("2024-03-05T12:30:15+09:00", "True"), ("2024-03-05T12:30:15", "False"), ("2024-03-05", "False")], has_zone)
_parsed("parse_date", "date", [("2024-03-05", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("2024.03.05", "2024-03-05"), ("20240305", "2024-03-05"), ("2024-02-30", "!")])
_parsed("parse_time", "time", [("08:05:09", "08:05:09"), ("8:05", "08:05:00"), ("0805", "08:05:00"), ("080509", "08:05:09"), ("24:00", "!")])
_parsed("parse_instant", "timestamp", [("2024-03-05T12:30:15Z", "2024-03-05 12:30:15+00:00"), ("2024-03-05T12:30:15+02:00", "2024-03-05 12:30:15+02:00"), ("Tue, 5 Mar 2024 12:30:15 GMT", "2024-03-05 12:30:15+00:00"), ("never", "!")])
_parsed("parse_between_bounds", "", [("2024-03-05", "2024-03-05 23:59:59.999999"), ("2024-03-05T10:00:00", "2024-03-05 10:00:00")], lambda t: parse_bound(t, ValueType("datetime"), True))
_parsed("parse_date_only", "", [("2024-03-05", "2024-03-05"), ("2024-03-05T00:00:00", None), ("20240305", "2024-03-05")], date_only)
_parsed("parse_numeric", "int", [("1,234", "1234"), ("-7", "-7"), ("2147483648", "!"), ("1.5", "!")])
_parsed("parse_boolean", "boolean", [("yes", "True"), ("OFF", "False"), ("1", "True"), ("2", "!")])
_parsed("parse_enum", "", [("draft", "DRAFT"), ("Live", "Live"), ("gone", "!")], lambda t: parse(t, enum("DRAFT", "Live")))
_parsed("parse_char", "char", [("x", "x"), ("xy", "!")])
_parsed("parse_uuid", "uuid", [("0000000A-0000-0000-0000-00000000000F", "0000000a-0000-0000-0000-00000000000f"), ("x", "!")])
_parsed("parse_null", "int", [("null", None), (" ", None), (None, None), ("5", "5")])

_rows("ir_where", lambda: search(ORDERS).where(lambda w: w.equals("status", "O")).where(lambda w: w.where(lambda v: v.less_than("price", 90000.0)).starts_with("priority", "2")).build(), "o_orderstatus = 'O' AND o_totalprice < 90000 AND starts_with(o_orderpriority, '2')")
_rows("ir_and_or_nested", _w(lambda w: w.equals("status", "F").or_(lambda g: g.less_than("price", 20000.0).and_(lambda h: h.starts_with("priority", "1").or_starts_with("priority", "2"))).and_(lambda g: g)), "o_orderstatus = 'F' OR (o_totalprice < 20000 AND (starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2')))")
_rows("ir_first_op_null", _w(lambda w: w.or_equals("status", "P").greater_than("price", 100000.0)), "o_orderstatus = 'P' AND o_totalprice > 100000")
_rows("ir_from", lambda: from_search(_w(lambda w: w.equals("status", "O"))(), ORDERS).where(lambda w: w.greater_than("price", 250000.0)).build(), "o_orderstatus = 'O' AND o_totalprice > 250000")
_page("ir_sort", lambda: search(ORDERS).sort(lambda s: s.asc("price")).sort(lambda s: s.desc("id")).build(), f"SELECT {_ORDER} FROM orders ORDER BY o_orderkey DESC LIMIT 20")
_page("ir_page_size", lambda: search(ORDERS).page(2).size(7).build(), f"SELECT {_ORDER} FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 14")
_add("ir_fetch_fields", lambda s, d: _engine(s, d).find_all(search(ORDERS).page(0).size(5).fetch_fields("customer").build()).content.select("o_orderkey", F.col("customer.c_name").alias("c_name")), "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 5")
_rows("ir_json_values", lambda: from_json('{"conditions": [{"searchOperator": "in", "field": "id", "value": [1, "2", 3]}]}', ORDERS), "o_orderkey IN (1, 2, 3)")
_page("ir_params_grammar", lambda: from_params({"status.equals": "P", "price.lessThan": "90000", "sort": "priority.asc,price.desc", "page": "0", "size": "10"}, ORDERS), f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 90000 ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")

_CHECKED = SearchSchema("checked", (typed("n", "int", None, Op.EQUALS, Op.BETWEEN, Op.IN, Op.IS_NULL, minimum=0), text("s", None, min_length=2, max_length=4), typed("j", "json")))


def _problems(name: str, cases: list[tuple[str, Callable[[SearchBuilder], SearchBuilder], int]]) -> None:
    """How many problems a request has."""

    def run() -> list[tuple]:
        out = []
        for label, fill, _ in cases:
            try:
                fill(search(_CHECKED)).build()
                out.append((label, 0))
            except SearchValidationError as e:
                out.append((label, len(e.problems)))
        return out

    _facts(name, "label string, problems long", run, [(label, n) for label, _, n in cases])


_problems("field_whitelist", [("unknown", lambda b: b.where(lambda w: w.equals("x", 1)), 1), ("operator", lambda b: b.where(lambda w: w.less_than("n", 1)), 1), ("sort", lambda b: b.sort(lambda s: s.asc("n")), 1), ("all", lambda b: b.where(lambda w: w.equals("x", 1).less_than("n", 1)).sort(lambda s: s.asc("n")), 3)])
_problems("ir_validate", [("good", lambda b: b.where(lambda w: w.equals("n", "5")).page(0).size(1), 0), ("bad", lambda b: b.where(lambda w: w.equals("n", "x")), 1)])
_problems("val_page", [("page only", lambda b: b.page(1), 1), ("negative", lambda b: b.page(-1).size(1), 1), ("size", lambda b: b.page(0).size(0), 1)])
_problems("val_null", [("null", lambda b: b.where(lambda w: w.equals("n", None)), 1), ("is null", lambda b: b.where(lambda w: w.is_null("n")), 0)])
_problems("val_between2", [("one end", lambda b: b.where(lambda w: w.between("n", 1)), 1), ("two ends", lambda b: b.where(lambda w: w.between("n", 1, 2)), 0), ("bad end", lambda b: b.where(lambda w: w.between("n", 1, "x")), 1)])
_problems("val_collection", [("scalar", lambda b: b.where(lambda w: w.in_("n", 1)), 1), ("empty", lambda b: b.where(lambda w: w.in_("n", [])), 1), ("bad item", lambda b: b.where(lambda w: w.in_("n", [1, "x"])), 1), ("good", lambda b: b.where(lambda w: w.in_("n", [1, "2"])), 0)])
_problems("val_type", [("text", lambda b: b.where(lambda w: w.equals("n", "x")), 1), ("double", lambda b: b.where(lambda w: w.equals("n", 1.5)), 1), ("parsed", lambda b: b.where(lambda w: w.equals("n", "1")), 0)])
_problems("val_constraints", [("short", lambda b: b.where(lambda w: w.equals("s", "a")), 1), ("long", lambda b: b.where(lambda w: w.equals("s", "abcde")), 1), ("low", lambda b: b.where(lambda w: w.equals("n", -1)), 1), ("items", lambda b: b.where(lambda w: w.in_("s", ["a", "ab", "abcde"])), 2)])
_RULES = SearchSchema("rules", (text("mail", constraints=("not_blank", "email")), typed("past", "date", constraints=("past_or_present",)), typed("amount", "decimal", digits=(3, 2), constraints=("positive",)), typed("yes", "boolean", constraints=("assert_true",)), typed("even", "int", check=lambda v: v % 2 == 0)))


def _rule_problems() -> list[tuple]:
    out = []
    for name, value in (("mail", "a.b@example.org"), ("mail", "a@"), ("mail", " "), ("past", "2000-01-01"), ("past", "9000-01-01"), ("amount", "999.25"), ("amount", "1000.5"), ("amount", "0.125"), ("amount", "-1"), ("yes", "true"), ("yes", "false"), ("even", "4"), ("even", "5")):
        try:
            search(_RULES).where(lambda w, n=name, v=value: w.equals(n, v)).build()
            out.append((name, value, 0))
        except SearchValidationError as e:
            out.append((name, value, len(e.problems)))
    return out


_facts("val_rules", "field string, value string, problems long", _rule_problems, [("mail", "a.b@example.org", 0), ("mail", "a@", 1), ("mail", " ", 2), ("past", "2000-01-01", 0), ("past", "9000-01-01", 1), ("amount", "999.25", 0), ("amount", "1000.5", 1), ("amount", "0.125", 1), ("amount", "-1", 1), ("yes", "true", 0), ("yes", "false", 1), ("even", "4", 0), ("even", "5", 1)])
_problems("val_json_skip", [("any text", lambda b: b.where(lambda w: w.equals("j", "{")), 0)])
_problems("val_pattern_empty", [("empty", lambda b: b.where(lambda w: w.contains("s", "")), 1), ("number", lambda b: b.where(lambda w: w.contains("n", "1")), 2)])


def _rejected(text_: str) -> str:
    try:
        from_json(text_, _CHECKED)
    except SearchError as e:
        return e.key
    return "ok"


_facts("val_json_shape", "body string, outcome string", lambda: [(b, _rejected(b)) for b in ('{"conditions": {}}', '{"conditions": [{"field": "n"}]}', '{"conditions": [{"searchOperator": "equals"}]}', '{"conditions": [{"searchOperator": "like", "field": "n"}]}', "{}")], [('{"conditions": {}}', "json.conditions"), ('{"conditions": [{"field": "n"}]}', "json.operator"), ('{"conditions": [{"searchOperator": "equals"}]}', "json.field"), ('{"conditions": [{"searchOperator": "like", "field": "n"}]}', "operator.unknown"), ("{}", "ok")])
_facts("err_hierarchy", "name string, is_search_error boolean", lambda: [(k.__name__, issubclass(k, SearchError)) for k in (errors.SearchConfigurationError, errors.SearchValidationError, errors.SearchOperationError, errors.SearchJoinError, errors.SearchParseError)], [(f"Search{k}Error", True) for k in ("Configuration", "Validation", "Operation", "Join", "Parse")])


def _both_languages() -> list[tuple]:
    out = []
    for language in ("en", "ko"):
        errors.set_language(language)
        out.append((language, errors.message("page.both")))
    errors.set_language("en")
    return out


_facts("err_i18n", "language string, message string", _both_languages, [("en", "page and size go together"), ("ko", "page와 size는 함께 지정해야 합니다")])

_facts("doc_description", "line string", lambda: [(x,) for x in openapi.description(_CHECKED).split("\n")[2:]], [("- `n` (equals|isNull|in|between)",), ("- `s` (" + "|".join(o.value for o in Op) + ")",), ("- `j` (" + "|".join(o.value for o in Op) + ")",)])
_facts("doc_params", "name string", lambda: [(p["name"],) for p in openapi.parameters(_CHECKED) if p["name"][0] in "np" or "." not in p["name"]], [("n.equals",), ("n.isNull",), ("n.in",), ("n.between",), ("page",), ("size",), ("sort",)])
_facts("doc_param_schema", "operator string, type string", lambda: [(o.value, openapi.parameter_schema(_CHECKED.get("n"), o)["type"]) for o in (Op.EQUALS, Op.IS_NULL, Op.IN, Op.BETWEEN)], [("equals", "integer"), ("isNull", "boolean"), ("in", "string"), ("between", "string")])
_facts("doc_enum_constraints", "value string", lambda: [(v,) for v in openapi.allowed_values(text("x", pattern="DRAFT|LIVE")) + openapi.allowed_values(typed("y", enum("A", "B")))], [("DRAFT",), ("LIVE",), ("A",), ("B",)])
_facts("doc_example", "field string, operator string, page long, size long", lambda: [(c["field"], c["searchOperator"], e["page"], e["size"]) for e in [openapi.example(_CHECKED)] for c in e["conditions"]], [("n", "equals", 0, 10)])
_facts("doc_components", "name string, properties string", lambda: [(n, ",".join(c["properties"])) for n, c in openapi.components(_CHECKED)["schemas"].items()], [("Search", "conditions,sort,page,size"), ("SearchCondition", "operator,field,searchOperator,value,value2"), ("SearchGroup", "operator,conditions"), ("SearchOrder", "field,direction")])
_facts("doc_page_size_sort", "name string, type string, minimum long", lambda: [(p["name"], p["schema"]["type"], p["schema"].get("minimum", -1)) for p in openapi.paging_parameters(ORDERS)], [("page", "integer", 0), ("size", "integer", 1), ("sort", "array", -1)])

_add("fn_case_when", lambda s, d: _engine(s, d, "events").bucket_sums(Search(), "ts", _FROM, _TO, 2), "SELECT " + ", ".join(f"count(*) FILTER (WHERE bucket = {i}) AS b{i}" for i in range(2)) + f" FROM (SELECT {_BUCKET.format(n=2)} AS bucket FROM events WHERE {_INSIDE})")
_add("fn_arith", lambda s, d: s.read.parquet(f"{d}/events.parquet").where((F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-24 07:30:00").cast("timestamp_ntz"))).select("event_id", bucket_of(F.col("ts"), int(_FROM.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), int((_TO - _FROM).total_seconds() * 1000), 37).alias("bucket")), f"SELECT event_id, {_BUCKET.format(n=37)} AS bucket FROM events WHERE {_INSIDE}")
_add("fn_concat_key", lambda s, d: _engine(s, d, "conversations").matched_keys(Search()).select(F.concat_ws("|", F.col("__pk0").cast("string"), F.col("__pk1").cast("string")).alias("key")), "SELECT CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR) AS key FROM conversations")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Large orders of one market segment, latest first, first page."""
    return _queries["find_all"](spark, folder)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


