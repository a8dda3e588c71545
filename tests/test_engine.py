import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import SearchConfigurationError, SearchError, SearchJoinError, SearchOperationError
from lodestone.operators.predicates import fold, predicate
from lodestone.plans.builder import search
from lodestone.plans.ir import LISTS, NULLARY, PATTERNS, RANGES, Condition, Group, Logic, Op, Order, Search
from lodestone.sources.catalog import Catalog, Entity, many_to_many, to_many, to_one
from lodestone.streaming import matches as stream_matches


@pytest.fixture(scope="module")
def blog(spark):
    authors = spark.createDataFrame([(1, "Boss", None), (2, "Alice", 1), (3, "Bob", 2)], "author_id long, name string, manager_id long")
    posts = spark.createDataFrame(
        [
            (1, "50% discount", "PUBLISHED", 10, 2, dt.datetime(2024, 1, 1), '{"en": "Welcome"}', {"k": "v"}),
            (2, "50X discount", "DRAFT", 2000, 2, dt.datetime(2024, 1, 2), '{"en": "Bye"}', None),
            (3, "keep me", None, None, 3, dt.datetime(2024, 1, 3), None, {"k": "w"}),
            (4, None, "PUBLISHED", 5, None, None, '{"ko": "Welcome"}', {}),
            (5, "a_b\\c", "ARCHIVED", 5, 1, dt.datetime(2024, 1, 3, 23, 59), "", {"q": "v"}),
        ],
        "post_id long, title string, status string, views int, author_id long, created timestamp_ntz, i18n string, meta map<string,string>",
    )
    comments = spark.createDataFrame([(1, "good", 1, 3), (2, "bad", 1, 2), (3, "good", 2, 2), (4, None, 3, 1)], "comment_id long, content string, post_id long, author_id long")
    tags = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "tag_id long, name string")
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3), (1, 1)], "post_id long, tag_id long")
    items = spark.createDataFrame([(("w1", i), f"n{i % 3}") for i in range(25)] + [(("w2", 0), "n0")], "id struct<code:string,line:long>, name string")
    notes = spark.createDataFrame([(100 * i + k, f"x{k}", "w1", i) for i in range(25) for k in range(3)], "note_id long, content string, code string, line long")
    return Catalog(
        Entity("author", authors, ("author_id",), (to_one("manager", "author", ("manager_id", "author_id")), to_many("posts", "post", ("author_id", "author_id")))),
        Entity("post", posts, ("post_id",), (to_one("author", "author", ("author_id", "author_id")), to_many("comments", "comment", ("post_id", "post_id")), many_to_many("tags", "tag", bridge, (("post_id", "post_id"),), (("tag_id", "tag_id"),)))),
        Entity("comment", comments, ("comment_id",), (to_one("author", "author", ("author_id", "author_id")),)),
        Entity("tag", tags, ("tag_id",)),
        Entity("item", items, ("id.code", "id.line"), (to_many("notes", "note", ("id.code", "code"), ("id.line", "line")),)),
        Entity("note", notes, ("note_id",)),
    )


def ids(engine, fill):
    return sorted(r.post_id for r in engine.matches(search().where(fill).build()).collect())


@pytest.mark.parametrize(
    ("fill", "want"),
    [
        (lambda w: w.equals("views", 5), [4, 5]),
        (lambda w: w.not_equals("views", 5), [1, 2]),
        (lambda w: w.greater_than("views", 5), [1, 2]),
        (lambda w: w.greater_than_or_equal_to("views", "5"), [1, 2, 4, 5]),
        (lambda w: w.less_than("views", 10), [4, 5]),
        (lambda w: w.less_than_or_equal_to("views", 10), [1, 4, 5]),
        (lambda w: w.contains("title", "50%"), [1]),
        (lambda w: w.contains("title", "_b\\"), [5]),
        (lambda w: w.not_contains("title", "50"), [3, 5]),
        (lambda w: w.starts_with("title", "50"), [1, 2]),
        (lambda w: w.not_starts_with("title", "50"), [3, 5]),
        (lambda w: w.ends_with("title", "me"), [3]),
        (lambda w: w.not_ends_with("title", "discount"), [3, 5]),
        (lambda w: w.is_null("title"), [4]),
        (lambda w: w.is_not_null("title"), [1, 2, 3, 5]),
        (lambda w: w.in_("views", [5, 10]), [1, 4, 5]),
        (lambda w: w.not_in("views", [5, 10]), [2]),
        (lambda w: w.not_in("views", [5, None]), []),
        (lambda w: w.between("views", 5, 10), [1, 4, 5]),
        (lambda w: w.not_between("views", 5, 10), [2]),
        (lambda w: w.between("created", "2024-01-02", "2024-01-03"), [2, 3, 5]),
        (lambda w: w.equals("created", "2024-01-02T00:00:00Z"), [2]),
        (lambda w: w.contains("i18n", "Welcome"), [1, 4]),
        (lambda w: w.not_contains("i18n", "Welcome"), [2, 5]),
        (lambda w: w.contains("meta", '"v"'), [1, 5]),
        (lambda w: w.equals("author.manager.name", "Boss"), [1, 2]),
        (lambda w: w.equals("author.manager.manager.name", "Boss"), [3]),
        (lambda w: w.is_null("author.name"), [4]),
        (lambda w: w.equals("comments.content", "good"), [1, 2]),
        (lambda w: w.not_equals("comments.content", "good"), [1]),
        (lambda w: w.is_null("comments.comment_id"), [4, 5]),
        (lambda w: w.is_null("comments.content"), [3, 4, 5]),
        (lambda w: w.equals("comments.content", "good").equals("comments.author.name", "Alice"), [2]),
        (lambda w: w.equals("tags.name", "A"), [1, 2]),
        (lambda w: w.equals("tags.name", "A").equals("tags.name", "B"), []),
        (lambda w: w.equals("tags.name", "B").equals("comments.content", "bad"), [1]),
        (lambda w: w.equals("tags.name", "C").or_equals("comments.content", "bad"), [1, 3]),
        (lambda w: w.equals("status", "PUBLISHED").or_greater_than("views", 1000).contains("title", "keep"), []),
        (lambda w: w.equals("views", 10).or_(lambda g: g.equals("views", 5).equals("status", "ARCHIVED")), [1, 5]),
    ],
)
def test_matches(blog, fill, want):
    engine = Engine(blog, "post")
    assert ids(engine, fill) == want
    r = search().where(fill).build()
    assert engine.count(r) == len(want)
    if not r.paths():
        return
    assert engine.exists(r) == bool(want)
    survivors, gone = engine.delete(r)
    assert sorted(x.post_id for x in gone.collect()) == want and survivors.count() == 5 - len(want)
    done = engine.update(r, {"status": "NEW", "title": None}).collect()
    assert sorted(x.post_id for x in done if x.status == "NEW") == want and len(done) == 5
    assert sum(x.title is None for x in done) == 1
    listed = [x.post_id for x in engine.find_all(r).content.collect()]
    assert listed == want


def test_semi_join_where_proven_and_outer_join_elsewhere(blog):
    engine = Engine(blog, "post")

    def plan(fill):
        return engine._filtered(search().where(fill).build()).df._jdf.queryExecution().optimizedPlan().toString()

    assert "LeftSemi" in plan(lambda w: w.equals("comments.content", "good"))
    for fill in (lambda w: w.is_null("comments.content"), lambda w: w.equals("comments.content", "good").or_equals("views", 5)):
        assert "LeftSemi" not in plan(fill)


def test_pages_are_disjoint_and_complete(blog):
    engine = Engine(blog, "item")
    for sort in ((), (Order("name"),), (Order("notes.content", False),)):
        seen = []
        for page in range(4):
            p = engine.find_all(Search((Condition("id.code", Op.EQUALS, "w1"), Condition("notes.content", Op.STARTS_WITH, "x")), sort, page, 10))
            rows = p.content.collect()
            assert p.total == 25 and p.pages == 3 and len(rows) == (10, 10, 5, 0)[page]
            seen += [r.id.line for r in rows]
        assert sorted(seen) == list(range(25))
    assert engine.count(Search()) == 26 and engine.find_all(Search()).size == 20


def test_sort_uses_matching_children_only(blog):
    engine = Engine(blog, "post")
    r = Search((Condition("comments.content", Op.EQUALS, "good"),), (Order("comments.comment_id", False),))
    assert [x.post_id for x in engine.find_all(r).content.collect()] == [2, 1]
    everything = Search((), (Order("comments.comment_id"), Order("post_id", False)))
    assert [x.post_id for x in engine.find_all(everything).content.collect()] == [5, 4, 1, 2, 3]


def test_nulls_first_ascending_last_descending(blog):
    engine = Engine(blog, "post")
    assert [x.post_id for x in engine.find_all(Search(sort=(Order("views"),))).content.collect()] == [3, 4, 5, 1, 2]
    assert [x.post_id for x in engine.find_all(Search(sort=(Order("views", False),))).content.collect()] == [2, 1, 4, 5, 3]


def test_fetch(blog):
    engine = Engine(blog, "post")
    rows = engine.find_all(search().sort(lambda s: s.asc("post_id")).fetch_fields("author.manager", "comments.author", "tags").build()).content.collect()
    one, _, _, four, _ = rows
    assert [r.post_id for r in rows] == [1, 2, 3, 4, 5]
    assert one.author.name == "Alice" and one.author.manager.name == "Boss" and four.author is None
    assert sorted(c.author.name for c in one.comments) == ["Alice", "Bob"] and [t.name for t in one.tags] == ["A", "B"] and four.comments == [] and four.tags == []


def test_to_one_relations_are_fetched_by_themselves(blog):
    engine = Engine(blog, "post", auto_fetch=True)
    rows = engine.find_all(search().sort(lambda s: s.asc("post_id")).fetch_fields("comments").build()).content.collect()
    assert [r.author.name if r.author else None for r in rows] == ["Alice", "Alice", "Bob", None, "Boss"]
    assert sorted(c.author.name for c in rows[0].comments) == ["Alice", "Bob"]
    assert "author" not in Engine(blog, "post").find_all(Search()).content.columns
    assert Engine(blog, "tag", auto_fetch=True).find_all(Search()).content.columns == ["tag_id", "name"]


def test_fetch_reads_the_page_once(blog, spark, tmp_path, monkeypatch):
    blog.entity("post").df.write.parquet(str(tmp_path / "p"))
    engine = Engine(blog.replace("post", spark.read.parquet(str(tmp_path / "p"))), "post")
    request = search().sort(lambda s: s.asc("post_id")).fetch_fields("author.manager", "comments.author", "tags").build()
    plan = engine.find_all(request).content._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in plan  # the page is a table of its own by then
    # below the first level nothing is known of the size, so no broadcast is asked for
    asked, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: asked.append(df.columns) or plain(df))
    engine.find_all(request)
    assert len(asked) == 3


def test_affected_rows_are_counted_while_writing(blog):
    from pyspark.sql import Observation

    engine = Engine(blog, "post")
    for request, want in ((search().where(lambda w: w.equals("views", 5)).build(), 2), (search().where(lambda w: w.equals("tags.name", "A")).build(), 2), (Search(), 5), (search().where(lambda w: w.equals("views", 77)).build(), 0)):
        deleted, updated = Observation(), Observation()
        assert len(engine.delete(request, deleted)[0].collect()) == 5 - want
        assert len(engine.update(request, {"status": "NEW"}, updated).collect()) == 5
        assert deleted.get["affected"] == updated.get["affected"] == want


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(1, "b", 5, 7, 9), (2, "a", 6, 8, 9)], "id long, name string, __size int, __pkg int, __score int")
    kids = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "kid long, id long, t string")
    catalog = Catalog(Entity("e", rows, ("id",), (to_many("kids", "k", ("id", "id")),)), Entity("k", kids, ("kid",)))
    engine = Engine(catalog, "e")
    for request in (search().sort(lambda s: s.asc("name")).build(), search().where(lambda w: w.is_not_null("kids.t").or_equals("id", 1)).sort(lambda s: s.asc("kids.t")).fetch_fields("kids").build()):
        assert engine.find_all(request).content.columns[:5] == rows.columns


def test_terminals(blog):
    engine = Engine(blog, "post")
    assert engine.find_one(search().where(lambda w: w.equals("post_id", 3)).build()).title == "keep me"
    assert engine.find_one(search().where(lambda w: w.equals("post_id", 9)).build()) is None
    with pytest.raises(SearchOperationError):
        engine.find_one(search().where(lambda w: w.equals("views", 5)).build())
    assert engine.find_first(search().sort(lambda s: s.desc("post_id")).page(1).size(2).build()).post_id == 3
    assert engine.find_first(search().where(lambda w: w.equals("views", 77)).build()) is None
    view = engine.find_all_projected(Search(), {"x": "post_id * 2"})
    assert view.content.columns == ["x"] and view.total == 5
    with pytest.raises(SearchConfigurationError):
        engine.find_all_projected(Search(), 5)
    with pytest.raises(SearchError):
        engine.update(Search(), {"nope": 1})


def test_paths(blog):
    assert blog.is_to_many("post", "comments.author.name") and not blog.is_to_many("post", "author.name")
    assert not blog.is_valid("post", "author.nope") and blog.keys("item") == ("id.code", "id.line")
    engine = Engine(blog, "post")
    for path in ("author.nope", "nope.x", "author"):
        with pytest.raises(SearchJoinError):
            engine.count(search().where(lambda w, p=path: w.equals(p, "x")).build())


def test_day_ends_can_be_switched_off(blog):
    fill = lambda w: w.between("created", "2024-01-02", "2024-01-03")
    assert Engine(blog, "post", expand_days=False).count(search().where(fill).build()) == 2


def test_buckets(blog, spark):
    start = dt.datetime(2024, 1, 1)
    ms = [0, 3, 6, 9, 10]
    rows = spark.createDataFrame([(i, start + dt.timedelta(milliseconds=m)) for i, m in enumerate(ms)], "id long, ts timestamp_ntz")
    kids = spark.createDataFrame([(k, k % 5) for k in range(20)], "kid long, id long")
    engine = Engine(Catalog(Entity("e", rows, ("id",), (to_many("kids", "k", ("id", "id")),)), Entity("k", kids, ("kid",))), "e")
    end = start + dt.timedelta(milliseconds=10)
    assert [tuple(r) for r in engine.buckets(Search(), "ts", start, end, 3).collect()] == [(0, 2), (1, 1), (2, 1)]
    assert tuple(engine.bucket_sums(Search(), "ts", start, end, 3).first()) == (2, 1, 1)
    many = search().where(lambda w: w.greater_than("kids.kid", 4).or_equals("id", 0)).build()
    assert [r.n for r in engine.buckets(many, "ts", start, end, 3).collect()] == [2, 1, 1]
    assert [r.n for r in engine.buckets(search().where(lambda w: w.equals("id", 77)).build(), "ts", start, end, 4).collect()] == [0] * 4
    for a, b, n in ((end, start, 3), (start, start, 3), (start, end, 0), (start, end, 513)):
        with pytest.raises(SearchOperationError):
            engine.buckets(Search(), "ts", a, b, n)


def test_top_k_and_pushdown(blog, spark, tmp_path):
    blog.entity("post").df.write.parquet(str(tmp_path / "p"))
    engine = Engine(blog.replace("post", spark.read.parquet(str(tmp_path / "p"))), "post")
    plan = engine.find_all(search().where(lambda w: w.greater_than("views", 5)).build()).content._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(views,5)" in plan
    keys = engine.matched_keys(search().where(lambda w: w.greater_than("views", 5)).build())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<post_id:bigint,views:int>" in keys


def test_stream(blog, spark, tmp_path):
    blog.entity("post").df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(blog.entity("post").df.schema).parquet(str(tmp_path / "s"))
    request = search().where(lambda w: w.equals("author.manager.name", "Boss")).build()
    query = stream_matches(blog, "post", stream, request).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.post_id for r in spark.sql("SELECT * FROM found").collect()) == [1, 2]
    with pytest.raises(SearchOperationError):
        stream_matches(blog, "post", stream, search().where(lambda w: w.equals("tags.name", "A")).build())


# random trees against a plain evaluator

ROWS = [(i, a, s) for i, (a, s) in enumerate([(None, None), (0, ""), (1, "a"), (2, "ab"), (3, "b%"), (2, None), (None, "a_")])]
_numbers = st.one_of(
    st.builds(lambda o, v: Condition("n", o, v), st.sampled_from([Op.EQUALS, Op.NOT_EQUALS, Op.GREATER_THAN, Op.GREATER_THAN_OR_EQUAL_TO, Op.LESS_THAN, Op.LESS_THAN_OR_EQUAL_TO]), st.integers(0, 3)),
    st.builds(lambda o, v: Condition("n", o, tuple(v)), st.sampled_from(sorted(LISTS, key=str)), st.lists(st.one_of(st.none(), st.integers(0, 3)), min_size=1, max_size=3)),
    st.builds(lambda o, v, w: Condition("n", o, v, w), st.sampled_from(sorted(RANGES, key=str)), st.integers(0, 3), st.integers(0, 3)),
)
_texts = st.builds(lambda o, v: Condition("s", o, v), st.sampled_from(sorted(PATTERNS, key=str)), st.sampled_from(["a", "b", "%", "_"]))
_nulls = st.builds(lambda o, f: Condition(f, o), st.sampled_from(sorted(NULLARY, key=str)), st.sampled_from(["n", "s"]))
_leaf = st.one_of(_numbers, _texts, _nulls)
_logic = st.sampled_from([None, Logic.AND, Logic.OR])


def _with_logic(node, logic):
    return Group(node.nodes, logic) if isinstance(node, Group) else Condition(node.field, node.op, node.value, node.value2, logic)


_tree = st.recursive(st.builds(_with_logic, _leaf, _logic), lambda inner: st.builds(lambda ns, o: Group(tuple(ns), o), st.lists(inner, min_size=1, max_size=3), _logic), max_leaves=6)


def _evaluate(c, row):
    v = row[1] if c.field == "n" else row[2]
    if c.op in NULLARY:
        return (v is None) == (c.op is Op.IS_NULL)
    if v is None:
        return None
    if c.op in LISTS:
        inside = True if v in c.value else None if None in c.value else False
        return inside if c.op is Op.IN or inside is None else not inside
    if c.op in RANGES:
        return (c.value <= v <= c.value2) == (c.op is Op.BETWEEN)
    simple = {
        Op.EQUALS: lambda: v == c.value, Op.NOT_EQUALS: lambda: v != c.value, Op.GREATER_THAN: lambda: v > c.value, Op.GREATER_THAN_OR_EQUAL_TO: lambda: v >= c.value, Op.LESS_THAN: lambda: v < c.value, Op.LESS_THAN_OR_EQUAL_TO: lambda: v <= c.value,
        Op.CONTAINS: lambda: c.value in v, Op.NOT_CONTAINS: lambda: c.value not in v, Op.STARTS_WITH: lambda: v.startswith(c.value), Op.NOT_STARTS_WITH: lambda: not v.startswith(c.value), Op.ENDS_WITH: lambda: v.endswith(c.value), Op.NOT_ENDS_WITH: lambda: not v.endswith(c.value),
    }
    return simple[c.op]()


def _fold(nodes, row):
    out = None
    for i, n in enumerate(nodes):
        v = _fold(n.nodes, row) if isinstance(n, Group) else _evaluate(n, row)
        if i == 0:
            out = v
        elif n.logic is Logic.OR:
            out = True if out is True or v is True else None if out is None or v is None else False
        else:
            out = False if out is False or v is False else None if out is None or v is None else True
    return out


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_tree, min_size=1, max_size=4))
def test_random_trees(spark, nodes):
    df = spark.createDataFrame(ROWS, "i long, n int, s string")
    types = {f.name: f.dataType for f in df.schema}
    where = fold(tuple(nodes), lambda c: predicate(c, F.col(c.field), types[c.field]))
    got = {r.i for r in df.where(where).select("i").collect()}
    assert got == {r[0] for r in ROWS if _fold(nodes, r) is True}


def test_composite_keys_do_not_collide(spark):
    rows = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 1), ("a", "b|c", 2)], "k1 string, k2 string, v int")
    kids = spark.createDataFrame([("a|b", 1), ("a|b", 2), ("a", 3)], "k1 string, kid int")
    engine = Engine(Catalog(Entity("e", rows.where("v = 1"), ("k1", "k2"), (to_many("kids", "k", ("k1", "k1")),)), Entity("k", kids, ("kid",))), "e")
    assert engine.count(search().where(lambda w: w.greater_than("kids.kid", 0).or_equals("v", 9)).build()) == 2
