import json
import re

import pytest

from lodestone import errors, openapi
from lodestone.errors import SearchConfigurationError, SearchError, SearchParseError, SearchValidationError, set_language
from lodestone.openapi import description, example, operation, parameters
from lodestone.plans.builder import from_search, search
from lodestone.plans.ir import Condition, Group, Logic, Op, Search
from lodestone.plans.schema import SearchSchema, text, typed
from lodestone.sources.json_request import from_json, to_json
from lodestone.sources.params import from_params

BASE = SearchSchema("base", (typed("createdDate", "datetime", "created_at", Op.EQUALS, Op.BETWEEN, sortable=True),))
POSTS = SearchSchema(
    "posts",
    (
        typed("id", "long", "post_id", Op.EQUALS, Op.IN, sortable=True),
        text("title", None, Op.EQUALS, Op.CONTAINS, min_length=2, max_length=20, sortable=True),
        text("status", None, pattern="DRAFT|PUBLISHED"),
        typed("views", "int", "view_count", minimum=0, sortable=True, sort_path="rank.views"),
        text("author", "author.name", Op.EQUALS),
        typed("meta", "json"),
    ),
    BASE,
)


def test_operators_by_name():
    assert len(Op) == 18 and Op.named("GREATERTHANOREQUALTO") is Op.GREATER_THAN_OR_EQUAL_TO and Op.named("not_in") is Op.NOT_IN and Op.named("like") is None


def test_first_condition_has_no_logic():
    r = search().where(lambda w: w.or_equals("a", 1).or_equals("b", 2)).build()
    assert [n.logic for n in r.nodes] == [None, Logic.OR]


def test_root_groups_flatten_and_chained_ones_do_not():
    def fill(g):
        return g.equals("b", 2).or_equals("c", 3)

    flat = search().where(lambda w: w.equals("a", 1)).and_(fill).build()
    assert [n.logic for n in flat.nodes] == [None, Logic.AND, Logic.OR]
    chained = search().where(lambda w: w.equals("a", 1)).page(0).size(1).and_(fill).build()
    assert isinstance(chained.nodes[1], Group) and chained.nodes[1].logic is Logic.AND
    nested = search().or_(lambda g: g.equals("a", 1).and_(fill)).build()
    assert isinstance(nested.nodes[0], Group) and nested.nodes[0].logic is Logic.OR
    inner = search().where(lambda w: w.equals("a", 1).or_(fill).and_(lambda g: g).where(lambda g: g.equals("z", 1))).build()
    assert [type(n) for n in inner.nodes] == [Condition, Group, Condition]


def test_builder_copies_and_replaces():
    first = search(POSTS).where(lambda w: w.equals("id", 1)).sort(lambda s: s.asc("id")).page(1).size(5).fetch_fields("author", ["tags"]).build()
    second = from_search(first, POSTS).where(lambda w: w.equals("title", "xy")).sort(lambda s: s.desc("views")).build()
    assert len(first.nodes) == 1 and len(second.nodes) == 2 and second.fetch == ("author", "tags")
    assert [(o.target, o.ascending) for o in second.sort] == [("rank.views", False)] and second.nodes[1].logic is None
    assert first.paths() == set() and search(POSTS).where(lambda w: w.equals("author", "x")).build().paths() == {"author"}


def test_inherited_fields_may_be_filtered_and_sorted():
    r = search(POSTS).where(lambda w: w.between("createdDate", "2024-01-01", "2024-01-02")).sort(lambda s: s.asc("createdDate")).build()
    assert r.nodes[0].target == "created_at" == r.sort[0].target
    assert POSTS.resolve("nope") == "nope" == POSTS.resolve_sort("nope") and POSTS.resolve("views") == "view_count"


def problems(fill, schema=POSTS):
    with pytest.raises(SearchValidationError) as e:
        fill(search(schema)).build()
    return e.value.problems


def test_all_problems_at_once():
    found = problems(lambda b: b.where(lambda w: w.equals("nope", 1).greater_than("title", "bb").equals("views", "x")).sort(lambda s: s.asc("author").asc("gone")).page(3))
    assert len(found) == 6


@pytest.mark.parametrize(
    "fill",
    [
        lambda w: w.equals("title", None),
        lambda w: w.equals("title", "x"),
        lambda w: w.equals("title", "x" * 21),
        lambda w: w.contains("title", ""),
        lambda w: w.equals("status", "GONE"),
        lambda w: w.equals("views", -1),
        lambda w: w.equals("views", 1.5),
        lambda w: w.between("views", 1, None),
        lambda w: w.between("views", 1, "x"),
        lambda w: w.in_("id", []),
        lambda w: w.in_("id", "1"),
        lambda w: w.in_("id", [1, "x"]),
        lambda w: w.contains("views", "1"),
        lambda w: w.greater_than("meta", "1"),
        lambda w: w.equals("views", " "),
    ],
)
def test_value_rules(fill):
    assert problems(lambda b: b.where(fill))


def test_value_rules_that_pass():
    search(POSTS).where(lambda w: w.is_null("views").contains("meta", "x").equals("meta", "{").in_("id", ["1", 2, None]).equals("views", "7")).build()
    search(POSTS).build()


def test_paging_rules():
    for page, size in ((0, None), (None, 5), (-1, 5), (0, 0)):
        with pytest.raises(SearchValidationError):
            from_search(Search(page=page, size=size), POSTS).build()


def test_json_round_trip():
    r = search(POSTS).where(lambda w: w.equals("id", 1).or_(lambda g: g.in_("id", [1, 2]).or_contains("title", "ab"))).sort(lambda s: s.desc("views")).page(0).size(7).fetch_fields("author").build()
    data = json.loads(to_json(r))
    assert "fetch" not in to_json(r) and "operator" not in data["conditions"][0] and data["conditions"][1]["operator"] == "or"
    again = from_json(to_json(r), POSTS)
    assert again.sort == r.sort and (again.page, again.size, again.fetch) == (0, 7, ()) and again.nodes[1].nodes[0].value == ("1", "2")
    assert from_json(to_json(again), POSTS) == again
    assert to_json(Search()) == "{}"


def test_json_single_child_group_keeps_its_logic():
    text_ = '{"conditions": [{"searchOperator": "equals", "field": "id", "value": 1}, {"conditions": [{"searchOperator": "equals", "field": "id", "value": 2}], "operator": "or"}]}'
    group = from_json(text_, POSTS).nodes[1]
    assert isinstance(group, Group) and group.logic is Logic.OR and len(group.nodes) == 1


def test_json_cannot_name_a_path():
    node = from_json('{"conditions": [{"searchOperator": "equals", "field": "author", "value": "x", "entityField": "secret"}]}', POSTS).nodes[0]
    assert node.target == "author.name"


@pytest.mark.parametrize(
    "body",
    [
        "{", "[]", '{"conditions": {}}', '{"conditions": [{"searchOperator": "equals"}]}', '{"conditions": [{"field": "id"}]}', '{"conditions": [{"searchOperator": "like", "field": "id", "value": 1}]}',
        '{"conditions": [{"operator": "xor", "searchOperator": "equals", "field": "id", "value": 1}]}', '{"conditions": [{"conditions": []}]}', '{"conditions": [{"conditions": {}}]}', '{"sort": {"orders": [{"direction": "up", "field": "id"}]}}', '{"page": "x", "size": 1}', '{"conditions": [{"searchOperator": "in", "field": "id", "value": 1}]}',
    ],
)
def test_json_shape(body):
    with pytest.raises(SearchError):
        from_json(body, POSTS)


def test_json_sort_is_mapped():
    assert from_json('{"sort": {"orders": [{"direction": "desc", "field": "views"}]}}', POSTS).sort[0].target == "rank.views"


def test_params():
    r = from_params({"title.equals": " a,b ", "id.in": "1,2", "createdDate.between": "2024-01-01,2024-01-02", "views.isNull": "true", "sort": "id.asc, views.desc", "page": "2", "size": "5"}, POSTS)
    assert [n.logic for n in r.nodes] == [None, *[Logic.AND] * 3]
    assert r.nodes[0].value == "a,b" and r.nodes[1].value == ("1", "2") and r.nodes[2].value2.hour == 23 and (r.page, r.size) == (2, 5) and len(r.sort) == 2


@pytest.mark.parametrize("params", [{"title": "x"}, {"title.like": "x"}, {"page": "-1", "size": "1"}, {"page": "x", "size": "1"}, {"sort": "id,desc"}, {"sort": "id.ASC"}, {"createdDate.between": "2024-01-01"}, {"title.contains": " "}, {"views.equals": "x"}, {"page": "1"}, {"nope.equals": "1"}])
def test_params_errors(params):
    with pytest.raises(SearchError):
        from_params(params, POSTS)


def test_errors_and_languages():
    for kind in ("Configuration", "Validation", "Operation", "Join", "Parse"):
        assert issubclass(getattr(errors, f"Search{kind}Error"), SearchError)
    set_language("ko")
    try:
        assert "연산자" in str(SearchParseError("operator.unknown", "x"))
    finally:
        set_language("en")
    assert str(SearchParseError("operator.unknown", "x")) == "unknown operator 'x'"


def test_openapi():
    assert "- `id` (equals|in) [sortable]" in description(POSTS)
    by = {p["name"]: p for p in parameters(POSTS)}
    assert by["id.equals"]["schema"] == {"type": "integer", "format": "int64"} and by["id.in"]["schema"]["type"] == "string"
    assert by["status.equals"]["schema"]["enum"] == ["DRAFT", "PUBLISHED"] and by["status.isNull"]["schema"] == {"type": "boolean"}
    assert by["createdDate.between"]["example"] == "2024-01-01T00:00:00,2024-12-31T23:59:59" and by["page"]["schema"]["minimum"] == 0
    assert "id.asc" in by["sort"]["schema"]["items"]["enum"]
    assert from_json(json.dumps(example(POSTS)), POSTS).size == 10 and "requestBody" in operation(POSTS, "post")


def test_single_values_of_urls_are_normalised_and_others_are_not():
    r = from_params({"title.equals": " ａｂ ", "title.contains": " ａ", "status.in": "DRAFT,PUBLISHED"}, POSTS)
    assert [n.value for n in r.nodes] == ["ab", " ａ", ("DRAFT", "PUBLISHED")]


def test_a_missing_direction_means_ascending():
    assert from_json('{"sort": {"orders": [{"direction": null, "field": "id"}, {"field": "title"}]}}', POSTS).sort[0].ascending


def test_no_operators_means_all():
    assert all(POSTS.get("status").allows(o) for o in Op) and not POSTS.get("id").allows(Op.LESS_THAN)


@pytest.mark.parametrize(
    ("field", "kind", "more", "good", "bad"),
    [
        ("f", "string", {"constraints": ("not_blank",)}, ["x"], [" ", "\t"]),
        ("f", "string", {"constraints": ("not_empty",)}, ["x", " "], [""]),
        ("f", "string", {"constraints": ("email",)}, ["a@b", "a.b+c@x-y.example.org", ""], ["a", "@b", "a@", "a b@c", "a@-b", ".a@b", "a..b@c"]),
        ("f", "date", {"constraints": ("past",)}, ["1999-12-31"], ["9999-01-01"]),
        ("f", "datetime", {"constraints": ("future",)}, ["9999-01-01T00:00:00"], ["1999-12-31T00:00:00"]),
        ("f", "timestamp", {"constraints": ("past_or_present",)}, ["1999-12-31T00:00:00Z"], ["9999-01-01T00:00:00Z"]),
        ("f", "timestamp", {"constraints": ("future_or_present",)}, ["9999-01-01T00:00:00Z"], ["1999-12-31T00:00:00Z"]),
        ("f", "int", {"constraints": ("positive",)}, [1], [0, -1]),
        ("f", "double", {"constraints": ("positive_or_zero",)}, [0.0, 0.5], [-0.5]),
        ("f", "long", {"constraints": ("negative",)}, [-1], [0, 1]),
        ("f", "decimal", {"constraints": ("negative_or_zero",)}, ["0", "-1.5"], ["0.1"]),
        ("f", "boolean", {"constraints": ("assert_true",)}, [True, "true"], [False]),
        ("f", "boolean", {"constraints": ("assert_false",)}, [False], [True]),
        ("f", "decimal", {"digits": (3, 2)}, ["999.99", "0.5", "-12.30", "0", "5e2"], ["1000", "0.125", "1e3"]),
        ("f", "int", {"check": lambda v: v % 2 == 0}, [2], [3]),
    ],
)
def test_rules_of_values(field, kind, more, good, bad):
    schema = SearchSchema("s", (typed(field, kind, **more),))
    for v in good:
        search(schema).where(lambda w, v=v: w.equals(field, v)).build()
    for v in bad:
        assert len(problems(lambda b, v=v: b.where(lambda w: w.equals(field, v)), schema)) == 1
    assert len(problems(lambda b: b.where(lambda w: w.in_(field, [*good, *bad])), schema)) == len(bad)


def test_unknown_rules_are_an_error():
    with pytest.raises(SearchConfigurationError):
        text("f", constraints=("shiny",))


def test_components_are_complete():
    made = openapi.components(POSTS)
    names = set(re.findall(r"#/components/schemas/(\w+)", json.dumps([made, openapi.operation(POSTS, "post")])))
    assert names == set(made["schemas"])
    condition = made["schemas"]["SearchCondition"]["properties"]
    assert condition["field"]["enum"] == [f.name for f in POSTS.all()] and "between" in condition["searchOperator"]["enum"]
    assert "enum" not in openapi.components()["schemas"]["SearchOrder"]["properties"]["field"]
    rules = SearchSchema("r", (text("m", constraints=("email", "not_blank")), typed("n", "int", constraints=("positive",))))
    assert openapi.value_schema(rules.get("m")) == {"type": "string", "format": "email", "minLength": 1} and openapi.value_schema(rules.get("n"))["exclusiveMinimum"] == 0
