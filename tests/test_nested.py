import json

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from quirelake.operators import nested
from quirelake.operators.nested import Member, child_tables, flatten, infer_schema, levels_of

TREE = (Member("bookmarks", again="children"),)
REPORT = (Member("entries"), Member("check", many=False))


def paths(df):
    return sorted((r["row_id"], r["path"], r["parent_path"]) for r in df.collect())


def test_tree_keeps_parents_ordinals_and_nulls(spark):
    tree = [{"title": "a", "children": [None, {"title": "b", "children": {"title": "c"}}]}, None, {"title": "d", "children": []}, {}]
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(json.dumps(tree))), (3, '{"title": "x"}'), (4, None), (5, ""), (6, '[{"title": 1}] x'), (7, "[]"), (8, "null"), (9, '[{"title": 1}')], "id long, b string")
    got = paths(flatten(df, "b", "id", TREE, record=False))
    one = [("bookmarks[1]", ""), ("bookmarks[1].children[2]", "bookmarks[1]"), ("bookmarks[1].children[2].children[1]", "bookmarks[1].children[2]"), ("bookmarks[3]", "")]
    assert got == sorted([(1, *p) for p in one] + [(2, *p) for p in one] + [(3, "bookmarks[1]", "")])


def test_record_members_in_any_shape(spark):
    docs = [
        {"entries": [{"t": 1}, None, {}, "x", {"t": 2}], "check": {"ok": True}}, {"entries": {"t": 1}, "check": {}}, {"entries": json.dumps([{"t": 3}]), "check": json.dumps({"ok": 1})},
        {"entries": None}, {}, {"entries": "no json", "check": [1]},
    ]
    df = spark.createDataFrame([(i, json.dumps(d), "extra") for i, d in enumerate(docs)], "row_id long, path string, node string")
    got = paths(flatten(df, "path", "row_id", REPORT))
    assert got == [(0, "check", ""), (0, "entries[1]", ""), (0, "entries[5]", ""), (1, "entries[1]", ""), (2, "check", ""), (2, "entries[1]", "")]


def test_child_tables_and_empty_input(spark):
    df = spark.createDataFrame([(1, json.dumps({"entries": [{"t": "a", "path": "p", "n": "no number"}]}))], "id long, j string")
    t = child_tables(flatten(df, "j", "id", REPORT), {"entries": {"t": "string", "path": "string", "n": "int"}})["entries"].collect()[0]
    assert (t["path"], t["t"], t["path_value"], t["n"], t["ordinal"]) == ("entries[1]", "a", "p", None, 1)
    assert flatten(df.where("id > 1"), "j", "id", REPORT).count() == 0
    assert flatten(df.where("id > 1").selectExpr("id", "j"), "j", "id", TREE, record=False).count() == 0


def test_schema_merges_kinds(spark):
    df = spark.createDataFrame([(json.dumps({"a": [{"b": 1}]}),), (json.dumps({"a": {"b": "x"}}),), ("bad",), (None,)], "j string")
    merged = {(r["path"], r["kind"]) for r in infer_schema(df, "j").collect()}
    assert merged == {("", "object"), ("a", "array"), ("a", "object"), ("a[]", "object"), ("a[].b", "number"), ("a.b", "string")}
    schema = lambda *paths: spark.createDataFrame([(p, "string") for p in paths], "path string, kind string")
    assert levels_of(schema("x").where("path = ''"), TREE) == 1 and levels_of(schema("children.children[].title"), TREE, record=False) == 3


def test_more_paths_than_a_task_holds(spark, monkeypatch):
    """A map in disguise: every record has names of its own."""
    monkeypatch.setattr(nested, "FLUSH", 10)
    df = spark.createDataFrame([(i, json.dumps([{"title": "a", f"name{i}": 1, "children": [{f"x{i}.y": [1]}]}])) for i in range(25_000)], "id long, b string")
    assert infer_schema(df, "b").count() == 75_005
    assert flatten(df, "b", "id", TREE, record=False).count() == 50_000


def test_deep_tree(spark):
    node = {"title": "end"}
    for _ in range(60):
        node = {"title": "x", "children": [node, None, {"title": "y"}]}
    df = spark.createDataFrame([(1, json.dumps([node])), (2, '[{"title": "z"}]')], "id long, b string")
    got = [(r["row_id"], r["depth"], r["path"]) for r in flatten(df, "b", "id", TREE, record=False).collect()]
    assert len(got) == len(set(got)) == 122
    assert sorted({d for i, d, _ in got if i == 1}) == list(range(1, 62)) and all(p.count("[") == d for _, d, p in got)


node = st.recursive(
    st.fixed_dictionaries({"title": st.text(max_size=3)}),
    lambda kids: st.fixed_dictionaries({"title": st.just("t"), "children": st.one_of(kids, st.none(), st.lists(st.one_of(kids, st.none(), st.just({})), max_size=3))}),
    max_leaves=8,
)


@settings(max_examples=3, deadline=None, phases=(Phase.generate,), suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(node, st.lists(node, max_size=3)), min_size=1, max_size=12))
def test_same_as_recursion(spark, trees):
    want = []

    def walk(i, value, base, parent):
        for k, x in enumerate([value] if isinstance(value, dict) else value or [], 1):
            if x:
                p = f"{base}[{k}]"
                want.append((i, p, parent))
                walk(i, x.get("children"), p + ".children", p)

    for i, t in enumerate(trees):
        walk(i, t, "bookmarks", "")
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id long, b string")
    assert paths(flatten(df, "b", "id", TREE, record=False)) == sorted(want)
