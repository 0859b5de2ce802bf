import json

from idloom.operators import shred as s

SCHEMA = "identifier string, metadata_json string, outer string, rid string"
FILE = {"name": "a.zip", "size": 1, "members": [{"name": "b"}, {"name": " "}, {"name": None, "files": [{"name": "lost"}]}, 7, "text", None, {"name": 12.50, "contents": {"c.txt": {}, "k": {"name": "own"}, "n": {"name": None}, "x": "gone"}}]}
ITEM = {"created": 5, "metadata": {"identifier": "i", "subject": ["p", "q"], "deep": {"x": 1}}, "files": FILE, "members": [{"name": "no"}], "reviews": [{"body": "r1", "replies": [{"body": "s1", "replies": [{"body": "t1"}]}]}, {"body": "r2"}]}


def _df(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def _files(spark, rows, root="item"):
    return {tuple(r) for r in s.file_objects(_df(spark, rows), root, "identifier", ["identifier"]).collect()}


WANT = {"a.zip", "a.zip!/b", "a.zip!/12.5", "a.zip!/12.5!/c.txt", "a.zip!/12.5!/own"}


def test_forms_of_collections(spark):
    assert _files(spark, [("i", json.dumps(ITEM))]) == {("i", p) for p in WANT}
    # JSON as text inside JSON, once and twice
    inner = dict(ITEM, files=json.dumps([FILE]))
    assert _files(spark, [("i", json.dumps(json.dumps(json.dumps(inner))))]) == {("i", p) for p in WANT}
    assert _files(spark, [("f", json.dumps(FILE))], "file") == {("f", p) for p in WANT}
    assert _files(spark, [("f", json.dumps({"members": [{"name": "x"}]}))], "file") == set()


def test_unusable_records(spark):
    bad = [None, "", "not json", '{"files": [{"name": "a"}', '{"files": [{"name": "a", "x": NaN}]}', '{"files": [{"name": "a"}]} x', "[1]", "null", '"text"', "{" * 50_000]
    assert _files(spark, [("i", t) for t in bad]) == set()
    assert _files(spark, []) == set()
    surrogate = _files(spark, [("i", '{"files": [{"name": "a\\ud800b"}]}')])
    assert surrogate == {("i", "a�b")}


def test_tables_and_links(spark):
    df = _df(spark, [("i", json.dumps(ITEM)), ("i", json.dumps(ITEM)), ("j", json.dumps({"files": [{"name": "n"}]}))])
    links, fields = s.schema_graph(df, "item")
    plan = s.inline_plan("item", links, fields)
    assert {"item", "file", "review", "reply"} <= plan.tables and "deep" not in plan.tables and "metadata" not in plan.tables
    assert "/metadata/deep/x" in plan.columns["item"]
    rows = s.shred(df, "item", "identifier", ["identifier"])
    assert not s.inline_plan("item", {}, fields).tables - {"item"} and "x" in s.inline_plan("item", {}, fields, ("x",)).tables
    got = {r.row_id: r for r in rows.collect()}
    assert len(got) == rows.count()
    assert all(r.parent_row_id in got and got[r.parent_row_id].element == r.parent_element for r in got.values() if r.element != "item")
    by = {}
    for r in got.values():
        by.setdefault(r.element, []).append(r)
    assert len(by["item"]) == 2 and len(by["review"]) == 2 and len(by["reply"]) == 2
    t1 = next(r for r in by["reply"] if r.fields["/body"] == "t1")
    assert got[t1.parent_row_id].fields["/body"] == "s1"
    flat = s.flat_table(rows, plan, "item").where("identifier = 'i'").first()
    assert flat["f_metadata/deep/x"] == "1" and flat["f_metadata/subject"] == '["p","q"]' and flat["f_created"] == "5"


def test_deep_nesting(spark):
    o = {"name": "z"}
    for k in range(200):
        o = {"name": f"n{k}", "members": [o]}
    got = _files(spark, [("i", json.dumps({"files": [o]}))])
    assert len(got) == 201 and max(len(p.split("!/")) for _, p in got) == 201


def _fields(spark, record, element="item"):
    rows = s.shred(_df(spark, [("i", json.dumps(record))]), "item", "identifier", ["identifier"]).where(f"element = '{element}'").collect()
    return [r.fields for r in rows]


def test_nothing_is_lost(spark):
    record = {"mixed": [{"o": 1}, "text", 5, None, {"o": 2}], "e": [], "o": {}, "a.b": 1, "a_b": 2, "a": {"b": 3, "/~": 4}, "a/b": 6, "n": [[1, {"x": 2.50}]], "files": [{"name": "f"}, "loose.txt", 3], "gone": None, "t": True}
    [item] = _fields(spark, record)
    assert item == {"/mixed": '["text",5,null]', "/e": "[]", "/o": "{}", "/a.b": "1", "/a_b": "2", "/a/b": "3", "/a/~1~0": "4", "/a~1b": "6", "/n": '[[1,{"x":2.5}]]', "/files": '["loose.txt",3]', "/t": "true"}
    assert sorted(f["/o"] for f in _fields(spark, record, "mixed")) == ["1", "2"]
    maps = {"files": {"a": {"size": 1}, "b": "text", "c": {}}}
    assert _fields(spark, maps) == [{"/files": '[{"b":"text"}]'}] and len(_fields(spark, maps, "file")) == 2
    assert _fields(spark, {"files": {"size": 1}}) == [{"/files": '{"size":1}'}]


def test_records_nest_to_any_depth(spark):
    deep = '{"name":"a","members":[' * 3000 + '{"name":"z"}' + "]}" * 3000
    got = _files(spark, [("f", deep)], "file")
    assert len(got) == 3001 and max(p.count("!/") for _, p in got) == 3000
    lists = '{"files":[{"name":"a","x":' + "[" * 20_000 + "]" * 20_000 + "}]}"
    assert _files(spark, [("i", lists), ("j", lists + "]")]) == {("i", "a")}
    inner = {"files": [{"name": "w"}]}
    for _ in range(11):
        inner = json.dumps(inner)
    assert _files(spark, [("i", inner)]) == {("i", "w")}


def test_one_object_in_every_record_is_a_table_if_asked(spark):
    df = _df(spark, [("i", '{"files": {"name": "only"}}')])
    assert "file" not in s.plan_of(df, "item").tables
    assert _files(spark, [("i", '{"files": {"name": "only"}}')]) == {("i", "only")}
    rows = s.shred(df, "item", "identifier", ["identifier"], asked=("file",)).collect()
    assert {r.element for r in rows} == {"item", "file"} and all(r.parent_row_id in {x.row_id for x in rows} for r in rows if r.parent_row_id)
