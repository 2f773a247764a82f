"""Flattening against a plain recursive reader."""

import json
import random
from datetime import datetime

from quillspark.operators.nested import COLUMNS, TABLES, TRANSITIONS, Flat, _deep_loads, flatten_trees, names_table, read_tree, typed_tables

DDL = "page_id bigint, rev_id string, emitter string, ast string, loaded_at timestamp"


def brute(root):
    out = []

    def go(v, parent, ix):
        node = len(out)
        out.append((node, parent, ix))
        if isinstance(v, dict) and isinstance(v.get("token"), dict):
            v = v["token"]
        if not isinstance(v, dict) or v.get("type") in (None, "text"):
            return
        kids = v.get("children", v.get("childNodes"))
        kids = [] if kids is None else kids if isinstance(kids, list) else [kids]
        for i, k in enumerate([k for k in kids if k is not None]):
            go(k, node, i)

    go(root, -1, 0)
    return out


def tree(rnd, depth, key, native):
    kids = []
    for _ in range(rnd.randrange(4) if depth else 0):
        x = rnd.random()
        if x < 0.1:
            kids.append(None)
        elif x < 0.5:
            t = rnd.choice(["", "a", "ü\n"])
            kids.append(rnd.choice([{"is_text": True, "text": t, "token": None}, {"text": t}, {"is_text": True}]) if native else rnd.choice([t, {"type": "text", "text": t}]))
        else:
            t = tree(rnd, depth - 1, key, native)
            kids.append(rnd.choice([{"is_text": False, "token": t}, {"token": t}]) if native else t)
    out = {"type": "x", "name": rnd.choice(["n", "", None])}
    x = rnd.random()
    if x < 0.1:
        out[key] = None
    elif x < 0.2 and kids and kids[0] is not None:
        out[key] = kids[0]
    elif x > 0.25:
        out[key] = kids
    return out


def flat(spark, rows):
    return sorted((r.page_id, r.node_id, r.parent_id, r.child_ix) for r in flatten_trees(spark.createDataFrame(rows, DDL)).collect())


def test_random_trees(spark):
    rnd = random.Random(1)
    rows, want = [], []
    for p in range(60):
        native = p % 2 == 0
        t = tree(rnd, 6, "children" if native else "childNodes", native)
        rows.append((p, "1", "e", json.dumps(t), datetime(2025, 1, 1)))
        want += [(p, *x) for x in brute(t)]
    assert flat(spark, rows) == sorted(want)


def test_latest_well_formed_counts(spark):
    good, new = json.dumps({"type": "root", "children": ["a"]}), json.dumps({"type": "root"})
    rows = [
        (1, None, "e", good, datetime(2025, 1, 1)), (1, None, "e", new, datetime(2025, 1, 2)), (1, None, "e", new[:-1], datetime(2025, 1, 3)), (1, None, "e", None, datetime(2025, 1, 4)),
        (2, None, "e", good, None), (2, None, "e", good, None), (3, None, "e", "[1]", datetime(2025, 1, 1)), (4, None, "e", '"x"', datetime(2025, 1, 1)), (None, None, "e", new, datetime(2025, 1, 1)),
    ]
    got = [(r.page_id, r.node_id) for r in flatten_trees(spark.createDataFrame(rows, DDL)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (2, 1), (None, 0)], key=str)
    assert flat(spark, []) == []


def test_deep_tree():
    deep = '{"type":"a","children":[' * 60000 + "]}" * 60000
    v = read_tree(deep)
    assert v["type"] == "a"
    assert len(Flat(v)) == 60000


def test_own_reader_agrees_with_json():
    for s in ['{"a":[1,-2.5e3,true,null,"x\\u00e9\\n"],"b":{}}', "[]", '[[],[{}],{"a":{"b":[ ]}}]', ' {"a" : 1 , "b":[1 , 2]} ']:
        assert _deep_loads(s) == json.loads(s)
    for s in ["", "[", '{"a"}', "[1,]", "[1 2]", '{"a":1}x', "{1:2}"]:
        try:
            _deep_loads(s)
        except ValueError:
            continue
        raise AssertionError(s)


def test_typed_tables_cover_all_nodes(spark):
    t = {"type": "root", "children": ["a", {"type": "heading", "level": 2, "name": "2", "Type": "H"}, {"type": "quote", "bold": True, "name": "q"}, {"type": "b", "orig_tag": "B"}, {"odd": 1}, 5]}
    nodes = flatten_trees(spark.createDataFrame([(1, "r", "e", json.dumps(t), datetime(2025, 1, 1))], DDL)).cache()
    tables = typed_tables(nodes)
    assert set(tables) == set(TABLES) and sum(x.count() for x in tables.values()) == nodes.count() == 7
    assert tables["opaque"].count() == 2 and tables["heading"].first()["level"] == 2 and tables["style"].first()["name"] == "q"
    assert tables["heading"].first()["other"] == {"Type": '"H"'}
    assert sorted(r["name"] for r in names_table(nodes).collect()) == ["2", "q"]
    up = nodes.selectExpr("page_id", "node_id as parent_id")
    assert nodes.filter("parent_id >= 0").join(up, ["page_id", "parent_id"], "left_anti").count() == 0


def brute_state(v):
    """The state by recursion over the parts."""
    if isinstance(v, str):
        return ("text", 0)
    if not isinstance(v, dict):
        return ("opaque", 0)
    if not isinstance(v.get("type"), str):
        if isinstance(v.get("token"), dict) and not v.get("is_text"):
            return brute_state({"type": "", **v["token"]})
        return ("wrapped_text", 0) if v.get("is_text") or isinstance(v.get("text"), str) or not v else ("opaque", 0)
    if v["type"] == "text" and "children" not in v and "childNodes" not in v:
        return ("wrapped_text", 0)
    kids = v.get("children") if v.get("children") is not None else v.get("childNodes")
    kids = [] if kids is None else kids if isinstance(kids, list) else [kids]
    bits = 0
    for k in kids:
        if k is not None:
            bits |= TRANSITIONS[brute_state(k)].bit
    return ("named" if v.get("name") else "plain", bits)


def test_states_follow_from_the_states_of_the_parts():
    rnd = random.Random(5)
    for p in range(80):
        t = tree(rnd, 5, "children" if p % 2 else "childNodes", p % 2 == 1)
        assert Flat(t).states[0] == TRANSITIONS[brute_state(t)]
    states = lambda kids: Flat({"type": "x", "children": kids}).states[0]
    assert states([]).variant == "plain:empty" and states(["a", {"text": "b"}]).variant == "plain:text" and states([{"type": "y"}]).variant == "plain:tokens"
    assert states(["a", {"token": {"type": "y"}}]).variant == "plain:mixed" and states([["a"]]).variant == "plain:odd"
    # The same token goes to another table when its parts change.
    assert Flat({"type": "x", "name": "n", "children": ["a"]}).states[0].table == "labelled" and Flat({"type": "x", "name": "n", "children": [{"type": "y"}]}).states[0].table == "container"


def test_columns_on_demand(spark):
    df = spark.createDataFrame([(1, "r", "e", json.dumps({"type": "a", "children": ["b", {"type": "c"}]}), datetime(2025, 1, 1))], DDL)
    assert flatten_trees(df, ("page_id", "child_ix")).columns == ["page_id", "child_ix"]
    whole = flatten_trees(df)
    assert whole.columns == list(COLUMNS) and flatten_trees(df, ("page_id", "text")).count() == whole.count() == 3
