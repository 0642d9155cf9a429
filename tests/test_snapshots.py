"""Flattening, differences and digests of JSON; nested stage times."""

import json
import random

from attestra.operators import snapshots, stage_time


def flat(value, path="", lists=False):
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in flat(x, f"{path}.{name}".strip(".") if path else name, lists).items()}
    if isinstance(value, list):
        return {k: v for i, x in enumerate(value) for k, v in flat(x, f"{path}[{i}]", lists).items()} if lists else {}
    return {path: value}


def tree(r, deep):
    kind = r.random()
    if deep and kind < 0.45:
        return {f"n{i}": tree(r, deep - 1) for i in range(r.randint(0, 3))}
    if deep and kind < 0.6:
        return [tree(r, deep - 1) for _ in range(r.randint(0, 3))]
    return r.choice([1, "x{[", '"}\\', True, None, 2.5])


def test_scalars_of_any_depth(spark):
    r = random.Random(1)
    values = [{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}, {}, [], 5, "s", None, *({"t": tree(r, 5)} for _ in range(40))]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, "{"), (98, None)], "id long, text string")
    for lists in (False, True):
        got = {}
        for x in snapshots.scalars(rows, ["id"], "text", lists).collect():
            assert x.path not in got.setdefault(x.id, {})
            got[x.id][x.path] = x.value
        want = {i: {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in flat(x, "", lists).items()} for i, x in enumerate(values)}
        assert got == {i: x for i, x in want.items() if x}


def test_difference_and_document_changes(spark):
    one = {"success": True, "fields": {"name": {"value": "A"}, "sex": {"value": "M"}}, "mrz": {"lines": ["a", "b"]}, "time": 1}
    other = {"mrz": {"lines": ["a", "c"]}, "fields": {"name": {"value": "B"}, "age": {"value": 1}}, "success": True, "time": 2}
    table = lambda *rows: snapshots.scalars(spark.createDataFrame([(i, json.dumps(x)) for i, x in rows], "id long, text string"), ["id"], "text", True)
    a, b = table((1, one), (2, one), (3, one)), table((1, other), (2, one), (3, one | {"time": 9}), (4, {"success": "true"}))
    got = {(x.id, x.path, x.change, x.before, x.after) for x in snapshots.difference(a, b, ["id"]).collect()}
    assert got == {(1, "fields.name.value", "changed", "A", "B"), (1, "fields.sex.value", "removed", "M", None), (1, "fields.age.value", "added", None, "1"), (1, "mrz.lines[1]", "changed", "b", "c"), (1, "time", "changed", "1", "2"), (3, "time", "changed", "1", "9"), (4, "success", "added", None, "true")}
    docs = {x.id: (x.changed_fields, x.zone_changed, x.success_changed) for x in snapshots.document_changes(a, b, "id").collect()}
    assert docs == {1: (["age", "name", "sex"], True, False), 4: ([], False, True)}


def test_digests(spark):
    same = ['{"a":1,"b":{"x":[1,2],"ms":5}}', '{"b":{"ms":6,"x":[1,2]},"a":1}']
    odd = ['{"a":1,"b":{"x":[2,1],"ms":5}}', '{"a":"1","b":{"x":[1,2],"ms":5}}', '{"a":1,"b":{"x":[1,2,null],"ms":5}}', "{}", "{"]
    rows = spark.createDataFrame(list(enumerate(same + odd)), "id long, text string")
    d = {x.id: x.digest for x in snapshots.digests(rows, ["id"], "text", (r"(^|\.)ms$",)).collect()}
    assert d[0] == d[1] and len(set(d.values())) == 6 and d[6] is None and d[5]
    whole = {x.id: x.digest for x in snapshots.digests(rows, ["id"], "text").collect()}
    assert whole[0] != whole[1]


def test_equivalence_of_multisets(spark):
    rows = [("base", 1, "x"), ("base", 1, "x"), ("base", 1, "y"), ("base", 2, "z"), ("base", None, "n"), ("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", 3, "q"), ("b", 1, "x"), ("b", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), ("b", None, "n"), ("c", 2, None)]
    got = {x.run: tuple(x)[1:] for x in snapshots.equivalence(spark.createDataFrame(rows, "run string, doc_id long, digest string"), "base").collect()}
    assert got == {"a": (2, 1, 2, 1), "b": (5, 0, 0, 0), "c": (0, 1, 4, 0)}


def test_nested_stages(spark):
    rows = [("t", "all", 0, 100), ("t", "a", 10, 40), ("t", "a1", 10, 20), ("t", "a2", 20, 40), ("t", "b", 50, 60), ("t", "b1", 50, 60), ("t", "late", 100, 110), ("u", "one", 5, 5)]
    got = {(x.trace, x.stage): (x.parent, x.level, x.own) for x in stage_time.nested(spark.createDataFrame(rows, "trace string, stage string, start long, end long"), "trace").collect()}
    assert got == {("t", "all"): (None, 0, 60.0), ("t", "a"): ("all", 1, 0.0), ("t", "a1"): ("a", 2, 10.0), ("t", "a2"): ("a", 2, 20.0), ("t", "b"): ("all", 1, 0.0), ("t", "b1"): ("b", 2, 10.0), ("t", "late"): (None, 0, 10.0), ("u", "one"): (None, 0, 0.0)}
    total = spark.createDataFrame([("t", 130.0), ("u", -1.0), ("v", 7.0)], "trace string, total double")
    assert {tuple(x) for x in stage_time.residual(spark.createDataFrame(rows, "trace string, stage string, start long, end long"), "trace", total).collect()} == {("t", 130.0, 110.0, 20.0), ("u", -1.0, 0.0, 0.0), ("v", 7.0, 0.0, 7.0)}
