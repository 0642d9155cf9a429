"""Discovery of labelled folders, and every rule on annotations and profiles."""

import copy
import hashlib
import json

import pytest

from attestra.operators import dataset as rules
from attestra.sources import dataset as source


@pytest.fixture
def folder(tmp_path):
    def put(name, content=b"x"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else json.dumps(content).encode())
        return hashlib.sha256(content).hexdigest() if isinstance(content, bytes) else None

    put.root = str(tmp_path)
    return put


def annotation(kind, name, images, hashes, **more):
    fields = {f: {"state": "value", "value": "A"} for f in rules.FIELDS[kind]}
    a = {"id": name, "document_type": kind, "images": images, "image_sha256": hashes, "fields": fields, "status": "complete", "notes": ""}
    if kind in rules.ZONES:
        n, width = rules.ZONES[kind]
        a["mrz"] = {"lines": ["A" * width] * n}
    return a | more


def found(spark, put):
    files = source.listing(spark, put.root)
    docs, problems = source.discovered(files)
    issues = rules.annotation_issues(source.annotations(spark, put.root), docs, source.digests(spark, put.root))
    return docs, {(r.issue, r.id, r.detail) for r in problems.collect()}, {(r.issue, r.file, r.detail) for r in issues.collect()}


def test_discovery(spark, folder):
    for name in ("passport/b.JPG", "passport/a.png", "passport/a.jpg", "passport/notes.txt", "passport/deep/x.jpg", "id_card/one/Front.png", "id_card/one/back.jpg", "id_card/two/front.png", "id_card/two/front.jpg", "id_card/three/readme", "driving_license/b.webp", "other/c.jpg", "id_card/loose.jpg"):
        folder(name)
    docs, problems, _ = found(spark, folder)
    got = [(r.document_type, r.id, r.images) for r in docs.orderBy("place", "id").collect()]
    assert got == [("passport", "a", {"image": "passport/a.jpg"}), ("passport", "b", {"image": "passport/b.JPG"}), ("id_card", "one", {"back": "id_card/one/back.jpg", "front": "id_card/one/Front.png"}), ("driving_license", "b", {"image": "driving_license/b.webp"})]
    assert problems == {("duplicate id", "a", None), ("missing or duplicate side", "two", "duplicate front"), ("missing or duplicate side", "two", "missing back"), ("missing or duplicate side", "three", "missing front"), ("missing or duplicate side", "three", "missing back"), ("duplicate logical id", "b", "driving_license, passport")}


def test_inputs_order_and_inventory(spark, folder):
    for name in ("cards/b/front.jpg", "cards/b/back.png", "cards/A/Front.tif", "cards/A/back.bmp", "cards/c/front.jpg", "cards/c/front.png", "cards/loose.jpg", "pass/Z.JPG", "pass/a.webp", "pass/notes.txt", "pass/deep/x.jpg", "runs/one.jsonl", "runs/x/two.JSON", "runs/table.csv"):
        folder(name)
    files = source.listing(spark, folder.root)
    layouts = spark.createDataFrame([(1, "card", "id_card", "cards", ["front", "back"]), (0, "page", "passport", "pass", None), (2, "none", "x", "absent", None)], "place int, layout string, document_type string, input_directory string, pair_sides array<string>")
    samples, problems = source.inputs(files, layouts)
    got = [(r.key, r.file) for r in samples.orderBy("place", "order", "side").collect()]
    assert got == [("passport:a.webp", "pass/a.webp"), ("passport:Z.JPG", "pass/Z.JPG"), ("id_card:A:back", "cards/A/back.bmp"), ("id_card:A:front", "cards/A/Front.tif"), ("id_card:b:back", "cards/b/back.png"), ("id_card:b:front", "cards/b/front.jpg")]
    assert {r.detail for r in problems.collect()} == {"duplicate front in c", "missing back in c", "not in a folder of its own: loose.jpg"}
    assert {(r.file, r.format, r.length) for r in source.inventory(spark, folder.root).collect()} == {("runs/one.jsonl", "jsonl", 1), ("runs/x/two.JSON", "json", 1), ("runs/table.csv", "csv", 1)}
    docs = spark.createDataFrame([("passport", "b", 1), ("id_card", "a", 2), ("passport", "A", 1)], "document_type string, id string, place int")
    assert [r.id for r in source.in_report_order(docs).collect()] == ["A", "b", "a"]


def test_whole_annotations_have_no_issues(spark, folder):
    h = folder("passport/a.jpg"), folder("id_card/c/front.png", b"f"), folder("id_card/c/back.png", b"b"), folder("driving_license/d.jpg", b"d")
    folder("annotations/passport/a.json", annotation("passport", "a", {"image": "passport/a.jpg"}, {"image": h[0]}))
    folder("annotations/id_card/c.json", annotation("id_card", "c", {"front": "id_card/c/front.png", "back": "id_card/c/back.png"}, {"front": h[1], "back": h[2]}))
    folder("annotations/driving_license/d.json", annotation("driving_license", "d", {"image": "driving_license/d.jpg"}, {"image": h[3]}))
    assert found(spark, folder)[1:] == (set(), set())


def test_every_annotation_rule(spark, folder):
    want, h = set(), {}

    def case(name, wanted, kind="passport", **more):
        h[name] = folder(f"{kind}/{name}.jpg", name.encode())
        a = annotation(kind, name, {"image": f"{kind}/{name}.jpg"}, {"image": h[name]})
        for k, x in more.items():
            a.pop(k, None) if x is None else a.__setitem__(k, x)
        at = f"annotations/{kind}/{name}.json"
        folder(at, a)
        want.update((issue, at, detail) for issue, detail in wanted)
        return a, at

    fields = annotation("passport", "", {}, {})["fields"]
    case("ok", [])
    folder("annotations/broken.json", b"{")
    folder("annotations/list.json", b"[1]")
    folder("annotations/noid.json", {"id": 5})
    folder("annotations/type.json", {"id": "t", "document_type": "visa"})
    want |= {("malformed", "annotations/broken.json", ""), ("malformed", "annotations/list.json", ""), ("missing id", "annotations/noid.json", ""), ("invalid type", "annotations/type.json", "visa")}
    a, _ = case("moved", [("path does not match", "")])
    folder("annotations/passport/elsewhere.json", a)
    (at,) = [x for x in want if x[0] == "path does not match"]
    want.remove(at)
    want |= {("path does not match", "annotations/passport/elsewhere.json", ""), ("repeated id", None, "moved")}
    case("roles", [("invalid picture roles", ""), ("pictures differ from those found", "")], images={"front": "x"})
    case("roles2", [("invalid picture roles", ""), ("pictures differ from those found", "")], images=[1])
    case("hashes", [("invalid hash roles", ""), ("changed digest", "passport/hashes.jpg")], image_sha256=None)
    case("number", [("picture path is no text", "image"), ("pictures differ from those found", "")], images={"image": 5})
    case("out", [("picture outside the dataset", "a/../../x.jpg"), ("pictures differ from those found", "")], images={"image": "a/../../x.jpg"})
    case("gone", [("missing picture", "passport/none.jpg"), ("pictures differ from those found", "")], images={"image": "passport/none.jpg"})
    case("dots", [("pictures differ from those found", "")], images={"image": "./passport/x/../dots.jpg"})
    case("changed", [("changed digest", "passport/changed.jpg")], image_sha256={"image": "00"})
    case("nofields", [("fields are no object", ""), ("missing fields", ", ".join(sorted(rules.FIELDS["passport"])))], fields=[])
    some = copy.deepcopy(fields)
    del some["sex"], some["name"]
    case("unknown", [("unknown fields", "a1, a2"), ("missing fields", "name, sex")], fields=some | {"a2": {"state": "empty"}, "a1": {"state": "unreadable", "value": None}})
    case("states", [("invalid state", "type"), ("invalid state", "sex"), ("value is no text", "surname"), ("value is no text", "name"), ("value without state", "authority")], fields=fields | {"type": "x", "sex": {"state": "odd"}, "surname": {"state": "value", "value": 3}, "name": {"state": "value"}, "authority": {"state": "empty", "value": ""}})
    case("status", [("invalid status", "done"), ("incomplete", "done")], status="done")
    case("status2", [("invalid status", "null"), ("incomplete", "null")], status=None)
    case("progress", [("incomplete", "in_progress")], status="in_progress", notes=None)
    case("notes", [("missing notes", "")], notes=7)
    case("nozone", [("number of zone lines", "0")], mrz=None)
    case("zone", [("zone lines are no list", "")], mrz={"lines": "x"})
    case("zone3", [("number of zone lines", "3"), ("unreadable zone line", "2"), ("width of zone line", "3"), ("characters of zone line", "1")], mrz={"lines": ["a" * 44, None, "B"]})
    case("licence", [("zone not allowed", "")], kind="driving_license", mrz={"lines": []})
    folder("passport/bare.jpg")
    want.add(("not annotated", None, "passport/bare"))
    assert found(spark, folder)[2] == want
    assert {r.issue for r in rules.RULES} <= {x[0] for x in want}


def test_manifest_with_labels(spark):
    manifest = spark.createDataFrame([(1, "a.jpg", "k", None, "v1", ["blur", "blur"]), (2, "b.jpg", "", "k", None, None), (3, "c.jpg", "lost", None, None, []), (4, "gone.jpg", "k", None, None, []), (5, "b.jpg", None, None, None, None), (6, "a.jpg", "e", None, "v", [])], "line long, image string, label_id string, source_image string, variant string, augmentation array<string>")
    labels = spark.createDataFrame([("k", ["L1", "L2"]), ("e", []), ("n", None)], "label_id string, lines array<string>")
    files = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "file string")
    samples, problems = source.labelled_samples(manifest, labels, files)
    assert sorted((r.line, r.label_id, r.variant, r.augmentation) for r in samples.collect()) == [(1, "k", "v1", ["blur", "blur"]), (2, "k", "unknown", ["original"])]
    assert {tuple(r) for r in problems.collect()} == {(3, "label not found", "lost"), (4, "missing picture", "gone.jpg"), (5, "label not found", None), (6, "label not found", "e"), (None, "empty label", "e"), (None, "empty label", "n")}


def profile(**more):
    box = {"x1": 0.1, "y1": 0.1, "x2": 0.9, "y2": 0.9}
    regions = {"front": {"data_crop": box, "field_rois": {"name": box}}, "back": {"data_crop": box, "field_rois": {"sex": box}}}
    fields = [{"name": "name", "region": "front", "required": True}, {"name": "sex", "region": "back", "required": False}]
    return {"version": 1, "layout": "card", "sample_metadata": {}, "canonical_size": {"width": 10, "height": 5}, "regions": regions, "fields": fields} | more


@pytest.mark.parametrize(
    ("more", "want"),
    [
        ({}, []),
        ({"document_localization": None}, []),
        ({"version": 2}, ["version or layout"]),
        ({"layout": 1}, ["version or layout"]),
        ({"sample_metadata": []}, ["no sample metadata"]),
        ({"canonical_size": {"width": 0, "height": 5}}, ["canonical size"]),
        ({"canonical_size": {"width": 1.5, "height": 5}}, ["canonical size"]),
        ({"fields": []}, ["box without a field", "box without a field", "no regions or fields"]),
        ({"regions": {}}, ["field outside its region", "field outside its region", "no regions or fields"]),
        ({"regions": {"front": {"data_crop": {"x1": 0.5, "y1": 0, "x2": 0.5, "y2": 1}, "field_rois": {"name": {"x1": 0, "y1": 0, "x2": 1.5, "y2": 1}}}, "back": {"data_crop": 1}}}, ["box rectangle", "field outside its region", "region rectangle", "region rectangle", "region without boxes"]),
        ({"fields": [{"name": "name", "region": "front", "required": 1}, {"name": "sex", "region": "front", "required": True}, {"region": "back"}, {"name": "name", "region": "front", "required": True}]}, ["box without a field", "field outside its region", "field owned twice", "field without a name", "required is no flag"]),
        ({"document_localization": {"strategy": "other"}}, ["page anchor"]),
        ({"document_localization": {"strategy": "mrz_anchor", "page_corners_relative_to_mrz_width": [[0, 0], [1, 0], [1, 1], [0, "x"]]}}, ["anchor corners"]),
        ({"document_localization": {"strategy": "mrz_anchor", "page_corners_relative_to_mrz_width": [[0, 0.5], [1, 0], [1, 1], [0, 1]]}}, []),
    ],
)
def test_profile_rules(spark, more, want):
    rows = spark.createDataFrame([("p.json", json.dumps(profile(**more))), ("bad.json", "[")], "file string, text string")
    got = [(r.issue, r.file) for r in rules.layout_issues(rows).collect()]
    assert sorted(i for i, f in got if f == "p.json") == want and ("malformed", "bad.json") in got
