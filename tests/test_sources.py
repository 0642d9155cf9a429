"""Readers, writers and the stream of checks."""

import io
import json
import zipfile

from attestra.sources import files
from attestra.streaming import checks


def test_archives_and_uploads(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name in ("one/front.jpg", "one/back.jpg", "../evil.jpg", "__MACOSX/x", "one/.DS_Store", "big.bin"):
            z.writestr(name, b"\xff\xd8\xff" + b"0" * (50 if name == "big.bin" else 1))
    (tmp_path / "a.zip").write_bytes(b.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "empty.png").write_bytes(b"")
    up = {r.path.rsplit("/", 1)[1]: r for r in files.uploads(spark, str(tmp_path)).collect()}
    assert up["a.zip"].extension == "zip" and up["b.zip"].extension is None
    got = {r.entry: r.error for r in files.archive_entries(files.uploads(spark, str(tmp_path)).where("path like '%.zip'"), most_bytes=40).collect()}
    assert got == {"one/front.jpg": None, "one/back.jpg": None, "../evil.jpg": "unsafe path", "big.bin": "too large", None: "not an archive"}


def test_logs_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a": 1, "b": {"c": 2}}\n\n{"a": 3}\n')
    log = files.run_log(spark, str(tmp_path / "in"), "a long, b struct<c:long>")
    assert sorted(r.a for r in log.collect()) == [1, 3]
    files.write_csv([log.select("a", "b"), spark.createDataFrame([(5,)], "z long")], str(tmp_path / "out"))
    back = files.csv_table(spark, str(tmp_path / "out"))
    assert back.columns == ["a", "b", "z"] and back.count() == 3 and {r.b for r in back.collect()} == {'{"c":2}', None}
    gpu = spark.createDataFrame([("100 MiB, 200 MiB, 50 %",), ("x",), ("1, ?, 3",)], "value string")
    assert [tuple(r) for r in files.gpu_samples(gpu).collect()] == [(100.0, 200.0, 50.0), (1.0, None, 3.0)]
    assert files.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_stream_of_checks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"doc_id": "d", "document_type": None, "lines": [{"text": "JOHN", "confidence": 0.9}], "fields": [{"field": "name", "expected": "JOHN"}]}
    (tmp_path / "in" / "a.json").write_text(json.dumps(row))
    stream = spark.readStream.schema(checks.REQUEST).json(str(tmp_path / "in"))
    checks.checks(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.field, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("name", "match")]
