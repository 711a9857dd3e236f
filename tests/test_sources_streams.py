"""The directory source and the telemetry streams."""

from __future__ import annotations

import datetime

from larkspur.sources import catalog_scan, file_tree
from larkspur.streaming import telemetry


def test_file_tree_scan(spark, tmp_path):
    for name in ("a.md", "src/b.py", "src/node_modules/c.js", "src/deep/er/d.txt", "builder/e.txt", ".git/f", "src/.hidden", "src/_kept", "x/__pycache__/g.pyc", "$h", "docs/$i/j"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("12345")
    (tmp_path / "empty").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "src")
    rows = file_tree.scan(spark, str(tmp_path)).collect()
    files = {(r.dir, r.name) for r in rows if not r.is_dir}
    assert files == {("", "a.md"), ("", "link"), ("src", "b.py"), ("src/node_modules", "c.js"), ("src/deep/er", "d.txt"), ("src", "_kept")}
    assert {(r.dir, r.name) for r in rows if r.is_dir} == {("", "src"), ("", "x"), ("", "docs"), ("", "empty"), ("src", "node_modules"), ("src", "deep"), ("src/deep", "er")}
    assert all(r.size == 5 for r in rows if not r.is_dir and r.name != "link")


def test_counter_rates_as_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    schema = "host string, at timestamp, total long"
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = telemetry.counter_rates(spark.readStream.schema(schema).parquet(source), "host", "at", "total")
    for rows in ([("a", at(0), 10), ("b", at(0), 5), ("a", at(5), 20)], [("a", at(10), 15), ("b", at(0), 9), ("a", at(12), 35)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted((r.key, r.at.second, r.rate) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 0.0), ("a", 5, 2.0), ("a", 10, -1.0), ("a", 12, 10.0), ("b", 0, 0.0), ("b", 0, 0.0)]


def test_messages_are_typed_envelopes(spark):
    rows = spark.createDataFrame([(1, "x")], "a int, b string")
    assert [r.message for r in telemetry.messages(rows, "metrics").collect()] == ['{"type":"metrics","data":{"a":1,"b":"x"}}']


def test_served_files_stay_within_the_folder(spark, tmp_path):
    """Links that lead out are denied, those that stay within are followed; folders and reserved paths aren't files."""
    (tmp_path / "out.txt").write_text("secret")
    top = tmp_path / "top"
    (top / "sub").mkdir(parents=True)
    (top / "sub/a.txt").write_text("12345")
    (top / "inner").symlink_to(top / "sub/a.txt")
    (top / "leak").symlink_to(tmp_path / "out.txt")
    (top / "up").symlink_to(tmp_path)
    paths = ["sub/a.txt", "inner", "leak", "up/out.txt", "up/top/sub/a.txt", "sub", "", "../out.txt", "api/x", "sub/none", str(tmp_path / "out.txt"), None]
    got = {r.path: (r.status, r.size) for r in file_tree.served(spark, str(top), spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {
        "sub/a.txt": ("found", 5), "inner": ("found", 5), "leak": ("denied", None), "up/out.txt": ("denied", None), "up/top/sub/a.txt": ("found", 5), "sub": ("missing", None), "": ("missing", None),
        "../out.txt": ("missing", None), "api/x": ("missing", None), "sub/none": ("missing", None), str(tmp_path / "out.txt"): ("denied", None), None: ("missing", None),
    }


def test_a_scan_is_kept_until_something_changes(spark, tmp_path):
    top, out = tmp_path / "top", str(tmp_path / "out")
    (top / "sub").mkdir(parents=True)
    (top / "sub/a.txt").write_text("1")
    assert catalog_scan.write(spark, str(top), out) is None
    written = lambda: max(p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*"))
    first = written()
    assert catalog_scan.write(spark, str(top), out) == 0 and written() == first
    assert catalog_scan.write(spark, str(top), out, force=True) == 0 and written() > first
    (top / "sub/b.txt").write_text("22")
    (top / "empty").mkdir()
    assert catalog_scan.write(spark, str(top), out) == 2  # the file and the empty folder
    assert spark.read.json(f"{out}/files").count() == 2
