"""Out-of-order events by window, and the stream of directory changes."""

from __future__ import annotations

import datetime
import os
import random

from pyspark.sql import functions as F

from larkspur.sources import tree_changes
from larkspur.streaming import late

SCHEMA = "k string, at timestamp, v double"
DAY = datetime.datetime(2024, 1, 1)


def put(spark, folder, rows) -> None:
    spark.createDataFrame([(k, DAY + datetime.timedelta(seconds=s), v) for k, s, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def plain(batches, size, delay):
    """Closed windows and late rows by the rule, batch by batch."""
    top, windows, done, missed = {}, {}, {}, {}
    for rows in batches:
        before = dict(top)
        for k, s, v in rows:
            w = (k, s // size * size)
            if k in before and w[1] + size <= before[k] - delay:
                missed.setdefault(w, []).append(v)
            else:
                windows.setdefault(w, []).append(v)
            top[k] = max(top.get(k, s), s)
        for w in [w for w in windows if w[1] + size <= top[w[0]] - delay]:
            done[w] = windows.pop(w)
    return done, missed


def as_found(df):
    rows = df.groupBy("key", "window_start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).collect()
    return {(r.key, int((r.window_start - DAY).total_seconds())): (r.n, round(r.total, 6), r.least, r.greatest) for r in rows}


def sums(groups):
    return {w: (len(vs), round(sum(vs), 6), min(vs), max(vs)) for w, vs in groups.items()}


def test_late_rows_are_counted_apart_and_a_restart_changes_nothing(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(k, max(0, 300 * n + rng.randrange(300) - rng.choice([0, 0, 0, 100, 500])), float(rng.randrange(9))) for k in "ab" for _ in range(12)] for n in range(5)]
    stream = lambda: late.closed_windows(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k", "at", "v", 60 * 10**6, 120 * 10**6, "1 day")
    done, missed = plain(batches, 60, 120)
    assert missed and done
    for rows in batches[:3]:
        put(spark, tmp_path / "in", rows)
    late.run_apart(stream(), str(tmp_path / "out"))
    for rows in batches[3:]:
        put(spark, tmp_path / "in", rows)
    closed, behind = late.run_apart(stream(), str(tmp_path / "out"))
    assert closed.count() == len(done)
    assert as_found(closed) == sums(done) and as_found(behind) == sums(missed)


def test_state_of_quiet_keys_expires(spark, tmp_path):
    """A new key in every batch: each is closed and forgotten once the watermark is past it."""
    for n in range(6):
        put(spark, tmp_path / "in", [(f"key {n}", 1000 * n, 1.0), (f"key {n}", 1000 * n + 5, 2.0)])
    stream = late.closed_windows(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k", "at", "v", 60 * 10**6, 0, "10 seconds")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", late.STORE)
    try:
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(held) <= 12
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.key for r in out.where("n = 2").collect()} >= {f"key {n}" for n in range(5)}


def run_changes(spark, tmp_path, force=False):
    """One scan, delivered by batch number."""
    out = str(tmp_path / "out")
    stream = tree_changes.changes(spark, str(tmp_path / "tree"), str(tmp_path / "seen"), force)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    return {(r.change, r.dir, r.name) for r in rows if r.scan == max(x.scan for x in rows)}, rows


def test_changes_of_a_directory(spark, tmp_path):
    put_file = lambda name, text: ((tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / "tree" / name).write_text(text))
    for name in ("a.txt", "src/b.py", "src/deep/c.py", "docs/d.md", "node_modules/x.js", ".git/y"):
        put_file(name, "1")
    first, _ = run_changes(spark, tmp_path)
    assert first == {("added", "", "a.txt"), ("added", "", "src"), ("added", "", "docs"), ("added", "src", "b.py"), ("added", "src", "deep"), ("added", "src/deep", "c.py"), ("added", "docs", "d.md")}
    put_file("src/b.py", "longer")
    put_file("new/e.txt", "1")
    os.remove(tmp_path / "tree/docs/d.md")
    os.rmdir(tmp_path / "tree/docs")
    second, rows = run_changes(spark, tmp_path)
    assert second == {("changed", "src", "b.py"), ("added", "", "new"), ("added", "new", "e.txt"), ("removed", "", "docs"), ("removed", "docs", "d.md")}
    # Each change is there once, over all runs.
    assert len(rows) == len({(r.scan, r.change, r.dir, r.name) for r in rows}) == len(first) + len(second)


def test_a_batch_that_runs_again_gives_the_same_rows(tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a").write_text("1")
    options = {"path": str(tmp_path / "tree"), "state": str(tmp_path / "seen")}
    reader = tree_changes.TreeChangesReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    once = [list(reader.read(p)) for p in reader.partitions(start, end)]
    (tmp_path / "tree/b").write_text("2")
    again = tree_changes.TreeChangesReader(options)
    assert [list(again.read(p)) for p in again.partitions(start, end)] == once
    reader.commit(end)
    later = again.latestOffset()
    assert [r[1:4] for p in again.partitions(end, later) for r in again.read(p)] == [("added", "", "b")]
    forced = tree_changes.TreeChangesReader(options | {"force": "true"})
    assert {r[3] for p in forced.partitions(end, later) for r in forced.read(p)} == {"a", "b"}


def test_scans_by_the_clock(spark, tmp_path):
    """A processing-time trigger scans again and again; nothing new gives no rows."""
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a").write_text("1")
    stream = tree_changes.changes(spark, str(tmp_path / "tree"), str(tmp_path / "seen"))
    query = stream.writeStream.format("memory").queryName("tree_scans").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if query.lastProgress and query.lastProgress["batchId"] >= 2:
                break
    finally:
        query.stop()
    assert [r.name for r in spark.sql("SELECT name FROM tree_scans").collect()] == ["a"]
    assert query.lastProgress["batchId"] >= 2
