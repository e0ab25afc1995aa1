"""The pruned walk, counters, cancelling and signs of life."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import runs
from dossierflow.sources import walk


@pytest.fixture()
def tree(tmp_path):
    put = lambda path, data=b"x": (os.makedirs(os.path.dirname(f"{tmp_path}/t/{path}"), exist_ok=True), open(f"{tmp_path}/t/{path}", "wb").write(data))  # noqa: E731, SIM115
    for path in ("a.txt", "sub/b.txt", "sub/deep/c.md", "_old/d.txt", "sub/_old/e.txt", "Library/Caches/f.txt", "Library/notes/g.txt", "sub/big.txt", "odd.bin", "Caches/h.txt"):
        put(path, b"x" * 50 if "big" in path else b"x")
    put("real.pdf", b"%PDF-1.7 body")
    put("false.pdf", b"plain text")
    os.makedirs(f"{tmp_path}/outside")
    open(f"{tmp_path}/outside/secret.txt", "w").close()
    os.symlink(f"{tmp_path}/outside", f"{tmp_path}/t/away")
    os.symlink(f"{tmp_path}/t/sub/deep", f"{tmp_path}/t/near")
    os.symlink(f"{tmp_path}/t", f"{tmp_path}/t/sub/up")
    os.symlink(f"{tmp_path}/nowhere", f"{tmp_path}/t/broken")
    return f"{tmp_path}/t"


RULES = {"excludes": ("_*",), "max_bytes": 20, "extensions": (".txt", ".md", ".pdf")}


@pytest.mark.parametrize("parts", ["1", "3", "1000"])
def test_what_is_left_out_is_never_entered(spark, tree, parts):
    got = {r.relative: r.reason for r in walk.walk(spark, f"file://{tree}", **RULES, parts=parts).collect()}
    assert got == {
        "a.txt": None, "sub": None, "sub/b.txt": None, "sub/deep": None, "sub/deep/c.md": None, "_old": "excluded", "sub/_old": "excluded", "Library": None, "Library/Caches": "library",
        "Library/notes": None, "Library/notes/g.txt": None, "sub/big.txt": "size", "odd.bin": "extension", "Caches": None, "Caches/h.txt": None, "real.pdf": None, "false.pdf": None,
        "away": "link", "near": "link", "sub/up": "link",
    }


def test_links_inside_are_followed_on_demand(spark, tree):
    got = {r.relative: r.reason for r in walk.walk(spark, tree, **RULES, follow_links="true").collect()}
    assert got["near/c.md"] is None and got["away"] == "escape" and got["sub/up"] == "link"
    assert not any(p.startswith("away/") for p in got)


def test_roots_too_wide_are_refused(spark):
    with pytest.raises(Exception, match="too wide"):
        walk.walk(spark, "/home").count()


def test_contents_are_read_of_the_rest_alone(spark, tree):
    files = walk.walk(spark, tree, **RULES)
    manifest = files.where("relative = 'a.txt'").select("path", "size", "mtime").unionByName(files.where("relative = 'sub/b.txt'").select("path", (F.col("size") + 1).alias("size"), "mtime"))
    os.chmod(f"{tree}/sub/deep/c.md", 0o600)
    rows = {r.relative: (r.reason, r.content and bytes(r.content)) for r in walk.contents(walk.unchanged(files, manifest)).where("kind = 'file'").collect()}
    assert rows["a.txt"] == ("manifest", None) and rows["sub/b.txt"] == (None, b"x")
    assert rows["false.pdf"] == ("magic", None) and rows["real.pdf"] == (None, b"%PDF-1.7 body") and rows["sub/big.txt"] == ("size", None)


def test_estimate_is_capped(spark, tree):
    args = {"excludes": ("_*",)}
    assert walk.estimate(spark, tree, **args, cap_seconds=60.0) == 9
    assert walk.estimate(spark, tree, **args, cap_files=9, cap_seconds=60.0) is None
    assert walk.estimate(spark, tree, **args, cap_seconds=0.0) is None


def test_counters_come_with_the_rows(spark, tmp_path):
    rows = spark.range(100).withColumn("n", F.col("id") % 10)
    reason = F.when(F.col("n") < 3, "small").when(F.col("n") == 9, "odd")
    kept, seen = runs.counted(rows, reason, ("small", "large"))
    kept.write.parquet(f"{tmp_path}/kept")
    assert seen.get == {"small": 30, "large": 0, "other": 10, "kept": 60}
    assert spark.read.parquet(f"{tmp_path}/kept").columns == ["id", "n"]
    assert runs.snapshot(seen, 0.0, 200, now=50.0) == {"status": "running", "current": 100, "total": 200, "throughput": 2.0, "eta_s": 50.0, "skipped": {"small": 30, "other": 10}}


def test_a_cancelled_run_ends_as_partial_and_goes_on(spark, tmp_path):
    made, folder = [], f"{tmp_path}/runs"
    busy = lambda: spark.range(400).repartition(200).mapInPandas(lambda it: (time.sleep(0.5) or f for f in it), "id long").count()
    steps = [("one", lambda: made.append(1)), ("two", busy), ("three", lambda: made.append(3))]
    timer = threading.Timer(4.0, runs.cancel, (spark, "run-1"))
    timer.start()
    began = time.time()
    assert runs.run_steps(spark, "run-1", steps, folder) == "partial"
    assert time.time() - began < 30 and made == [1]
    steps[1] = ("two", lambda: made.append(2))
    assert runs.run_steps(spark, "run-1", steps, folder) == "done" and made == [1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        runs.run_steps(spark, "run-2", [("bad", lambda: 1 / 0)], folder)
    noted = {(r.run, r.step, r.status) for r in runs.read_runs(spark, folder).collect()}
    assert noted == {("run-1", "one", "done"), ("run-1", "two", "partial"), ("run-1", "two", "done"), ("run-1", "three", "done"), ("run-1", None, "done"), ("run-2", "bad", "failed")}


def test_within(spark):
    assert runs.within(spark, 60.0, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        runs.within(spark, 60.0, lambda: 1 / 0)


def test_streams_leave_signs_of_life(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    listener = runs.heartbeats(spark, f"{tmp_path}/beats")
    try:
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 30
        read = lambda: spark.read.json(f"{tmp_path}/beats").where(F.col("query") == str(query.id)) if os.path.isdir(f"{tmp_path}/beats") else None
        while time.time() < until and not (read() is not None and read().where("status = 'ended'").count()):
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert [(r.status, r.rows) for r in read().orderBy("at_s").collect() if r.status != "idle"] == [("started", None), ("running", 10), ("ended", None)]
    clock = [0.0]
    beats = []
    quiet = runs.Heartbeat(beats.append, 60.0, lambda: clock[0])
    for t in (0.0, 61.0, 90.0, 122.0):
        clock[0] = t
        quiet.onQueryIdle(type("E", (), {"id": "q"}))
    assert [b["at_s"] for b in beats] == [61.0, 122.0]
