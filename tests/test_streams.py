"""Changed files, keyed state with timers, and tries before dead letters."""

import json
import os
import pickle
import time
import tracemalloc

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dossierflow.sources import changes
from dossierflow.streaming import keyed, tries, watch


def put(folder, name, text, at):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(path, (at, at))


# ---------------------------------------------------------------- changed files


def drain(spark, tmp_path, **options):
    """One run over what has changed; what it gave, as (name, content, change)."""
    out = []
    source = changes.changed_files(spark, f"file://{tmp_path}/in", f"{tmp_path}/state", **options)
    query = source.writeStream.foreachBatch(lambda df, _: out.extend((r.name, bytes(r.content).decode(), r.change) for r in df.collect()))
    query.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return sorted(out)


def test_a_changed_file_comes_once_more(spark, tmp_path):
    box = f"{tmp_path}/in"
    put(box, "a.txt", "one", 1000)
    put(box, "deep/er/b.txt", "two", 900)
    put(box, ".hidden/x.txt", "no", 900)
    put(box, "c.txt~", "no", 900)
    os.symlink(f"{box}/a.txt", f"{box}/link.txt")
    assert drain(spark, tmp_path) == [("a.txt", "one", "new"), ("b.txt", "two", "new")]
    assert drain(spark, tmp_path) == []
    put(box, "a.txt", "three", 2000)
    put(box, "old.txt", "copied with an old time", 10)
    assert drain(spark, tmp_path) == [("a.txt", "three", "changed"), ("old.txt", "copied with an old time", "new")]
    os.remove(f"{box}/a.txt")
    assert drain(spark, tmp_path) == []
    put(box, "a.txt", "three", 2000)
    assert drain(spark, tmp_path) == [("a.txt", "three", "new")]


def test_lists_fold_and_a_bound_leaves_the_rest(spark, tmp_path, monkeypatch):
    lists = changes._Lists(f"{tmp_path}/state")
    box = f"{tmp_path}/in"
    for k in range(5):
        put(box, f"f{k}.txt", str(k), 100 + k)
    seen = []
    for _ in range(3):
        seen += drain(spark, tmp_path, max_files="2")
    assert sorted(seen) == [(f"f{k}.txt", str(k), "new") for k in range(5)]
    reader = changes.ChangesReader({"root": box, "state": f"{tmp_path}/state"})
    monkeypatch.setattr(changes, "FOLD_AFTER", 3)
    reader.commit({"version": 3})
    assert lists.names("base") == [2] and lists.names("list") == [3]
    assert drain(spark, tmp_path) == []
    put(box, "f0.txt", "again", 500)
    assert drain(spark, tmp_path) == [("f0.txt", "again", "changed")]


def test_a_stream_that_stops_at_what_is_there_reads_it_all(spark, tmp_path):
    for k in range(5):
        put(f"{tmp_path}/in", f"f{k}.txt", str(k), 100 + k)
    assert sorted(drain(spark, tmp_path, max_files="2")) == [(f"f{k}.txt", str(k), "new") for k in range(5)]


def test_the_lists_of_the_last_listing_stay(tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "FOLD_AFTER", 3)
    reader = changes.ChangesReader({"root": f"{tmp_path}/in", "state": f"{tmp_path}/state", "max_files": "2"})
    for k in range(5):
        put(f"{tmp_path}/in", f"f{k}.txt", str(k), 100 + k)
    end = reader.latestOffset()
    reader.commit(end)
    assert sorted(x[0][-6:] for p in reader.partitions({"version": 0}, end) for x in p.value) == [f"f{k}.txt" for k in range(5)]


def test_parts_are_cut_by_size(tmp_path):
    reader = changes.ChangesReader({"root": f"{tmp_path}/in", "state": f"{tmp_path}/state", "chunk_bytes": "10"})
    for k, n in enumerate((4, 4, 4, 30, 1)):
        put(f"{tmp_path}/in", f"f{k}", "x" * n, 100 + k)
    end = reader.latestOffset()
    assert [[x[2] for x in p.value] for p in reader.partitions({"version": 0}, end)] == [[4, 4], [4], [30], [1]]
    os.remove(f"{tmp_path}/in/f3")
    assert [b.num_rows for p in reader.partitions({"version": 0}, end) for b in reader.read(p)] == [1, 1, 1, 1]


def test_the_driver_holds_no_more_for_more_files(tmp_path, monkeypatch):
    """What listing and planning hold, and what partitions carry, is the same for five times the files."""
    for name, value in (("SORT_ROWS", 200), ("SPOOLED", 10), ("MERGED", 10)):
        monkeypatch.setattr(changes, name, value, raising=False)
    held, carried = [], []
    for n in (2000, 10_000):
        box = f"{tmp_path}/in{n}"
        for k in range(n):
            put(box, f"{k % 10}/f{k}.txt", "", 100 + k)
        seen = []
        for turn in range(2):
            reader = changes.ChangesReader({"root": box, "state": f"{tmp_path}/state{n}"})
            tracemalloc.start()
            end = reader.latestOffset()
            parts = reader.partitions({"version": 0}, end)
            seen.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert end == {"version": 1} and len({x[0] for p in parts for x in p.value}) == n
        held.append(max(seen))
        carried.append(sum(len(pickle.dumps(p)) for p in parts) / len(parts))
    assert held[1] < 2 * held[0] and carried[1] < 1.1 * carried[0]


def test_lists_are_sorted_in_files_and_the_last_word_counts(tmp_path, monkeypatch):
    """Three listings read as one batch, with names that break lines."""
    monkeypatch.setattr(changes, "SORT_ROWS", 2, raising=False)
    monkeypatch.setattr(changes, "MERGED", 2, raising=False)
    box, options = f"{tmp_path}/in", {"root": f"{tmp_path}/in", "state": f"{tmp_path}/state", "max_files": "3"}
    names = [f"f{k}.txt" for k in range(7)] + ["a\nb", "c\u2028d", "e\rf"]
    for k, name in enumerate(names):
        put(box, name, "x", 100 + k)
    first = changes.ChangesReader(options).latestOffset()
    assert first == {"version": 4}
    put(box, "f1.txt", "new", 500)
    os.remove(f"{box}/f2.txt")
    os.remove(f"{box}/f3.txt")
    assert changes.ChangesReader(options).latestOffset() == {"version": 5}
    put(box, "f3.txt", "back", 600)
    reader = changes.ChangesReader(options)
    end = reader.latestOffset()
    lines = lambda start: {x[0].removeprefix(f"{box}/"): (x[1] // 10**9, x[3]) for p in reader.partitions({"version": start}, end) for x in p.value}
    rest = {n: (100 + k, "new") for k, n in enumerate(names) if n not in ("f1.txt", "f2.txt", "f3.txt")}
    assert end == {"version": 6} and lines(0) == rest | {"f1.txt": (500, "changed"), "f3.txt": (600, "new")}
    assert lines(4) == {"f1.txt": (500, "changed"), "f3.txt": (600, "new")} and lines(5) == {"f3.txt": (600, "new")}
    monkeypatch.setattr(changes, "FOLD_AFTER", 3)
    reader.commit(end)
    assert changes._Lists(options["state"]).names("batch") == [] and changes._Lists(options["state"]).names("base") == [5]
    assert changes.ChangesReader(options).latestOffset() == {"version": 6}


# ---------------------------------------------------------------- keyed state


def feed(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")


def run_until(query, checkpoint, done, seconds=60):
    """Timers keep micro-batches going, so the query is stopped when it has given what is waited for."""
    running = query.option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + seconds
        while not done() and time.time() < until and running.isActive:
            time.sleep(0.1)
        time.sleep(1.0)
    finally:
        running.stop()


def test_throttle_equals_the_batch_form(spark, tmp_path):
    schema = "key string, at double"
    one = [("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 3.5), ("b", 9.0), ("a", 4.0), (None, 1.0), (None, 1.5), ("b", None)]
    two = [("a", 5.0), ("a", 6.0), ("a", 3.0), ("b", 10.5), ("b", 11.0), (None, 3.0)]
    got = set()
    for k, rows in enumerate((one, two)):
        feed(spark, tmp_path, f"in/k={k}", rows, schema)
        stream = spark.readStream.schema(schema + ", k int").parquet(f"{tmp_path}/in").select("key", "at")
        query = keyed.throttle(stream, "key", "at").writeStream.foreachBatch(lambda df, _: got.update((r.key, r.at, r.late) for r in df.collect()))
        size = len(got)
        run_until(query, f"{tmp_path}/cp", lambda size=size: len(got) > size)
    batch = watch.throttled(spark.createDataFrame([r for r in one + two if r != ("a", 3.0)], schema), "key", "at")
    assert {(k, t) for k, t, late in got if not late} == {(r.key, r.at) for r in batch.collect()}
    assert {r for r in got if r[2]} == {("a", 3.0, True)}


def test_idle_keys_leave_the_state_and_stalled_runs_end(spark, tmp_path):
    schema = "run string, status string, beat_s double"
    feed(spark, tmp_path, "in/k=0", [("r1", "running", 1.0), ("r2", "running", 1.0), ("r3", "running", 1.0), ("r3", "done", 2.0)], schema)
    stream = spark.readStream.schema(schema + ", k int").parquet(f"{tmp_path}/in").drop("k")
    got = []
    query = keyed.ended_runs(stream, 4.0).writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect()))
    fed = []

    def done():
        if got and not fed:
            fed.append(feed(spark, tmp_path, "in/k=1", [("r2", "failed", 3.0)], schema))
        return len(got) >= 3

    run_until(query, f"{tmp_path}/cp", done)
    assert sorted(got) == [("r1", "interrupted", 1.0), ("r2", "failed", 3.0), ("r3", "done", 2.0)]


def test_a_key_is_forgotten_after_its_idle_time(spark, tmp_path):
    got = []
    for k, pause in ((0, 0), (1, 3)):
        time.sleep(pause)
        feed(spark, tmp_path, f"in/k={k}", [("a", 1.0 + k)], "key string, at double")
        stream = spark.readStream.schema("key string, at double, k int").parquet(f"{tmp_path}/in").select("key", "at")
        query = keyed.throttle(stream, "key", "at", gap=1000.0, idle_ms=1500).writeStream.foreachBatch(lambda df, _: got.extend((r.key, r.at, r.late) for r in df.collect()))
        run_until(query, f"{tmp_path}/cp", lambda k=k: len(got) > k)
    assert got == [("a", 1.0, False), ("a", 2.0, False)]


# ---------------------------------------------------------------- tries


def work_with(log, plan, crash_at=None):
    """Fails each path as often as `plan` says; notes (try, paths)."""

    def work(rows, k):
        log.append((k, sorted(r.path for r in rows.select("path").collect())))
        if crash_at == k:
            raise RuntimeError("the driver goes down")
        fails = F.lit(False)
        for path, n in plan.items():
            fails |= (F.col("path") == path) & F.lit(n >= k)
        return rows.select("path", F.upper("content").alias("text"), F.when(fails, F.concat(F.lit("boom "), "path")).alias("error"))

    return work


BATCH = [("ok", "a"), ("shaky", "b"), ("dead", "c")]


def test_three_tries_then_dead(spark, tmp_path):
    batch, log = spark.createDataFrame(BATCH, "path string, content string"), []
    work = work_with(log, {"shaky": 2, "dead": 3})
    for _ in range(2):  # the second time, after a restart, nothing is done again
        out = tries.with_tries(batch, 7, work, f"{tmp_path}/t", pause=0.0)
        assert sorted(map(tuple, out.good.collect())) == [("ok", "A", 1), ("shaky", "B", 3)]
        assert [tuple(r) for r in out.dead.collect()] == [("dead", 3, "boom dead")]
    assert log == [(1, ["dead", "ok", "shaky"]), (2, ["dead", "shaky"]), (3, ["dead", "shaky"])]


def test_a_restart_goes_on_with_its_try(spark, tmp_path):
    batch, log = spark.createDataFrame(BATCH, "path string, content string"), []
    with pytest.raises(RuntimeError, match="goes down"):
        tries.with_tries(batch, 0, work_with(log, {"shaky": 2, "dead": 3}, crash_at=2), f"{tmp_path}/t", pause=0.0)
    out = tries.with_tries(batch, 0, work_with(log, {"shaky": 2, "dead": 3}), f"{tmp_path}/t", pause=0.0)
    assert [(r.path, r.attempts) for r in out.dead.collect()] == [("dead", 3)] and out.good.count() == 2
    assert [k for k, _ in log] == [1, 2, 2, 3]
    tries.bury(out.dead, batch.withColumn("content", F.col("content").cast("binary")), 0, f"{tmp_path}/d")
    letter = spark.read.json(f"{tmp_path}/d/letters").first()
    assert (letter.path, letter.attempts, letter.error) == ("dead", 3, "boom dead") and len(letter.sha12) == 12
    assert bytes(spark.read.parquet(f"{tmp_path}/d/contents").first().content) == b"c"


def test_watch_takes_changes_and_tries_again(spark, tmp_path):
    put(f"{tmp_path}/in", "good.txt", "Preventivo per il cliente Rossi", 100)
    put(f"{tmp_path}/in", "bad.xyz", "?", 100)
    log = []
    base = watch.worked(F.current_timestamp())

    def work(rows, k):
        log.append((k, rows.count()))
        return base(rows, k).withColumn("error", F.when((F.col("name") == "good.txt") & F.lit(k == 1), "not yet").otherwise(F.col("error")))

    args = (f"{tmp_path}/inv", f"{tmp_path}/dead", f"{tmp_path}/cp")
    run = lambda: watch.watch(spark, f"{tmp_path}/in", *args, changes=f"{tmp_path}/state", work=work, pause=0.0).awaitTermination()
    run()
    assert log == [(1, 2), (2, 2), (3, 1)]
    assert [(r.name, r.attempts) for r in spark.read.parquet(args[0]).collect()] == [("good.txt", 2)]
    assert json.loads(spark.read.text(f"{args[1]}/letters").first()[0])["error"] == "no parser"
    put(f"{tmp_path}/in", "good.txt", "another text", 200)
    put(f"{tmp_path}/in", "copy.xyz", "?", 200)
    run()
    assert spark.read.parquet(args[0]).count() == 2 and spark.read.json(f"{args[1]}/letters").count() == 1
    with pytest.raises(PySparkException):
        spark.read.parquet(f"{tmp_path}/nothing")
