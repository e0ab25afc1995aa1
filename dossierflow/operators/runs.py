"""Runs: counters without a second pass, signs of life, cancelling by job tag, steps that end as done, partial or failed."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

T = TypeVar("T")
#: Fixed value: seconds between signs of life.
BEAT_S = 60.0


# ---------------------------------------------------------------- counters


def counted(rows: DataFrame, reason: Column, reasons: Iterable[str], name: str = "counters") -> tuple[DataFrame, Observation]:
    """The rows without a reason, and the counts that come about as they are read: one for each reason, `other`, `kept`."""
    names = list(reasons)
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    marked = rows.withColumn("_reason", reason)
    count = lambda cond, as_: F.count_if(cond).alias(as_)
    observed = marked.observe(
        seen,
        *[count(F.col("_reason") == r, r) for r in names],
        count(F.col("_reason").isNotNull() & ~F.col("_reason").isin(names), "other"),
        count(F.col("_reason").isNull(), "kept"),
    )
    return observed.where("_reason IS NULL").drop("_reason"), seen


def snapshot(seen: Observation, started: float, total: int | None = None, status: str = "running", now: float | None = None) -> dict:
    """What a run has to show: current, total, throughput a second, seconds to go, and the counts of what was left out."""
    counts = dict(seen.get)
    current, passed = sum(counts.values()), max((time.time() if now is None else now) - started, 1e-9)
    rate = current / passed
    return {
        "status": status,
        "current": current,
        "total": total,
        "throughput": rate,
        "eta_s": (total - current) / rate if total is not None and rate > 0 else None,
        "skipped": {k: v for k, v in counts.items() if k != "kept" and v},
    }


# ---------------------------------------------------------------- cancelling


_cancelled: set[str] = set()


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the Spark jobs of a tagged run and keeps its further steps from starting. From any thread; again does no harm."""
    _cancelled.add(tag)
    spark.sparkContext.cancelJobsWithTag(tag)


def is_cancelled(tag: str) -> bool:
    return tag in _cancelled


def within(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T | None:
    """What `work` gives, or None if its jobs take longer than so many seconds; they are cancelled then."""
    tag, found, raised = f"within-{uuid.uuid4().hex}", [], []

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            found.append(work())
        except Exception as e:
            if not is_cancelled(tag):
                raised.append(e)
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=run)
    thread.start()
    thread.join(seconds)
    late = thread.is_alive()
    while thread.is_alive():  # a job may start after a cancel
        cancel(spark, tag)
        thread.join(0.2)
    _cancelled.discard(tag)
    if raised:
        raise raised[0]
    return found[0] if found and not late else None


# ---------------------------------------------------------------- records of runs


def _append(spark: SparkSession, folder: str, row: dict) -> None:
    """One JSON line as a file of its own, so writers never meet."""
    line = json.dumps(row, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(folder)


def run_steps(spark: SparkSession, run: str, steps: Iterable[tuple[str, Callable[[], None]]], folder: str) -> str:
    """Runs steps in order under the job tag `run` and notes each in `folder`: done, partial (cancelled) or failed.

    A step that is cancelled, or the next one after a cancel, ends the run as `partial`; what earlier steps have written
    stays. Steps noted as done for this run are not done again, so a partial or failed run goes on where it was. An
    error that no cancel explains is noted and raised.
    """
    context = spark.sparkContext
    done = finished_steps(spark, run, folder)
    note = lambda step, status, error=None: _append(spark, folder, {"run": run, "step": step, "status": status, "error": error, "at": datetime.now(UTC).isoformat()})
    for step, work in steps:
        if step in done:
            continue
        if is_cancelled(run):
            note(step, "partial")
            _cancelled.discard(run)
            return "partial"
        context.addJobTag(run)
        try:
            work()
        except Exception as e:
            context.removeJobTag(run)
            if is_cancelled(run):
                note(step, "partial")
                _cancelled.discard(run)
                return "partial"
            note(step, "failed", str(e)[:500])
            raise
        context.removeJobTag(run)
        note(step, "done")
    note(None, "done")
    return "done"


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("run string, step string, status string, error string, at timestamp").json(folder)


def finished_steps(spark: SparkSession, run: str, folder: str) -> set[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return set()
    rows = read_runs(spark, folder).where((F.col("run") == run) & (F.col("status") == "done") & F.col("step").isNotNull())
    return {r.step for r in rows.select("step").distinct().collect()}


# ---------------------------------------------------------------- signs of life


class Heartbeat(StreamingQueryListener):
    """Notes start, each batch, idle triggers (at most every `beat_s` seconds) and end of streams, through `write(row)`."""

    def __init__(self, write: Callable[[dict], None], beat_s: float = BEAT_S, clock: Callable[[], float] = time.time):
        self.write, self.beat_s, self.clock = write, beat_s, clock
        self.last: dict[str, float] = {}
        self.lock = threading.Lock()

    def _note(self, query: object, status: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        with self.lock:
            self.last[str(query)] = self.clock()
        self.write({"query": str(query), "status": status, "batch": batch, "rows": rows, "error": error, "at_s": self.clock()})

    def onQueryStarted(self, event) -> None:
        self._note(event.id, "started")

    def onQueryProgress(self, event) -> None:
        self._note(event.progress.id, "running", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        if self.clock() - self.last.get(str(event.id), 0.0) >= self.beat_s:
            self._note(event.id, "idle")

    def onQueryTerminated(self, event) -> None:
        self._note(event.id, "failed" if event.exception else "ended", error=event.exception and event.exception[:500])


def heartbeats(spark: SparkSession, folder: str, beat_s: float = BEAT_S) -> Heartbeat:
    """Streams of this session leave signs of life as JSON lines in `folder`; `spark.streams.removeListener` ends that."""
    listener = Heartbeat(lambda row: _append(spark, folder, row), beat_s)
    spark.streams.addListener(listener)
    return listener
