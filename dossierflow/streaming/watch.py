"""The inbox as a stream: file drops, throttling, content dedup, dead letters, and a hook after each micro-batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossierflow.operators.categorize import classify
from dossierflow.operators.filters import editor_temp
from dossierflow.sources.changes import changed_files
from dossierflow.sources.extract import extract, kind_of
from dossierflow.streaming.tries import PAUSE, TRIES, bury, with_tries


def drops(spark: SparkSession, inbox: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder tree (path, name, size, mtime, content, sha256); editors' temporary files are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(inbox)
    named = raw.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return named.where(~editor_temp()).withColumn("sha256", F.sha2("content", 256))


def changed(spark: SparkSession, inbox: str, state: str) -> DataFrame:
    """New and changed files of a folder tree, in the columns of `drops`."""
    return changed_files(spark, inbox, state).drop("change").withColumn("sha256", F.sha2("content", 256))


def throttled(events: DataFrame, key: str, clock: str, gap: float = 2.0) -> DataFrame:
    """Batch form of the leading-edge throttle: an event counts iff `gap` seconds have passed since the last that did.

    A task reads its keys' events in order and keeps the last accepted time alone, so a key may have any number of
    them. Events without a time are left out; a null key is a key.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        was = last = None
        for frame in frames:
            keys, times = frame[key], frame[clock].to_numpy(dtype=float)
            same = keys.eq(keys.shift()) | (keys.isna() & keys.shift().isna())
            starts = [0, *(k for k in np.flatnonzero(~same.to_numpy()).tolist() if k), len(frame)]
            kept = []
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                k = None if pd.isna(keys.iloc[a]) else keys.iloc[a]
                if last is None or k != was:
                    was, last = k, -math.inf
                at = a + int(np.searchsorted(times[a:b], last + gap))
                while at < b:
                    kept.append(at)
                    last = times[at]
                    at = max(at + 1, a + int(np.searchsorted(times[a:b], last + gap)))
            yield frame.iloc[kept]

    rows = events.select(key, F.col(clock).cast("double").alias(clock)).where(F.col(clock).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, clock).mapInPandas(step, rows.schema)


def worked(now) -> Callable[[DataFrame, int], DataFrame]:
    """Extraction and classification of files as work that may be tried again: a row a file, `error` where it failed."""

    def work(files: DataFrame, attempt: int) -> DataFrame:
        parsed = extract(files.select("path", "content"))
        rows = classify(files.drop("content").join(parsed, "path", "left"), now)
        return rows.withColumn("error", F.coalesce("warning", F.when(kind_of(F.col("path")).isNull(), "no parser"))).drop("warning")

    return work


def watch(
    spark: SparkSession,
    inbox: str,
    inventory: str,
    dead_letters: str,
    checkpoint: str,
    after: Callable[[DataFrame, int], None] | None = None,
    max_files: int = 1000,
    changes: str | None = None,
    work: Callable[[DataFrame, int], DataFrame] | None = None,
    tries: int = TRIES,
    pause: float = PAUSE,
) -> StreamingQuery:
    """Processes all files that are there and stops; call again, or set another trigger, to go on from the checkpoint.

    Contents seen before are left out by keyed state, dealt out by hash, so a batch costs what is new in it; contents
    that ended as dead letters count as seen. With `changes`, a folder for the lists of `changed_files`, a changed file
    comes again; without, files count once by path. Each file is tried up to `tries` times. Micro-batches write to
    folders of their own number, so one that is repeated after a failure replaces itself and goes on with its tries.
    """

    def each(batch: DataFrame, number: int) -> None:
        own = f"{inventory}/batch={number}"
        rows = batch.persist()
        outcome = with_tries(rows, number, work or worked(F.current_timestamp()), f"{dead_letters}/tries", tries, pause)
        outcome.good.write.mode("overwrite").parquet(own)
        bury(outcome.dead, rows, number, dead_letters)
        if after is not None:
            after(spark.read.parquet(own), number)
        rows.unpersist()

    files = drops(spark, inbox, max_files) if changes is None else changed(spark, inbox, changes)
    return files.dropDuplicates(["sha256"]).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
