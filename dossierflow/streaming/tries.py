"""Work on a micro-batch that is tried again where it fails, and dead letters after the last try."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.text import letter_mark
from dossierflow.session import written

#: Tries, and seconds between them.
TRIES, PAUSE = 3, 5.0


class Outcome(NamedTuple):
    good: DataFrame  #: rows of `work`, without `error`, and `attempts`
    dead: DataFrame  #: (path, attempts, error)


def with_tries(batch: DataFrame, number: int, work: Callable[[DataFrame, int], DataFrame], folder: str, tries: int = TRIES, pause: float = PAUSE, key: str = "path") -> Outcome:
    """`work(rows, k)` over the batch, then over what failed, up to `tries` times.

    `work` gives the key, `error` (null where all went well) and columns of its own. Each try is a table of its own,
    batch=N/try=K below `folder`, and is never made twice: a batch that is run again after a crash goes on with the try
    it was at, and one that was done just reads. A try that fails as a whole (an exception of the job) leaves no table,
    so the batch's failure is Spark's to handle.
    """
    spark = batch.sparkSession
    own = lambda k: f"{folder.rstrip('/')}/batch={number}/try={k}"
    rows, made = batch, []
    for k in range(1, tries + 1):
        if not written(spark, own(k)):
            if k > 1:
                time.sleep(pause)
            work(rows, k).write.mode("overwrite").parquet(own(k))
        result = spark.read.parquet(own(k))
        made.append(result.withColumn("attempts", F.lit(k)))
        failed = result.where("error IS NOT NULL").select(key)
        if failed.isEmpty():
            break
        rows = batch.join(failed, key, "left_semi")
    good = made[0].where("error IS NULL")
    for m in made[1:]:
        good = good.unionByName(m.where("error IS NULL"))
    return Outcome(good.drop("error"), made[-1].where("error IS NOT NULL").select(key, "attempts", "error"))


def bury(dead: DataFrame, batch: DataFrame, number: int, folder: str, key: str = "path") -> None:
    """Dead letters of a batch: `letters` with path, sha12 of head and path, attempts, error and time, and `contents` with a copy."""
    head = letter_mark(F.col("content"), F.col(key)).alias("sha12")
    rows = dead.join(batch.select(key, "content"), key).select(key, head, "attempts", "error", F.current_timestamp().alias("at"), "content")
    rows.drop("content").write.mode("overwrite").json(f"{folder.rstrip('/')}/letters/batch={number}")
    rows.select("sha12", key, "content").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/contents/batch={number}")
