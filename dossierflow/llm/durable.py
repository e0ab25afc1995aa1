"""Tables that cut lineage: written to the cluster's shared checkpoint folder, so that lost executors cost little."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder; where neither is set, a folder of our own
    in local mode. On a cluster executors could not share that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='dossierflow-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written Parquet table, removed by `drop` or when the driver process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Removes tables that `cut` has given and that no later plan reads."""
    for table in tables:
        entry = (table.sparkSession, table._cut_path)
        _written.remove(entry)
        _remove(*entry)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Has the driver forget plans that nothing refers to, whose shuffle files Spark then removes from the executors."""
    gc.collect()
    with contextlib.suppress(Exception):
        spark._jvm.System.gc()


@atexit.register
def purge() -> None:
    """Removes all tables that `cut` has written."""
    while _written:
        _remove(*_written.pop())
