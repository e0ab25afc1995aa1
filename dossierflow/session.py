"""Session and table helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "dossierflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or of the context; in local mode one of our own where neither is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='dossierflow-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out evenly, for work that costs more by row than a shuffle: a small table is one row group and so one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, so that every reader sees the same rows and partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written a table at `path` to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
