"""File sources: binary scans, wholetext vaults, JSON-lines inventories, snapshot and append sinks."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.sources.stores import read_files

INVENTORY = "source string, source_id string, path string, name string, size long, mtime string, mime string, author string, sha256 string, categoria string, confidence double, reason string"


def scan_files(spark: SparkSession, root: str, source: str, max_mb: int = 100, with_hash: bool = True, glob: str | None = None) -> DataFrame:
    """Inventory rows of a folder tree. Size filters come before the hash, so skipped files are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(root).where(F.col("length") <= max_mb * 1024 * 1024)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    columns = [F.lit(source).alias("source"), F.col("path").alias("source_id"), "path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return rows.select(*columns, F.sha2("content", 256).alias("sha256")) if with_hash else rows.select(*columns)


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every Markdown file below root, listed and read in tasks."""
    return read_files(spark, root, "*.md").select("path", F.col("content").cast("string").alias("text"))


def read_inventory(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """JSON-lines inventories; files named _* are no inventories. Strict fails on a bad line, else it is left out."""
    rows = spark.read.schema(INVENTORY).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(paths)
    return rows.where(~F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).startswith("_"))


def append_inventory(rows: DataFrame, root: str) -> None:
    """Adds rows to the JSON-lines inventory, a folder per source."""
    rows.write.mode("append").partitionBy("source").json(root)


def write_snapshot(rows: DataFrame, root: str) -> str:
    """Writes a whole new snapshot beside the old ones, then adds a pointer to it: readers see the old or the new one."""
    name = f"snapshot-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{name}")
    spark = rows.sparkSession
    pointer = spark.createDataFrame([(json.dumps({"at": time.time_ns(), "current": name}),)], "value string").coalesce(1)
    pointer.write.mode("append").text(f"{root}/_current")
    return name


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    newest = spark.read.schema("at long, current string").json(f"{root}/_current").agg(F.max_by("current", "at"))
    name = newest.first()[0]
    return spark.read.parquet(f"{root}/{name}")


def write_extractions(rows: DataFrame, root: str) -> None:
    """Extraction results keyed by the first twelve characters of the content hash."""
    rows.withColumn("sha12", F.substring("sha256", 1, 12)).write.mode("append").parquet(root)


def write_pages(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, action): what publishing (path, text) over `existing` does: create, skip if identical, or back up and replace."""
    joined = pages.join(existing.select("path", F.col("text").alias("_old")), "path", "left")
    return joined.withColumn("action", F.when(F.col("_old").isNull(), "create").when(F.col("_old") == F.col("text"), "skip").otherwise("backup-and-replace")).drop("_old")
