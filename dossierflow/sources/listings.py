"""Listings of cloud drives and mail services from JSON dumps; `paged` reads services page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.session import settled

NATIVE_EXPORTS = {
    "application/vnd.google-apps.document": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.google-apps.spreadsheet": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
EPOCH = "1970-01-01 00:00:00"
DRIVE = "struct<id:string,name:string,mimeType:string,size:string,modifiedTime:string,parents:array<string>,owners:array<struct<emailAddress:string,displayName:string>>,md5Checksum:string,trashed:boolean>"
ONEDRIVE = "struct<id:string,name:string,size:bigint,lastModifiedDateTime:string,webUrl:string,file:struct<mimeType:string,hashes:struct<quickXorHash:string>>,parentReference:struct<driveId:string,path:string>,createdBy:struct<user:struct<email:string,displayName:string>>>"
MESSAGE = "struct<id:string,subject:string,receivedDateTime:string,from:struct<emailAddress:struct<name:string,address:string>>,toRecipients:array<struct<emailAddress:struct<name:string,address:string>>>,body:struct<contentType:string,content:string>>"


def _time(col: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(col), F.lit(EPOCH).cast("timestamp"))


def _items(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """The items of dumps that are either an object with a list in `field` or the list itself."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", f"array<{item}>")).otherwise(F.from_json("v", f"struct<{field}:array<{item}>>")[field])
    return raw.select(F.explode(listed).alias("i")).where("i IS NOT NULL")


def drive_listing(spark: SparkSession, path: str) -> DataFrame:
    i = _items(spark, path, "files", DRIVE)
    owner = F.get("i.owners", F.lit(0))
    return i.where(~F.coalesce("i.trashed", F.lit(False))).select(
        F.lit("gdrive").alias("source"), F.col("i.id").alias("source_id"), F.col("i.name").alias("name"),
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NATIVE_EXPORTS.items() for x in kv]), F.col("i.mimeType")), F.col("i.mimeType")).alias("mime"),
        F.coalesce(F.expr("try_cast(i.size AS BIGINT)"), F.lit(0).cast("long")).alias("size"), _time(F.col("i.modifiedTime")).alias("mtime"),
        F.coalesce(owner["emailAddress"], owner["displayName"]).alias("author"), F.get("i.parents", F.lit(0)).alias("parent_id"),
    )


def onedrive_listing(spark: SparkSession, path: str) -> DataFrame:
    i = _items(spark, path, "value", ONEDRIVE)
    return i.select(
        F.lit("m365").alias("source"), F.col("i.id").alias("source_id"), F.col("i.name").alias("name"), F.concat_ws("/", "i.parentReference.path", "i.name").alias("path"),
        F.col("i.file.mimeType").alias("mime"), F.coalesce("i.size", F.lit(0).cast("long")).alias("size"), _time(F.col("i.lastModifiedDateTime")).alias("mtime"),
        F.coalesce("i.createdBy.user.email", "i.createdBy.user.displayName").alias("author"),
    )


def message_listing(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    rows = _items(spark, path, "value", MESSAGE).select(
        F.col("i.id").alias("source_id"), F.col("i.subject").alias("subject"), _time(F.col("i.receivedDateTime")).alias("received"), F.col("i.from.emailAddress.address").alias("from"),
        F.filter(F.transform("i.toRecipients", lambda r: r["emailAddress"]["address"]), lambda a: a.isNotNull() & (a != "")).alias("to"), F.col("i.body.content").alias("body"),
    )
    return rows.where(F.col("received") >= F.lit(since).cast("timestamp")) if since else rows


def drive_paths(folders: DataFrame, root: str, max_depth: int = 64) -> DataFrame:
    """(id, path) of the folders below `root` from (id, parent_id, name): level by level, each folder once, cycles end.

    Each level is written, so the next one reads it instead of all before. Folders deeper than `max_depth` are an error.
    """
    level = folders.where(F.col("parent_id") == root).select("id", F.col("name").alias("path"))
    out = level
    for _ in range(max_depth):
        parents = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_p"))
        below = folders.join(parents, "parent_id").select("id", F.concat_ws("/", "_p", "name").alias("path"))
        level = settled(below.join(out.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"folders lie deeper than {max_depth} levels")
