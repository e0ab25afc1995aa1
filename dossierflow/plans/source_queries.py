"""Queries through sources and sinks: dumps, trees and streams are written from the given tables and read back by the source under test."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.operators import runs
from dossierflow.plans import entity_queries  # noqa: F401  (its SQL is used again)
from dossierflow.plans.bridge import INV_SQL, NOW_S, inventory, with_inv
from dossierflow.plans.registry import ORACLES, query
from dossierflow.session import read_table, shared_folder
from dossierflow.sources import paged, walk
from dossierflow.sources.changes import changed_files
from dossierflow.sources.stores import write_files
from dossierflow.streaming.keyed import throttle
from dossierflow.streaming.tries import with_tries


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- paged services

#: Messages of a resource each: one an hour for each conversation, a minute a turn. One in 50 lacks its id.
MAIL = "SELECT role AS resource, conv_id * 3600 + turn * 60 AS at_s, CASE WHEN (conv_id + turn) % 50 = 7 THEN NULL ELSE concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) END AS item_id, length(text) AS n_chars FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"


def _mail(spark: SparkSession, sf_dir: str) -> str:
    """A folder of stored pages, written from `conversations`."""
    rows = read_table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    at = F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60)
    name = F.when((F.col("conv_id") + F.col("turn")) % 50 != 7, F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    item = F.to_json(F.struct(name.alias("id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("receivedDateTime"), F.col("text").alias("body")))
    root = _folder(spark, "mail")
    paged.write_pages(rows.select(F.col("role").alias("resource"), at.alias("at"), item.alias("item")), root)
    return root


def _read_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged.read_pages(spark, _mail(spark, sf_dir), ("system", "user", "assistant"), time_field="receivedDateTime", order="newest-first", max_pages=str(10**9))


@query("S11_F10_mail_since", f"SELECT resource, item_id, at_s, n_chars FROM ({MAIL}) WHERE resource IN ('user', 'system') AND item_id IS NOT NULL AND at_s >= 36000")
def s11(spark, sf_dir):
    found = _read_mail(spark, sf_dir).where("resource IN ('user', 'system') AND at >= timestamp'1970-01-01 10:00:00'")
    return found.select("resource", "item_id", F.unix_timestamp("at").alias("at_s"), F.length(F.get_json_object("item", "$.body")).alias("n_chars"))


@query("S11_Y11_mail_isolation", f"SELECT resource, CASE WHEN item_id IS NULL THEN 'no id' ELSE 'processed' END AS outcome, count(*) AS n FROM ({MAIL}) GROUP BY ALL")
def y11(spark, sf_dir):
    return _read_mail(spark, sf_dir).groupBy("resource", F.coalesce("problem", F.lit("processed")).alias("outcome")).agg(F.count("*").alias("n"))


SERVICE = """SELECT 'clients' AS resource, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier
 UNION ALL SELECT 'invoices', o_orderkey, concat('order of ', CAST(o_custkey AS STRING)) FROM orders"""


@query("S12_numbered_pages", f"SELECT resource, CAST(id AS STRING) AS item_id, name FROM ({SERVICE})")
def s12_pages(spark, sf_dir):
    part = lambda table, resource, key, name: read_table(spark, sf_dir, table).select(F.lit(resource).alias("resource"), F.col(key).cast("string").alias("id"), name.alias("name"))
    rows = part("customer", "clients", "c_custkey", F.col("c_name")).unionByName(part("supplier", "suppliers", "s_suppkey", F.col("s_name")))
    rows = rows.unionByName(part("orders", "invoices", "o_orderkey", F.concat(F.lit("order of "), F.col("o_custkey").cast("string"))))
    root = _folder(spark, "service")
    paged.write_pages(rows.select("resource", F.timestamp_seconds(F.col("id").cast("long")).alias("at"), F.to_json(F.struct("id", "name")).alias("item")), root, per_page=500, numbered=True)
    found = paged.read_pages(spark, root, ("clients", "suppliers", "invoices"), paging="numbers", per_page="500", max_pages=str(10**9))
    return found.select("resource", "item_id", F.get_json_object("item", "$.name").alias("name"))


# ---------------------------------------------------------------- the pruned walk and its counters

#: Where documents lie as files: folders and names of the inventory, an id before the name; half of the PDF files are such by their first bytes.
TREE = "SELECT doc_id, CASE WHEN substr(folder, 1, 1) = '/' THEN substr(folder, 2, length(folder) - 2) ELSE substr(folder, 1, length(folder) - 1) END AS folder, concat(CAST(doc_id AS STRING), '-', name) AS name, CASE WHEN doc_id % 2 = 0 AND lower(right(name, 4)) = '.pdf' THEN concat('%PDF', coalesce(text, '')) ELSE coalesce(text, '') END AS body FROM ({inv}) JOIN documents USING (doc_id)"
EXCLUDES, MAX_BYTES, EXTENSIONS = ("_*", "cestino", "*-~$*"), 5000, (".pdf", ".docx", ".txt")


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the documents as files, written by tasks."""
    inventory(spark, sf_dir)
    rows = spark.sql(TREE.replace("JOIN documents", "JOIN bridge_documents").format(inv=INV_SQL.format(now=NOW_S, sha="sha2(text, 256)").replace("FROM documents", "FROM bridge_documents")))
    root = _folder(spark, "tree")
    write_files(rows.select(F.concat_ws("/", "folder", "name").alias("path"), F.encode("body", "UTF-8").alias("content")), root)
    return root


WALKED = """, files AS ({tree}), met AS (SELECT *, octet_length(encode(body)) AS size, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM files
 WHERE NOT regexp_matches(folder, '(^|/)(_[^/]*|cestino)(/|$)') AND NOT contains(folder, 'Library/Caches')),
ruled AS (SELECT concat(folder, '/', name) AS relative, CASE WHEN contains(name, '-~$') THEN 'excluded' WHEN size > 5000 THEN 'size' WHEN ext NOT IN ('.pdf', '.docx', '.txt') THEN 'extension'
 WHEN doc_id % 7 = 0 THEN 'manifest' WHEN ext = '.docx' AND NOT starts_with(body, 'PK') THEN 'magic' WHEN ext = '.pdf' AND NOT starts_with(body, '%PDF') THEN 'magic' END AS reason, body FROM met)"""


def _walked(sql: str) -> str:
    tree = TREE.format(inv="SELECT * FROM inv").replace("JOIN documents", "JOIN (SELECT doc_id, text FROM documents)")
    return with_inv("").rstrip() + WALKED.format(tree=tree) + " " + sql


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = walk.walk(spark, _tree(spark, sf_dir), EXCLUDES, MAX_BYTES, EXTENSIONS).where("kind = 'file'")
    manifest = files.where(F.regexp_extract("name", r"^(\d+)-", 1).cast("long") % 7 == 0).select("path", "size", "mtime")
    return walk.contents(walk.unchanged(files, manifest))


@query("S9_F6_F7_walk", _walked("SELECT relative, reason, CASE WHEN reason IS NULL THEN sha256(body) END AS sha256 FROM ruled"))
def s9(spark, sf_dir):
    return _scanned(spark, sf_dir).select("relative", "reason", F.sha2("content", 256).alias("sha256"))


REASONS = ("excluded", "size", "extension", "manifest", "magic")


@query("A21_scan_counters", _walked("SELECT reason, n FROM (SELECT unnest(['excluded', 'size', 'extension', 'manifest', 'magic', 'kept']) AS reason) LEFT JOIN (SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ruled GROUP BY 1) USING (reason)").replace("SELECT reason, n FROM", "SELECT reason, coalesce(n, 0) AS n FROM"))
def a21(spark, sf_dir):
    """The counts of one pass that also writes what is kept."""
    kept, seen = runs.counted(_scanned(spark, sf_dir), F.col("reason"), REASONS)
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, v) for k, v in seen.get.items() if k != "other"], "reason string, n long")


@query("Y17_estimate", "SELECT count(*) AS n FROM (SELECT * FROM ({t}) WHERE NOT regexp_matches(folder, '(^|/)(_[^/]*|cestino)(/|$)') AND NOT contains(folder, 'Library/Caches') AND NOT contains(name, '-~$'))".format(t=TREE.format(inv=INV_SQL.format(now=NOW_S, sha="sha256(text)")).replace("JOIN documents", "JOIN (SELECT doc_id, text FROM documents)")))
def y17(spark, sf_dir):
    found = walk.estimate(spark, _tree(spark, sf_dir), EXCLUDES, cap_files=2**31 - 1, cap_seconds=1e6)
    return spark.createDataFrame([(found,)], "n long")


# ---------------------------------------------------------------- streams


@query(
    "T1_T6_changed_files",
    "SELECT concat('c', CAST(c_custkey AS STRING), '.txt') AS name, 'new' AS change, sha256(c_name) AS sha256 FROM customer UNION ALL SELECT concat('c', CAST(c_custkey AS STRING), '.txt'), 'changed', sha256(concat(c_name, '!')) FROM customer WHERE c_custkey % 3 = 0",
)
def t1(spark, sf_dir):
    """A file for each customer; then every third changes, and the stream is started again from its checkpoint, twice."""
    rows = read_table(spark, sf_dir, "customer")
    inbox, out = _folder(spark, "inbox"), _folder(spark, "seen")
    # In folders of a thousand, as stores other than local ones list a folder as a whole.
    place = F.concat(F.expr("CAST(c_custkey DIV 1000 AS STRING)"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    content = lambda df, text: df.select(place.alias("path"), F.encode(text, "UTF-8").alias("content"))
    for rewritten in (rows, rows.where("c_custkey % 3 = 0"), None):
        if rewritten is not None:
            write_files(content(rewritten, F.col("c_name") if rewritten is rows else F.concat("c_name", F.lit("!"))), inbox)
        stream = changed_files(spark, inbox, f"{out}-state").select("name", "change", F.sha2("content", 256).alias("sha256"))
        keep = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("name", "change", "sha256")


@query("T4_tries", "SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 3 WHEN 5 THEN 2 WHEN 7 THEN 3 ELSE 1 END AS attempts, CASE WHEN doc_id % 10 = 7 THEN 'boom 3' END AS error FROM documents")
def t4(spark, sf_dir):
    """Documents as a batch: some pass at the second or third try, some never."""

    def work(rows, attempt):
        fails = (F.col("doc_id") % 10 == 7) | ((F.col("doc_id") % 10 == 3) & F.lit(attempt < 3)) | ((F.col("doc_id") % 10 == 5) & F.lit(attempt < 2))
        return rows.select("doc_id", F.when(fails, F.lit(f"boom {attempt}")).alias("error"))

    done = with_tries(read_table(spark, sf_dir, "documents").select("doc_id"), 0, work, _folder(spark, "tries"), pause=0.0, key="doc_id")
    return done.good.select("doc_id", F.col("attempts"), F.lit(None).cast("string").alias("error")).unionByName(done.dead.select("doc_id", "attempts", "error"))


@query("T2_throttle_stream", ORACLES["T2_throttle"])
def t2_stream(spark, sf_dir):
    """The throttle as keyed state over all events. Without batches for timers the stream ends when it has read all."""
    out, setting = _folder(spark, "throttled"), "spark.sql.streaming.noDataMicroBatches.enabled"
    events = read_table(spark, sf_dir, "events")
    events.select("user_id", F.unix_timestamp("ts").cast("double").alias("at")).write.parquet(f"{out}-events")
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        stream = throttle(spark.readStream.schema("user_id long, at double").parquet(f"{out}-events"), "user_id", "at", 86400.0)
        keep = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(out).where("NOT late").select("user_id", "at")
