"""Queries over entities, drafts, runs, invoices, manifests and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.operators import dashboard, drafts, incremental
from dossierflow.plans.bridge import NOW_S, entities, inventory, runs, with_ent, with_inv, with_runs
from dossierflow.plans.registry import query
from dossierflow.session import read_table

# ---------------------------------------------------------------- drafts and states

DRAFTS = "draft AS (SELECT doc_id AS draft_id, concat('batch-', CAST(doc_id % 6 AS STRING)) AS batch, name, (doc_id % 21) / 20.0::DOUBLE AS confidence FROM inv), state AS (SELECT doc_id AS draft_id, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'parked' ELSE 'rejected' END AS stato FROM inv WHERE doc_id % 3 <> 0), ds AS (SELECT d.*, coalesce(s.stato, 'pending') AS stato FROM draft d LEFT JOIN state s USING (draft_id))"


def _with_drafts(sql: str) -> str:
    return with_inv("").rstrip() + f", {DRAFTS} {sql}"


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = inventory(spark, sf_dir)
    draft = inv.select(F.col("doc_id").alias("draft_id"), F.concat(F.lit("batch-"), (F.col("doc_id") % 6).cast("string")).alias("batch"), "name", ((F.col("doc_id") % 21) / 20.0).alias("confidence"))
    stato = F.when(F.col("doc_id") % 4 == 0, "approved").when(F.col("doc_id") % 4 == 1, "parked").otherwise("rejected")
    states = inv.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("draft_id"), stato.alias("stato"))
    return drafts.with_state(draft, states)


@query("J5_draft_state", _with_drafts("SELECT draft_id, batch, stato FROM ds"))
def j5(spark, sf_dir):
    return _drafts(spark, sf_dir).select("draft_id", "batch", "stato")


@query("F14_draft_filter", _with_drafts("SELECT draft_id FROM ds WHERE stato = 'parked' AND contains(lower(name), 'offerta')"))
def f14(spark, sf_dir):
    return drafts.draft_filter(_drafts(spark, sf_dir), "parked", "Offerta").select("draft_id")


@query("F15_bulk_approve", _with_drafts("SELECT draft_id, CASE WHEN stato IN ('pending', 'parked') AND confidence >= 0.85 THEN 'approved' ELSE stato END AS stato FROM ds"))
def f15(spark, sf_dir):
    return drafts.bulk_approve(_drafts(spark, sf_dir)).select("draft_id", "stato")


@query("A6_J17_state_pivot", _with_drafts("SELECT batch, count(*) FILTER (stato = 'pending') AS pending, count(*) FILTER (stato = 'approved') AS approved, count(*) FILTER (stato = 'rejected') AS rejected, count(*) FILTER (stato = 'edited') AS edited, count(*) FILTER (stato = 'parked') AS parked FROM ds GROUP BY batch"))
def a6(spark, sf_dir):
    return drafts.state_counts(_drafts(spark, sf_dir))


@query("K9_flush_plan", _with_drafts("SELECT draft_id, CASE WHEN stato = 'rejected' THEN 'archive' WHEN stato NOT IN ('approved', 'edited') THEN 'keep' WHEN draft_id % 5 = 0 THEN 'rename' ELSE 'write' END AS action, CASE WHEN stato IN ('approved', 'edited') THEN CASE WHEN draft_id % 5 = 0 THEN concat('t/', CAST(draft_id AS STRING), '-1.md') ELSE concat('t/', CAST(draft_id AS STRING), '.md') END END AS target FROM ds"))
def k9(spark, sf_dir):
    rows = _drafts(spark, sf_dir).withColumn("target", F.concat(F.lit("t/"), F.col("draft_id").cast("string"), F.lit(".md")))
    existing = rows.where("draft_id % 5 = 0").select("target")
    return drafts.flush_plan(rows, existing, "rename").select("draft_id", "action", "target")


# ---------------------------------------------------------------- dashboards

SPENT = "SELECT event_type AS model, CASE user_id % 3 WHEN 0 THEN 'categorize' WHEN 1 THEN 'narrative' ELSE 'extract' END AS stage, value FROM events"


@query("A7_cost_grouping_sets", f"SELECT model, stage, count(*) AS n_calls, round(sum(value), 2) AS cost FROM ({SPENT}) GROUP BY GROUPING SETS ((), (model), (stage))")
def a7(spark, sf_dir):
    stage = F.when(F.col("user_id") % 3 == 0, "categorize").when(F.col("user_id") % 3 == 1, "narrative").otherwise("extract")
    return dashboard.cost_totals(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), stage.alias("stage"), F.col("value").alias("cost_eur")))


@query("A4_J2_source_progress", with_inv("SELECT source, count(*) AS discovered, count(*) FILTER (sha256 IS NOT NULL AND substr(sha256, 1, 12) IN (SELECT substr(sha256, 1, 12) FROM inv WHERE doc_id % 2 = 0)) AS extracted, count(categoria) AS categorized FROM inv GROUP BY source"))
def a4(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    return dashboard.source_progress(inv, inv.where("doc_id % 2 = 0 AND sha256 IS NOT NULL").select(F.substring("sha256", 1, 12).alias("sha12")))


@query("J3_to_extract", with_inv("SELECT doc_id FROM inv WHERE sha256 IS NOT NULL AND substr(sha256, 1, 12) NOT IN (SELECT substr(sha256, 1, 12) FROM inv WHERE doc_id % 2 = 0 AND sha256 IS NOT NULL)"))
def j3(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    done = inv.where("doc_id % 2 = 0 AND sha256 IS NOT NULL").select(F.substring("sha256", 1, 12).alias("sha12"))
    return inv.where("sha256 IS NOT NULL").withColumn("sha12", F.substring("sha256", 1, 12)).join(done, "sha12", "left_anti").select("doc_id")


@query("A12_entity_rollup", with_ent("SELECT entity_type, status, count(*) AS n FROM ent GROUP BY GROUPING SETS ((entity_type, status), (entity_type), (status))"))
def a12(spark, sf_dir):
    return dashboard.entity_rollup(entities(spark, sf_dir))


@query("A13_A20_counts", with_ent("SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending FROM ent"))
def a13(spark, sf_dir):
    return entities(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))


@query("A14_pages_per_area", "SELECT area, count(url) AS n FROM (VALUES ('a'), ('b'), ('c'), ('zzz')) t(area) LEFT JOIN pages ON CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END = area GROUP BY area")
def a14(spark, sf_dir):
    area = F.when(F.col("page_id") % 3 == 0, "a").when(F.col("page_id") % 3 == 1, "b").otherwise("c")
    return dashboard.zero_filled(read_table(spark, sf_dir, "pages").withColumn("area", area), "area", ("a", "b", "c", "zzz"))


@query("A15_dormant", f"SELECT o_custkey AS client, max(o_orderdate) AS last_seen FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1998-06-01' - INTERVAL 90 DAY")
def a15(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), F.col("o_orderdate").alias("seen"))
    return dashboard.dormant(rows, F.lit("1998-06-01").cast("timestamp"))


@query("A16_usage", "SELECT event_type, sum(user_id) AS tokens, round(sum(value), 2) AS cost, count(*) AS n FROM events GROUP BY 1")
def a16(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("user_id").alias("tokens"), F.round(F.sum("value"), 2).alias("cost"), F.count("*").alias("n"))


@query("A22_last_runs", with_runs("SELECT CASE WHEN command LIKE 'scan fs%' THEN 'fs' WHEN command LIKE 'scan gdrive%' THEN 'gdrive' WHEN command LIKE 'scan outlook%' THEN 'outlook' ELSE 'other' END AS source, count(*) AS n FROM (SELECT * FROM runs ORDER BY id DESC LIMIT 50) GROUP BY 1"))
def a22(spark, sf_dir):
    return dashboard.last_runs(runs(spark, sf_dir), 50)


@query("A23_lint_counts", "SELECT doc_id, length(text) - length(replace(text, '. ', '.')) AS n_marks, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n_lines FROM documents")
def a23(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\. ")).cast("long").alias("n_marks"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"))


@query("J9_compliance", with_inv("SELECT o.folder, r.need FROM (SELECT DISTINCT folder FROM inv) o CROSS JOIN (VALUES ('fattura_rossi.pdf'), ('note.txt'), ('scheda.md')) r(need) WHERE NOT EXISTS (SELECT 1 FROM inv i WHERE i.folder = o.folder AND i.name = r.need)"))
def j9(spark, sf_dir):
    return dashboard.missing_files(inventory(spark, sf_dir), ("fattura_rossi.pdf", "note.txt", "scheda.md"))


@query("J10_broken_links", "SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) WHERE link NOT IN (SELECT url FROM pages)")
def j10(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return dashboard.broken_links(pages, "page_id", "html", r'href="([^"]+)"', pages.select(F.col("url").alias("link")))


@query("Y1_next_actions", with_inv("SELECT CASE WHEN count(*) = 0 THEN 'empty' ELSE concat_ws('|', CASE WHEN count(*) FILTER (sha256 IS NULL) > 0 THEN 'extract' END, CASE WHEN count(*) FILTER (categoria IS NULL) > 0 THEN 'categorize' END, CASE WHEN count(*) FILTER (categoria = 'da-chiarire') > 0.2 * count(categoria) THEN 'unclear' END) END AS actions FROM inv"))
def y1(spark, sf_dir):
    return dashboard.next_actions(inventory(spark, sf_dir))


@query(
    "Y1_all_actions",
    _with_drafts(
        """, progress AS (SELECT count(*) AS d, count(sha256) FILTER (substr(sha256, 1, 12) IN (SELECT substr(sha256, 1, 12) FROM inv WHERE doc_id % 2 = 0)) AS e, count(categoria) AS c, 100.0 * count(*) FILTER (categoria = 'da-chiarire') / count(categoria) AS u FROM inv),
objects AS (SELECT count(DISTINCT folder) AS n FROM inv WHERE folder NOT IN (SELECT folder FROM inv WHERE name = 'scheda.md'))
SELECT 2 AS place, 'extract' AS action, (d - e)::DOUBLE AS n FROM progress WHERE d > e UNION ALL SELECT 3, 'categorize', (d - c)::DOUBLE FROM progress WHERE d > c
UNION ALL SELECT 4, 'approve', count(*)::DOUBLE FROM ds WHERE stato = 'pending' HAVING count(*) > 0 UNION ALL SELECT 5, 'review-rules', round(u, 1) FROM progress WHERE round(u, 1) > 20
UNION ALL SELECT 6, 'clean-orphans', count(*)::DOUBLE FROM inv WHERE categoria IS NULL HAVING count(*) > 0 UNION ALL SELECT 7, 'complete-objects', n::DOUBLE FROM objects WHERE n > 0""".lstrip()
    ).replace("(draft_id)) , progress", "(draft_id)), progress"),
)
def y1_all(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    done = inv.where("doc_id % 2 = 0 AND sha256 IS NOT NULL").select(F.substring("sha256", 1, 12).alias("sha12"))
    drafts_ = _drafts(spark, sf_dir).groupBy(F.col("stato").alias("name")).agg(F.count("*").alias("n"))
    categories = inv.where("categoria IS NOT NULL").groupBy(F.col("categoria").alias("name")).agg(F.count("*").alias("n"))
    missing = dashboard.missing_files(inv, ("scheda.md",)).select(F.lit("srv").alias("area"), F.col("folder").alias("object"))
    return dashboard.all_actions(dashboard.source_progress(inv, done), drafts_, categories, inv.where("categoria IS NULL"), missing)


@query("Y4_confidence_label", with_ent("SELECT pk, CASE WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.7 THEN 'medium' ELSE 'high' END AS label FROM ent"))
def y4(spark, sf_dir):
    return entities(spark, sf_dir).select("pk", dashboard.confidence_label(F.col("confidence")).alias("label"))


@query("W11_throughput", with_runs("SELECT id, row_number() OVER (PARTITION BY command ORDER BY id) AS done, start_s - min(start_s) OVER (PARTITION BY command ORDER BY id) AS elapsed_s FROM runs"))
def w11(spark, sf_dir):
    return dashboard.throughput(runs(spark, sf_dir), "command", "id", "start_s")


@query("W11_eta", with_runs("SELECT id, done, elapsed_s, CASE WHEN elapsed_s > 0 THEN done / elapsed_s END AS rate, CASE WHEN elapsed_s > 0 AND done < total THEN (total - done) / (done / elapsed_s) END AS eta_s FROM (SELECT id, row_number() OVER (PARTITION BY command ORDER BY id) AS done, start_s - min(start_s) OVER (PARTITION BY command ORDER BY id) AS elapsed_s, count(*) OVER (PARTITION BY command) AS total FROM runs)"))
def w11_eta(spark, sf_dir):
    rows = runs(spark, sf_dir)
    return dashboard.eta(rows, rows.groupBy("command").agg(F.count("*").alias("total")), "command", "id", "start_s")


# ---------------------------------------------------------------- entities

FIELDS = ["nome", "piva", "settore", "note"]


@query("A17_fill_rate", with_ent("SELECT pk, round((CASE WHEN trim(coalesce(nome, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(piva, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(settore, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(note, '')) <> '' THEN 1 ELSE 0 END) / 4, 2) AS fill_rate FROM ent"))
def a17(spark, sf_dir):
    return incremental.fill_rate(entities(spark, sf_dir), FIELDS).select("pk", "fill_rate")


MERGE_SQL = """, seq AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY pk) AS k FROM ent),
RECURSIVE_fold AS (SELECT entity_type, entity_id, k, CASE WHEN trim(coalesce(nome, '')) = '' THEN nome ELSE nome END AS nome, settore, trim(coalesce(note, '')) AS note, CAST(confidence AS DOUBLE) AS confidence FROM seq WHERE k = 1
 UNION ALL SELECT s.entity_type, s.entity_id, s.k,
  CASE WHEN trim(coalesce(f.nome, '')) = '' THEN s.nome WHEN trim(coalesce(s.nome, '')) = '' OR f.confidence >= s.confidence THEN f.nome ELSE s.nome END,
  CASE WHEN trim(coalesce(f.settore, '')) = '' THEN s.settore WHEN trim(coalesce(s.settore, '')) = '' OR f.confidence >= s.confidence THEN f.settore ELSE s.settore END,
  CASE WHEN f.note = '' THEN trim(coalesce(s.note, '')) WHEN trim(coalesce(s.note, '')) IN ('', f.note) THEN f.note ELSE concat(f.note, chr(10), chr(10), '---', chr(10), chr(10), trim(s.note)) END,
  (f.confidence + s.confidence) / 2 FROM RECURSIVE_fold f JOIN seq s ON s.entity_type = f.entity_type AND s.entity_id = f.entity_id AND s.k = f.k + 1)
SELECT entity_type, entity_id, nome, settore, note, round(confidence, 6) AS confidence, CAST(k AS INTEGER) AS n FROM RECURSIVE_fold WHERE (entity_type, entity_id, k) IN (SELECT entity_type, entity_id, max(k) FROM seq GROUP BY 1, 2)"""


@query("A18_merge_entities", with_ent(MERGE_SQL.lstrip()).replace("WITH ", "WITH RECURSIVE ", 1).replace(") , seq", "), seq").replace("RECURSIVE_fold", "fold"))
def a18(spark, sf_dir):
    merged = incremental.merge_candidates(entities(spark, sf_dir), ["entity_type", "entity_id"], "pk", ["nome", "settore"], ["note"])
    return merged.withColumn("confidence", F.round("confidence", 6))


@query("J12_field_diff", with_ent("""SELECT pk, field, old, new, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'lost' WHEN old = new THEN 'same' ELSE 'changed' END AS kind FROM (
 SELECT pk, f.field, CASE f.field WHEN 'nome' THEN nome WHEN 'piva' THEN CASE WHEN trim(piva) <> '' THEN piva END ELSE settore END AS old,
  CASE f.field WHEN 'nome' THEN CASE WHEN pk % 4 = 0 THEN NULL ELSE nome END WHEN 'piva' THEN CASE WHEN pk % 3 = 0 THEN 'IT0' ELSE CASE WHEN trim(piva) <> '' THEN piva END END ELSE settore END AS new
 FROM ent CROSS JOIN (VALUES ('nome'), ('piva'), ('settore')) f(field)) WHERE old IS NOT NULL OR new IS NOT NULL"""))
def j12(spark, sf_dir):
    old = entities(spark, sf_dir)
    new = old.withColumns({"nome": F.when(F.col("pk") % 4 != 0, F.col("nome")), "piva": F.when(F.col("pk") % 3 == 0, "IT0").otherwise(F.col("piva"))})
    return incremental.field_diff(old, new, ["pk"], ["nome", "piva", "settore"])


DECISIONS = "SELECT event_id AS ts, event_id % 200 AS pk, CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'edit' ELSE 'skip' END AS action FROM events"


@query("J15_decisions", with_ent(f"SELECT pk, coalesce(CASE a WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'edit' THEN 'edited' END, status) AS status FROM ent LEFT JOIN (SELECT pk, arg_max(action, ts) AS a FROM ({DECISIONS}) WHERE action <> 'skip' GROUP BY pk) USING (pk)"))
def j15(spark, sf_dir):
    action = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "edit").otherwise("skip")
    decisions = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("ts"), (F.col("event_id") % 200).alias("pk"), action.alias("action"))
    return incremental.latest_decision(entities(spark, sf_dir), decisions).select("pk", "status")


@query("K10_upsert", with_ent("SELECT coalesce(o.pk, n.pk) AS pk, CASE WHEN n.pk IS NOT NULL THEN n.nome ELSE o.nome END AS nome, CASE WHEN n.pk IS NOT NULL THEN 'pending' ELSE o.status END AS status, coalesce(o.written, n.written) AS written FROM (SELECT * FROM ent WHERE pk % 2 = 0) o FULL JOIN (SELECT pk, nome || '!' AS nome, false AS written FROM ent WHERE pk % 3 = 0) n ON o.pk = n.pk"))
def k10(spark, sf_dir):
    rows = entities(spark, sf_dir).select("pk", "nome", "status", "written")
    changes = rows.where("pk % 3 = 0").select("pk", F.concat("nome", F.lit("!")).alias("nome"), F.lit("pending").alias("status"), F.lit(False).alias("written"))
    return incremental.upsert(rows.where("pk % 2 = 0"), changes, ["pk"], keep=("written",))


# ---------------------------------------------------------------- manifests

FILES = "fa AS (SELECT 'fs' AS connector, concat('f', CAST(doc_id AS STRING)) AS source_id, substr(sha256(text), 1, 32) AS hash, doc_id * 10 AS mtime_s, n_chars AS size FROM documents WHERE doc_id % 4 <> 0), fb AS (SELECT 'fs' AS connector, CASE WHEN doc_id % 7 = 0 THEN concat('moved', CAST(doc_id AS STRING)) ELSE concat('f', CAST(doc_id AS STRING)) END AS source_id, substr(sha256(text), 1, 32) AS hash, doc_id * 10 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime_s, n_chars AS size FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents").withColumn("hash", F.substring(F.sha2("text", 256), 1, 32))
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    manifest = docs.where("doc_id % 4 <> 0").select(F.lit("fs").alias("connector"), name("f").alias("source_id"), "hash", (F.col("doc_id") * 10).alias("mtime_s"), F.col("n_chars").alias("size"))
    files = docs.select(F.lit("fs").alias("connector"), F.when(F.col("doc_id") % 7 == 0, name("moved")).otherwise(name("f")).alias("source_id"), "hash", (F.col("doc_id") * 10 + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("mtime_s"), F.col("n_chars").alias("size"))
    return files, manifest


@query("J7_J8_scan_state", f"WITH {FILES} SELECT b.source_id, CASE WHEN a.source_id IS NOT NULL AND a.mtime_s = b.mtime_s AND a.size = b.size THEN 'unchanged' WHEN a.source_id IS NOT NULL THEN 'changed' WHEN EXISTS (SELECT 1 FROM fa r WHERE r.hash = b.hash AND r.source_id <> b.source_id) THEN 'renamed' ELSE 'new' END AS state FROM fb b LEFT JOIN fa a USING (connector, source_id)")
def j7(spark, sf_dir):
    return incremental.scan_state(*_files(spark, sf_dir)).select("source_id", "state")


@query("J6_J14_insert_if_absent", f"WITH {FILES} SELECT hash, min(source_id) AS source_id FROM fb WHERE hash NOT IN (SELECT hash FROM fa) GROUP BY hash")
def j14(spark, sf_dir):
    files, manifest = _files(spark, sf_dir)
    return incremental.insert_if_absent(files, manifest, "hash", "source_id").select("hash", "source_id")


# ---------------------------------------------------------------- invoices

@query(
    "S12_X28_invoices",
    """SELECT o_orderkey, c_name AS client, strftime(o_orderdate, '%Y') AS year, n_lines, total, body FROM orders JOIN customer ON o_custkey = c_custkey JOIN (
 SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total, string_agg(concat('- riga ', l_linenumber, ': ', CAST(CAST(l_quantity AS BIGINT) AS STRING)), chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS body FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def s12(spark, sf_dir):
    from dossierflow.operators.documents import invoices

    return invoices(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "customer"))


@query(
    "T2_throttle",
    """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
fold AS (SELECT user_id, k, t AS last, true AS ok FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.k, CASE WHEN e.t - f.last >= 86400 THEN e.t ELSE f.last END, e.t - f.last >= 86400 FROM fold f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, last AS at FROM fold WHERE ok""",
)
def t2(spark, sf_dir):
    from dossierflow.streaming.watch import throttled

    events = read_table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").cast("double").alias("at"))
    return throttled(events, "user_id", "at", 86400.0)


@query("T3_content_dedup", "SELECT sha256(text) AS sha256, count(*) > 0 AS fresh FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def t3(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("sha256", F.sha2("text", 256))
    fresh = docs.dropDuplicates(["sha256"]).join(docs.where("doc_id % 5 = 0").select("sha256"), "sha256", "left_anti")
    return fresh.select("sha256", F.lit(True).alias("fresh"))


@query("T7_stalled_runs", with_runs(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'running' AND coalesce(heartbeat_s, start_s) < {NOW_S} - 300 THEN 'interrupted' ELSE status END AS status FROM runs) GROUP BY 1"))
def t7(spark, sf_dir):
    from dossierflow.operators.filters import interrupted

    return runs(spark, sf_dir).groupBy(F.when(interrupted(NOW_S - 300), "interrupted").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))
