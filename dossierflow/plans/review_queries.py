"""Queries over reviews, publishing, validation, run states and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import dashboard, publish, redaction, review
from dossierflow.operators.dedup import ordinals
from dossierflow.plans.bridge import entities, inventory, runs, with_ent, with_inv, with_runs
from dossierflow.plans.registry import query
from dossierflow.session import read_table, spread

DAY = "2025-06-15"

# ---------------------------------------------------------------- merges

#: Old and new values of one field of each customer: equal, short, contained and long ones, and absent ones.
PAIRS = """pairs AS (SELECT c_custkey AS pk, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN concat(c_name, '
', c_mktsegment, ' long') ELSE c_name END AS old, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN NULL WHEN 2 THEN repeat(c_mktsegment, 12) ELSE c_mktsegment END AS new FROM customer)"""
MERGED = f"CASE WHEN old IS NULL THEN new WHEN new IS NULL OR old = new THEN old WHEN NOT (contains(old, chr(10)) OR contains(new, chr(10)) OR length(old) > 80 OR length(new) > 80) THEN new WHEN contains(old, new) THEN old ELSE concat(old, chr(10), chr(10), '— aggiornamento {DAY} —', chr(10), new) END"


def _pairs(spark, sf_dir):
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    old = F.when(k % 7 == 0, None).when(k % 5 == 0, F.concat(name, F.lit("\n"), segment, F.lit(" long"))).otherwise(name)
    new = F.when(k % 4 == 0, name).when(k % 4 == 1, None).when(k % 4 == 2, F.repeat(segment, 12)).otherwise(segment)
    return read_table(spark, sf_dir, "customer").select(k.alias("pk"), old.alias("old"), new.alias("new"))


def _as_map(col, key="note"):
    return F.when(col.isNotNull(), F.create_map(F.lit(key), col))


@query("X36_review_merge", f"WITH {PAIRS} SELECT pk, 'note' AS field, {MERGED} AS value FROM pairs WHERE old IS NOT NULL OR new IS NOT NULL UNION ALL SELECT pk, 'only', old FROM pairs WHERE old IS NOT NULL")
def x36(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    old = F.map_concat(F.coalesce(_as_map(F.col("old")), F.create_map().cast("map<string,string>")), F.coalesce(_as_map(F.col("old"), "only"), F.create_map().cast("map<string,string>")))
    return rows.select("pk", F.explode(review.merge_maps(old, _as_map(F.col("new")), DAY)).alias("field", "value"))


@query("X36_merge_lists", "SELECT o_custkey AS pk, list_sort(list_distinct(list_concat(list(DISTINCT o_orderpriority), ['1-URGENT', 'new']))) AS values_ FROM orders GROUP BY o_custkey")
def x36b(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pk")).agg(F.collect_set("o_orderpriority").alias("had"))
    return rows.select("pk", F.sort_array(review.merge_lists(F.col("had"), F.array(F.lit("1-URGENT"), F.lit("new")))).alias("values_"))


@query("X36_merge_body", f"WITH {PAIRS} SELECT pk, CASE WHEN trim(new) = '' OR trim(old) = trim(new) THEN old ELSE concat(old, chr(10), chr(10), '---', chr(10), '*Aggiornamento {DAY}*', chr(10), chr(10), new) END AS body FROM pairs WHERE old IS NOT NULL AND new IS NOT NULL")
def x36c(spark, sf_dir):
    return _pairs(spark, sf_dir).where("old IS NOT NULL AND new IS NOT NULL").select("pk", review.merge_body(F.concat("old", F.lit(" \n")), F.concat(F.lit("\n "), "new"), DAY).alias("body")).select("pk", F.regexp_replace("body", r" \n$", "").alias("body"))


@query("Y16_merge_as_edit", f"WITH {PAIRS} SELECT pk, {MERGED} AS note, 'edited' AS status, concat('body ', pk) AS body FROM pairs WHERE pk % 3 = 0 AND (old IS NOT NULL OR new IS NOT NULL)")
def y16(spark, sf_dir):
    rows = _pairs(spark, sf_dir).where("old IS NOT NULL OR new IS NOT NULL")
    new = rows.where("pk % 3 = 0").select("pk", _as_map(F.col("new")).alias("fields"), F.concat(F.lit("body "), "pk").alias("body"))
    out = review.merged_edits(rows.select("pk", _as_map(F.col("old")).alias("fields"), F.lit("old").alias("body")), new, ["pk"], DAY)
    return out.select("pk", F.try_element_at("fields", F.lit("note")).alias("note"), "status", "body")


FILL = "CASE WHEN trim(coalesce(a.{0}, '')) = '' THEN b.{0} WHEN trim(coalesce(b.{0}, '')) = '' THEN a.{0} WHEN a.confidence >= b.confidence THEN a.{0} ELSE b.{0} END AS {0}"


@query("U3_map_union", with_ent(f"SELECT a.pk, {FILL.format('nome')}, {FILL.format('piva')}, {FILL.format('settore')} FROM ent a JOIN ent b ON b.pk = a.pk + 1"))
def u3(spark, sf_dir):
    rows = entities(spark, sf_dir)
    pack = lambda names: F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    a = rows.select("pk", pack(["nome", "piva"]).alias("fa"), pack(["settore"]).alias("fs"), F.col("confidence").alias("ca"))
    b = rows.select((F.col("pk") - 1).alias("pk"), pack(["nome", "piva", "settore"]).alias("fb"), F.col("confidence").alias("cb"))
    merged = review.merge_confident(F.map_concat("fa", "fs"), F.col("ca"), F.col("fb"), F.col("cb"))
    return a.join(b, "pk").withColumn("m", merged).select("pk", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("nome", "piva", "settore")])


@query("X37_preview", f"WITH {PAIRS} SELECT pk, CASE WHEN old IS NULL THEN '∅' WHEN contains(old, chr(10)) THEN concat(string_split(old, chr(10))[1], ' ⏎ (', len(string_split(old, chr(10))), ' righe)') ELSE old END AS shown, CASE WHEN length(new) > 80 THEN concat(substr(new, 1, 77), '...') ELSE new END AS cut FROM pairs")
def x37(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pk", review.preview(F.col("old")).alias("shown"), review.preview_structure(F.col("new")).alias("cut"))


# ---------------------------------------------------------------- paths and slugs

KIND = "CASE c_custkey % 7 WHEN 0 THEN 'scheda-cliente' WHEN 1 THEN ' Scheda-Fornitore' WHEN 2 THEN 'scheda-commessa' WHEN 3 THEN 'decisione' WHEN 4 THEN 'persona' WHEN 5 THEN '' ELSE 'altro' END"


@query("X17_target_path", f"SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN concat('vault/clienti/', s, '/', s, '.md') WHEN 1 THEN concat('vault/fornitori/', s, '/', s, '.md') WHEN 2 THEN concat('vault/commesse/', s, '/', s, '.md') WHEN 3 THEN concat('vault/decisioni/', s, '.md') WHEN 4 THEN 'vault/references/persone.md' END AS target FROM (SELECT *, concat('s', c_custkey % 50) AS s FROM customer)")
def x17(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").withColumns({"kind": F.expr(KIND), "slug": F.concat(F.lit(" s"), (F.col("c_custkey") % 50).cast("string"))})
    return rows.select("c_custkey", review.target_path(F.col("kind"), F.col("slug")).alias("target"))


TAKEN = "SELECT concat('t', n, '.md') AS target FROM (SELECT DISTINCT c_custkey % 20 AS n FROM customer) WHERE n % 3 = 0 UNION ALL SELECT concat('t', n, '-1.md') FROM (SELECT DISTINCT c_custkey % 20 AS n FROM customer) WHERE n % 6 = 0"


@query("X17_unique_targets", "SELECT pk, CASE WHEN k = 0 THEN concat('t', n, '.md') ELSE concat('t', n, '-', k, '.md') END AS target FROM (SELECT c_custkey AS pk, c_custkey % 20 AS n, row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY c_custkey) - 1 + CASE WHEN c_custkey % 20 % 6 = 0 THEN 2 WHEN c_custkey % 20 % 3 = 0 THEN 1 ELSE 0 END AS k FROM customer)")
def x17b(spark, sf_dir):
    n = F.col("c_custkey") % 20
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), F.concat(F.lit("t"), n.cast("string"), F.lit(".md")).alias("target"))
    numbers = read_table(spark, sf_dir, "customer").select(n.alias("n")).distinct()
    name = lambda end: F.concat(F.lit("t"), F.col("n").cast("string"), F.lit(end)).alias("target")
    return review.unique_targets(rows, numbers.where("n % 3 = 0").select(name(".md")).unionByName(numbers.where("n % 6 = 0").select(name("-1.md"))), "pk")


@query("X2_slug_variants", with_inv("SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'entita-senza-nome') AS entity, domain_slug FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '!!' ELSE name END AS stem, trim(regexp_replace(split_part(lower(regexp_extract(sender, '@([^>]+)>', 1)), '.', 1), '[^a-z0-9]+', '-', 'g'), '-') AS domain_slug FROM inv WHERE sender IS NOT NULL)"))
def x2(spark, sf_dir):
    inv = inventory(spark, sf_dir).where("sender IS NOT NULL").withColumn("stem", F.when(F.col("doc_id") % 50 == 0, "!!").otherwise(F.col("name")))
    return inv.select("doc_id", X.slugify(F.col("stem"), empty="entita-senza-nome").alias("entity"), X.domain_slug(F.regexp_extract("sender", "@([^>]+)>", 1)).alias("domain_slug"))


@query("X22_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y') END AS year FROM orders")
def x22(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 5 == 0, "n/a 2020").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", X.year_of(date).alias("year"))


@query("Y10_mime", with_inv("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 3 THEN 'text/plain' ELSE 'application/pdf' END AS mime FROM inv"))
def y10(spark, sf_dir):
    return inventory(spark, sf_dir).select("doc_id", X.mime_of(F.col("name")).alias("mime"))


@query("Y10_mime_with_head", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'text/plain' ELSE CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/png' END END AS mime FROM documents")
def y10b(spark, sf_dir):
    k = F.col("doc_id")
    head = F.when(k % 5 == 0, F.lit("%PDF-1.4").cast("binary")).when(k % 5 == 1, F.unhex(F.lit("504B03040A"))).when(k % 5 == 2, F.unhex(F.lit("FFD8FFE0"))).when(k % 5 == 3, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.encode("text", "UTF-8"))
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 4 == 3, ".txt").when(k % 4 == 2, ".odd").otherwise(""))
    return read_table(spark, sf_dir, "documents").select("doc_id", X.mime_with_head(name, head).alias("mime"))


# ---------------------------------------------------------------- publishing

DRAFT = "d AS (SELECT doc_id AS draft_id, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'edited' WHEN 2 THEN 'rejected' ELSE 'parked' END AS stato, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('t', doc_id, '.md') END AS target, text, CASE WHEN doc_id % 4 = 1 THEN concat('edited ', doc_id) END AS edits FROM documents), e AS (SELECT concat('t', doc_id, '.md') AS target, concat('old ', doc_id) AS old FROM documents WHERE doc_id % 5 = 0)"


def _flush(policy):
    def run(spark, sf_dir):
        k = F.col("doc_id")
        docs = read_table(spark, sf_dir, "documents").withColumn("t", F.concat(F.lit("t"), k.cast("string"), F.lit(".md")))
        stato = F.when(k % 4 == 0, "approved").when(k % 4 == 1, "edited").when(k % 4 == 2, "rejected").otherwise("parked")
        drafts = docs.select(k.alias("draft_id"), stato.alias("stato"), F.when(k % 9 != 0, F.col("t")).alias("target"), "text", F.when(k % 4 == 1, F.concat(F.lit("edited "), k.cast("string"))).alias("edits"))
        existing = docs.where("doc_id % 5 = 0").select(F.col("t").alias("target"), F.concat(F.lit("old "), k.cast("string")).alias("text"))
        done = publish.outcomes(drafts, existing, policy)
        return done.select("draft_id", "action", "outcome", "target", F.sha2("content", 256).alias("content_sha256"))

    return run


def _flush_sql(target: str, content: str, conflict: str) -> str:
    return f"WITH {DRAFT} SELECT draft_id, stato AS action, CASE WHEN stato = 'rejected' THEN 'archived' WHEN d.target IS NULL THEN 'skipped-no-target' {conflict} ELSE 'applied' END AS outcome, {target} AS target, sha256({content}) AS content_sha256 FROM d LEFT JOIN e USING (target) WHERE stato <> 'parked'"


query("K9_publish_skip", _flush_sql("d.target", "coalesce(edits, text)", "WHEN old IS NOT NULL THEN 'skipped-conflict'"))(_flush("skip"))
query("K9_publish_merge", _flush_sql("d.target", f"CASE WHEN old IS NOT NULL THEN concat(old, chr(10), chr(10), '{publish.MERGE_MARK.strip()}', chr(10), chr(10), coalesce(edits, text)) ELSE coalesce(edits, text) END", ""))(_flush("merge"))
query("K9_publish_rename", _flush_sql("CASE WHEN old IS NOT NULL AND stato <> 'rejected' THEN replace(d.target, '.md', '-1.md') ELSE d.target END", "coalesce(edits, text)", ""))(_flush("rename"))


query("K9_publish_overwrite", _flush_sql("d.target", "coalesce(edits, text)", ""))(_flush("overwrite"))


#: Ten neighbouring drafts share a name; every third name is in the archive already.
ARCHIVED = """SELECT draft_id, concat('_archive/n', stem, CASE WHEN k = 0 THEN '' ELSE concat('-', k) END, '.md') AS target FROM (SELECT draft_id, draft_id // 10 AS stem,
 row_number() OVER (PARTITION BY draft_id // 10 ORDER BY draft_id) - CASE WHEN (draft_id // 10) % 3 = 0 THEN 0 ELSE 1 END AS k FROM d WHERE stato = 'rejected')"""


@query("Y23_archive", f"WITH {DRAFT} {ARCHIVED}")
def y23(spark, sf_dir):
    stem = lambda c: F.concat(F.lit("n"), F.floor(F.col(c) / 10).cast("string"), F.lit(".md"))
    there = read_table(spark, sf_dir, "documents").where("floor(doc_id / 10) % 3 = 0").select(F.concat(F.lit("_archive/"), stem("doc_id")).alias("target")).distinct()
    return publish.archived(_flush("skip")(spark, sf_dir).withColumn("name", stem("draft_id")), there)


@query("K3_audit_rows", f"WITH {DRAFT} SELECT draft_id, stato AS action, 'anna' AS \"user\", 'b1' AS batch, CASE WHEN stato <> 'rejected' AND old IS NULL THEN d.target END AS applied_to, 'skip' AS conflict_policy, CASE WHEN stato = 'rejected' THEN 'archived' WHEN d.target IS NULL THEN 'skipped-no-target' WHEN old IS NOT NULL THEN 'skipped-conflict' ELSE 'applied' END AS outcome, 'now' AS ts FROM d LEFT JOIN e USING (target) WHERE stato <> 'parked'")
def k3(spark, sf_dir):
    return publish.audit_rows(_flush("skip")(spark, sf_dir), F.lit("b1"), "anna", F.lit("now"), "skip")


@query("Y15_mark_written", with_ent("SELECT pk, CASE WHEN pk % 5 = 0 THEN 'before' WHEN status IN ('approved', 'edited') THEN 'now' END AS written_at FROM ent"))
def y15(spark, sf_dir):
    rows = entities(spark, sf_dir).withColumn("written_at", F.when(F.col("pk") % 5 == 0, "before"))
    return publish.mark_written(rows, rows.where("status IN ('approved', 'edited')"), ["pk"], F.lit("now")).select("pk", "written_at")


@query("U6_delete", with_ent("SELECT pk FROM ent WHERE NOT (entity_type = 'cliente' AND settore IS NOT DISTINCT FROM 'BUILDING') AND NOT (entity_type = 'commessa' AND settore IS NULL)"))
def u6(spark, sf_dir):
    gone = spark.sql("SELECT * FROM VALUES ('cliente', 'BUILDING'), ('commessa', CAST(NULL AS STRING)) AS t(entity_type, settore)")
    return publish.delete_rows(entities(spark, sf_dir), gone).select("pk")


KINDS = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'progress' WHEN 'view' THEN 'heartbeat' ELSE 'complete' END"
STATUS = "CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_id % 3 = 0 THEN 'error' ELSE 'unknown' END"


@query("Y14_run_state", f"WITH v AS (SELECT user_id AS run_id, event_id AS t, {KINDS} AS kind, {STATUS} AS status FROM events) SELECT run_id, min(t) FILTER (kind = 'start') AS started_at, max(t) FILTER (kind = 'complete' AND status <> 'unknown') AS completed_at, max(t) FILTER (kind IN ('progress', 'heartbeat')) AS heartbeat_at, CAST(max(t) FILTER (kind = 'progress') AS VARCHAR) AS progress, coalesce(arg_max(status, t) FILTER (kind = 'complete' AND status <> 'unknown'), 'running') AS status FROM v GROUP BY run_id HAVING min(t) FILTER (kind = 'start') IS NOT NULL")
def y14(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("at"), F.expr(KINDS).alias("kind"), F.expr(STATUS).alias("status"), F.col("event_id").cast("string").alias("payload"))
    return publish.run_state(events)


# ---------------------------------------------------------------- validation

JSON = """concat('{"nome": ', CASE WHEN c_custkey % 5 = 0 THEN 'null' WHEN c_custkey % 5 = 1 THEN '12' ELSE '"x"' END, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', "tipo": "cliente"' END, ', "sconto": ', CASE c_custkey % 4 WHEN 0 THEN '3' WHEN 1 THEN '2.5' WHEN 2 THEN '"12%"' ELSE 'null' END, ', "tags": ', CASE WHEN c_custkey % 2 = 0 THEN '["a"]' ELSE 'true' END, '}')"""
KIND_SQL = "CASE json_type(j, '$.{0}') WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' END"
RULES = {"nome": "string", "sconto": "number", "tags": "array", "tipo": "string"}
VALID = f"v AS (SELECT c_custkey AS pk, {', '.join(KIND_SQL.format(f) + ' AS ' + f for f in RULES)} FROM (SELECT c_custkey, {JSON}::JSON AS j FROM customer))"


@query("X39_infer_kinds", f"WITH {VALID} SELECT DISTINCT field, kind, field NOT IN ('tipo', 'nome') AS nullable FROM (UNPIVOT (SELECT {', '.join(RULES)} FROM v) ON {', '.join(RULES)} INTO NAME field VALUE kind) WHERE kind <> 'null'")
def x39(spark, sf_dir):
    return review.infer_kinds(read_table(spark, sf_dir, "customer").select(F.expr(JSON).alias("j")), "j", list(RULES))


ERRORS = "concat_ws('|', CASE WHEN nome <> 'string' THEN concat('nome: expected string, found ', nome) END, CASE WHEN sconto NOT IN ('number', 'integer', 'null') THEN concat('sconto: expected number, found ', sconto) END, CASE WHEN tags NOT IN ('array', 'null') THEN concat('tags: expected array, found ', tags) END, CASE WHEN tipo IS NULL THEN 'tipo: missing' END)"


@query("X39_validate", f"WITH {VALID} SELECT pk, {ERRORS} AS errors, CASE WHEN {ERRORS} <> '' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM v")
def x39b(spark, sf_dir):
    rows = spread(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"))).withColumn("c_custkey", F.col("pk")).select("pk", F.expr(JSON).alias("j")).withColumn("errors", review.validation_errors(F.col("j"), RULES))
    return rows.select("pk", F.array_join("errors", "|").alias("errors"), review.penalised(F.lit(0.9), F.col("errors")).alias("confidence"))


@query("Y6_relabel", with_ent("SELECT pk, first_value(coalesce(nome, 'n')) OVER w AS slug, coalesce(nome, 'n') <> first_value(coalesce(nome, 'n')) OVER w AS diverged FROM ent WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY pk)"))
def y6(spark, sf_dir):
    rows = entities(spark, sf_dir).withColumn("slug", F.coalesce("nome", F.lit("n")))
    return review.relabelled(rows, ["entity_type", "entity_id"], "pk").select("pk", "slug", "diverged")


# ---------------------------------------------------------------- drafts by line

NOTE = """concat(CASE WHEN page_id % 2 = 0 THEN '---
tipo: <x>
warnings:
- "one"
 - two
nome: b
---
' ELSE '' END, 'Intro & todo ', page_id, '
## Generato oggi
text warning
', CASE WHEN page_id % 3 = 0 THEN '## Altro
' ELSE '' END, 'last')"""
ESCAPED = "replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query("X42_draft_lines", f"""WITH l AS (SELECT page_id, unnest(string_split(note, chr(10))) AS raw, CAST(generate_subscripts(string_split(note, chr(10)), 1) - 1 AS INTEGER) AS line FROM (SELECT page_id, {NOTE} AS note FROM pages)),
m AS (SELECT *, trim(raw) AS s, count(*) FILTER (trim(raw) = '---') OVER (PARTITION BY page_id ORDER BY line) AS rules FROM l),
t AS (SELECT *, last_value(CASE WHEN rules = 1 AND s LIKE 'warnings:%' THEN true WHEN rules = 1 AND s <> '---' AND s NOT LIKE '- %' THEN false END IGNORE NULLS) OVER w AS warn,
 CASE WHEN rules <> 1 AND lower(s) LIKE '## generato%' THEN true WHEN rules <> 1 AND s LIKE '## %' THEN false END AS head,
 last_value(CASE WHEN rules <> 1 AND lower(s) LIKE '## generato%' THEN true WHEN rules <> 1 AND s LIKE '## %' THEN false END IGNORE NULLS) OVER w AS inside FROM m WINDOW w AS (PARTITION BY page_id ORDER BY line))
SELECT page_id, line, {ESCAPED} AS escaped, CASE WHEN s = '---' THEN 'fm-marker' WHEN rules = 1 AND coalesce(warn, false) THEN 'warning-marker' WHEN rules = 1 THEN 'fm-line'
 ELSE concat_ws(' ', CASE WHEN contains(upper(raw), 'TODO') THEN 'todo-marker' END, CASE WHEN contains(upper(raw), 'WARNING') THEN 'warning-marker' END, CASE WHEN coalesce(inside, page_id % 5 = 0) THEN 'generated' END, CASE WHEN head THEN 'section-header' END) END AS css FROM t""")
def x42(spark, sf_dir):
    return review.draft_lines(read_table(spark, sf_dir, "pages").select("page_id", F.expr(NOTE).alias("note")), "page_id", "note", F.col("page_id") % 5 == 0)


@query("A23_lint", f"SELECT page_id, len(list_filter(l, lambda x: x LIKE '## %')) AS n_entries, len(list_filter(l, lambda x: trim(x) <> '')) AS n_lines, 1 AS n_opened, page_id % 2 AS n_closed, len(list_filter(l, lambda x: x LIKE '## %')) > 1 AS over_memory, len(list_filter(l, lambda x: trim(x) <> '')) < 10 AS stub, page_id % 2 <> 1 AS open_sessions FROM (SELECT page_id, string_split({NOTE}, chr(10)) AS l FROM pages)")
def a23b(spark, sf_dir):
    text = F.concat(F.expr(NOTE), F.lit("\n### Sessione 2 aperta"), F.when(F.col("page_id") % 2 == 1, "\n### Sessione 2 chiusa").otherwise(""))
    out = dashboard.lint(read_table(spark, sf_dir, "pages").select("page_id", text.alias("text")), entries=1, stub=12)
    session = F.col("n_opened") + F.col("n_closed")
    return out.select("page_id", "n_entries", (F.col("n_lines") - session).alias("n_lines"), "n_opened", "n_closed", "over_memory", (F.col("n_lines") - session < 10).alias("stub"), "open_sessions")


@query("Y2_orphans", with_inv("SELECT doc_id FROM inv WHERE doc_id % 3 <> 0 AND doc_id % 7 IN (0, 1, 2) AND doc_id % 10 <> 0"))
def y2(spark, sf_dir):
    k = F.col("doc_id")
    area = F.when(k % 7 == 0, "clienti").when(k % 7 == 1, "decisioni").when(k % 7 == 2, "reparti").otherwise("Daily")
    path = F.concat_ws("/", area, F.when(k % 10 == 0, "_esempio-x").otherwise("x"), F.concat(k.cast("string"), F.lit(".md")))
    return review.orphans(read_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.when(k % 3 == 0, "cliente").alias("kind"))).select("doc_id")


@query("Y3_next_step", with_ent("SELECT entity_id, CASE WHEN entity_id = 'e0' THEN 'Scan' WHEN entity_id = 'e1' THEN 'Build' WHEN n_pending > 0 THEN 'Review' WHEN n_approved > 0 AND entity_id LIKE 'e2%' THEN 'Vault' WHEN n_approved > 0 THEN 'Settings' ELSE 'Scan' END AS step FROM (SELECT entity_id, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'approved') AS n_approved FROM ent GROUP BY 1)"))
def y3(spark, sf_dir):
    counts = entities(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "approved").alias("approved"))
    none = lambda p, n: F.when(F.col("entity_id").like(p), 0).otherwise(n)
    return counts.select("entity_id", publish.next_step(none("e0", 1), none("e1", F.col("n")), F.col("pending"), F.col("approved"), none("e2%", 3)).alias("step"))


# ---------------------------------------------------------------- reports


@query("A19_run_stats", with_inv("SELECT coalesce(categoria, 'none') AS categoria, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS n_llm, count(*) FILTER (doc_id % 3 <> 0) AS n_rules FROM inv GROUP BY GROUPING SETS ((coalesce(categoria, 'none')), ())"))
def a19(spark, sf_dir):
    return dashboard.run_stats(inventory(spark, sf_dir).select(F.coalesce("categoria", F.lit("none")).alias("categoria"), F.when(F.col("doc_id") % 3 == 0, "llm").otherwise("rules").alias("method")))


@query("A24_status_totals", with_inv("SELECT count(*) AS n_records, count(DISTINCT source) AS n_sources, count(sha256) AS n_hashed, count(categoria) AS n_categorized, CAST(sum(size) AS BIGINT) AS bytes FROM inv"))
def a24(spark, sf_dir):
    return dashboard.status_totals(inventory(spark, sf_dir))


@query("A25_any", with_runs("SELECT command, bool_or(status = 'failed') AS needs_attention, bool_and(heartbeat_s IS NOT NULL) AS all_alive FROM runs GROUP BY command"))
def a25(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("command").agg(F.bool_or(F.col("status") == "failed").alias("needs_attention"), F.bool_and(F.col("heartbeat_s").isNotNull()).alias("all_alive"))


@query("O4_ordered_list", with_inv("SELECT doc_id, row_number() OVER (ORDER BY path, doc_id) AS at FROM inv"))
def o4(spark, sf_dir):
    return ordinals(inventory(spark, sf_dir).select("doc_id", "path"), ["path", "doc_id"], "at").select("doc_id", "at")


@query("Y20_redact_messages", "SELECT conv_id, turn, 'text' AS kind, concat('ask <email-1> ', turn) AS said FROM conversations UNION ALL SELECT conv_id, turn, 'image', concat('p@x.it ', turn) FROM conversations")
def y20(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").withColumn("at", F.col("turn").cast("string"))
    block = lambda kind, said: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(said), F.col("at")).alias("text"))
    messages = rows.withColumn("blocks", F.array(block("text", "ask p@x.it "), block("image", "p@x.it ")))
    pairs = F.array(F.struct(F.lit("p@x.it").alias("value"), F.lit("<email-1>").alias("placeholder")))
    return messages.select("conv_id", "turn", F.explode(redaction.redact_blocks(F.col("blocks"), pairs)).alias("b")).select("conv_id", "turn", F.col("b.type").alias("kind"), F.col("b.text").alias("said"))
