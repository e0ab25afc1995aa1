"""Views that bring the given tables into the shapes the operators work on.

Each view is one SELECT that Spark SQL and DuckDB evaluate alike, but for the tokens in braces. The Spark side turns
the epoch column into a timestamp; `NOW_S` stands for the current time, so results do not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.session import read_table

NOW_S = 1_750_000_000

INV_SQL = """
SELECT doc_id,
  CASE doc_id % 6 WHEN 0 THEN 'gdrive' WHEN 1 THEN 'm365' WHEN 2 THEN 'nas' WHEN 3 THEN 'email-attachment' WHEN 4 THEN 'server' ELSE 'email' END AS source,
  concat('id-', CAST(doc_id AS STRING)) AS source_id,
  concat(CASE doc_id % 13 WHEN 0 THEN '/srv/clienti/rossi-srl' WHEN 1 THEN '/srv/clienti/Bianchi & Figli' WHEN 2 THEN '/srv/fornitori/acme'
    WHEN 3 THEN '/srv/_archivio/2019' WHEN 4 THEN '/srv/contratti' WHEN 5 THEN '/srv/commesse/C-101' WHEN 6 THEN '/home/cestino'
    WHEN 7 THEN '/srv/backup_2022' WHEN 8 THEN '/srv/misc' WHEN 9 THEN '/srv/listini' WHEN 10 THEN '/srv/clienti/_esempio'
    WHEN 11 THEN 'clienti/verdi' ELSE '/Users/x/Library/Caches' END, '/') AS folder,
  concat(CASE doc_id % 11 WHEN 0 THEN 'fattura_rossi' WHEN 1 THEN 'rossi-srl_offerta_24' WHEN 2 THEN 'Relazione' WHEN 3 THEN 'Copia di listino'
    WHEN 4 THEN 'foto' WHEN 5 THEN 'contratto_bianchi' WHEN 6 THEN 'bianchi_ordine_12' WHEN 7 THEN 'note' WHEN 8 THEN '~$untitled'
    WHEN 9 THEN 'DDT_2021' ELSE 'verdi-spa-preventivo' END,
    CASE doc_id % 7 WHEN 1 THEN ' (2)' WHEN 2 THEN '_v2' WHEN 3 THEN '_FINAL' WHEN 4 THEN ' copia' WHEN 5 THEN '_v3_def' ELSE '' END,
    CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.txt' ELSE '.PDF' END) AS name,
  CAST(CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 101 = 0 THEN 314572800 ELSE n_chars END AS BIGINT) AS size,
  CAST({now} - ((doc_id * 37) % 1600) * 86400 - doc_id % 3600 AS BIGINT) AS mtime_s,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE {sha} END AS sha256,
  CASE WHEN doc_id % 6 IN (3, 5) THEN concat('"User ', CAST(doc_id % 19 AS STRING), '" <u', CAST(doc_id % 19 AS STRING), '@',
    CASE doc_id % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'rossi-srl.it' WHEN 2 THEN 'Verdi.com' ELSE 'pec.it' END, '>') END AS sender,
  CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'vivo' WHEN 2 THEN 'archivio' WHEN 3 THEN 'cestino' WHEN 4 THEN 'da-consultare' WHEN 5 THEN 'da-chiarire'
    WHEN 6 THEN 'altro' ELSE 'vivo' END AS categoria
FROM documents
"""

ENTITIES_SQL = """
SELECT c_custkey AS pk,
  CASE c_custkey % 3 WHEN 0 THEN 'cliente' WHEN 1 THEN 'fornitore' ELSE 'commessa' END AS entity_type,
  concat('e', CAST(c_custkey % 40 AS STRING)) AS entity_id,
  CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'edited' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS nome,
  CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE concat('IT', CAST(c_custkey * 7 AS STRING)) END AS piva,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS settore,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('nota ', CAST(c_custkey % 8 AS STRING)) END AS note,
  round((c_custkey % 11) / 10.0, 2) AS confidence,
  c_custkey % 2 = 1 AS written
FROM customer
"""

RUNS_SQL = """
SELECT event_id AS id, CAST({epoch} AS BIGINT) AS start_s,
  CASE event_type WHEN 'click' THEN 'scan fs /srv' WHEN 'purchase' THEN 'scan gdrive' WHEN 'error' THEN 'scan fs --resume' WHEN 'signup' THEN 'build' ELSE 'scan outlook' END AS command,
  CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'partial' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST({epoch} + event_id % 900 AS BIGINT) END AS heartbeat_s,
  CASE WHEN event_id % 5 = 0 THEN '{{"status":"interrupted"}}' ELSE '{{"status":"ok"}}' END AS progress_json,
  user_id, value, event_type
FROM events
"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str, **tokens: str) -> DataFrame:
    read_table(spark, sf_dir, table).createOrReplaceTempView(f"bridge_{table}")
    return spark.sql(sql.format(**tokens).replace(f"FROM {table}", f"FROM bridge_{table}"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, "documents", INV_SQL, now=str(NOW_S), sha="sha2(text, 256)")
    return rows.withColumns({"path": F.concat("folder", "name"), "mtime": F.timestamp_seconds("mtime_s")})


def inventory_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", ENTITIES_SQL)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", RUNS_SQL, epoch="unix_timestamp(ts)")


INV_CTE = "inv AS (SELECT *, concat(folder, name) AS path FROM (" + INV_SQL.format(now=NOW_S, sha="sha256(text)") + "))"
ENTITIES_CTE = "ent AS (" + ENTITIES_SQL + ")"
RUNS_CTE = "runs AS (" + RUNS_SQL.format(epoch="floor(epoch(ts))") + ")"


def with_inv(sql: str) -> str:
    return f"WITH {INV_CTE} {sql}"


def with_ent(sql: str) -> str:
    return f"WITH {ENTITIES_CTE} {sql}"


def with_runs(sql: str) -> str:
    return f"WITH {RUNS_CTE} {sql}"
