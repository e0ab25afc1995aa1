"""Queries over the inventory view: filters, categories, duplicates, objects, people, sets and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.functions.tokens import ARCHIVE_PATHS, BUSINESS_NAMES, CONSULT_PATHS, LIVE_PATHS, RED_FLAG_NAMES
from dossierflow.operators import categorize, dedup, filters, objects
from dossierflow.plans.bridge import NOW_S, inventory, inventory_with_text, runs, with_inv, with_runs
from dossierflow.plans.registry import query
from dossierflow.session import read_table


def _now():
    return F.timestamp_seconds(F.lit(NOW_S))


def _any(column: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


# ---------------------------------------------------------------- filters


@query("F1_perimeter", with_inv("SELECT doc_id, path FROM inv WHERE size <= 104857600 AND NOT lower(name) LIKE '%.txt' AND NOT contains(path, '_archivio') AND (contains(path, 'clienti') OR contains(path, 'contratti'))"))
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).where(filters.perimeter(100, (".TXT",), ("_archivio",), ("clienti", "contratti"))).select("doc_id", "path")


@query("F2_glob_exclude", with_inv("SELECT doc_id FROM inv WHERE NOT (path GLOB '*/backup_*' OR path GLOB '*.xlsx')"))
def f2(spark, sf_dir):
    return inventory(spark, sf_dir).where(~filters.glob_excluded(("*/backup_*", "*.xlsx"))).select("doc_id")


@query("F3_any_component", with_inv("SELECT doc_id FROM inv WHERE len(list_filter(string_split(path, '/'), lambda c: c GLOB '_*' OR c GLOB 'misc')) > 0"))
def f3(spark, sf_dir):
    return inventory(spark, sf_dir).where(filters.any_component(("_*", "misc"))).select("doc_id")


@query("F4_adjacent_component", with_inv("SELECT doc_id FROM inv WHERE regexp_matches(path, '(^|/)Library/(Caches|Logs|Application Support|Containers|Developer)(/|$)')"))
def f4(spark, sf_dir):
    return inventory(spark, sf_dir).where(filters.library_component()).select("doc_id")


F5_CASE = """CASE WHEN len(list_filter(string_split(path, '/'), lambda c: c GLOB '_*')) > 0 THEN 'excluded'
 WHEN regexp_matches(path, '(^|/)Library/(Caches|Logs|Application Support|Containers|Developer)(/|$)') THEN 'library'
 WHEN size > 5000 THEN 'size' WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) NOT IN ('.pdf', '.docx', '.txt') THEN 'extension' END"""


@query("F5_skip_reasons", with_inv(f"SELECT coalesce({F5_CASE}, 'kept') AS reason, count(*) AS n FROM inv GROUP BY 1"))
def f5(spark, sf_dir):
    reason = filters.skip_reason(5000, (".pdf", ".docx", ".txt"), ("_*",))
    return inventory(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("F6_magic_veto", with_inv("SELECT inv.doc_id, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.pdf', '.docx', '.xlsx') AS veto FROM inv"))
def f6(spark, sf_dir):
    rows = inventory_with_text(spark, sf_dir)
    return rows.select("doc_id", filters.magic_veto(F.substring(F.encode("text", "UTF-8"), 1, 16), X.extension(F.col("name"))).alias("veto"))


@query("F8_short_mail", "SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 4 <> 0 AND length(substr(text, 1, 500)) < 120)")
def f8(spark, sf_dir):
    mails = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("body"), F.when(F.col("conv_id") % 4 == 0, 1).otherwise(0).alias("n_attachments"))
    return mails.where(~filters.noisy_mail(mails, 120)).select("conv_id", "turn")


@query("F9_kind_filter", with_inv("SELECT doc_id FROM inv WHERE lower(name) NOT LIKE '%.txt' AND size <= 52428800 AND categoria IS DISTINCT FROM 'cestino'"))
def f9(spark, sf_dir):
    return inventory(spark, sf_dir).where(~F.endswith(F.lower("name"), F.lit(".txt")) & (F.col("size") <= 50 * 1024 * 1024) & ~F.col("categoria").eqNullSafe("cestino")).select("doc_id")


@query("F10_pushed_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag = 'R'")
def f10(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("F11_dynamic_where", with_inv("SELECT doc_id FROM inv WHERE source = 'nas' AND categoria = 'vivo'"))
def f11(spark, sf_dir):
    return filters.optional_equal(inventory(spark, sf_dir), source="nas", categoria="vivo", name=None).select("doc_id")


@query("F12_interrupted_runs", with_runs(f"SELECT id FROM runs WHERE status = 'running' AND ((heartbeat_s IS NOT NULL AND heartbeat_s < {NOW_S}) OR (heartbeat_s IS NULL AND start_s < 1704500000))"))
def f12(spark, sf_dir):
    stale = filters.interrupted(NOW_S) & (F.col("heartbeat_s").isNotNull() | (F.col("start_s") < 1704500000))
    return runs(spark, sf_dir).where(stale).select("id")


@query("F13_like", with_runs("SELECT id FROM runs WHERE command LIKE 'scan fs%' AND json_extract_string(progress_json, '$.status') = 'interrupted'"))
def f13(spark, sf_dir):
    return runs(spark, sf_dir).where(F.col("command").like("scan fs%") & (F.get_json_object("progress_json", "$.status") == "interrupted")).select("id")


@query("F16_temp_ignore", with_inv("SELECT doc_id FROM inv WHERE NOT (name LIKE '.%' OR name LIKE '%~' OR name LIKE '%.swp')"))
def f16(spark, sf_dir):
    return inventory(spark, sf_dir).where(~filters.editor_temp()).select("doc_id")


@query("F17_domain_exclusion", with_inv("SELECT doc_id, lower(regexp_extract(sender, '@([\\w.-]+)', 1)) AS domain FROM inv WHERE sender IS NOT NULL AND lower(regexp_extract(sender, '@([\\w.-]+)', 1)) NOT IN ('gmail.com', 'pec.it')"))
def f17(spark, sf_dir):
    return inventory(spark, sf_dir).select("doc_id", objects.mail_domain().alias("domain")).where("domain IS NOT NULL")


@query("F18_category_filter", with_inv("SELECT doc_id FROM inv WHERE categoria IN ('vivo', 'da-consultare')"))
def f18(spark, sf_dir):
    return inventory(spark, sf_dir).where(F.col("categoria").isin("vivo", "da-consultare")).select("doc_id")


@query("F19_projection", with_inv("SELECT source, source_id, name FROM inv"))
def f19(spark, sf_dir):
    return inventory(spark, sf_dir).select("source", "source_id", "name")


@query("F20_point_lookup", with_inv("SELECT doc_id, path, size FROM inv WHERE source = 'gdrive' AND source_id = 'id-42'"))
def f20(spark, sf_dir):
    return inventory(spark, sf_dir).where((F.col("source") == "gdrive") & (F.col("source_id") == "id-42")).select("doc_id", "path", "size")


@query(
    "F21_search",
    "SELECT url AS path, CAST((length(html) - length(replace(lower(html), 'href', ''))) // 4 AS BIGINT) AS n, substr(html, greatest(instr(lower(html), 'href') - 80, 1), CAST(instr(lower(html), 'href') + 84 - greatest(instr(lower(html), 'href') - 80, 1) AS BIGINT)) AS snippet FROM pages WHERE contains(lower(html), 'href') ORDER BY url LIMIT 20",
)
def f21(spark, sf_dir):
    return filters.search(read_table(spark, sf_dir, "pages"), "HREF", 20, "url", "html").withColumnRenamed("url", "path")


# ---------------------------------------------------------------- categories

_AGE = f"greatest(0, ({NOW_S} - mtime_s) // 86400)"
SCORED = f"""sig AS (SELECT *, {_AGE} AS age, lower(name) AS ln, lower(path) AS lp FROM inv),
flag AS (SELECT *, {_any("ln", RED_FLAG_NAMES)} AS red, {_any("lp", ARCHIVE_PATHS)} AS arch, {_any("lp", LIVE_PATHS)} AS live, {_any("lp", CONSULT_PATHS)} AS cons, {_any("ln", BUSINESS_NAMES)} AS biz FROM sig),
sc AS (SELECT *,
 least(1.0, least(1.0, CAST(CASE WHEN age < 90 THEN 0.6 WHEN age < 365 THEN 0.3 ELSE 0 END AS DOUBLE) + CASE WHEN live THEN 0.4::DOUBLE ELSE 0 END) + CASE WHEN biz AND age < 365 THEN 0.3::DOUBLE ELSE 0 END) AS s1,
 least(1.0, least(1.0, CAST(CASE WHEN age >= 90 AND age < 365 THEN 0.3 WHEN age >= 365 AND age < 1095 THEN 0.4 ELSE 0 END AS DOUBLE) + CASE WHEN cons THEN 0.5::DOUBLE ELSE 0 END) + CASE WHEN biz AND age >= 365 AND age < 1095 THEN 0.3::DOUBLE ELSE 0 END) AS s2,
 least(1.0, least(1.0, CAST(CASE WHEN age >= 1095 THEN 0.6 WHEN age >= 365 THEN 0.3 ELSE 0 END AS DOUBLE) + CASE WHEN arch THEN 0.7::DOUBLE ELSE 0 END) + CASE WHEN biz AND age >= 1095 THEN 0.3::DOUBLE ELSE 0 END) AS s3,
 least(1.0, least(1.0, least(1.0, CASE WHEN red THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN starts_with(ln, '~$') THEN 0.5::DOUBLE ELSE 0 END) + CASE WHEN contains(lp, '/cestino') OR starts_with(lp, 'cestino/') OR contains(lp, '/trash') THEN 0.9::DOUBLE ELSE 0 END) + CASE WHEN size = 0 THEN 0.4::DOUBLE ELSE 0 END) AS s4,
 CASE WHEN size > 209715200 THEN 0.3::DOUBLE ELSE 0 END AS s5 FROM flag),
cl AS (SELECT *, greatest(s1, s2, s3, s4, s5) AS best,
 concat_ws(',', concat('age=', age, 'd'), CASE WHEN red THEN 'naming-red-flag' END, CASE WHEN arch THEN 'path=archivio' END, CASE WHEN live THEN 'path=vivo' END, CASE WHEN size = 0 THEN 'size=0' END) AS said FROM sc),
classified AS (SELECT *, CASE WHEN best < 0.5 THEN 'da-chiarire' WHEN s1 = best THEN 'vivo' WHEN s2 = best THEN 'da-consultare' WHEN s3 = best THEN 'archivio' WHEN s4 = best THEN 'cestino' ELSE 'da-chiarire' END AS category,
 CASE WHEN best < 0.5 THEN concat('no-rule-decisive: ', said) ELSE said END AS reason FROM cl)"""


def with_classified(sql: str) -> str:
    return with_inv("").rstrip() + f", {SCORED} {sql}"


@query("C1_scores", with_classified("SELECT doc_id, round(s1, 6) AS vivo, round(s2, 6) AS da_consultare, round(s3, 6) AS archivio, round(s4, 6) AS cestino, round(s5, 6) AS da_chiarire FROM classified"))
def c1(spark, sf_dir):
    scored = categorize.score(inventory(spark, sf_dir), _now())
    return scored.select("doc_id", *[F.round(F.col(f"score_{c}"), 6).alias(c.replace("-", "_")) for c in ("vivo", "da-consultare", "archivio", "cestino", "da-chiarire")])


@query("C2_classify", with_classified("SELECT doc_id, category, round(best, 6) AS confidence, reason FROM classified"))
def c2(spark, sf_dir):
    return categorize.classify(inventory(spark, sf_dir), _now()).select("doc_id", "category", F.round("confidence", 6).alias("confidence"), "reason")


@query("C3_needs_model", with_classified("SELECT category, (category = 'da-chiarire' OR best < 0.5) AS needs_model, count(*) AS n FROM classified GROUP BY 1, 2"))
def c3(spark, sf_dir):
    return categorize.needs_model(categorize.classify(inventory(spark, sf_dir), _now())).groupBy("category", "needs_model").agg(F.count("*").alias("n"))


ANSWERS = "SELECT coalesce(sha256, source_id) AS key, 'archivio' AS category, 0.9 AS confidence, concat('seen ', CAST(doc_id AS STRING)) AS reason, doc_id AS ord FROM inv WHERE doc_id % 3 = 0"


@query(
    "C4_J1_apply_answers",
    with_classified(f"""SELECT doc_id, CASE WHEN use THEN a_cat ELSE category END AS category, CASE WHEN use THEN concat('model: ', a_reason) ELSE concat('rules: ', reason) END AS reason FROM (
 SELECT c.*, a.a_cat, a.a_reason, a.key IS NOT NULL AND (category = 'da-chiarire' OR best < 0.5) AS use FROM classified c LEFT JOIN (
  SELECT key, arg_max(category, ord) AS a_cat, arg_max(reason, ord) AS a_reason FROM ({ANSWERS}) GROUP BY key) a ON coalesce(c.sha256, c.source_id) = a.key)"""),
)
def c4(spark, sf_dir):
    rows = inventory(spark, sf_dir)
    answers = rows.where("doc_id % 3 = 0").select(F.coalesce("sha256", "source_id").alias("key"), F.lit("archivio").alias("category"), F.lit(0.9).alias("confidence"), F.concat(F.lit("seen "), F.col("doc_id").cast("string")).alias("reason"), F.col("doc_id").alias("ord"))
    return categorize.apply_answers(categorize.classify(rows, _now()), answers).select("doc_id", "category", "reason")


@query("C7_model_cost", "SELECT event_id, round((user_id * 100 / 1e6 * CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 15.0 ELSE 1.0 END + event_id / 1e6 * CASE event_type WHEN 'click' THEN 15.0 WHEN 'view' THEN 75.0 ELSE 5.0 END) * 0.92::DOUBLE, 6) AS cost_eur FROM events")
def c7(spark, sf_dir):
    model = F.when(F.col("event_type") == "click", "sonnet").when(F.col("event_type") == "view", "opus").otherwise(F.col("event_type"))
    calls = read_table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 100).alias("tokens_in"), F.col("event_id").alias("tokens_out"), model.alias("model"))
    return categorize.model_cost(calls).select("event_id", "cost_eur")


@query(
    "A5_category_counts",
    with_classified("""SELECT t.category, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / (SELECT count(*) FROM classified), 1) AS pct
 FROM (VALUES ('vivo'), ('da-consultare'), ('archivio'), ('cestino'), ('da-chiarire')) t(category) LEFT JOIN (SELECT category, count(*) AS n FROM classified GROUP BY 1) USING (category)"""),
)
def a5(spark, sf_dir):
    return categorize.category_counts(categorize.classify(inventory(spark, sf_dir), _now()), "category")


@query(
    "A5_stored_category_counts",
    with_inv("""SELECT t.category, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / (SELECT count(*) FROM inv WHERE categoria IS NOT NULL), 1) AS pct
 FROM (VALUES ('vivo'), ('da-consultare'), ('archivio'), ('cestino'), ('da-chiarire')) t(category)
 LEFT JOIN (SELECT CASE WHEN categoria = 'altro' THEN 'da-chiarire' ELSE categoria END AS category, count(*) AS n FROM inv WHERE categoria IS NOT NULL GROUP BY 1) USING (category)"""),
)
def a5b(spark, sf_dir):
    return categorize.category_counts(inventory(spark, sf_dir))


# ---------------------------------------------------------------- duplicates

PRIORITY = "CASE source WHEN 'gdrive' THEN 50 WHEN 'm365' THEN 40 WHEN 'nas' THEN 30 WHEN 'email-attachment' THEN 20 WHEN 'server' THEN 15 WHEN 'email' THEN 10 ELSE 0 END"
MARKED = f"""ranked AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS c, row_number() OVER w AS r, first_value(concat(source, ':', source_id)) OVER w AS top
 FROM inv WINDOW w AS (PARTITION BY sha256 ORDER BY {PRIORITY} DESC, mtime_s DESC, doc_id)),
marked AS (SELECT *, CASE WHEN sha256 IS NULL OR c = 1 THEN 'unique' WHEN r = 1 THEN 'canonical' ELSE 'duplicate-of' END AS role FROM ranked)"""


def with_marked(sql: str) -> str:
    return with_inv("").rstrip() + f", {MARKED} {sql}"


@query("A1_hash_index", with_inv("SELECT coalesce(sha256, '__missing__') AS sha256, count(*) AS n, min(concat(source, ':', source_id)) AS first_id FROM inv GROUP BY 1"))
def a1(spark, sf_dir):
    return dedup.hash_index(inventory(spark, sf_dir)).withColumnRenamed("first", "first_id")


@query("A1_hash_members", with_inv("SELECT coalesce(sha256, '__missing__') AS sha256, concat(source, ':', source_id) AS id FROM inv"))
def a1b(spark, sf_dir):
    return dedup.hash_members(inventory(spark, sf_dir))


@query("A2_duplicate_totals", with_inv("SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_redundant FROM (SELECT count(*) AS n FROM inv WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1)"))
def a2(spark, sf_dir):
    return dedup.duplicate_totals(inventory(spark, sf_dir))


@query("W1_mark_duplicates", with_marked("SELECT doc_id, role, CASE WHEN role = 'duplicate-of' THEN top END AS canonical FROM marked"))
def w1(spark, sf_dir):
    return dedup.mark_duplicates(inventory(spark, sf_dir), F.col("doc_id")).select("doc_id", "role", "canonical")


@query("A3_J4_dedup_stats", with_marked("SELECT source, count(*) FILTER (role = 'canonical') AS n_canonical, count(*) FILTER (role = 'duplicate-of') AS n_duplicates, count(*) FILTER (role = 'unique') AS n_unique FROM marked GROUP BY source"))
def a3(spark, sf_dir):
    marked = dedup.mark_duplicates(inventory(spark, sf_dir), F.col("doc_id"))
    count = lambda r: F.count_if(F.col("role") == r)
    return marked.groupBy("source").agg(count("canonical").alias("n_canonical"), count("duplicate-of").alias("n_duplicates"), count("unique").alias("n_unique"))


@query("W2_siblings", with_marked("SELECT top AS id, concat(source, ':', source_id) AS sibling FROM marked WHERE role = 'duplicate-of'"))
def w2(spark, sf_dir):
    return dedup.siblings(dedup.mark_duplicates(inventory(spark, sf_dir), F.col("doc_id")))


_PASS = ["^(.+?)[\\s_-]*(?:copia(?:\\s+di)?|copy(?:\\s+of)?)(?:[\\s_-]*\\(?(\\d+)\\)?)?$", "^copia\\s+di\\s+(.+)$", "^(.+?)[\\s_-]*v(\\d+)$", "^(.+?)[\\s_-]+(?:final|finale|definitivo|def)$", "^(.+?)[\\s_-]*\\((\\d+)\\)$"]


def _one_pass(col: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({col}, '{p}', 'i') AND trim(regexp_extract({col}, '{p}', 1, 'i'), ' _-') NOT IN ('', {col}) THEN trim(regexp_extract({col}, '{p}', 1, 'i'), ' _-')" for p in _PASS)
    return f"CASE {cases} ELSE {col} END"


BASED = "b0 AS (SELECT *, trim(regexp_extract(name, '^(.*)\\.[^.]*$', 1)) AS p0, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM inv)"
for _k in range(5):
    BASED += f", b{_k + 1} AS (SELECT *, {_one_pass(f'p{_k}')} AS p{_k + 1} FROM b{_k})"
BASED += ", based AS (SELECT *, trim(lower(p5), ' _-') AS base, p5 <> p0 AS matched FROM b5)"


def with_based(sql: str) -> str:
    return with_inv("").rstrip() + f", {BASED} {sql}"


@query("X3_normalize_base", with_based("SELECT DISTINCT name, base, matched FROM based"))
def x3(spark, sf_dir):
    return inventory(spark, sf_dir).select("name").distinct().select("name", X.base_passes(F.col("name")).alias("b")).select("name", "b.base", "b.matched")


@query("X4_split_path", with_based("SELECT doc_id, ext, parent, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS stem FROM based"))
def x4(spark, sf_dir):
    return inventory(spark, sf_dir).select("doc_id", X.extension(F.col("name")).alias("ext"), X.parent(F.col("path")).alias("parent"), X.stem(F.col("name")).alias("stem"))


@query("A8_W3_name_clusters", with_based("SELECT parent, base, ext, count(*) AS n, arg_max(source_id, (mtime_s, -length(name), source_id)) AS canonical_id FROM based GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def a8(spark, sf_dir):
    return dedup.name_clusters(inventory(spark, sf_dir)).select("parent", "base", "ext", "n", "canonical_id").distinct()


@query("W4_cluster_ordinals", with_based("SELECT parent, base, ext, n, row_number() OVER (ORDER BY parent, base, ext) AS ordinal FROM (SELECT parent, base, ext, count(*) AS n FROM based GROUP BY 1, 2, 3 HAVING count(*) > 1)"))
def w4(spark, sf_dir):
    return dedup.cluster_ordinals(dedup.name_clusters(inventory(spark, sf_dir)))


# ---------------------------------------------------------------- objects and people

_SLUG = "CASE WHEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'ignoto' ELSE trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') END"
SIGNALS = (
    """f0 AS (SELECT *, CASE WHEN contains(path, 'clienti/') THEN 'cliente' WHEN contains(path, 'fornitori/') THEN 'fornitore' WHEN contains(path, 'commesse/') THEN 'commessa' END AS ft,
 regexp_extract(path, '(?:clienti|fornitori|commesse)/([^/]+)/', 1) AS child, lower(regexp_extract(coalesce(sender, ''), '@([\\w.-]+)', 1)) AS dom,
 regexp_extract(lower(string_split(name, '.')[1]), '^([a-z0-9]+(?:[-_][a-z0-9]+)*)[_-](?:offerta|ordine|contratto|fattura|capitolato|preventivo)', 1) AS pre
 FROM inv WHERE categoria IN ('vivo', 'da-consultare')),
sig AS (SELECT *, CASE WHEN ft IS NOT NULL AND child <> '' AND NOT starts_with(child, '_') THEN 1 WHEN dom NOT IN ('', 'gmail.com', 'pec.it') THEN 2 WHEN pre <> '' THEN 3 END AS kind FROM f0),
obj AS (SELECT *, CASE kind WHEN 1 THEN ft WHEN 2 THEN 'cliente' ELSE coalesce(ft, 'cliente') END AS tipo,
 CASE kind WHEN 1 THEN """
    + _SLUG.format("child")
    + " WHEN 2 THEN "
    + _SLUG.format("string_split(dom, '.')[1]")
    + " ELSE "
    + _SLUG.format("replace(pre, '_', '-')")
    + """ END AS slug FROM sig WHERE kind IS NOT NULL),
objs AS (SELECT *, CASE kind WHEN 1 THEN concat('folder:', tipo) WHEN 2 THEN concat('email-domain:', dom) ELSE concat('name-prefix:', slug) END AS signal FROM obj WHERE slug <> 'ignoto')"""
)


def with_objects(sql: str) -> str:
    return with_inv("").rstrip() + f", {SIGNALS} {sql}"


@query("W7_signals", with_objects("SELECT doc_id, tipo, slug, signal FROM objs"))
def w7(spark, sf_dir):
    return objects.with_signal(inventory(spark, sf_dir)).select("doc_id", "tipo", "slug", "signal")


@query("A9_object_groups", with_objects("SELECT tipo, slug, count(*) AS n, count(DISTINCT signal) AS n_signals, round(least(1.0::DOUBLE, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) + least(0.3::DOUBLE, 0.05::DOUBLE * count(DISTINCT signal))), 2) AS confidence FROM objs GROUP BY 1, 2 HAVING count(*) >= 2"))
def a9(spark, sf_dir):
    return objects.object_groups(inventory(spark, sf_dir))


@query("W5_first_files", with_objects("SELECT tipo, slug, CAST(place AS INTEGER) AS place, name, source_id, greatest(n - 5, 0) AS others FROM (SELECT *, row_number() OVER (PARTITION BY tipo, slug ORDER BY name, source_id) AS place, count(*) OVER (PARTITION BY tipo, slug) AS n FROM objs) WHERE place <= 5"))
def w5(spark, sf_dir):
    return objects.first_files(inventory(spark, sf_dir), 5)


MAIL = """mail AS (SELECT conv_id * 100 + turn AS when_s, concat('Name ', CAST(conv_id % 12 AS STRING), ' <P', CAST(conv_id % 12 AS STRING), '@Firm', CAST(conv_id % 3 AS STRING), '.it>') AS f,
 CASE WHEN turn % 2 = 0 THEN concat('"Rossi, Anna" <anna@rossi-srl.it>, q', CAST(conv_id % 5 AS STRING), '@home.it') END AS t FROM conversations)"""


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: (F.col("conv_id") % n).cast("string")
    return read_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("when_s"),
        F.concat(F.lit("Name "), k(12), F.lit(" <P"), k(12), F.lit("@Firm"), k(3), F.lit(".it>")).alias("from"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"Rossi, Anna" <anna@rossi-srl.it>, q'), k(5), F.lit("@home.it"))).alias("to"),
    )


SAID = """, said AS (SELECT when_s, 1 AS sent, lower(regexp_extract(f, '<([^>]+)>', 1)) AS email, regexp_extract(f, '^(.*?) <', 1) AS name FROM mail
 UNION ALL SELECT when_s, 0, 'anna@rossi-srl.it', 'Anna' FROM mail WHERE t IS NOT NULL
 UNION ALL SELECT when_s, 0, regexp_extract(t, '(q\\d+@home.it)', 1), NULL FROM mail WHERE t IS NOT NULL),
persons AS (SELECT email, coalesce(string_agg(DISTINCT name, '|' ORDER BY name), '') AS names, coalesce(arg_max(name, (length(name), name)), '') AS best_name, min(when_s) AS first_s, max(when_s) AS last_s, CAST(sum(sent) AS BIGINT) AS n_messages FROM said GROUP BY email)"""


@query("A10_X10_people", f"WITH {MAIL}{SAID} SELECT * FROM persons")
def a10(spark, sf_dir):
    return objects.people(_mails(spark, sf_dir))


@query("A11_people_by_domain", f"WITH {MAIL}{SAID} SELECT regexp_extract(email, '@(.*)$', 1) AS domain, regexp_extract(email, '@(.*)$', 1) = 'rossi-srl.it' AS internal, count(*) AS n, CAST(sum(n_messages) AS BIGINT) AS n_messages FROM persons GROUP BY 1, 2")
def a11(spark, sf_dir):
    return objects.people_by_domain(objects.people(_mails(spark, sf_dir)), "Rossi-srl.it")


@query("X1_slugify", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def x1(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", X.slugify(F.col("c_name")).alias("slug"))


@query("X5_normalize_name", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(trim(concat(c_name, CASE c_custkey % 4 WHEN 0 THEN ' SRL' WHEN 1 THEN '  S.p.A.' WHEN 2 THEN ' spa' ELSE ' sasso' END))), '( srl| s\\.p\\.a\\.| spa)$', ''), '\\s+', ' ', 'g')) AS name FROM customer")
def x5(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 4 == 0, " SRL").when(F.col("c_custkey") % 4 == 1, "  S.p.A.").when(F.col("c_custkey") % 4 == 2, " spa").otherwise(" sasso")
    return read_table(spark, sf_dir, "customer").select("c_custkey", X.normalize_name(F.concat("c_name", tail)).alias("name"))


@query("X20_age", with_inv(f"SELECT doc_id, greatest(0, ({NOW_S} - mtime_s) // 86400) AS age FROM inv"))
def x20(spark, sf_dir):
    return inventory(spark, sf_dir).select("doc_id", X.age_days(F.col("mtime"), _now()).alias("age"))


# ---------------------------------------------------------------- sets, order, limits


@query("O1_latest", with_runs("SELECT id, command, start_s FROM runs ORDER BY start_s DESC, id DESC LIMIT 25"))
def o1(spark, sf_dir):
    return runs(spark, sf_dir).select("id", "command", "start_s").orderBy(F.desc("start_s"), F.desc("id")).limit(25)


@query("O3_resume_candidate", with_runs("SELECT id FROM runs WHERE status = 'partial' AND command LIKE 'scan fs%' ORDER BY id DESC LIMIT 1"))
def o3(spark, sf_dir):
    return runs(spark, sf_dir).where((F.col("status") == "partial") & F.col("command").like("scan fs%")).select("id").orderBy(F.desc("id")).limit(1)


@query("O5_first_per_resource", with_runs("SELECT command, id FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY id) AS r FROM runs) WHERE r <= 10"))
def o5(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("command").orderBy("id"))
    return runs(spark, sf_dir).withColumn("r", place).where("r <= 10").select("command", "id")


@query("U1_union", with_inv("SELECT source, count(*) AS n FROM (SELECT source FROM inv WHERE source = 'nas' UNION ALL SELECT source FROM inv WHERE source IN ('nas', 'email')) GROUP BY 1"))
def u1(spark, sf_dir):
    rows = inventory(spark, sf_dir).select("source")
    return rows.where("source = 'nas'").unionByName(rows.where("source IN ('nas', 'email')")).groupBy("source").agg(F.count("*").alias("n"))


@query("U4_except", with_inv("SELECT name FROM inv WHERE source = 'nas' EXCEPT SELECT name FROM inv WHERE source = 'gdrive'"))
def u4(spark, sf_dir):
    rows = inventory(spark, sf_dir)
    return rows.where("source = 'nas'").select("name").subtract(rows.where("source = 'gdrive'").select("name"))
