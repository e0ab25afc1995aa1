"""Queries over texts: redaction, front matter, chunks, mentions, model answers, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import dashboard, documents, model_stage, redaction
from dossierflow.plans.bridge import inventory, with_inv
from dossierflow.plans.registry import query
from dossierflow.session import read_table, settled, spread

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
FOUND = f"found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS value, generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) AS pos FROM documents)"
NAMED = f"WITH {FOUND}, firsts AS (SELECT value, min((doc_id, pos)) AS f FROM found GROUP BY value), named AS (SELECT 'email' AS kind, value, concat('<email-', row_number() OVER (ORDER BY f), '>') AS placeholder FROM firsts)"


@query("X12_personal_values", f"WITH {FOUND} SELECT doc_id, 'email' AS kind, value FROM found")
def x12(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(X.personal_values(F.col("text"), ("email",))).alias("v")).select("doc_id", "v.kind", "v.value")


@query("X14_stable_ids", f"{NAMED} SELECT * FROM named")
def x14(spark, sf_dir):
    return redaction.dictionary(read_table(spark, sf_dir, "documents"), kinds=("email",))


@query("X12_redact", f"{NAMED} SELECT doc_id, CAST(count(*) FILTER (value IS NOT NULL) AS BIGINT) AS n_values FROM documents LEFT JOIN (SELECT DISTINCT doc_id, value FROM found) USING (doc_id) GROUP BY doc_id")
def x12b(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = redaction.redact(docs, redaction.dictionary(docs, kinds=("email",)), ("email",))
    return out.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"<email-\d+>"), F.lit(0)))).cast("long").alias("n_values"))


#: Two customers share each value: an IBAN, a tax code, an address and a number.
PERSONAL = """SELECT c_custkey AS doc_id, c_custkey // 2 AS j, concat('IT60X05428111', lpad(CAST(c_custkey // 2 AS STRING), 10, '0')) AS iban, concat('RSSMRA85T10A', lpad(CAST(c_custkey // 2 % 1000 AS STRING), 3, '0'), 'X') AS cf,
 concat('u', CAST(c_custkey // 2 AS STRING), '@posta.it') AS email, concat('02 ', CAST(100 + c_custkey // 2 % 900 AS STRING), ' ', lpad(CAST(c_custkey // 2 % 100000 AS STRING), 5, '0')) AS phone, c_custkey % 5 = 0 AS none, c_name FROM customer"""


@query(
    "X12_all_kinds",
    f"""WITH p AS ({PERSONAL}), n AS (SELECT j, cf, row_number() OVER (ORDER BY min(doc_id)) AS k FROM p WHERE NOT none GROUP BY ALL), c AS (SELECT cf, row_number() OVER (ORDER BY min(doc_id)) AS kc FROM p WHERE NOT none GROUP BY cf)
SELECT doc_id, CASE WHEN none THEN c_name ELSE concat('Cliente ', c_name, ', IBAN <iban-', k, '>, cf <cf-', kc, '>; posta <email-', k, '>, tel. <phone-', k, '>. Ancora <email-', k, '>') END AS text FROM p LEFT JOIN n USING (j) LEFT JOIN c ON c.cf = p.cf""",
)
def x12k(spark, sf_dir):
    k, j = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    mail = F.concat(F.lit("u"), j.cast("string"), F.lit("@posta.it"))
    text = F.concat(
        F.lit("Cliente "), "c_name", F.lit(", IBAN IT60X05428111"), pad(j, 10), F.lit(", cf RSSMRA85T10A"), pad(j % 1000, 3), F.lit("X; posta "), mail, F.lit(", tel. 02 "), (j % 900 + 100).cast("string"), F.lit(" "), pad(j % 100000, 5), F.lit(". Ancora "), mail
    )
    docs = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(k.alias("doc_id"), F.when(k % 5 == 0, F.col("c_name")).otherwise(text).alias("text"))
    return redaction.redact(docs, redaction.dictionary(docs))


@query("X13_unredact", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def x13(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # Each is read several times by what follows, so it is written once.
    names = settled(redaction.dictionary(docs))
    return redaction.unredact(settled(redaction.redact(docs, names)), names).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("X15_front_matter", "SELECT c_custkey, c_name AS nome, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS tipo FROM customer")
def x15(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer")
    body = F.concat(F.lit("---\nnome: "), "c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("\ntipo:  "), "c_mktsegment")), F.lit("\nnome: other\n---\n# body: x"))
    found = X.front_matter(body)
    return rows.select("c_custkey", F.try_element_at(found, F.lit("nome")).alias("nome"), F.try_element_at(found, F.lit("tipo")).alias("tipo"))


@query("X16_coerce", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'bool' WHEN 2 THEN 'int' WHEN 3 THEN 'float' ELSE 'str' END AS kind, CASE c_custkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN CAST(c_custkey AS STRING) WHEN 3 THEN concat(CAST(c_custkey AS STRING), '.5') ELSE c_name END AS value FROM customer")
def x16(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 5 == 0, " Yes").when(F.col("c_custkey") % 5 == 1, "no ").when(F.col("c_custkey") % 5 == 2, k).when(F.col("c_custkey") % 5 == 3, F.concat(k, F.lit(".5"))).otherwise(F.col("c_name"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", X.coerce_scalar(raw).alias("c")).select("c_custkey", "c.kind", "c.value")


@query("X18_sanitise", with_inv("SELECT DISTINCT name, regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM inv"))
def x18(spark, sf_dir):
    return inventory(spark, sf_dir).select("name").distinct().select("name", X.safe_name(F.col("name")).alias("safe"))


@query("X19_hashes", "SELECT doc_id, sha256(text) AS sha256, substr(sha1(concat('p/', CAST(doc_id AS STRING))), 1, 16) AS path16 FROM documents")
def x19(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha1(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).cast("binary")), 1, 16).alias("path16"))


@query(
    "X18_all_forms",
    r"SELECT doc_id, regexp_replace(t, '[^A-Za-z0-9._-]+', '_', 'g') AS name, regexp_replace(t, '[^\p{L}\p{N}._-]', '_', 'g') AS part, CASE WHEN trim(regexp_replace(t, '[^\p{L}\p{N}._ -]', '_', 'g')) = '' THEN 'unnamed' ELSE trim(regexp_replace(t, '[^\p{L}\p{N}._ -]', '_', 'g')) END AS path, CASE WHEN t = '' THEN 'noid' ELSE regexp_replace(t, '[^\p{L}\p{N}_-]', '_', 'g') END AS id FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS t FROM documents)",
)
def x18b(spark, sf_dir):
    t = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", X.safe_name(t).alias("name"), X.safe_part(t).alias("part"), X.safe_part(t, spaces=True).alias("path"), X.safe_id(t).alias("id"))


@query("X19_marks", "SELECT doc_id, substr(sha1(encode(text)[1:1048576]), 1, 32) AS first, substr(sha256(encode(text)[1:262144] || encode(concat('p/', CAST(doc_id AS STRING)))), 1, 12) AS letter FROM documents")
def x19b(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    return read_table(spark, sf_dir, "documents").select("doc_id", X.first_mark(raw).alias("first"), X.letter_mark(raw, F.concat(F.lit("p/"), F.col("doc_id").cast("string"))).alias("letter"))


@query("X29_message_text", "SELECT conv_id, turn, concat_ws(chr(10), concat('Da: ', role), CASE WHEN turn % 2 = 0 THEN 'A: desk' END, concat('Oggetto: ', CAST(conv_id AS STRING)), '', text) AS body FROM conversations")
def x29(spark, sf_dir):
    to = F.when(F.col("turn") % 2 == 0, "desk")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", documents.message_text(F.col("role"), to, F.col("conv_id").cast("string"), F.col("text")).alias("body"))


@query("X32_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def x32(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


CHUNKS = """WITH RECURSIVE parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, p, greatest(1, length(p) // 4) AS size FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, trim(unnest(string_split(text, chr(10)))) AS p FROM documents WHERE greatest(1, length(text) // 4) > 400) WHERE p <> ''),
fold AS (SELECT doc_id, k, size AS total, 0 AS chunk_index FROM parts WHERE k = 1 UNION ALL
 SELECT p.doc_id, p.k, CASE WHEN f.total + p.size <= 400 THEN f.total + p.size ELSE p.size END, CASE WHEN f.total + p.size <= 400 THEN f.chunk_index ELSE f.chunk_index + 1 END FROM fold f JOIN parts p ON p.doc_id = f.doc_id AND p.k = f.k + 1)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, string_agg(p, chr(10) || chr(10) ORDER BY k) AS chunk FROM fold JOIN parts USING (doc_id, k) GROUP BY 1, 2
UNION ALL SELECT doc_id, 0, text FROM documents WHERE greatest(1, length(text) // 4) <= 400 AND trim(text) <> ''"""


@query("W8_X34_chunks", CHUNKS)
def w8(spark, sf_dir):
    return documents.chunks(read_table(spark, sf_dir, "documents"), 400)


@query("J11_unknown_initials", "SELECT DISTINCT initials FROM (SELECT unnest(regexp_extract_all(text, '[A-Z]{2,3}')) AS initials FROM conversations) WHERE initials NOT IN ('EN', 'AN')")
def j11(spark, sf_dir):
    known = spark.createDataFrame([("EN",), ("AN",)], "link string")
    return dashboard.broken_links(read_table(spark, sf_dir, "conversations"), "conv_id", "text", r"([A-Z]{2,3})", known).select(F.col("link").alias("initials")).distinct()


@query("J13_snippets", with_inv("SELECT inv.doc_id, substr(d.text, 1, 500) AS snippet FROM inv LEFT JOIN (SELECT sha256(text) AS sha256, min(text) AS text FROM documents GROUP BY 1) d USING (sha256)"))
def j13(spark, sf_dir):
    texts = read_table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("text").alias("text"))
    # Records without a hash have keys of their own, so they don't meet in one partition.
    keyed = inventory(spark, sf_dir).withColumn("sha256", F.coalesce("sha256", F.col("doc_id").cast("string")))
    return keyed.join(texts, "sha256", "left").select("doc_id", F.substring("text", 1, 500).alias("snippet"))


MENTIONS = "SELECT doc_id, trim(lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')))) AS name FROM documents"


@query("J16_mentions", f"SELECT name, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM ({MENTIONS}) GROUP BY name")
def j16(spark, sf_dir):
    names = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{5,}"), F.lit(0))).alias("name"))
    return names.groupBy(X.normalize_name(F.col("name")).alias("name")).agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


@query("J18_S25_canned", "SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN 'one' WHEN starts_with(text, 'Th') THEN 'two' WHEN starts_with(text, 'E') THEN 'three' END AS response FROM documents")
def j18(spark, sf_dir):
    responses = spark.createDataFrame([(1, "The ", "one"), (2, "Th", "two"), (3, "E", "three")], "ord int, prefix string, response string")
    asked = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return model_stage.canned(asked, responses)


@query("C5_C6_model_answers", with_inv("SELECT doc_id AS key, CASE WHEN doc_id // 20 % 4 = 0 THEN 'da-chiarire' WHEN doc_id % 2 = 0 THEN 'da-consultare' ELSE 'da-chiarire' END AS category, CASE WHEN doc_id // 20 % 4 <> 0 AND doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM inv"))
def c5(spark, sf_dir):
    def model(asked: list[str]) -> list[str]:
        import json

        out = []
        for prompt in asked:
            rows = json.loads(prompt)
            if rows[0]["id"] // 20 % 4 == 0:
                raise TimeoutError
            out.append("Here: " + json.dumps([{"id": str(r["id"]), "category": "Da Consultare" if r["id"] % 2 == 0 else "?", "confidence": 7, "reason": "x"} for r in rows]) + " done")
        return out

    asked = model_stage.prompts(inventory(spark, sf_dir).select("doc_id", "name", "path"), ["name", "path"])
    return model_stage.parse(model_stage.ask(asked, model)).select("key", "category", "confidence")


@query("U2_ordered_union", "SELECT conv_id, string_agg(role, '|' ORDER BY f) AS roles FROM (SELECT conv_id, role, min((turn, role)) AS f FROM (SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, 1000000, 'closing' FROM conversations) GROUP BY conv_id, role) GROUP BY conv_id")
def u2(spark, sf_dir):
    lists = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    closing = F.array(F.lit("closing"), F.get("turns.role", F.lit(0)))
    return lists.select("conv_id", F.array_join(X.ordered_union(F.col("turns.role"), closing), "|").alias("roles"))


@query("X23_quality", "SELECT doc_id, round(least(1.0::DOUBLE, n_chars / (50.0::DOUBLE * greatest(1, n_chars // 1800))), 4) AS text_quality, round(least(1.0::DOUBLE, n_chars / (200.0::DOUBLE * greatest(1, n_chars // 1800))), 4) AS ocr_quality FROM documents")
def x23(spark, sf_dir):
    pages = F.greatest(F.lit(1), F.floor(F.col("n_chars") / 1800))
    q = lambda per: F.round(F.least(F.lit(1.0), F.col("n_chars") / (F.lit(float(per)) * pages)), 4)
    return read_table(spark, sf_dir, "documents").select("doc_id", q(50).alias("text_quality"), q(200).alias("ocr_quality"))


@query("X30_html_text")
def x30(spark, sf_dir):
    from dossierflow.sources.extract import html_to_text

    return html_to_text(read_table(spark, sf_dir, "pages")).select("page_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))
