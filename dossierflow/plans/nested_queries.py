"""Queries over nested documents, made as JSON from `customer`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.operators import nested
from dossierflow.plans.registry import query
from dossierflow.session import read_table

DAY = "2025-06-15"

#: A stored card and a candidate for each customer: maps in maps, lists, texts short and long, a map against a text, absent fields.
CARDS = """SELECT c_custkey AS pk, c_name AS nome, c_mktsegment AS settore, c_nationkey AS paese,
  CASE WHEN c_custkey % 4 = 0 THEN repeat(concat(c_mktsegment, ' '), 10) ELSE c_mktsegment END AS nota_a,
  CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE concat('nuova ', c_name) END AS nota_b,
  c_custkey % 3 = 0 AS flat, c_custkey % 7 = 0 AS only_old, (c_custkey % 11) / 10.0 AS confidence FROM customer"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "customer").createOrReplaceTempView("nested_customer")
    return spark.sql(CARDS.replace("FROM customer", "FROM nested_customer"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _cards(spark, sf_dir)
    inner = F.struct(F.col("settore").alias("sconto"), F.struct(F.col("paese").alias("n"), F.array("settore", F.lit("b")).alias("voci")).alias("fondo"))
    old = rows.select("pk", F.to_json(F.struct("nome", inner.alias("cond"), F.col("nota_a").alias("nota"))).alias("doc"))
    deep = F.to_json(F.struct(F.struct(F.lit("12%").alias("sconto"), F.struct(F.array(F.lit("c"), F.col("settore")).alias("voci"), F.lit(True).alias("attivo")).alias("fondo")).alias("cond"), F.col("nota_b").alias("nota")))
    flat = F.to_json(F.struct(F.lit("nessuna").alias("cond"), F.col("nota_b").alias("nota")))
    new = rows.where("NOT only_old").select("pk", F.when(F.col("flat"), flat).otherwise(deep).alias("doc"))
    return old, new


@query(
    "X36_nested_merge",
    f"""WITH cards AS ({CARDS}) SELECT pk, nome, CASE WHEN only_old THEN settore WHEN flat THEN NULL ELSE '12%' END AS sconto,
 CASE WHEN flat AND NOT only_old THEN 'nessuna' END AS cond, CASE WHEN only_old OR NOT flat THEN CAST(paese AS STRING) END AS n,
 CASE WHEN only_old THEN concat(settore, ',b') WHEN NOT flat THEN concat(settore, ',b,c') END AS voci, CASE WHEN NOT flat AND NOT only_old THEN 'true' END AS attivo,
 CASE WHEN only_old OR nota_a = nota_b THEN nota_a WHEN length(nota_a) <= 80 AND length(nota_b) <= 80 THEN nota_b WHEN contains(nota_a, nota_b) THEN nota_a
  ELSE concat(nota_a, chr(10), chr(10), '— aggiornamento {DAY} —', chr(10), nota_b) END AS nota FROM cards""",
)
def x36n(spark, sf_dir):
    merged = nested.merge_documents(*_sides(spark, sf_dir), ["pk"], "doc", DAY)
    at = lambda path: F.get_json_object("doc", path)
    plain = F.when(F.startswith(at("$.cond"), F.lit("{")), None).otherwise(at("$.cond"))
    voci = F.array_join(F.from_json(at("$.cond.fondo.voci"), "array<string>"), ",")
    return merged.select("pk", at("$.nome").alias("nome"), at("$.cond.sconto").alias("sconto"), plain.alias("cond"), at("$.cond.fondo.n").alias("n"), voci.alias("voci"), at("$.cond.fondo.attivo").alias("attivo"), at("$.nota").alias("nota"))


@query(
    "A18_nested_merge",
    f"""WITH cards AS ({CARDS}), pairs AS (SELECT pk // 2 AS entity, count(*) AS n, round(avg(confidence), 6) AS confidence, min_by(nome, pk) AS first_name, max_by(nome, pk) AS last_name,
 min_by(confidence, pk) AS c1, max_by(confidence, pk) AS c2, min_by(settore, pk) AS s1, max_by(settore, pk) AS s2, min_by(pk, pk) % 3 = 0 AS empty1, max_by(pk, pk) % 3 = 0 AS empty2 FROM cards GROUP BY 1)
SELECT entity, n, confidence, CASE WHEN c1 >= c2 THEN first_name ELSE last_name END AS nome,
 CASE WHEN empty1 AND empty2 THEN NULL WHEN empty1 THEN s2 WHEN empty2 OR c1 >= c2 THEN s1 ELSE s2 END AS sconto, CASE WHEN s1 = s2 THEN s1 ELSE concat(s1, ',', s2) END AS tags FROM pairs""",
)
def a18n(spark, sf_dir):
    rows = _cards(spark, sf_dir)
    doc = F.to_json(F.struct("nome", F.struct(F.when(F.col("flat"), "").otherwise(F.col("settore")).alias("sconto")).alias("cond"), F.array("settore").alias("tags")))
    merged = nested.merge_confident(rows.select((F.col("pk") / 2).cast("long").alias("entity"), "pk", doc.alias("doc"), "confidence"), ["entity"], "pk", "doc", "confidence")
    at = lambda path: F.get_json_object("doc", path)
    return merged.select("entity", "n", F.round("confidence", 6).alias("confidence"), at("$.nome").alias("nome"), at("$.cond.sconto").alias("sconto"), F.array_join(F.from_json(at("$.tags"), "array<string>"), ",").alias("tags"))


@query(
    "X39_nested_errors",
    """SELECT c_custkey AS pk, concat_ws('|', CASE c_custkey % 5 WHEN 1 THEN 'cond.fondo.n: expected integer, found string' WHEN 2 THEN 'cond: expected object, found string' END,
 CASE WHEN c_custkey % 4 = 1 THEN 'nome: expected string, found null' WHEN c_custkey % 4 = 2 THEN 'nome: missing' END,
 CASE WHEN c_custkey % 3 = 0 THEN 'voci.1: expected string, found integer' WHEN c_custkey % 3 = 1 THEN 'voci: expected array, found boolean' END) AS errors FROM customer""",
)
def x39n(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer")
    cond = F.when(k % 5 == 1, F.lit('{"fondo":{"n":"x"}}')).when(k % 5 == 2, F.lit('"flat"')).otherwise(F.lit('{"fondo":{"n":3}}'))
    voci = F.when(k % 3 == 0, F.lit('["a",2]')).when(k % 3 == 1, F.lit("true")).otherwise(F.lit("null"))
    name = F.when(k % 4 == 1, F.lit('"nome":null,')).when(k % 4 == 2, F.lit("")).otherwise(F.concat(F.lit('"nome":'), F.lit('"'), "c_name", F.lit('",')))
    doc = F.concat(F.lit('{"tipo":"cliente",'), name, F.lit('"cond":'), cond, F.lit(',"voci":'), voci, F.lit("}"))
    docs = rows.select(k.alias("pk"), doc.alias("doc"))
    # The least card without a fault is the sample that the rules come from.
    sample = docs.where("pk % 60 = 0").select(F.min_by("doc", "pk").alias("doc"))
    found = nested.errors(docs, ["pk"], "doc", nested.infer_rules(sample, "doc"))
    return found.select("pk", F.array_join("errors", "|").alias("errors"))
