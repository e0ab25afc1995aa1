"""Queries over cards, drafts, front matter and sheets, made from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossierflow.operators import cards, sheets
from dossierflow.plans.registry import query
from dossierflow.plans.source_queries import _folder
from dossierflow.session import read_table, spread
from dossierflow.sources import files
from dossierflow.sources.stores import write_files


@query(
    "K7_client_cards",
    """SELECT concat('clienti/c', CAST(c_custkey AS STRING), '.md') AS path, concat('---', chr(10), 'tipo: cliente', chr(10), 'nome: ', c_name, chr(10), 'piva: ''', CAST(10000000000 + c_custkey AS STRING), '''', chr(10),
 'settore: ', c_mktsegment, chr(10), 'condizioni_commerciali:', chr(10), '  fondo:', chr(10), '    attivo: ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, chr(10), '  sconto: 12%', chr(10),
 'prodotti_ricorrenti:', chr(10), '- nome: ', c_mktsegment, chr(10), '  righe:', chr(10), '  - ', CAST(c_nationkey AS STRING), chr(10), 'note_relazionali: |-', chr(10), '  riga uno', chr(10), '  di ', c_name, chr(10),
 'altro: null', chr(10), '---', chr(10), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(chr(10), '# ', c_name, chr(10)) END) AS text FROM customer""",
)
def k7(spark, sf_dir):
    k = F.col("c_custkey")
    deal = F.struct(F.lit("12%").alias("sconto"), F.struct((k % 2 == 0).alias("attivo")).alias("fondo"))
    goods = F.array(F.struct(F.col("c_mktsegment").alias("nome"), F.array("c_nationkey").alias("righe")))
    note = F.concat(F.lit("riga uno\ndi "), "c_name")
    made = F.struct(
        F.lit(None).cast("string").alias("altro"), note.alias("note_relazionali"), goods.alias("prodotti_ricorrenti"), deal.alias("condizioni_commerciali"),
        F.col("c_mktsegment").alias("settore"), (k + 10_000_000_000).cast("string").alias("piva"), F.col("c_name").alias("nome"), F.lit("cliente").alias("tipo"),
    )
    # As VARIANT, as merges leave it: keys sorted.
    fields = F.to_json(F.parse_json(F.to_json(made, {"ignoreNullFields": "false"})))
    body = F.when(k % 3 == 0, F.lit("\n")).otherwise(F.concat(F.lit("\n\n# "), "c_name", F.lit("\n\n")))
    # Dealt out before the fields are made, which takes longer than the reading.
    rows = spread(read_table(spark, sf_dir, "customer")).select(F.lit("cliente").alias("kind"), F.concat(F.lit("c"), k.cast("string")).alias("slug"), fields.alias("fields"), body.alias("body"))
    root = _folder(spark, "cards")
    cards.write_cards(rows, root, dealt=True)
    return files.read_vault(spark, root).select(F.regexp_extract("path", "(clienti/.*)$", 1).alias("path"), "text")


#: One card for each customer: maps, a list of maps, a block, a comment; every seventh is broken.
YAML = "concat('---\ntipo: cliente\nnome: \"', c_name, '\"  # nome\ncondizioni:\n  sconto: ', CAST(c_nationkey AS STRING), '%\n  giorni: ', CAST(c_custkey % 90 AS STRING), '\nvoci:\n  - data: 2024-01-', CAST(10 + c_custkey % 20 AS STRING), '\n    n: 1\n  - {data: x, n: ', CAST(c_custkey AS STRING), '}\nnote: |\n  uno\n  due ', c_mktsegment, '\n', CASE WHEN c_custkey % 7 = 0 THEN 'rotto\n' ELSE '' END, '---\ncorpo ', c_name)"


@query(
    "X15_yaml",
    """SELECT c_custkey, c_custkey % 7 = 0 AS broken, concat('corpo ', c_name) AS body, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS nome, CASE WHEN c_custkey % 7 <> 0 THEN concat(CAST(c_nationkey AS STRING), '%') END AS sconto,
 CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 90 END AS giorni, CASE WHEN c_custkey % 7 <> 0 THEN concat('2024-01-', CAST(10 + c_custkey % 20 AS STRING)) END AS data, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS n,
 CASE WHEN c_custkey % 7 <> 0 THEN concat('uno', chr(10), 'due ', c_mktsegment, chr(10)) END AS note FROM customer""",
)
def x15y(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.expr(YAML.replace("\n", "\\n")).alias("text"))
    v = F.try_parse_json("fields")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    found = cards.parsed(rows, "text", "yaml")
    return found.select(
        "c_custkey", F.col("problem").isNotNull().alias("broken"), "body", at("$.nome", "string").alias("nome"), at("$.condizioni.sconto", "string").alias("sconto"), at("$.condizioni.giorni", "long").alias("giorni"),
        at("$.voci[0].data", "string").alias("data"), at("$.voci[1].n", "long").alias("n"), at("$.note", "string").alias("note"),
    )


@query(
    "S15_drafts",
    "SELECT concat('batch ', CAST(c_custkey % 5 AS STRING)) AS batch, concat('è+', CAST(c_custkey AS STRING), '.md') AS name, c_name AS slug, (c_custkey % 100) / 100.0 AS confidence, c_custkey % 3 AS n_warnings, length(c_mktsegment) AS n_body FROM customer WHERE c_custkey % 5 <> 4",
)
def s15(spark, sf_dir):
    k = F.col("c_custkey")
    warnings = F.concat(F.lit("warnings:\n"), F.repeat(F.lit("- manca\n"), (k % 3).cast("int")))
    text = F.concat(F.lit("---\nslug: "), "c_name", F.lit("\nconfidence: 0."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("\n"), warnings, F.lit("---\n"), "c_mktsegment")
    batch = F.concat(F.when(k % 5 == 4, "_old ").otherwise("batch "), (k % 5).cast("string"))
    root = _folder(spark, "drafts")
    write_files(read_table(spark, sf_dir, "customer").select(F.concat(batch, F.lit("/è+"), k.cast("string"), F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content")), root)
    v = F.try_parse_json("fields")
    found = cards.read_drafts(spark, root)
    return found.select("batch", "name", F.try_variant_get(v, "$.slug", "string").alias("slug"), F.try_variant_get(v, "$.confidence", "double").alias("confidence"), F.size(F.try_variant_get(v, "$.warnings", "array<string>")).cast("long").alias("n_warnings"), F.length("body").cast("long").alias("n_body"))


@query(
    "K7_people_lists",
    """SELECT domain, n, messages, sha256(string_agg(row, chr(10) ORDER BY email)) AS table_sha256 FROM (SELECT concat('d', CAST(c_nationkey AS STRING), '.it') AS domain, concat('u', CAST(c_custkey AS STRING), '@d.it') AS email,
 concat('| ', CASE WHEN c_custkey % 4 = 0 THEN 'TODO' ELSE c_name END, ' | ', CASE WHEN c_custkey % 3 = 0 THEN 'TODO' ELSE concat('a; ', lower(c_mktsegment)) END, ' | TODO | u', CAST(c_custkey AS STRING), '@d.it | ', CAST(c_custkey % 50 AS STRING), ' | — | 2024-03-01 |') AS row,
 count(*) OVER (PARTITION BY c_nationkey) AS n, sum(c_custkey % 50) OVER (PARTITION BY c_nationkey) AS messages FROM customer) GROUP BY ALL""",
)
def k7_people(spark, sf_dir):
    k = F.col("c_custkey")
    people = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("d"), F.col("c_nationkey").cast("string"), F.lit(".it")).alias("domain"), F.concat(F.lit("u"), k.cast("string"), F.lit("@d.it")).alias("email"),
        F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 3 != 0, F.array(F.lower("c_mktsegment"), F.lit("a"))).alias("roles"), F.array().cast("array<string>").alias("phones"),
        (k % 50).alias("n_messages"), F.lit(None).cast("date").alias("first_seen"), F.lit("2024-03-01").cast("date").alias("last_seen"),
    )
    full, safe = cards.people_lists(people, "2025-06-15"), cards.people_lists(people, "2025-06-15", full=False).withColumnRenamed("text", "safe")
    table = F.regexp_extract("text", r"(?s)\|---\|---\|---\|---\|---\|---\|---\|\n(.*?)\n\n", 1)
    number = lambda name: F.regexp_extract("safe", name + r": (\d+)", 1).cast("long")
    return full.join(safe, "domain").select("domain", number("uniche").alias("n"), number(r"`from`\)").alias("messages"), F.sha2(table, 256).alias("table_sha256"))


# ---------------------------------------------------------------- sheets as cells

#: A sheet for each order: a title, a gap, a header from its second column on, a line a line item, a gap, a note with an address beyond Z.
CELLS = """SELECT o_orderkey AS sheet, 0 AS row, 0 AS col, concat('Ordine ', CAST(o_orderkey AS STRING)) AS text FROM orders
UNION ALL SELECT o_orderkey, 2, unnest([0, 2, 3, 4]), unnest(['x', 'parte', 'pezzi', 'importo']) FROM orders
UNION ALL SELECT l_orderkey, 2 + k, 2, CASE WHEN k % 2 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END FROM lines UNION ALL SELECT l_orderkey, 2 + k, 3, CAST(CAST(l_quantity AS BIGINT) AS STRING) FROM lines
UNION ALL SELECT l_orderkey, 2 + k, 4, CAST(l_linenumber AS STRING) FROM lines
UNION ALL SELECT o_orderkey, 40, 27 + CAST(o_orderkey % 3 AS INTEGER), 'nota' FROM orders UNION ALL SELECT o_orderkey, 41, 3, 'dopo' FROM orders"""
LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"


def _sheet_cells(spark, sf_dir):
    orders, key = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sheet")), F.col("sheet")
    cell = lambda row, col, text: F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), text.alias("text"))
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    items = read_table(spark, sf_dir, "lineitem").withColumn("k", k).withColumnRenamed("l_orderkey", "sheet").join(orders, "sheet", "left_semi")
    fixed = [
        cell(F.lit(0), F.lit(0), F.concat(F.lit("Ordine "), key.cast("string"))),
        *[cell(F.lit(2), F.lit(c), F.lit(t)) for c, t in ((0, "x"), (2, "parte"), (3, "pezzi"), (4, "importo"))],
        cell(F.lit(40), 27 + key % 3, F.lit("nota")),
        cell(F.lit(41), F.lit(3), F.lit("dopo")),
    ]
    lines = [
        cell(F.col("k") + 2, F.lit(2), F.when(F.col("k") % 2 != 0, F.col("l_partkey").cast("string"))),
        cell(F.col("k") + 2, F.lit(3), F.col("l_quantity").cast("long").cast("string")),
        cell(F.col("k") + 2, F.lit(4), F.col("l_linenumber").cast("string")),
    ]
    made = lambda rows, cells: rows.select("sheet", F.inline(F.array(*cells)))
    return made(orders, fixed).unionByName(made(items, lines))


@query("S21_W10_sheet_tables", f"WITH {LINES} SELECT l_orderkey AS sheet, k AS line, place, name, text FROM (SELECT l_orderkey, k, 0 AS place, 'parte' AS name, CASE WHEN k % 2 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS text FROM lines UNION ALL SELECT l_orderkey, k, 1, 'pezzi', CAST(CAST(l_quantity AS BIGINT) AS STRING) FROM lines UNION ALL SELECT l_orderkey, k, 2, 'importo', CAST(l_linenumber AS STRING) FROM lines) WHERE text IS NOT NULL")
def s21(spark, sf_dir):
    return sheets.tables(_sheet_cells(spark, sf_dir), ["sheet"])


@query(
    "X35_free_cells",
    "SELECT o_orderkey AS sheet, unnest(['A1', 'A3', CASE o_orderkey % 3 WHEN 0 THEN 'AB41' WHEN 1 THEN 'AC41' ELSE 'AD41' END, 'D42']) AS address, unnest([concat('Ordine ', CAST(o_orderkey AS STRING)), 'x', 'nota', 'dopo']) AS text FROM orders",
)
def x35(spark, sf_dir):
    return sheets.free_cells(_sheet_cells(spark, sf_dir), ["sheet"])
