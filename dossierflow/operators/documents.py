"""Documents built from rows: invoices, messages, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.text import token_estimate


def invoices(orders: DataFrame, items: DataFrame, clients: DataFrame) -> DataFrame:
    """One row an invoice: client, year, number of lines, total, and its lines rendered in order."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    lines = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.sort_array(F.collect_list(line)).alias("lines"))
    said = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- riga "), x["l_linenumber"].cast("string"), F.lit(": "), x["l_quantity"].cast("long").cast("string"))), "\n")
    joined = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(lines, "o_orderkey").join(clients.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("client")), "o_custkey")
    return joined.select("o_orderkey", "client", F.date_format("o_orderdate", "yyyy").alias("year"), "n_lines", "total", said.alias("body"))


def pack(parts: Column, budget: int, joint: str = "\n\n") -> Column:
    """Greedy packing of an array of texts into chunks of at most `budget` estimated tokens; a longer part is its own."""

    def step(acc: Column, part: Column) -> Column:
        size = token_estimate(part)
        fits = (acc["size"] + size <= budget) & (acc["text"] != "")
        return F.struct(
            F.when(fits | (acc["text"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["text"]))).alias("done"),
            F.when(fits, F.concat(acc["text"], F.lit(joint), part)).otherwise(part).alias("text"),
            F.when(fits, acc["size"] + size).otherwise(size).alias("size"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).cast("long").alias("size"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["text"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["text"]))))


def split_at(text: Column, marker: str) -> Column:
    """Parts of a text, each beginning with the marker that opens it; empty parts are dropped."""
    return F.filter(F.transform(F.split(text, f"(?m)(?={marker})"), lambda p: F.trim(p)), lambda p: p != "")


def chunks(docs: DataFrame, budget: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, chunk): whole if it fits, else by pages, sheets, headings or paragraphs, whichever parts it first."""
    col = F.col(text)
    cuts = [split_at(col, m) for m in (r"^## Pagina \d+", r"^## Foglio ", r"^#{1,2} ")]
    paragraphs = F.filter(F.transform(F.split(col, r"\n\s*\n|\n"), lambda p: F.trim(p)), lambda p: p != "")
    parts = paragraphs
    for c in reversed(cuts):
        parts = F.when(F.size(c) > 1, c).otherwise(parts)
    found = docs.where(col.isNotNull() & (F.trim(col) != "")).select(key, F.when(token_estimate(col) <= budget, F.array(col)).otherwise(pack(parts, budget)).alias("c"))
    return found.select(key, F.posexplode("c").alias("chunk_index", "chunk"))


def message_text(sender: Column, to: Column, subject: Column, body: Column) -> Column:
    labelled = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    return F.concat_ws("\n", labelled("Da: ", sender), labelled("A: ", to), labelled("Oggetto: ", subject), F.lit(""), body)
