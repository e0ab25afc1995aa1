"""Sheets as cells: the header, the table below it and what lies beside, by gaps and islands over (row, column).

A cell is a row of (keys of the sheet, row, col, text), both numbered from 0. The header is the first row with a run of
at least three filled cells, its longest (of equal ones the first); the table goes on below it to the first row without
a filled cell, in the header's columns. Everything else is free cells. Null and empty texts are no cells; of repeated cells
the least text counts. A sheet without a header is free cells alone. No bound on rows: a file format has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: cells in a row that make a header.
HEADER_CELLS = 3


def letters(col: Column) -> Column:
    """A, B, ..., Z, AA, ... of a column number from 0; three letters, as sheets have."""
    letter = lambda n: F.char((F.lit(65) + n % 26).cast("int"))
    second = F.floor(col / 26) - 1
    third = F.floor(second / 26) - 1
    return F.concat(F.when(third >= 0, letter(third)).otherwise(""), F.when(second >= 0, letter(second)).otherwise(""), letter(col))


def address(row: Column, col: Column) -> Column:
    return F.concat(letters(col), (row + 1).cast("string"))


def shown(text: Column) -> Column:
    """A cell's text as Markdown tables hold it."""
    return F.trim(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def filled(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.where("text IS NOT NULL AND text <> '' AND row IS NOT NULL AND col IS NOT NULL").groupBy(*keys, "row", "col").agg(F.min("text").alias("text"))


def placed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The filled cells with header, start, n and stop: header row of their sheet, its columns, and the first row behind the table; null without one.

    Cells are dealt out by sheet once; all that follows sorts within the tasks. A sheet with a null key has no header.
    """
    sheet = Window.partitionBy(*keys)
    own = filled(cells.repartition(*keys), keys).withColumn("_island", F.col("col") - F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col")))
    run = Window.partitionBy(*keys, "row", "_island")
    own = own.withColumns({"_start": F.min("col").over(run), "_n": F.count("*").over(run), "_rank": F.dense_rank().over(sheet.orderBy("row"))})
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    best = F.min(F.when(known & (F.col("_n") >= HEADER_CELLS), F.struct("row", (-F.col("_n")).alias("n"), F.col("_start").alias("start"), F.col("_rank").alias("rank")))).over(sheet)
    own = own.withColumn("_b", best)
    # Rows go on without a gap as long as they and their ranks are equally far from the header.
    joined = (F.col("row") >= F.col("_b.row")) & (F.col("row") - F.col("_b.row") == F.col("_rank") - F.col("_b.rank"))
    own = own.withColumn("stop", F.max(F.when(joined, F.col("row") + 1)).over(sheet))
    return own.select(*keys, "row", "col", "text", F.col("_b.row").alias("header"), F.col("_b.start").alias("start"), (-F.col("_b.n")).alias("n"), "stop")


def _inside() -> Column:
    return (F.col("row") >= F.col("header")) & (F.col("row") < F.col("stop")) & (F.col("col") >= F.col("start")) & (F.col("col") < F.col("start") + F.col("n"))


def headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header, start, n, stop of the sheets that have a header."""
    return placed(cells, keys).where("row = header AND col = start").select(*keys, "header", "start", "n", "stop")


def tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, place, name, text: the filled cells of each table by line (from 1) and column of the header."""
    name = F.max(F.when(F.col("row") == F.col("header"), F.col("text"))).over(Window.partitionBy(*keys, "col"))
    own = placed(cells, keys).where(_inside()).withColumn("name", name).where("row > header")
    return own.select(*keys, (F.col("row") - F.col("header")).alias("line"), (F.col("col") - F.col("start")).alias("place"), "name", "text")


def free_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, address, text of the cells outside the tables."""
    return placed(cells, keys).where(~F.coalesce(_inside(), F.lit(False))).select(*keys, address(F.col("row"), F.col("col")).alias("address"), "text")
