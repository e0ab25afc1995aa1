"""Sheets as cells against plain loops over grids; workbooks as cells."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from dossierflow.operators import sheets
from dossierflow.sources import extract

SCHEMA = "book string, sheet long, row long, col long, text string"


def plain(grid):
    """(header, start, n, stop) by the rules; None without a header."""
    for i, row in enumerate(grid):
        best, run = (0, 0), None
        for j, v in enumerate([*row, ""]):
            if v and run is None:
                run = j
            elif not v and run is not None:
                best, run = max(best, (j - run, -run)), None
        if best[0] >= 3:
            stop = next((k for k in range(i + 1, len(grid)) if not any(grid[k])), len(grid))
            return i, -best[1], best[0], stop
    return None


def name(j):
    out = ""
    while j >= 0:
        out, j = chr(65 + j % 26) + out, j // 26 - 1
    return out


def test_tables_and_free_cells_against_grids(spark):
    rng = random.Random(4)
    grids = {k: [[rng.choice(["", "", f"{k}.{i}.{j}"]) for j in range(rng.choice([3, 6, 30]))] if rng.random() < 0.8 else [] for i in range(rng.randrange(12))] for k in range(120)}
    grids[500] = [["a"] * 720]
    cells = [("b", k, i, j, v or rng.choice([None, ""])) for k, g in grids.items() for i, row in enumerate(g) for j, v in enumerate(row)]
    df = spark.createDataFrame([*cells, cells[-1], ("b", 900, None, 1, "x"), ("b", 901, 3, None, "x")], SCHEMA)
    table, free = set(), set()
    for k, g in grids.items():
        found = plain(g)
        for i, row in enumerate(g):
            for j, v in enumerate(row):
                if not v:
                    continue
                if found and found[0] <= i < found[3] and found[1] <= j < found[1] + found[2]:
                    if i > found[0]:
                        table.add((k, i - found[0], j - found[1], g[found[0]][j], v))
                else:
                    free.add((k, f"{name(j)}{i + 1}", v))
    keys = ["book", "sheet"]
    assert {(r.sheet, r.line, r.place, r.name, r.text) for r in sheets.tables(df, keys).collect()} == table
    assert {(r.sheet, r.address, r.text) for r in sheets.free_cells(df, keys).collect()} == free
    heads = {r.sheet: (r.header, r.start, r.n, r.stop) for r in sheets.headers(df, keys).collect()}
    assert heads == {k: plain(g) for k, g in grids.items() if plain(g)}


def test_letters_and_shown(spark):
    got = spark.range(0, 18_278, 97).select("id", sheets.letters(F.col("id")).alias("a")).collect()
    assert all(r.a == name(r.id) for r in got)
    row = spark.range(1).select(sheets.shown(F.lit(" a|b\nc ")).alias("s"), sheets.address(F.lit(11), F.lit(26)).alias("a")).first()
    assert (row.s, row.a) == ("a\\|b c", "AA12")


def test_no_cells(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sheets.tables(empty, ["sheet"]).count() == sheets.free_cells(empty, ["sheet"]).count() == 0


def workbook(rows):
    """One sheet; a row is (number or None, [(address or None, text)])."""
    buf = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda a, t: f'<c{f" r=\"{a}\"" if a else ""} t="inlineStr"><is><t>{t}</t></is></c>'
    body = "".join(f"<row{f' r=\"{n}\"' if n else ''}>{''.join(cell(*c) for c in cs)}</row>" for n, cs in rows)
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()


def test_workbooks_as_cells(spark):
    raw = workbook([(2, [("B2", "a"), (None, "b"), ("D2", "c")]), (None, [("B3", "1")]), (6, [("A6", "dopo"), ("AA6", "x")])])
    long = workbook([(1, [(None, "h1"), (None, "h2"), (None, "h3")]), *[(k, [(None, f"v{k}")]) for k in range(2, 1203)]])
    files = spark.createDataFrame([("w", raw), ("long", long), ("bad", b"no zip")], "path string, content binary")
    rows = extract.workbook_cells(files).collect()
    assert {(r.row, r.col, r.text) for r in rows if r.path == "w"} == {(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "1"), (5, 0, "dopo"), (5, 26, "x")}
    assert [r.warning is not None for r in rows if r.path == "bad"] == [True]
    cells = extract.workbook_cells(files).where("warning IS NULL")
    assert sheets.tables(cells, ["path", "sheet"]).groupBy("path").count().orderBy("path").collect() == [("long", 1201), ("w", 1)]
    assert {(r.address, r.text) for r in sheets.free_cells(cells, ["path", "sheet"]).where("path = 'w'").collect()} == {("A6", "dopo"), ("AA6", "x")}
    text = extract._xlsx(raw)[0]
    assert text == "## Foglio S\n\n| a | b | c |\n| --- | --- | --- |\n| 1 |  |  |\n\n- dopo\n\n- x"
    assert "_201 righe oltre le prime 1000 non mostrate_" in extract._xlsx(long)[0]


def test_cells_are_dealt_out_once(spark):
    cells = spark.createDataFrame([("s", 0, 0, "a")], "sheet string, row long, col long, text string")
    for found in (sheets.tables(cells, ["sheet"]), sheets.free_cells(cells, ["sheet"])):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
