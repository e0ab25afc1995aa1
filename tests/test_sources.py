"""Sources, sinks, extraction and the stream over small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from dossierflow.sources import extract, files, listings
from dossierflow.streaming import watch


@pytest.fixture
def inbox(tmp_path):
    root = tmp_path / "inbox"
    root.mkdir()
    (root / "a.txt").write_text("perché no", encoding="utf-8")
    (root / "b.csv").write_text("x;y;z\n1;2;3\n")
    (root / "c.eml").write_bytes(b"From: A <a@b.it>\r\nTo: c@d.it\r\nSubject: Hi\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nhello\r\n--q\r\nContent-Type: application/pdf; name=f.pdf\r\nContent-Disposition: attachment; filename=f.pdf\r\n\r\nPDF\r\n--q--\r\n")
    (root / "bad.docx").write_bytes(b"no zip")
    buf = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Titolo</w:t></w:r></w:p><w:p><w:r><w:t>Testo</w:t></w:r></w:p></w:body></w:document>')
    (root / "d.docx").write_bytes(buf.getvalue())
    buf = io.BytesIO()
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="Uno"/></sheets></workbook>')
        cell = lambda r, c, v: f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row>{cell(1, "A", "note")}</row><row>{"".join(cell(2, c, c.lower()) for c in "ABC")}</row><row>{"".join(cell(3, c, 1) for c in "ABC")}</row></sheetData></worksheet>')
    (root / "e.xlsx").write_bytes(buf.getvalue())
    (root / "~tmp~").write_text("x")
    return str(root)


def test_scan_and_extract(spark, inbox):
    rows = files.scan_files(spark, inbox, "nas")
    assert rows.count() == 7 and rows.where("length(sha256) = 64").count() == 7
    raw = spark.read.format("binaryFile").load(inbox).select("path", "content")
    got = {r.path.rsplit("/", 1)[1]: r for r in extract.extract(raw).collect()}
    assert got["a.txt"].markdown == "perché no" and got["b.csv"].markdown.startswith("| x | y | z |")
    assert got["d.docx"].markdown == "# Titolo\n\nTesto" and "| a | b | c |" in got["e.xlsx"].markdown and "- note" in got["e.xlsx"].markdown
    assert "hello" in got["c.eml"].markdown and got["bad.docx"].warning and got["bad.docx"].quality == 0


def test_mailbox_and_attachments(spark, inbox):
    mails = extract.mailbox(spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(inbox))
    row = mails.first()
    assert row.sender == "A <a@b.it>" and row.to == ["c@d.it"] and row.snippet.strip() == "hello"
    att = extract.attachments(mails).first()
    assert att.source_id == "<1@x>#att2" and att.name == "f.pdf"


def test_html_text():
    assert extract.html_text("<h1>T</h1><script>x</script><p>a&amp;b <b>c</b></p><li>i") == "# T\n\na&b c\n\n- i"


@pytest.mark.parametrize(
    "markup,text",
    [
        ("", ""),
        ("no tags &lt;here&gt; &egrave;&#233;&nbsp;x", "no tags <here> èé\xa0x"),
        ("<!DOCTYPE html><!-- a <p>b</p> --><P>One<BR>two</P>", "One\ntwo"),
        ("<div><div><div>a</div></div></div><div>b</div>", "a\n\nb"),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n\n- b"),
        ('<a title="x > y">link</a><style>p{}</style><script>if (a<b) { "</p>" }</script>end', "linkend"),
        ("<h2>Tit<em>ol</em>o</h2><p>  many \t spaces\nand lines  </p>", "## Titolo\n\nmany spaces\nand lines"),
        ("<table><tr><td>1</td><td>2</td></tr><tr><td>3", "12\n\n3"),
    ],
)
def test_html_golden_rows(spark, markup, text):
    rows = spark.createDataFrame([(1, markup), (2, None)], "k int, html string")
    assert {r.k: r.text for r in extract.html_to_text(rows).collect()} == {1: text, 2: None}


def test_listings(spark, tmp_path):
    (tmp_path / "drive.json").write_text(json.dumps({"files": [{"id": "1", "name": "n", "mimeType": "text/plain", "size": "12", "modifiedTime": "2024-01-01T00:00:00Z", "parents": ["r"], "owners": [{"displayName": "D"}], "trashed": False}, {"id": "2", "trashed": True}, {"id": "3", "modifiedTime": "bad"}]}))
    got = {r.source_id: r for r in listings.drive_listing(spark, str(tmp_path / "drive.json")).collect()}
    assert set(got) == {"1", "3"} and got["1"].size == 12 and got["1"].author == "D" and got["3"].mtime.year == 1970
    (tmp_path / "one.json").write_text(json.dumps([{"id": "x", "name": "f", "size": 3, "createdBy": {"user": {"displayName": "U"}}}]))
    assert listings.onedrive_listing(spark, str(tmp_path / "one.json")).first().author == "U"


def test_drive_paths_end_on_cycles(spark):
    folders = spark.createDataFrame([("a", "root", "A"), ("b", "a", "B"), ("a", "b", "A"), ("z", "y", "Z")], "id string, parent_id string, name string")
    assert {(r.id, r.path) for r in listings.drive_paths(folders, "root").collect()} == {("a", "A"), ("b", "A/B")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("nas", "1", "p", "n", 1)], "source string, source_id string, path string, name string, size long")
    files.append_inventory(rows, f"{tmp_path}/inv")
    files.append_inventory(rows, f"{tmp_path}/inv")
    assert files.read_inventory(spark, f"{tmp_path}/inv/*").count() == 2
    files.write_snapshot(rows, f"{tmp_path}/snap")
    files.write_snapshot(rows.unionByName(rows), f"{tmp_path}/snap")
    assert files.read_snapshot(spark, f"{tmp_path}/snap").count() == 2
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "x.md").write_text("one")
    vault = files.read_vault(spark, str(tmp_path / "v"))
    pages = vault.select("path", F.lit("one").alias("text")).unionByName(spark.createDataFrame([("new", "t")], "path string, text string"))
    assert sorted(r.action for r in files.write_pages(pages, vault).collect()) == ["create", "skip"]


def test_watch(spark, inbox, tmp_path):
    seen = []
    args = (f"{tmp_path}/inventory", f"{tmp_path}/dead", f"{tmp_path}/cp")
    watch.watch(spark, inbox, *args, after=lambda df, n: seen.append(df.count()), pause=0.0).awaitTermination()
    assert sum(seen) == 5
    assert spark.read.json(f"{args[1]}/letters").select("error").count() == 1
    with open(f"{inbox}/again.txt", "w", encoding="utf-8") as f:
        f.write("perché no")
    with open(f"{inbox}/new.txt", "w", encoding="utf-8") as f:
        f.write("new")
    watch.watch(spark, inbox, *args, pause=0.0).awaitTermination()
    assert spark.read.parquet(args[0]).count() == 6
