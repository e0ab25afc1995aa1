"""Text extraction in tasks: plain text, CSV, HTML, mail, DOCX and XLSX with the standard library, one row an error at most.

`extract(files)` takes binary rows (path, content) and adds kind, markdown, quality, warnings. Parsing is the only
Python here; choosing the parser, the quality rules and everything behind it are columns.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MAX_ROWS, MAX_UNZIPPED, MAX_MAIL = 200_000, 1000, 200 * 1024 * 1024, 50 * 1024
KINDS = {".txt": "plain", ".md": "plain", ".csv": "csv", ".html": "html", ".htm": "html", ".eml": "eml", ".docx": "docx", ".xlsx": "xlsx"}
MIMES = {"text/plain": "plain", "text/markdown": "plain", "text/csv": "csv", "text/html": "html", "message/rfc822": "eml"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def kind_of(path: Column, mime: Column | None = None) -> Column:
    """Parser by mime first, then by extension; null if none."""
    by = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    by_ext = by(KINDS, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))
    return by_ext if mime is None else F.coalesce(by(MIMES, mime), by_ext)


def decode(raw: bytes) -> str:
    for encoding in ("utf-8", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def table(rows: list[list[str]]) -> str:
    """A Markdown table; rows are padded or cut to the header."""
    if not rows:
        return ""
    cell = lambda x: str(x or "").replace("|", "\\|").replace("\n", " ").strip()
    width = len(rows[0])
    lines = ["| " + " | ".join(cell(c) for c in (r + [""] * width)[:width]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Text(HTMLParser):
    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table section article ul ol".split())

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(markup: str) -> str:
    parser = _Text()
    parser.feed(markup)
    parser.close()
    lines = (re.sub(r"[ \t\r\f]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _plain(raw: bytes) -> tuple[str, float]:
    text = decode(raw)[:MAX_CHARS]
    return text, 1.0 if text.strip() else 0.1


def _csv(raw: bytes) -> tuple[str, float]:
    text = decode(raw)[:MAX_CHARS]
    head = text.split("\n", 1)[0]
    sep = max(",;\t|", key=head.count)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if any(c.strip() for c in r)]
    return table(rows), 0.9 if rows else 0.1


def _mail_parts(raw: bytes) -> tuple:
    return email.message_from_bytes(raw, policy=email.policy.default)


def _eml(raw: bytes) -> tuple[str, float]:
    message = _mail_parts(raw)
    body = message.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = html_text(text)
    names = [p.get_filename() for p in message.walk() if p.get_filename() and p.get_content_disposition() != "inline"]
    heads = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if message[h]]
    return "\n".join([*heads, *(f"Attachment: {n}" for n in names), "", text[:MAX_MAIL]]), 1.0 if text.strip() else 0.2


def _unzip(raw: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(raw))
    if sum(i.file_size for i in archive.infolist()) > MAX_UNZIPPED:
        raise ValueError("too large when unpacked")
    return archive


def _docx(raw: bytes) -> tuple[str, float]:
    root = ElementTree.fromstring(_unzip(raw).read("word/document.xml"))
    out = []
    for block in root.iter(f"{_W}body"):
        for node in block:
            if node.tag == f"{_W}p":
                text = "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
                style = node.find(f"{_W}pPr/{_W}pStyle")
                level = re.search(r"(\d)$", style.get(f"{_W}val", "")) if style is not None and "eading" in style.get(f"{_W}val", "") else None
                if text:
                    out.append("#" * int(level[1]) + " " + text if level else text)
            elif node.tag == f"{_W}tbl":
                out.append(table([["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]))
    return "\n\n".join(out), 1.0 if out else 0.1


def longest_run(cells: list[str]) -> tuple[int, int]:
    """Start and length of the longest run of filled cells."""
    best, begin = (0, 0), None
    for i, c in enumerate([*cells, ""]):
        if c and begin is None:
            begin = i
        elif not c and begin is not None:
            best, begin = (max(best, (begin, i - begin), key=lambda b: b[1])), None
    return best


def _cells(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the filled cells of a workbook, numbered from 0, sheet by sheet and in order."""
    archive = _unzip(raw)
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
    names = [s.get("name") for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    for k, name in enumerate(names, 1):
        row = -1
        for r in ElementTree.fromstring(archive.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"):
            row = int(r.get("r", row + 2)) - 1  # rows without cells may be left out
            col = -1
            for c in r.iter(f"{_S}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                col = at - 1 if at else col + 1
                value = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if value is None else value.text or ""
                text = shared[int(text)] if c.get("t") == "s" and text else text
                if text:
                    yield name, row, col, text
        yield name, -1, -1, ""  # an empty sheet has its name


def _xlsx(raw: bytes) -> tuple[str, float]:
    sheets: dict[str, dict[int, dict[int, str]]] = {}
    for name, row, col, text in _cells(raw):
        own = sheets.setdefault(name, {})
        if row >= 0:
            own.setdefault(row, {})[col] = text
    out = []
    for name, rows in sheets.items():
        lines = {i: [cells.get(c, "") for c in range(max(cells) + 1)] for i, cells in sorted(rows.items())}
        head = next((i for i, r in lines.items() if longest_run(r)[1] >= 3), None)
        out.append(f"## Foglio {name}")
        inside: set[tuple[int, int]] = set()
        if head is not None:
            first, n = longest_run(lines[head])
            stop = head
            while stop in lines:
                stop += 1
            pick = lambda i, lines=lines, first=first, n=n: [*lines[i][first : first + n], *[""] * max(0, first + n - max(first, len(lines[i])))]
            shown = range(head + 1, min(stop, head + 1 + MAX_ROWS))
            out.append(table([pick(head), *map(pick, shown)]))
            if len(shown) < stop - head - 1:
                out.append(f"_{stop - head - 1 - len(shown)} righe oltre le prime {MAX_ROWS} non mostrate_")
            inside = {(i, c) for i in range(head, stop) for c in range(first, first + n)}
        out += [f"- {c}" for i, r in lines.items() for k, c in enumerate(r) if c and (i, k) not in inside]
    return "\n\n".join(out), 1.0 if len(out) > len(sheets) else 0.2


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row, col, text, warning) of workbooks (path, content): a row a filled cell, whatever their number; a broken file is one row with a warning."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "row", "col", "text", "warning"]
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                out: list[tuple] = []
                try:
                    for cell in _cells(bytes(raw)):
                        if cell[1] >= 0:
                            out.append((path, *cell, None))
                        if len(out) == 50_000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except Exception as e:
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
                frame_out = pd.DataFrame(out, columns=names)
                yield frame_out.astype({"row": "Int64", "col": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row long, col long, text string, warning string")


_PARSERS = {"plain": _plain, "csv": _csv, "html": lambda raw: (html_text(decode(raw)), 1.0), "eml": _eml, "docx": _docx, "xlsx": _xlsx}


def _run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, kind, raw in zip(frame["path"], frame["kind"], frame["content"], strict=True):
            try:
                text, quality = _PARSERS[kind](bytes(raw))
                out.append((path, kind, text, quality, None))
            except Exception as e:  # a bad file is a row with a warning, never a failed stage
                out.append((path, kind, "", 0.0, f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(out, columns=["path", "kind", "markdown", "quality", "warning"])


def extract(files: DataFrame, mime: str | None = None) -> DataFrame:
    """(path, kind, markdown, quality, warning) of the files that have a parser."""
    known = files.withColumn("kind", kind_of(F.col("path"), F.col(mime) if mime else None)).where("kind IS NOT NULL")
    return known.select("path", "kind", "content").mapInPandas(_run, "path string, kind string, markdown string, quality double, warning string")


def _mails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, raw in zip(frame["path"], frame["content"], strict=True):
            try:
                m = _mail_parts(bytes(raw))
                plain = next((p for p in m.walk() if p.get_content_type() == "text/plain" and not p.get_filename()), None) or next((p for p in m.walk() if p.get_content_type() == "text/html"), None)
                body = plain.get_content() if plain is not None else ""
                when = parsedate_to_datetime(str(m["Date"])).timestamp() if m["Date"] else 0.0
                files = [{"idx": i, "name": p.get_filename(), "mime": p.get_content_type(), "size": len(p.get_payload(decode=True) or b"")} for i, p in enumerate(m.walk()) if p.get_filename()]
                to = [a.lower() for _, a in getaddresses(m.get_all("To", []))]
                out.append((path, str(m["Message-ID"] or path), str(m["From"] or ""), to, str(m["Subject"] or ""), when, body[:500], files, None))
            except Exception as e:  # kept as a row, so that the mailbox is whole
                out.append((path, path, "", [], "", 0.0, "", [], f"{type(e).__name__}: {e}"[:300]))
        yield pd.DataFrame(out, columns=["path", "message_id", "sender", "to", "subject", "when_s", "snippet", "attachments", "warning"])


MAIL_SCHEMA = "path string, message_id string, sender string, to array<string>, subject string, when_s double, snippet string, attachments array<struct<idx:int,name:string,mime:string,size:long>>, warning string"


def mailbox(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_mails, MAIL_SCHEMA)


def attachments(mails: DataFrame) -> DataFrame:
    """One inventory row an attachment: its id is the message's and its place among the parts."""
    one = mails.select("message_id", "when_s", F.explode("attachments").alias("a"))
    return one.select(F.lit("email-attachment").alias("source"), F.format_string("%s#att%d", "message_id", "a.idx").alias("source_id"), F.col("a.name").alias("name"), F.col("a.mime").alias("mime"), F.col("a.size").alias("size"), F.timestamp_seconds("when_s").alias("mtime"))


def html_to_text(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Adds the text of an HTML column, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(markup: pd.Series) -> pd.Series:
        return markup.map(html_text, na_action="ignore")

    return pages.withColumn(out, run(F.col(column)))
