"""Predicates over inventory records, drafts, mails and runs."""

from __future__ import annotations

import os
from fnmatch import translate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading bytes of file families, and which extensions promise which.
SIGNATURES = {"pdf": "25504446", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF"}
PROMISES = {".pdf": "pdf", ".docx": "zip", ".xlsx": "zip", ".pptx": "zip", ".doc": "ole", ".xls": "ole", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg"}
#: Folders too wide to be scanned as a whole.
WIDE_ROOTS = ("/", "/Users", "/home", "/etc", "/var", "/private", "/tmp", "/usr", "/bin", "/sbin", "/opt", "/System", "/Library", "C:\\", "C:\\Users")
LIBRARY_CHILDREN = ("Caches", "Logs", "Application Support", "Containers", "Developer")


def _glob(pattern: str) -> str:
    """A shell pattern as a Java regular expression over the whole string."""
    body = translate(pattern)
    body = body.replace("(?>", "(?:").removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
    return f"(?s)^(?:{body})$"


def perimeter(max_mb: int = 100, suffixes: tuple[str, ...] = (), excludes: tuple[str, ...] = (), includes: tuple[str, ...] = ()) -> Column:
    keep = F.col("size") <= max_mb * 1024 * 1024
    for s in suffixes:
        keep &= ~F.endswith(F.lower("name"), F.lit(s.lower()))
    for s in excludes:
        keep &= ~F.contains("path", F.lit(s))
    if includes:
        some = F.lit(False)
        for s in includes:
            some |= F.contains("path", F.lit(s))
        keep &= some
    return keep


def glob_excluded(patterns: tuple[str, ...]) -> Column:
    return F.col("path").rlike("|".join(_glob(p) for p in patterns))


def any_component(patterns: tuple[str, ...]) -> Column:
    regex = "|".join(_glob(p) for p in patterns)
    return F.exists(F.split("path", "/"), lambda c: c.rlike(regex))


def library_component() -> Column:
    return F.col("path").rlike("(^|/)Library/(" + "|".join(LIBRARY_CHILDREN) + ")(/|$)")


def skip_reason(max_bytes: int, extensions: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    """The first reason in order for which a file is skipped, null if none."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return F.when(any_component(patterns), "excluded").when(library_component(), "library").when(F.col("size") > max_bytes, "size").when(~ext.isin(*extensions), "extension")


def magic_veto(head: Column, ext: Column) -> Column:
    """True if the extension promises a family that the leading bytes do not have."""
    promised = F.try_element_at(F.create_map(*[F.lit(x) for e, f in PROMISES.items() for x in (e, SIGNATURES[f])]), ext)
    return promised.isNotNull() & ~F.startswith(F.hex(head), promised)


def noisy_mail(mails: DataFrame, min_chars: int) -> Column:
    return (F.col("n_attachments") == 0) & (F.char_length(F.substring("body", 1, 500)) < min_chars)


def optional_equal(rows: DataFrame, **values: str | None) -> DataFrame:
    for column, value in values.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def interrupted(cutoff: int) -> Column:
    beat, start = F.col("heartbeat_s"), F.col("start_s")
    return (F.col("status") == "running") & ((beat.isNotNull() & (beat < cutoff)) | (beat.isNull() & (start < cutoff)))


def editor_temp() -> Column:
    return F.startswith("name", F.lit(".")) | F.endswith("name", F.lit("~")) | F.endswith("name", F.lit(".swp"))


def search(pages: DataFrame, term: str, limit: int, path: str = "path", text: str = "text", around: int = 80) -> DataFrame:
    """Literal search without case: occurrences and a snippet; the first `limit` hits in path order."""
    low = F.lower(F.col(text))
    place = F.instr(low, F.lit(term.lower()))
    hits = pages.where(F.contains(low, F.lit(term.lower())))
    count = ((F.char_length(low) - F.char_length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("long")
    start = F.greatest(place - around, F.lit(1))
    snippet = F.substring(F.col(text), start, place + len(term) + around - start)
    return hits.select(path, count.alias("n"), snippet.alias("snippet")).orderBy(path).limit(limit)


def guard_root(root: str, force: bool = False) -> str:
    """The root without dots and doubled slashes; one that is too wide, the home folder included, is refused unless forced."""
    plain = os.path.normpath(root)
    if not force and plain in (*WIDE_ROOTS, os.path.expanduser("~")):
        raise ValueError(f"root {plain} is too wide: name a folder below it, or force it")
    return plain


def leaves_root(path: Column, root: str) -> Column:
    """Whether a path, its .. and . taken away, lies outside the root. Links are to be resolved by whoever lists the files."""
    empty = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    parts = F.aggregate(F.split(path, "/"), empty, lambda acc, p: F.when(p == "..", up(acc)).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p))))
    plain = F.concat(F.lit("/"), F.array_join(parts, "/"))
    top = os.path.normpath(root).rstrip("/")
    return ~((plain == (top or "/")) | F.startswith(plain, F.lit(top + "/")))
