"""String functions on columns: slugs, names, paths, dates, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierflow.functions.tokens import FOLDER_TYPES, LEGAL_FORMS

#: Accented Latin letters and what is left of them in ASCII.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Patterns of copies and versions in file stems, in order of trial.
COPY_PATTERNS = (
    r"(?i)^(.+?)[\s_-]*(?:copia(?:\s+di)?|copy(?:\s+of)?)(?:[\s_-]*\(?(\d+)\)?)?$",
    r"(?i)^copia\s+di\s+(.+)$",
    r"(?i)^(.+?)[\s_-]*v(\d+)$",
    r"(?i)^(.+?)[\s_-]+(?:final|finale|definitivo|def)$",
    r"(?i)^(.+?)[\s_-]*\((\d+)\)$",
)
#: Personal data, most specific kind first.
PERSONAL = (
    ("iban", r"(?i)\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9][ ]?){11,30}\b"),
    ("cf", r"(?i)\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z][A-Z0-9]{3}[A-Z]\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"(?:(?<!\d)\+?39[ \-./]?)?(?<!\d)\d{2,4}[ \-./]\d{2,4}[ \-./]?\d{2,5}(?!\d)"),
)


def contains_any(col: Column, tokens: tuple[str, ...]) -> Column:
    """One alternation of quoted tokens instead of a chain of tests."""
    return col.rlike("|".join(r"\Q" + t + r"\E" for t in tokens))


def slugify(col: Column, empty: str = "ignoto") -> Column:
    ascii_only = F.regexp_replace(F.translate(col, _ACCENTED, _BARE), r"[^\x00-\x7F]", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", empty).otherwise(slug)


def stem(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.contains(flat, F.lit("/")), F.regexp_extract(flat, "(?s)^(.*)/[^/]*$", 1)).otherwise("")


def _trim_marks(col: Column) -> Column:
    return F.regexp_replace(col, "^[ _-]+|[ _-]+$", "")


def base_passes(names: Column, passes: int = 5) -> Column:
    """struct(base, matched): up to `passes` times the first pattern that shortens the stem is applied.

    A fold over a short array keeps one copy of the step in the plan.
    """

    def step(acc: Column, _: Column) -> Column:
        was = acc["base"]
        tries = [_trim_marks(F.regexp_extract(was, p, 1)) for p in COPY_PATTERNS]
        fits = [was.rlike(p) & (t != "") & (t != was) for p, t in zip(COPY_PATTERNS, tries, strict=True)]
        found = reduce(lambda rest, ft: F.when(ft[0], ft[1]).otherwise(rest), reversed(list(zip(fits, tries, strict=True))), was)
        return F.struct(found.alias("base"), (acc["matched"] | (found != was)).alias("matched"))

    start = F.struct(F.trim(stem(names)).alias("base"), F.lit(False).alias("matched"))
    return F.aggregate(F.array_repeat(F.lit(0), passes), start, step, lambda acc: F.struct(_trim_marks(F.lower(acc["base"])).alias("base"), acc["matched"].alias("matched")))


def normalize_name(col: Column) -> Column:
    low = F.lower(F.trim(col))
    cut = low
    for form in reversed(LEGAL_FORMS):
        cut = F.when(F.endswith(low, F.lit(form)), F.substring(low, F.lit(1), F.char_length(low) - len(form))).otherwise(cut)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def type_from_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(None).cast("string")
    for token, kind in reversed(FOLDER_TYPES.items()):
        out = F.when(F.contains(low, F.lit(f"/{token}")) | F.startswith(low, F.lit(f"{token}/")), kind).otherwise(out)
    return out


def object_folder(path: Column) -> Column:
    """struct(tipo, child) of the first path component that is a known folder with a child not starting with _."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kinds = F.create_map(*[F.lit(x) for kv in FOLDER_TYPES.items() for x in kv])
    pairs = F.transform(parts, lambda p, i: F.struct(F.try_element_at(kinds, F.lower(p)).alias("tipo"), F.get(parts, i + 1).alias("child")))
    return F.get(F.filter(pairs, lambda p: p["tipo"].isNotNull() & (p["child"] != "") & ~F.startswith(p["child"], F.lit("_"))), F.lit(0))


def sender_domain(sender: Column) -> Column:
    found = F.lower(F.regexp_extract(sender, r"@([\w.-]+)", 1))
    return F.when(found != "", found)


def age_days(mtime: Column, now: Column) -> Column:
    """Whole days of 24 hours since mtime, not below 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_timestamp(now) - F.unix_timestamp(mtime)) / 86400))


def _tag(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def personal_values(text: Column, kinds: tuple[str, ...] = ("iban", "cf", "email", "phone")) -> Column:
    """array<struct<kind,value>> of personal data, in the order of redaction: what one kind takes is gone for the next."""
    rest, found = text, []
    for kind, pattern in PERSONAL:
        if kind in kinds:
            found.append(F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), _tag(kind)))
            rest = F.regexp_replace(rest, pattern, "<>")
    return F.concat(*found)


def holds_personal(text: Column, kinds: tuple[str, ...] = ("iban", "cf", "email", "phone")) -> Column:
    """Whether there may be personal data: a superset of the texts with personal_values, by one pass."""
    return text.rlike("|".join(f"(?:{p})" for kind, p in PERSONAL if kind in kinds))


def coerce_scalar(col: Column) -> Column:
    """struct(kind, value): yes/true, no/false, float with a point, int, else text."""
    low = F.lower(F.trim(col))
    kind = (
        F.when(low.isin("true", "yes", "false", "no"), "bool")
        .when(low.rlike(r"^[+-]?\d+$"), "int")
        .when(low.rlike(r"^[+-]?\d*\.\d+$|^[+-]?\d+\.\d*$"), "float")
        .otherwise("str")
    )
    value = F.when(low.isin("true", "yes"), "true").when(low.isin("false", "no"), "false").otherwise(F.trim(col))
    return F.struct(kind.alias("kind"), value.alias("value"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(text) / 4))


def front_matter(text: Column) -> Column:
    """map<string,string> of the `key: value` lines between the leading rules; empty without them."""
    block = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^\s#][^:]*:"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(first)


def ordered_union(a: Column, b: Column) -> Column:
    """Elements of both lists, each once, in order of first appearance."""
    return F.array_distinct(F.concat(a, b))


#: Types of the file families that are read.
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".txt": "text/plain", ".csv": "text/csv", ".md": "text/markdown",
    ".html": "text/html", ".eml": "message/rfc822", ".json": "application/json", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
}


def mime_of(name: Column) -> Column:
    """Type by extension; null for others, which the leading bytes may tell."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), extension(name))


#: Types by leading bytes, for names that tell none.
HEADS = (("25504446", "application/pdf"), ("504B0304", "application/zip"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"))


def mime_with_head(name: Column, head: Column) -> Column:
    """Type by extension, else by the leading bytes, else null."""
    by_head = F.lit(None).cast("string")
    for sign, mime in reversed(HEADS):
        by_head = F.when(F.startswith(F.hex(head), F.lit(sign)), mime).otherwise(by_head)
    return F.coalesce(mime_of(name), by_head)


def safe_name(name: Column) -> Column:
    """Runs of anything but ASCII letters, digits and ._- as one _ (attachments)."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def safe_part(name: Column, spaces: bool = False) -> Column:
    """Each character but letters and digits of any script and ._- as _ (messages); with spaces kept inside, `unnamed` if nothing is left (services)."""
    if not spaces:
        return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")
    kept = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}._ -]", "_"))
    return F.when(kept == "", "unnamed").otherwise(kept)


def safe_id(value: Column) -> Column:
    """Each character but word characters and - as _; `noid` for an empty id (item files of services)."""
    kept = F.regexp_replace(value.cast("string"), r"[^\p{L}\p{N}_-]", "_")
    return F.when(kept == "", "noid").otherwise(kept)


def first_mark(content: Column) -> Column:
    """The first 128 bits of SHA-1 over the first MiB, in hex: tells changes in a manifest."""
    return F.substring(F.sha1(F.substring(content, 1, 1 << 20)), 1, 32)


def letter_mark(content: Column, path: Column) -> Column:
    """Twelve digits of SHA-256 over the first 256 KiB and the path: names a dead letter."""
    return F.substring(F.sha2(F.concat(F.substring(content, 1, 256 << 10), F.encode(path, "UTF-8")), 256), 1, 12)


def domain_slug(domain: Column) -> Column:
    """Slug of a domain without what follows its first dot."""
    return slugify(F.split_part(F.lower(domain), F.lit("."), F.lit(1)), empty="dominio")


def project_slug(name: Column) -> Column:
    """Slug without a fold of accents: letters outside ASCII part words. Null where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.nullif(slug, F.lit(""))


def year_of(date: Column) -> Column:
    """The first four digits of a date as text, or a word for none."""
    return F.when(date.rlike(r"^\d{4}"), F.substring(date, 1, 4)).otherwise("unknown")
