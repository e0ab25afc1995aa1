"""Review of entities: merges with what is there, previews, validation, line classes of a draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.operators.dedup import ordinals

#: Longest text that is a scalar, and longest preview of a structure.
NARRATIVE_FROM, PREVIEW = 80, 80
#: Folders of the types that have one note each.
TARGETS = {
    "scheda-cliente": "vault/clienti/{0}/{0}.md",
    "scheda-fornitore": "vault/fornitori/{0}/{0}.md",
    "scheda-commessa": "vault/commesse/{0}/{0}.md",
    "decisione": "vault/decisioni/{0}.md",
    "persona": "vault/references/persone.md",
}
#: Areas whose notes need a type.
AREAS = ("clienti", "fornitori", "commesse", "reparti", "decisioni", "references")


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


# ---------------------------------------------------------------- merges


def merge_text(old: Column, new: Column, day: str) -> Column:
    """Of two texts under one key: the new one if both are short, else the new one behind the old unless contained."""
    long = F.contains(old, F.lit("\n")) | F.contains(new, F.lit("\n")) | (F.char_length(old) > NARRATIVE_FROM) | (F.char_length(new) > NARRATIVE_FROM)
    appended = F.concat(old, F.lit(f"\n\n— aggiornamento {day} —\n"), new)
    return F.when(old.isNull(), new).when(new.isNull() | (old == new), old).when(~long, new).when(F.contains(old, new), old).otherwise(appended)


def merge_maps(old: Column, new: Column, day: str) -> Column:
    """Union of the keys of two maps of texts. A null map counts as empty, a null text as an absent key."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda _, a, b: merge_text(a, b, day))


def merge_lists(old: Column, new: Column) -> Column:
    """Both lists one after the other, each value where it comes first."""
    return F.array_distinct(F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.concat(old, new)))


def merge_confident(a: Column, a_conf: Column, b: Column, b_conf: Column) -> Column:
    """Union of the keys of two maps; under one key the filled value, of two the one of higher confidence, ties the first."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", y).when(F.trim(F.coalesce(y, F.lit(""))) == "", x).when(a_conf >= b_conf, x).otherwise(y))


def merge_body(old: Column, new: Column, day: str) -> Column:
    appended = F.concat(F.regexp_replace(old, r"\s+$", ""), F.lit(f"\n\n---\n*Aggiornamento {day}*\n\n"), F.regexp_replace(new, r"^\s+", ""))
    return F.when((_strip(new) == "") | (_strip(old) == _strip(new)), old).otherwise(appended)


def merged_edits(stored: DataFrame, candidates: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, fields, body, status: what the reviewer's merge stores. Fields are joined, the body is the candidate's."""
    new = candidates.select(*keys, F.col("fields").alias("_fields"), F.col("body").alias("_body"))
    return stored.join(new, keys).select(*keys, merge_maps(F.col("fields"), F.col("_fields"), day).alias("fields"), F.col("_body").alias("body"), F.lit("edited").alias("status"))


# ---------------------------------------------------------------- previews and paths


def preview(value: Column) -> Column:
    """A text in one line: its first one and how many there are; a sign for null."""
    lines = F.split(F.regexp_replace(value, r"\n$", ""), "\n")
    many = F.concat(F.get(lines, F.lit(0)), F.lit(" ⏎ ("), F.size(lines).cast("string"), F.lit(" righe)"))
    return F.when(value.isNull(), "∅").when(F.contains(value, F.lit("\n")), many).otherwise(value)


def preview_structure(rendered: Column) -> Column:
    return F.when(F.char_length(rendered) > PREVIEW, F.concat(F.substring(rendered, 1, PREVIEW - 3), F.lit("..."))).otherwise(rendered)


def target_path(kind: Column, slug: Column) -> Column:
    """Path of a note in the vault; null for other types and where type or slug is missing."""
    t, s = F.lower(_strip(kind)), _strip(slug)
    out = F.lit(None).cast("string")
    for name, form in TARGETS.items():
        out = F.when(t == name, F.replace(F.lit(form), F.lit("{0}"), s)).otherwise(out)
    return F.when((F.coalesce(kind, F.lit("")) != "") & (F.coalesce(slug, F.lit("")) != ""), out)


def within_vault(target: Column) -> Column:
    return F.regexp_replace(target, "^vault/", "")


def unique_targets(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """`target` made free: a taken one gets the least -1, -2, ... that neither `existing` nor a row has.

    Rows of one target are numbered in order, the first keeping a free target. Of the numbers that are taken, u0 < u1 < ...,
    u - i free ones lie below the i-th, so a row with n rows before it gets n plus the count of those with u - i <= n.
    All three counts run over range partitions, whatever the number of rows of a target.
    """
    form = r"^(.*?)(?:-(\d+))?(\.[^./]*)$"
    base = F.concat(F.regexp_extract("target", form, 1), F.regexp_extract("target", form, 3))
    numbered = existing.select("target").unionByName(rows.select("target")).select(base.alias("target"), F.regexp_extract("target", form, 2).try_cast("long").alias("k"))
    plain = existing.select("target", F.lit(0).cast("long").alias("k"))
    # Numbers of other targets are of no use.
    used = plain.unionByName(numbered.where("k IS NOT NULL")).distinct().join(rows.select("target").distinct(), "target", "left_semi")
    placed = _ranks(rows, ["target", order], "_nth")
    below = _ranks(used, ["target", "k"], "_i").select("target", (F.col("k") - F.col("_i")).alias("_n"), F.lit(0).alias("_row"), "k")
    asked = placed.select("target", F.col("_nth").alias("_n"), F.lit(1).alias("_row"), F.lit(None).cast("long").alias("k"))
    counted = _ranks(below.unionByName(asked), ["target", "_n", "_row", "k"], "_all").where("_row = 1").select("target", F.col("_n").alias("_nth"), F.col("_all").alias("k"))
    joined = placed.join(counted, ["target", "_nth"], "left")
    k = F.col("k")
    renamed = F.regexp_replace("target", r"(\.[^./]*)$", F.concat(F.lit("-"), k.cast("string"), F.lit("$1")))
    return joined.withColumn("target", F.when(k == 0, F.col("target")).otherwise(renamed)).select(*rows.columns)


def _ranks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds 0, 1, 2 ... among the rows of one target (the first key) in the order of `keys`."""
    counted = ordinals(rows, keys, name)
    first = counted.groupBy("target").agg(F.min(name).alias("_first"))
    return counted.join(first, "target", "left").withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def orphans(notes: DataFrame) -> DataFrame:
    """Notes (path below the vault, kind) in the areas that have no type, templates apart."""
    parts = F.split("path", "/")
    kept = F.get(parts, F.lit(0)).isin(*AREAS) & F.endswith("path", F.lit(".md")) & ~F.exists(parts, lambda p: F.startswith(p, F.lit("_esempio")))
    return notes.where(kept & F.col("kind").isNull())


# ---------------------------------------------------------------- validation


def json_kind(document: Column, field: str) -> Column:
    """Kind of a field of a JSON text: boolean, integer, number, string, array, object or null; null if it is absent."""
    return _kind(F.try_parse_json(document), field)


def _kind(parsed: Column, field: str) -> Column:
    """The same of a parsed document. The schema's first word tells the kind, so that it is worked out once."""
    kinds = (("BOOLEAN", "boolean"), ("BIGINT", "integer"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("STRING", "string"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null"))
    word = F.regexp_extract(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")), "^[A-Z]+", 0)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds for x in kv]), word)


def infer_kinds(samples: DataFrame, document: str, fields: list[str]) -> DataFrame:
    """(field, kind, nullable): kinds seen in the samples; tipo and nome must be there, all others may be null."""
    seen = samples.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), json_kind(F.col(document), f).alias("kind")) for f in fields])).alias("f")).select("f.*")
    return seen.where("kind IS NOT NULL AND kind <> 'null'").distinct().withColumn("nullable", ~F.col("field").isin("tipo", "nome"))


def validation_errors(document: Column, rules: dict[str, str], required: tuple[str, ...] = ("tipo", "nome")) -> Column:
    """Errors in the order of fields: `field: missing` and `field: expected kind, found kind`; empty if it is valid.

    An integer is a number too; a null passes unless the field is required.
    """
    fields = sorted({*rules, *required})

    def checked(parsed: Column) -> Column:
        rows = [F.struct(F.lit(f).alias("field"), F.lit(rules.get(f)).cast("string").alias("asked"), F.lit(f in required).alias("must"), _kind(parsed, f).alias("kind")) for f in fields]
        return F.array_compact(F.transform(F.array(*rows), error))

    def error(e: Column) -> Column:
        kind, asked = e["kind"], e["asked"]
        fits = (kind == asked) | ((kind == "integer") & (asked == "number")) | ((kind == "null") & ~e["must"])
        wrong = F.concat(e["field"], F.lit(": expected "), asked, F.lit(", found "), kind)
        return F.when(kind.isNull() & e["must"], F.concat(e["field"], F.lit(": missing"))).when(kind.isNotNull() & asked.isNotNull() & ~fits, wrong)

    # As a variable of a lambda the document is parsed once, and so is each kind.
    return F.get(F.transform(F.array(F.try_parse_json(document)), checked), F.lit(0))


def relabelled(partials: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Partial candidates of one entity take the slug of the first, whatever their own; `diverged` marks changed ones."""
    first = partials.groupBy(*keys).agg(F.min_by("slug", order).alias("_first"))
    return partials.join(first, keys).withColumns({"diverged": ~F.col("slug").eqNullSafe(F.col("_first")), "slug": F.col("_first")}).drop("_first")


def penalised(confidence: Column, errors: Column) -> Column:
    return F.when(F.size(errors) > 0, F.least(confidence, F.lit(0.5))).otherwise(confidence)


# ---------------------------------------------------------------- lines of a draft


def escape_html(col: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(sign), F.lit(name))
    return col


def draft_lines(drafts: DataFrame, key: str, text: str, generated: Column) -> DataFrame:
    """(key, line, escaped, css): class names of each line of a draft.

    Rule lines and what lies between the first two are front matter, with warnings marked; in the body TODO, WARNING
    and the generated section. The section's state is that of the last heading; `generated` is its state before any.
    """
    lines = drafts.select(key, generated.alias("_from"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s, low = F.col("s"), F.lower("s")
    marked = lines.withColumn("s", _strip(F.col("raw"))).withColumn("rules", F.count_if(s == "---").over(so_far))
    rule, front = s == "---", F.col("rules") == 1
    body = ~rule & ~front
    warns = F.when(front & F.startswith(s, F.lit("warnings:")), True).when(front & ~rule & ~F.startswith(s, F.lit("- ")), False)
    heads = F.when(body & F.startswith(low, F.lit("## generato")), True).when(body & F.startswith(s, F.lit("## ")), False)
    state = marked.withColumns({"_warn": warns, "_head": heads}).withColumns({
        "warning": F.coalesce(F.last("_warn", ignorenulls=True).over(so_far), F.lit(False)),
        "inside": F.coalesce(F.last("_head", ignorenulls=True).over(so_far), F.col("_from"), F.lit(False)),
    })
    upper = F.upper("raw")
    tags = F.array_compact(F.array(
        F.when(F.contains(upper, F.lit("TODO")), "todo-marker"),
        F.when(F.contains(upper, F.lit("WARNING")), "warning-marker"),
        F.when(F.col("inside"), "generated"),
        F.when(F.col("_head"), "section-header"),
    ))
    css = F.when(rule, "fm-marker").when(front & F.col("warning"), "warning-marker").when(front, "fm-line").otherwise(F.array_join(tags, " "))
    return state.select(key, "line", escape_html(F.col("raw")).alias("escaped"), css.alias("css"))
