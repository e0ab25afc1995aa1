"""Documents with maps in maps and lists, as rows of paths: flatten, merge or check by path, put together again.

A document is a JSON text. `leaves` opens its maps level by level with VARIANT, so a field however deep is a row with its
path; rows of all documents join, group and fold like any others, and `assembled` writes each document's rows, which are
its own fields and no more, back as one JSON text. Maps have no order of keys here: they come back sorted by key.

Defined cases: text that is no JSON, and null, has no row and comes back as null; an empty map is a value like others;
a null is a value; lists are values in `leaves` and opened by `nodes`; keys may hold any character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.operators.review import merge_text
from dossierflow.session import settled

#: Keys whose texts are joined, whatever their confidence, and what stands between them.
LONG_FORM, LONG_FORM_SEPARATOR = ("note", "note_relazionali", "storia"), "\n\n---\n\n"


def kind(value: Column) -> Column:
    """boolean, integer, number, string, array, object or null."""
    found = F.schema_of_variant(value)
    names = (("BOOLEAN", "boolean"), ("BIGINT", "integer"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null"))
    out = F.lit("string")
    for prefix, name in names:
        out = F.when(F.startswith(found, F.lit(prefix)), name).otherwise(out)
    return out


def _opened(docs: DataFrame, keys: list[str], document: str, lists: bool) -> DataFrame:
    """keys, path, value, kind of every node; maps, and lists if asked for, are opened level by level until none is left."""
    spark = docs.sparkSession
    level = docs.select(*keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(document).alias("value")).where("value IS NOT NULL")
    level = settled(level.withColumn("kind", kind(F.col("value"))))
    every = level
    while True:
        holders = level.where(F.col("kind").isin("object", "array") if lists else F.col("kind") == "object")
        inner = holders.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "child"))
        # A place in a list sorts as a number.
        name = F.coalesce("key", F.lpad(F.col("pos").cast("string"), 10, "0"))
        level = settled(inner.select(*keys, F.concat("path", F.array(name)).alias("path"), F.col("child").alias("value")).withColumn("kind", kind(F.col("value"))))
        if level.isEmpty():
            return every
        every = every.unionByName(level)


def nodes(docs: DataFrame, keys: list[str], document: str) -> DataFrame:
    """keys, path, value (VARIANT), kind of every map, list and scalar. The document itself has the empty path."""
    return _opened(docs, keys, document, lists=True)


def leaves(docs: DataFrame, keys: list[str], document: str) -> DataFrame:
    """keys, path, json, kind of every value that is no map, and of empty maps."""
    rows = _opened(docs, keys, document, lists=False)
    return rows.where((F.col("kind") != "object") | (F.to_json("value") == "{}")).select(*keys, "path", F.to_json("value").alias("json"), "kind")


def _quoted(text: Column) -> Column:
    """A JSON string. What a one-field map writes, less its braces and name."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("k"))), r'(?s)^\{"k":(.*)\}$', "$1")


def assembled(rows: DataFrame, keys: list[str], out: str = "document") -> DataFrame:
    """keys, `out`: the JSON text of each document's leaves."""
    own = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("path"), F.col("json"), F.transform("path", _quoted).alias("q")))).alias("leaves"))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("at"))

    def add(acc: Column, leaf: Column) -> Column:
        shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(acc["at"]), F.size(leaf["path"])) - 1), lambda i: (i >= 0) & (F.slice(acc["at"], 1, i + 1) == F.slice(leaf["path"], 1, i + 1))))
        first = F.size(acc["at"]) == 0
        closing = F.when(first, "{").otherwise(F.concat(F.repeat(F.lit("}"), F.size(acc["at"]) - 1 - shared), F.lit(",")))
        opening = F.array_join(F.slice(leaf["q"], shared + 1, F.size(leaf["q"]) - shared), ":{")
        return F.struct(F.concat(acc["text"], closing, opening, F.lit(":"), leaf["json"]).alias("text"), leaf["path"].alias("at"))

    folded = F.aggregate("leaves", start, add, lambda acc: F.concat(acc["text"], F.repeat(F.lit("}"), F.size(acc["at"]))))
    whole = F.when(F.size(F.get("leaves", F.lit(0))["path"]) == 0, F.get("leaves", F.lit(0))["json"]).otherwise(folded)
    return own.select(*keys, whole.alias(out))


# ---------------------------------------------------------------- merges


def _strings(json: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")


def _elements(json: Column) -> Column:
    """The elements of a JSON list, each as JSON, with one form for equal values."""
    return F.transform(F.try_parse_json(json).cast("array<variant>"), lambda v: F.to_json(v))


def _union(old: Column, new: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_distinct(F.concat(_elements(old), _elements(new))), ","), F.lit("]"))


def merge_documents(old: DataFrame, new: DataFrame, keys: list[str], document: str, day: str) -> DataFrame:
    """keys, document: the stored document with the candidate's fields. A document that only one side has stays as it is.

    Maps merge by key however deep; lists become their union, each value where it comes first; of two texts the
    candidate's if both are short, else it is put behind the stored one unless contained; in all else (numbers, a map
    against a text) the candidate wins with all that is below it.
    """
    a = leaves(old, keys, document).select(*keys, "path", F.col("json").alias("a"), F.col("kind").alias("ka"))
    b = leaves(new, keys, document).select(*keys, "path", F.col("json").alias("b"), F.col("kind").alias("kb"))
    both = settled(a.join(b, [*keys, "path"], "full"))
    # A value on one side where the other has a map: the candidate's side stands, the other's rows below or at it go.
    above = lambda col: F.transform(F.sequence(F.lit(0), F.size(col) - 1), lambda n: F.slice(col, 1, n))
    upper = lambda side: both.where(F.col(side).isNotNull() & (F.size("path") > 0)).select(*keys, F.explode(above(F.col("path"))).alias("path")).distinct()
    maps_new, maps_old = upper("b").withColumn("_map_b", F.lit(True)), upper("a").withColumn("_map_a", F.lit(True))
    values_new = maps_old.join(both.where("b IS NOT NULL AND kb <> 'object'").select(*keys, "path"), [*keys, "path"]).select(*keys, F.col("path").alias("_top"))
    gone = both.where("a IS NOT NULL AND b IS NULL").join(values_new, keys).where(F.slice("path", 1, F.size("_top")) == F.col("_top")).select(*keys, "path").distinct()
    kept = both.join(gone, [*keys, "path"], "left_anti").join(maps_new, [*keys, "path"], "left").join(maps_old, [*keys, "path"], "left")
    text = merge_text(_strings(F.col("a")), _strings(F.col("b")), day)
    value = (
        F.when(F.col("_map_b") & F.col("b").isNull(), None)  # an old value, or empty map, where the candidate has a map
        .when(F.col("_map_a") & (F.col("kb") == "object") & F.col("a").isNull(), None)  # an empty map of the candidate where there is a full one
        .when(F.col("b").isNull(), F.col("a"))
        .when(F.col("a").isNull(), F.col("b"))
        .when((F.col("ka") == "array") & (F.col("kb") == "array"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(_union(F.col("a"), F.col("b"))))
        .when((F.col("ka") == "string") & (F.col("kb") == "string"), _quoted(text))
        .otherwise(F.col("b"))
    )
    return assembled(kept.select(*keys, "path", value.alias("json")).where("json IS NOT NULL"), keys, document)


def merge_confident(candidates: DataFrame, keys: list[str], order: str, document: str, confidence: str) -> DataFrame:
    """keys, document, confidence, n: all candidates of an entity in one, folded in order, map by map.

    Under one path the filled value stands; of two texts or numbers that of higher confidence, ties the earlier, where
    the confidence so far is the running mean of pairs; lists become their union in order; long forms are joined. Where
    a path is a map in one candidate and a value in another, the map stands. Repeated orders are taken by content.
    """
    by = Window.partitionBy(*keys).orderBy(order, document)
    numbered = settled(candidates.select(*keys, document, F.col(confidence).cast("double").alias("conf"), F.row_number().over(by).alias("k")))
    # The mean so far before each candidate: of one entity's candidates, a few numbers each.
    pairs = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "conf"))).alias("c"))
    running = F.aggregate("c", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x["conf"]).otherwise((F.element_at(acc, -1) + x["conf"]) / 2))))
    means = pairs.select(*keys, running.alias("means"))
    rows = leaves(numbered.select(*keys, "k", "conf", document), [*keys, "k", "conf"], document)
    rows = rows.where(~F.col("json").isin("null", '""', "[]", "{}") & ~F.col("json").rlike(r'^"(\\s|\\[ntr])*"$'))
    own = rows.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(F.struct("k", "conf", "json", "kind"))).alias("v")).join(means, keys)
    name = F.element_at("path", -1)
    start = F.get("v", F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        earlier = F.element_at("means", x["k"] - 1) >= x["conf"]
        joined = F.when(F.contains(_strings(acc["json"]), _strings(x["json"])) & (_strings(acc["json"]) == _strings(x["json"])), acc["json"]).otherwise(_quoted(F.concat(F.trim(_strings(acc["json"])), F.lit(LONG_FORM_SEPARATOR), F.trim(_strings(x["json"])))))
        value = (
            F.when((acc["kind"] == "array") & (x["kind"] == "array"), _union(acc["json"], x["json"]))
            .when(name.isin(*LONG_FORM) & (acc["kind"] == "string") & (x["kind"] == "string"), joined)
            .when(earlier, acc["json"])
            .otherwise(x["json"])
        )
        return F.struct(x["k"].alias("k"), x["conf"].alias("conf"), value.alias("json"), F.when((acc["kind"] != x["kind"]) & ~earlier, x["kind"]).otherwise(acc["kind"]).alias("kind"))

    value = F.aggregate(F.slice("v", 2, F.size("v")), start, add, lambda acc: acc["json"])
    merged = settled(own.select(*keys, "path", value.alias("json")))
    above = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", 1, n))
    maps = merged.where(F.size("path") > 0).select(*keys, F.explode(above).alias("path")).distinct()
    whole = assembled(merged.join(maps, [*keys, "path"], "left_anti"), keys, document)
    totals = means.select(*keys, F.element_at("means", -1).alias(confidence), F.size("means").alias("n"))
    return totals.join(whole, keys, "left").select(*keys, F.coalesce(document, F.lit("{}")).alias(document), confidence, "n")


# ---------------------------------------------------------------- validation


def _rule_path(path: Column, kinds: Column) -> Column:
    """The path with every place in a list as []; `kinds` has the kind of the holder of each step."""
    return F.array_join(F.transform(path, lambda p, i: F.when(F.get(kinds, i) == "array", "[]").otherwise(F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))), "/")


def _ruled(docs: DataFrame, keys: list[str], document: str) -> DataFrame:
    """keys, path, rule, kind, whole (a number without a fraction)."""
    rows = nodes(docs, keys, document)
    holders = rows.where(F.col("kind").isin("array", "object")).select(*keys, F.col("path").alias("_holder"), F.col("kind").alias("_kind"))
    steps = rows.where(F.size("path") > 0).select(*keys, "path", "kind", F.to_json("value").alias("json"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("_n", "_holder"))
    held = steps.join(holders, [*keys, "_holder"]).groupBy(*keys, "path", "kind", "json").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_kind"))), lambda s: s["_kind"]).alias("_kinds"))
    whole = (F.col("kind") == "integer") | ((F.col("kind") == "number") & (F.floor(F.expr("try_cast(json AS DOUBLE)")) == F.expr("try_cast(json AS DOUBLE)")))
    return held.select(*keys, "path", _rule_path(F.col("path"), F.col("_kinds")).alias("rule"), "kind", whole.alias("whole"))


def infer_rules(sample: DataFrame, document: str) -> DataFrame:
    """(rule, kind, required): what the one canonical document of a type asks for; of a list its first element counts."""
    one = sample.select(F.lit(1).alias("_one"), document)
    found = _ruled(one, ["_one"], document)
    first = F.forall("path", lambda p: ~p.rlike("^[0-9]{10}$") | (p == "0000000000"))
    return found.where(first & (F.col("kind") != "null")).select("rule", "kind", F.col("rule").isin("tipo", "nome").alias("required")).distinct()


def errors(docs: DataFrame, keys: list[str], document: str, rules: DataFrame) -> DataFrame:
    """keys, errors: `path: expected kind, found kind` and `path: missing`, sorted by path; empty for valid documents.

    Null passes but for required fields, an integer is a number, a number without a fraction an integer. Fields without
    a rule pass, as does all below a field of the wrong kind, which is an error itself.
    """
    found = settled(_ruled(docs, keys, document))
    want = rules.select("rule", F.col("kind").alias("want"), "required")
    fits = (F.col("kind") == F.col("want")) | ((F.col("want") == "number") & (F.col("kind") == "integer")) | ((F.col("want") == "integer") & F.col("whole")) | ((F.col("kind") == "null") & ~F.col("required"))
    shown = F.array_join(F.transform("path", lambda p: F.when(p.rlike("^[0-9]{10}$"), p.cast("string").cast("int").cast("string")).otherwise(p)), ".")
    wrong = found.join(want, "rule").where(~fits).select(*keys, "path", F.concat(shown, F.lit(": expected "), "want", F.lit(", found "), "kind").alias("error"))
    names = docs.select(*keys).distinct()
    # The required fields of a type are two at most.
    asked = sorted(r.rule for r in rules.where("required").select("rule").distinct().collect())
    missing = names.select(*keys, F.explode(F.array(*map(F.lit, asked)).cast("array<string>")).alias("rule")).join(found.select(*keys, "rule"), [*keys, "rule"], "left_anti")
    missing = missing.select(*keys, F.array("rule").alias("path"), F.concat("rule", F.lit(": missing")).alias("error"))
    told = wrong.unionByName(missing).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "error"))), lambda e: e["error"]).alias("errors"))
    return names.join(told, keys, "left").select(*keys, F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
