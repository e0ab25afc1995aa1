"""Personal data to stable placeholders and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.text import holds_personal, personal_values
from dossierflow.operators.dedup import ordinals

KINDS = ("iban", "cf", "email", "phone")


def dictionary(docs: DataFrame, known: DataFrame | None = None, kinds: tuple[str, ...] = KINDS, key: str = "doc_id") -> DataFrame:
    """(kind, value, placeholder): numbers run per kind in order of first appearance by key and position.

    Values in `known` keep their placeholder; new ones are numbered behind the highest of their kind. A value keeps
    the kind it is first seen as. Counting runs per range partition, not in one task.
    """
    found = docs.where(holds_personal(F.col("text"), kinds)).select(key, F.posexplode(personal_values(F.col("text"), kinds)).alias("pos", "v")).select(key, "pos", "v.kind", "v.value")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    first = found.groupBy("value").agg(F.min(F.struct(F.col(key), rank.alias("rank"), "pos", "kind")).alias("f"))
    fresh = first.select("value", F.col("f.kind").alias("kind"), F.col(f"f.{key}").alias("at"), F.col("f.pos").alias("pos"))
    if known is not None:
        fresh = fresh.join(known.select("value"), "value", "left_anti")
    counted = ordinals(fresh, ["kind", "at", "pos"])
    # At most one row a kind.
    base = counted.groupBy("kind").agg((F.min("ordinal") - 1).alias("base"))
    if known is not None:
        used = known.groupBy("kind").agg(F.max(F.regexp_extract("placeholder", r"-(\d+)>$", 1).cast("long")).alias("used"))
        base = base.join(used, "kind", "left").select("kind", (F.col("base") - F.coalesce("used", F.lit(0))).alias("base"))
    new = counted.join(F.broadcast(base), "kind").select("kind", "value", F.format_string("<%s-%d>", "kind", F.col("ordinal") - F.col("base")).alias("placeholder"))
    return new if known is None else known.select("kind", "value", "placeholder").unionByName(new)


def _swapped(docs: DataFrame, holds: Column, pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Texts that hold something are joined with their pairs (longest first); the others are left where they lie."""
    swap = F.aggregate("pairs", F.col("text"), lambda acc, p: F.replace(acc, p[old], p[new]))
    some = docs.where(holds).join(pairs, key, "left").withColumn("text", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(swap)).drop("pairs")
    return some.select(docs.columns).unionByName(docs.where(~F.coalesce(holds, F.lit(False))))


def redact(docs: DataFrame, names: DataFrame, kinds: tuple[str, ...] = KINDS, key: str = "doc_id") -> DataFrame:
    """`docs` with every value of the dictionary that the text holds replaced, longest first."""
    holds = holds_personal(F.col("text"), kinds)
    values = docs.where(holds).select(key, F.explode(personal_values(F.col("text"), kinds)).alias("v")).select(key, "v.value").distinct()
    pairs = values.join(names.select("value", "placeholder"), "value").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.char_length("value").alias("n"), "value", "placeholder")), asc=False).alias("pairs"))
    return _swapped(docs, holds, pairs, key, "value", "placeholder")


def unredact(docs: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """The inverse: placeholders that the dictionary knows become their values, others stay."""
    form = r"<(?:email|cf|iban|phone)-\d+>"
    holds = F.col("text").rlike(form)
    held = docs.where(holds).select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(form), F.lit(0)))).alias("placeholder"))
    pairs = held.join(names.select("placeholder", "value"), "placeholder").groupBy(key).agg(F.collect_list(F.struct("placeholder", "value")).alias("pairs"))
    return _swapped(docs, holds, pairs, key, "placeholder", "value")


def redact_blocks(blocks: Column, pairs: Column) -> Column:
    """Of a message's blocks (type, text) the texts redacted by pairs (value, placeholder), longest first; other blocks stay."""
    swapped = lambda text: F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["value"], p["placeholder"]))
    return F.transform(blocks, lambda b: F.when(b["type"] == "text", b.withField("text", swapped(b["text"]))).otherwise(b))
