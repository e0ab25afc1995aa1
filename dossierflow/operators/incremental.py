"""Manifests, snapshots and merges: what is new, changed, renamed or already known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_state(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds state: unchanged (same id, mtime and size), changed, renamed (other id, same content), new; and old_id."""
    known = manifest.select("connector", "source_id", F.col("mtime_s").alias("m_mtime"), F.col("size").alias("m_size"))
    by_hash = manifest.where("hash IS NOT NULL").groupBy("connector", "hash").agg(F.min("source_id").alias("least"), F.max("source_id").alias("most"))
    joined = files.join(known, ["connector", "source_id"], "left").join(by_hash, ["connector", "hash"], "left")
    other = F.when(F.col("least") != F.col("source_id"), F.col("least")).when(F.col("most") != F.col("source_id"), F.col("most"))
    same = F.col("m_mtime").isNotNull() & (F.col("m_mtime") == F.col("mtime_s")) & (F.col("m_size") == F.col("size"))
    state = F.when(same, "unchanged").when(F.col("m_mtime").isNotNull(), "changed").when(other.isNotNull(), "renamed").otherwise("new")
    return joined.withColumns({"state": state, "old_id": F.when(state == "renamed", other)}).drop("m_mtime", "m_size", "least", "most")


def insert_if_absent(rows: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """The rows whose key the table lacks, one a key: the first in order."""
    fresh = rows.join(table.select(key), key, "left_anti")
    packed = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("row")
    return fresh.groupBy(F.col(key).alias("_key")).agg(packed).select("row.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Snapshot after a merge: changed rows replace the table's, columns in `keep` stay as they were."""
    values = [c for c in table.columns if c not in keys]
    old, new = table.withColumn("_old", F.lit(True)), changes.withColumn("_new", F.lit(True))
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    pick = lambda c: (F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
    return joined.select(*keys, *[pick(c) for c in values])


def latest_decision(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies the latest decision of each entity to its status; actions other than the four are ignored."""
    actions = {"approve": "approved", "reject": "rejected", "edit": "edited", "skip": None}
    status = F.try_element_at(F.create_map(*[F.lit(x) for kv in actions.items() if kv[1] for x in kv]), F.col("action"))
    last = decisions.withColumn("_status", status).where("_status IS NOT NULL").groupBy("pk").agg(F.max_by("_status", "ts").alias("_status"))
    return entities.join(last, "pk", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def field_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """key, field, old, new, kind (new, changed, same, lost): a full outer join of the filled fields."""
    entries = lambda df: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("e")).select(*keys, "e.field", "e.value").where("value IS NOT NULL AND trim(value) <> ''")
    a, b = entries(old).withColumnRenamed("value", "old"), entries(new).withColumnRenamed("value", "new")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "lost").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, [*keys, "field"], "full_outer").withColumn("kind", kind)


def filled(col: Column) -> Column:
    return col.isNotNull() & (F.trim(col.cast("string")) != "")


def fill_rate(rows: DataFrame, fields: list[str], name: str = "fill_rate") -> DataFrame:
    total = sum((F.when(filled(F.col(f)), 1).otherwise(0) for f in fields), F.lit(0))
    return rows.withColumn(name, F.round(total / len(fields), 2))


def merge_candidates(candidates: DataFrame, keys: list[str], order: str, scalars: list[str], long_form: list[str]) -> DataFrame:
    """Ordered merge of candidates of an entity.

    A scalar takes the value of the higher confidence, ties keep the earlier; the confidence of what has been merged is
    the running pairwise mean. Long-form texts are joined in order by a rule line unless equal to what is there.
    """
    fields = [*scalars, *long_form]
    rows = F.sort_array(F.collect_list(F.struct(order, F.col("confidence").cast("double").alias("confidence"), *[F.col(f).cast("string").alias(f) for f in fields])))
    rule = "\n\n---\n\n"

    def step(acc: Column, row: Column) -> Column:
        out = []
        for f in scalars:
            a, b = acc[f], row[f]
            out.append(F.when(~filled(a) | a.isNull(), b).when(~filled(b) | b.isNull() | (acc["confidence"] >= row["confidence"]), a).otherwise(b).alias(f))
        for f in long_form:
            a, b = F.trim(F.coalesce(acc[f], F.lit(""))), F.trim(F.coalesce(row[f], F.lit("")))
            out.append(F.when(a == "", b).when((b == "") | (a == b), a).otherwise(F.concat(a, F.lit(rule), b)).alias(f))
        return F.struct(((acc["confidence"] + row["confidence"]) / 2).alias("confidence"), *out, (acc["n"] + 1).alias("n"))

    grouped = candidates.groupBy(*keys).agg(rows.alias("_rows"))
    first = F.get("_rows", F.lit(0))
    start = F.struct(first["confidence"].alias("confidence"), *[first[f].alias(f) if f in scalars else F.trim(F.coalesce(first[f], F.lit(""))).alias(f) for f in fields], F.lit(1).alias("n"))
    merged = F.aggregate(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0))), start, step)
    return grouped.select(*keys, merged.alias("_m")).select(*keys, *[F.col(f"_m.{f}") for f in fields], F.col("_m.confidence"), F.col("_m.n"))
