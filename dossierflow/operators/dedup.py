"""Exact and name-based duplicates of inventory records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.functions.text import base_passes, extension, parent, stem
from dossierflow.functions.tokens import SOURCE_PRIORITY
from dossierflow.session import settled

MISSING = "__missing__"


def priority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]), source), F.lit(0))


def record_id() -> Column:
    return F.concat_ws(":", "source", "source_id")


def hash_index(records: DataFrame) -> DataFrame:
    """(sha256 or the marker for a missing one, n, first): number of records of a hash and the least of their ids."""
    return records.groupBy(F.coalesce("sha256", F.lit(MISSING)).alias("sha256")).agg(F.count("*").alias("n"), F.min(record_id()).alias("first"))


def hash_members(records: DataFrame) -> DataFrame:
    """(sha256, id): membership of the index as rows, so a hash that very many records share is no array in one task."""
    return records.select(F.coalesce("sha256", F.lit(MISSING)).alias("sha256"), record_id().alias("id"))


def duplicate_totals(records: DataFrame) -> DataFrame:
    sizes = records.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_redundant"))


def mark_duplicates(records: DataFrame, order: Column, group_missing: bool = False) -> DataFrame:
    """Adds role (unique, canonical, duplicate-of) and canonical.

    The canonical record has the highest source priority, then the latest mtime, then the first place in `order`.
    Per hash an aggregate picks it (so a hash that very many records share is combined before the shuffle), and one
    join brings it back; records without a hash are left alone unless `group_missing`.
    """
    key = F.coalesce("sha256", F.lit(MISSING)) if group_missing else F.col("sha256")
    keyed = records.withColumn("_key", key)
    # The place tells apart two records of one id.
    best = F.max_by(F.struct(record_id().alias("id"), order.alias("at")), F.struct(priority(F.col("source")), F.col("mtime"), -order)).alias("_best")
    groups = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_n"), best).where("_n > 1")
    role = F.when(F.col("_best").isNull(), "unique").when((record_id() == F.col("_best.id")) & (order == F.col("_best.at")), "canonical").otherwise("duplicate-of")
    # Records without a key go with keys of their own, which nothing equals, instead of all to one partition.
    own = keyed.withColumn("_key", F.coalesce("_key", F.concat(F.lit("\0"), F.coalesce(record_id(), F.lit("")))))
    out = own.join(groups, "_key", "left").withColumns({"role": role, "canonical": F.when(role == "duplicate-of", F.col("_best.id"))})
    return out.drop("_key", "_n", "_best")


def siblings(marked: DataFrame) -> DataFrame:
    """(id, sibling): the duplicates of each canonical record, a row each."""
    return marked.where(F.col("role") == "duplicate-of").select(F.col("canonical").alias("id"), record_id().alias("sibling"))


def name_clusters(records: DataFrame) -> DataFrame:
    """Adds parent, base, ext, and per cluster of two or more its size, canonical name and ordinal key."""
    based = records.withColumn("_b", base_passes(F.col("name")))
    base = F.when(F.col("_b.base") == "", F.lower(stem(F.col("name")))).otherwise(F.col("_b.base"))
    keyed = based.withColumns({"parent": parent(F.col("path")), "base": base, "ext": extension(F.col("name"))}).drop("_b")
    keys = ["parent", "base", "ext"]
    best = F.max_by("source_id", F.struct(F.col("mtime"), -F.char_length("name"), F.col("source_id"))).alias("canonical_id")
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("n"), best).where("n > 1")
    return keyed.join(groups, keys)


def cluster_ordinals(clusters: DataFrame) -> DataFrame:
    """One row a cluster with its ordinal, in the order of its keys.

    Ordinals are counted per range partition and shifted by the partitions before, so no task sorts all clusters.
    """
    keys = ["parent", "base", "ext"]
    groups = clusters.groupBy(*keys).agg(F.first("n").alias("n"))
    return ordinals(groups, keys)


def ordinals(rows: DataFrame, keys: list[str], name: str = "ordinal") -> DataFrame:
    """Adds 1, 2, 3 ... in the order of `keys` (which must be unique) without a global window.

    The ranged rows are written first: the bounds are sampled, and counts and numbers must go by the same ones.
    """
    ranged = settled(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    counts = local.groupBy("_part").agg(F.count("*").alias("_c"))
    # One row a partition, so this window and broadcast are as small as the number of partitions.
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")
