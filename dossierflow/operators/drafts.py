"""Drafts, their review states, and what publishing them would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.tokens import BULK_APPROVE

STATES = ("pending", "approved", "rejected", "edited", "parked")


def with_state(drafts: DataFrame, states: DataFrame, key: str = "draft_id") -> DataFrame:
    return drafts.join(states.select(key, "stato"), key, "left").withColumn("stato", F.coalesce("stato", F.lit("pending")))


def draft_filter(drafts: DataFrame, state: str | None = None, text: str | None = None) -> DataFrame:
    if state is not None:
        drafts = drafts.where(F.col("stato") == state)
    return drafts.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else drafts


def bulk_approve(drafts: DataFrame, threshold: float = BULK_APPROVE) -> DataFrame:
    fits = F.col("stato").isin("pending", "parked") & F.col("confidence").isNotNull() & (F.col("confidence") >= threshold)
    return drafts.withColumn("stato", F.when(fits, "approved").otherwise(F.col("stato")))


def state_counts(drafts: DataFrame) -> DataFrame:
    return drafts.groupBy("batch").agg(*[F.count_if(F.col("stato") == s).alias(s) for s in STATES])


def flush_plan(drafts: DataFrame, existing: DataFrame, policy: str) -> DataFrame:
    """action and target of each draft; `existing` has the targets already there. Policies: skip, overwrite, rename, merge."""
    marked = drafts.join(existing.select("target").distinct().withColumn("_there", F.lit(True)), "target", "left")
    ready = F.col("stato").isin("approved", "edited")
    action = F.when(F.col("stato") == "rejected", "archive").when(~ready, "keep").when(F.col("_there"), policy).otherwise("write")
    renamed = F.regexp_replace("target", r"(\.[^.]*)$", "-1$1")
    target = F.when(ready & F.coalesce("_there", F.lit(False)) & F.lit(policy == "rename"), renamed).when(ready, F.col("target"))
    return marked.withColumns({"action": action, "target": target}).drop("_there")
