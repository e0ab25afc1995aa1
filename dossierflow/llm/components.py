"""Connected components of an edge table by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.durable import cut


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): for each id in an edge between two different ids the least id that it can reach.

    Each round points every node at its least neighbour (or itself), follows the pointers once more, and contracts
    the edges to what is left between different nodes. Every node with a smaller neighbour goes, so rounds grow with
    the logarithm of the longest chain, and edges inside a finished group are not read again. Every round is written
    to the shared folder, so lineage stays short.
    """
    flat = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a <> b")
    open_ = cut(flat.distinct(), "edges")
    labels = None
    while True:
        ends = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("up"))
        further = least.select(F.col("id").alias("up"), F.col("up").alias("top"))
        step = cut(least.join(further, "up").select("id", "top"), "labels")
        if labels is None:
            labels = step.withColumnRenamed("top", "component")
        else:
            moved = labels.join(step.withColumnRenamed("id", "component"), "component", "left")
            labels = cut(moved.select("id", F.coalesce("top", "component").alias("component")), "labels")
        ended = lambda k: step.select(F.col("id").alias(k), F.col("top").alias(f"{k}_top"))
        left_over = open_.join(ended("a"), "a").join(ended("b"), "b").where("a_top <> b_top")
        open_ = cut(left_over.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct(), "edges")
        if open_.isEmpty():
            return labels
