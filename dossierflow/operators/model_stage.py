"""The pluggable model stage: batches of records to a callable, answers parsed and checked.

The callable is `model(prompts: list[str]) -> list[str]`; it runs in the tasks, one call a batch. `canned` is a
deterministic stand-in that answers by the first matching prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.tokens import CATEGORIES
from dossierflow.operators.dedup import ordinals

BATCH = 20
ANSWER = "array<struct<id:string,category:string,confidence:double,reason:string>>"


def prompts(records: DataFrame, fields: list[str], batch: int = BATCH, key: str = "doc_id") -> DataFrame:
    """(batch_id, ids, prompt): records in groups of `batch` in the order of the key (unique, of any type), the last one smaller."""
    placed = ordinals(records, [key], "_nth").withColumn("_b", F.floor((F.col("_nth") - 1) / F.lit(batch)))
    grouped = placed.groupBy(F.col("_b").alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), *[f for f in fields]))).alias("rows"))
    return grouped.select("batch_id", F.transform("rows", lambda r: r["id"]).alias("ids"), F.to_json("rows").alias("prompt"))


def ask(asked: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds `answer` and `error`. The model gets all prompts of an Arrow batch in one call; if it fails or gives another
    number of answers they are asked one by one, and what fails then has an empty answer and the reason."""

    def each(prompt: str) -> tuple[str, str | None]:
        try:
            return model([prompt])[0], None
        except Exception as e:  # the residue is marked as unclear by `parse`
            return "", f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame["prompt"].tolist()
            try:
                answers = list(model(prompts))
            except Exception:
                answers = []
            found = [(a, None) for a in answers] if len(answers) == len(prompts) else [each(p) for p in prompts]
            yield frame.assign(answer=[a for a, _ in found], error=pd.Series([e for _, e in found], index=frame.index, dtype=object))

    return asked.mapInPandas(run, asked.withColumns({"answer": F.lit(""), "error": F.lit(None).cast("string")}).schema)


def json_array(answer: Column) -> Column:
    """The answer as it is, or what lies from its first [ to its last ]."""
    return F.regexp_extract(answer, r"(?s)(\[.*\])", 1)


def parse(answered: DataFrame) -> DataFrame:
    """(key, category, confidence, reason, ord): one row a record; unreadable or missing answers are unclear with 0."""
    read = answered.withColumn("parsed", F.from_json(json_array(F.col("answer")), ANSWER))
    ids = read.select("parsed", F.posexplode("ids").alias("ord", "id"))
    mine = F.get(F.filter("parsed", lambda a: a["id"] == F.col("id").cast("string")), F.lit(0))
    name = F.regexp_replace(F.lower(F.trim(mine["category"])), "[ _]+", "-")
    return ids.select(
        F.col("id").alias("key"),
        F.when(name.isin(*CATEGORIES), name).otherwise("da-chiarire").alias("category"),
        F.when(name.isin(*CATEGORIES), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(mine["confidence"], F.lit(0.0))))).otherwise(0.0).alias("confidence"),
        F.coalesce(mine["reason"], F.lit("")).alias("reason"),
        F.col("ord").cast("long").alias("ord"),
    )


def canned(prompts: DataFrame, responses: DataFrame, key: str = "doc_id", text: str = "prompt") -> DataFrame:
    """(key, response): the first response in order whose prefix the prompt begins with; without one it is null.

    `responses` (ord, prefix, response) is a small hand-written table, so it is joined by broadcast; its size is checked.
    """
    if responses.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 canned responses: join them by an exact key instead")
    joined = prompts.join(F.broadcast(responses), F.startswith(F.col(text), F.col("prefix")), "left")
    return joined.groupBy(key).agg(F.min_by("response", "ord").alias("response"))
