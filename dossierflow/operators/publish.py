"""Publishing of drafts into the vault, its audit trail, and the life of runs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.operators.review import unique_targets

MERGE_MARK = "\n\n<!-- merge da batch UI -->\n\n"
#: States in which a run may end.
FINAL = ("success", "error", "partial")


def outcomes(drafts: DataFrame, existing: DataFrame, policy: str, key: str = "draft_id") -> DataFrame:
    """key, action, outcome, target and content of the drafts that are acted on.

    `drafts` has stato, target (null: none), text and edits (null: none); `existing` has target and text. Approved and
    edited drafts are applied, rejected ones archived, all others stay as they are and have no row. Policies for a target
    that is there: skip, overwrite, rename (the least free -1, -2, ...) and merge (behind what is there).
    """
    there = existing.select("target", F.col("text").alias("_old"))
    acted = drafts.where(F.col("stato").isin("approved", "edited", "rejected")).join(there, "target", "left")
    content = F.coalesce("edits", "text")
    taken, ready = F.col("_old").isNotNull(), F.col("stato") != "rejected"
    outcome = F.when(~ready, "archived").when(F.col("target").isNull(), "skipped-no-target").when(taken & F.lit(policy == "skip"), "skipped-conflict").otherwise("applied")
    if policy == "merge":
        content = F.when(taken, F.concat(F.regexp_replace("_old", r"\s+$", ""), F.lit(MERGE_MARK), content)).otherwise(content)
    out = acted.select(key, F.col("stato").alias("action"), outcome.alias("outcome"), "target", content.alias("content"))
    if policy != "rename":
        return out
    moving = F.col("outcome") == "applied"
    return unique_targets(out.where(moving), existing, key).select(*out.columns).unionByName(out.where(~moving))


def audit_rows(done: DataFrame, batch: Column, user: str, at: Column, policy: str) -> DataFrame:
    """One row of the decisions log for each draft that was acted on."""
    return done.select(at.alias("ts"), batch.alias("batch"), "draft_id", "action", F.lit(user).alias("user"), F.when(F.col("outcome") == "applied", F.col("target")).alias("applied_to"), "outcome", F.lit(policy).alias("conflict_policy"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to a log of JSON lines; no file of it is ever changed. For decisions, costs of models, raw answers of services."""
    rows.write.mode("append").json(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the log hasn't; what is there is never written again. One writer at a time."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(rows.schema).json(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], rows.select(key).schema)
    rows.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").json(path)


def write_notes(notes: DataFrame, root: str, backup_at: str | None = None, backups: str = ".backups") -> DataFrame:
    """Writes (path, text) below `root`, a folder that all executors share, and returns (path, action) as written.

    An identical note is left alone. One that differs is first copied to the folder `backups` as stem_TIME.md if
    `backup_at` gives the time. A note is written beside its place and moved there, so a task that runs twice does no
    harm and readers see a whole note. A path that leads out of the root is refused. The result is computed as it is
    read: write it or count it once.
    """
    top = os.path.realpath(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            actions = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                place = os.path.realpath(os.path.join(top, path))
                if not place.startswith(top + os.sep):
                    actions.append("refused")
                    continue
                old = None
                if os.path.exists(place):
                    with open(place, encoding="utf-8", newline="") as f:
                        old = f.read()
                if old == text:
                    actions.append("identical")
                    continue
                os.makedirs(os.path.dirname(place), exist_ok=True)
                moves = [(place, text)]
                if old is not None and backup_at:
                    folder = os.path.join(top, backups)
                    os.makedirs(folder, exist_ok=True)
                    moves.insert(0, (os.path.join(folder, f"{os.path.splitext(os.path.basename(place))[0]}_{backup_at}.md"), old))
                for to, what in moves:
                    beside = f"{to}.{uuid.uuid4().hex}"
                    with open(beside, "w", encoding="utf-8", newline="") as f:
                        f.write(what)
                    os.replace(beside, to)
                actions.append("created" if old is None else "replaced")
            yield pd.DataFrame({"path": batch["path"], "action": actions})

    return notes.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(write, "path string, action string")


def archived(done: DataFrame, archive: DataFrame, folder: str = "_archive") -> DataFrame:
    """draft_id, target: where rejected drafts (outcomes with name) go: the folder, under their name or the next that neither it nor another draft has."""
    named = done.where("outcome = 'archived'").select("draft_id", F.concat(F.lit(f"{folder}/"), "name").alias("target"))
    return unique_targets(named, archive, "draft_id").select("draft_id", "target")


def mark_written(entities: DataFrame, published: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Sets written_at of the published entities; one that has it keeps it, so a second run changes nothing."""
    done = published.select(*keys).distinct().withColumn("_done", F.lit(True))
    return entities.join(done, keys, "left").withColumn("written_at", F.coalesce("written_at", F.when(F.col("_done"), at))).drop("_done")


def run_state(events: DataFrame) -> DataFrame:
    """Latest state of each run from its events (run_id, at, kind, status, payload); runs that never started have none.

    kind is start, progress, heartbeat or complete. A run is running until its last `complete` with a final status.
    """
    kind, at = F.col("kind"), F.col("at")
    ended = (kind == "complete") & F.col("status").isin(*FINAL)
    alive = kind.isin("progress", "heartbeat")
    found = events.groupBy("run_id").agg(
        F.min(F.when(kind == "start", at)).alias("started_at"),
        F.max(F.when(ended, at)).alias("completed_at"),
        F.max(F.when(alive, at)).alias("heartbeat_at"),
        F.max_by("payload", F.when(kind == "progress", at)).alias("progress"),
        F.coalesce(F.max_by("status", F.when(ended, at)), F.lit("running")).alias("status"),
    )
    return found.where("started_at IS NOT NULL")


def delete_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Snapshot without the rows whose key columns equal those of `keys`, nulls being equal."""
    gone = keys.distinct().select(*[F.col(c).alias(f"_{c}") for c in keys.columns])
    same = F.lit(True)
    for c in keys.columns:
        same &= table[c].eqNullSafe(gone[f"_{c}"])
    return table.join(gone, same, "left_anti")


def next_step(docs: Column, entities: Column, pending: Column, approved: Column, notes: Column) -> Column:
    """Where to go next, by the first thing that is missing."""
    return F.when(docs == 0, "Scan").when(entities == 0, "Build").when(pending > 0, "Review").when((approved > 0) & (notes == 0), "Vault").when(approved > 0, "Settings").otherwise("Scan")
