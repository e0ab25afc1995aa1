"""Aggregates for reports: progress, costs, coverage and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.functions.tokens import DORMANT_DAYS


def cost_totals(calls: DataFrame) -> DataFrame:
    """Total, per model and per stage in one pass over the calls."""
    return calls.groupingSets([[], ["model"], ["stage"]], "model", "stage").agg(F.count("*").alias("n_calls"), F.round(F.sum(F.coalesce("cost_eur", F.lit(0.0))), 2).alias("cost"))


def source_progress(records: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per source: discovered, extracted (its hash prefix is among `extracted`), categorized."""
    done = extracted.select("sha12").distinct().withColumn("_done", F.lit(1))
    # Counted by prefix first, so records without a hash are a row a source in the join.
    counted = records.groupBy("source", F.substring("sha256", 1, 12).alias("sha12")).agg(F.count("*").alias("_n"), F.count("categoria").alias("_c"))
    marked = counted.join(done, "sha12", "left")
    return marked.groupBy("source").agg(F.sum("_n").alias("discovered"), F.sum(F.when(F.col("_done").isNotNull(), F.col("_n")).otherwise(0)).alias("extracted"), F.sum("_c").alias("categorized"))


def entity_rollup(entities: DataFrame) -> DataFrame:
    return entities.groupingSets([["entity_type", "status"], ["entity_type"], ["status"]], "entity_type", "status").agg(F.count("*").alias("n"))


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    names = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return names.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def dormant(activity: DataFrame, now: Column, days: int = DORMANT_DAYS) -> DataFrame:
    return activity.groupBy("client").agg(F.max("seen").alias("last_seen")).where(F.col("last_seen") < now - F.expr(f"INTERVAL {days} DAYS"))


def last_runs(runs: DataFrame, limit: int) -> DataFrame:
    source = F.when(F.col("command").like("scan fs%"), "fs").when(F.col("command").like("scan gdrive%"), "gdrive").when(F.col("command").like("scan outlook%"), "outlook").otherwise("other")
    return runs.orderBy(F.desc("id")).limit(limit).groupBy(source.alias("source")).agg(F.count("*").alias("n"))


def missing_files(records: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(folder, need): required names that a folder lacks. The required list is a constant, exploded per folder."""
    wanted = records.select("folder").distinct().select("folder", F.explode(F.array(*[F.lit(r) for r in required])).alias("need"))
    return wanted.join(records.select("folder", F.col("name").alias("need")).where(F.col("need").isin(*required)), ["folder", "need"], "left_anti")


def broken_links(pages: DataFrame, key: str, text: str, pattern: str, targets: DataFrame) -> DataFrame:
    links = pages.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("link")).distinct()
    return links.join(targets, "link", "left_anti").select(key, "link")


def next_actions(records: DataFrame) -> DataFrame:
    facts = records.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sha256").isNull()).alias("bare"),
        F.count_if(F.col("categoria").isNull()).alias("loose"),
        F.count_if(F.col("categoria") == "da-chiarire").alias("unclear"),
    )
    known = F.col("n") - F.col("loose")
    said = F.concat_ws("|", F.when(F.col("bare") > 0, "extract"), F.when(F.col("loose") > 0, "categorize"), F.when(F.col("unclear") > 0.2 * known, "unclear"))
    return facts.select(F.when(F.col("n") == 0, "empty").otherwise(said).alias("actions"))


def all_actions(progress: DataFrame, drafts: DataFrame, categories: DataFrame, orphans: DataFrame, missing: DataFrame) -> DataFrame:
    """(place, action, n): what to do next, in order: scan, extract, categorize, approve, review-rules, clean-orphans, complete-objects, else fine.

    progress as `source_progress` gives it; drafts and categories have name and n; orphans and missing a row each, of
    which objects (area, object) may miss several. n is a count, for review-rules the share of unclear files in percent.
    """
    one = lambda df, place, action, n, holds: df.agg(n.alias("n"), F.count("*").alias("_rows")).where(holds).select(F.lit(place).alias("place"), F.lit(action).alias("action"), "n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    zero = F.lit(0.0)
    unclear = F.coalesce(F.round(100 * F.sum(F.when(F.col("name") == "da-chiarire", F.col("n")).otherwise(0)) / F.sum("n"), 1), zero)
    parts = [
        one(progress, 1, "scan", zero, F.col("_rows") == 0),
        one(progress, 2, "extract", total(F.col("discovered") - F.col("extracted")), F.col("n") > 0),
        one(progress, 3, "categorize", total(F.col("discovered") - F.col("categorized")), F.col("n") > 0),
        one(drafts.where("name = 'pending'"), 4, "approve", total("n"), F.col("n") > 0),
        one(categories, 5, "review-rules", unclear, F.col("n") > 20),
        one(orphans, 6, "clean-orphans", F.count("*").cast("double"), F.col("n") > 0),
        one(missing.select("area", "object").distinct(), 7, "complete-objects", F.count("*").cast("double"), F.col("n") > 0),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # Seven rows at most.
    return found.unionByName(one(found, 8, "fine", zero, F.col("_rows") == 0))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence < 0.4, "low").when(confidence < 0.7, "medium").otherwise("high")


def throughput(rows: DataFrame, group: str, order: str, clock: str) -> DataFrame:
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(order, F.count("*").over(running).alias("done"), (F.col(clock) - F.min(clock).over(running)).alias("elapsed_s"))


def eta(rows: DataFrame, totals: DataFrame, group: str, order: str, clock: str) -> DataFrame:
    """throughput with items a second and seconds to go; both null in the first tenth of a second, to go also once all are done or where `totals` (group, total) has none."""
    running = throughput(rows, group, order, clock).join(rows.select(group, order), order).join(totals, group, "left")
    rate = F.when(F.col("elapsed_s") > 0.1, F.col("done") / F.col("elapsed_s"))
    return running.select(order, "done", "elapsed_s", rate.alias("rate"), F.when(F.col("done") < F.col("total"), (F.col("total") - F.col("done")) / rate).alias("eta_s"))


def lint(notes: DataFrame, entries: int = 25, stub: int = 15, proposals: int = 15) -> DataFrame:
    """Counts of each note's text, and whether they ask for attention: `## ` entries, lines that aren't blank, sessions opened and closed."""
    count = lambda pattern: F.regexp_count("text", F.lit("(?m)" + pattern)).cast("long")
    counted = notes.withColumns({"n_entries": count("^## "), "n_lines": count(r"^.*\S.*$"), "n_opened": count(r"^### Sessione \d+ aperta"), "n_closed": count(r"^### Sessione \d+ chiusa")})
    n = F.col("n_entries")
    return counted.withColumns({"over_memory": n > entries, "over_proposals": n > proposals, "stub": F.col("n_lines") < stub, "open_sessions": F.col("n_opened") != F.col("n_closed")})


def run_stats(decisions: DataFrame) -> DataFrame:
    """Per category and in total (category null): records, and how many a model or the rules have decided."""
    of = lambda method: F.count_if(F.col("method") == method).alias(f"n_{method}")
    return decisions.groupingSets([["categoria"], []], "categoria").agg(F.count("*").alias("n"), of("llm"), of("rules"))


def status_totals(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n_records"), F.count_distinct("source").alias("n_sources"), F.count("sha256").alias("n_hashed"), F.count("categoria").alias("n_categorized"), F.sum("size").alias("bytes"))
