"""Rule categorizer: additive signals, argmax in a fixed order, and routing of the residue to a model stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions.text import age_days, contains_any
from dossierflow.functions.tokens import ARCHIVE_PATHS, BUSINESS_NAMES, CATEGORIES, CONSULT_PATHS, LIVE_PATHS, MODEL_BELOW, RED_FLAG_NAMES

#: Dollars per million tokens in and out, and euros per dollar.
PRICES = {"haiku": (1.0, 5.0), "sonnet": (3.0, 15.0), "opus": (15.0, 75.0)}
EUR_PER_USD = 0.92


def _clamped(*bumps: Column) -> Column:
    """Sum of the bumps, clamped to 1 after each."""
    total = F.lit(0.0)
    for bump in bumps:
        total = F.least(F.lit(1.0), total + bump)
    return total


def score(records: DataFrame, now: Column) -> DataFrame:
    """Adds age_days and a score column for each category; needs name, path, size, mtime."""
    flags = records.withColumns(
        {
            "age_days": age_days(F.col("mtime"), now),
            "_name": F.lower(F.coalesce("name", F.lit(""))),
            "_path": F.lower(F.coalesce("path", F.lit(""))),
        }
    ).withColumns(
        {
            "_red": contains_any(F.col("_name"), RED_FLAG_NAMES),
            "_archive": contains_any(F.col("_path"), ARCHIVE_PATHS),
            "_live": contains_any(F.col("_path"), LIVE_PATHS),
            "_consult": contains_any(F.col("_path"), CONSULT_PATHS),
            "_business": contains_any(F.col("_name"), BUSINESS_NAMES),
        }
    )
    age, on = F.col("age_days"), lambda c, v: F.when(c, v).otherwise(0.0)
    trash = F.contains("_path", F.lit("/cestino")) | F.startswith("_path", F.lit("cestino/")) | F.contains("_path", F.lit("/trash"))
    scores = {
        "vivo": _clamped(on(age < 90, 0.6) + on((age >= 90) & (age < 365), 0.3), on(F.col("_live"), 0.4), on(F.col("_business") & (age < 365), 0.3)),
        "da-consultare": _clamped(on((age >= 90) & (age < 365), 0.3) + on((age >= 365) & (age < 1095), 0.4), on(F.col("_consult"), 0.5), on(F.col("_business") & (age >= 365) & (age < 1095), 0.3)),
        "archivio": _clamped(on((age >= 365) & (age < 1095), 0.3) + on(age >= 1095, 0.6), on(F.col("_archive"), 0.7), on(F.col("_business") & (age >= 1095), 0.3)),
        "cestino": _clamped(on(F.col("_red"), 0.5), on(F.startswith("_name", F.lit("~$")), 0.5), on(trash, 0.9), on(F.col("size") == 0, 0.4)),
        "da-chiarire": on(F.col("size") > 200 * 1024 * 1024, 0.3),
    }
    return flags.withColumns({f"score_{k}": v for k, v in scores.items()})


def classify(records: DataFrame, now: Column) -> DataFrame:
    """Adds category, confidence and reason; the first category in order wins a tie, under the cutoff none does."""
    scored = score(records, now)
    values = F.array(*[F.col(f"score_{c}") for c in CATEGORIES])
    best = F.array_max(values)
    winner = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.array_position(values, best).cast("int"))
    said = F.concat_ws(
        ",",
        F.concat(F.lit("age="), F.col("age_days").cast("string"), F.lit("d")),
        F.when(F.col("_red"), "naming-red-flag"),
        F.when(F.col("_archive"), "path=archivio"),
        F.when(F.col("_live"), "path=vivo"),
        F.when(F.col("size") == 0, "size=0"),
    )
    unsure = best < MODEL_BELOW
    out = scored.withColumns(
        {
            "category": F.when(unsure, "da-chiarire").otherwise(winner),
            "confidence": best,
            "reason": F.when(unsure, F.concat(F.lit("no-rule-decisive: "), said)).otherwise(said),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(("_", "score_"))])


def needs_model(classified: DataFrame) -> DataFrame:
    return classified.withColumn("needs_model", (F.col("category") == "da-chiarire") | (F.col("confidence") < MODEL_BELOW))


def apply_answers(classified: DataFrame, answers: DataFrame, model_prefix: str = "model: ") -> DataFrame:
    """Patches the rows that a model answered; answers: key, category, confidence, reason, ord. The last answer wins."""
    last = answers.groupBy("key").agg(F.max_by(F.struct("category", "confidence", "reason"), "ord").alias("answer"))
    keyed = classified.withColumn("key", F.coalesce("sha256", "source_id"))
    use = F.col("answer").isNotNull() & ((F.col("category") == "da-chiarire") | (F.col("confidence") < MODEL_BELOW))
    joined = keyed.join(last, "key", "left")
    pick = lambda name: F.when(use, F.col(f"answer.{name}")).otherwise(F.col(name))
    return joined.select(
        *[c for c in classified.columns if c not in ("category", "confidence", "reason")],
        pick("category").alias("category"),
        pick("confidence").alias("confidence"),
        F.when(use, F.concat(F.lit(model_prefix), F.col("answer.reason"))).otherwise(F.concat(F.lit("rules: "), F.col("reason"))).alias("reason"),
    )


def category_counts(records: DataFrame, column: str = "categoria") -> DataFrame:
    """Every category with its count and percentage; null is skipped, an unknown one counts as the last."""
    spark = records.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "ord int, category string")
    known = F.when(F.col(column).isin(*CATEGORIES), F.col(column)).otherwise(CATEGORIES[-1])
    counts = records.where(F.col(column).isNotNull()).groupBy(known.alias("category")).agg(F.count("*").alias("n"))
    # Five rows on either side.
    filled = names.join(F.broadcast(counts), "category", "left").select("ord", "category", F.coalesce("n", F.lit(0)).alias("n"))
    total = filled.agg(F.sum("n").alias("total"))
    return filled.crossJoin(F.broadcast(total)).select("category", "n", F.when(F.col("total") > 0, F.round(100 * F.col("n") / F.col("total"), 1)).otherwise(0.0).alias("pct"))


def model_cost(calls: DataFrame) -> DataFrame:
    """Adds cost_eur from tokens_in, tokens_out and model; an unknown model costs as the cheapest."""
    price = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[i])]), F.col("model")), F.lit(PRICES["haiku"][i]))
    cost = (F.col("tokens_in") / 1e6 * price(0) + F.col("tokens_out") / 1e6 * price(1)) * EUR_PER_USD
    return calls.withColumn("cost_eur", F.round(cost, 6))
