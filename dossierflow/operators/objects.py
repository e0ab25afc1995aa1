"""Business objects: records to clients, suppliers and jobs, and people from mail headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.functions.text import object_folder, sender_domain, slugify, type_from_path
from dossierflow.functions.tokens import GENERIC_DOMAINS, MIN_CLUSTER

NAME_PREFIX = r"^([a-z0-9]+(?:[-_][a-z0-9]+)*)[_-](?:offerta|ordine|contratto|fattura|capitolato|preventivo)"


def mail_domain() -> Column:
    found = sender_domain(F.col("sender"))
    return F.when(F.col("source").isin("email", "email-attachment") & ~found.isin(*GENERIC_DOMAINS), found)


def signal() -> Column:
    """struct(tipo, slug, signal) of the strongest signal: folder, then mail domain, then name prefix."""
    folder = object_folder(F.col("path"))
    domain = mail_domain()
    prefix = F.regexp_extract(F.lower(F.substring_index("name", ".", 1)), NAME_PREFIX, 1)
    slug = slugify(F.replace(prefix, F.lit("_"), F.lit("-")))
    make = lambda tipo, s, label: F.struct(tipo.alias("tipo"), s.alias("slug"), label.alias("signal"))
    return F.coalesce(
        F.when(folder.isNotNull(), make(folder["tipo"], slugify(folder["child"]), F.concat(F.lit("folder:"), folder["tipo"]))),
        F.when(domain.isNotNull(), make(F.lit("cliente"), slugify(F.substring_index(domain, ".", 1)), F.concat(F.lit("email-domain:"), domain))),
        F.when(prefix != "", make(F.coalesce(type_from_path(F.col("path")), F.lit("cliente")), slug, F.concat(F.lit("name-prefix:"), slug))),
    )


def with_signal(records: DataFrame) -> DataFrame:
    live = records.where(F.col("categoria").isin("vivo", "da-consultare")).withColumn("_s", signal())
    return live.where(F.col("_s").isNotNull() & (F.col("_s.slug") != "ignoto")).select("*", "_s.*").drop("_s")


def object_groups(records: DataFrame) -> DataFrame:
    groups = with_signal(records).groupBy("tipo", "slug").agg(F.count("*").alias("n"), F.count_distinct("signal").alias("n_signals")).where(F.col("n") >= MIN_CLUSTER)
    base = F.least(F.lit(1.0), F.col("n") / 10.0) + F.least(F.lit(0.3), 0.05 * F.col("n_signals"))
    return groups.withColumn("confidence", F.round(F.least(F.lit(1.0), base), 2))


def first_files(records: DataFrame, limit: int) -> DataFrame:
    """The first `limit` files of each object by name, and how many more there are.

    A large object keeps only its first names per task before they meet, since row_number below a limit is pushed.
    """
    rows = with_signal(records)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("tipo", "slug").orderBy("name", "source_id"))).where(F.col("place") <= limit)
    sizes = rows.groupBy("tipo", "slug").agg(F.count("*").alias("n"))
    return ranked.join(sizes, ["tipo", "slug"]).select("tipo", "slug", "place", "name", "source_id", F.greatest(F.col("n") - limit, F.lit(0)).alias("others"))


def addresses(raw: Column) -> Column:
    """array<struct<name,email>> of a header; commas inside angle brackets do not part."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r",(?![^<]*>)"), lambda p: F.trim(p)), lambda p: p != "")
    named = r"^\s*\"?([^<\"]+?)\"?\s*<([^>]+)>"
    bare = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

    def one(p: Column) -> Column:
        is_named = p.rlike(named)
        email = F.when(is_named, F.lower(F.trim(F.regexp_extract(p, named, 2)))).otherwise(F.lower(F.regexp_extract(p, bare, 0)))
        return F.struct(F.when(is_named, F.trim(F.regexp_extract(p, named, 1))).otherwise("").alias("name"), email.alias("email"))

    return F.filter(F.transform(parts, one), lambda a: a["email"] != "")


def people(mails: DataFrame, headers: tuple[str, ...] = ("from", "to")) -> DataFrame:
    """One row a mail address: names, best name (longest), first and last seen, messages sent."""
    kinds = F.array(*[F.struct(F.lit(h).alias("header"), F.col(h).alias("raw")) for h in headers])
    said = mails.select("when_s", F.explode(kinds).alias("h")).select("when_s", "h.header", F.explode(addresses(F.col("h.raw"))).alias("a"))
    named = F.when(F.col("a.name") != "", F.col("a.name"))
    return said.groupBy(F.col("a.email").alias("email")).agg(
        F.array_join(F.sort_array(F.collect_set(named)), "|").alias("names"),
        F.coalesce(F.max_by(named, F.struct(F.char_length(named), named)), F.lit("")).alias("best_name"),
        F.min("when_s").alias("first_s"),
        F.max("when_s").alias("last_s"),
        F.count_if(F.col("header") == "from").alias("n_messages"),
    )


def people_by_domain(persons: DataFrame, internal: str) -> DataFrame:
    domain = F.substring_index("email", "@", -1)
    return persons.groupBy(domain.alias("domain"), (domain == internal.lower()).alias("internal")).agg(F.count("*").alias("n"), F.sum("n_messages").alias("n_messages"))


def signature(body: Column) -> Column:
    """struct(role, phone) read behind the last greeting."""
    hints = ("cordiali saluti", "distinti saluti", "saluti", "best regards", "regards", "grazie", "buona giornata")
    low = F.lower(body)
    last = F.greatest(*[F.when(F.contains(low, F.lit(h)), F.char_length(low) - F.instr(F.reverse(low), F.lit(h[::-1])) - len(h) + 2).otherwise(0) for h in hints])
    tail = F.substring(body, last, F.lit(800))
    lines = F.filter(F.transform(F.split(tail, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    phone = F.trim(F.regexp_extract(tail, r"(?:\+39\s*)?(?:\d[\d\s./-]{6,}\d)", 0))
    return F.when(last > 0, F.struct(F.get(lines, F.lit(2)).alias("role"), F.when(phone != "", phone).alias("phone")))
