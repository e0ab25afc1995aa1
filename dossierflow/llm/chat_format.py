"""Chat formatting (operator 10): conversations to training texts with a loss mask, in Spark expressions only.

Template: each run of turns with one role is a block ``<s>[INST] role [/INST]text</s>``; further turns of the
same role follow inside the block after ``[TURN]``. In texts and roles a backslash is doubled and each control
string gets a backslash behind its first character, so no control string is left and the escape is reversible.

A conversation is built in two steps so that a very long one is not sorted and joined row by row in one task:
turns are first collected into shards of SHARD_TURNS consecutive turn numbers, then the few shards of a
conversation are joined. Defined cases: null text is empty, null role is '', null turn numbers come first, ties are
ordered by role and text, repeated rows are kept, a null conv_id is a conversation of its own, other columns are
ignored. Turns with one number all fall in one shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.session import read_table

#: Fixed values of the template.
BEGIN, HEAD, BODY, TURN, END = "<s>", "[INST] ", " [/INST]", "[TURN]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]")
SHARD_TURNS = 128
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _shards(turns: DataFrame) -> DataFrame:
    """A row for each (conversation, run of turn numbers): its text without the first header, and its mask."""
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / SHARD_TURNS).alias("shard"),
        F.struct("turn", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id", "shard").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # What stands before each text: nothing for the first, else a separator or the next block's header.
    lead = F.transform(
        "ts",
        lambda t, i: F.when(i == 0, F.lit(""))
        .when(F.get("ts", i - 1)["role"] == t["role"], F.lit(TURN))
        .otherwise(F.concat(F.lit(END + BEGIN + HEAD), t["role"], F.lit(BODY))),
    )
    led = sorted_turns.withColumn("leads", lead)
    pieces = F.zip_with("leads", "ts", lambda a, t: F.struct(F.char_length(a).alias("lead"), F.char_length(t["text"]).alias("len"), (t["role"] == "assistant").alias("loss")))
    run = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["lead"] + p["len"]).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).cast("long").alias("start"), p["len"].cast("long").alias("len"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return led.withColumn("pieces", pieces).select(
        "conv_id",
        "shard",
        F.get("ts", F.lit(0))["role"].alias("head_role"),
        F.element_at("ts", -1)["role"].alias("tail_role"),
        F.array_join(F.zip_with("leads", "ts", lambda a, t: F.concat(a, t["text"])), "").alias("body"),
        run["spans"].alias("spans"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (string), loss_spans (array of start and length in code points of `formatted`)."""
    whole = _shards(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("shard", "head_role", "tail_role", "body", "spans"))).alias("ss"))
    header = lambda role: F.concat(F.lit(BEGIN + HEAD), role, F.lit(BODY))
    lead = F.transform(
        "ss",
        lambda s, i: F.when(i == 0, header(s["head_role"]))
        .when(F.get("ss", i - 1)["tail_role"] == s["head_role"], F.lit(TURN))
        .otherwise(F.concat(F.lit(END), header(s["head_role"]))),
    )
    led = whole.withColumn("leads", lead)
    starts = F.aggregate(
        F.zip_with("leads", "ss", lambda a, s: F.struct(F.char_length(a).cast("long").alias("lead"), F.char_length(s["body"]).cast("long").alias("len"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, p: F.struct((acc["at"] + p["lead"] + p["len"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + p["lead"])).alias("starts")),
    )["starts"]
    led = led.withColumn("starts", starts)
    return led.select(
        "conv_id",
        F.concat(F.array_join(F.zip_with("leads", "ss", lambda a, s: F.concat(a, s["body"])), ""), F.lit(END)).alias("formatted"),
        F.flatten(F.zip_with("ss", "starts", lambda s, at: F.transform(s["spans"], lambda x: F.struct((x["start"] + at).alias("start"), x["len"].alias("len"))))).alias("loss_spans"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns as they stand in `formatted`, unescaped: adds turns array<struct<role,text>>."""
    blocks = F.transform(
        F.slice(F.split("formatted", F.lit(END)), 1, F.size(F.split("formatted", F.lit(END))) - 1),
        lambda b: F.split(F.substr(b, F.lit(len(BEGIN + HEAD) + 1)), r" \[/INST\]", 2),
    )
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(b[1], r"\[TURN\]"), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text")))))
    return formatted.withColumn("turns", turns)


def read_loss(formatted: DataFrame) -> DataFrame:
    """All text under the mask, unescaped: adds loss_text. UTF-32 makes each span a direct slice of the bytes."""
    wide = formatted.withColumn("wide", F.encode("formatted", "UTF-32"))
    parts = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring("wide", (4 * s["start"] + 1).cast("int"), (4 * s["len"]).cast("int")), "UTF-32")))
    return wide.withColumn("loss_text", F.array_join(parts, "")).drop("wide")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = read_loss(read_turns(format_conversations(turns.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '[TURN]', ''))) // 6 AS esc_len,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(esc_len + CASE WHEN before = role THEN 6 ELSE length(role) + 22 END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
