"""Chat formatting by prefix-target expansion, with DataFrame and SQL functions only.

Every assistant turn becomes an example of its own: all turns before it as context, only that reply under the
loss mask. A conversation that ends with other turns (or has no reply) gives one more example without a target,
so that the output holds every turn.

A conversation is rendered once, as one string with the offsets of its turns; an example is a prefix of that
string. One shuffle, by conversation; the examples are cut from it row by row afterwards, and never stand
together in memory.

Template of a turn: ``<s>`` role newline text ``</s>``. Inside roles and texts a backslash is doubled, and one
backslash is put after the first character of ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``; in roles a newline
is written as backslash n. Reading left to right undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The control strings that may not appear inside a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
END = "</s>"
_CONTROL_START = r"<(?=/?s>)|\[(?=/?INST\])"


def escape(c: Column) -> Column:
    """Text that holds no control string and can be turned back by ``unescape``."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _CONTROL_START, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), target_turn_no, text, loss_start, loss_chars, is_last.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Null text and null role are empty. Turns
    are ordered by turn (nulls first), then role, then text; repeated rows are turns of their own. Rows with a
    null conv_id form one conversation. ``loss_start`` counts code points from 0; ``loss_chars`` is 0 and
    target_turn_no null in an example without a target.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rendered = rows.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("<s>"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rendered.withColumn("end", F.sum(F.length("head") + F.length("body") + F.lit(len(END))).over(order))
    # The window and the grouping share one shuffle; ends grow with each turn, so sorting by them keeps the order.
    conv = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("end", "role", "head", "body"))).alias("t"))
    ends = conv.select(
        "conv_id",
        F.expr("transform(t, (x, i) -> struct(i AS i, x.role AS role, x.end - length(x.body) - 4 AS start, length(x.body) AS chars, x.end AS end))").alias("m"),
        F.expr(f"array_join(transform(t, x -> concat(x.head, x.body, '{END}')), '')").alias("stream"),
    )
    role = target_role.replace("\\", "\\\\").replace("'", "\\'")
    targets = ends.withColumn("cuts", F.expr(f"filter(m, x -> x.role = '{role}' OR x.i = size(m) - 1)"))
    cut = targets.select("conv_id", "stream", F.size("m").alias("n"), F.posexplode("cuts").alias("example", "c"))
    hit = F.col("c.role") == target_role
    return cut.select(
        "conv_id", "example",
        F.when(hit, F.col("c.i")).alias("target_turn_no"),
        F.expr("substring(stream, 1, CAST(c.end AS INT))").alias("text"),
        F.when(hit, F.col("c.start")).alias("loss_start"),
        F.when(hit, F.col("c.chars")).otherwise(0).alias("loss_chars"),
        (F.col("c.i") == F.col("n") - 1).alias("is_last"),
    )


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted example, as an array of structs."""
    head = lambda x: F.substring_index(x, "\n", 1)
    newline = lambda c: F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.transform(
        F.filter(F.split(text, END), lambda x: x != ""),
        lambda x: F.struct(unescape(newline(F.substr(head(x), F.lit(4)))).alias("role"), unescape(F.substr(x, F.length(head(x)) + 2)).alias("text")),
    )


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digest per conversation, read back from the formatted examples of all conversations and of conversation -7."""
    own = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (CAST(0 AS BIGINT), 'user'), (CAST(1 AS BIGINT), 'assistant') AS v(turn, role)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    ex = format_conversations(turns)
    loss = F.when(F.col("target_turn_no").isNotNull(), unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_chars"))))
    # What a row carries on is linear in the conversation: only its last example keeps the whole text.
    slim = ex.select("conv_id", "example", loss.alias("loss"), F.length("text").alias("chars"), F.when(F.col("is_last"), F.col("text")).alias("whole"))
    per = slim.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
    per = per.withColumn("turns", read_turns(F.col("whole"))).withColumn("loss", F.array_join(F.transform("loss", lambda x: x["loss"]), ""))
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT conv_id, turn, role, text,
         3 + length(replace(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), chr(10), '\n')) + 1
         + length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) + 4 AS chars
  FROM t),
r AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""
