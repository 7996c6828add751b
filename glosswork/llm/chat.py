"""Chat formatting: cumulative-snapshot collapse, then rendering.

Logs that store a conversation again after every turn hold many conversations that are
prefixes of a longer one. Each turn prefix gets a rolling hash, md5 of the hash so far,
the role and the text. A conversation whose last hash is an inner hash of another one is
dropped by an anti-join; of equal conversations the one with the least conv_id stays.
What is left is rendered with role markers.

DataFrame functions only. The turns of one conversation must fit into one row.

Rows: turns are ordered by turn, then role and text; exactly repeated rows of a
conversation count once. A null role or text counts as empty; a null turn comes last. A row
with a null conv_id belongs to no conversation known: it is a conversation of one turn by
itself (so such rows are never gathered), and the last choice among equal ones. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render(turns: Column) -> Column:
    """The text of an array of turns. Markers inside a text are broken up by a space, so that no text can open a turn."""

    def plain(x: Column) -> Column:
        return F.replace(x, F.lit("<|im_"), F.lit("<| im_"))

    return F.array_join(
        F.transform(
            turns, lambda t: F.concat(F.lit(OPEN), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(CLOSE), F.lit("\n"))
        ),
        "",
    )


def prefix_hashes(turns: Column) -> Column:
    """The rolling hash after each turn."""

    def step(hashes: Column, t: Column) -> Column:
        # the length of the role keeps role and text apart
        link = F.concat(F.coalesce(F.try_element_at(hashes, F.lit(-1)), F.lit("")), F.char_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])
        return F.concat(hashes, F.array(F.md5(link)))

    return F.aggregate(turns, F.array().cast("array<string>"), step)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of structs) and n_copies of the conversations that no other one continues."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known, lone = F.col("conv_id").isNotNull(), F.col("conv_id").isNull()
    whole = turns.where(known).groupBy("conv_id").agg(F.array_sort(F.collect_set(row)).alias("turns"))
    whole = whole.unionByName(turns.where(lone).select("conv_id", F.array(row).alias("turns")))
    whole = cut(whole.withColumn("hashes", prefix_hashes(F.col("turns"))).withColumn("_row", F.monotonically_increasing_id()))
    last = whole.select("_row", "conv_id", F.element_at("hashes", -1).alias("h"))
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "_row"))
    distinct = last.groupBy("h").agg(first.alias("first"), F.count("*").alias("n_copies"))
    inner = whole.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("h")).distinct()
    kept = distinct.join(inner, "h", "left_anti").select(F.col("first._row").alias("_row"), "n_copies")
    return whole.join(kept, "_row").select("conv_id", "turns", "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat of every maximal conversation."""
    return maximal_conversations(turns).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("chat"))


def op8(spark, sf_dir: str) -> DataFrame:
    """All maximal conversations of the conversations table, rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_')
                    || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL
  SELECT NULL, 1, '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_')
                  || '<|im_end|>' || chr(10)
  FROM conversations WHERE conv_id IS NULL
), d AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies, chat FROM c GROUP BY chat
)
SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS l WHERE l.n_turns > d.n_turns AND starts_with(l.chat, d.chat))
"""
