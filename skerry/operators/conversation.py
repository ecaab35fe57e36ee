"""Conversation rows (conv_id, turn, role, content), prompts and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import urls

MAX_TURNS = 10
NOTHING = "No relevant context retrieved."


def tail(history: DataFrame, turns: int = MAX_TURNS) -> DataFrame:
    """The last 2 * turns rows of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return history.withColumn("_b", back).filter(F.col("_b") <= 2 * turns).drop("_b")


def turn_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("conv_id").agg(F.expr("count(*) div 2").alias("turns"))


def context_entry(number: Column) -> Column:
    """One chunk of a context block: its number, type, label, source and extras, then its text."""
    extras = F.concat_ws(", ", *(F.when(tx.text_or_empty(F.col(c)) != "", F.concat(F.lit(f"{name}: "), F.col(c))) for c, name in (("orbit_type", "Orbit"), ("section_type", "Section"), ("category", "Category"), ("doc_type", "Doc type"))))
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce("node_type", F.lit("Unknown")), F.lit(": "), tx.text_or_empty(F.col("label")))
    head = F.concat(head, F.when(tx.text_or_empty(F.col("source_url")) != "", F.concat(F.lit(" | Source: "), F.col("source_url"))).otherwise(""), F.when(extras != "", F.concat(F.lit(" | "), extras)).otherwise(""))
    return F.concat(head, F.lit("\n"), F.trim(tx.text_or_empty(F.col("text"))))


def context_blocks(chunks: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """(by, context): the numbered chunks of each group; groups are cut to a budget before, so they are small."""
    entries = chunks.select(by, F.struct(F.col(rank).alias("r"), context_entry(F.col(rank)).alias("e")).alias("x"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "\n\n")
    return entries.groupBy(by).agg(F.coalesce(F.nullif(block, F.lit("")), F.lit(NOTHING)).alias("context"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("<context>\n"), context, F.lit("\n</context>\n\nQuestion: "), question)


def messages(history: DataFrame, questions: DataFrame, contexts: DataFrame, turns: int = MAX_TURNS) -> DataFrame:
    """(conv_id, messages): the tail of each conversation and a user message with context and question.

    questions: conv_id, question. A conversation's tail is at most 2 * turns rows.
    """
    past = tail(history, turns).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("past"))
    rows = questions.join(contexts, "conv_id", "left").join(past, "conv_id", "left")
    now = F.struct(F.lit("user").alias("role"), prompt(F.coalesce("context", F.lit(NOTHING)), F.col("question")).alias("content"))
    return rows.select("conv_id", F.concat(F.coalesce("past", F.array().cast("array<struct<role:string,content:string>>")), F.array(now)).alias("messages"))


def source_rows(chunks: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """(by, rank, source): the distinct sources of each group in first-seen order, a path or a label with a bullet."""
    key = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("label", F.lit("")))
    short = F.regexp_replace(urls.path(F.col("source_url")), "/+$", "")
    line = F.when(tx.text_or_empty(F.col("source_url")) != "", F.coalesce(F.nullif(short, F.lit("")), F.col("source_url"))).otherwise(F.col("label"))
    rows = chunks.withColumn("_key", key).filter("_key is not null").groupBy(by, "_key").agg(F.min(F.struct(F.col(rank).alias("rank"), F.concat(F.lit("• "), line).alias("source"))).alias("x"))
    return rows.select(by, "x.rank", "x.source")


def source_lists(chunks: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    return source_rows(chunks, by, rank).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), "\n").alias("sources"))
