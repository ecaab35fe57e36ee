"""Counts and roll-ups for operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of a mission's sections in its roll-up; others come last.
SECTION_ORDER = ("landing", "introduction", "objectives", "spacecraft", "payloads", "references", "tools", "products")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def counts_with_total(df: DataFrame, column: str, missing: str = "Unknown", total: str = "TOTAL") -> DataFrame:
    """Counts by value and a row for all."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))
    rows = df.select(value.alias("kind")).rollup("kind").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("kind", F.lit(total)).alias("kind"), "n")


def hierarchy_stats(hierarchy: DataFrame) -> DataFrame:
    done = F.sum(F.when(F.col("crawl_status") == "done", 1).otherwise(0))
    return hierarchy.groupBy("mission_slug").agg(F.min("mission_name").alias("mission_name"), F.count("*").alias("total"), done.alias("done"), (F.count("*") - done).alias("pending"))


def section_rank(c: str = "section_type"):
    rank = F
    for i, name in enumerate(SECTION_ORDER):
        rank = rank.when(F.col(c) == name, i)
    return rank.otherwise(len(SECTION_ORDER) + 1)


def hierarchy_nested(hierarchy: DataFrame) -> DataFrame:
    """(mission_slug, mission_name, landing_url, sections): the sections of each mission in order, the landing page apart."""
    section = F.struct(section_rank().alias("rank"), F.col("id"), F.col("section_type"), F.col("section_title"), F.col("section_url"))
    landing = F.col("section_type") == "landing"
    rows = hierarchy.groupBy("mission_slug").agg(
        F.min("mission_name").alias("mission_name"),
        F.min(F.when(landing, F.col("section_url"))).alias("landing_url"),
        F.array_sort(F.collect_list(F.when(~F.coalesce(landing, F.lit(False)), section))).alias("sections"),
    )
    return rows.withColumn("sections", F.transform("sections", lambda s: F.struct(s["section_type"].alias("type"), s["section_title"].alias("title"), s["section_url"].alias("url"))))


def section_texts(hierarchy: DataFrame, pages: DataFrame, size: int = 3000, least: int = 20) -> DataFrame:
    """(mission_slug, text): the texts of each mission's sections in the order of id, each under its type, cut to a size.

    Sections join pages on their url (left), and only texts longer than least count. A
    mission's text is built from its sections' first size characters, so that no group
    holds whole texts.
    """
    page = pages.groupBy("url").agg(F.max_by(F.substring("content_text", 1, size), "id").alias("t"))
    rows = hierarchy.join(page, hierarchy.section_url == page.url, "left").withColumn("t", F.trim("t")).filter(F.length("t") > least)
    kind = F.upper(F.coalesce("section_type", F.lit("section")))
    part = F.struct(F.col("id"), F.concat(F.lit("["), kind, F.lit("]\n"), F.col("t")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "\n\n")
    return rows.groupBy("mission_slug").agg(F.substring(joined, 1, size).alias("text"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(chunks, chars, mean_chars) of a chunk table."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("char_count"), F.lit(0)).cast("bigint").alias("chars")).withColumn("mean_chars", F.expr("chars div greatest(chunks, 1)"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
