"""python -m skerry report|chunks|graph|search FOLDER [OUT or QUESTION]: the pipelines over a folder of Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as rl
from .operators import chunking, dedup, entities, graph, reports, retrieval
from .sources import sinks
from .sources.readers import table


def missions_of(hierarchy: DataFrame) -> rl.Rules:
    """Rules for the missions of a hierarchy table, which is a dimension of few rows."""
    rows = hierarchy.select("mission_slug").filter("mission_slug is not null").distinct().orderBy("mission_slug").collect()
    return tuple((r[0], (r[0], r[0].replace("-", ""))) for r in rows)


def knowledge_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    hierarchy, pages = table(spark, folder, "mission_hierarchy"), table(spark, folder, "pages")
    missions = missions_of(hierarchy)
    nodes, edges, failed = entities.extract_all(
        [
            ("missions", lambda: (entities.mission_nodes(hierarchy, reports.section_texts(hierarchy, pages)), None)),
            ("sections", lambda: entities.section_nodes(hierarchy, pages)),
            ("products", lambda: (entities.product_nodes(pages.filter("page_type = 'open_data'")), None)),
            ("faqs", lambda: (entities.faq_nodes(table(spark, folder, "faqs")), None)),
            ("documents", lambda: entities.document_nodes(table(spark, folder, "site_documents"), missions)),
        ]
    )
    return *graph.build(nodes, edges), failed


def all_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the graph's nodes and, in full, of the documents."""
    nodes, _, _ = knowledge_graph(spark, folder)
    names = nodes.select("node_id", "node_type", "label", "source_url")
    short = chunking.chunk_rows(nodes.filter(F.length(F.trim("text")) >= 20), "node_id", "text")
    files = table(spark, folder, "site_documents").filter(F.col("extraction_ok") & (F.length(F.trim("extracted_text")) >= 200))
    files = files.withColumn("node_id", F.concat(F.lit("doc:"), F.col("url_hash")))
    full = chunking.chunk_rows(dedup.last_write(files, ["node_id"], "id"), "node_id", "extracted_text", mark="full")
    return short.unionByName(full).join(names, "node_id")


def main() -> None:
    parser = argparse.ArgumentParser(prog="skerry", description=__doc__)
    parser.add_argument("mode", choices=("report", "chunks", "graph", "search"))
    parser.add_argument("folder")
    parser.add_argument("what", nargs="?", default="")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("skerry").getOrCreate()
    if args.mode == "report":
        reports.summary({n: table(spark, args.folder, n) for n in ("pages", "site_documents", "faqs", "crawl_queue", "text_chunks")}).show()
        reports.counts_by(table(spark, args.folder, "crawl_queue"), "status").orderBy("status").show()
        reports.hierarchy_stats(table(spark, args.folder, "mission_hierarchy")).orderBy("mission_slug").show(100)
    elif args.mode == "chunks":
        sinks.chunk_lines(all_chunks(spark, args.folder), args.what)
    elif args.mode == "graph":
        nodes, edges, failed = knowledge_graph(spark, args.folder)
        sinks.node_link(nodes, edges, f"{args.what}/node_link")
        sinks.graphml(nodes, edges, f"{args.what}/graphml")
        sinks.statements(nodes, edges, f"{args.what}/statements")
        print("extractors that failed:", ", ".join(failed) or "none")
    else:
        chunks = chunking.cleaned(table(spark, args.folder, "text_chunks")).withColumn("seq", F.col("chunk_id"))
        retrieval.keyword_search(chunks, args.what).select("chunk_id", "hits", "source_url", F.substring("text", 1, 200).alias("text")).show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
