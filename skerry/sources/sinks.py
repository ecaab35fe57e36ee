"""Tables to files: Parquet, JSON, delimited text, JSON lines, graph formats, statements.

Tables and lines are written in parallel, a file a task; graph documents, which must be one
file to be read elsewhere, are made in parallel and written line by line by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, graph


def upsert(path: str, new: DataFrame, old: DataFrame | None, keys: Sequence[str], seq: str) -> None:
    """Write old and new rows, the latest of each key; path must not be the place of old."""
    every = new if old is None else old.unionByName(new, allowMissingColumns=True)
    dedup.last_write(every, keys, seq).write.mode("overwrite").parquet(path)


def export(df: DataFrame, path: str, columns: Sequence[str] = (), order: str = "id", kind: str = "json") -> None:
    """JSON lines, or delimited text with a header, sorted by a column."""
    rows = (df.select(*columns) if columns else df).orderBy(order)
    if kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def chunk_lines(chunks: DataFrame, path: str, optional: Sequence[str] = ("mission_slug", "section_type", "category", "topic", "doc_type", "orbit_type", "doc_source")) -> None:
    """Chunks as JSON lines; optional keys are left out where they are empty."""
    names = [c for c in optional if c in chunks.columns]
    chunks.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in names}).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def statements(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Constraints, nodes and edges as statements of a graph query language, a folder each."""
    graph.constraint_statements(nodes).select("statement").orderBy("statement").write.mode("overwrite").text(f"{path}/constraints")
    graph.node_statements(nodes).select("statement").write.mode("overwrite").text(f"{path}/nodes")
    graph.edge_statements(edges).select("statement").write.mode("overwrite").text(f"{path}/edges")


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _data(attributes: Column, size: int | None = None) -> Column:
    def one(e: Column) -> Column:
        value = F.coalesce(e["value"], F.lit(""))
        if size:
            value = F.when((e["key"] == "text") & (F.length(value) > size), F.concat(F.substring(value, 1, size), F.lit("…"))).otherwise(value)
        return F.concat(F.lit('<data key="'), _xml(e["key"]), F.lit('">'), _xml(value), F.lit("</data>"))

    return F.array_join(F.transform(F.map_entries(attributes), one), "")


def _document(parts: Sequence[DataFrame], path: str) -> None:
    """Lines in order as one text file: range-partitioned and sorted by part and line in the cluster, then written in one task that holds a line at a time."""
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    lines.repartitionByRange("part", "n", "value").sortWithinPartitions("part", "n", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def _line(spark: SparkSession, part: int, text: str) -> DataFrame:
    return spark.createDataFrame([(part, 0, text)], "part int, n long, value string")


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML document: declarations of all keys, nodes, edges; texts cut to 500 characters."""
    spark = nodes.sparkSession

    def keys(df: DataFrame, of: str, part: int) -> DataFrame:
        names = df.select(F.explode(F.map_keys("attributes")).alias("k")).distinct()
        return names.select(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("n"), F.concat(F.lit('<key id="'), _xml(F.col("k")), F.lit(f'" for="{of}" attr.name="'), _xml(F.col("k")), F.lit('" attr.type="string"/>')).alias("value"))

    n = nodes.select(F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("n"), F.concat(F.lit('<node id="'), _xml(F.col("node_id")), F.lit('">'), _data(F.col("attributes"), 500), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(5).alias("part"), F.lit(0).cast("bigint").alias("n"), F.concat(F.lit('<edge source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('">'), _data(F.col("attributes")), F.lit("</edge>")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    _document([_line(spark, 0, head), keys(nodes, "node", 1), keys(edges, "edge", 2), _line(spark, 3, '<graph edgedefault="directed">'), n, e, _line(spark, 6, "</graph></graphml>")], path)


def node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A node-link document: one JSON object with nodes and links, one of them a line."""
    spark = nodes.sparkSession

    def items(df: DataFrame, part: int) -> DataFrame:
        # a comma leads each item but the first
        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
        least = rows.agg(F.min("json").alias("least"))
        lead = F.when(F.col("json") == F.col("least"), "").otherwise(",")
        return rows.dropDuplicates(["json"]).join(F.broadcast(least)).select(F.lit(part).alias("part"), F.when(F.col("json") == F.col("least"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("n"), F.concat(lead, "json").alias("value"))

    n = items(nodes.select(F.col("node_id").alias("id"), "node_type", "label", "source_url", "attributes", "text"), 1)
    e = items(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation_type", "attributes"), 3)
    _document([_line(spark, 0, '{"directed": true, "multigraph": false, "graph": {}, "nodes": ['), n, _line(spark, 2, '], "links": ['), e, _line(spark, 4, "]}")], path)


def append(df: DataFrame, path: str, clock: str = "") -> None:
    """Add rows to a table; clock names a column that takes the time of writing."""
    (df.withColumn(clock, F.current_timestamp()) if clock else df).write.mode("append").parquet(path)
