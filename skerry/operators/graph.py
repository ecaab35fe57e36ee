"""A property graph as two tables: nodes(node_id, node_type, label, source_url, attributes, text, seq), edges(source_id, target_id, relation_type, attributes, seq).

Attributes are map<string,string>. Node and edge order is carried by seq, unique in each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ready_to_checkpoint
from . import dedup


def flat_attributes(**values: Column) -> Column:
    """A map of the values that are not null: lists joined by '; ', booleans as True and False, others as text."""
    entries = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in values.items())))
    return F.map_from_entries(entries)


def boolean_text(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False")


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes once each, edges between known nodes, one an ordered pair. Both are written once, as each is used more than once."""
    ready_to_checkpoint(nodes.sparkSession)
    kept = dedup.longest_first(nodes, "node_id", "text", "seq").checkpoint()
    return kept, merged(valid_edges(edges, kept).checkpoint())


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("node_id").distinct()
    a = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    return a.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def dropped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is missing."""
    ids = nodes.select("node_id").distinct()
    no_source = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    has = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    no_target = has.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return no_source.unionByName(no_target)


def merged(edges: DataFrame) -> DataFrame:
    """One edge an ordered pair: later edges overwrite relation and attributes key by key, the first gives the place.

    Attributes are merged by rows, a pair and key at a time, so a pair with very many edges is no group in memory.
    """
    place = edges.groupBy("source_id", "target_id").agg(F.max_by("relation_type", "seq").alias("relation_type"), F.min("seq").alias("seq"), F.count("*").alias("times"))
    values = edges.select("source_id", "target_id", "seq", F.explode_outer("attributes").alias("key", "value")).filter("key is not null")
    last = values.groupBy("source_id", "target_id", "key").agg(F.max_by("value", "seq").alias("value"))
    maps = last.groupBy("source_id", "target_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    return place.join(maps, ["source_id", "target_id"], "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id)


def neighbours(edges: DataFrame, nodes: DataFrame, node_id: str, relation: str | None = None) -> DataFrame:
    """The ends of a node's outgoing edges, with their label and relation."""
    out = edges.filter(F.col("source_id") == node_id)
    if relation:
        out = out.filter(F.col("relation_type") == relation)
    return out.join(nodes.select(F.col("node_id").alias("target_id"), "label", "node_type"), "target_id", "left").select("target_id", "relation_type", "label", "node_type")


def by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.filter(F.col("node_type") == node_type)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def property_map(attributes: Column, size: int = 2000) -> Column:
    """{key: 'value', ...} in the map's order; values are cut to a size before they are escaped, nulls left out."""
    entries = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull())
    parts = F.transform(entries, lambda e: F.concat(F.regexp_replace(e["key"], "[^a-zA-Z0-9_]", "_"), F.lit(": '"), escaped(F.substring(e["value"], 1, size)), F.lit("'")))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def node_statements(nodes: DataFrame) -> DataFrame:
    """(node_id, statement): an upsert of each node."""
    kind = F.regexp_replace("node_type", "[^a-zA-Z0-9]", "")
    text = F.concat(F.lit("MERGE (n:"), kind, F.lit(" {node_id: '"), escaped(F.col("node_id")), F.lit("'})\nSET n += "), property_map(F.col("attributes")), F.lit(";"))
    return nodes.select("node_id", text.alias("statement"))


def edge_statements(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, statement): an upsert of each edge."""
    kind = F.regexp_replace(F.upper(F.coalesce("relation_type", F.lit("RELATED_TO"))), "[^A-Z0-9_]", "_")
    props = F.when(F.size("attributes") > 0, F.concat(F.lit(" "), property_map(F.col("attributes")))).otherwise("")
    text = F.concat(F.lit("MATCH (a {node_id: '"), escaped(F.col("source_id")), F.lit("'}), (b {node_id: '"), escaped(F.col("target_id")), F.lit("'})\nMERGE (a)-[:"), kind, props, F.lit("]->(b);"))
    return edges.select("source_id", "target_id", text.alias("statement"))


def constraint_statements(nodes: DataFrame) -> DataFrame:
    kinds = nodes.select(F.regexp_replace("node_type", "[^a-zA-Z0-9]", "").alias("kind")).distinct()
    return kinds.select("kind", F.concat(F.lit("CREATE CONSTRAINT IF NOT EXISTS FOR (n:"), F.col("kind"), F.lit(") REQUIRE n.node_id IS UNIQUE;")).alias("statement"))
