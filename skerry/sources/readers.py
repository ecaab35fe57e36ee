"""Tables from files: Parquet, delimited text, JSON lines, graphs, raw documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = "chunk_id string, node_id string, node_type string, label string, source_url string, chunk_index int, total_chunks int, text string, char_count int, mission_slug string, section_type string, category string, topic string, doc_type string, orbit_type string, doc_source string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """A chunk file of JSON lines; blank and malformed lines are skipped."""
    rows = spark.read.schema(CHUNK_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record is null and chunk_id is not null").drop("_corrupt_record") if "_corrupt_record" in rows.columns else rows


def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, extracted_text, page_count): delimited files as text, cells joined by ' | ', blank rows dropped; page_count counts all rows."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))

    @F.pandas_udf("struct<extracted_text:string,page_count:int>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        import csv
        import io

        out = []
        for t in texts:
            rows = list(csv.reader(io.StringIO(t or "")))
            out.append(("\n".join(" | ".join(r) for r in rows if any(c.strip() for c in r)), len(rows)))
        return pd.DataFrame(out, columns=["extracted_text", "page_count"])

    return files.select("path", parse("value").alias("x")).select("path", "x.*")


def raw_documents(spark: SparkSession, path: str, most_mb: int = 50) -> DataFrame:
    """(path, bytes, file_size_kb) of files up to a size, unread beyond it."""
    rows = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_mb * 1024 * 1024)
    return rows.select("path", F.col("content").alias("bytes"), F.round(F.col("length") / 1024, 2).alias("file_size_kb"))


def string_arrays(text: str) -> T.ArrayType:
    return F.coalesce(F.from_json(text, "array<array<string>>"), F.array().cast("array<array<string>>"))


def decoded_tables(tables: DataFrame) -> DataFrame:
    """Extracted tables whose headers and rows are JSON text; if either is bad, both are empty."""
    h, r = F.from_json("headers", "array<string>"), F.from_json("rows", "array<array<string>>")
    bad = h.isNull() | r.isNull()
    return tables.withColumns({"headers": F.when(bad, F.array().cast("array<string>")).otherwise(h), "rows": F.when(bad, F.array().cast("array<array<string>>")).otherwise(r)})


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node_id, node_type, label, source_url, attributes, text) and (source_id, target_id, relation_type, attributes) of a node-link document, whichever way it is laid out."""
    node = "array<struct<id:string,node_type:string,label:string,source_url:string,attributes:map<string,string>,text:string>>"
    link = "array<struct<source:string,target:string,relation_type:string,attributes:map<string,string>>>"
    data = spark.read.schema(f"nodes {node}, links {link}").option("multiLine", True).json(path)
    nodes = data.select(F.inline("nodes")).withColumnRenamed("id", "node_id")
    return nodes, data.select(F.inline("links")).withColumnsRenamed({"source": "source_id", "target": "target_id"})


def by_url(df: DataFrame, url: str, column: str = "url") -> DataFrame:
    """The rows of one url, by a filter that reaches the scan."""
    return df.filter(F.col(column) == url)


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node_id, attributes) and (source_id, target_id, attributes) of a GraphML folder or file, one element a line as written by the sink."""
    lines = spark.read.text(path).select("value")
    kind = "struct<kind:string,a:string,b:string,attributes:map<string,string>>"

    @F.pandas_udf(kind)
    def parse(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            v = v.strip()
            if not v.startswith(("<node", "<edge")):
                out.append((None, None, None, None))
                continue
            e = ET.fromstring(v)
            data = {d.get("key"): d.text or "" for d in e.iter("data")}
            out.append(("node", e.get("id"), None, data) if e.tag == "node" else ("edge", e.get("source"), e.get("target"), data))
        return pd.DataFrame(out, columns=["kind", "a", "b", "attributes"])

    rows = lines.select(parse("value").alias("x")).select("x.*").filter("kind is not null")
    nodes = rows.filter("kind = 'node'").select(F.col("a").alias("node_id"), "attributes")
    return nodes, rows.filter("kind = 'edge'").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "attributes")


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    """A crawl queue of seed URLs at depth 0."""
    rows = [(i + 1, u, "pending", 0) for i, u in enumerate(dict.fromkeys(urls))]
    return spark.createDataFrame(rows, "id long, url string, status string, depth int")
