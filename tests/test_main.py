from pyspark.sql import functions as F

from skerry import __main__ as main

SF = "/root/testdata/sf0.001"


def test_graph_and_chunks(spark):
    nodes, edges, failed = main.knowledge_graph(spark, SF)
    assert failed == [] and {"Mission", "FAQ", "Document"} <= {r.node_type for r in nodes.select("node_type").distinct().collect()}
    ids = {r.node_id for r in nodes.select("node_id").collect()}
    assert all(r.source_id in ids and r.target_id in ids for r in edges.collect())
    chunks = main.all_chunks(spark, SF)
    assert chunks.filter(F.length("text") > 1500).count() == 0
    assert chunks.select("chunk_id").distinct().count() == chunks.count() > 0
