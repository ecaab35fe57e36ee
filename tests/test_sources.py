from pyspark.sql import functions as F

from skerry.operators import chunking
from skerry.sources import readers, sinks
from skerry.streaming import crawl


def test_chunk_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "text": "x"}\n\nnot json\n{"chunk_id": "b"}\n')
    rows = readers.chunk_lines(spark, str(tmp_path / "c.jsonl"))
    assert sorted(r.chunk_id for r in rows.collect()) == ["a", "b"]
    out = str(tmp_path / "out")
    sinks.chunk_lines(rows.withColumn("topic", F.lit("")), out)
    assert "topic" not in "".join(r.value for r in spark.read.text(out).collect())


def test_csv_documents(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n,\nc,d\n")
    r = readers.csv_documents(spark, str(tmp_path / "d.csv")).first()
    assert (r.extracted_text, r.page_count) == ("a | b\nc | d", 3)


def test_decoded_tables(spark):
    rows = spark.createDataFrame([('["h"]', '[["r"]]'), ("bad", '[["r"]]')], "headers string, rows string")
    assert [(r["headers"], r["rows"]) for r in readers.decoded_tables(rows).collect()] == [(["h"], [["r"]]), ([], [])]


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a<", "T", "l", "u", {"text": "x" * 600, "k": 'q"&'}, "t")], "node_id string, node_type string, label string, source_url string, attributes map<string,string>, text string")
    edges = spark.createDataFrame([("a<", "b", "R", {"w": "1"})], "source_id string, target_id string, relation_type string, attributes map<string,string>")
    sinks.graphml(nodes, edges, str(tmp_path / "g"))
    n, e = readers.graphml(spark, str(tmp_path / "g"))
    a = n.first().attributes
    assert n.first().node_id == "a<" and a["k"] == 'q"&' and len(a["text"]) == 501
    assert e.first().attributes == {"w": "1"}
    sinks.node_link(nodes, edges, str(tmp_path / "l"))
    sinks.statements(nodes, edges, str(tmp_path / "s"))
    import json
    import xml.etree.ElementTree as ET

    (file,) = (tmp_path / "l").glob("part-*.txt")
    whole = json.loads(file.read_text())
    assert [n["id"] for n in whole["nodes"]] == ["a<"] and whole["links"][0]["target"] == "b"
    (file,) = (tmp_path / "g").glob("part-*.txt")
    assert [e.tag.split("}")[1] for e in ET.fromstring(file.read_text())] == ["key", "key", "key", "graph"]
    sinks.node_link(nodes.limit(0), edges.limit(0), str(tmp_path / "none"))
    assert [x.count() for x in readers.node_link(spark, str(tmp_path / "none"))] == [0, 0]


def test_upsert_and_export(spark, tmp_path):
    old = spark.createDataFrame([("u", 1, "x"), ("v", 2, "y")], "url string, id int, t string")
    sinks.upsert(str(tmp_path / "t"), spark.createDataFrame([("u", 3, "z")], "url string, id int, t string"), old, ["url"], "id")
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.url, r.t) for r in rows.collect()} == {("u", "z"), ("v", "y")}
    sinks.export(rows, str(tmp_path / "e"), ["id", "t"], kind="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2


def test_seeds(spark):
    assert [(r.url, r.depth) for r in readers.seeds(spark, ["a", "b", "a"]).collect()] == [("a", 0), ("b", 0)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "https://h/a#x", "pending", "2024-01-01 00:00:00"), (2, "https://h/a", "Pending", "2024-01-01 00:10:00"), (3, "https://h/b", "visited", "2024-01-01 02:00:00")], "id int, url string, status string, t string").withColumn("added_at", F.to_timestamp("t").cast("timestamp_ntz")).drop("t")
    rows.write.parquet(str(tmp_path / "q"))
    for name, f in (("seen", crawl.first_seen), ("counts", crawl.status_counts)):
        q = f(crawl.queue_stream(spark, str(tmp_path / "q"), rows.schema)).writeStream.format("memory").queryName(name).outputMode("append" if name == "seen" else "complete").start()
        q.processAllAvailable()
        q.stop()
    assert {r.target for r in spark.table("seen").collect()} == {"https://h/a", "https://h/b"}
    assert {(r.status, r.n) for r in spark.table("counts").collect()} == {("pending", 2), ("visited", 1)}


def test_cleaned_chunks(spark):
    rows = spark.createDataFrame([("a", "?php x; The data are here and they are long enough"), ("b", "short"), ("c", None)], "chunk_id string, text string")
    assert [r.chunk_id for r in chunking.cleaned(rows).collect()] == ["a"]
