import random

from pyspark.sql import functions as F

from skerry.functions import rules as rl
from skerry.operators import chunking as ck
from skerry.operators import conversation as cv
from skerry.operators import dedup as dd
from skerry.operators import entities as en
from skerry.operators import frontier as fr
from skerry.operators import graph as gr
from skerry.operators import reports as rp
from skerry.operators import retrieval as rt
from skerry.operators import vector_index as vx


def split_plainly(text, size=1500, overlap=200, least=20):
    text = text.strip()
    if not text:
        return []
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while True:
        window = text[at : at + size]
        if at + size >= len(text):
            out.append(window)
            break
        cut = window.rfind("\n\n")
        if cut <= size // 2:
            cut = next((p + 1 for p in (window.rfind(s) for s in (". ", "? ", "! ", "\n")) if p > size // 2), size)
        out.append(window[:cut])
        at += cut - overlap
    return [p.strip() for p in out if len(p.strip()) > least]


def test_split_text(spark):
    rng = random.Random(3)
    words = ["alpha", "beta.", "gamma?", "delta!", "\n", "\n\n", "epsilon", "é" * 9]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 5, 150, 400, 900, 1500)] + ["x" * 1500, "x" * 1501, "x" * 4000, "a" * 800 + "\n\n" + "b" * 900, "a" * 700 + "\n\n" + "b" * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in rows.select("i", ck.split_text(F.col("t")).alias("p")).collect()}
    assert all(got[i] == split_plainly(t) for i, t in enumerate(texts))


def test_chunk_rows_and_null(spark):
    rows = spark.createDataFrame([(1, None, "k"), (2, "short", "k")], "id int, t string, chunk_id string")
    assert [(r.id, r.chunk_id, r.total_chunks, r.text) for r in ck.chunk_rows(rows, "id", "t").collect()] == [(2, "2:0", 1, "short")]


def test_writes(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in dd.first_write(rows, ["k"], "seq").collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v) for r in dd.last_write(rows, ["k"], "seq").collect()} == {("a", "y"), ("b", "z")}
    assert dd.last_write(rows.limit(0), ["k"], "seq").count() == 0


def test_longest_keeps_the_earliest_of_ties(spark):
    rows = spark.createDataFrame([("n", "aa", 1), ("n", "bb", 2), ("n", "c", 0)], "node_id string, text string, seq int")
    r = dd.longest_first(rows, "node_id", "text", "seq").collect()
    assert [(x.text, x.pos) for x in r] == [("aa", 0)]


def test_breadth_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in fr.breadth_first(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_queue(spark):
    q = spark.createDataFrame([(1, "https://h/internal/x", "pending", 1), (2, "https://h/a.pdf", "pending", 0), (3, "https://h/p", "pending", 5), (4, "https://h/q", "visited", 0), (5, "https://h/ajax/z", "pending", 0)], "id int, url string, status string, depth int")
    assert [r.id for r in fr.next_pending(q, 2).collect()] == [2, 5]
    assert {r.id: r.action for r in fr.with_action(q).collect()} == {1: "skip_login", 2: "document", 3: "skip_depth", 4: "page", 5: "skip_ajax"}


def test_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", "R", {"x": "1", "y": "1"}, 1), ("a", "b", "S", {"y": "2"}, 2), ("a", "z", "R", {}, 3), ("z", "b", "R", {}, 4)], "source_id string, target_id string, relation_type string, attributes map<string,string>, seq int")
    assert gr.valid_edges(edges, nodes).count() == 2 and gr.dropped_edges(edges, nodes).count() == 2
    m = gr.merged(gr.valid_edges(edges, nodes)).collect()
    assert [(r.relation_type, r.seq, r.attributes) for r in m] == [("S", 1, {"x": "1", "y": "2"})]


def test_statements(spark):
    nodes = spark.createDataFrame([("n'1", "My Type", {"a-b": "it's \\ x", "t": "y" * 3000})], "node_id string, node_type string, attributes map<string,string>")
    s = gr.node_statements(nodes).first().statement
    assert s.startswith("MERGE (n:MyType {node_id: 'n\\'1'})\nSET n += {") and "a_b: 'it\\'s \\\\ x'" in s and s.count("yy") == 1000


def test_payload_tables(spark):
    rows = spark.createDataFrame(
        [("https://h/m-1-payloads", 0, ["Name", "Swath", "Orbit type"], [["I1", "10 km", "x"], ["", "", ""], ["I2", "", ""]]), ("https://h/m-1-payloads", 1, ["Attribute", "Value"], [["Channels", "19"], ["Channels", "20"], ["Instrument", "I3"]])],
        "source_url string, table_index int, headers array<string>, rows array<array<string>>",
    )
    nodes, edges = en.payload_nodes(rows, (("m-1", ("m-1",)),))
    got = {r.node_id: r.attributes for r in nodes.collect()}
    assert set(got) == {"payload:m-1:i1", "payload:m-1:i2", "payload:m-1:i3"}
    assert got["payload:m-1:i1"] == {"payload_name": "I1", "swath": "10 km", "payload_type": "x", "mission_slug": "m-1"} and got["payload:m-1:i3"]["channels"] == "20"
    assert edges.count() == 3


def test_failing_extractor_is_left_out(spark):
    n = spark.createDataFrame([("a",)], "node_id string")

    def bad():
        raise ValueError

    nodes, edges, failed = en.extract_all([("good", lambda: (n, n)), ("bad", bad)])
    assert nodes.count() == 1 and edges.count() == 1 and failed == ["bad"]


def test_search_cuts_before_it_groups(spark):
    rows = spark.createDataFrame([(i, [1.0 - i / 100, 0.0], 0 if i < 8 else i) for i in range(20)], "vec_id long, embedding array<float>, label int")
    got = vx.search(rows, [1.0, 0.0], k=2, least=0.0).collect()
    assert [(r.vec_id, r.label) for r in got] == [(0, 0)]


def test_cells_reach_exact_recall(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.gauss(c, 0.2) for c in ((i % 8) * 3.0, (i % 5) * 2.0, 1.0)], i % 3) for i in range(400)], "vec_id long, embedding array<float>, label int")
    rows = vx.normalised(rows)
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vx.top_k_each(rows, queries, 5).collect()}
    near = {(r.query_id, r.vec_id) for r in vx.build_cells(rows, 8).search(queries, 5, 6).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(1, "a" * 3000), (2, ""), (3, "b" * 900), (4, "c" * 200), (5, "d")], "rank int, text string")
    assert [r.rank for r in rt.within_budget(rows).orderBy("rank").collect()] == [1, 3]
    assert [r.rank for r in rt.within_budget(rows, 10).collect()] == [1]


def test_keyword_search(spark):
    rows = spark.createDataFrame([("c1", "sea ice map", "x", 1), ("c2", "ice", "sea map", 2), ("c3", "none", None, 3)], "chunk_id string, text string, label string, seq int")
    assert [(r.chunk_id, r.hits) for r in rt.keyword_search(rows, "Sea ice MAP of").collect()] == [("c1", 3), ("c2", 3)]


def test_keyword_search_each_keeps_chunks_apart(spark, tmp_path, monkeypatch):
    # a file has a size, queries from Python have none: by these Spark would broadcast the chunks' words
    rows = [(f"c{i:02}", " ".join(w for j, w in enumerate(("sea", "ice", "map", "Éire", "wave")) if (i * 7 + 3) >> j & 1), "wave" if i % 5 == 0 else None, i) for i in range(40)]
    spark.createDataFrame(rows, "chunk_id string, text string, label string, seq int").write.parquet(str(tmp_path / "chunks"))
    asked = [(0, "sea ICE sea of"), (1, "éire Wave map"), (2, "absent"), (3, "of"), (4, None)]
    want = {}
    for q, text in asked:
        said = {w for w in (text or "").lower().split() if len(w) > 2}
        hits = [(-len(said & {*f"{t} {label or ''}".lower().split()}), n, c) for c, t, label, n in rows]
        want |= {(q, c): (-h, r) for r, (h, n, c) in enumerate(sorted(x for x in hits if x[0])[:4], 1)}
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for joined in ("BuildRight", "SortMergeJoin"):
        found = rt.keyword_search_each(spark.read.parquet(str(tmp_path / "chunks")), queries, 4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert joined in plan and "BuildLeft" not in plan
        assert {(r.query_id, r.chunk_id): (r.hits, r["rank"]) for r in found.collect()} == want
        monkeypatch.setattr(rt, "WORD_BYTES", 0)
    assert rt.keyword_search_each(spark.read.parquet(str(tmp_path / "chunks")), queries.limit(0)).count() == 0


def test_question_kinds(spark):
    rows = spark.createDataFrame([("How to get data",), ("the sensor of the satellite",), ("",)], "q string")
    kinds = (("faq", ("how to",)), ("payload", ("sensor",)), ("mission", ("satellite",)))
    assert [r[0] for r in rows.select(rt.question_kind(F.col("q"), kinds)).collect()] == ["faq", "payload", "general"]


def test_rule_tables_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rl, "BLOCK", 2)
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None), (4, "delta beta")], "id int, t string")
    rules = spark.createDataFrame([(3, "alpha", "A"), (1, "beta", "B"), (2, "gamma", "G"), (0, "", "none"), (5, "delta", "D")], "seq int, keyword string, label string")
    assert {r.id: r.label for r in rl.matched_by_table(rows, "t", rules, "id").collect()} == {1: "B", 2: "G", 3: None, 4: "B"}
    assert rl.matched_by_table(rows, "t", rules.limit(0), "id").filter("label is null").count() == 4


def test_best_scores_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 9, (20, 300)).astype(float), rng.permutation(300)
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :7]
    assert (vx._top(scores, ids, 7) == want).all()


def test_index_is_kept(spark, tmp_path):
    rows = vx.normalised(spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "vec_id long, embedding array<float>"))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vx.build_index(rows).search(asked, 5).collect()}
    for name, index in (("cells", vx.build_index(rows, 100)), ("exact", vx.build_index(rows))):
        index.save(str(tmp_path / name))
        again = vx.load_index(spark, str(tmp_path / name))
        assert (again.centres is None) == (name == "exact")
        assert {(r.query_id, r.vec_id) for r in again.search(asked, 5, 10_000).collect()} == exact
    assert vx.build_cells(rows.limit(0)).search(asked, 5).count() == 0


def test_conversation(spark):
    h = spark.createDataFrame([(1, t, "user", str(t)) for t in range(21)], "conv_id int, turn int, role string, content string")
    assert sorted(r.turn for r in cv.tail(h).collect()) == list(range(1, 21))
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "conv_id int, question string")
    none = spark.createDataFrame([], "conv_id int, context string")
    got = {r.conv_id: r.messages for r in cv.messages(h, asked, none, 1).collect()}
    assert len(got[1]) == 3 and got[2][0].content == "<context>\nNo relevant context retrieved.\n</context>\n\nQuestion: r"


def test_counts_with_total(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "k string")
    assert {(r.kind, r.n) for r in rp.counts_with_total(rows, "k").collect()} == {("a", 2), ("Unknown", 2), ("TOTAL", 4)}
