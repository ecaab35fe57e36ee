"""Queries on small hand-made inputs, for what the tables don't hold; their SQL is the list of the rows that must come out, worked out by hand."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as ht
from ..operators import entities as en
from ..operators import frontier as fr
from ..operators import ingest as ig
from ..session import checkpoint_root
from ..sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOST = "https://h.example"
DOMAINS = ("h.example", "o.example")


def _literal(x: object) -> str:
    return "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def fixture(columns: str, *rows: tuple):
    """Register a query of one argument whose rows are these."""

    def register(f: Callable[[SparkSession], DataFrame]):
        QUERIES[f.__name__] = lambda s, _: f(s)
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({columns})"
        return f

    return register


def _pages(s: SparkSession, *pages: tuple[str, str]) -> DataFrame:
    return s.createDataFrame([(HOST + path, html) for path, html in pages], "url string, html string")


LINKS = """<!-- <a href="/commented">x</a> --><script>var s = '<a href="/scripted">';</script><a name="x">no</a>
<a href="c.html">1</a><a href='?p=2'>2</a><a href=/q/>3</a><a href="/z?a=1&amp;b=2">4</a><A HREF="//o.example/x#part">5</A>
<a title="a > b" href="../up">6</a><a href="#top">7</a><a href="#" onclick="open()">8</a><a href="/menu" onclick="toggle(); return false;">9</a>
<a href="mailto:x@h.example">10</a><a href=" /q ">11</a>"""


@fixture("url, target", *((f"{HOST}/a/b.html", x) for x in (f"{HOST}/a/c.html", f"{HOST}/a/b.html?p=2", f"{HOST}/q", f"{HOST}/z?a=1&b=2", "https://o.example/x", f"{HOST}/up")))
def fixture_links(s: SparkSession) -> DataFrame:
    return fr.links(_pages(s, ("/a/b.html", LINKS)), "html").select("url", "target")


@fixture("url, parent_url, depth", (f"{HOST}/q", f"{HOST}/a/b.html", 3), (f"{HOST}/up", f"{HOST}/a/b.html", 3), (f"{HOST}/z?a=1&b=2", f"{HOST}/a/b.html", 3), ("https://o.example/x", f"{HOST}/a/b.html", 3), (f"{HOST}/a/b.html?p=2", f"{HOST}/a/b.html", 3))
def fixture_discovered(s: SparkSession) -> DataFrame:
    pages = _pages(s, ("/a/b.html", LINKS)).withColumnRenamed("html", "content_html").withColumn("depth", F.lit(2))
    queue = s.createDataFrame([(f"{HOST}/a/c.html",)], "url string")
    return fr.discovered(pages, queue, DOMAINS).withColumn("depth", F.col("depth").cast("bigint"))


def _faq(question: str, answer: str) -> str:
    return f'<div class="faq-question-answer"><div class="faq-question"><span property="dc:title">{question}</span></div><div class="faq-answer"><div class="field-item even">{answer}</div></div></div>'


@fixture("source_url, question, answer", (f"{HOST}/faq", "How?", "Like this, in two parts."), (f"{HOST}/faq", "Why?", "Because it is so."))
def fixture_faqs(s: SparkSession) -> DataFrame:
    page = _faq("How?", "Like  this,<p>in two parts.</p><p><w:x>LsdException</w:x></p>") + _faq("HOW? ", "Again, in another way.") + _faq("Really?", "Yes.") + _faq("Why?", "Because it\nis so.") + _faq("", "No question at all.")
    return ig.faq_rows(_pages(s, ("/faq", page), ("/none", "<p>no pairs</p>"))).select("source_url", "question", "answer")


SECTIONS = (("introduction", ("introduction",)), ("payload", ("payload",)), ("objective", ("objective",)))


@fixture("source_url, title, url, section_type", (f"{HOST}/m-1", "Payloads", f"{HOST}/m-1-payloads", "payload"), (f"{HOST}/m-1", "Start", f"{HOST}/m-1-introduction", "introduction"), (f"{HOST}/m-2", "Objectives", f"{HOST}/m-2-objectives", "objective"))
def fixture_sections(s: SparkSession) -> DataFrame:
    menu = '<ul id="block-menu-menu-m-1-menu"><li><a href="/m-1-payloads">Payloads</a></li><li><a href="#x">here</a></li><li><a href="/m-1-introduction/">Start</a></li></ul><a href="/m-1-other">beside</a>'
    bare = '<div><a href="/m-2-objectives">Objectives</a><a href="/m-3-payloads">other</a><a href="/about">About</a></div>'
    return ig.section_links(_pages(s, ("/m-1", menu), ("/m-2", bare)), DOMAINS, SECTIONS)


SITE_MAP = '<a href="/outside">no</a><div id="site-map"><a href="docs/a.pdf">A</a><a href="https://elsewhere.example/">E</a><a href="/p#x">P</a><a href="/p">again</a></div><div class="view-announcement-view"><a href="/new.pdf">N</a><a href="/page">P</a></div>'


@fixture("source_url, url, is_document", (f"{HOST}/map", f"{HOST}/docs/a.pdf", True), (f"{HOST}/map", f"{HOST}/p", False))
def fixture_sitemap(s: SparkSession) -> DataFrame:
    return ig.sitemap_links(_pages(s, ("/map", SITE_MAP)), DOMAINS).select("source_url", "url", "is_document")


@fixture("source_url, title, url", (f"{HOST}/map", "N", f"{HOST}/new.pdf"))
def fixture_announced(s: SparkSession) -> DataFrame:
    return ig.announced_documents(_pages(s, ("/map", SITE_MAP)), DOMAINS)


TABLES = """<table><caption>Bands</caption><thead><tr><th>Name</th><th colspan="2">Range</th></tr></thead><tbody><tr><td>B1</td><td>1</td><td>2</td></tr><tr><td>B2</td><td>3</td></tr><tr><td> </td></tr></tbody></table>
<table><tr><th>x</th><th>y</th></tr><tr><td>only</td><td>one</td></tr></table><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td><td>e</td></tr></table>"""


@fixture("source_url, table_index, caption, headers, cells", (f"{HOST}/t", 0, "Bands", "Name|Range|Range", "B1|1|2;B2|3|"), (f"{HOST}/t", 1, "", "Column 1|Column 2", "a|b;c|d"))
def fixture_tables(s: SparkSession) -> DataFrame:
    rows = ig.table_rows(_pages(s, ("/t", TABLES)))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return rows.select("source_url", F.col("table_index").cast("bigint").alias("table_index"), "caption", F.array_join("headers", "|").alias("headers"), cells.alias("cells"))


META = """<head><meta name="Description" content="A  portal"><meta property="og:title" content="Title"><meta name="twitter:card" content="summary"><meta name="empty" content="">
<script type="application/ld+json">{"@type": "FAQPage", "name": "Help", "mainEntity": [{"name": "Q?", "acceptedAnswer": {"text": "A."}}, 5]}</script><script type="application/ld+json">broken</script></head>
<body><nav id="top" aria-label="Main menu"></nav><img src="/i.png" alt="A map of ice"><img src="/j.png" alt="x"></body>"""


@fixture("kind, key, value", ("meta", "description", "A portal"), ("meta", "twitter:card", "summary"), ("og", "og:title", "Title"), ("twitter", "twitter:card", "summary"), ("schema", "@type", "FAQPage"), ("schema", "name", "Help"), ("schema_faq", "Q?", "A."), ("aria", "aria-label:top", "Main menu"), ("alt", "/i.png", "A map of ice"))
def fixture_meta(s: SparkSession) -> DataFrame:
    return ig.meta_rows(_pages(s, ("/m", META))).select(F.col("meta_type").alias("kind"), "key", "value")


DEEP = '<body><p>outside</p><div id="content"><ul class="breadcrumb"><li>gone</li></ul><h2>Head</h2><p>One <b>two</b></p><ul><li>x</li><li>y</li></ul><figcaption>Map</figcaption><table><tr><td>no</td></tr></table><script>no</script>' + "<div>" * 2000 + "deep" + "</div>" * 2000 + "</div></body>"


@fixture("url, text", (f"{HOST}/d", "## Head\n\nOne two\n\n• x\n• y\nService: Map\ndeep"), (f"{HOST}/f", "a"))
def fixture_text(s: SparkSession) -> DataFrame:
    return _pages(s, ("/d", DEEP), ("/f", "<font>" * 1500 + "a")).select("url", ht.text_of(F.col("html")).alias("text"))


PAYLOADS = [
    (f"{HOST}/m-1-payloads", 0, ["Instrument", "Payload type", "Swath", "Swath width"], [["I1", "Imager", "10 km", "12 km"], ["", "Sounder", "", ""], ["I2", "", "", "7 km"]]),
    (f"{HOST}/m-1-payloads", 1, ["Attribute", "Value"], [["Channels", "19"], ["No. of bands", "20"], ["Sensor", "I3"], ["", "x"]]),
    (f"{HOST}/m1-spacecraft", 0, ["Kind", "Mass", "Power"], [["Bus A", "5 kg", "9 W"]]),
    (f"{HOST}/m-1-introduction", 0, ["Instrument", "Swath", "Band"], [["no", "no", "no"]]),
    (f"{HOST}/m-9-payloads", 0, ["Instrument", "Swath", "Band"], [["no", "no", "no"]]),
]


@fixture(
    "node_id, label, attributes, text",
    ("payload:m-1:i1", "I1", "mission_slug=m-1|payload_name=I1|payload_type=Imager|swath=12 km", "I1 is an instrument on m-1. Type: Imager Swath width: 12 km"),
    ("payload:m-1:i2", "I2", "mission_slug=m-1|payload_name=I2|swath=7 km", "I2 is an instrument on m-1. Swath width: 7 km"),
    ("payload:m-1:i3", "I3", "channels=20|mission_slug=m-1|payload_name=I3", "I3 is an instrument on m-1. Number of channels/bands: 20"),
    ("payload:m-1:bus_a", "Bus A", "kind=Bus A|mass=5 kg|mission_slug=m-1|power=9 W", "Bus A is an instrument on m-1."),
)
def fixture_payloads(s: SparkSession) -> DataFrame:
    tables = s.createDataFrame(PAYLOADS, "source_url string, table_index int, headers array<string>, rows array<array<string>>")
    nodes, _ = en.payload_nodes(tables, (("m-1", ("m-1", "m1")),))
    return nodes.select("node_id", "label", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("attributes"), "text")


def _folder(s: SparkSession) -> str:
    return f"{checkpoint_root(s)}/skerry-fixture-{uuid.uuid4().hex}"


def _small_graph(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = s.createDataFrame([("a<", "T", "l", "u", {"k": 'q"&', "text": "é" * 600}, "t"), ("b", "T", None, "v", {}, None)], "node_id string, node_type string, label string, source_url string, attributes map<string,string>, text string")
    return nodes, s.createDataFrame([("a<", "b", "R", {"w": "1"}), ("b", "a<", "S", {})], "source_id string, target_id string, relation_type string, attributes map<string,string>")


def _read_back(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("a"), F.lit("").alias("b"), F.coalesce(F.try_element_at("attributes", F.lit("k")), F.lit("")).alias("value"), F.length(F.coalesce(F.try_element_at("attributes", F.lit("text")), F.lit(""))).cast("bigint").alias("size"))
    return n.unionByName(edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.coalesce(F.try_element_at("attributes", F.lit("w")), F.lit("")).alias("value"), F.lit(0).cast("bigint").alias("size")))


@fixture("part, a, b, value, size", ("node", "a<", "", 'q"&', 600), ("node", "b", "", "", 0), ("edge", "a<", "b", "1", 0), ("edge", "b", "a<", "", 0))
def fixture_node_link(s: SparkSession) -> DataFrame:
    path = _folder(s)
    sinks.node_link(*_small_graph(s), path)
    return _read_back(*readers.node_link(s, path))


@fixture("part, a, b, value, size", ("node", "a<", "", 'q"&', 501), ("node", "b", "", "", 0), ("edge", "a<", "b", "1", 0), ("edge", "b", "a<", "", 0))
def fixture_graphml(s: SparkSession) -> DataFrame:
    path = _folder(s)
    sinks.graphml(*_small_graph(s), path)
    return _read_back(*readers.graphml(s, path))


@fixture("url, times, stamped", (f"{HOST}/1", 2, True), (f"{HOST}/2", 1, True))
def fixture_appended(s: SparkSession) -> DataFrame:
    path = _folder(s)
    for urls in ((f"{HOST}/1", f"{HOST}/2"), (f"{HOST}/1",)):
        sinks.append(s.createDataFrame([(u,) for u in urls], "url string"), path, "added_at")
    return s.read.parquet(path).groupBy("url").agg(F.count("*").alias("times"), F.every(F.col("added_at") <= F.current_timestamp()).alias("stamped"))
