import io
import zipfile

import pytest
from pyspark.sql import functions as F

from skerry.operators import chat, ingest
from skerry.operators import entities as en
from skerry.sources import office, readers

from .test_functions import PAGE


@pytest.fixture(scope="module")
def fetched(spark):
    menu = '<ul id="block-menu-menu-m-1-menu"><li><a href="/m-1-payloads">Payloads</a><a href="#x">x</a></ul><div id="site-map"><a href="docs/a.pdf">A</a><a href="https://other.example/">O</a></div><div class="view-announcement-view"><a href="/new.pdf">N</a><a href="/page">P</a></div>'
    return spark.createDataFrame([("https://h.example/m-1", PAGE, 200, 0), ("https://h.example/m-1/menu", menu, 200, 1), ("https://h.example/gone", None, 404, 1)], "url string, html string, status_code int, depth int")


def test_page_rows(fetched):
    rows = {r.url: r for r in ingest.page_rows(fetched, en.PageRules(slugs=(("m-1", "m-1"),))).collect()}
    r = rows["https://h.example/m-1"]
    assert len(rows) == 2 and (r.title, r.page_type, r.language, r.links_found) == ("Name", "mission", "en", 1)
    assert r.word_count == len(r.content_text.split())


def test_extracted_rows(fetched):
    assert [(r.question, r.answer) for r in ingest.faq_rows(fetched).collect()] == []
    assert [(r.row_count, r.col_count) for r in ingest.table_rows(fetched).collect()] == [(2, 2)]
    assert {r.meta_type for r in ingest.meta_rows(fetched).collect()} >= {"meta", "og", "twitter"}


def test_scoped_links(fetched):
    d = ("h.example",)
    assert {(r.url, r.is_document) for r in ingest.sitemap_links(fetched.filter("depth = 1"), d).collect()} == {("https://h.example/m-1/docs/a.pdf", True)}
    assert [r.url for r in ingest.announced_documents(fetched, d).collect()] == ["https://h.example/new.pdf"]
    assert [(r.url, r.section_type) for r in ingest.section_links(fetched, d, (("payload", ("payload",)),)).collect()] == [("https://h.example/m-1-payloads", "payload")]


def test_permitted(spark):
    queue = spark.createDataFrame([("https://h/a/x",), ("https://h/a/open/x",), ("https://o/a",)], "url string")
    robots = spark.createDataFrame([("h", "*", False, "/a"), ("h", "*", True, "/a/open")], "host string, agent string, allow boolean, path string")
    assert {r.url for r in ingest.permitted(queue, robots).collect()} == {"https://h/a/open/x", "https://o/a"}


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_rels/", "_rels/"), text)
    return out.getvalue()


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = zipped(**{"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>'})
    assert office.docx(doc) == ("## Head\nText\na | ", 2)
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = zipped(**{"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {s}><si><t>x</t></si></sst>", "xl/worksheets/s1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></sheetData></worksheet>'})
    assert office.xlsx(book) == ("=== Sheet: One ===\nx | 5", 1)
    for name, data in (("a.docx", doc), ("b.xlsx", book), ("c.csv", b"p,q\n"), ("d.pdf", b"%PDF"), ("e.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in office.parsed_documents(readers.raw_documents(spark, str(tmp_path))).collect()}
    assert [rows[n].extraction_ok for n in ("a.docx", "b.xlsx", "c.csv", "d.pdf", "e.docx")] == [True, True, True, False, False]
    assert rows["c.csv"].extracted_text == "p | q"


KINDS = (("faq", ("how to",)),)


def test_ask(spark):
    rows = [(f"c{i}", f"n{i}", "FAQ", f"label {i}", f"https://h.example/{i}", i, text, i) for i, text in enumerate(["how to download the wind data", "the ice map", "orbit of the craft"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, node_id string, node_type string, label string, source_url string, chunk_index int, text string, seq long")
    chunks = chat.embedded(chunks.withColumns({c: F.lit(None).cast("string") for c in ("mission_slug", "section_type", "category", "doc_type", "orbit_type")}))
    history, seen = [], []
    a = chat.ask(chunks, "how to download the wind data", history, lambda m: seen.append(m) or "Do so.", KINDS)
    assert (a.text, a.kind, a.fallback) == ("Do so.", "faq", False) and a.sources[0] == "• /0" and "[1] FAQ: label 0 | Source: https://h.example/0" in seen[0][-1]["content"]
    assert [h["role"] for h in history] == ["user", "assistant"]
    b = chat.ask(chunks, "zzz craft", history, lambda m: "It flies.")
    assert b.text == "It flies." and len(history) == 4
    assert chat.ask(chunks, "qqqq", history, lambda m: "x").text == chat.NO_ANSWER and chat.ask(chunks, " ", history, str).fallback
