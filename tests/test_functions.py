import hashlib
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.functions import html as ht
from skerry.functions import rules as rl
from skerry.functions import text as tx
from skerry.functions import urls as ur
from skerry.functions import vectors as vc


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_clean_text(spark):
    got = one(spark, [None, "", "﻿﻿a  b", "a\x00b\x07", "x\n\n\n\ny", "  　x  "], tx.clean_text)
    assert got == ["", "", "a b", "ab", "x\n\ny", "x"]


def test_clean_text_is_idempotent(spark):
    texts = ["a  b\n\n\n\nc", " x\t\ny ", "﻿q", "é  ü\r\n"]
    once = one(spark, texts, tx.clean_text)
    assert one(spark, once, tx.clean_text) == once


def test_counts_hashes_and_language(spark):
    texts = [None, "", "a b  c", "नमस्ते दुनिया", "x" * 86 + "é" * 14, "x" * 85 + "é" * 15]
    assert one(spark, texts, tx.word_count) == [0, 0, 3, 2, 1, 1]
    assert one(spark, texts, tx.detect_language) == ["other", "other", "en", "other", "en", "other"]
    assert one(spark, ["a"], tx.content_hash) == [hashlib.sha256(b"a").hexdigest()]
    assert one(spark, ["a"], tx.url_hash) == [hashlib.md5(b"a").hexdigest()]


def test_casing(spark):
    words = ["gps-derived o'neil", "ABC def", "über ño"]
    assert one(spark, words, tx.title_case) == [w.title() for w in words]
    assert one(spark, ["aBC", ""], tx.capitalized) == ["Abc", ""]
    assert one(spark, ["Wide Swath (A)!"], tx.identifier) == ["wide_swath_a"]
    assert one(spark, ["sea-ice_map"], tx.slug_label) == ["Sea Ice Map"]


def test_residue_runs_to_the_end_without_a_semicolon(spark):
    got = one(spark, ["jQuery(document).ready(x); The data.", "jQuery(document).ready(x) all gone", "?php print; The data", "?? The data"], tx.strip_residue)
    assert got == ["The data.", "", "The data", "The data"]


def test_chunk_validity(spark):
    texts = ["x" * 29, "x" * 30, "x" * 15 + "é" * 15, "x" * 14 + "é" * 16]
    assert one(spark, texts, tx.valid_chunk) == [False, True, True, False]


def test_urls(spark):
    urls = ["HTTP://Host.Example/a//#x", "mailto:x@y", None, "https://h.example", "/rel"]
    assert one(spark, urls, ur.normalised) == ["http://Host.Example/a", None, None, "https://h.example", None]
    assert one(spark, ["https://h/a/b.PDF?x=1", "https://h/a.json"], ur.is_document) == [True, False]
    assert one(spark, ["https://evilh.example/x", "https://h.example/a.json", ""], lambda c: ur.is_allowed(c, ("h.example",))) == [True, False, False]
    assert one(spark, ["https://h/a/b/?q"], ur.last_segment) == ["b"]


def test_relative_references(spark):
    rows = spark.createDataFrame([("../x", "https://h.example/a/b/c"), ("?p=2", "https://h.example/a"), ("//o.example/z", "https://h.example"), ("/r/", "https://h.example/a/b")], "h string, b string")
    any_ = [r[0] for r in rows.select(ur.resolved_any(F.col("h"), F.col("b"))).collect()]
    assert any_ == ["https://h.example/a/x", "https://h.example/a?p=2", "https://o.example/z", "https://h.example/r"]
    native = [r[0] for r in rows.select(ur.resolved(F.col("h"), F.col("b"))).collect()]
    assert native[2:] == any_[2:]


def test_rule_order(spark):
    rules = (("a", ("orvex-2d",)), ("b", ("orvex-2ds",)))
    assert one(spark, ["x orvex-2ds", "none", None], lambda c: rl.first_match(c, rules, "other")) == ["a", "other", "other"]
    assert one(spark, ["ab", "b", ""], lambda c: rl.all_matches(c, (("x", ("a",)), ("y", ("b",)), ("x", ("b",))))) == [["x", "y"], ["y", "x"], []]
    table = spark.createDataFrame([(2, "orvex-2ds", "b"), (1, "orvex-2d", "a")], "seq int, keyword string, label string")
    rows = spark.createDataFrame([(1, "x orvex-2ds"), (2, "none")], "id int, t string")
    assert {(r.id, r.label) for r in rl.matched_by_table(rows, "t", table, "id").collect()} == {(1, "a"), (2, None)}


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in rows.select(vc.unit(F.col("v"))).collect()]
    assert [round(x, 5) for x in got[0]] == [0.6, 0.8] and got[1] == [0.0, 0.0]


PAGE = """<html><head><title>Name | Site</title><meta name="description" content="About"><meta property="og:title" content="T">
<meta name="twitter:card" content="sum"><script type="application/ld+json">{"@type": "FAQPage", "name": "N", "mainEntity": [{"name": "Q", "acceptedAnswer": {"text": "A"}}]}</script></head>
<body><nav>menu</nav><div class="region region-content"><h2>Head</h2><p>One<p>Two <a href="/x">link</a></p><ul><li>a<li>b</ul><div class="breadcrumb">home</div>
<table><caption>C</caption><tr><th>Name</th><th>Swath</th></tr><tr><td>I1</td><td>10 km</td></tr><tr><td colspan=2>both</td></tr></table><img src="i.png" alt="a map"></div>
<div class="faq-question-answer"><div class="faq-question"><span property="dc:title">What?</span></div><div class="faq-answer"><div class="field-item"><p>This.</p><p>&lt;w:x</p></div></div></div></body></html>"""


def test_html():
    root = ht.parse(PAGE)
    assert ht.title(root) == "Name"
    assert ht.page_text(PAGE) == "## Head\n\nOne\n\nTwo link\n\n• a\n• b"
    assert ht.tables(PAGE) == [{"table_index": 0, "headers": ["Name", "Swath"], "rows": [["I1", "10 km"], ["both", "both"]], "caption": "C"}]
    assert ht.faq_pairs(PAGE) == [{"question": "What?", "answer": "This.", "method": "Manual"}]
    kinds = {(m["kind"], m["key"]) for m in ht.meta(PAGE)}
    assert {("meta", "description"), ("meta", "twitter:card"), ("twitter", "twitter:card"), ("og", "og:title"), ("schema", "@type"), ("schema_faq", "Q"), ("alt", "i.png")} <= kinds


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=string.ascii_letters + "<>/='\" \n&;", max_size=300))
def test_html_never_fails(page):
    ht.page_text(page), ht.tables(page), ht.meta(page), ht.faq_pairs(page), ht.sidebar_links(page)


def test_chunk_literals_are_plain():
    assert all(isinstance(x, str) and re.escape(x) for x in tx.LITERALS)
