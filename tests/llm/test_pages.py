import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import main_body as mb
from skerry.llm import residue as rs
from skerry.llm import scans as sc
from skerry.llm import text_types as tt

NOUNS = "map sea pass orbit sensor ice wind wave cloud station archive forecast".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} shows {rng.randint(1, 999)} cells near the {rng.choice(NOUNS)} in the {rng.choice(NOUNS)} of {rng.randint(1990, 2030)}."


def page(i, rng, main=None, title=None, html=True):
    title = title or f"Notes {i} on the {rng.choice(NOUNS)}"
    main = main or [" ".join(sentence(rng) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 5))]
    menu, foot = ["Home", "Missions", "Contact us"], ["All content is owned by the centre.", f"Visitors: {rng.randint(1, 9999)}"]
    side = ["Latest news", *(f"{rng.choice(NOUNS).title()} passes orbit {rng.randint(1, 9)}" for _ in range(2))]
    text = "\n".join([*menu, title, *main, *side, *foot])
    markup = f'<html><body><ul id="menu-1">{"".join(f"<li>{x}</li>" for x in menu)}</ul><div class="main"><h2>{title}</h2>{"".join(f"<p>{x}</p>" for x in main)}</div><div class="side">{"".join(f"<div>{x}</div>" for x in side)}</div><div id="foot">{"".join(f"<p>{x}" for x in foot)}</div></body></html>'
    return (i, f"https://h{i % 2}.example/{i}", title, text, markup if html else None, 200, None, len(main))


SCHEMA = "id long, url string, title string, content_text string, content_html string, status_code int, word_count int, n int"
BAD = ["Sorry, the page you asked for was not found.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet lorem ipsum vel.", "Description: {{ summary }}", "Internal server error 500"]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = [page(i, rng, html=i % 10 != 0) for i in range(160)]
    rows += [page(200 + i, rng, main=[BAD[i % 5]], title="Error") for i in range(30)]
    rows += [page(300, rng, main=["• item one", "• item two", "• item three of many", "• item four of many"]), page(301, rng, main=["a | 1 | 2", "b | 3 | 4", "c | 5 | 6", "d | 7 | 8"]), page(302, rng, main=["x7Gh2kLmQ9vR4tZpW8nB3cD6", "qW9eR8tY7uI6oP5aS4dF3gH2", "zX1cV2bN3mM4lK5jH6gF7dS8"])]
    rows += [page(303, rng, main=["Write {{ station }} in your own layout and the tool puts in the name. " + sentence(rng)] + [sentence(rng) for _ in range(4)])]
    rows += [(400, None, None, None, None, None, None, 0), (401, "https://h0.example/e", None, "", None, 404, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def bodies(pages):
    return mb.main_bodies(pages).cache()


def test_dom_lines():
    lines, parents = mb.dom_lines('<body><div class="a1f2c"><p>One<p>Two <b>x</b><aside>N</aside></div><table><tr><td>a</td><td>b</td></tr></table><script>no</script>&amp; end')
    assert [(a, b) for _, a, b in lines] == [("p", "One"), ("p", "Two x"), ("", "N"), ("tr", "a | b"), ("", "& end")]
    assert parents[lines[2][0]] == lines[0][0] and parents[lines[0][0]] == mb.place(0, "body")
    again, _ = mb.dom_lines('<body><div class="a7d3e">x</div>')
    assert again[0][0] == lines[0][0]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/divplitrtd=\"' \nabc&;", max_size=200), st.text(alphabet="abc \n", max_size=60))
def test_dom_never_fails(markup, text):
    dom, _ = mb.dom_lines(markup)
    assert len(mb.aligned(text, dom)) == text.count("\n") + 1


def test_main_bodies(spark, pages, bodies):
    rows = {r.page_id: r for r in bodies.collect()}
    n = {r.id: r.n for r in pages.collect()}
    right = total = 0
    for i in range(160):
        kept = [not x for x in rows[i].noise]
        want = [False] * 3 + [True] * (1 + n[i]) + [False] * 5
        right += sum(a == b for a, b in zip(kept, want))
        total += len(want)
    assert right > 0.97 * total
    assert rows[400].noise == [] and rows[401].noise == [None]
    assert mb.noise_lines(bodies).filter("page_id = 1").count() == 8
    assert mb.body_text(bodies).filter("page_id = 401").first().main_text == ""


def test_empty_tables(spark, pages):
    none = mb.main_bodies(pages.limit(0))
    assert none.count() == 0 and rs.residue_pages(none).count() == 0
    assert tt.page_types(tt.measured(none)).count() == 0


def test_residue(bodies):
    found = {r.page_id for r in rs.residue_pages(bodies).collect()}
    assert {i for i in range(200, 230)} <= found | {i for i in range(200, 230) if i % 5 == 99}
    assert not found & (set(range(160)) | {300, 301, 302, 303, 400, 401})
    report = rs.validate(bodies)
    assert report["segments"] > 0 and report["recall"] > 0.5


def test_placeholders():
    bad = ["{{ a }}", "${launch_date}", "$!{x}", "#{a.b}", "<%= region %>", "%%summary%%", "[[product.level]]", "[node:author]", "__page.title__", "@@body@@", "<<sensor>>", "[INSERT BODY HERE]", "[region goes here]", "?php print $x; ?>", "{% block a %}", "a {author} b"]
    assert all(rs.placeholders(x) for x in bad)
    good = ["a { b: 1 }", "f(e){ return e[1]; }", "__init__x", "50 % of %", "[1]", "x << 2", "<b>", "{", "%%421%%"]
    assert not any(rs.placeholders(x) for x in good)


def test_text_types(pages, bodies):
    types = {r.page_id: r for r in tt.page_types(tt.measured(bodies)).collect()}
    assert all(abs(r.prose + r.list + r.table + r.junk - 1) < 1e-6 for r in types.values() if r.prose is not None) and types[302].junk > 0.5
    assert [types[i].kind for i in (300, 301, 302)] == ["list", "table", "junk"] and types[5].kind == "prose"
    assert types[400].words is None and types[401].words == 0
    none = bodies.select("page_id").limit(0)
    found = {(r.page_id, r.finding) for r in tt.findings(pages, tt.page_types(tt.measured(bodies)), none).collect()}
    assert (300, "list") in found and (1, "wrong_count") in found and not any(i == 400 for i, _ in found) and (401, "wrong_count") not in found


def test_em_learns_accuracies():
    rng = np.random.default_rng(1)
    kinds = rng.choice(4, 4000, p=[0.6, 0.2, 0.1, 0.1])
    own = [{tt.KINDS.index(k) for k in ks.split()} for _, ks in tt.FUNCTIONS]
    fires = np.array([[rng.random() < (0.8 if k in own[f] else 0.04) for f in range(len(own))] for k in kinds])
    masks = (fires << np.arange(len(own))).sum(axis=1)
    values, counts = np.unique(masks, return_counts=True)
    post = tt.learn(dict(zip(values.tolist(), counts.tolist())))
    assert (post[np.searchsorted(values, masks)].argmax(axis=1) == kinds).mean() > 0.95
    assert tt.learn({}).shape == (0, 4)


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=120).filter(lambda x: x.strip()))
def test_masks_never_fail(line):
    assert 0 <= tt.mask(line.replace("\n", " ") if line.replace("\n", " ").strip() else "x") < 1 << len(tt.FUNCTIONS)
    assert tt.statistics(line)["words"] == len(line.split())


def test_glyph_keys():
    for bad, good in (("courits", "counts"), ("povver", "power"), ("qiiality", "quality"), ("changecl", "changed"), ("ce1ls", "cells"), ("firmw@re", "firmware"), ("sincc", "since"), ("westem", "western")):
        assert sc.glyph_key(bad) == sc.glyph_key(good)
    assert sc.odd_shape("ce1ls") and sc.odd_shape("Orun@") and not sc.odd_shape("Level-2") and not sc.odd_shape("HDF5")


def scanned(rng, n, misread):
    lines = []
    for p in range(n):
        lines.append(("\x0c" if p else "") + "ORVEX-2 Handbook")
        for k in range(12):
            lines.append(f"the {rng.choice(NOUNS)} of every station counts the {rng.choice(NOUNS)} and the forecast")
        lines[-3] = "the sensor of every sta-"
        lines[-2] = "tion counts the cloud and the forecast"
        if misread:
            lines[-5] = "the sensor of every statiori courits the ice"
        lines.append(f"- {p + 3} -")
    return "\n".join(lines)


def test_scans(spark):
    rng = random.Random(6)
    rows = [(i, scanned(rng, 3, i == 1), "x") for i in range(6)]
    rows += [(50, None, "x"), (51, "", "x"), (52, "Band\nGain\n15\n23\n24\n6\n\nA short text with a quick-\nlook image and numbers.\n\n94\n81\n7", "x")]
    files = spark.createDataFrame(rows, "id long, extracted_text string, word string")
    got = {(r.file_id, r.line_no, r.noise) for r in sc.scan_noise(files).collect()}
    mine = {(n, k) for i, n, k in got if i == 1}
    assert {(1, "running_header"), (14, "page_number"), (15, "running_header"), (11, "broken_word"), (9, "misread"), (28, "page_number")} <= mine
    assert not {x for x in got if x[0] >= 50}
    text = {r.file_id: r.paragraphs for r in sc.repaired(files).collect()}[1]
    assert "Handbook" not in text and "- 3 -" not in text and "sta-" not in text
    assert "station counts the ice" in text and "courits" not in text
    assert sc.scan_noise(files.limit(0)).count() == 0


def test_copies_of_a_scan_are_judged_alike(spark):
    rng = random.Random(7)
    copied = "the statiori of every forecast\nsaw the cl0ud"
    rows = [(i, scanned(rng, 3, False), "x") for i in range(6)] + [(100 + i, copied, "x") for i in range(60)]
    files = spark.createDataFrame(rows, "id long, extracted_text string, word string")
    got = {(r.file_id, r.line_no) for r in sc.scan_noise(files).filter("noise = 'misread'").collect()}
    assert got == {(100 + i, n) for i in range(60) for n in (1, 2)}


def test_vectors_tell_contexts_apart(monkeypatch):
    # so small a vocabulary has frequent words alone, of which large texts sample fewer
    monkeypatch.setattr(sc, "SAMPLED", 1e-3)
    # hut and but share a key; the vectors tell which of them goes with the words around
    rng = random.Random(9)
    crops, rooms = [f"crop{i}" for i in range(40)], [f"room{i}" for i in range(40)]
    lines = [" ".join((*rng.choices(crops, k=3), "but", *rng.choices(crops, k=3))) for _ in range(6000)]
    lines += [" ".join((*rng.choices(rooms, k=3), "tent", *rng.choices(rooms, k=3))) for _ in range(6000)]
    texts = pa.array(lines, pa.large_string())
    words, row = sc._hashed(texts)
    model = sc.Vectors(np.bincount(words, minlength=sc.BUCKETS))
    for _ in range(3):
        model.learn(words, row, np.random.default_rng(1))
    mean = (model.share[:, None] * model.context).sum(0)

    def odds(word: str, near: list[str]) -> float:
        return float(model.own[sc.buckets([word])[0]] @ (model.context[sc.buckets(near)] - mean).sum(0))

    assert odds("but", crops[:6]) > 1 > -0.5 > odds("but", rooms[:6])
    assert sc.glyph_key("hut") == sc.glyph_key("but")


def score(n: int, often: int, times: int, own: list[float], sums: list[float], odd: bool = False) -> float:
    row = {"term": ["t"], "original": ["o"], "n": [n], "often": [often], "odd": [odd], "bucket": [0], "times": [times], **{c: [x] for c, x in zip(sc._SUMS, sums)}}
    vectors = np.zeros((sc.BUCKETS, sc.SIZE))
    vectors[0] = own
    return next(sc._scored(vectors)(iter([pa.RecordBatch.from_pydict(row)]))).column("score")[0].as_py()


def test_context_outweighs_frequency():
    v, zero = [1.0] * sc.SIZE, [0.0] * sc.SIZE
    least = float(np.log(sc.FAVOUR))
    assert score(10, 150, 1, v, zero) > least > score(10, 150, 1, v, [-0.5] * sc.SIZE)
    assert score(10, 40, 1, v, zero) < least < score(10, 40, 1, v, [0.5] * sc.SIZE)
    assert score(10, 40, 1, v, zero, odd=True) > least


def test_chain_is_the_longest():
    rng = random.Random(3)
    for _ in range(200):
        at = sorted(rng.sample(range(60), 12))
        v = {i: rng.randint(1, 6) for i in at}
        best = {}
        for n, i in enumerate(at):
            best[i] = 1 + max((best[j] for j in at[:n] if 1 <= v[i] - v[j] <= 2 and i - j >= 5), default=0)
        chain = sc._chain(at, v, 5)
        assert len(chain) == max(best.values()) and all(1 <= v[b] - v[a] <= 2 and b - a >= 5 for a, b in zip(chain, chain[1:]))


def test_long_unbroken_lines(spark):
    files = spark.createDataFrame([(1, "x" * 200_000 + "-\n" + "y" * 200_000), (2, "\n".join(str(i) for i in range(20_000)))], "id long, extracted_text string")
    assert sc.scan_noise(files).count() >= 0
    assert sc.roman("xliv") == 44 and sc.roman("mix") == 1009 and sc.roman("vx") == 0 and sc.roman("") == 0


def test_page_numbers():
    lines = ["Text of the first page that goes on", *["line of text"] * 9, "101", *["line of text"] * 9, "lO2", *["more text here"] * 9, "103"]
    assert sc.borders(lines)[0] == {10, 20, 30}
    assert sc.borders(["text"] * 3 + ["15", "23", "24", "6"])[0] == set()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab -\n\x0c12.lO", max_size=200))
def test_scan_files_never_fail(text):
    numbers, heads = sc.borders(text.split("\n"))
    f = sc.File(text, numbers, set(heads), {"ab": "ba"}, {"abba": 9})
    f.noise(), f.paragraphs()


def test_long_texts(spark, pages):
    rows = [(1, "https://h.example/1", "T", "word " * 200_000, "<p>" + "word " * 10_000, 200, 1, 0)]
    b = mb.main_bodies(spark.createDataFrame(rows, SCHEMA))
    assert b.count() == 1 and tt.page_types(tt.measured(b)).select(F.max("words")).first()[0] == 200_000
