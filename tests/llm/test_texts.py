import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import contamination as ct
from skerry.llm import encoding as en
from skerry.llm import mixing as mx
from skerry.llm import pairs as pr
from skerry.llm import repeated_lines as rl
from skerry.llm import splitting as sp

PAGES = "id long, url string, content_text string, site string, text string, line_no int"


def site_pages(spark):
    notice = "Content  on this PORTAL may be used 12 times, provided that the source is named in full"
    rows = [(i, "https://a.example/p", f"Own line number {'x' * i}\n\n{notice.lower() if i % 2 else notice}\nMenu\t{i}", "clash", "clash", 1) for i in range(20)]
    rows += [(100, "https://b.example/1", "Menu 1\n" + notice, "c", "c", 1), (101, None, "Menu 1", "c", "c", 1), (102, "https://a.example/z", None, "c", "c", 1), (103, "https://a.example/y", "", "c", "c", 1)]
    rows += [(104, "https://a.example/twice", "Menu 7\nMenu 8", "c", "c", 1)]
    return spark.createDataFrame(rows, PAGES)


def test_repeated_lines(spark):
    found = {(r.page_id, r.line_no) for r in rl.repeated_lines(site_pages(spark)).collect()}
    assert found == {(i, n) for i in range(20) for n in (3, 4)} | {(104, 1), (104, 2)}


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(1)
    words = ["Terms", "of use", "Share 12", "share 7", "é Café", "a very long notice that takes more than one chunk of the stream " * 3, ""]
    texts = [(i, f"https://h{i % 3}.example/{i}", "\n".join(rng.choices(words, k=rng.randint(0, 6))) + f"\n{rng.random()}") for i in range(120)]
    pages = spark.createDataFrame([(*t, "", "", 0) for t in texts], PAGES)
    key = lambda x: re.sub(r"[ \t]", "", re.sub(r"[0-9]+", "0", x.lower()))
    lines = [(i, u[:19], n, key(x)) for i, u, t in texts for n, x in enumerate(t.split("\n"), 1) if key(x)]
    sizes = {h: sum(u[:19] == h for _, u, _ in texts) for h in {u[:19] for _, u, _ in texts}}
    on = {}
    for i, h, _, k in lines:
        on.setdefault((h, k), set()).add(i)
    want = {(i, n) for i, h, n, k in lines if len(on[h, k]) >= max(3, 0.1 * sizes[h])}
    assert {(r.page_id, r.line_no) for r in rl.repeated_lines(pages).collect()} == want


def test_repeated_lines_removed(spark):
    pages = site_pages(spark)
    got = {r.page_id: r.clean_text for r in rl.without_lines(pages, rl.repeated_lines(pages)).collect()}
    assert got[3] == "Own line number xxx\n" and got[102] is None and got[103] == ""
    assert rl.repeated_lines(pages.limit(0)).count() == 0


def test_null_ids_are_counted(spark):
    rows = [(None, "https://a.example/p", "Menu\nown " + "x" * i, "", "", 1) for i in range(3)]
    assert [(r.page_id, r.line_no) for r in rl.repeated_lines(spark.createDataFrame(rows, PAGES)).collect()] == [(None, 1)] * 3


def test_chunks_are_set_by_content():
    text = "".join(random.Random(2).choices("abcdefgh ij", k=900))
    a = rl.chunked(pa.array([text, "zz" + text, f"menu\n{text}\nfoot", text[300:]], pa.large_string()))
    first, *others = (a["unit"][(a["row"] == r) & (a["line_no"] == n)] for r, n in ((0, 1), (1, 1), (2, 2), (3, 1)))
    # a prefix moves no cut behind it, lines around a line don't either, and a part of a line shares its chunks
    assert len(first) > 5 and set(others[0]) >= set(first[1:]) and set(others[1]) == set(first) and len(set(others[2]) & set(first)) > 5
    assert list(a["units"][(a["row"] == 2) & (a["line_no"] == 1)]) == [1]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n?é", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_split_properties(text, size, over):
    text = text.strip(" \t\r\n")
    cut = sp.spans(text, size, over)
    assert "".join(text[s:e] for s, e in cut) == text
    parts = sp.pieces(text, size, over)
    assert all(len(p) <= size for p in parts)
    assert all(b[:over] == text[max(0, s - over) : s] for b, (s, _) in list(zip(parts, cut))[1:] if s >= over)
    assert (len(parts) > 1) == (len(text) > size)


def test_split_prefers_strong_boundaries():
    text = "a" * 40 + "\n\n" + "b" * 38
    assert sp.spans(text, 60, 5) == [(0, 42), (42, 80)]
    with pytest.raises(ValueError):
        sp.spans("x", 5, 5)


def test_split_items(spark):
    limits = spark.createDataFrame([("k", 10, 2), ("none", None, None)], "item_kind string, max_chars int, overlap_chars int")
    rows = spark.createDataFrame([("k", "1", " " * 50 + "short" + "\n" * 9), ("k", "2", "x" * 11), ("k", "3", None), ("none", "4", "y" * 99), ("k", "5", "")], "item_kind string, item_key string, text string")
    assert [(r.item_kind, r.item_key) for r in sp.oversized(sp.split_items(rows, limits)).collect()] == [("k", "2")]
    assert sp.split_items(rows.limit(0), limits).count() == 0
    odd = spark.createDataFrame([("k", 5, 9), ("zero", 0, 0), ("minus", 4, -3)], "item_kind string, max_chars int, overlap_chars int")
    more = spark.createDataFrame([("k", "1", "abcdefghij"), ("zero", "2", "abc"), ("minus", "3", "abcdefghij")], "item_kind string, item_key string, text string")
    got = sp.split_items(more, odd).collect()
    assert {r.item_key for r in got} == {"1", "3"} and max(len(r.piece) for r in got) <= 5
    huge = spark.createDataFrame([("k", "1", "word " * 100_000)], "item_kind string, item_key string, text string")
    assert sp.split_items(huge, limits).agg(F.max(F.length("piece"))).first()[0] <= 10


def plain_words(text):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if unicodedata.category(c)[0] != "M"))


def test_contamination(spark):
    rng = random.Random(4)
    vocabulary = [f"wörd{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(6)] + [(9, "too short to be found"), (10, None)]
    docs = []
    for i in range(60):
        noise = rng.choices(vocabulary, k=30)
        if i % 4 == 0:
            w = plain_words(items[i % 6][1])
            k = rng.choice((12, 13, 17, 20))
            noise[10:10] = [x.upper() for x in w[:k]]
        docs.append((i, "-\n".join(noise).replace("W", "w" if i % 2 else "W"), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, items[0][1].replace("ö", "ö"), "x"), (103, items[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for a, t in items:
        w = plain_words(t or "")
        for b, x, _ in docs:
            v = plain_words(x or "")
            if any(w[k : k + 13] == v[j : j + 13] for k in range(len(w) - 12) for j in range(len(v) - 12)):
                want.add((b, a))
    assert {(r.doc_id, r.item_id) for r in ct.contaminated(d, it).collect()} == want and want
    assert max(r.match_words for r in ct.contaminated(d, it).filter("doc_id in (102, 103)").collect()) == 20
    assert ct.contaminated(d.limit(0), it).count() == 0 and ct.contaminated(d, it.limit(0)).count() == 0
    assert ct.decontaminated(d, ct.contaminated(d, it)).count() == len(docs) - len({b for b, _ in want})


def test_matches_have_places(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a b c " + " ".join(f"w{i}" for i in range(5, 25)) + " end"), (2, item + " x " + item), (3, "nothing"), (4, " ".join(f"w{i}" for i in range(14)) + " or " + " ".join(f"w{i}" for i in range(9, 30)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.match_words, r.doc_at, r.item_at) for r in ct.contaminated(d, it).collect()}
    assert got == {1: (20, 3, 5), 2: (30, 0, 0), 4: (21, 15, 9)}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(12)]
    docs = [(i, " ".join(rng.choices("xyz", k=20)) + " " + items[i % 12][1] + " " + " ".join(rng.choices("xyz", k=9))) for i in range(40)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in ct.contaminated(d, it).collect()}
    monkeypatch.setattr(ct, "MAX_BLOCK_WORDS", 70)
    assert len(list(ct._blocks(it, 13))) > 3
    assert {tuple(r) for r in ct.contaminated(d, it).collect()} == whole and len(whole) >= 40


def test_repeated_words_take_no_memory(monkeypatch):
    monkeypatch.setattr(ct, "MAX_PLACES", 10_000)
    shard = ct.Shard.of(pa.array(["x " * 4000, "y x x x " * 50, "x " * 12], pa.large_string()), 13)
    h, _ = ct.words(pa.array(["x " * 200], pa.large_string()))
    m = ct.longest_matches(shard, ct.Items([h], [5], 13))
    assert list(zip(m["row"], m["item"], m["words"], m["doc_at"], m["item_at"])) == [(0, 0, 200, 0, 0)]


def test_suffix_array():
    rng = np.random.default_rng(3)
    t = rng.integers(0, 4, 500).astype(np.uint64)
    order = ct.suffix_array(t, 16)
    padded = [tuple(t[i : i + 16]) for i in range(len(t))]
    assert sorted(order) == list(range(500))
    assert all(padded[a] <= padded[b] for a, b in zip(order, order[1:]))


BASE = "The archive holds maps of the sea, and every map is renewed each week after the pass. "
FAQS = [
    (1, "How often is the map renewed?", None, "empty_answer"),
    (2, "How often is the map renewed?", "&nbsp; ", "empty_answer"),
    (3, "How often is the map renewed?", "(blank)", "empty_answer"),
    (4, "How often is the map renewed?", "A: how often is the map renewed", "copied_question"),
    (5, "How often is the map renewed?", "How often is the map renewed? How often is the map renewed?", "copied_question"),
    (6, "How often is the map renewed?", "Sorry, I am unable to answer this question.", "refusal"),
    (7, "Wie oft wird die Karte erneuert?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
    (8, "How often is the map renewed?", "La carte est renouvelée toutes les semaines après le passage.", "wrong_language"),
    (9, "नक्शा कितनी बार बदलता है?", "The map is renewed each week after the pass.", "wrong_language"),
    (10, "How often is the map renewed?", "The map is renewed each week, usually soon after the", "truncated_answer"),
    (11, "How often is the map renewed?", "The map is renewed each week […]", "truncated_answer"),
    (12, "How often is the map renewed?", "The map is renewed each wee", "truncated_answer"),
    (13, "How often is the map renewed?", "The archive holds maps of the sea, and every map is renewed", "truncated_answer"),
    (14, "How often is the map renewed?", "Yes.", None),
    (15, "How often is the map renewed?", "Every 6 hours", None),
    (16, "How often is the map renewed?", "The archive holds maps of the sea and every map is renewed each week after the pass", None),
    (17, "How often is the map renewed?", "How often is the map renewed? Each week.", None),
    (18, "How often is the map renewed?", "Sorry for the wait. The map is renewed each week.", None),
    (19, None, "The map is renewed each week.", None),
    (20, "How often?", "We cannot ship tapes, but the map is renewed each week.", None),
]


def test_pairs(spark):
    rows = [(i, q, a) for i, q, a, _ in FAQS] + [(100 + n, "What?", BASE * 3 + f"Number {n}.") for n in range(4)]
    faqs = spark.createDataFrame(rows, "id long, question string, answer string")
    got = {r.faq_id: r.defect for r in pr.main_defects(pr.defects(faqs)).collect()}
    assert got == {i: d for i, _, _, d in FAQS if d}
    assert pr.defects(faqs.limit(0)).count() == 0


def test_one_end_does_not_clear_a_cut_answer(spark):
    rows = [(n, "What?", BASE * 3 + f"Number {n}.") for n in range(40)]
    rows += [(100, "What?", "The other map is renewed."), (200, "How often?", "The archive holds maps of the sea, and every map is renewed"), (201, "How often?", "The archive holds maps of the sea and every map is renewed each week after the pass")]
    faqs = spark.createDataFrame(rows, "id long, question string, answer string")
    assert [(r.faq_id, r.defect) for r in pr.main_defects(pr.defects(faqs)).collect()] == [(200, "truncated_answer")]


def test_a_language_can_be_added(spark):
    more = pr.Words(
        stopwords=(*pr.DEFAULT.stopwords, ("it", tuple("il lo gli della dello dei che non per con una sono dal alla ogni viene mappa dopo".split()))),
        scripts=(*pr.DEFAULT.scripts, ("el", "α-ωά-ώ")),
        refusals=(*pr.DEFAULT.refusals, re.compile(r"\bnon posso\b[^.!?]{0,25}\brispondere", re.I)),
        signs=(*pr.DEFAULT.signs, "non "),
        fillers=pr.DEFAULT.fillers | {"vuoto"},
    )
    rows = [(1, "Ogni quanto viene rinnovata la mappa?", "Non posso rispondere a questa domanda."), (2, "How often is the map renewed?", "La mappa viene rinnovata ogni settimana dopo il passaggio della missione."), (3, "Ogni quanto?", "(vuoto)"), (4, "How often is the map renewed?", "Ο χάρτης ανανεώνεται κάθε εβδομάδα μετά το πέρασμα.")]
    faqs = spark.createDataFrame(rows, "id long, question string, answer string")
    assert {r.faq_id: r.defect for r in pr.main_defects(pr.defects(faqs, more)).collect()} == {1: "refusal", 2: "wrong_language", 3: "empty_answer", 4: "wrong_language"}
    assert pr.language_of("नक्शा हर घंटे बदलता है") == "hi" and pr.language_of("The map is renewed with the data") == "en" and pr.language_of("SELKARA-1") == ""


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.text(max_size=200))
def test_pair_rules_never_fail(q, a):
    pr.is_empty(a), pr.Pair(q, a).defects()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n0'”é।", max_size=40), max_size=6))
def test_words_and_ends(texts):
    w = pr.words_and_ends(pa.array(texts, pa.large_string()))
    want = []
    for i, t in enumerate(pr._signs(pa.array(texts, pa.large_string()), pr.CUT_MARK.pattern).to_pylist()):
        found = list(re.finditer(r"[a-z0-9]+|[^\x00-\x7f]+", t)) and list(re.finditer(r"(?:[a-z0-9]|[^\x00-\x7f])+", t))
        want += [(i, m[0], 1 if re.match(r"[.!?](\s|$)", t[m.end() :]) else -1 if m is found[-1] else 0) for m in found]
    assert [(r, e) for r, e in zip(w["row"], w["ends"])] == [(r, e) for r, _, e in want]
    assert len(set(w["word"].tolist())) == len({x for _, x, _ in want})


CHARS = en.Characters({c: 50 for c in "’‘“”«»–—…°±µéèàâñóíáúüöäßÅÃÂãçÇÓáÁ½"} | {c: 1 for c in "Яʼ"})


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250"])
def test_wrong_reading_is_found_and_undone(codec):
    for word in ("10°C", "café", "l’été", "Größe–Maß"):
        read = "".join(chr(b) if b < 128 else en.BACK[codec][b] for b in word.encode())
        assert en.solve(read, 1, 1, [], CHARS)[0] == word


def test_double_reading():
    read = "l’été–10°C".encode().decode("cp1252").encode().decode("cp1252")
    assert en.solve(read, 1, 1, [], CHARS)[0] == "l’été–10°C"


def test_long_runs_are_searched_whole():
    for word in ("é" * 40, "«" + "ñ" * 30 + "»x", "a" * 90 + "é"):
        read = word.encode().decode("cp1252")
        assert en.solve(en.core(read), 1, 1, [], CHARS)[0] == word
    half = "Яʼ" + "é".encode().decode("cp1252") + "Яʼ"
    assert en.solve(half, 1, 1, [], CHARS) == ("ЯʼéЯʼ", True)


@pytest.mark.parametrize("text", ["ESTAÇÃO DE LAGUÃO", "ÂNGELIM – CÃIS", "Янка and Στάθμη", "5577 Å and the ½-hour", "Some see Ã© where é should be, or â€™ for a quote", "“Quoted” – ±5 °C…", "plain", "„MENÜ“"])
def test_proper_text_is_no_evidence(text):
    assert not any((en.solve(en.core(t), 1, 1, [], CHARS) or ("", False))[1] for t in en.TOKEN.findall(text))


def test_viterbi_fills_lost_bytes():
    assert en.viterbi("caf�", {"cafés": 3.0}) is None
    assert en.viterbi("caf�", {"café": 3.0, "cafè": 1.0})[1] == "café"
    assert en.viterbi("cafÃ�", {"café": 3.0, "cafè": 1.0})[1] == "café"
    assert en.viterbi("Ãtat", {"État": 3.0})[1] == "État"
    assert en.solve("caf�", 1, 1, [], CHARS) == ("caf�", True) and en.solve("�", 1, 1, [], CHARS) is None


def test_word_frequencies_decide():
    words = [("enregistrées", 40, 40), ("enregistrês", 3, 3)]
    assert en.solve("enregistrÈes", 1, 1, words, CHARS) == ("enregistrées", True)
    assert en.solve("enregistrÈes", 20, 20, words, CHARS) is None
    assert {"enregistrÈes", "enregistr�es", "enregistr��es"} <= en.images("enregistrées")


def test_garbled(spark):
    good = "Le relevé de l’été montre la fenêtre à 5 °C près de la côte."
    rows = [(i, good, "k") for i in range(40)]
    rows += [(100, good.encode().decode("cp1252"), "k"), (101, re.sub(r"[\x80-\x9f]", "", good.encode().decode("latin_1")), "k"), (102, re.sub(r"[^\x00-\x7f]", "�", good), "k"), (103, good.encode("cp1252").decode("cp1251"), "k"), (104, "Some see Ã© where the name has é.", "k"), (105, None, "k"), (106, "", "k"), (107, "ASCII only", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r.doc_id for r in en.garbled(docs).collect()} == {100, 101, 102, 103}
    got = {r.doc_id: r.restored_text for r in en.restore(docs).collect()}
    assert got[100] == good and got[102] == good and got[103] == good
    assert en.garbled(docs.limit(0)).count() == 0


def test_channels_are_asked_whatever_the_characters(spark):
    long = "données-" * 8 + "enregistrées"
    good = f"La précision des données enregistrées est bonne, {long} et geringfügig à télécharger."
    rows = [(i, f"{good} Žilina Ÿ-axis Èze Última", "k") for i in range(40)]
    pairs = (("cp1252", "mac_roman", "enregistrées"), ("cp1252", "cp850", "précision"), ("cp1252", "mac_roman", long), ("mac_roman", "cp1252", "geringfügig"), ("mac_roman", "cp1252", "télécharger"))
    rows += [(100 + n, f"Note {word.encode(wrote).decode(read)} here", "k") for n, (wrote, read, word) in enumerate(pairs)]
    rows += [(200, "The Èze and Última of Žilina – à", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r.doc_id for r in en.garbled(docs).collect()} == {100, 101, 102, 103, 104}
    assert {r.restored_text for r in en.restore(docs).collect()} == {f"Note {word} here" for _, _, word in pairs}


def test_copies_of_damage_are_found(spark):
    good = "Le relevé montre une fenêtre près de la côte"
    bad = good.encode("cp1252").decode("mac_roman")
    rows = [(i, f"{good}, numéro {i}.", "k") for i in range(12)] + [(100 + i, bad, "k") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r.doc_id for r in en.garbled(docs).collect()} == set(range(100, 130))
    assert {r.restored_text for r in en.restore(docs).collect()} == {good}


def test_temperature():
    tokens = {"a": 900, "b": 90, "c": 10}
    entropy = lambda w: -sum(x * np.log(x) for x in w.values())
    a, w = mx.tempered(tokens, entropy=1.0)
    assert 0 < a < 1 and abs(sum(w.values()) - 1) < 1e-9 and abs(entropy(w) - 1.0) < 1e-6
    assert mx.tempered(tokens, entropy=9.0) == (1.0, {s: pytest.approx(1 / 3) for s in tokens})
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    assert mx.tempered(tokens, targets, max_repeats={"a": 1, "b": 1, "c": 2}, budget=40)[0] == 1.0
    a, w = mx.tempered(tokens, targets, max_repeats={"a": 1, "b": 2, "c": 4}, budget=1000)
    assert 0 < a < 1 and w["c"] * 1000 <= 41 + 1e-6 and w["b"] * 1000 <= 181 + 1e-6 and w["c"] > 0.01
    assert mx.tempered({}) == (0.0, {})


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK_DOCS", 50)
    monkeypatch.setattr(mx, "SPAN", 4)
    rows = [(i, "Big source", 10) for i in range(3000)] + [(10_000 + i, "small", 7) for i in range(50)] + [(20_000, "untargeted", 5), (20_000, "small", 7)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("source", mx.source_name(F.col("source")))
    targets = spark.createDataFrame([("big-source", 0.9, 1), ("SMALL ", 0.08, 3), ("absent", 0.02, 2), ("nothing", None, None)], "source string, target_share double, max_repeats int")
    plan = mx.plan(sizes, targets)
    assert {r.exponent for r in plan.collect()} == {1.0}
    mixed = mx.mix(sizes, plan)
    got = {r.source: r for r in mx.shares(mixed, plan).collect()}
    assert got["small"].most_repeats <= 3 and got["big_source"].most_repeats == 1 and got["absent"].tokens_used == 0
    assert abs(got["big_source"].actual_share - 0.9 / 0.98) < 0.01 and abs(got["small"].actual_share - 0.08 / 0.98) < 0.01
    uses = mixed.collect()
    assert {r.doc_id for r in uses if r.source == "untargeted"} == set()
    assert {tuple(r) for r in mx.mix(sizes, plan).collect()} == {tuple(r) for r in uses}
    # each epoch is a permutation of its own, without gaps in a block, and no document is used twice in one
    assert max(sum(r.epoch == e and r.doc_id == d for r in uses) for e, d in {(r.epoch, r.doc_id) for r in uses if r.doc_id != 20_000}) == 1
    blocks = {}
    for r in uses:
        blocks.setdefault((r.source, r.epoch, r.block), []).append(r.position)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in blocks.values()) and len(blocks) > 20
    more = mx.plan(sizes, targets, 60_000)
    assert 0 <= more.first().exponent < 1
    got = {r.source: r for r in mx.shares(mx.mix(sizes, more), more).collect()}
    assert got["small"].most_repeats <= 3 and got["big_source"].most_repeats <= 1
    none = mx.plan(sizes.limit(0), targets)
    assert mx.mix(sizes.limit(0), none).count() == 0 and mx.shares(mx.mix(sizes.limit(0), none), none).count() == 4


def test_tokenizer_pattern_agrees(spark):
    public = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs, ours = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("a", public.PATTERN), ("b", mx.PATTERN)))
    for text in ("It's 12.5 °C\n\n  here ", "नमस्ते  दुनिया", "  x\t\ny "):
        assert theirs.encode_ordinary(text) == ours.encode_ordinary(text)
    docs = spark.createDataFrame([(1, "a b", "S"), (2, None, "S"), (3, "", "S"), (4, "x", None), (None, "x", "S")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.tokens) for r in mx.token_sizes(docs).collect()] == [(1, 2)]
