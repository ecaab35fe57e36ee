"""Pages whose main body is template residue, filler, an error message or a notice that scripts are needed.

A regularized logistic regression judges segments of the main body: each line
(each sentence of a long line), and a window around each thing that looks like an unfilled placeholder. Its
features are hashed words, pairs of words and runs of signs, the length, and the
words of the page's title. It is fitted on weak labels: phrases that such pages
use (error messages, script notices, filler, placeholder syntax) and the response
status of short pages are bad, prose on pages with status 200 is good. The page's
verdict follows from its segments: bad lines make up most of the body's
characters (the title's line aside), or a placeholder's window is bad and the
placeholder's syntax, checked exactly, is there.

The fit uses at most 3 * SAMPLE_PAGES pages: one sample of all, one of pages with
a phrase or an error status, one of pages with signs of placeholders, each in the order of a hash of the id; every page is
scored. ``validate`` leaves out each site in turn, fits on the others and reports the
agreement with the weak labels on it.

Cases: pages with a null, empty or blank body are no cases; a null title gives no
title features; a null status is no error; copies get the same verdict; very long
bodies are scored whole; a table without any bad or any good label finds only what
the phrases themselves find; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, raw, runs, word_hashes
from .main_body import bare

SAMPLE_PAGES, WEIGHTS = 1500, 1 << 16
#: Good segments for each bad one in the fit.
GOOD = 8
#: Characters of context on both sides of a placeholder.
WINDOW = 45
SIGN_BYTES = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])

SENTENCE = re.compile(r"(?<=[.!?।])\s+")
_ID = r"[A-Za-z][\w.\- ]{0,40}?"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_ID}\s*\}}\}}|\{{%\s*{_ID}\s*%\}}|[$#]!?\{{\s*{_ID}\s*\}}|<%=?\s*{_ID}\s*%>|%%{_ID}%%|@@{_ID}@@|(?<!\w)__[A-Za-z][A-Za-z0-9.]*(?:_[A-Za-z0-9.]+)*__(?!\w)"
    rf"|\[\[\s*{_ID}\s*\]\]|\[(?:node|site|user|field|term|page|current-\w+):[\w:.\-]+\]|\[\s*insert {_ID} here\s*\]|\[{_ID} goes here\]|<<\s*{_ID}\s*>>|<?\?(?:php|=)\s[^<>?]{{1,60}}\?>|(?<![\w$#{{(=\]]) ?\{{[a-z][a-z_]*(?:\.[a-z_]+)*\}}(?![\w}}(])",
    re.I,
)
#: Words with which a text explains syntax to its readers.
EXPLAINS = re.compile(r"\b(?:write|type|enter|stands? for|tokens?|syntax|placeholders?|replaced?|variables?|means|puts? in|your own|example|called|curly|brackets?|escape[ds]?|substitut\w+|expands?)\b|\bschreib\w+|\bersetz\w+|\bécri\w+|\bremplac\w+|\bescrib\w+|\breemplaz\w+|\bलिखें", re.I)

#: Words in longer sentences that leave open whether the page speaks of errors or is one.
SPEAKS = re.compile(r"script|error|not found|placeholder|coming soon|maintenance|denied|lorem|ipsum|timed out|unavailable", re.I)
FILLER = re.compile(r"\b(?:lorem|ipsum)\b.*\b(?:sit|sed|nec|amet|lorem|ipsum|vel|dolor)\b", re.I)
PHRASES = re.compile(
    "|".join(
        (
            r"(?:page|record|file|document|item|address|resource|link|view|content|entry|site|service)\b.{0,60}\b(?:not (?:be )?(?:found|available|exist|shown|loaded|displayed)|does not exist|no longer (?:exists|available)|was (?:withdrawn|removed|deleted)|cannot be (?:found|shown|loaded|displayed)|failed to load|is (?:offline|unavailable|missing|gone)|has (?:moved|been removed|been withdrawn))",
            r"(?:could not|couldn't|cannot|can't|unable to|failed to|trouble) (?:find|load|open|show|display|locate|serve|connect|loading|opening|showing|reach)\b.{0,50}\b(?:page|record|file|document|view|item|content|address|stream|server|database|service)",
            r"\b(?:internal )?(?:server|database|gateway|application|fatal|parse|syntax) error\b|\bsomething went wrong\b|\berror (?:code|id|no\.?|number)? ?#?\d+\b|\b(?:http|status|code) ?[45]\d\d\b|\b[45]\d\d\b.{0,20}\b(?:error|not found|forbidden|unavailable)|\btimed out\b|\btimeout\b|\baccess denied\b|\bforbidden\b|\bpermission denied\b|\bbad gateway\b|\bservice unavailable\b|\boffline for maintenance\b|\bunder maintenance\b|\btraceback\b|\bstack trace\b|\bexception in\b|^\s*(?:warning|notice|fatal error|uncaught|traceback)\b.{0,80}(?:\bline \d+|include|undefined|at \w+)|\brequest id [0-9a-f]{4,}|\bsession (?:has )?expired\b|\bnothing to (?:show|see)\b|\bno (?:results|entries|content) (?:to show|found|available)\b",
            r"(?:enable|allow|activate|switch(?:ed)? on|turn(?:ed)? on|permit|unblock|need|require|support|without|disabled?|blocked|turned off|switched off)\w*\b.{0,45}\b(?:java ?scripts?|scripts?|scripting|active content)|(?:java ?scripts?|scripts?|scripting|active content)\b.{0,45}\b(?:enabled?|allow|activate|switch|turn|permit|need|require|disabled?|blocked|support|off\b)|\bbrowser is out of date\b|\bupdate your browser\b",
            r"\blorem\b|\bipsum\b|\bdolor sit\b|\b(?:sample|dummy|placeholder|example|test) (?:paragraph|text|entry|page|body|content|heading|title|description)\b|\btext to be added\b|\bto be (?:added|written|completed|supplied|filled)\b|\b(?:description|content|text|body|summary|details) (?:pending|goes here|to follow|coming soon|missing)\b|\bcoming soon\b|^\W*(?:tbd|tba|tbc|todo|xxx)\b|\btbd tbd\b|\b(?:write|type|insert|enter|put|add) (?:something|your|the|a) .{0,40}\b(?:here|this box|this field|below)\b|\breplace with real\b|\b(?:headline|heading|caption|tagline|logo|copy|image|picture|name|address)\b.{0,20}\b(?:goes|belongs|comes)\b.{0,20}\b(?:here|in this spot|there)|\bwords of copy\b|^\W*x{2,}(?:\W+x{2,})+\W*$|\bunder construction\b|\bnew page\b.{0,12}$",
            r"(?:seite|datei|dokument|eintrag|inhalt|adresse)\b.{0,50}\b(?:nicht (?:gefunden|vorhanden|verfügbar|angezeigt|geladen)|existiert nicht|entfernt)|\bein fehler ist\b|\bfehler ?\d{3}|(?:javascript|skripte?)\b.{0,40}\b(?:aktivieren|einschalten|erlauben|deaktiviert|benötigt|nötig)|\baktivieren sie\b",
            r"(?:page|fichier|document|contenu|adresse|fiche)\b.{0,50}\b(?:introuvable|n[’']existe (?:pas|plus)|indisponible|pas (?:été )?trouvée?|supprimée?|n[’']est (?:pas|plus) disponible)|\bune erreur (?:est|s)|(?:javascript|scripts?)\b.{0,40}\b(?:activer|activez|désactivé|nécessaire|requis)|\b(?:activez|veuillez activer|autorisez)\b",
            r"(?:página|archivo|documento|contenido|dirección|registro)\b.{0,50}\b(?:no (?:existe|encontrad[ao]|disponible|se (?:encuentra|encontró|puede)|está disponible|fue encontrad[ao])|eliminad[ao])|\bno se (?:ha )?(?:encontrado|encontró|pudo)\b|\bha ocurrido un error\b|(?:javascript|scripts?)\b.{0,40}\b(?:activar|active|habilit\w+|desactivado|necesari\w+)|\b(?:active|habilite|permita) (?:javascript|los scripts)",
            r"(?:पृष्ठ|पन्ना|फ़ाइल|सामग्री|पेज)[^।]{0,40}(?:नहीं (?:मिला|मिली|है|हो)|उपलब्ध नहीं|हटा)|(?:स्क्रिप्ट|जावास्क्रिप्ट)[^।]{0,40}(?:चालू|सक्षम|आवश्यक|अनुमति|बंद)|त्रुटि",
        )
    ),
    re.I,
)


_SYNTAX = re.compile(r"[\[{}%<@]|__|\?(?:php|=)")


def placeholders(text: str) -> list[tuple[int, int]]:
    """Where an unfilled placeholder's syntax stands in text."""
    return [m.span() for m in PLACEHOLDER.finditer(text)] if _SYNTAX.search(text) else []


def segments(text: str, noise: list[bool | None], title: str | None) -> list[tuple[int, int, str]]:
    """(kind, weight, text) of a page: kind 0 is a line of the body, 1 the window around a placeholder, 2 the title's line."""
    head, out = bare(title or ""), []
    size, syntax = len(title or ""), bool(_SYNTAX.search(text))
    for line, gone in zip(text.split("\n"), noise):
        if not line.strip():
            continue
        # a placeholder counts wherever it stands, other text in the body alone
        for s, e in placeholders(line) if syntax else ():
            out.append((1, 0, f"{line[max(0, s - WINDOW) : s]} {line[s:e]} {line[e : e + WINDOW]}"))
        if gone:
            continue
        kind = 2 if head and abs(len(line) - size) < 9 and bare(line) == head else 0
        for part in SENTENCE.split(line) if len(line) > 120 else (line,):
            if part.strip():
                out.append((kind, len(part.strip()), part))
    return out


def weak_label(kind: int, text: str, status: int | None, body: int) -> float:
    """1 bad, 0 good, nan unknown."""
    if kind == 1:
        return 0.0 if EXPLAINS.search(text) else 1.0
    if kind == 2:
        return np.nan
    if body >= 900 or len(text) >= 90:
        if body < 900 and FILLER.search(text):
            return 1.0
        if SPEAKS.search(text):
            return np.nan
    elif PHRASES.search(text):
        return 1.0
    if status is not None and 400 <= status < 600 and body < 160:
        return 1.0
    return 0.0 if (status is None or status == 200) and len(text) >= 30 else np.nan


def features(texts: list[str], titles: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, index) pairs: hashed words, pairs of words, runs of signs, title words, length and kind."""
    rows, idx = [], []
    apart = np.where(kinds == 1, np.uint64(0x51), np.uint64(0))
    for salt, source in ((0, texts), (1, titles)):
        data, bounds = raw(pc.utf8_lower(pa.array(source, pa.large_string())))
        h, of = word_hashes(np.where((data >= 49) & (data <= 57), 48, data).astype(np.uint8), bounds)
        # windows have weights of their own, as their words are ordinary ones
        h = h + apart[of]
        rows.append(of), idx.append(mixed(h + np.uint64(salt)) % np.uint64(WEIGHTS))
        if not salt:
            near = np.flatnonzero(of[1:] == of[:-1])
            rows.append(of[near]), idx.append(mixed(h[near] * np.uint64(3) + h[near + 1]) % np.uint64(WEIGHTS))
            h, of = word_hashes(data, bounds, SIGN_BYTES)
            rows.append(of), idx.append(mixed(h + np.uint64(7)) % np.uint64(WEIGHTS))
            size = np.minimum(np.log2(np.diff(bounds) + 1).astype(np.uint64), np.uint64(11))
            n = np.arange(len(source))
            rows.append(n), idx.append(mixed(size + np.uint64(100) + np.uint64(50) * (kinds == 1)) % np.uint64(WEIGHTS))
    row, at = np.concatenate(rows), np.concatenate(idx).astype(np.int64)
    return row.astype(np.int64), at


def fit(row: np.ndarray, at: np.ndarray, labels: np.ndarray, l2: float = 1e-5, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with L2 penalty and balanced classes; the last is the bias. Without both classes all weights are 0."""
    w, g2, n = np.zeros(WEIGHTS + 1), np.full(WEIGHTS + 1, 1e-6), len(labels)
    if not n or not 0 < labels.mean() < 1:
        return w
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    value = scale[row]
    for _ in range(rounds):
        z = np.bincount(row, w[at] * value, n) + w[-1]
        d = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        g = np.bincount(at, d[row] * value, WEIGHTS + 1) + l2 * w
        g[-1] = d.sum()
        g2 += g * g
        w -= 0.7 * g / np.sqrt(g2)
    return w


def scores(w: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, w[at], n) / np.sqrt(np.maximum(1, np.bincount(row, minlength=n))) + w[-1]


#: Signs of which each placeholder holds one.
SIGNS = ("{", "%%", "@@", "__", "[[", "<<", "<%", "?php", "?=", " here]", " HERE]", "[node:", "[site:", "[user:", "[field:", "[term:", "[page:", "[current-")


def _sample(bodies: DataFrame) -> list[tuple[int, str, list, str | None, int | None]]:
    rows = bodies.filter("text is not null")
    part = F.pmod(F.xxhash64("page_id", F.lit(7)), F.lit(1 << 30)).alias("part")
    odd = (F.col("status_code") >= 400) | (F.length("text") < 1000) & F.col("text").rlike(r"(?i)lorem|script|not found|error|placeholder|sample|\{\{|%%|\$\{|\[\[|unavailable|tbd|request id|oops|sorry")
    signs = F.lit(False)
    for sign in SIGNS:
        signs = signs | F.contains("text", F.lit(sign))
    # numbers alone are chosen; the texts of the chosen come in one more scan, by a join with at most 3 * SAMPLE_PAGES rows
    chosen = [rows.filter(c).select(part, "row").orderBy("part", "row").limit(SAMPLE_PAGES).select("row") for c in (F.lit(True), odd, signs)]
    ids = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    every = rows.join(F.broadcast(ids), "row").select("site", "text", "noise", "title", "status_code")
    return [(r["site"], r["text"], r["noise"], r["title"], r["status_code"]) for r in every.toLocalIterator()]


def _taught(sample: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts, titles, kinds, labels, sites = [], [], [], [], []
    for site, text, noise, title, status in sample:
        parts = segments(text, noise, title)
        body = sum(n for k, n, _ in parts if k == 0)
        for kind, _, part in parts:
            y = weak_label(kind, part, status, body)
            if y == y:
                texts.append(part), titles.append(title or ""), kinds.append(kind), labels.append(y), sites.append(site)
    y = np.array(labels)
    # good segments are many; those of the lowest hash suffice, GOOD to a bad one
    order = mixed(np.arange(len(y), dtype=np.uint64) + np.uint64(5))
    order[y > 0] = 0
    order[np.array(kinds) == 1] = 0
    keep = np.sort(np.argsort(order, kind="stable")[: int(y.sum() * (1 + GOOD)) + kinds.count(1) + 500])
    texts, titles = [texts[i] for i in keep], [titles[i] for i in keep]
    row, at = features(texts, titles, np.array(kinds)[keep]) if texts else (np.empty(0, np.int64),) * 2
    return row, at, y[keep], np.array(sites)[keep]


def train(bodies: DataFrame) -> np.ndarray:
    row, at, labels, _ = _taught(_sample(bodies))
    return fit(row, at, labels)


def validate(bodies: DataFrame, folds: int = 10) -> dict[str, float]:
    """Leave out each site in turn (or, of more sites than folds, each group of sites by their hash), fit on the others, and report the agreement with the weak labels on the ones left out."""
    row, at, labels, sites = _taught(_sample(bodies))
    names, of = np.unique(sites, return_inverse=True)
    fold = of % folds
    hit = found = true = scored = 0
    for k in range(min(folds, len(names))):
        seen = fold != k
        index = np.cumsum(seen) - 1
        w = fit(index[row[seen[row]]], at[seen[row]], labels[seen])
        bad, y = scores(w, row, at, len(labels)) > 0, labels > 0
        hit += (bad & y & ~seen).sum()
        found += (bad & ~seen).sum()
        true += (y & ~seen).sum()
        scored += (~seen).sum()
    return {"sites": len(names), "segments": int(scored), "precision": hit / max(1, found), "recall": hit / max(1, true)}


def judge(w: np.ndarray, pages: list[tuple[str | None, list | None, str | None]]) -> list[bool]:
    """The verdict of each (text, noise, title)."""
    texts, titles, kinds, weights, of = [], [], [], [], []
    for i, (text, noise, title) in enumerate(pages):
        for kind, weight, part in segments(text, noise, title) if text else ():
            texts.append(part), titles.append(title or ""), kinds.append(kind), weights.append(weight), of.append(i)
    kind, weight, page, n = np.array(kinds, np.int64), np.array(weights, np.float64), np.array(of, np.int64), len(pages)
    if not texts:
        return [False] * n
    row, at = features(texts, titles, kind)
    bad = scores(w, row, at, len(texts)) > 0
    body = np.bincount(page, weight * (kind == 0), n)
    wrong = np.bincount(page, weight * (kind == 0) * bad, n)
    residue = np.bincount(page, (kind == 1) & bad, n) > 0
    named = np.bincount(page, (kind == 2) & bad, n) > 0
    return list(residue | (wrong > 0.5 * body) | (body == 0) & named)


def judged(w: np.ndarray):
    """judge() for the pages of a batch with text, noise and title."""

    def of(batch: pa.RecordBatch) -> list[bool]:
        return judge(w, list(zip(*(batch.column(c).to_pylist() for c in ("text", "noise", "title")))))

    return of


def _judge(w: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            yield pa.RecordBatch.from_arrays([batch.column("page_id").filter(pa.array(judged(w)(batch), pa.bool_()))], names=["page_id"])

    return task


def residue_pages(bodies: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """(page_id) of the pages without real content; bodies as from main_body.main_bodies."""
    w = train(bodies) if w is None else w
    return bodies.select("page_id", "title", "text", "noise").mapInArrow(_judge(w), "page_id long")
