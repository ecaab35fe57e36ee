"""The main body of web pages, by a style tree of each site.

The DOMs of a site's pages are merged into one style tree: a node is a place, its
path of containers from the body down with their ids, classes and roles (numbers and
hash suffixes in class names removed, so that builds of one style merge), and its
parent is the place around it. The importance of what stands in a node itself is
1 - (1 - (C + D) / 2)(1 - P):

- content importance C: 1 minus the entropy, relative to the pages that have the
  node, of its lines, weighted by their characters. A menu that all pages share has
  C near 0, running text C near 1;
- lead importance D: the entropy of the node's first lines over its pages. A box
  of teasers has other lines each time under one of a few captions;
- presentation importance P: the entropy of the sequences of elements in the
  node. A block of five links looks the same everywhere, an article doesn't.

The composite importance of a branch is the mean over all nodes below it, weighted by
their characters. A node on few pages says little by itself: its own importance
counts as its pages, that of the branch around it as PRIOR pages. Nodes whose importance
is under LEAST are noise, and a branch of which all nodes are noise is removed whole,
with nodes that were never seen elsewhere. Each line of content_text takes the verdict
of the DOM line with its text. A line without a DOM (no HTML, or cut off)
takes the verdict that its text has on the site's other pages, and a line unseen
there is judged by a regularized logistic regression on hashed words, shape and
place, fitted on a bounded sample of at most SAMPLE_PAGES pages that the tree
labelled.

Plan: one Arrow pass parses each page and writes, once, its lines' node and key
hashes beside the text; all later steps read that table without its texts, which are joined with the verdicts once, at the end. The tree is
JVM aggregation over hashes (partial aggregates in each task, so a site with a third
of the pages is no hot key). Verdicts reach the pages by joins of hashes on (site, node) and
(site, line), salted, as one node of one site can stand on a third of all pages; they
come back as one row a page.

Cases: a null or empty text has no lines; unclosed tags end where their parent
ends; duplicate rows are pages of their own; a site of one page keeps all but what
the regression drops; a page with null url belongs to the site ''; a place more than
DEPTH containers deep looks up to the DEPTH nearest; empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs, site_of

#: Importance below which a node is noise, and the pages as which the branch around it counts.
LEAST, PRIOR = 0.8, 4.0
#: A line's text must stand on so many pages of its site to have a verdict for lines without a DOM.
MIN_PAGES = 3
#: Containers above a node that are looked at.
DEPTH = 64
#: Salts of the joins on (site, node) and (site, line).
SALTS = 16
#: Most pages on which the regression is fitted, and its number of weights.
SAMPLE_PAGES, WEIGHTS = 1500, 1 << 14

TAG = re.compile(r"(<!--.*?(?:-->|$)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|$)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)", re.S | re.I)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
ATTRIBUTE = re.compile(r"\b(id|class|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
HASHED = re.compile(r"^([a-z]+?|[\w-]+?[-_])(?=[a-f]*\d)[0-9a-f]{4,10}$|^([a-z])[0-9a-f]{4}$")
LEAVES = {"p", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "pre", "blockquote", "caption", "figcaption"}
BLOCKS = LEAVES | {"div", "ul", "ol", "dl", "table", "tbody", "thead", "aside", "nav", "main", "article", "section", "footer", "header", "form", "small", "noscript", "body", "figure", "fieldset", "address"}
ENDED = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY = {"li": {"li", "p"}, "tr": {"tr", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
IGNORED, BREAK, OPEN, CLOSE, CELL, CELL_END, HEAD, HEAD_END = range(8)


def style(tag: str, name: str) -> str:
    """The element with its id, classes and role, without numbers and hash suffixes."""
    out = name
    for _, value in ATTRIBUTE.findall(tag):
        for v in value.lower().split():
            m = HASHED.match(v)
            out += "." + re.sub(r"\d+", "0", (m[1] or m[2]) if m else v)
    return out


def action(tag: str) -> tuple[int, str, str]:
    m = NAME.match(tag)
    if not m:
        return IGNORED, "", ""
    name, end = m[2].lower(), bool(m[1])
    if name in ("br", "hr"):
        return BREAK, "", ""
    if name in ("td", "th"):
        return (CELL_END if end else CELL), "td", style(tag, "td")
    if name in ("head", "title"):
        return (HEAD_END if end else HEAD), "", ""
    if name in BLOCKS:
        return (CLOSE if end else OPEN), name, style(tag, name)
    return IGNORED, "", ""


_actions: dict[str, tuple[int, str, str]] = {}
_nodes: dict[tuple[int, str], int] = {}


def place(parent: int, key: str) -> int:
    """The node of a container with this style in a parent node."""
    node = _nodes.get((parent, key))
    if node is None:
        node = number(f"{parent}>{key}")
        if len(_nodes) < 50_000:
            _nodes[parent, key] = node
    return node


def dom_lines(page: str) -> tuple[list[tuple[int, str, str]], dict[int, int]]:
    """(node, leaf element, text) of each line of a page, in order, and the parent of each node (0 is the page); the head has none."""
    out: list[tuple[int, str, str]] = []
    parents: dict[int, int] = {}
    # element name, leaf or not, node
    stack: list[tuple[str, bool, int]] = []
    text: list[str] = []
    head = False

    def flush() -> None:
        line = " ".join("".join(text).split()).strip("| ")
        text.clear()
        if line:
            name, leaf, node = stack[-1] if stack else ("", False, 0)
            out.append((node, name if leaf else "", html.unescape(line) if "&" in line else line))

    for k, part in enumerate(TAG.split(page)):
        if not k % 2:
            # a line of the markup between two elements is no text
            if part and not head and (text or not part.isspace()):
                text.append(part)
            continue
        act = _actions.get(part)
        if act is None:
            act = action(part)
            if len(_actions) < 50_000:
                _actions[part] = act
        kind, name, key = act
        if kind == IGNORED:
            continue
        if kind == BREAK:
            if text:
                flush()
        elif kind == OPEN or kind == CELL:
            if kind == CELL:
                if text:
                    text.append(" | ")
                if stack and stack[-1][0] == "td":
                    stack.pop()
            else:
                if text:
                    flush()
                if name in CLOSED_BY:
                    while stack and stack[-1][0] in CLOSED_BY[name]:
                        stack.pop()
                elif name != "small":
                    while stack and stack[-1][0] in ENDED:
                        stack.pop()
            above = stack[-1][2] if stack else 0
            if name in LEAVES:
                stack.append((name, True, above))
            else:
                node = place(above, key)
                parents[node] = above
                stack.append((name, False, node))
        elif kind == CLOSE:
            if text:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif kind == CELL_END:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "td":
                    if i < len(stack) - 1:
                        if text:
                            flush()
                    del stack[i:]
                    break
                if stack[i][0] == "tr":
                    break
        else:
            head = kind == HEAD
            text.clear()
    if text:
        flush()
    return out, parents


def number(text: str) -> int:
    """A hash of text as a positive long."""
    return xxhash.xxh64_intdigest(text) >> 1 or 1


#: The node of what stands in no container.
PAGE = number("")

_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def key_of(line: str) -> int:
    """A hash of a line without case, spaces and the values of its digits."""
    data = line.lower().encode("utf-8", "replace")
    data = data if data.isascii() else data.replace(b"\xc2\xa0", b"")
    return xxhash.xxh64_intdigest(data.translate(_DIGITS, b" \t\r\f\v")) >> 1 or 1


def bare(line: str) -> str:
    """A line without case and signs, such as those that mark headings and list items."""
    return re.sub(r"[\W_]+", "", line.lower()) or "".join(line.split())


def aligned(text: str, dom: list[tuple[int, str, str]]) -> list[int]:
    """Of each line of text, the index in dom of its DOM line in order, -1 without one, -2 if it is blank."""
    exact: dict[str, list[int]] = {}
    loose: dict[str, list[int]] | None = None
    taken: set[int] = set()
    for i in range(len(dom) - 1, -1, -1):
        exact.setdefault(dom[i][2], []).append(i)
    out = []
    for line in text.split("\n"):
        words = line.split()
        if not words:
            out.append(-2)
            continue
        found, at = -1, exact.get(" ".join(words))
        while at and found < 0:
            i = at.pop()
            if i not in taken:
                found = i
        if found < 0 and dom:
            if loose is None:
                loose = {}
                for i in range(len(dom) - 1, -1, -1):
                    loose.setdefault(bare(dom[i][2]), []).append(i)
            at = loose.get(bare(line))
            while at and found < 0:
                i = at.pop()
                if i not in taken:
                    found = i
        if found >= 0:
            taken.add(found)
        out.append(found)
    return out


PARSED = "row long, page_id long, site long, title string, status_code int, text string, node array<long>, key array<long>, size array<int>, forms array<struct<node:long,form:long,first:long,path:array<long>>>"
_FORM = pa.struct([("node", pa.int64()), ("form", pa.int64()), ("first", pa.int64()), ("path", pa.list_(pa.int64()))])


def _path(node: int, parents: dict[int, int]) -> list[int]:
    """The containers around a node, from the nearest to the farthest."""
    out = []
    while node and len(out) < DEPTH:
        node = parents.get(node, 0)
        out.append(node)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # a number for each row, as ids may be null or repeated; the result is written before it is used
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in runs(batches):
        nodes, keys, sizes, forms = [], [], [], []
        for text, page in zip(batch.column("text").to_pylist(), batch.column("html").to_pylist()):
            if text is None:
                nodes.append([]), keys.append([]), sizes.append([]), forms.append([])
                continue
            dom, parents = dom_lines(page) if page else ([], {})
            at = aligned(text, dom)
            # the page itself is a node too
            nodes.append([dom[i][0] or PAGE if i >= 0 else 0 if i == -2 else -1 for i in at])
            lines = text.split("\n")
            key = [key_of(x) if i != -2 else 0 for x, i in zip(lines, at)]
            keys.append(key)
            sizes.append([len(x) for x in lines])
            seen: dict[int, list[str]] = {}
            first: dict[int, int] = {}
            for i, k in zip(at, key):
                if i >= 0:
                    seen.setdefault(dom[i][0], []).append(dom[i][1])
                    first.setdefault(dom[i][0], k)
            forms.append([{"node": p or PAGE, "form": number(" ".join(x)), "first": first[p], "path": _path(p, parents)} for p, x in seen.items()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(batch.num_rows) + row), *(batch.column(c) for c in ("page_id", "site", "title", "status_code", "text")), pa.array(nodes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(forms, pa.list_(_FORM))],
            names=["row", "page_id", "site", "title", "status_code", "text", "node", "key", "size", "forms"],
        )
        row += batch.num_rows


def parsed(pages: DataFrame) -> DataFrame:
    """Each page with its lines' nodes (0: blank, -1: not in the DOM), keys and sizes, written once."""
    rows = pages.select(F.col("id").cast("bigint").alias("page_id"), F.xxhash64(site_of()).alias("site"), "title", F.col("status_code").cast("int").alias("status_code"), F.col("content_text").alias("text"), F.col("content_html").alias("html"))
    return materialize(rows.mapInArrow(_parse, PARSED))


def style_tree(parse: DataFrame) -> DataFrame:
    """(site, node, parent, pages, content, lead, presentation, own, importance) of each site's nodes with lines."""
    lines = parse.select("site", F.explode(F.arrays_zip("node", "key", "size")).alias("x")).select("site", "x.*").filter("node > 0")
    per_key = lines.groupBy("site", "node", "key").agg(F.count("*").alias("k"), F.sum("size").alias("chars"))
    content = per_key.groupBy("site", "node").agg((F.sum(F.col("chars") * F.log("k")) / F.greatest(F.sum("chars"), F.lit(1))).alias("h"), F.sum("chars").alias("chars"))
    forms = parse.select("site", F.explode("forms").alias("x")).select("site", "x.*")

    def entropy(of: str, name: str) -> DataFrame:
        n = forms.groupBy("site", "node", of).agg(F.count("*").alias("n"), F.first("path").alias("path")).groupBy("site", "node")
        return n.agg(F.sum("n").alias(f"{name}_n"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name), F.first("path").alias(f"{name}_path"))

    tree = content.join(entropy("form", "hp"), ["site", "node"]).join(entropy("first", "hd").drop("hd_path"), ["site", "node"])
    most = F.log(F.greatest("hp_n", F.lit(2)))
    c, p, d = 1 - F.least(F.lit(1.0), F.col("h") / most), F.least(F.lit(1.0), F.col("hp") / most), F.least(F.lit(1.0), F.col("hd") / most)
    tree = tree.select("site", "node", F.col("hp_path").alias("path"), F.col("hp_n").alias("pages"), "chars", c.alias("content"), d.alias("lead"), p.alias("presentation"), (1 - (1 - (c + d) / 2) * (1 - p)).alias("own"))
    tree = materialize(tree)
    # branches: all nodes below a node and itself
    below = tree.select("site", F.explode(F.concat(F.array("node"), "path")).alias("branch"), "chars", "own", "pages")
    branches = below.groupBy("site", "branch").agg((F.sum(F.col("chars") * F.col("own")) / F.greatest(F.sum("chars"), F.lit(1))).alias("composite"), F.sum("pages").alias("below"))
    # the nearest branch around a node that holds more than the node
    around = tree.select("site", "node", "pages", F.posexplode("path").alias("up", "branch")).join(branches, ["site", "branch"]).filter(F.col("below") > F.col("pages"))
    around = around.groupBy("site", "node").agg(F.min_by("composite", "up").alias("around"))
    own = F.col("own")
    importance = (F.col("pages") * own + PRIOR * F.coalesce("around", own)) / (F.col("pages") + PRIOR)
    return tree.join(around, ["site", "node"], "left").select("site", "node", F.col("path")[0].alias("parent"), "pages", "content", "lead", "presentation", "own", importance.alias("importance"))


def _looked_up(asked: DataFrame, known: DataFrame, by: str, value: str) -> DataFrame:
    """(row, known: map of by to value) for (row, site, by) against (site, by, value), by a salted join."""
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    salted = known.select("site", by, value, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    hit = asked.withColumn("salt", salt).join(salted, ["site", by, "salt"])
    return hit.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct(by, value))).alias("known"))


def with_verdicts(parse: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, noise): noise has a boolean for each line of the page that the tree, or its text's other places, decide, else null; written once."""
    tree = materialize(style_tree(parse).select("site", "node", (F.col("importance") < least).alias("noise")))
    nodes = _looked_up(parse.select("row", "site", F.explode("forms.node").alias("node")), tree, "node", "noise")
    lines = parse.select("row", "site", "node", "key").join(nodes, "row", "left")
    lines = materialize(lines.withColumn("noise", F.transform("node", lambda n: F.when(n > 0, F.try_element_at("known", n)))).drop("known"))
    said = lines.select("site", F.explode(F.arrays_zip("key", "noise")).alias("x")).select("site", "x.*").filter("noise is not null")
    votes = said.groupBy("site", "key").agg(F.avg(F.col("noise").cast("double")).alias("share"), F.count("*").alias("k")).filter(F.col("k") >= MIN_PAGES).select("site", "key", (F.col("share") > 0.5).alias("vote"))
    unknown = lines.select("row", "site", F.explode(F.arrays_zip("key", "node")).alias("x")).filter("x.node < 0").select("row", "site", "x.key").distinct()
    voted = lines.join(_looked_up(unknown, votes, "key", "vote"), "row", "left")
    noise = F.zip_with("noise", F.arrays_zip("key", "node"), lambda v, x: F.coalesce(v, F.when(x["node"] != 0, F.try_element_at("known", x["key"]))))
    unsure = F.exists(F.arrays_zip("node", "noise"), lambda x: (x["node"] != 0) & x["noise"].isNull())
    return materialize(voted.withColumn("noise", noise).select("row", "noise", unsure.alias("unsure")))


# ---- lines that the tree doesn't know


def line_features(lines: list[str], title: str | None) -> list[list[int]]:
    """Indices of the features of each non-blank line of a page: words, shape, neighbours and place."""
    full = [x.strip() for x in lines if x.strip()]
    heads = bare(title or "")
    seen, out = False, []
    long = [len(x) >= 70 or x[-1] in ".!?।:" and len(x) >= 40 for x in full]
    places = np.flatnonzero(long)
    begin, end = (places[0], places[-1]) if len(places) else (len(full), -1)
    for i, x in enumerate(full):
        words = ["0" if w.isdigit() else w for w in _FEATURE.findall(x.lower())]
        seen = seen or bool(heads) and bare(x) == heads
        near = f"{int(i > 0 and long[i - 1])}{int(long[i])}{int(i + 1 < len(full) and long[i + 1])}"
        f = {f"w:{w}" for w in words} | {f"b:{a} {b}" for a, b in zip(words, words[1:])}
        f |= {f"first:{' '.join(words[:2])}", f"last:{' '.join(words[-2:])}", f"size:{len(x) // 12 if len(x) < 120 else 10}", f"near:{near}", f"after:{int(i <= end)}{int(i > begin)}{int(seen)}", f"top:{min(i, 9)}", f"end:{min(len(full) - 1 - i, 9)}", f"cut:{x[-1] in '.!?।'}{x[:1].isupper()}", f"mark:{_PLAIN.sub('', x)[:3]}", f"all:{'|'.join(words)}"}
        out.append([xxhash.xxh32_intdigest(t) % WEIGHTS for t in f])
    return out


_FEATURE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_PLAIN = re.compile(r"[\w\s]+")


def _scale(n: int) -> float:
    """What a feature of a line with n features counts, so that long lines weigh no more than short ones."""
    return (20 / max(20, n)) ** 0.5


def fit(rows: list[list[int]], labels: np.ndarray, weights: int = WEIGHTS, l2: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression with L2 penalty over sets of feature indices (the last weight is the bias), by AdaGrad on the whole sample."""
    w, g2 = np.zeros(weights + 1), np.full(weights + 1, 1e-6)
    if not len(rows) or not 0 < labels.mean() < 1:
        w[-1] = 20 * (labels.mean() - 0.5) if len(rows) else -20
        return w
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = np.array([_scale(len(r)) for r in rows])
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(rounds):
        z = np.bincount(of, w[flat], len(rows)) * scale + w[-1]
        d = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        g = np.bincount(flat, (d * scale)[of], weights + 1)
        g[-1] = d.sum()
        g += l2 * w / weights
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def _resolve(w: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            noise = []
            for text, title, known in zip(*(batch.column(c).to_pylist() for c in ("text", "title", "noise"))):
                lines = text.split("\n")
                scores = iter(w[np.asarray(f)].sum() * _scale(len(f)) + w[-1] for f in line_features(lines, title))
                noise.append([None if not x.strip() else v if v is not None else bool(s > 0) for x, v, s in ((x, v, next(scores) if x.strip() else 0) for x, v in zip(lines, known))])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(noise, pa.list_(pa.bool_()))], names=["row", "noise"])

    return task


def main_bodies(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, page_id, site, title, status_code, text, noise) of each page, written once; row numbers the pages, noise has for each line true, false, or null if blank."""
    parse = parsed(pages)
    verdicts = with_verdicts(parse, least)
    # a range of the row's hash holds the sample, so that tasks needn't send SAMPLE_PAGES texts each
    part, sure = F.pmod(F.xxhash64("row"), F.lit(1 << 30)), verdicts.filter("not unsure and size(noise) > 1")
    chosen = sure.filter(part < min(1.0, 1.3 * SAMPLE_PAGES / max(1, sure.count())) * (1 << 30)).orderBy(part, "row").limit(SAMPLE_PAGES)
    texts = parse.select("row", "title", "text")
    rows: list[list[int]] = []
    labels: list[bool] = []
    for r in chosen.join(texts, "row").select("title", "text", "noise").toLocalIterator():
        lines = r["text"].split("\n")
        rows += line_features(lines, r["title"])
        labels += [bool(v) for x, v in zip(lines, r["noise"]) if x.strip()]
    w = fit(rows, np.asarray(labels, float))
    rest = verdicts.filter("unsure").select("row", "noise").join(texts, "row").mapInArrow(_resolve(w), "row long, noise array<boolean>")
    noise = verdicts.filter("not unsure").select("row", "noise").unionByName(rest)
    return materialize(parse.select("row", "page_id", "site", "title", "status_code", "text").join(noise, "row"))


def noise_lines(bodies: DataFrame) -> DataFrame:
    """(page_id, line_no) of the lines that are not part of the main body."""
    return bodies.select("page_id", F.posexplode("noise").alias("at", "noise")).filter("noise").select("page_id", (F.col("at") + 1).cast("int").alias("line_no"))


def body_text(bodies: DataFrame) -> DataFrame:
    """(page_id, main_text): the lines that stay."""
    kept = F.filter(F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.col("noise")), lambda x: ~F.coalesce(x["noise"], F.lit(False)))
    return bodies.select("page_id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("main_text"))
