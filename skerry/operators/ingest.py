"""Fetched pages (url, html, status_code, depth) to the rows of the portal's tables.

Each page is parsed in one Arrow pass; everything else is native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as ht
from ..functions import rules as rl
from ..functions import text as tx
from ..functions import urls as ur
from . import dedup
from . import entities as en

#: Characters of HTML that are kept.
HTML_SIZE = 50_000
_PARTS = "struct<title:string,text:string,links_found:int>"


def _parts(pages: pd.Series) -> pd.DataFrame:
    out = []
    for p in pages:
        root = ht.parse(p or "")
        name, n = ht.title(root), sum("href" in a.attrs for a in root.all("a"))
        # last, as it takes the chrome out of the tree
        out.append((name, ht.tree_text(root), n))
    return pd.DataFrame(out, columns=["title", "text", "links_found"])


def page_rows(fetched: DataFrame, rules: en.PageRules = en.PageRules()) -> DataFrame:
    """Rows of the table pages for pages fetched with status 200."""
    rows = fetched.filter("status_code = 200 and html is not null").withColumn("p", F.pandas_udf(_parts, _PARTS)("html"))
    text = F.col("p.text")
    return rows.select(
        "url",
        tx.url_hash(F.col("url")).alias("url_hash"),
        F.col("p.title").alias("title"),
        text.alias("content_text"),
        F.substring("html", 1, HTML_SIZE).alias("content_html"),
        tx.content_hash(text).alias("content_hash"),
        en.page_kind(F.col("url"), F.col("p.title"), text, rules).alias("page_type"),
        "depth",
        F.col("p.links_found").alias("links_found"),
        "status_code",
        tx.detect_language(text).alias("language"),
        tx.word_count(text).cast("int").alias("word_count"),
    )


def new_content(pages: DataFrame, known: DataFrame, order: str = "url") -> DataFrame:
    """Pages whose text isn't known yet, the first of equal ones."""
    return dedup.unseen(dedup.one_per_key(pages, ["content_hash"], [F.col(order)]), known, ["content_hash"])


def faq_rows(fetched: DataFrame) -> DataFrame:
    """Question pairs of the pages: answers longer than 10 characters, the first of equal questions on a page."""
    rows = fetched.select("url", F.posexplode(ht.faqs_of(F.col("html"))).alias("n", "q")).select(F.col("url").alias("source_url"), "n", "q.question", "q.answer", F.col("q.method").alias("category"))
    rows = rows.filter("question <> '' and length(answer) > 10").withColumn("key", F.lower(F.trim("question")))
    return dedup.one_per_key(rows, ["source_url", "key"], [F.col("n")]).drop("n", "key")


def table_rows(fetched: DataFrame) -> DataFrame:
    t = fetched.select(F.col("url").alias("source_url"), F.explode(ht.tables_of(F.col("html"))).alias("t")).select("source_url", "t.*")
    return t.withColumns({"row_count": F.size("rows"), "col_count": F.size("headers")})


def meta_rows(fetched: DataFrame) -> DataFrame:
    return fetched.select(F.col("url").alias("source_url"), F.explode(ht.meta_of(F.col("html"))).alias("m")).select("source_url", F.col("m.kind").alias("meta_type"), "m.key", "m.value")


def _scoped_links(selector) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            block = selector(ht.parse(p or ""))
            out.append([{"title": a.text(), "href": a.attrs["href"]} for a in block.all("a") if a.attrs.get("href")] if block is not None else [])
        return pd.Series(out, dtype=object)

    return lambda c: F.pandas_udf(run, "array<struct<title:string,href:string>>")(c)


def _sitemap(root: ht.Element) -> ht.Element:
    return next((e for e in root.all("div") if e.attrs.get("id") == "site-map"), root)


def _announced(root: ht.Element) -> ht.Element | None:
    return next((e for e in root.all("div") if "view-announcement-view" in e.classes().split()), None)


def _resolved(rows: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    rows = rows.select(F.col("url").alias("source_url"), "x.title", "x.href").filter("not startswith(href, '#')")
    rows = rows.withColumn("url", ur.resolved_any(F.col("href"), F.col("source_url"))).filter(ur.is_allowed(F.col("url"), domains))
    return rows.select("source_url", "title", "url").dropDuplicates(["source_url", "url"])


def sitemap_links(fetched: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """(source_url, title, url, is_document) of the links in a site map's block, else of all links."""
    rows = fetched.select("url", F.explode(_scoped_links(_sitemap)(F.col("html"))).alias("x"))
    return _resolved(rows, domains).withColumn("is_document", ur.is_document(F.col("url")))


def announced_documents(fetched: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """(source_url, title, url) of the documents that the announcements link."""
    rows = fetched.select("url", F.explode(_scoped_links(_announced)(F.col("html"))).alias("x"))
    return _resolved(rows, domains).filter(ur.is_document(F.col("url")))


def section_links(fetched: DataFrame, domains: tuple[str, ...], sections: rl.Rules) -> DataFrame:
    """(source_url, title, url, section_type) of the links in the menu beside a landing page, else of its links that begin with its own slug."""
    rows = fetched.select("url", F.explode(ht.sidebar_by_slug(F.col("html"), ur.last_segment(F.col("url")))).alias("x"))
    return _resolved(rows, domains).withColumn("section_type", en.section_kind(F.col("url"), F.col("title"), sections))


def permitted(queue: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """queue without the URLs that a robots table (host, agent, allow, path) forbids; the longest path decides, hosts without rules allow all.

    Rules meet URLs by an equi-join on the host and are aggregated back to one row a URL.
    """
    rules = robots.filter(F.col("agent").isin("*", agent) & (F.col("path") != "")).select("host", "path", "allow")
    rows = queue.withColumns({"_host": ur.host(F.col("url")), "_path": F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)})
    hit = rows.select("url", "_host", "_path").distinct().join(rules, (F.col("_host") == F.col("host")) & F.startswith("_path", "path"))
    verdict = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("path"), "allow")).alias("allow"))
    return rows.join(verdict.filter("not allow"), "url", "left_anti").drop("_host", "_path")
