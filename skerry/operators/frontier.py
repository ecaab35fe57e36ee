"""The crawl queue: what comes next, what is new, and a breadth-first drain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as ht
from ..functions import urls
from ..session import ready_to_checkpoint
from . import dedup


def next_pending(queue: DataFrame, n: int) -> DataFrame:
    """The n pending rows of least depth, then id (a top-k without a full sort)."""
    return queue.filter("status = 'pending'").orderBy("depth", "id").limit(n)


def within_cap(queue: DataFrame, n: int, most: int = 500) -> DataFrame:
    """next_pending while a crawl of at most so many pages lasts: those already visited count."""
    visited = queue.filter("lower(status) = 'visited'").count()
    return next_pending(queue, max(0, min(n, most - visited)))


def with_action(queue: DataFrame, most: int = 4) -> DataFrame:
    return queue.withColumn("action", urls.crawl_action(F.col("url"), F.col("depth"), most))


def updated(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """queue with status and error of the changes (url, new_status, error); errors are cut to 500 characters, one change a url."""
    one = changes.groupBy("url").agg(F.max_by(F.struct("new_status", "error"), F.coalesce("new_status", F.lit(""))).alias("c"))
    joined = queue.join(one, "url", "left")
    return joined.withColumns({"status": F.coalesce("c.new_status", "status"), "error_msg": F.coalesce(F.substring("c.error", 1, 500), "error_msg")}).drop("c")


def links(pages: DataFrame, html: str = "content_html", url: str = "url") -> DataFrame:
    """(url, href, target): the distinct links of each page, resolved against it, in normal form; links to nowhere and places in the page aside."""
    rows = pages.select(url, F.explode(ht.anchors_of(F.col(html), F.col(url))).alias("a")).filter("not startswith(a.href, '#')")
    return rows.select(url, F.col("a.href").alias("href"), urls.normalised(F.col("a.full")).alias("target")).filter("target is not null").dropDuplicates([url, "target"])


def discovered(pages: DataFrame, queue: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """(url, parent_url, depth): allowed links of the pages that the queue doesn't have yet, each once, one level deeper than its shallowest page."""
    deep = pages.select(F.col("url").alias("parent_url"), F.coalesce("depth", F.lit(0)).alias("d"))
    found = links(pages).select(F.col("url").alias("parent_url"), F.col("target").alias("url")).filter(urls.is_allowed(F.col("url"), domains))
    new = dedup.unseen(found, queue, ["url"]).join(deep.groupBy("parent_url").agg(F.min("d").alias("d")), "parent_url")
    return new.groupBy("url").agg(F.min(F.struct("d", "parent_url")).alias("f")).select("url", "f.parent_url", (F.col("f.d") + 1).alias("depth"))


def breadth_first(edges: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """(node, depth) of all nodes reached from the seeds in at most so many steps, with the least depth.

    edges: src, dst. seeds: node. One join and one anti-join a level; the visited set is
    written to the checkpoint folder at each level, which cuts the lineage.
    """
    ready_to_checkpoint(edges.sparkSession)
    edges = edges.select("src", "dst").distinct()
    visited = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    for level in range(most):
        edge = visited.filter(F.col("depth") == level).select(F.col("node").alias("src"))
        new = edges.join(edge, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        new = new.withColumn("depth", F.lit(level + 1)).checkpoint()
        if new.isEmpty():
            break
        visited = visited.unionByName(new)
    return visited
