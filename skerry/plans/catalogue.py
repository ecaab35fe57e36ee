"""The queries of the general operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as ht
from ..functions import rules as rl
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import chat as ch
from ..operators import chunking as ck
from ..operators import conversation as cv
from ..operators import dedup as dd
from ..operators import entities as en
from ..operators import frontier as fr
from ..operators import graph as gr
from ..operators import ingest as ig
from ..operators import reports as rp
from ..operators import retrieval as rt
from ..operators import vector_index as vx
from ..session import checkpoint_root
from ..sources.readers import by_url, table
from ..streaming import crawl as st
from . import fixtures
from . import portal as vp
from .oracle import oracle_sql
from .portal import MISSIONS, SLUGS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Parameters of the queries: the portal's hosts, and texts to search for; its words are in ``portal``.
DOMAINS = ("samverta.example", "velkara.example", "norvane-met.example")
SEARCHED = ("significant wave height near the Uskar Desert", "calibration coefficients for the Coral Scanner", "orbit files in NetCDF")
ROBOTS = (("portal.samverta.example", "*", False, "/internal"), ("portal.samverta.example", "*", True, "/internal/catalog"), ("archive.velkara.example", "*", False, "/node"), ("learn.quenmar.example", "other", False, "/"), ("blog.kaspen-sea.example", "*", False, ""))
PAGE_TYPES = ("mission", "mission_section", "product", "document", "open_data", "general")
GARBAGE = ("/internal/", "/ajax/", "?language=", "/print/", "/user/", "/search")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return QUERIES | fixtures.QUERIES


# ---- text


@query
def clean_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "site_documents").select("id", tx.clean_text(F.col("extracted_text")).alias("clean"))


@query
def word_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("id", tx.word_count(F.col("content_text")).alias("words"))


@query
def language_detect(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", tx.detect_language(F.col("text")).alias("language"))


@query
def content_hashes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("id", tx.content_hash(F.col("content_text")).alias("content_sha"), tx.url_hash(F.col("url")).alias("url_md5"))


@query
def safe_filenames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("id", tx.safe_filename(F.col("url")).alias("filename"))


@query
def noise_strip(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "text_chunks").select("chunk_id", tx.strip_residue(F.col("text")).alias("stripped"))


@query
def chunk_clean(s: SparkSession, d: str) -> DataFrame:
    return ck.cleaned(table(s, d, "text_chunks")).select("chunk_id", "text", F.col("char_count").cast("bigint").alias("char_count"))


@query
def chunk_clean_stats(s: SparkSession, d: str) -> DataFrame:
    return rp.chunk_stats(ck.cleaned(table(s, d, "text_chunks")))


@query
def labels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "mission_hierarchy")
    return rows.select("id", tx.slug_label(ur.last_segment(F.col("section_url"))).alias("slug_label"), tx.identifier(F.col("mission_name")).alias("identifier"), tx.capitalized(F.col("section_type")).alias("capitalized"))


@query
def document_labels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "site_documents")
    kind = rl.first_match(F.lower("filename"), en.DOC_TYPES, "Document")
    return rows.select("id", kind.alias("doc_type"), tx.stem_label(F.col("filename"), kind).alias("label"), F.round("file_size_kb", 2).alias("size_kb"))


@query
def facts_in_text(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return table(s, d, "documents").select("doc_id", tx.number_after(low, en.ALTITUDE).alias("altitude_km"), tx.number_after(low, en.LAUNCH_YEAR).alias("launch_year"), F.trim(tx.number_after(low, en.SPATIAL)).alias("resolution"))


@query
def json_props(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("k_count"), F.max(k).alias("k_max"))


# ---- urls


@query
def url_normalise(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crawl_queue").select("id", ur.normalised(F.col("url")).alias("normal"))


@query
def url_filter(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(s, d, "crawl_queue").select("id", ur.is_allowed(u, DOMAINS).alias("allowed"), ur.is_document(u).alias("document"), ur.is_excluded(u).alias("excluded"))


@query
def url_parts(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(s, d, "crawl_queue").select("id", ur.host(u).alias("host"), ur.path(u).alias("path"), ur.last_segment(u).alias("last"))


@query
def file_types(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "site_documents").select("id", ur.file_type(F.col("url"), F.col("file_type")).alias("kind"))


@query
def page_links(s: SparkSession, d: str) -> DataFrame:
    return fr.links(table(s, d, "pages")).select("url", "target")


@query
def page_title(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").filter("content_html is not null").select("id", ht.native_title(F.col("content_html")).alias("title"))


# ---- html


@query
def html_title(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").filter("content_html is not null").select("id", ht.title_of(F.col("content_html")).alias("title"))


@query
def html_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").filter("content_html is not null").select("id", ht.text_of(F.col("content_html")).alias("text"))


@query
def html_tables(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select("url", F.explode(ht.tables_of(F.col("content_html"))).alias("t"))
    return rows.select("url", "t.table_index", F.size("t.rows").cast("bigint").alias("row_count"), F.size("t.headers").cast("bigint").alias("col_count"), F.array_join("t.headers", " | ").alias("headers"))


@query
def html_meta(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("id", F.explode(ht.meta_of(F.col("content_html"))).alias("m")).select("id", "m.kind", "m.key", "m.value")


# ---- ingestion


def _fetched(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("id", "url", F.col("content_html").alias("html"), "status_code", "depth")


@query
def ingest_pages(s: SparkSession, d: str) -> DataFrame:
    return ig.page_rows(_fetched(s, d), vp.PAGES)


@query
def ingest_new_pages(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").filter("status_code = 200").withColumn("content_hash", tx.content_hash(F.col("content_text")))
    known = table(s, d, "pages").filter("status_code <> 200").select(tx.content_hash(F.col("content_text")).alias("content_hash"))
    return ig.new_content(rows, known, "id").select("id", "content_hash")


@query
def ingest_links(s: SparkSession, d: str) -> DataFrame:
    return ig.sitemap_links(_fetched(s, d), DOMAINS).select("source_url", "url", "is_document")


@query
def robots_permitted(s: SparkSession, d: str) -> DataFrame:
    robots = s.createDataFrame(ROBOTS, "host string, agent string, allow boolean, path string")
    return ig.permitted(table(s, d, "crawl_queue"), robots).select("id")


# ---- rules


@query
def page_classify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("id", en.page_kind(F.col("url"), F.col("title"), F.col("content_text"), vp.PAGES).alias("kind"))


@query
def mission_context(s: SparkSession, d: str) -> DataFrame:
    return en.mission_context(table(s, d, "pages"), vp.PAGES).select("id", "mission_slug", "mission_section", "node_kind")


@query
def section_from_url(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mission_hierarchy").select("id", en.section_from_url(F.col("section_url"), vp.PAGES.sections).alias("section"))


@query
def section_classify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mission_hierarchy").select("id", en.section_kind(F.col("section_url"), F.col("section_title"), vp.SECTIONS).alias("kind"))


@query
def query_classify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "faqs").select("id", rt.question_kind(F.col("question"), vp.QUESTIONS).alias("kind"), rl.first_match(F.lower("question"), en.TOPICS, "General").alias("topic"))


@query
def document_missions(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "site_documents").withColumn("said", F.lower(F.concat_ws(" ", "filename", "url")))
    rules = s.createDataFrame([(i * 10 + j, w, m) for i, (m, words) in enumerate(MISSIONS) for j, w in enumerate(words)], "seq int, keyword string, label string")
    return rl.matched_by_table(rows, "said", rules, "id").select("id", "label")


@query
def application_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.array_join(rl.all_matches(F.lower("text"), en.APPLICATIONS), "; ").alias("applications"), rl.first_match(F.substring(F.lower("text"), 1, 500), en.CATEGORIES, "Unknown").alias("category"))


@query
def page_filter(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("url")
    rows = table(s, d, "pages").filter(F.col("page_type").isin(*PAGE_TYPES) & (F.col("word_count") >= 10) & (F.col("language") == "en") & ~ur.contains_any(low, GARBAGE))
    return rows.select("id", "page_type", "url")


@query
def document_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "site_documents").filter(F.col("extraction_ok") & (F.length(tx.text_or_empty(F.col("extracted_text"))) >= 200)).select("id", "filename", F.length("extracted_text").cast("bigint").alias("chars"))


# ---- queue


@query
def frontier_next(s: SparkSession, d: str) -> DataFrame:
    return fr.next_pending(table(s, d, "crawl_queue"), 25).select("id", "url", "depth")


@query
def frontier_capped(s: SparkSession, d: str) -> DataFrame:
    return fr.within_cap(table(s, d, "crawl_queue"), 25, 100_000).select("id", "url", "depth")


@query
def page_lookup(s: SparkSession, d: str) -> DataFrame:
    return by_url(table(s, d, "pages"), "https://portal.samverta.example/orvex-2-introduction").select("id", "url", "depth")


@query
def hierarchy_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mission_hierarchy").filter(F.col("mission_slug") == SLUGS[0]).select("id", "section_url")


@query
def queue_stats(s: SparkSession, d: str) -> DataFrame:
    return rp.counts_by(table(s, d, "crawl_queue").withColumn("status", F.lower("status")), "status")


@query
def crawl_actions(s: SparkSession, d: str) -> DataFrame:
    return fr.with_action(table(s, d, "crawl_queue")).select("id", "action")


@query
def queue_update(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "crawl_queue")
    seen = table(s, d, "pages").select("url", F.when(F.col("status_code") == 200, "visited").otherwise("failed").alias("new_status"), F.concat(F.lit("status "), F.col("status_code").cast("string")).alias("error"))
    return fr.updated(q, seen).select("id", "status", "error_msg")


@query
def url_first_seen(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "crawl_queue").withColumn("normal", ur.normalised(F.col("url"))).filter("normal is not null")
    return dd.first_write(rows, ["normal"], "id").select("normal", "id", "depth")


@query
def stream_first_seen(s: SparkSession, d: str) -> DataFrame:
    stream = st.queue_stream(s, f"{d}/crawl_queue.parque*", table(s, d, "crawl_queue").schema)
    return st.drained(st.first_seen(stream, "3650 days").select("target"), f"{checkpoint_root(s)}/skerry-stream-{uuid.uuid4().hex}")


@query
def url_last_write(s: SparkSession, d: str) -> DataFrame:
    return dd.last_write(table(s, d, "pages"), ["url"], "id").select("url", "id", "content_hash")


@query
def discovered_urls(s: SparkSession, d: str) -> DataFrame:
    return fr.discovered(table(s, d, "pages"), table(s, d, "crawl_queue"), DOMAINS)


@query
def unseen_urls(s: SparkSession, d: str) -> DataFrame:
    return dd.unseen(table(s, d, "pages").select("url").distinct(), table(s, d, "crawl_queue"), ["url"])


@query
def url_union(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "mission_hierarchy").select(F.col("section_url").alias("url"))
    return a.union(table(s, d, "site_documents").select("url")).distinct()


@query
def crawl_levels(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "crawl_queue")
    edges = q.filter("parent_url is not null").select(F.col("parent_url").alias("src"), F.col("url").alias("dst"))
    return fr.breadth_first(edges, q.filter("depth = 0").select(F.col("url").alias("node")))


# ---- deduplication


@query
def content_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").withColumn("sha", tx.content_hash(F.col("text")))
    return dd.one_per_key(rows, ["sha"], [F.col("doc_id").asc()]).select("doc_id", "sha")


@query
def faq_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "faqs").filter((tx.text_or_empty(F.col("question")) != "") & (F.length("answer") > 10))
    return dd.one_per_key(rows.withColumn("key", F.lower(F.trim("question"))), ["key"], [F.col("id").asc()]).select("id", "key")


# ---- reports


@query
def hierarchy_stats(s: SparkSession, d: str) -> DataFrame:
    return rp.hierarchy_stats(table(s, d, "mission_hierarchy"))


@query
def hierarchy_sections(s: SparkSession, d: str) -> DataFrame:
    rows = rp.hierarchy_nested(table(s, d, "mission_hierarchy"))
    return rows.select("mission_slug", "mission_name", "landing_url", F.array_join(F.transform("sections", lambda x: F.coalesce(x["url"], F.lit(""))), "|").alias("section_urls"))


@query
def section_texts(s: SparkSession, d: str) -> DataFrame:
    return rp.section_texts(table(s, d, "mission_hierarchy"), table(s, d, "pages"))


@query
def summary(s: SparkSession, d: str) -> DataFrame:
    return rp.summary({n: table(s, d, n) for n in ("pages", "site_documents", "faqs", "mission_hierarchy")})


@query
def chunk_type_counts(s: SparkSession, d: str) -> DataFrame:
    return rp.counts_with_total(table(s, d, "text_chunks"), "node_type")


# ---- entities and graph


def _texts(s: SparkSession, d: str) -> DataFrame:
    return rp.section_texts(table(s, d, "mission_hierarchy"), table(s, d, "pages"))


def _missions(s: SparkSession, d: str) -> DataFrame:
    dimension = s.createDataFrame(vp.DIMENSION, "mission_slug string, orbit_type string, mission_family string, agency string")
    return en.mission_nodes(table(s, d, "mission_hierarchy"), _texts(s, d), dimension)


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = en.document_nodes(table(s, d, "site_documents"), MISSIONS)
    sections = en.section_nodes(table(s, d, "mission_hierarchy"), table(s, d, "pages"))
    nodes = dd.union_by_name([_missions(s, d), sections[0], en.faq_nodes(table(s, d, "faqs")), documents[0]])
    return nodes, dd.union_by_name([sections[1], documents[1]])


def _flat(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("attributes", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n"))


@query
def faq_nodes(s: SparkSession, d: str) -> DataFrame:
    return _flat(en.faq_nodes(table(s, d, "faqs")))


@query
def document_nodes(s: SparkSession, d: str) -> DataFrame:
    return _flat(en.document_nodes(table(s, d, "site_documents"), MISSIONS)[0])


@query
def document_edges(s: SparkSession, d: str) -> DataFrame:
    return _flat(en.document_nodes(table(s, d, "site_documents"), MISSIONS)[1])


@query
def section_nodes(s: SparkSession, d: str) -> DataFrame:
    return _flat(en.section_nodes(table(s, d, "mission_hierarchy"), table(s, d, "pages"))[0])


@query
def section_edges(s: SparkSession, d: str) -> DataFrame:
    return en.section_nodes(table(s, d, "mission_hierarchy"), table(s, d, "pages"))[1].select("source_id", "target_id", "relation_type")


@query
def mission_nodes(s: SparkSession, d: str) -> DataFrame:
    return _flat(_missions(s, d))


@query
def product_nodes(s: SparkSession, d: str) -> DataFrame:
    nodes = en.product_nodes(table(s, d, "pages").filter("page_type = 'open_data'"), vp.PRODUCTS)
    return nodes.select("node_id", "label", "source_url", *(F.try_element_at("attributes", F.lit(c)).alias(c) for c in ("category", "data_format", "coverage", "algorithm", "download_url")), "text")


@query
def payload_nodes(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select(F.col("url").alias("source_url"), F.explode(ht.tables_of(F.col("content_html"))).alias("t"))
    return _flat(en.payload_nodes(rows.select("source_url", "t.table_index", "t.headers", "t.rows"), MISSIONS)[0])


@query
def node_dedup(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "text_chunks").select("node_id", "chunk_id", "text", F.col("chunk_id").alias("seq"))
    return dd.longest_first(chunks, "node_id", "text", "seq").select("node_id", "chunk_id", "pos")


@query
def edges_valid(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(s, d)
    return gr.valid_edges(edges, nodes).select("source_id", "target_id", "relation_type")


@query
def edges_dropped(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "crawl_queue").filter("parent_url is not null").select(F.col("parent_url").alias("source_id"), F.col("url").alias("target_id"), "id")
    return gr.dropped_edges(q, table(s, d, "pages").select(F.col("url").alias("node_id"))).select("id", "source_id", "target_id")


@query
def edge_merge(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "crawl_queue").filter("parent_url is not null and id is not null")
    edges = q.select(ur.host(F.col("parent_url")).alias("source_id"), ur.host(F.col("url")).alias("target_id"), F.lower("status").alias("relation_type"), F.map_from_arrays(F.array(F.lit("depth"), F.concat(F.lit("has_"), F.lower("status"))), F.array(F.col("depth").cast("string"), F.col("id").cast("string"))).alias("attributes"), F.col("id").alias("seq"))
    return _flat(gr.merged(edges))


@query
def graph_build(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = gr.build(*_graph(s, d))
    a = nodes.groupBy("node_type").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), F.col("node_type").alias("kind"), "n")
    return a.unionByName(edges.groupBy("relation_type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), F.col("relation_type").alias("kind"), "n"))


@query
def neighbours(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(s, d)
    return gr.neighbours(edges, nodes, f"mission:{SLUGS[0]}")


@query
def node_lookup(s: SparkSession, d: str) -> DataFrame:
    nodes, _ = _graph(s, d)
    return gr.by_type(nodes, "Mission").select("node_id", "label").unionByName(gr.node(nodes, "faq:1").select("node_id", "label"))


@query
def node_statements(s: SparkSession, d: str) -> DataFrame:
    return gr.node_statements(en.faq_nodes(table(s, d, "faqs")))


@query
def edge_statements(s: SparkSession, d: str) -> DataFrame:
    return gr.edge_statements(en.document_nodes(table(s, d, "site_documents"), MISSIONS)[1])


@query
def constraint_statements(s: SparkSession, d: str) -> DataFrame:
    return gr.constraint_statements(table(s, d, "text_chunks"))


# ---- chunks


@query
def chunk_split(s: SparkSession, d: str) -> DataFrame:
    return ck.chunk_rows(table(s, d, "documents"), "doc_id", "text")


@query
def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "site_documents").filter(F.col("extraction_ok") & (F.length("extracted_text") >= 200)).withColumn("node_id", F.concat(F.lit("doc:"), F.col("url_hash")))
    return ck.chunk_rows(dd.last_write(rows, ["node_id"], "id"), "node_id", "extracted_text", mark="full")


@query
def chunk_faqs(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "faqs").withColumn("said", ck.faq_text(F.col("question"), F.col("answer"), F.col("question")))
    return ck.chunk_rows(rows.filter(F.length(F.trim("said")) >= 20), "id", "said")


# ---- vectors


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(s, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def _query_vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return vx.top_k(table(s, d, "embeddings"), _query_vector(s, d), 24).select("vec_id", "label", F.round("score", 6).alias("score"))


@query
def vector_search(s: SparkSession, d: str) -> DataFrame:
    return vx.search(table(s, d, "embeddings"), _query_vector(s, d), k=12, least=0.0).select("vec_id", "label", F.round("score", 6).alias("score"))


@query
def vector_search_filtered(s: SparkSession, d: str) -> DataFrame:
    return vx.search(table(s, d, "embeddings"), _query_vector(s, d), k=6, least=0.0, filters="label % 2 = 0").select("vec_id", "label", F.round("score", 6).alias("score"))


@query
def vector_topk_each(s: SparkSession, d: str) -> DataFrame:
    return vx.top_k_each(table(s, d, "embeddings"), _query_vectors(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query
def vector_cells(s: SparkSession, d: str) -> DataFrame:
    index = vx.build_cells(table(s, d, "embeddings"))
    return index.search(_query_vectors(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query
def vector_recall(s: SparkSession, d: str) -> DataFrame:
    rows, asked = table(s, d, "embeddings"), _query_vectors(s, d)
    found = vx.recall(vx.build_cells(rows).search(asked, 10), vx.top_k_each(rows, asked, 10))
    return found.select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query
def vector_index_saved(s: SparkSession, d: str) -> DataFrame:
    index, path = vx.build_cells(table(s, d, "embeddings"), 16), f"{checkpoint_root(s)}/skerry-index-{uuid.uuid4().hex}"
    index.save(path)
    # all cells, so that the rows are those of the exact search
    return vx.load_index(s, path).search(_query_vectors(s, d), 10, 16).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query
def vector_index_exact(s: SparkSession, d: str) -> DataFrame:
    return vx.build_index(table(s, d, "embeddings")).search(_query_vectors(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


# ---- retrieval


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "text_chunks").withColumn("seq", F.col("chunk_id"))


@query
def keyword_search(s: SparkSession, d: str) -> DataFrame:
    return rt.keyword_search(_chunks(s, d), SEARCHED[0], 25).select("chunk_id", F.col("hits").cast("bigint").alias("hits"))


@query
def keyword_search_each(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame(list(enumerate(SEARCHED)), "query_id long, text string")
    return rt.keyword_search_each(_chunks(s, d), asked).select("query_id", "chunk_id", "hits")


def _results(s: SparkSession, d: str) -> DataFrame:
    found = rt.keyword_search(_chunks(s, d), SEARCHED[1], 12)
    from pyspark.sql.window import Window

    return found.withColumns({"score": F.col("hits") / 10.0, "rank": F.row_number().over(Window.orderBy(F.desc("hits"), "seq"))}).drop("hits")


@query
def graph_enrich(s: SparkSession, d: str) -> DataFrame:
    return rt.enriched(_results(s, d), _chunks(s, d)).select("chunk_id", F.round("score", 6).alias("score"))


@query
def rerank(s: SparkSession, d: str) -> DataFrame:
    return rt.reranked(_results(s, d), "document").select("chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query
def budget_trim(s: SparkSession, d: str) -> DataFrame:
    return rt.within_budget(_chunks(s, d), by=["node_id"], order="chunk_id").select("chunk_id", "node_id")


@query
def retrieve(s: SparkSession, d: str) -> DataFrame:
    ranked = rt.reranked(rt.enriched(_results(s, d), _chunks(s, d)), "mission")
    return rt.within_budget(ranked).select("chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query
def answer_context(s: SparkSession, d: str) -> DataFrame:
    chunks = ch.embedded(ck.cleaned(table(s, d, "text_chunks")).withColumn("seq", F.col("chunk_id")))
    found = ch.retrieved(chunks, SEARCHED[0], vp.QUESTIONS, least=0.1)
    return found.select("chunk_id", F.col("rank").cast("bigint").alias("rank"), "kind")


# ---- conversation


def _history(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"), F.col("props").alias("content"))


@query
def history_tail(s: SparkSession, d: str) -> DataFrame:
    return cv.tail(_history(s, d)).select("conv_id", "turn", "role")


@query
def turn_counts(s: SparkSession, d: str) -> DataFrame:
    return cv.turn_counts(_history(s, d))


@query
def context_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = rt.within_budget(_chunks(s, d).withColumn("rank", F.col("chunk_index") + 1), by=["node_id"], order="chunk_id")
    return cv.context_blocks(rows, "node_id")


@query
def source_lists(s: SparkSession, d: str) -> DataFrame:
    return cv.source_lists(_chunks(s, d).withColumn("rank", F.col("chunk_id")), "node_id")


@query
def prompts(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "faqs").select(F.col("id").alias("conv_id"), "question").filter("question is not null")
    contexts = table(s, d, "faqs").select(F.col("id").alias("conv_id"), F.col("answer").alias("context"))
    rows = cv.messages(_history(s, d), asked, contexts)
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("n"), F.element_at("messages", -1)["content"].alias("last"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Documents cleaned, kept once, chunked, the valid chunks searched by keywords, cut to the budget and set as a context."""
    docs = table(s, d, "documents").withColumn("text", tx.clean_text(F.col("text")))
    once = dd.one_per_key(docs.withColumn("sha", tx.content_hash(F.col("text"))), ["sha"], [F.col("doc_id").asc()])
    chunks = ck.cleaned(ck.chunk_rows(once, "doc_id", "text")).withColumns({"label": F.lit(""), "node_type": F.lit("Document"), "source_url": F.lit(""), "seq": F.col("chunk_id")})
    chunks = chunks.withColumns({c: F.lit(None).cast("string") for c in ("orbit_type", "section_type", "category", "doc_type")})
    from pyspark.sql.window import Window

    found = rt.keyword_search(chunks, SEARCHED[0], 12).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "seq")))
    return cv.context_blocks(rt.within_budget(found).withColumn("question", F.lit(SEARCHED[0])), "question")


__all__ = ["flagship", "oracle_sql", "queries"]
