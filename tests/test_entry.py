import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("pages", "site_documents", "faqs", "text_chunks", "crawl_queue", "mission_hierarchy", "documents", "events", "embeddings", "eval_items", "split_limits")
NAMES = ("clean_text", "chunk_clean", "page_classify", "queue_update", "hierarchy_sections", "mission_nodes", "edge_merge", "chunk_split", "vector_search", "retrieve", "context_blocks", "discovered_urls")


def test_entry(spark):
    assert entry.entry(spark).columns == ["question", "context"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


FIXTURES = tuple(n for n in entry.oracle_sql() if n.startswith("fixture_"))
MORE = ("mission_context", "product_nodes", "section_from_url", "query_classify", "frontier_capped", "page_lookup", "vector_index_saved", "vector_recall", "document_missions", "history_tail", "stream_first_seen", "page_links", "graph_build")


@pytest.mark.parametrize("name", NAMES + MORE + FIXTURES)
def test_same_rows_as_sql(spark, duck, name):
    a = entry.queries()[name](spark, SF)
    b = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in b.description]
    assert sorted(names) == sorted(a.columns)
    key = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert key([[r[n] for n in names] for r in a.collect()]) == key(b.fetchall())
