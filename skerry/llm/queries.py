"""Queries of the operators in this subpackage, each over its whole tables with the operators' defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, encoding, main_body, mixing, pairs, repeated_lines, residue, scans, splitting, text_types

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(main_body.main_bodies(_table(spark, sf_dir, "pages")))


def p1_kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = residue.residue_pages(main_body.main_bodies(pages))
    return pages.join(found, pages.id == found.page_id, "left_anti").select(F.col("id").alias("page_id"))


def p1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = residue.validate(main_body.main_bodies(_table(spark, sf_dir, "pages")))
    return spark.createDataFrame([(int(report["sites"]), int(report["segments"]), float(report["precision"]), float(report["recall"]))], "sites long, segments long, precision double, recall double")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(_table(spark, sf_dir, "pages"))


def p2_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return repeated_lines.without_lines(pages, repeated_lines.repeated_lines(pages))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "site_documents").select(F.lit("document").alias("item_kind"), F.col("id").cast("string").alias("item_key"), F.col("extracted_text").alias("text"))
    chunks = _table(spark, sf_dir, "text_chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text")
    return splitting.split_items(files.unionByName(chunks), _table(spark, sf_dir, "split_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_pieces(spark, sf_dir))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    bodies = main_body.main_bodies(pages)
    measure = text_types.measured(bodies, residue.judged(residue.train(bodies)))
    return text_types.findings(pages, text_types.page_types(measure), measure.filter("residue").select("page_id"))


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types.page_types(text_types.measured(main_body.main_bodies(_table(spark, sf_dir, "pages"))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(_table(spark, sf_dir, "site_documents"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(_table(spark, sf_dir, "site_documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = main_body.main_bodies(_table(spark, sf_dir, "pages"))
    return main_body.noise_lines(bodies).join(residue.residue_pages(bodies), "page_id", "left_anti")


def p6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = main_body.main_bodies(_table(spark, sf_dir, "pages"))
    return main_body.body_text(bodies).join(residue.residue_pages(bodies), "page_id", "left_anti")


def p6_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body.style_tree(main_body.parsed(_table(spark, sf_dir, "pages")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.main_defects(pairs.defects(_table(spark, sf_dir, "faqs")))


def p7_all_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(_table(spark, sf_dir, "faqs")).select("faq_id", F.explode("defects").alias("defect"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.token_sizes(_table(spark, sf_dir, "documents"))
    return mixing.mix(sizes, mixing.plan(sizes, _table(spark, sf_dir, "mix_targets")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.token_sizes(_table(spark, sf_dir, "documents"))
    planned = mixing.plan(sizes, _table(spark, sf_dir, "mix_targets"))
    return mixing.shares(mixing.mix(sizes, planned), planned)


def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.temperature_report(mixing.token_sizes(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(_table(spark, sf_dir, "documents"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restore(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows, where SQL can express the operator and is fast on whole tables."""
    lines = """
        WITH lines AS (
            SELECT id AS page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]+)', 1) AS site,
                   unnest(string_split(content_text, chr(10))) AS line,
                   unnest(range(1, len(string_split(content_text, chr(10))) + 1)) AS line_no
            FROM pages WHERE content_text IS NOT NULL),
        keys AS (
            SELECT page_id, site, line, line_no, replace(replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), ' ', ''), chr(9), '') AS key FROM lines),
        sites AS (
            SELECT regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]+)', 1) AS site, count(*) AS n FROM pages GROUP BY 1),
        repeated AS (
            SELECT site, key FROM keys JOIN sites USING (site) WHERE key <> '' GROUP BY site, key, n
            HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) * 10 >= n),
        found AS (SELECT page_id, CAST(line_no AS INTEGER) AS line_no, line FROM keys JOIN repeated USING (site, key))"""
    over = """
        SELECT i.item_kind, item_key FROM (
            SELECT 'document' AS item_kind, CAST(id AS VARCHAR) AS item_key, extracted_text AS text FROM site_documents
            UNION ALL SELECT 'chunk', chunk_id, text FROM text_chunks) i
        JOIN split_limits l ON l.item_kind = i.item_kind
        WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > max_chars"""
    return {
        "p2_found": lines + " SELECT page_id, line_no FROM found",
        "p2_clean_pages": lines
        + """
        , kept AS (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS clean_text FROM lines ANTI JOIN found USING (page_id, line_no) GROUP BY page_id)
        SELECT id AS page_id, CASE WHEN content_text IS NOT NULL THEN coalesce(clean_text, '') END AS clean_text FROM pages LEFT JOIN kept ON page_id = id""",
        "p3_found": over,
        "p8_found": """
            WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
            dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
            ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
