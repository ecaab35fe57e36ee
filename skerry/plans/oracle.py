"""DuckDB SQL with the same rows as the queries of the catalogue."""

from __future__ import annotations

from ..functions import rules as rl
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import entities as en
from ..operators import reports as rp
from ..operators import retrieval as rt

BLANK = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def clean(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '^\\x{{FEFF}}+', '')"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    return strip(f"regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def residue(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '\\?php.*?(\\n|\\bThe\\b|\\bThis\\b|$)', '\\1', 'gis')"
    x = f"regexp_replace({x}, 'jQuery\\(document\\)\\.ready[^;]*;?', '', 'gis')"
    return strip(f"regexp_replace({x}, '^[\\s?]+', '')")


def clean_chunk(x: str) -> str:
    x = residue(x)
    for p in tx.LITERALS:
        x = f"replace({x}, {lit(p)}, '')"
    return strip(f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")


def non_ascii(x: str) -> str:
    return f"length(regexp_replace({x}, '[\\x00-\\x7F]+', '', 'g'))"


def has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def rules(x: str, rows: rl.Rules, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {has(x, words)} THEN {lit(label)}" for label, words in rows)
    return f"CASE {whens} ELSE {lit(default) if default is not None else 'NULL'} END"


def normal(x: str) -> str:
    x = f"regexp_replace(regexp_replace(trim({x}), '#.*$', ''), '/+$', '')"
    return f"CASE WHEN regexp_matches({x}, '^(?i:https?)://[^/?#]+') THEN lower(regexp_extract({x}, '^([A-Za-z]+):', 1)) || regexp_replace({x}, '^[A-Za-z]+', '') END"


#: A run of letters, marks, digits and joiners of three characters or more.
WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]{3,}"
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"


def host(x: str) -> str:
    return f"regexp_extract({x}, '^{SCHEME}://([^/?#]*)', 1)"


def path(x: str) -> str:
    return f"regexp_extract({x}, '^(?:{SCHEME}://[^/?#]*)?([^?#]*)', 1)"


def last_segment(x: str) -> str:
    return f"regexp_extract(regexp_replace({path(x)}, '/+$', ''), '([^/]*)$', 1)"


def is_document(x: str) -> str:
    return "coalesce(" + " OR ".join(f"ends_with(lower({path(x)}), {lit(s)})" for s in ur.DOCUMENT_SUFFIXES) + ", false)"


def allowed(x: str, domains) -> str:
    return f"coalesce({x} <> '' AND (" + " OR ".join(f"ends_with({host(x)}, {lit(d)})" for d in domains) + f") AND NOT {has(f'lower({x})', ur.EXCLUDED)}, false)"


def number(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {lit(pattern)}, 1), '')"


def title_case(x: str) -> str:
    parts = f"regexp_extract_all(lower({x}), '\\p{{L}}+|\\P{{L}}+')"
    return f"array_to_string(list_transform({parts}, lambda p: upper(p[1]) || p[2:]), '')"


def flat(**values: str) -> str:
    parts = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN '{k}=' || CAST({v} AS VARCHAR) END" for k, v in sorted(values.items()))
    return f"concat_ws(chr(10), {parts})"


def first_line(x: str, n: int) -> str:
    return f"replace(replace(substr({x}, 1, {n}), chr(10) || chr(10), ' '), chr(10), ' ')"


def escaped(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '''', '\\''')"


def words_hit(x: str, query: str) -> str:
    import re

    found = list(dict.fromkeys(re.findall(r"\b\w{3,}\b", query.lower())))
    return " + ".join(f"CAST(contains({x}, {lit(w)}) AS INTEGER)" for w in found)


def split(source: str, key: str, text: str, size: int = 1500, overlap: int = 200, least: int = 20, mark: str = "") -> str:
    """Chunks of source's text by a recursive query."""
    half = size // 2

    def last(sep: str) -> str:
        rev = sep[::-1].replace("\n", "' || chr(10) || '")
        return f"CASE WHEN instr(reverse(w), '{rev}') > 0 THEN length(w) - instr(reverse(w), '{rev}') - {len(sep)} + 1 ELSE -1 END"

    cuts = f"WHEN {last(chr(10) * 2)} > {half} THEN {last(chr(10) * 2)} " + " ".join(f"WHEN {last(x)} > {half} THEN {last(x)} + 1" for x in (". ", "? ", "! ", "\n"))
    return f"""
        WITH RECURSIVE src AS (SELECT {key} AS k, {strip(f"coalesce({text}, '')")} AS t FROM {source}),
        step AS (
            SELECT k, t, 0 AS pos, 0 AS n, CAST('' AS VARCHAR) AS piece, length(t) = 0 AS done FROM src
            UNION ALL
            SELECT k, t, pos + size - {overlap}, n + 1, substr(w, 1, size), ends FROM (
                SELECT k, t, pos, n, w, ends, CASE WHEN ends THEN {size} {cuts} ELSE {size} END AS size FROM (
                    SELECT k, t, pos, n, substr(t, pos + 1, {size}) AS w, pos + {size} >= length(t) AS ends FROM step WHERE NOT done))),
        pieces AS (SELECT k, n, {strip("piece")} AS p FROM step WHERE n > 0 AND (length(t) <= {size} OR length({strip("piece")}) > {least})),
        numbered AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY k) AS total, p FROM pieces)
        SELECT k AS {key}, CAST(k AS VARCHAR) || '{":" + mark + ":" if mark else ":"}' || i AS chunk_id, CAST(i AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS total_chunks, p AS text, CAST(length(p) AS INTEGER) AS char_count FROM numbered"""


def oracle_sql() -> dict[str, str]:
    from . import fixtures
    from . import portal as vp
    from .catalogue import DOMAINS, GARBAGE, PAGE_TYPES, ROBOTS, SEARCHED
    from .portal import MISSIONS, SLUGS

    rank = "CASE coalesce(section_type, '') " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(rp.SECTION_ORDER)) + f" ELSE {len(rp.SECTION_ORDER) + 1} END"
    texts = f"""
        section_page AS (SELECT url, arg_max(substr(content_text, 1, 3000), id) FILTER (WHERE content_text IS NOT NULL) AS t0 FROM pages GROUP BY url),
        section_page2 AS (SELECT url, (SELECT substr(p2.content_text, 1, 3000) FROM pages p2 WHERE p2.url = p.url ORDER BY p2.id DESC LIMIT 1) AS t FROM (SELECT DISTINCT url FROM pages) p),
        texts AS (SELECT mission_slug, substr(string_agg('[' || upper(coalesce(section_type, 'section')) || ']' || chr(10) || trim(t), chr(10) || chr(10) ORDER BY h.id), 1, 3000) AS text
            FROM mission_hierarchy h JOIN section_page2 p ON h.section_url = p.url WHERE length(trim(t)) > 20 GROUP BY mission_slug)"""
    head = "substr(coalesce(content_text, ''), 1, 600)"
    everything = f"lower(concat_ws(' ', coalesce(url, ''), coalesce(title, ''), {head}))"
    said = f"lower(concat_ws(' ', coalesce(title, ''), {head}))"
    kinds = f"CASE WHEN {has(everything, vp.PAGES.faq)} THEN 'faq' "
    context = ""
    for slug, _ in vp.PAGES.slugs:
        tail = f"regexp_replace(list_extract(string_split(lower(url), '/{slug}'), -1), '^/*-*', '')"
        hit = f"contains(lower(url), '/{slug}')"
        kinds += f"WHEN {hit} AND {has(tail, vp.PAGES.sections)} THEN 'mission_section' WHEN {hit} THEN 'mission' "
        context += f"WHEN {hit} THEN CASE WHEN {tail} = '' THEN 'landing' ELSE {rules(tail, [(x, (x,)) for x in vp.PAGES.sections], 'other')} END "
    kinds += f"WHEN {has('lower(url)', vp.PAGES.open_data)} THEN 'open_data' " + " ".join(f"WHEN {has(said, words)} THEN '{k}'" for k, words in vp.PAGES.kinds) + " ELSE 'general' END"
    of_mission = rules("lower(url)", [(m, (f"/{x}",)) for x, m in vp.PAGES.slugs])
    body_class = "regexp_extract(content_html, '(?is)<body\\b[^>]*?\\bclass\\s*=\\s*[\"'']([^\"'']*)', 1)"
    dimension = "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in vp.DIMENSION) + ") dim(mission_slug, orbit_type, mission_family, agency)"
    body = "coalesce(extracted_text, '')"
    doc_type = rules("lower(filename)", en.DOC_TYPES, "Document")
    mission = rules("lower(concat_ws(' ', filename, url))", MISSIONS)
    stem = "trim(regexp_replace(regexp_replace(replace(regexp_replace({f}, '\\.[^.]*$', ''), '%20', ' '), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    stem_label = f"substr({stem.format(f='filename')} || ' (' || {doc_type} || ')', 1, 120)"
    boolean = "CASE WHEN extraction_ok THEN 'True' WHEN NOT extraction_ok THEN 'False' END"
    doc_nodes = f"""SELECT 'doc:' || url_hash AS node_id, 'Document' AS node_type, {stem_label.replace('filename', "coalesce(filename, '')", 1)} AS label, url AS source_url,
        {flat(doc_type=doc_type, filename='filename', page_count='page_count', mission_slug=mission, extraction_ok=boolean)} AS attributes,
        CASE WHEN length({body}) > 50 THEN {first_line(body, 1200)} ELSE concat_ws(' ', filename, {doc_type}) END AS text, id * 10 + 5 AS seq FROM site_documents WHERE extraction_ok"""
    doc_edges = f"""SELECT 'mission:' || {mission} AS source_id, 'doc:' || url_hash AS target_id, 'DOCUMENTED_BY' AS relation_type, {flat(doc_type=doc_type)} AS attributes, id * 10 + 5 AS seq
        FROM site_documents WHERE extraction_ok AND {mission} IS NOT NULL"""
    topic = rules("lower(question)", en.TOPICS, "General")
    category = f"coalesce(nullif(trim(category), ''), {topic})"
    shortened = "CASE WHEN length(question) > 80 THEN substr(question, 1, 80) || '…' ELSE question END"
    faq_nodes = f"""SELECT 'faq:' || id AS node_id, 'FAQ' AS node_type, {shortened} AS label, coalesce(source_url, '') AS source_url,
        {flat(question='question', answer='answer', category=category, topic=topic)} AS attributes, 'Q: ' || coalesce(question, '') || chr(10) || 'A: ' || coalesce(answer, '') AS text, id * 10 + 4 AS seq FROM faqs"""
    section = f"""section_rows AS (
        SELECT h.*, p.content_text, p.word_count, p.id AS page, 'section:' || trim({path('h.section_url')}, '/') AS node FROM mission_hierarchy h
        LEFT JOIN (SELECT url, content_text, word_count, id FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1) p ON h.section_url = p.url
        WHERE (section_type IS NULL OR section_type <> 'landing') AND (coalesce(word_count, 0) >= 5 OR trim(coalesce(content_text, '')) <> ''))"""
    kind = "coalesce(section_type, 'other')"
    section_nodes = f"""SELECT node AS node_id, 'MissionSection' AS node_type, mission_name || ' — ' || upper({kind}[1]) || lower({kind}[2:]) AS label, section_url AS source_url,
        {flat(mission_slug='mission_slug', mission_name='mission_name', section_type=kind, word_count='coalesce(word_count, 0)', crawled="CASE WHEN page IS NOT NULL THEN 'True' ELSE 'False' END")} AS attributes,
        trim(coalesce(content_text, '')) AS text, id * 10 + 1 AS seq FROM section_rows"""
    section_edges = "SELECT 'mission:' || mission_slug AS source_id, node AS target_id, 'HAS_SECTION' AS relation_type FROM section_rows UNION ALL SELECT node, 'mission:' || mission_slug, 'PART_OF' FROM section_rows"
    low = "lower(coalesce(t.text, ''))"
    apps = "concat_ws('; ', " + ", ".join(f"CASE WHEN {has('{x}', words)} THEN {lit(a)} END" for a, words in en.APPLICATIONS) + ")"
    mission_nodes = f"""SELECT 'mission:' || m.mission_slug AS node_id, 'Mission' AS node_type, m.name AS label, m.url AS source_url,
        {flat(slug='m.mission_slug', display_name='m.name', orbit_type="coalesce(dim.orbit_type, 'Unknown')", mission_family="coalesce(dim.mission_family, 'Unknown')", agency='dim.agency', launch_year=number(low, en.LAUNCH_YEAR), altitude_km=number(low, en.ALTITUDE), orbit_class=rules(low, en.ORBITS), status=rules(low, en.STATES), applications=f"nullif({apps.replace('{x}', low)}, '')")} AS attributes,
        coalesce(t.text, '') AS text, m.id * 10 AS seq
        FROM (SELECT mission_slug, min(mission_name) AS name, min(mission_url) AS url, min(id) AS id FROM mission_hierarchy GROUP BY 1) m LEFT JOIN texts t USING (mission_slug) LEFT JOIN {dimension} USING (mission_slug)"""
    all_edges = f"SELECT * FROM ({section_edges}) UNION ALL SELECT source_id, target_id, relation_type FROM ({doc_edges})"
    all_nodes = f"SELECT node_id, node_type, label FROM ({mission_nodes}) UNION ALL SELECT node_id, node_type, label FROM ({section_nodes}) UNION ALL SELECT node_id, node_type, label FROM ({faq_nodes}) UNION ALL SELECT node_id, node_type, label FROM ({doc_nodes})"
    chunk_said = "lower(concat_ws(' ', coalesce(text, ''), coalesce(label, '')))"
    results = f"""results AS (SELECT *, row_number() OVER (ORDER BY hits DESC, chunk_id) AS rank, hits / 10.0 AS score FROM (SELECT *, {words_hit(chunk_said, SEARCHED[1])} AS hits FROM text_chunks) WHERE hits > 0 ORDER BY hits DESC, chunk_id LIMIT 12),
        slugs AS (SELECT DISTINCT coalesce(nullif(mission_slug, ''), CASE WHEN node_type = 'Mission' THEN regexp_extract(node_id, '^mission:(.*)$', 1) END) AS slug FROM results WHERE rank <= 3),
        more AS (SELECT * FROM text_chunks WHERE node_type IN ('Payload', 'MissionSection') AND mission_slug IN (SELECT slug FROM slugs WHERE slug IS NOT NULL) AND chunk_id NOT IN (SELECT chunk_id FROM results) ORDER BY chunk_id LIMIT 6),
        enriched AS (SELECT chunk_id, node_type, text, rank, score FROM results UNION ALL SELECT chunk_id, node_type, text, 1000000 + row_number() OVER (ORDER BY chunk_id), 0.5 FROM more)"""

    def boost(k: str) -> str:
        return "CASE node_type " + " ".join(f"WHEN '{t}' THEN {b}" for t, b in rt.BOOSTS[k].items()) + " ELSE 0.0 END"

    budget = "SELECT *, sum(length(text)) OVER w AS used, row_number() OVER w AS n FROM {src} WHERE length(trim(coalesce(text, ''))) > 0 WINDOW w AS ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    extras = "concat_ws(', ', " + ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN '{n}: ' || {c} END" for c, n in (("orbit_type", "Orbit"), ("section_type", "Section"), ("category", "Category"), ("doc_type", "Doc type"))) + ")"
    entry = f"'[' || (chunk_index + 1) || '] ' || coalesce(node_type, 'Unknown') || ': ' || coalesce(label, '') || CASE WHEN coalesce(source_url, '') <> '' THEN ' | Source: ' || source_url ELSE '' END || CASE WHEN {extras} <> '' THEN ' | ' || {extras} ELSE '' END || chr(10) || trim(coalesce(text, ''))"
    dot = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
    first_vector = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
    scored = f"scored AS (SELECT vec_id, label, {dot} AS score FROM embeddings e, (SELECT {first_vector} AS embedding) q)"

    def group_search(over: int, k: int, where: str = "") -> str:
        return f"WITH {scored}, best AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT {over}), ok AS (SELECT * FROM best WHERE score >= 0 {where} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1) SELECT vec_id, label, round(score, 6) AS score FROM ok ORDER BY ok.score DESC, vec_id LIMIT {k}"

    queue_docs = f"regexp_extract_all(content_html, '(?i)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"', 1)"
    links = f"""hrefs AS (SELECT url, unnest({queue_docs}) AS href FROM pages),
        joined AS (SELECT url, CASE WHEN starts_with(href, '//') THEN regexp_extract(url, '^({SCHEME}:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^({SCHEME}://[^/?#]*)', 1) || href ELSE href END AS full_url FROM hrefs WHERE href <> '' AND NOT starts_with(href, '#')),
        links AS (SELECT DISTINCT url, {normal('full_url')} AS target FROM joined WHERE {normal('full_url')} IS NOT NULL)"""
    conversation = "(SELECT user_id AS conv_id, event_id AS turn, event_type AS role, props AS content FROM events)"
    return {
        "clean_text": f"SELECT id, {clean('extracted_text')} AS clean FROM site_documents",
        "word_counts": f"SELECT id, len(list_filter(regexp_split_to_array(coalesce(content_text, ''), '{BLANK}+'), lambda w: w <> '')) AS words FROM pages",
        "language_detect": f"SELECT doc_id, CASE WHEN (length(coalesce(text, '')) - {non_ascii(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) / greatest(length(coalesce(text, '')), 1) > 0.85 THEN 'en' ELSE 'other' END AS language FROM documents",
        "content_hashes": "SELECT id, sha256(coalesce(content_text, '')) AS content_sha, md5(url) AS url_md5 FROM pages",
        "safe_filenames": f"SELECT id, substr(regexp_replace(translate(regexp_replace(regexp_replace(url, '^{SCHEME}://', ''), '[?#].*$', ''), '/.', '__'), '[^\\w\\-]', '', 'g'), 1, 200) AS filename FROM pages",
        "noise_strip": f"SELECT chunk_id, {residue('text')} AS stripped FROM text_chunks",
        "chunk_clean": f"SELECT chunk_id, c AS text, length(c) AS char_count FROM (SELECT chunk_id, {clean_chunk('text')} AS c FROM text_chunks) WHERE length(c) >= 30 AND {non_ascii('c')} <= length(c) * 0.5",
        "chunk_clean_stats": f"SELECT count(*) AS chunks, CAST(coalesce(sum(length(c)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(length(c)), 0) // greatest(count(*), 1) AS BIGINT) AS mean_chars FROM (SELECT {clean_chunk('text')} AS c FROM text_chunks) WHERE length(c) >= 30 AND {non_ascii('c')} <= length(c) * 0.5",
        "labels": f"SELECT id, {title_case(f'''translate({last_segment('section_url')}, '-_', '  ')''')} AS slug_label, regexp_replace(regexp_replace(lower(mission_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS identifier, upper(section_type[1]) || lower(section_type[2:]) AS capitalized FROM mission_hierarchy",
        "document_labels": f"SELECT id, {doc_type} AS doc_type, {stem_label} AS label, round(file_size_kb, 2) AS size_kb FROM site_documents",
        "facts_in_text": f"SELECT doc_id, {number('lower(text)', en.ALTITUDE)} AS altitude_km, {number('lower(text)', en.LAUNCH_YEAR)} AS launch_year, trim({number('lower(text)', en.SPATIAL)}) AS resolution FROM documents",
        "json_props": "SELECT event_type, CAST(sum(k) AS BIGINT) AS k_sum, count(k) AS k_count, max(k) AS k_max FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
        "url_normalise": f"SELECT id, {normal('url')} AS normal FROM crawl_queue",
        "url_filter": f"SELECT id, {allowed('url', DOMAINS)} AS allowed, {is_document('url')} AS document, {has('lower(url)', ur.EXCLUDED)} AS excluded FROM crawl_queue",
        "url_parts": f"SELECT id, {host('url')} AS host, {path('url')} AS path, {last_segment('url')} AS last FROM crawl_queue",
        "file_types": "SELECT id, CASE " + " ".join(f"WHEN ends_with(lower({path('url')}), '{s}') THEN '{s[1:]}'" for s in ur.DOCUMENT_SUFFIXES) + " " + " ".join(f"WHEN contains(lower(file_type), '{a}') THEN '{b}'" for a, b in (("pdf", "pdf"), ("wordprocessingml", "docx"), ("msword", "doc"), ("spreadsheetml", "xlsx"), ("excel", "xls"), ("csv", "csv"))) + " ELSE 'unknown' END AS kind FROM site_documents",
        "page_links": f"WITH {links} SELECT url, target FROM links",
        "ingest_links": f"WITH {links} SELECT url AS source_url, target AS url, {is_document('target')} AS is_document FROM links WHERE {allowed('target', DOMAINS)}",
        "page_title": "SELECT id, CASE WHEN t <> '' THEN substr(split_part(t, ' | ', 1), 1, 300) ELSE 'Untitled' END AS title FROM (SELECT id, trim(regexp_replace(regexp_extract(content_html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS t FROM pages WHERE content_html IS NOT NULL)",
        "html_title": "SELECT id, CASE WHEN t <> '' THEN substr(split_part(t, ' | ', 1), 1, 300) ELSE 'Untitled' END AS title FROM (SELECT id, trim(regexp_replace(regexp_extract(content_html, '(?is)<title[^>]*>(.*?)</title>', 1), ' +', ' ', 'g')) AS t FROM pages WHERE content_html IS NOT NULL)",
        "ingest_new_pages": "SELECT id, h AS content_hash FROM (SELECT id, status_code, sha256(coalesce(content_text, '')) AS h FROM pages) WHERE status_code = 200 AND h NOT IN (SELECT sha256(coalesce(content_text, '')) FROM pages WHERE status_code <> 200) QUALIFY row_number() OVER (PARTITION BY h ORDER BY id) = 1",
        "robots_permitted": f"WITH r(host, agent, allow, path) AS (VALUES {', '.join(f'({lit(a)}, {lit(b)}, {c}, {lit(e)})' for a, b, c, e in ROBOTS)}), q AS (SELECT DISTINCT url, {host('url')} AS host, regexp_extract(url, '^{SCHEME}://[^/?#]*(.*)$', 1) AS p FROM crawl_queue), v AS (SELECT url, arg_max(allow, {{'n': length(path), 'a': allow}}) AS allow FROM q JOIN r ON q.host = r.host AND agent = '*' AND path <> '' AND starts_with(p, path) GROUP BY url) SELECT id FROM crawl_queue WHERE url IS NULL OR url NOT IN (SELECT url FROM v WHERE NOT allow)",
        "page_classify": f"SELECT id, {kinds} AS kind FROM pages",
        "section_classify": f"SELECT id, {rules('concat_ws(chr(32), lower(section_url), lower(section_title))', vp.SECTIONS, 'other')} AS kind FROM mission_hierarchy",
        "query_classify": f"SELECT id, {rules('lower(question)', vp.QUESTIONS, 'general')} AS kind, {topic} AS topic FROM faqs",
        "mission_context": f"SELECT id, {of_mission} AS mission_slug, CASE {context} END AS mission_section, CASE WHEN {of_mission} IS NOT NULL THEN nullif(regexp_extract({body_class}, '(?:^|\\s)(node-type-[\\w-]+)', 1), '') END AS node_kind FROM pages",
        "section_from_url": f"SELECT id, {rules('lower(section_url)', [(x, (x,)) for x in vp.PAGES.sections], 'section')} AS section FROM mission_hierarchy",
        "frontier_capped": "SELECT id, url, depth FROM crawl_queue WHERE status = 'pending' QUALIFY row_number() OVER (ORDER BY depth, id) <= least(25, 100000 - (SELECT count(*) FROM crawl_queue WHERE lower(status) = 'visited'))",
        "page_lookup": "SELECT id, url, depth FROM pages WHERE url = 'https://portal.samverta.example/orvex-2-introduction'",
        "hierarchy_of": f"SELECT id, section_url FROM mission_hierarchy WHERE mission_slug = '{SLUGS[0]}'",
        "document_missions": f"SELECT id, {mission} AS label FROM site_documents",
        "application_labels": f"SELECT doc_id, {'CASE WHEN text IS NULL THEN ' + lit('') + ' ELSE ' + apps.replace('{x}', 'lower(text)') + ' END'} AS applications, {rules('substr(lower(text), 1, 500)', en.CATEGORIES, 'Unknown')} AS category FROM documents",
        "page_filter": f"SELECT id, page_type, url FROM pages WHERE page_type IN ({', '.join(map(lit, PAGE_TYPES))}) AND word_count >= 10 AND language = 'en' AND NOT {has('lower(url)', GARBAGE)}",
        "document_filter": "SELECT id, filename, length(extracted_text) AS chars FROM site_documents WHERE extraction_ok AND length(coalesce(extracted_text, '')) >= 200",
        "frontier_next": "SELECT id, url, depth FROM crawl_queue WHERE status = 'pending' ORDER BY depth, id LIMIT 25",
        "queue_stats": "SELECT lower(status) AS status, count(*) AS n FROM crawl_queue GROUP BY 1",
        "crawl_actions": f"SELECT id, CASE WHEN contains(lower(url), '/internal/') THEN 'skip_login' WHEN {has('url', ('/quicktabs/ajax/', '/ajax/'))} THEN 'skip_ajax' WHEN depth > 4 THEN 'skip_depth' WHEN {is_document('url')} THEN 'document' ELSE 'page' END AS action FROM crawl_queue",
        "queue_update": "WITH c AS (SELECT url, CASE WHEN status_code = 200 THEN 'visited' ELSE 'failed' END AS s, 'status ' || status_code AS e FROM pages), one AS (SELECT url, arg_max({'s': s, 'e': e}, {'s': s, 'k': e IS NOT NULL, 'e': coalesce(e, '')}) AS x FROM c GROUP BY url) SELECT id, coalesce(one.x.s, status) AS status, coalesce(substr(one.x.e, 1, 500), error_msg) AS error_msg FROM crawl_queue LEFT JOIN one USING (url)",
        "url_first_seen": f"SELECT normal, id, depth FROM (SELECT *, {normal('url')} AS normal FROM crawl_queue) WHERE normal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY normal ORDER BY id) = 1",
        "stream_first_seen": f"SELECT DISTINCT {normal('url')} AS target FROM crawl_queue WHERE {normal('url')} IS NOT NULL",
        "url_last_write": "SELECT url, id, content_hash FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1",
        "discovered_urls": f"WITH {links}, found AS (SELECT DISTINCT l.url AS parent_url, target AS url FROM links l WHERE {allowed('target', DOMAINS)} AND target NOT IN (SELECT url FROM crawl_queue WHERE url IS NOT NULL)), deep AS (SELECT url AS parent_url, min(coalesce(depth, 0)) AS d FROM pages GROUP BY 1) SELECT url, arg_min(parent_url, {{'d': d, 'p': parent_url}}) AS parent_url, min(d) + 1 AS depth FROM found JOIN deep USING (parent_url) GROUP BY url",
        "unseen_urls": "SELECT DISTINCT url FROM pages ANTI JOIN crawl_queue USING (url)",
        "url_union": "SELECT section_url AS url FROM mission_hierarchy UNION SELECT url FROM site_documents",
        "crawl_levels": "WITH RECURSIVE e AS (SELECT DISTINCT parent_url AS src, url AS dst FROM crawl_queue WHERE parent_url IS NOT NULL), r AS (SELECT DISTINCT url AS node, 0 AS depth FROM crawl_queue WHERE depth = 0 UNION SELECT dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node",
        "content_dedup": "SELECT doc_id, sha FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents) QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1",
        "faq_dedup": "SELECT id, key FROM (SELECT id, lower(trim(question)) AS key FROM faqs WHERE coalesce(question, '') <> '' AND length(answer) > 10) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1",
        "hierarchy_stats": "SELECT mission_slug, min(mission_name) AS mission_name, count(*) AS total, CAST(count_if(crawl_status = 'done') AS BIGINT) AS done, CAST(count(*) - count_if(crawl_status = 'done') AS BIGINT) AS pending FROM mission_hierarchy GROUP BY 1",
        "hierarchy_sections": f"SELECT mission_slug, min(mission_name) AS mission_name, min(section_url) FILTER (WHERE section_type = 'landing') AS landing_url, coalesce(string_agg(coalesce(section_url, ''), '|' ORDER BY {rank}, id) FILTER (WHERE section_type IS NULL OR section_type <> 'landing'), '') AS section_urls FROM mission_hierarchy GROUP BY 1",
        "section_texts": f"WITH {texts} SELECT mission_slug, text FROM texts",
        "summary": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("pages", "site_documents", "faqs", "mission_hierarchy")),
        "chunk_type_counts": "SELECT coalesce(nullif(node_type, ''), 'Unknown') AS kind, count(*) AS n FROM text_chunks GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM text_chunks",
        "faq_nodes": faq_nodes,
        "document_nodes": doc_nodes,
        "document_edges": doc_edges,
        "section_nodes": f"WITH {section} {section_nodes}",
        "section_edges": f"WITH {section} {section_edges}",
        "mission_nodes": f"WITH {texts} {mission_nodes}",
        "product_nodes": f"""SELECT 'opendata:' || slug AS node_id, label, url AS source_url, category, data_format, coverage, algorithm, download_url, label || ' (' || category || '). ' || {first_line('content_text', 800)} AS text FROM (
            SELECT *, CASE slug {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in vp.PRODUCTS.labels)} ELSE {title_case("translate(slug, '-_', '  ')")} END AS label,
                coalesce({rules('lower(slug)', vp.PRODUCTS.categories)}, {rules('substr(lower(content_text), 1, 500)', en.CATEGORIES, 'Unknown')}) AS category,
                {rules('lower(content_text)', [(f.upper(), (f,)) for f in en.FORMATS])} AS data_format, {rules('lower(content_text)', [(x.title(), (x,)) for x in vp.PRODUCTS.coverages])} AS coverage,
                {rules('lower(content_text)', [(x.title(), (x,)) for x in vp.PRODUCTS.algorithms])} AS algorithm, nullif(regexp_extract(content_text, '({vp.PRODUCTS.downloads}\\S+)', 1), '') AS download_url
            FROM (SELECT *, {last_segment('url')} AS slug FROM pages WHERE page_type = 'open_data' AND coalesce(word_count, 0) >= 20 AND trim(coalesce(content_text, '')) <> ''))""",
        "node_dedup": "SELECT node_id, chunk_id, pos FROM (SELECT node_id, chunk_id, text, min(chunk_id) OVER (PARTITION BY node_id) AS pos FROM text_chunks) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY length(text) DESC NULLS LAST, chunk_id) = 1",
        "edges_valid": f"WITH {texts}, {section}, n AS ({all_nodes}) SELECT source_id, target_id, relation_type FROM ({all_edges}) WHERE source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n)",
        "edges_dropped": "SELECT id, parent_url AS source_id, url AS target_id FROM crawl_queue WHERE parent_url IS NOT NULL AND (parent_url NOT IN (SELECT url FROM pages) OR url NOT IN (SELECT url FROM pages))",
        "edge_merge": f"WITH e AS (SELECT {host('parent_url')} AS a, {host('url')} AS b, lower(status) AS rel, depth, id FROM crawl_queue WHERE parent_url IS NOT NULL AND id IS NOT NULL), kv AS (SELECT a, b, id, 'depth' AS k, CAST(depth AS VARCHAR) AS v FROM e UNION ALL SELECT a, b, id, 'has_' || rel, CAST(id AS VARCHAR) FROM e), l AS (SELECT a, b, k, arg_max(v, id) AS v FROM kv GROUP BY ALL), m AS (SELECT a, b, string_agg(k || '=' || v, chr(10) ORDER BY k) AS attributes FROM l GROUP BY ALL) SELECT a AS source_id, b AS target_id, arg_max(rel, id) AS relation_type, min(id) AS seq, count(*) AS times, min(attributes) AS attributes FROM e JOIN m USING (a, b) GROUP BY a, b",
        "graph_build": f"WITH {texts}, {section}, n AS (SELECT DISTINCT ON (node_id) * FROM ({all_nodes})), e AS (SELECT source_id, target_id, arg_max(relation_type, seq) AS relation_type FROM (SELECT 'mission:' || mission_slug AS source_id, node AS target_id, 'HAS_SECTION' AS relation_type, id * 10 + 1 AS seq FROM section_rows UNION ALL SELECT node, 'mission:' || mission_slug, 'PART_OF', id * 10 + 2 FROM section_rows UNION ALL SELECT source_id, target_id, relation_type, seq FROM ({doc_edges})) WHERE source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n) GROUP BY 1, 2) SELECT 'node' AS part, node_type AS kind, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', relation_type, count(*) FROM e GROUP BY 2",
        "neighbours": f"WITH {texts}, {section}, n AS ({all_nodes}) SELECT e.target_id, relation_type, label, node_type FROM ({all_edges}) e LEFT JOIN n ON e.target_id = n.node_id WHERE source_id = 'mission:{SLUGS[0]}'",
        "node_lookup": f"WITH {texts}, {section}, n AS ({all_nodes}) SELECT node_id, label FROM n WHERE node_type = 'Mission' UNION ALL SELECT node_id, label FROM n WHERE node_id = 'faq:1'",
        "node_statements": f"SELECT 'faq:' || id AS node_id, 'MERGE (n:FAQ {{node_id: ''faq:' || id || '''}})' || chr(10) || 'SET n += {{' || concat_ws(', ', " + ", ".join(f"CASE WHEN {v} IS NOT NULL THEN '{k}: ''' || {escaped(f'substr({v}, 1, 2000)')} || '''' END" for k, v in (("question", "question"), ("answer", "answer"), ("category", category), ("topic", topic))) + ") || '};' AS statement FROM faqs",
        "edge_statements": f"SELECT source_id, target_id, 'MATCH (a {{node_id: ''' || source_id || '''}}), (b {{node_id: ''' || target_id || '''}})' || chr(10) || 'MERGE (a)-[:DOCUMENTED_BY {{doc_type: ''' || kind || '''}}]->(b);' AS statement FROM (SELECT 'mission:' || {mission} AS source_id, 'doc:' || url_hash AS target_id, {doc_type} AS kind FROM site_documents WHERE extraction_ok AND {mission} IS NOT NULL)",
        "constraint_statements": "SELECT DISTINCT regexp_replace(node_type, '[^a-zA-Z0-9]', '', 'g') AS kind, 'CREATE CONSTRAINT IF NOT EXISTS FOR (n:' || regexp_replace(node_type, '[^a-zA-Z0-9]', '', 'g') || ') REQUIRE n.node_id IS UNIQUE;' AS statement FROM text_chunks",
        "chunk_split": split("documents", "doc_id", "text"),
        "chunk_documents": split("(SELECT 'doc:' || url_hash AS node_id, extracted_text FROM site_documents WHERE extraction_ok AND length(extracted_text) >= 200 QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY id DESC) = 1)", "node_id", "extracted_text", mark="full"),
        "chunk_faqs": split("(SELECT id, said FROM (SELECT id, CASE WHEN coalesce(question, '') <> '' AND coalesce(answer, '') <> '' THEN 'Question: ' || question || chr(10) || 'Answer: ' || answer ELSE question END AS said FROM faqs) WHERE length(trim(said)) >= 20)", "id", "said"),
        "vector_topk": f"WITH {scored} SELECT vec_id, label, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, vec_id LIMIT 24",
        "vector_search": group_search(48, 12),
        "vector_search_filtered": group_search(24, 6, "AND label % 2 = 0"),
        "vector_topk_each": f"SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {dot} AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10",
        "vector_recall": "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0",
        **{name: f"SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {dot} AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10" for name in ("vector_index_saved", "vector_index_exact")},
        **fixtures.ORACLES,
        "keyword_search": f"SELECT chunk_id, CAST(hits AS BIGINT) AS hits FROM (SELECT chunk_id, {words_hit(chunk_said, SEARCHED[0])} AS hits FROM text_chunks) WHERE hits > 0 ORDER BY hits DESC, chunk_id LIMIT 25",
        "keyword_search_each": f"WITH q(query_id, text) AS (VALUES {', '.join(f'({i}, {lit(x)})' for i, x in enumerate(SEARCHED))}), w AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM q), c AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all({chunk_said}, '{WORD}')) AS word FROM text_chunks), h AS (SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, count(*) AS hits FROM c JOIN w USING (word) GROUP BY ALL) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) <= {rt.TOP_K}",
        "graph_enrich": f"WITH {results} SELECT chunk_id, CAST(score AS DOUBLE) AS score FROM enriched",
        "rerank": f"WITH {results} SELECT chunk_id, row_number() OVER (ORDER BY score + {boost('document')} DESC, rank) AS rank FROM results",
        "budget_trim": f"SELECT chunk_id, node_id FROM ({budget.format(src='text_chunks', part='PARTITION BY node_id', order='chunk_id')}) WHERE used <= {rt.BUDGET} OR n = 1",
        "retrieve": f"WITH {results}, ranked AS (SELECT chunk_id, text, row_number() OVER (ORDER BY score + {boost('mission')} DESC, rank) AS rank FROM enriched) SELECT chunk_id, rank FROM ({budget.format(src='ranked', part='', order='rank')}) WHERE used <= {rt.BUDGET} OR n = 1",
        "history_tail": f"SELECT conv_id, turn, role FROM {conversation} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20",
        "turn_counts": f"SELECT conv_id, count(*) // 2 AS turns FROM {conversation} GROUP BY 1",
        "context_blocks": f"SELECT node_id, string_agg({entry}, chr(10) || chr(10) ORDER BY chunk_index + 1, {entry}) AS context FROM ({budget.format(src='text_chunks', part='PARTITION BY node_id', order='chunk_id')}) WHERE used <= {rt.BUDGET} OR n = 1 GROUP BY node_id",
        "source_lists": f"SELECT node_id, string_agg(s, chr(10) ORDER BY r, s) AS sources FROM (SELECT node_id, arg_min(s, {{'r': chunk_id, 's': s}}) AS s, min(chunk_id) AS r FROM (SELECT node_id, chunk_id, coalesce(nullif(source_url, ''), nullif(label, '')) AS k, '• ' || CASE WHEN coalesce(source_url, '') <> '' THEN coalesce(nullif(regexp_replace({path('source_url')}, '/+$', ''), ''), source_url) ELSE label END AS s FROM text_chunks) WHERE k IS NOT NULL GROUP BY node_id, k) GROUP BY node_id",
        "prompts": f"SELECT f.id AS conv_id, least(coalesce(n, 0), 20) + 1 AS n, '<context>' || chr(10) || coalesce(answer, 'No relevant context retrieved.') || chr(10) || '</context>' || chr(10) || chr(10) || 'Question: ' || question AS last FROM faqs f LEFT JOIN (SELECT conv_id, count(*) AS n FROM {conversation} GROUP BY 1) h ON f.id = h.conv_id WHERE question IS NOT NULL",
    }
