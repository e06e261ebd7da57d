"""The same answers in DuckDB SQL over the same tables."""

from __future__ import annotations

import re

from quillframe.checks import fixtures as fx
from quillframe.checks.queries import FOLDER_DEPTH, HISTORY_TIME, KEPT_REPLY, PACKAGE, RUN_DOCSTRING, TAG
from quillframe.functions import prompts
from quillframe.operators import reports


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NL = lit("\n")
TOKENS = r"len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[ \t\r\n\f]+|[ \t\r\n\f]+\z', '', 'g')"


def parts(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda x: x <> '' AND x <> '.')"


def normalize(path: str) -> str:
    return f"array_to_string({parts(path)}, '/')"


def parent(path: str) -> str:
    return rf"regexp_replace({path}, '(^|/)[^/]*\z', '')"


def folder_of(path: str, depth: int) -> str:
    return f"array_to_string(list_slice({parts(path)}, 1, least({depth}, len({parts(path)}) - 1)), '/')"


def module_sql() -> str:
    content = lit(fx.MODULE)
    for hole, column in (("key", "p_partkey"), ("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"), ("name", "p_name")):
        content = f"replace({content}, '{{{hole}}}', {column}::VARCHAR)"
    return f"CASE WHEN p_brand = '{fx.BROKEN_BRAND}' THEN {content} || {lit(fx.BROKEN)} ELSE {content} END"


CTES = {
    "doc_files": """
        SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
               text AS content, lang, source, n_chars FROM documents""",
    "labelled": "SELECT d.*, quality, toxic FROM doc_files d LEFT JOIN labels USING (doc_id)",
    "manifest": """
        SELECT path, CASE WHEN quality = 1 THEN sha256(content) ELSE 'stale' END AS sha256
        FROM labelled WHERE quality IS NOT NULL""",
    "summaries": """
        SELECT './/' || path AS path,
               'Text in ' || lang || ' from ' || source || ', characters: ' || n_chars AS description
        FROM labelled WHERE quality IS NOT NULL""",
    "page_paths": rf"""
        SELECT page_id, html, regexp_replace({normalize(r"regexp_replace(url, '^[a-z]+://|[?#].*\z', '', 'g')")}, '^m\.', '.') AS p
        FROM pages""",
    "page_files": r"""
        SELECT page_id, CASE WHEN starts_with(p, 'blog.') THEN regexp_replace(p, '/([^/]*)\z', '/.\1') ELSE p END AS path,
               strlen(html) AS size_bytes FROM page_paths""",
    "page_parts": f"""
        SELECT *, {parts('path')} AS parts, split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS lang,
               split_part(path, '/', -1) AS name FROM page_files""",
    "page_chain": """
        SELECT page_id, path, size_bytes, unnest(range(0, len(parts))) AS depth,
               array_to_string(list_slice(parts, 1, unnest(range(0, len(parts)))), '/') AS folder,
               len(parts) AS n FROM page_parts""",
    "all_folders": "SELECT DISTINCT folder, depth FROM page_chain",
    "code_files": f"""
        SELECT 'pkg/' || p_type || '/part_' || p_partkey || '.py' AS path, {module_sql()} AS content,
               p_partkey, p_name, p_brand, p_type, p_size FROM part""",
    "good_code": f"SELECT * FROM code_files WHERE p_brand <> '{fx.BROKEN_BRAND}'",
    "code_imports": """
        SELECT path, unnest([0, 1, 2, 3, 4]) AS ordinal,
               unnest(['shop.' || p_type, 'shop.' || p_type || '.mix', 'shop.' || p_type || '.mix', 'shop.wild', NULL]) AS module,
               unnest(['Base' || p_size, 'Mixin' || p_size, 'helper_' || p_size, '*', 'sibling']) AS name
        FROM good_code""",
    "code_symbols": f"""
        SELECT path, unnest([0, 1, 2, 3]) AS position,
               unnest(['module', 'Part' || p_partkey, 'Part' || p_partkey || '.fetch', 'cost']) AS qualified_name,
               unnest(['module', 'class', 'async function', 'function']) AS kind,
               unnest(['Part ' || p_partkey || ' of the catalogue.' || {NL} || {NL} || 'Sold as ' || p_brand || '.',
                       p_name, 'Fetch ' || p_name || '.' || {NL} || {NL} || 'In the background.',
                       'Last cost of ' || p_brand]) AS docstring
        FROM good_code""",
    "code_classes": """
        SELECT path, 0 AS position, 'Part' || p_partkey AS class_name, NULL AS docstring, []::VARCHAR[] AS parents FROM good_code
        UNION ALL
        SELECT path, 1, 'Spare' || p_partkey, 'Spare for ' || p_brand, ['Part' || p_partkey, 'Unknown'] FROM good_code""",
    "import_queries": """
        SELECT path, CASE WHEN p_brand <> '{broken}' THEN 'Base' || p_size || ' Mixin' || p_size || ' helper_' || p_size ELSE '' END AS query,
               content FROM code_files""".replace("{broken}", fx.BROKEN_BRAND),
    "vectors": """
        SELECT vec_id::VARCHAR AS id, content AS document, path AS file_path, 'label_' || label AS file_type,
               embedding::DOUBLE[] AS embedding, doc_id
        FROM embeddings JOIN doc_files ON vec_id = doc_id""",
    "batches": """
        SELECT source AS batch, CASE WHEN source = 'src3' THEN lang ELSE doc_id::VARCHAR END AS id,
               CASE WHEN source = 'src5' AND quality IS NULL THEN ''
                    WHEN source = 'src7' AND quality IS NULL THEN NULL ELSE content END AS document
        FROM labelled""",
    "revisions": rf"""
        SELECT doc_id, content AS old,
               CASE WHEN quality = 0 THEN content || {NL} || 'reviewed'
                    WHEN toxic = 1 THEN regexp_replace(content, '^[^\n]*\n', '') ELSE content END AS new
        FROM labelled""",
    "decisions": f"""
        SELECT doc_id, CASE WHEN toxic = 1 THEN 'maybe' WHEN quality = 1 THEN ' Yes ' || {NL} ELSE 'n' END AS answer
        FROM labels""",
    "model_output": f"""
        SELECT doc_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 0 THEN '{TAG}' || {NL} || body
                            WHEN quality = 1 THEN body || {NL} ELSE body END AS content
        FROM (SELECT *, {lit('` ``python' + chr(10))} || content || {lit(chr(10) + '` ``')} AS body
              FROM labelled)""".replace("SELECT *,", "SELECT doc_id, quality, toxic,"),
    "changed": """
        SELECT d.path, sha256(d.content) AS sha256, strlen(d.content) AS size_bytes, d.source, d.lang
        FROM doc_files d LEFT JOIN manifest m ON m.path = d.path AND m.sha256 = sha256(d.content)
        WHERE m.path IS NULL""",
    "repo_urls": """
        SELECT doc_id, CASE WHEN source = 'src3' THEN 'https://example.org/' || name
                            WHEN quality = 1 THEN 'git@github.com:' || name || '.git'
                            WHEN quality = 0 THEN 'https://github.com/' || name || '.git'
                            ELSE 'https://github.com/' || name END AS url
        FROM (SELECT *, lang || '/' || source || '-' || doc_id AS name FROM labelled)""",
}


def with_ctes(body: str) -> str:
    """Prefix the CTEs the statement mentions, in definition order."""
    needed: set[str] = set()

    def visit(statement: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "''", statement)):
                needed.add(name)
                visit(definition)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed) + "\n" + body


def hashed_words(source: str, name: str, key: str, content: str) -> str:
    """CTEs computing the default embedding of ``content`` as ``name``."""
    return f"""
        {name}_words AS (SELECT {key} AS id, lower(unnest(regexp_extract_all({content}, '[A-Za-z0-9_]+'))) AS word FROM {source}),
        {name}_counts AS (SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS slot, count(*) AS n
                          FROM {name}_words GROUP BY ALL),
        {name}_norms AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS norm FROM {name}_counts GROUP BY id),
        {name} AS (SELECT id, slot, (n::DOUBLE / norm)::FLOAT AS weight FROM {name}_counts JOIN {name}_norms USING (id))"""


def add_ctes(extra: str, body: str) -> str:
    """CTEs of the registry, then ``extra`` ones, then the body."""
    prefixed = with_ctes(extra + "\n SELECT " + body)
    cut = prefixed.rfind(extra)
    head = prefixed[:cut].rstrip()
    return (head + ", " if head else "WITH ") + extra + "\n" + body


NEAREST = """
    SELECT query_id, id, distance, rank FROM (
        SELECT q.vec_id AS query_id, v.id, {distance} AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, v.id)::INT AS rank
        FROM embeddings q, vectors v WHERE {where}) WHERE rank <= 5"""
L2 = "round(pow(list_distance(q.embedding::DOUBLE[], v.embedding), 2), 9)"
COSINE = "round(list_cosine_distance(q.embedding::DOUBLE[], v.embedding), 9)"


def section(retrieved: str, description: str) -> str:
    return f"""
        (CASE WHEN coalesce({retrieved}, '') <> '' THEN {lit(prompts.EXAMPLES_TITLE)} || {retrieved} || {lit(chr(10) * 2)} ELSE '' END
         || CASE WHEN coalesce({description}, '') <> '' THEN {lit(prompts.MORE_TITLE)} || {description} || {lit(chr(10) * 2)} ELSE '' END)"""


def _bodies() -> dict[str, str]:
    fence3 = "'```'"
    escaped = "'` ``'"
    pages = "SELECT page_id, path FROM page_parts WHERE "
    return {
        "run_first": f"""
            SELECT path, sha256('{TAG}' || {NL} || {lit(RUN_DOCSTRING)} || rtrim(content, {NL}) || {NL}) AS sha256 FROM code_files""",
        "run_second": """
            SELECT name AS "table", CASE WHEN name IN ('manifest', 'files') THEN (SELECT count(*) FROM code_files) ELSE 0 END AS rows
            FROM (SELECT unnest(['pending', 'descriptions', 'contents', 'reports', 'manifest', 'files']) AS name)""",
        "src1_scan_source_tree": "SELECT path, strlen(content) AS size_bytes, sha256(content) AS sha256, NULL::VARCHAR AS error FROM code_files",
        "src2_load_manifest": "SELECT path, sha256 FROM manifest WHERE sha256 <> 'stale'",
        "src3_load_summaries": "SELECT path, description FROM summaries",
        "src4_parse_ignore_rules": """
            SELECT dir, unnest(['es/', '#odd', '*.' || dir]) AS pattern FROM (SELECT DISTINCT host AS dir FROM page_parts)""",
        "snk1_save_manifest": "SELECT path, sha256(content) AS sha256 FROM doc_files",
        "snk2_save_summaries": "SELECT path, description FROM summaries",
        "snk3_save_descriptions": f"""
            SELECT {normalize('path')} AS path, 'data/' || {normalize('path')} AS out_path, description,
                   split_part({normalize('path')}, '/', 1) AS top_folder FROM summaries""",
        "snk4_vector_collection": """
            SELECT id, document, file_path, file_type, round(list_sum(embedding), 6) AS embedding_sum,
                   {tokens} AS tokens FROM vectors""".replace("{tokens}", TOKENS.format("document")),
        "snk4_class_vectors": """
            SELECT path || '::' || class_name AS id, docstring AS document, path AS file_path, class_name, 'class' AS file_type,
                   {tokens} AS tokens FROM code_classes WHERE docstring <> ''""".replace("{tokens}", TOKENS.format("docstring")),
        "snk5_keep_history": f"""
            SELECT doc_id::VARCHAR AS path, old AS content, strftime(TIMESTAMP '{HISTORY_TIME}', '%Y%m%d%H%M%S') AS stamp
            FROM revisions WHERE old <> new""",
        "flt1_suffix_filter": pages + "path LIKE '%.html'",
        "flt2_hidden_folder_filter": pages + "NOT starts_with(host, '.')",
        "flt3_ignore_rule_filter": pages + r"""
            NOT (host LIKE 'spam-%.org') AND lang <> 'es'
            AND NOT (lang = 'en' AND regexp_matches(name, '^[0-4].[^5].*$'))
            AND NOT (lang = 'fr' AND name LIKE '%.html')""",
        "flt4_ignore_subtree_filter": pages + "NOT (starts_with(host, 'blog.') AND lang = 'en')",
        "flt5_ignore_suffix_filter": pages + r"regexp_extract(name, '^.+(\.[^.]+)$', 1) <> '.html'",
        "flt6_metadata_filter": NEAREST.format(distance=L2, where="v.file_type = 'label_3'"),
        "flt7_folder_depth_filter": f"SELECT folder, depth::INT AS depth FROM all_folders WHERE depth <= {FOLDER_DEPTH}",
        "flt8_blank_entry_filter": f"""
            SELECT doc_id, len(kept)::INT AS lines, array_to_string(kept, {NL}) AS kept FROM (
                SELECT doc_id, list_filter(string_split({strip('content')}, {NL}), lambda x: x <> '') AS kept FROM doc_files)""",
        "flt9_package_import_filter": f"""
            SELECT path, ordinal, module, name FROM code_imports
            WHERE (module = '{PACKAGE}' OR starts_with(module, '{PACKAGE}.')) AND name <> '*'""",
        "flt10_empty_output_filter": """
            SELECT doc_id, CASE WHEN content = '' THEN 'no changes' ELSE 'accepted' END AS status FROM model_output""",
        "jon1_changed_files": "SELECT path, sha256, size_bytes FROM changed",
        "jon1_changed_by_state": "SELECT path, sha256, size_bytes FROM changed",
        "jon2_skip_described": f"""
            SELECT doc_id, path FROM doc_files ANTI JOIN (SELECT {normalize('path')} AS path FROM summaries) USING (path)""",
        "jon3_description_lookup": f"""
            SELECT d.path, coalesce(s.description, '') AS description
            FROM doc_files d LEFT JOIN (SELECT {normalize('path')} AS path, description FROM summaries) s USING (path)""",
        "jon4_folder_assignment": f"SELECT page_id, path, {folder_of('path', FOLDER_DEPTH)} AS folder FROM page_files",
        "jon4_listed_folder_assignment": """
            SELECT page_id, any_value(path) AS path,
                   coalesce(arg_max(folder, depth) FILTER (starts_with(folder, 'blog.') OR folder LIKE '%/en'), '') AS folder
            FROM page_chain GROUP BY page_id""",
        "jon5_insert_if_absent": """
            SELECT id, document, file_type FROM vectors ANTI JOIN (SELECT doc_id::VARCHAR AS id FROM labels) USING (id)""",
        "jon6_vector_top_k": NEAREST.format(distance=L2, where="true"),
        "jon6_vector_top_k_blocks": NEAREST.format(distance=L2, where="true"),
        "jon6_indexed_top_k": NEAREST.format(distance=L2, where="true"),
        "jon6_indexed_top_k_cosine_visits": NEAREST.format(distance=COSINE, where="true"),
        "jon6_vector_top_k_cosine": NEAREST.format(distance=COSINE, where="true"),
        "jon7_approval_gate": f"""
            SELECT doc_id, old <> new AS changed FROM revisions
            SEMI JOIN (SELECT doc_id FROM decisions WHERE lower({strip('answer')}) IN ('yes', 'y')) USING (doc_id)""",
        "jon8_class_docstring_lookup": f"""
            SELECT path, unnest(['Part' || p_partkey, 'Spare' || p_partkey, 'Missing' || p_partkey]) AS class_name,
                   unnest(CASE WHEN p_brand = '{fx.BROKEN_BRAND}' THEN ['', '', ''] ELSE [p_name, 'Spare for ' || p_brand, ''] END) AS docstring
            FROM code_files""",
        "agg1_batch_validation": """
            SELECT batch, n AS rows, reason = 'ok' AS accepted, reason FROM (
                SELECT batch, count(*) AS n,
                       CASE WHEN count(document) <> count(*) THEN 'length mismatch'
                            WHEN count(*) FILTER (document = '') > 0 THEN 'empty document'
                            WHEN count(DISTINCT id) < count(*) THEN 'duplicate id' ELSE 'ok' END AS reason
                FROM batches GROUP BY batch)""",
        "agg2_folders_by_depth": f"""
            SELECT depth::INT AS depth, 0 AS part, count(*)::INT AS n_folders, string_agg(folder, {NL} ORDER BY folder) AS folders
            FROM all_folders WHERE depth <= {FOLDER_DEPTH} GROUP BY depth""",
        "agg3_folder_change_reports": f"""
            SELECT source || '/' || lang AS folder, 0 AS part,
                   {lit(reports.REPORT_HEADER)} || string_agg('- `' || path || '`' || {NL}, '' ORDER BY path) AS body
            FROM changed GROUP BY ALL""",
        "agg4_compiled_docstrings": f"""
            SELECT c.path, coalesce(t.compiled, '') AS compiled FROM code_files c LEFT JOIN (
                SELECT path, string_agg(qualified_name || ' (' || kind || '):' || {NL} || docstring, {lit(chr(10) * 2)} ORDER BY position) AS compiled
                FROM code_symbols GROUP BY path) t USING (path)""",
        "agg5_docstring_descriptions": f"""
            SELECT path, CASE WHEN p_brand = '{fx.BROKEN_BRAND}' THEN '' ELSE
                   'module: Part ' || p_partkey || ' of the catalogue.; Part' || p_partkey || ': ' || p_name
                   || '; cost: First cost of ' || p_name || '; cost: Last cost of ' || p_brand
                   || '; fetch: Fetch ' || p_name || '.; Spare' || p_partkey || ': Spare for ' || p_brand END AS description
            FROM code_files""",
        "agg6_import_query_text": "SELECT path, query FROM import_queries",
        "agg7_directory_rollup": r"""
            SELECT f.folder, f.depth::INT AS depth, split_part(f.folder, '/', -1) AS name,
                   f.own_files, f.own_files + coalesce(c.n, 0) AS children, f.subtree_files, f.subtree_bytes
            FROM (SELECT folder, depth, count(*) FILTER (depth = n - 1) AS own_files, count(*) AS subtree_files,
                         sum(size_bytes)::BIGINT AS subtree_bytes FROM page_chain GROUP BY folder, depth) f
            LEFT JOIN (SELECT regexp_replace(folder, '(^|/)[^/]*\z', '') AS up, count(*) AS n
                       FROM all_folders WHERE depth > 0 GROUP BY up) c ON c.up = f.folder""",
        "agg7_directory_listing": """
            SELECT folder AS path, depth::INT AS depth, repeat('  ', depth::INT) || split_part(folder, '/', -1) || '/' AS line FROM all_folders
            UNION ALL
            SELECT path, len(parts)::INT, repeat('  ', len(parts)::INT) || name FROM page_parts""",
        "agg7_ignored_tree": """
            SELECT path, is_folder, depth::INT AS depth,
                   repeat('  ', depth::INT) || CASE WHEN path = '' THEN 'pages' ELSE name END || CASE WHEN is_folder THEN '/' ELSE '' END AS line
            FROM (
                SELECT *, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, split_part(path, '/', -1) AS name FROM (
                    SELECT folder AS path, true AS is_folder FROM all_folders
                    UNION ALL SELECT path, false FROM page_parts WHERE NOT (lang = 'en' AND regexp_matches(name, '^[0-4]'))
                    UNION ALL SELECT DISTINCT host || '/.gitignore', false FROM page_parts
                    UNION ALL SELECT DISTINCT folder || '/.gitignore', false FROM page_chain WHERE folder LIKE '%/en' AND depth = n - 1))
            WHERE split_part(path, '/', 2) <> 'es' AND NOT (starts_with(path, 'blog.') AND split_part(path, '/', 2) = 'en')
              AND (is_folder OR regexp_extract(name, '^.+([.][^.]+)$', 1) <> '.htm')""",
        "agg8_run_counters": """
            SELECT (SELECT count(*) FROM doc_files) AS found, (SELECT count(*) FROM changed) AS changed,
                   (SELECT count(*) FROM doc_files) - (SELECT count(*) FROM changed) AS unchanged, 0::BIGINT AS failed""",
        "agg9_packed_context": f"""
            SELECT query_id, coalesce(string_agg(document || {lit(chr(10) * 2)}, '' ORDER BY rank) FILTER (running <= budget), '') AS context
            FROM (SELECT q.id AS query_id, r.rank, r.document,
                         floor((4000 - length(q.document)) / 2)::BIGINT AS budget,
                         sum({TOKENS.format('r.document')}) OVER (PARTITION BY q.id ORDER BY r.rank) AS running
                  FROM vectors q JOIN (
                      SELECT q.id AS query_id, v.document, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, v.id) AS rank
                      FROM vectors q, vectors v) r ON r.query_id = q.id AND r.rank <= 5)
            GROUP BY query_id""",
        "win1_token_budget_packing": f"""
            SELECT source, doc_id, rank, tokens, running_tokens FROM (
                SELECT source, doc_id, row_number() OVER w AS rank, tokens, (sum(tokens) OVER w)::BIGINT AS running_tokens,
                       floor((64000 - max(n_chars) OVER (PARTITION BY source)) / 2) AS budget
                FROM (SELECT source, doc_id, n_chars, {TOKENS.format('content')} AS tokens FROM doc_files)
                WINDOW w AS (PARTITION BY source ORDER BY doc_id))
            WHERE running_tokens <= budget""",
        "win2_last_message": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
        "win2_last_assistant_message": """
            SELECT conv_id, max(turn) AS turn, 'assistant' AS role, arg_max(text, turn) AS text
            FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
        "win3_first_match": """
            SELECT sha256(content) AS sha256, doc_id, path, lang FROM doc_files
            QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id) = 1""",
        "win4_last_definition": """
            SELECT p_brand, p_name, min(p_partkey) AS p_partkey, arg_max(p_type, p_partkey) AS p_type, arg_max(p_size, p_partkey) AS p_size
            FROM part GROUP BY ALL""",
        "srt1_work_order": """
            SELECT path, sha256, size_bytes, row_number() OVER (ORDER BY size_bytes, path) AS position FROM changed""",
        "srt2_top_five": """
            SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank
            FROM doc_files QUALIFY rank <= 5""",
        "srt3_deepest_folders_first": """
            SELECT folder, depth::INT AS depth, row_number() OVER (ORDER BY depth DESC, folder) AS position FROM all_folders""",
        "srt4_messages_in_order": """
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""",
        "set1_manifest_merge": """
            SELECT path, coalesce(c.sha256, m.sha256) AS sha256 FROM manifest m FULL JOIN changed c USING (path)""",
        "set1_manifest_in_state": """
            SELECT path, coalesce(c.sha256, m.sha256) AS sha256 FROM manifest m FULL JOIN changed c USING (path)""",
        "set2_append_summaries": f"""
            SELECT {normalize('path')} AS path, description FROM summaries
            UNION ALL
            SELECT path, 'New text in ' || lang FROM labelled WHERE quality IS NULL""",
        "set3_merge_metadata": """
            SELECT id, 3 AS n_keys, file_path, 'script' AS file_type, lang FROM vectors JOIN doc_files USING (doc_id)""",
        "set4_line_diff": f"""
            SELECT doc_id, line, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change, abs(net)::BIGINT AS lines FROM (
                SELECT doc_id, line, sum(side) AS net FROM (
                    SELECT doc_id, unnest(string_split(old, {NL})) AS line, -1 AS side FROM revisions
                    UNION ALL SELECT doc_id, unnest(string_split(new, {NL})), 1 FROM revisions)
                GROUP BY ALL) WHERE net <> 0""",
        "scl1_content_hash": "SELECT path, sha256(content) AS sha256, strlen(content) AS size_bytes FROM doc_files",
        "scl2_path_functions": rf"""
            SELECT page_id, 'site/' || path AS normalized, path AS relative, len(parts)::INT AS depth,
                   host || '/' || lang AS parent, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS suffix,
                   CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_replace(path, '\.[^.]+$', '.txt') ELSE path || '.txt' END AS swapped
            FROM page_parts""",
        "scl2_byte_sizes": "SELECT doc_id, strlen(content) AS size_bytes FROM doc_files",
        "scl3_header_tag": f"""
            SELECT doc_id, CASE WHEN contains(content, '{TAG}') THEN content ELSE '{TAG}' || {NL} || content END AS content FROM model_output""",
        "scl4_trailing_newline": f"""
            SELECT doc_id, CASE WHEN ends_with(content, {NL}) THEN content ELSE content || {NL} END AS content FROM model_output""",
        "scl5_fence_escape": f"""
            SELECT doc_id, {lit('` ``python' + chr(10))} || replace(content, {fence3}, {escaped}) || {lit(chr(10) + '` ``')} AS escaped,
                   NOT contains(content, {escaped}) AS restored FROM doc_files""",
        "scl6_sanitized_names": """
            SELECT page_id, regexp_replace(replace(url, '/', '-'), '[^A-Za-z0-9_-]+', '_', 'g') AS name, substr(sha256(url), 1, 8) AS suffix
            FROM pages""",
        "scl7_repository_names": """
            SELECT doc_id, CASE WHEN source <> 'src3' THEN lang END AS owner,
                   CASE WHEN source <> 'src3' THEN source || '-' || doc_id END AS name FROM doc_files""",
        "scl8_token_counts": f"SELECT doc_id, {TOKENS.format('content')} AS tokens FROM doc_files",
        "scl9_prompt_columns": f"""
            SELECT doc_id,
                   {lit(prompts.DESCRIBE_PREAMBLE + prompts.DESCRIBE_PATH)} || '`' || path || '`' || {lit(chr(10) * 2 + prompts.DESCRIBE_CONTENT)}
                       || body || {lit(prompts.CLOSING_FENCE)} AS describe,
                   {lit(prompts.DESCRIBE_PREAMBLE)} || CASE WHEN quality = 0 THEN {lit(prompts.DESCRIBE_TREE + 'a/' + chr(10) + '  b' + chr(10) * 2)} ELSE '' END
                       || {lit(prompts.DESCRIBE_CONTENT)} || body || {lit(prompts.CLOSING_FENCE)} AS describe_tree,
                   {lit(prompts.DOCUMENT_PREAMBLE + prompts.DOCUMENT_CONTEXT)}
                       || CASE WHEN toxic = 1 THEN {lit(prompts.NO_CONTEXT)}
                               ELSE {section("CASE WHEN quality = 1 THEN body END", "source")} END
                       || {lit(prompts.DOCUMENT_INSTRUCTIONS)} || replace(body, {fence3}, {escaped}) || {lit(prompts.CLOSING_FENCE)} AS document,
                   path || '::' || lang AS composite,
                   floor((64000 - length(body)) / 2)::BIGINT AS budget
            FROM (SELECT doc_id, path, lang, source, quality, toxic, {lit('```' + chr(10))} || content AS body FROM labelled)""",
        "scl10_small_text_maps": f"""
            SELECT l.doc_id, CASE WHEN quality IS NULL OR toxic = 1 THEN NULL ELSE quality = 1 END AS decision,
                   split_part({strip('l.content')}, {NL}, 1) AS first_line, left(l.content, 200) AS preview,
                   CASE WHEN quality = 1 THEN '[HIDDEN]' ELSE 'NOT SET' END AS secret,
                   length(m.content)::INT AS parsed_chars
            FROM labelled l JOIN model_output m USING (doc_id)""",
        "udf1_symbol_extraction": "SELECT path, position, qualified_name, kind, docstring FROM code_symbols",
        "udf2_class_hierarchy": """
            SELECT path, class_name, unnest(range(0, len(parents)))::INT AS parent_position, unnest(parents) AS parent FROM code_classes""",
        "udf2_class_table": "SELECT path, position, class_name, array_to_string(parents, ',') AS parents, docstring FROM code_classes",
        "udf3_import_listing": "SELECT path, ordinal, module, name FROM code_imports",
        "udf5_batch_completion": f"""
            SELECT digest AS prompt_hash, '{KEPT_REPLY}' || digest AS text, 1 AS attempts, 'completed' AS status, NULL::VARCHAR AS error
            FROM (SELECT DISTINCT sha256({lit(prompts.DESCRIBE_PREAMBLE + prompts.DESCRIBE_CONTENT)} || content || {lit(prompts.CLOSING_FENCE)}) AS digest
                  FROM doc_files)""",
        "udf6_named_post_processor": f"""
            SELECT doc_id, CASE WHEN ends_with(headed, {NL}) THEN headed ELSE headed || {NL} END AS new_content FROM (
                SELECT doc_id, CASE WHEN contains(plain, '{TAG}') THEN plain ELSE '{TAG}' || {NL} || plain END AS headed FROM (
                    SELECT doc_id, replace(content, {escaped}, {fence3}) AS plain FROM model_output WHERE content <> ''))""",
    }


def _with_embeddings() -> dict[str, str]:
    docs = hashed_words("doc_files", "docs", "doc_id", "content")
    code = hashed_words("code_files", "code", "path", "content")
    asked = hashed_words("(SELECT DISTINCT query FROM import_queries)", "asked", "query", "query")
    hits = f"""{code}, {asked},
        sizes AS (SELECT id, sum(weight::DOUBLE * weight::DOUBLE) AS s FROM code GROUP BY id),
        dots AS (SELECT a.id AS query, c.id, sum(a.weight::DOUBLE * c.weight::DOUBLE) AS d, FROM asked a JOIN code c USING (slot) GROUP BY ALL),
        asked_sizes AS (SELECT id AS query, sum(weight::DOUBLE * weight::DOUBLE) AS s FROM asked GROUP BY id),
        distinct_queries AS (SELECT DISTINCT query FROM import_queries),
        scored AS (SELECT q.query, z.id, round(coalesce(s.s, 0) + z.s - 2 * coalesce(d.d, 0), 9) AS distance
                   FROM distinct_queries q CROSS JOIN sizes z LEFT JOIN asked_sizes s ON s.query = q.query
                   LEFT JOIN dots d ON d.query = q.query AND d.id = z.id),
        ranked AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM scored QUALIFY rank <= 5),
        running AS (SELECT r.query, r.rank, f.content AS document,
                           sum({TOKENS.format('f.content')}) OVER (PARTITION BY r.query ORDER BY r.rank) AS tokens
                    FROM ranked r JOIN code_files f ON f.path = r.id)"""
    return {
        "udf4_batch_embedding": add_ctes(docs, "SELECT id AS doc_id, slot::INT AS slot, round(weight::DOUBLE, 6) AS weight FROM docs"),
        "jon9_import_context": add_ctes(hits, f"""
            SELECT i.path, i.query,
                   sha256(coalesce(string_agg(r.document || {lit(chr(10) * 2)}, '' ORDER BY r.rank)
                          FILTER (r.tokens <= floor((64000 - length(i.content)) / 2)), '')) AS context_sha256
            FROM import_queries i JOIN running r USING (query) GROUP BY i.path, i.query"""),
    }


ORACLES = {name: with_ctes(body) for name, body in _bodies().items()} | _with_embeddings()
