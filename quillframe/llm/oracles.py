"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: A list c of the remainders of all bytes, and crc32 of a text of ASCII characters.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS c
  FROM range(256) AS bytes(n)
)"""
CRC32 = """xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT),
    lambda x, byte: xor(x >> 8, c[(xor(x, byte) & 255) + 1])), 4294967295)"""

ORACLES = {
    "op1_warc": """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM sized
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM firsts
""",
    "op4_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (SELECT d.*, s.size, unnest(generate_series(1, len(w) - s.size + 1)) AS p
        FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(w) >= s.size)
), hits AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN bw USING (size, words)),
places AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hits))
  GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op5_chat_formatting": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(regexp_replace(role, '([<\\[])(\\\\*)(/?s>|/?INST\\]|/?SYS>>|\\|)', '\\1\\\\\\2\\3', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\]|/?SYS>>|\\|)', '\\1\\\\\\2\\3', 'g')) AS text_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + 13 + CASE WHEN opens THEN 7 + role_chars ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE x.norm > 0 AND y.norm > 0 AND list_sum(list_transform(generate_series(1, len(x.e)), lambda i: x.e[i] * y.e[i])) >= 0.98 * x.norm * y.norm
), reach AS (
  SELECT vec_id AS node, vec_id AS least FROM embeddings
  UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node WHERE reach.least < links.b
)
SELECT node AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(least) AS component_id, node = min(least) AS kept
FROM reach LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = node GROUP BY node
""",
    "op8_url_filters": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(r, '^[^/?#]*')) AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(h, p, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, parts.host, parts.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict
FROM parts LEFT JOIN hits ON parts.page_id = hits.page_id AND place = 1
""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS shingle
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY ALL
  ) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
  WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS least FROM documents
  UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node WHERE reach.least < links.b
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(least) AS component_id, w.doc_id = min(least) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = w.doc_id
GROUP BY w.doc_id, n.n
""",
    "op11_conversation_repair": fr"""
WITH RECURSIVE {CRC_TABLE}, raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32.format(text="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE fault <> 0
), numbered AS (
  SELECT *, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged
), rows AS (
  SELECT *, ending = '' AS blank, ending <> '' AND again AS duplicate,
    ending <> '' AND NOT again AND ending NOT IN ('.', '!', '?') AS truncated,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM numbered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n
  FROM rows GROUP BY conv_id
), best AS (
  SELECT conv_id, 0::BIGINT AS i, v.q, {{'cost': v.cost::BIGINT, 'audit': v.audit}} AS way
  FROM counts, (VALUES (0, 0, ''), (2, 3, 'I'), (3, 6, 'II')) v(q, cost, audit)
  UNION ALL
  SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit}}) FROM (
    SELECT conv_id, i, unnest([{{'q': q, 'cost': cost, 'audit': audit}},
      {{'q': CASE q WHEN 2 THEN 3 ELSE 2 END, 'cost': cost + 3, 'audit': audit || 'I'}},
      {{'q': CASE q WHEN 2 THEN 2 ELSE 3 END, 'cost': cost + 6, 'audit': audit || 'II'}}], recursive := true) FROM (
      SELECT b.conv_id, r.i, e.q, b.way.cost + e.cost + CASE WHEN r.truncated AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost,
        b.way.audit || e.edit AS audit
      FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
      JOIN (VALUES ('D', '*', 0, 0, 4), ('D', '*', 1, 1, 4), ('D', '*', 2, 2, 4), ('D', '*', 3, 3, 4),
        ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
        ('R', '*', 0, 2, 3), ('R', '*', 1, 2, 3), ('R', '*', 2, 3, 3), ('R', '*', 3, 2, 3)) e(edit, initial, was, q, cost)
      ON e.was = b.q AND (e.initial = '*' OR e.initial = r.initial) AND (e.edit = 'D' OR NOT (r.blank OR r.duplicate))))
  GROUP BY conv_id, i, q
), chosen AS (
  SELECT b.conv_id, min(b.way) AS way FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  WHERE b.q IN (0, 3) GROUP BY b.conv_id
), edits AS (
  SELECT conv_id, place, audit[place] AS edit, length(replace(left(audit, place), 'I', '')) AS i,
    length(replace(left(audit, place), 'D', '')) AS out
  FROM (SELECT conv_id, way.audit AS audit, unnest(generate_series(1, length(way.audit))) AS place FROM chosen)
), turns AS (
  SELECT e.*, r.role, CASE WHEN e.edit = 'I' THEN '' ELSE r.text END AS text,
    max(CASE WHEN e.out = 1 AND e.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i WHERE e.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY place) AS text FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.way.cost, 0) AS cost,
  coalesce(w.way.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE}, fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    n_chars + CASE WHEN doc_id IS NOT NULL AND {CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 THEN 1 ELSE 0 END AS again
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM (
    SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
      sha256(head || coalesce(octet_length(encode(again::VARCHAR)) || ':' || again, '-') || tail) AS seen
    FROM fields)
), nodes AS (
  SELECT lang, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 1) // 2)
  FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1
), forest AS (
  SELECT 0 AS level, place, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 1) // 2)
  FROM forest WHERE n > 1 GROUP BY level, place // 2
), steps AS (
  SELECT l.lang, l.place, x.level, (l.place >> x.level) & 1 AS side, y.h
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) x ON l.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN nodes y ON y.lang IS NOT DISTINCT FROM l.lang AND y.level = x.level AND y.place = xor(l.place >> x.level, 1)
  UNION ALL
  SELECT l.lang, l.place, 100 + x.level, (s.place >> x.level) & 1, y.h
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT level FROM forest WHERE n > 1) x
  LEFT JOIN forest y ON y.level = x.level AND y.place = xor(s.place >> x.level, 1)
), paths AS (
  SELECT lang, place, string_agg(h, '' ORDER BY level) AS siblings,
    list(CASE WHEN h IS NULL THEN '' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS path
  FROM steps GROUP BY lang, place
), folded AS (
  SELECT l.*, s.subroot, (SELECT h FROM forest WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce([l.seen] || coalesce(p.path, []::VARCHAR[]), lambda h, step: sha256(
      CASE step[1] WHEN 'L' THEN step[2:] || h WHEN 'R' THEN h || step[2:] ELSE h END)) AS folded_root
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
""",
    "op13_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY words ORDER BY doc_id, p) AS place
  FROM (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS words
        FROM (SELECT *, unnest(generate_series(1, len(w) - 19)) AS p FROM w WHERE len(w) >= 20))
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS q FROM windows WHERE place > 1
), removed AS (SELECT doc_id, list(q) AS q FROM covered GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w) w
  ANTI JOIN covered ON covered.doc_id = w.doc_id AND covered.q = w.place GROUP BY w.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(removed.q), 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
