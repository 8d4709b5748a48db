"""The queries of this package and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from .chat import op7_chat_formatting
from .decontamination import op3_decontamination
from .exact_dedup import op5_exact_dedup
from .infill import OP11_SQL, op11_fill_in_middle
from .language import op2_language_id
from .lines import op6_line_dedup
from .lm import op9_lm_scoring
from .mixing import OP13_SQL, op13_mixing
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op4_best_fit_packing
from .simhash import op8_simhash
from .token_files import op1_token_files
from .urls import chained_verdicts, op10_url_filters

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_simhash": op8_simhash,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_url_filters": op10_url_filters,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_mixing": op13_mixing,
    "chained_verdicts": chained_verdicts,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_decontamination": f"""
        WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        pats AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT n FROM pats),
        dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        wins AS (
            SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
        ),
        found AS (SELECT doc_id, wins.n, i, item FROM wins JOIN pats ON wins.n = pats.n AND wins.p = pats.p),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op6_line_dedup": """
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, i AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)),
        firsts AS (SELECT doc_id, pos, line, row_number() OVER (ORDER BY doc_id, pos) AS o
                   FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS rn FROM lines WHERE line <> '') WHERE rn = 1),
        long AS (SELECT o, line, length(line) AS n FROM firsts WHERE length(line) >= 20),
        variants AS (SELECT o, n, i, hash(substring(line, 1, i - 1) || substring(line, i + 1)) AS v
                     FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)),
        replaced AS (SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY n, i, v) AS lead FROM variants) WHERE o <> lead),
        added AS (SELECT greatest(variants.o, long.o) AS o FROM variants JOIN long ON variants.n = long.n + 1 AND variants.v = hash(long.line)),
        stay AS (SELECT doc_id, pos FROM firsts WHERE o NOT IN (SELECT o FROM replaced UNION ALL SELECT o FROM added))
        SELECT lines.doc_id, count(*) AS n_lines, count(*) FILTER (line = '' OR stay.pos IS NOT NULL) AS n_kept,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.pos) FILTER (line = '' OR stay.pos IS NOT NULL), '')) AS text_sha256
        FROM lines LEFT JOIN stay ON lines.doc_id = stay.doc_id AND lines.pos = stay.pos
        GROUP BY lines.doc_id""",
    "op7_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        near AS (
            SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
                   regexp_replace(regexp_replace(regexp_replace(text, '(<)(\\*(?:\||/?s>))', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g'), '(\|)(\\*>)', '\1\\\2', 'g') AS escaped
            FROM rows WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(escaped) + CASE WHEN before IS DISTINCT FROM role THEN 5 + length(role) ELSE 5 END
                   + CASE WHEN after IS DISTINCT FROM role THEN 5 ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM near GROUP BY conv_id, alone""",
    "chained_verdicts": """
        SELECT DISTINCT page_id, 'w' || CAST(page_id // 5 AS VARCHAR) || '.example.org' AS host, CAST(NULL AS VARCHAR) AS rule,
               CASE WHEN (page_id // 5) % 3 = 0 AND bool_or(page_id % 5 = 4) OVER (PARTITION BY page_id // 5) THEN 'block' ELSE 'allow' END AS verdict
        FROM pages""",
    "op10_url_filters": r"""
        WITH RECURSIVE parts AS (
            SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                   regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS tail
            FROM pages
        ),
        rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        nodes AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN tail = '' THEN '/' ELSE tail END END AS node FROM parts),
        tags AS (SELECT node AS a, unnest(regexp_extract_all(html, '<link[^>]*rel="canonical"[^>]*href="(?:[a-z]+://[^"#]*)', 0)) AS tag FROM nodes),
        links AS (SELECT a, regexp_extract(tag, 'href="[a-z]+://([^"#]*)', 1) AS b FROM tags),
        pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a, a AS b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
        names AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/?]*', 0) AS host, regexp_extract(a, '^[^/?]*([^?]*)', 1) AS path FROM pairs),
        judged AS (SELECT node, arg_max(verdict, length(h || p)) AS verdict FROM names JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
        bad AS (SELECT DISTINCT reach.a AS node FROM reach JOIN judged ON reach.b = judged.node WHERE verdict = 'block'),
        fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                 FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT nodes.page_id, host, path, rule, coalesce(fits.verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM nodes LEFT JOIN fits ON nodes.page_id = fits.page_id LEFT JOIN bad ON nodes.node = bad.node""",
    "op11_fill_in_middle": OP11_SQL,
    "op13_mixing": OP13_SQL,
    "op12_hard_negatives": OP12_SQL,
}
