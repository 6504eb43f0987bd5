"""The pN_ queries in DuckDB's SQL, where that can state them on whole tables."""

from __future__ import annotations

import unicodedata

# Latin letters, each with the Cyrillic and Greek letters of its shape; kept apart from the operator's own table, which it checks.
_SHAPES = (
    "AАΑ BВΒ CС EЕΕ HНΗ IІӀΙ JЈ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ WԜ XХΧ YҮΥ ZΖ GԌ aа cс dԁ eе hһ iі jјϳ lӏ oоο pр qԛ sѕ wԝ xх yу"
)


def _reading(column: str) -> str:
    """What a text reads like, letter by letter: no invisible characters, plain spaces, widths and ligatures undone, Latin letters for all of their shape."""
    shapes = {x: group[0] for group in _SHAPES.split() for x in group[1:]}
    to = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), *range(0xFF01, 0xFFA0), *range(0xFFA1, 0xFFEF))}
    for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if base in shapes:
            to[chr(c)] = unicodedata.normalize("NFC", shapes[base] + "".join(marks))
    text = f"regexp_replace(regexp_replace({column}, '[\\p{{Cf}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FFA0}}\\x{{180B}}-\\x{{180F}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'), '\\p{{Zs}}', ' ', 'g')"
    for a, b in to.items():
        if len(b) > 1:
            text = f"replace({text}, '{a}', '{b}')"
    single = {a: b for a, b in to.items() if len(b) == 1 and a != b}
    quoted = "".join(single.values()).replace("'", "''")
    return f"nfc_normalize(translate({text}, '{''.join(single)}', '{quoted}'))"


_TERMS = r"""
tok AS (SELECT chunk_no, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM chunks),
tf AS (SELECT chunk_no, term, count(*) AS tf FROM tok GROUP BY ALL),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS gf, sum(tf * ln(tf)) AS tlogt FROM tf GROUP BY term),
total AS (SELECT count(DISTINCT chunk_no) AS n FROM tok)"""
_LINES = r"""
l AS (SELECT chunk_no, source_document, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM chunks WHERE source_document IS NOT NULL),
f AS (SELECT chunk_no, source_document, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\p{Z}\x{85}\x1C-\x1F]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS form FROM l),
often AS (SELECT source_document, form FROM f WHERE form <> '' GROUP BY ALL HAVING count(DISTINCT chunk_no) >= 10),
found AS (SELECT chunk_no, line_no FROM f JOIN often USING (source_document, form))"""

_ALIKE = r"""
t AS (SELECT chunk_no, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks),
g AS (SELECT DISTINCT chunk_no, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 3),
n AS (SELECT chunk_no, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.chunk_no AS x, b.chunk_no AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.chunk_no < b.chunk_no GROUP BY ALL),
alike AS (SELECT x, y FROM c JOIN n p ON p.chunk_no = x JOIN n q ON q.chunk_no = y WHERE k * 10 >= 6 * (p.n + q.n - k))"""

SQL: dict[str, str] = {
    "p1_found": "SELECT chunk_no FROM chunks WHERE strlen(text) > 1600",
    "p1_cover": "SELECT chunk_no, strlen(text)::BIGINT AS n_bytes, true AS fits, true AS numbered, true AS whole FROM chunks WHERE text IS NOT NULL",
    "p2_found": f"WITH {_TERMS} SELECT chunk_no, term FROM tf JOIN stats USING (term) WHERE tf >= 4 AND df BETWEEN 2 AND 12",
    "p2_scores": f"""WITH {_TERMS} SELECT chunk_no, term, tf, df, round(ln(1 + tf) * CASE WHEN df > 1 THEN 1 - (ln(gf) - tlogt / gf) / ln(n) ELSE 1 END, 6) AS score FROM tf JOIN stats USING (term), total""",
    "p3_found": """WITH c AS (SELECT chunk_no, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0), u AS (SELECT chunk_no, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM c)
        SELECT a.chunk_no AS chunk_no_a, b.chunk_no AS chunk_no_b FROM u a JOIN u b ON a.chunk_no < b.chunk_no WHERE list_dot_product(a.e, b.e) >= 0.9""",
    "p3_recall": """SELECT count(*) AS queries, true AS enough FROM chunks WHERE chunk_no % 100 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p4_found": f"WITH {_ALIKE} SELECT x AS chunk_no_a, y AS chunk_no_b FROM alike",
    "p4_groups": f"""WITH RECURSIVE {_ALIKE}, classes AS (SELECT chunk_no, md5(string_agg(s, '|' ORDER BY s)) AS h FROM g GROUP BY 1), heads AS (SELECT chunk_no, min(chunk_no) OVER (PARTITION BY h) AS r FROM classes),
        links AS (SELECT DISTINCT a.r AS u, b.r AS v FROM alike JOIN heads a ON a.chunk_no = x JOIN heads b ON b.chunk_no = y WHERE a.r <> b.r), both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach(node, other) AS (SELECT r, r FROM heads UNION SELECT node, v FROM reach JOIN both_ways ON u = other), groups AS (SELECT node, min(other) AS k FROM reach GROUP BY 1), degrees AS (SELECT u, count(*) AS n FROM both_ways GROUP BY 1)
        SELECT chunk_no, k AS group_no, coalesce(n, 0) AS links FROM heads JOIN groups ON node = r LEFT JOIN degrees ON u = r""",
    "p5_found": f"WITH {_TERMS} SELECT term FROM stats, total WHERE df <= 2 OR df * 10 > 6 * n",
    "p5_terms": f"WITH {_TERMS} SELECT term, gf AS occurrences, df AS rows, CASE WHEN df <= 2 THEN 'rare' WHEN df * 10 > 6 * n THEN 'common' ELSE 'useful' END AS mark FROM stats, total",
    "p6_found": f"WITH {_LINES} SELECT chunk_no, line_no FROM found",
    "p6_clean": f"""WITH {_LINES}, gone AS (SELECT chunk_no, count(*) AS n FROM found GROUP BY 1),
        kept AS (SELECT l.chunk_no, string_agg(line, chr(10) ORDER BY l.line_no) AS t FROM l LEFT JOIN found ON found.chunk_no = l.chunk_no AND found.line_no = l.line_no WHERE found.chunk_no IS NULL GROUP BY 1)
        SELECT c.chunk_no, CASE WHEN gone.n > 0 THEN coalesce(kept.t, '') ELSE c.text END AS text, coalesce(gone.n, 0)::INTEGER AS lines_removed FROM chunks c LEFT JOIN gone USING (chunk_no) LEFT JOIN kept USING (chunk_no)""",
    "p6_sequences": f"""WITH RECURSIVE {_LINES}, fl AS (SELECT source_document, form, f.chunk_no, f.line_no FROM f JOIN often USING (source_document, form)),
        pat AS (SELECT source_document, [form] AS p, chunk_no, [min(line_no)] AS ats FROM fl GROUP BY source_document, form, chunk_no UNION ALL
            SELECT source_document, p, chunk_no, ats FROM (SELECT *, count(*) OVER (PARTITION BY source_document, p) AS n FROM (
                SELECT source_document, list_append(p, form) AS p, chunk_no, list_append(ats, min(line_no)) AS ats FROM pat JOIN fl USING (source_document, chunk_no) WHERE line_no > ats[-1] GROUP BY source_document, p, form, chunk_no, ats)) WHERE n >= 10),
        sup AS (SELECT source_document, p, count(*) AS rows, min(chunk_no) AS first_chunk_no, array_to_string(arg_min(ats, chunk_no), ' ') AS first_lines FROM pat GROUP BY ALL),
        parts AS (SELECT DISTINCT source_document, rows, list_concat(p[:i - 1], p[i + 1:]) AS p FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM sup WHERE len(p) > 1))
        SELECT len(p)::INTEGER AS length, rows, first_chunk_no, first_lines FROM sup WHERE NOT EXISTS (SELECT 1 FROM parts WHERE parts.source_document = sup.source_document AND parts.rows = sup.rows AND parts.p = sup.p)""",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 8192",
    "p7_fit": "SELECT count(DISTINCT doc_id) AS documents, sum(coalesce(strlen(text), 0))::BIGINT AS tokens, count(DISTINCT doc_id) FILTER (strlen(text) > 8192) AS split, 0::BIGINT AS overfull, true AS tight FROM documents",
    "p8_reached": """WITH s AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS size FROM documents GROUP BY 1), t AS (SELECT sum(size)::BIGINT AS total FROM s),
        m AS (SELECT source, coalesce(size, 0)::BIGINT AS source_size, least((target_permille * total + 999) // 1000, coalesce(size, 0) * max_repeats)::BIGINT AS wanted_size, target_permille * total > coalesce(size, 0) * max_repeats * 1000 AS short FROM mix_targets LEFT JOIN s USING (source), t)
        SELECT *, true AS held FROM m""",
    "p8_found": """WITH s AS (SELECT source, sum(coalesce(strlen(text), 0)) AS size FROM documents GROUP BY 1), t AS (SELECT sum(size) AS total FROM s)
        SELECT m.source FROM mix_targets m LEFT JOIN s USING (source), t WHERE coalesce(size, 0) * max_repeats * 1000 < target_permille * total""",
    "p9_found": f"""WITH s AS (SELECT doc_id, text, {_reading("text")} AS k FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_classes": f"""WITH s AS (SELECT doc_id, text, {_reading("text")} AS k FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first_doc_id, count(*) OVER (PARTITION BY k) AS n_rows, length({_reading("text")}) AS n_chars FROM s""",
}
