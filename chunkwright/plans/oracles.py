"""The catalog's queries in DuckDB's SQL."""

from __future__ import annotations

from pyspark import SparkContext

from chunkwright.operators import stopwords

_USABLE = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter({v}, lambda x: x <> 0)) > 0"
_VECTORS = f"""
c AS (SELECT chunk_no, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunks WHERE {_USABLE.format(v="embedding")}),
q AS (SELECT query_id, list_transform(vec, lambda x: x::DOUBLE) AS e FROM queries WHERE {_USABLE.format(v="vec")}),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM (
    SELECT query_id, chunk_no, round(list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(c.e, c.e)), 6) AS score FROM q, c))"""

_TF = r"""
tok AS (SELECT chunk_no, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM chunks),
tf AS (SELECT *, (sum(tf) OVER (PARTITION BY chunk_no))::BIGINT AS length FROM (SELECT chunk_no, term, count(*) AS tf FROM tok GROUP BY chunk_no, term)),
stats AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
corpus AS (SELECT count(DISTINCT chunk_no) AS n, count(*) AS total, CASE WHEN count(*) > 0 THEN count(*) / count(DISTINCT chunk_no) ELSE 1.0 END AS average FROM tok),
qtok AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM queries),
qtf AS (SELECT *, (sum(tf) OVER (PARTITION BY query_id))::BIGINT AS length FROM (SELECT query_id, term, count(*) AS tf FROM qtok GROUP BY query_id, term))"""


def _sat(tf: str, length: str, average: str) -> str:
    return f"({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / {average})))"


def _sparse(query: str, average: str) -> str:
    return f"""
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM (
    SELECT query_id, chunk_no, round(sum({query} * {_sat("tf.tf", "tf.length", average)}), 6) AS score
    FROM qtf JOIN tf USING (term) JOIN stats USING (term), corpus GROUP BY query_id, chunk_no))"""


_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
_LIVE = _sparse(f"{_IDF} * {_sat('qtf.tf', 'qtf.length', '400.0::DOUBLE')}", "400.0::DOUBLE")
_RRF = """
lists AS (SELECT query_id, chunk_no, rank FROM dense WHERE rank <= {nd} UNION ALL SELECT query_id, chunk_no, rank FROM sparse WHERE rank <= {ns}),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM (
    SELECT query_id, chunk_no, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM lists GROUP BY ALL))"""

_ETEXT = r"""(CASE WHEN coalesce(source_document, '') <> '' THEN 'Document: ' || source_document || chr(10) ELSE '' END
    || CASE WHEN coalesce(section_path, '') <> '' THEN 'Section: ' || section_path || chr(10) WHEN coalesce(section, '') <> '' THEN 'Section: ' || section || chr(10) ELSE '' END
    || CASE WHEN coalesce(source_document, '') <> '' OR coalesce(section_path, '') <> '' OR coalesce(section, '') <> '' THEN chr(10) ELSE '' END || coalesce(text, ''))"""
_ENTRY = r"""('[Source: ' || coalesce(source_document, '') || CASE WHEN coalesce(section_path, '') <> '' AND section_path IS DISTINCT FROM source_document THEN ', Section: ' || section_path
    WHEN coalesce(section, '') <> '' AND section IS DISTINCT FROM source_document THEN ', Section: ' || section ELSE '' END
    || ', Pages: ' || start_page || '-' || end_page || ']' || chr(10) || coalesce(text, '') || chr(10) || chr(10))"""
_OVERLAP = r"""CASE WHEN len(list_distinct(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}]+'))) > 0 THEN
    round(len(list_intersect(list_distinct(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')))) * 10.0::DOUBLE
    / len(list_distinct(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}]+'))), 6) ELSE 0.0::DOUBLE END"""

_SEARCH = f"""WITH {_VECTORS}, {_TF}, {_LIVE}, {_RRF.format(nd=28, ns=12)},
hits AS (SELECT query_id, chunk_no, rank, source_document, section_path, chunk_index, chunk_total FROM fused JOIN chunks USING (chunk_no) WHERE rank <= 10),
places AS (SELECT query_id, source_document, section_path, chunk_index + step AS chunk_index, min(rank) AS rank FROM hits, (VALUES (-1), (1)) s(step)
    WHERE chunk_index + step >= 0 AND chunk_index + step < chunk_total GROUP BY ALL),
fresh AS (SELECT p.* FROM places p WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = p.query_id AND h.source_document IS NOT DISTINCT FROM p.source_document AND h.section_path IS NOT DISTINCT FROM p.section_path AND h.chunk_index IS NOT DISTINCT FROM p.chunk_index)),
wide AS (SELECT query_id, chunk_no, rank, 0 AS late FROM hits UNION ALL SELECT f.query_id, c.chunk_no, f.rank, 1 FROM fresh f JOIN chunks c ON c.source_document = f.source_document AND c.section_path = f.section_path AND c.chunk_index = f.chunk_index),
ordered AS (SELECT query_id, chunk_no, row_number() OVER (PARTITION BY query_id ORDER BY late, rank, chunk_no) AS original_rank FROM wide),
scored AS (SELECT o.query_id, o.chunk_no, o.original_rank, {_OVERLAP.format(q="q.text", t=_ETEXT.replace("text,", "ch.text,"))} AS relevance_score FROM ordered o JOIN chunks ch USING (chunk_no) JOIN queries q USING (query_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, original_rank) AS new_rank FROM scored) WHERE new_rank <= 5)"""

_SCORED = "scored AS (SELECT DISTINCT * FROM reranked), s AS (SELECT query_id, id, relevance_score, original_rank FROM scored)"
_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan(relevance_score) THEN '-inf'::DOUBLE ELSE coalesce(relevance_score, '-inf'::DOUBLE) END DESC, original_rank)"

_HITS = """
one AS (SELECT source_document, section_path, chunk_index, min(chunk_no) AS chunk_no, max(chunk_total) AS chunk_total FROM chunks GROUP BY ALL),
hits AS (SELECT query_id, source_document, section_path, chunk_index, rank, chunk_no, chunk_total FROM (
    SELECT query_id, source_document, section_path, chunk_index, min(new_rank) AS rank FROM reranked GROUP BY ALL) JOIN one USING (source_document, section_path, chunk_index))"""


def _places(n: int) -> str:
    steps = ", ".join(f"({i})" for i in range(-n, n + 1) if i)
    return f"""
moved AS (SELECT query_id, source_document, section_path, (chunk_index + step)::INTEGER AS chunk_index, min(rank) AS rank FROM hits, (VALUES {steps}) s(step)
    WHERE chunk_index + step >= 0 AND chunk_index + step < chunk_total GROUP BY ALL),
places AS (SELECT m.* FROM moved m WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = m.query_id AND h.source_document = m.source_document AND h.section_path = m.section_path AND h.chunk_index = m.chunk_index))"""


_WORDS = """
ls AS (SELECT doc_id::VARCHAR AS document, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
ws AS (SELECT document, line, unnest(string_split(l, ' ')) AS text, unnest(range(len(string_split(l, ' ')))) AS place FROM ls),
tops AS (SELECT *, 800.0::DOUBLE - (line % 40) * CASE WHEN line % 7 = 0 THEN 18 ELSE 17 END AS top FROM ws WHERE text <> ''),
words AS (SELECT document, line * 100000 + place AS ord, (line // 40 + 1)::INTEGER AS page, text, CASE WHEN line = 0 THEN 18.0 WHEN line % 10 = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS font_size,
    line % 10 = 0 AND line > 0 AS is_bold, top, top - 12 AS bottom FROM tops)"""
_BODY = """
sizes AS (SELECT document, round_even(font_size, 1) AS size, count(*) AS n, min(ord) AS first FROM words GROUP BY ALL),
body AS (SELECT document, arg_min(size, {'a': -n, 'b': first}) AS body_size FROM sizes GROUP BY document)"""
_HEADS = """
large AS (SELECT document, list_sort(list_distinct(list(round_even(font_size, 1))), 'DESC') AS sizes FROM words JOIN body USING (document) WHERE font_size > body_size * 1.1 GROUP BY document),
known AS (SELECT document, body_size, coalesce(sizes, []::DOUBLE[]) AS sizes FROM body LEFT JOIN large USING (document)),
leveled AS (SELECT w.*, CASE WHEN list_position(sizes, round_even(font_size, 1)) > 0 THEN list_position(sizes, round_even(font_size, 1))
    WHEN is_bold AND font_size >= body_size THEN len(sizes) + 1 ELSE 0 END::INTEGER AS heading_level FROM words w JOIN known USING (document))"""


def _breaks(source: str, part: str) -> str:
    return f"""
prev AS (SELECT *, lag(top) OVER w AS pt, lag(bottom) OVER w AS pb, lag(text) OVER w AS px FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY ord)),
high AS (SELECT *, CASE WHEN (abs(top - bottom) + abs(pt - pb)) / 2 < 1 THEN 10.0::DOUBLE ELSE (abs(top - bottom) + abs(pt - pb)) / 2 END AS h FROM prev),
parted AS (SELECT *, CASE WHEN px IS NULL THEN NULL WHEN NOT (abs(pb - bottom) < h * 0.3 AND abs(pt - top) < h * 0.3) AND (pb - top > h * 1.5 OR (pb - top > h * 0.3
    AND (regexp_matches(rtrim(px), '[.?!:;]$') OR regexp_matches(rtrim(px), '^[0-9].*[.)]$')))) THEN chr(10) ELSE ' ' END AS separator FROM high)"""


_TITLES = r"""
once AS (SELECT DISTINCT document, ord, title, level, page, parent_titles FROM bookmarks),
named AS (SELECT document, ord, trim(title) AS title, level, coalesce(page, 1) AS page, list_append(coalesce(parent_titles, []), trim(title)) AS path FROM once)"""
_PAGES = r"""
titled AS (SELECT *, string_split(heading_path, ' > ')[-1] AS title FROM sections),
shown AS (SELECT document, section_ord, CASE WHEN section_ord % 3 = 2 THEN replace(title, ' ', ' - ') ELSE title END AS heading, unnest(page_texts) AS p, unnest(range(len(page_texts))) AS i FROM titled),
paged AS (SELECT document, p.page_number AS page, string_agg(concat_ws(chr(10), CASE WHEN i = 0 THEN heading END, p.text), chr(10) ORDER BY section_ord, i) AS t FROM shown GROUP BY ALL),
pages AS (SELECT document, page, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s FROM paged)"""
_PIECES = r"[\s\p{Z}]*(?:[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{Z}\p{L}\p{N}]+)|[\s\p{Z}]+"
_SECTION_TOKENS = f"""
joined AS (SELECT *, array_to_string(list_transform(page_texts, lambda p: coalesce(p.text, '')), ' ') AS t FROM sections),
counted AS (SELECT *, len(regexp_extract_all(t, '{_PIECES}'))::INTEGER AS n_tokens, list_filter(list_transform(page_texts, lambda p: p.page_number), lambda n: n IS NOT NULL) AS ns FROM joined WHERE regexp_matches(t, '[^\\s\\p{{Z}}\\x1C-\\x1F]'))"""
_FLAT = """
flat AS (SELECT document, row_number() OVER (PARTITION BY document ORDER BY page, level, ord, title) - 1 AS ord, title, array_to_string(path, ' > ') AS full_title, level, page FROM kept)"""


def _stop_words() -> dict[str, str]:
    if SparkContext._active_spark_context is None:
        return {}
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    pairs = ", ".join(f"('{code}', {quoted(w)})" for code in stopwords.LANGUAGES for w in stopwords.words(code))
    rows = lambda name, ws: f"SELECT '{name}' AS list, unnest(range({len(ws)}))::INTEGER AS at, unnest([{', '.join(quoted(w) for w in ws)}]) AS word"
    en = stopwords.words("en")
    heads = {code: stopwords.words(code)[:5] for code in ("en", "de", "fr")}
    return {
        "stopword_filter": rf"""WITH stop(lang, word) AS (VALUES {pairs}), t AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents)
            SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM t WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop.lang = t.lang AND stop.word = t.term) GROUP BY doc_id""",
        "stopword_algebra": " UNION ALL ".join([
            rows("english", en), rows("extended", list(dict.fromkeys(en + stopwords.EXTENDED))), rows("combined", list(dict.fromkeys(heads["en"] + heads["de"] + heads["fr"]))),
            rows("excluded", [w for w in en if w.lower() not in ("the", "and", "is")]), rows("more", ["word1", "word2", "word3"])]),
    }


def sql() -> dict[str, str]:
    ids = "row_number() OVER (PARTITION BY id ORDER BY chunk_no DESC)"
    meta = lambda k, d: f"coalesce(metadata['{k}'], '{d}')"
    budgets = "\n".join(["WITH k(k) AS (VALUES (1), (3), (5), (10), (20), (50)), w(w) AS (VALUES (0.0), (0.25), (0.5), (0.6), (0.7), (0.9), (1.0)), f AS (SELECT k, w, w::FLOAT AS d, (1::FLOAT - w::FLOAT)::FLOAT AS s FROM k, w)",
        "SELECT k, w::DOUBLE AS dense_weight, greatest(k, trunc(((k * 4)::FLOAT * d)::FLOAT / (d + s)::FLOAT))::INTEGER AS n_dense, greatest(k, trunc(((k * 4)::FLOAT * s)::FLOAT / (d + s)::FLOAT))::INTEGER AS n_sparse FROM f"])
    return _stop_words() | {
        "dense_topk": f"WITH {_VECTORS} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM dense WHERE rank <= 10",
        "l2_normalize": f"WITH {_VECTORS}, n AS (SELECT chunk_no, e, sqrt(list_dot_product(e, e)) AS m FROM c) SELECT chunk_no, round(e[1] / m, 5) AS first, round(e[64] / m, 5) AS last, 1.0::DOUBLE AS norm FROM n",
        "cosine_to_next": f"WITH {_VECTORS} SELECT a.chunk_no, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 5) AS cosine, round(list_dot_product(a.e, b.e), 4) AS dot FROM c a JOIN c b ON b.chunk_no = a.chunk_no + 1",
        "tokenize_counts": r"SELECT chunk_no, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, strlen(text)::BIGINT AS n_bytes FROM (SELECT chunk_no, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM chunks WHERE text IS NOT NULL)",
        "term_frequency": f"WITH {_TF} SELECT chunk_no, term, tf, length FROM tf",
        "document_frequency": f"WITH {_TF} SELECT term, df FROM stats",
        "merged_document_frequency": f"WITH {_TF} SELECT term, df FROM stats",
        "corpus_stats": f"WITH {_TF} SELECT n AS total_docs, total AS total_len, round(average, 6) AS average_len FROM corpus",
        "unique_terms": f"WITH {_TF} SELECT count(*) AS n_terms FROM stats",
        "term_index_md5": r"SELECT term, ('0x' || substr(md5(term), 1, 8))::BIGINT AS index FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)",
        "bm25_weights": f"WITH {_TF} SELECT chunk_no, term, round({_IDF} * {_sat('tf', 'length', 'average')}, 6) AS weight FROM tf JOIN stats USING (term), corpus",
        "tf_only_weights": f"WITH {_TF} SELECT chunk_no, term, round({_sat('tf', 'length', '400.0::DOUBLE')}, 6) AS weight FROM tf",
        "sparse_vectors": f"""WITH {_TF}, v AS (SELECT chunk_no, ('0x' || substr(md5(term), 1, 8))::BIGINT AS i, sum({_sat('tf', 'length', '400.0::DOUBLE')})::FLOAT AS w FROM tf GROUP BY ALL)
            SELECT chunk_no, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices, round(sum(w::DOUBLE ORDER BY i), 3) AS total FROM v GROUP BY chunk_no""",
        "bm25_topk": f"WITH {_TF}, {_sparse(_IDF, 'average')} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM sparse WHERE rank <= 20",
        "bm25_scores": f"""WITH {_TF}, s AS (SELECT query_id, chunk_no, sum({_IDF} * {_sat("tf.tf", "tf.length", "average")}) AS score FROM qtf JOIN tf USING (term) JOIN stats USING (term), corpus GROUP BY ALL)
            SELECT query_id, count(*) AS n_chunks, round(max(score), 6) AS best, round(sum(score), 3) AS total FROM s GROUP BY query_id""",
        "stored_bm25_topk": f"WITH {_TF}, {_sparse(_IDF, 'average')} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM sparse WHERE rank <= 20",
        "stored_bm25_live_idf": f"WITH {_TF}, {_LIVE} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM sparse WHERE rank <= 20",
        "stored_bm25_frozen": f"WITH {_TF}, {_sparse(_IDF + ' * ' + _IDF + ' * ' + _sat('qtf.tf', 'qtf.length', 'average'), 'average')} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM sparse WHERE rank <= 20",
        "bm25_topk_live_idf": f"WITH {_TF}, {_LIVE} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM sparse WHERE rank <= 20",
        "bm25_topk_idf_squared": f"WITH {_TF}, {_sparse(_IDF + ' * ' + _IDF + ' * ' + _sat('qtf.tf', 'qtf.length', 'average'), 'average')} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM sparse WHERE rank <= 20",
        "prefetch_budgets": budgets,
        "hybrid_rrf_topk": f"WITH {_VECTORS}, {_TF}, {_LIVE}, {_RRF.format(nd=28, ns=12)} SELECT query_id, chunk_no, score, rank::INTEGER AS rank FROM fused WHERE rank <= 10",
        "adjacent_places": f"WITH {_HITS}, {_places(2)} SELECT query_id, source_document, section_path, chunk_index, rank FROM places",
        "adjacent_expand": f"""WITH {_HITS}, {_places(1)}, wide AS (SELECT query_id, chunk_no, rank, true AS is_hit FROM hits UNION ALL
            SELECT p.query_id, c.chunk_no, p.rank, false FROM places p JOIN chunks c USING (source_document, section_path, chunk_index))
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY is_hit DESC, rank, chunk_no))::INTEGER AS ord FROM wide""",
        "adjacent_none": f"WITH {_HITS} SELECT query_id, chunk_no, rank, true AS is_hit, (row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_no))::INTEGER AS ord FROM hits",
        "get_chunks_by_indices": "SELECT chunk_no, section_path, chunk_index FROM chunks WHERE source_document = 'Corvane Platform Reference.pdf' AND chunk_index IN (0, 2, 5)",
        "embedding_text": f"SELECT chunk_no, {_ETEXT} AS embedding_text FROM chunks",
        "context_block": f"""WITH b AS (SELECT DISTINCT * FROM reranked), newest AS (SELECT * FROM (SELECT *, {ids} AS n FROM chunks) WHERE n = 1),
            told AS (SELECT b.query_id, string_agg(e, '' ORDER BY new_rank, e) AS t FROM (SELECT query_id, id, new_rank FROM b WHERE new_rank <= 5) b JOIN (SELECT id, {_ENTRY} AS e FROM newest) USING (id) GROUP BY 1)
            SELECT query_id, CASE WHEN t IS NULL THEN 'No relevant information found.' ELSE 'Context from documents:' || chr(10) || chr(10) || t END AS context FROM queries LEFT JOIN told USING (query_id)""",
        "blank_pruning": r"SELECT chunk_no, text IS NULL AS is_null FROM chunks WHERE text IS NULL OR NOT regexp_matches(text, '[^\s\p{Z}\x1C-\x1F]')",
        "section_text": r"""WITH t AS (SELECT section_no, list_filter(page_texts, lambda p: p.text IS NOT NULL AND regexp_matches(p.text, '[^\s\p{Z}\x1C-\x1F]')) AS p FROM sections)
            SELECT section_no, array_to_string(list_transform(p, lambda x: x.text), ' ') AS text FROM t WHERE len(p) > 0""",
        "section_pages": "WITH t AS (SELECT section_no, list_transform(page_texts, lambda p: p.page_number) AS p FROM sections WHERE len(page_texts) > 0) SELECT section_no, list_min(p) AS first_page, list_max(p) AS last_page, array_to_string(list_sort(p), ',') AS pages FROM t",
        "metadata_values": f"SELECT chunk_no, {meta('ChunkType', 'none')} AS chunk_type, {meta('BookmarkLevel', '0')}::INTEGER AS bookmark_level, {meta('Pages', '')} AS pages FROM chunks",
        "payload_round_trip": """SELECT concat_ws('#', id, chunk_no) AS id, source_document, start_page, end_page, chunk_index, chunk_total, coalesce(section, '') AS section, coalesce(section_path, '') AS section_path,
            length(coalesce(text, '')) AS n_chars, coalesce(cardinality(metadata), 0)::BIGINT AS n_metadata FROM chunks""",
        "rerank_topk": f"WITH {_SCORED}, r AS (SELECT *, {_RANKED} AS new_rank FROM s) SELECT query_id, id, relevance_score, original_rank, new_rank::INTEGER AS new_rank FROM r WHERE new_rank <= 5",
        "rerank_threshold": f"WITH {_SCORED}, r AS (SELECT *, {_RANKED} AS new_rank FROM s WHERE relevance_score >= 5 AND NOT isnan(relevance_score)) SELECT query_id, id, relevance_score, original_rank, new_rank::INTEGER AS new_rank FROM r WHERE new_rank <= 5",
        "rerank_fallback": f"WITH {_SCORED} SELECT query_id, id, original_rank, round(5.0::DOUBLE - (original_rank - 1) * 0.1::DOUBLE, 6) AS relevance_score, original_rank AS new_rank FROM s WHERE original_rank <= 5",
        "rerank_overlap_topk": f"""WITH {_SCORED}, last AS (SELECT id, arg_max_null(text, chunk_no) AS t FROM chunks GROUP BY id),
            p AS (SELECT s.query_id, s.id, original_rank, {_OVERLAP.format(q="q.text", t="coalesce(t, '')")} AS relevance_score FROM s JOIN last USING (id) JOIN queries q USING (query_id)),
            r AS (SELECT *, {_RANKED} AS new_rank FROM p) SELECT query_id, id, original_rank, relevance_score, new_rank::INTEGER AS new_rank FROM r WHERE new_rank <= 5""",
        "sigmoid_scores": f"WITH {_SCORED} SELECT query_id, id, original_rank, round(10 / (1 + exp(5 - relevance_score)), 6) AS score, round(1 / (1 + exp(5 - relevance_score)), 6) AS yes FROM s WHERE relevance_score IS NOT NULL",
        "llm_score_parse": f"""WITH {_SCORED}, n AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY original_rank, round(relevance_score, 1)) - 1 AS position, round(relevance_score, 1) AS score FROM s WHERE relevance_score IS NOT NULL)
            SELECT query_id, position::INTEGER AS position, CASE WHEN query_id % 4 IN (0, 1) THEN score ELSE 5.0 END::DOUBLE AS score FROM n""",
        "judge_rerank": """WITH c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY original_rank, id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT DISTINCT query_id, id, original_rank FROM reranked)),
            s AS (SELECT *, CASE WHEN n % 5 = 0 THEN round(5.0::DOUBLE - (r - 1) * 0.1::DOUBLE, 6) WHEN n % 7 = 0 THEN 5.0::DOUBLE WHEN r = 4 THEN NULL ELSE ((7 * (r - 1) + n) % 11)::DOUBLE END AS relevance_score FROM c),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, r) AS new_rank FROM s WHERE n % 5 = 0 OR relevance_score >= 5)
            SELECT query_id, id, r::INTEGER AS original_rank, relevance_score, new_rank::INTEGER AS new_rank FROM k WHERE new_rank <= 5""",
        "store_upsert": f"""WITH e AS (SELECT id, source_document, text FROM (SELECT *, {ids} AS n FROM chunks WHERE chunk_no % 2 = 0) WHERE n = 1), o AS (SELECT id, source_document, text FROM (SELECT *, {ids} AS n FROM chunks WHERE chunk_no % 2 = 1) WHERE n = 1)
            SELECT id, source_document, length(text) AS n_chars FROM (SELECT * FROM o UNION ALL SELECT * FROM e WHERE id NOT IN (SELECT id FROM o))""",
        "store_append": f"""WITH e AS (SELECT source_document, text FROM (SELECT *, {ids} AS n FROM chunks WHERE chunk_no % 2 = 0) WHERE n = 1)
            SELECT source_document, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM (SELECT * FROM e UNION ALL SELECT source_document, text FROM chunks WHERE chunk_no % 2 = 1) GROUP BY 1""",
        "store_clear": "SELECT source_document, count(*) AS n_chunks FROM chunks WHERE source_document = 'Corvane Platform Reference.pdf' GROUP BY 1",
        "upsert_by_id": f"""WITH e AS (SELECT id, chunk_no, text FROM (SELECT *, {ids} AS n FROM chunks WHERE chunk_no % 2 = 0) WHERE n = 1), o AS (SELECT id, chunk_no, text FROM (SELECT *, {ids} AS n FROM chunks WHERE chunk_no % 2 = 1) WHERE n = 1)
            SELECT id, chunk_no, length(text) AS n_chars FROM (SELECT * FROM o UNION ALL SELECT * FROM e WHERE id NOT IN (SELECT id FROM o))""",
        "delete_document": r"""SELECT source_document, count(*) AS n_chunks, count(DISTINCT chunk_no) AS n_ids, count(*) FILTER (n > 0) AS n_with_terms, sum(n)::BIGINT AS n_terms
            FROM (SELECT source_document, chunk_no, coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 0) AS n FROM chunks WHERE source_document IS DISTINCT FROM 'Corvane Platform Reference.pdf') GROUP BY 1""",
        "chunks_by_document": """SELECT source_document, strategy, page_count, n_chunks, n_sections, first_page, last_page FROM source_files LEFT JOIN (
            SELECT source_document, count(*) AS n_chunks, count(DISTINCT section_path) AS n_sections, min(start_page) AS first_page, max(end_page) AS last_page FROM chunks GROUP BY 1) USING (source_document)""",
        "body_font_mode": f"WITH {_WORDS}, {_BODY} SELECT document, body_size FROM body",
        "font_sizes": f"WITH {_WORDS} SELECT document, round(avg(font_size), 6) AS average, max(font_size) AS largest, min(font_size) AS smallest FROM words GROUP BY document",
        "heading_sizes": f"WITH {_WORDS}, {_BODY}, {_HEADS} SELECT document, body_size, array_to_string(list_transform(sizes, lambda s: printf('%.1f', s)), ',') AS sizes FROM known",
        "heading_levels": f"WITH {_WORDS}, {_BODY}, {_HEADS} SELECT document, heading_level, count(*) AS n_words FROM leveled GROUP BY ALL",
        "heading_levels_limited": f"""WITH {_WORDS}, {_BODY}, large AS (SELECT document, list_sort(list_distinct(list(round_even(font_size, 1))), 'DESC') AS sizes FROM words JOIN body USING (document) WHERE font_size > body_size * 1.1 AND font_size <= 15 AND ord % 3 <> 0 GROUP BY document),
            known AS (SELECT document, body_size, coalesce(sizes, []::DOUBLE[]) AS sizes FROM body LEFT JOIN large USING (document)),
            leveled AS (SELECT w.document, CASE WHEN font_size > 15 OR ord % 3 = 0 THEN 0 WHEN list_position(sizes, round_even(font_size, 1)) > 0 THEN list_position(sizes, round_even(font_size, 1)) WHEN is_bold AND font_size >= body_size THEN len(sizes) + 1 ELSE 0 END::INTEGER AS heading_level FROM words w JOIN known USING (document))
            SELECT document, heading_level, count(*) AS n_words FROM leveled GROUP BY ALL""",
        "line_breaks": f"WITH {_WORDS}, {_breaks('words', 'document, page')} SELECT document, page, count(*) FILTER (separator = chr(10)) AS n_breaks, count(*) FILTER (separator = ' ') AS n_spaces FROM parted GROUP BY ALL",
        "page_texts": f"WITH {_WORDS}, {_breaks('words', 'document, page')} SELECT document, page, string_agg(text, ' ' ORDER BY ord) AS text_spaced, string_agg(coalesce(separator, '') || text, '' ORDER BY ord) AS text_lines FROM parted GROUP BY ALL",
        "simple_sections": f"""WITH {_WORDS}, {_breaks('words', 'document, page')}, p AS (SELECT document, page, string_agg(coalesce(separator, '') || text, '' ORDER BY ord) AS t FROM parted WHERE page > 1 GROUP BY ALL)
            SELECT document, min(p.page)::INTEGER AS start_page, any_value(l.page)::INTEGER AS end_page, count(*) AS n_pages, string_agg(t, ' ' ORDER BY p.page) AS text FROM p JOIN (SELECT document, max(page) AS page FROM words GROUP BY 1) l USING (document) WHERE regexp_matches(t, '\\S') GROUP BY document""",
        "sections_by_format": f"""WITH {_WORDS}, {_BODY}, {_HEADS},
            flagged AS (SELECT *, heading_level BETWEEN 1 AND 2 AS headed FROM leveled),
            starts AS (SELECT *, (headed AND NOT coalesce(lag(headed) OVER w AND abs(font_size - lag(font_size) OVER w) < 0.5 AND page = lag(page) OVER w, false))::INTEGER AS new FROM flagged WINDOW w AS (PARTITION BY document ORDER BY ord)),
            m AS (SELECT *, (sum(new) OVER (PARTITION BY document ORDER BY ord))::INTEGER AS sid FROM starts),
            heads AS (SELECT document, sid, string_agg(text, ' ' ORDER BY ord) FILTER (headed) AS title, max(font_size) FILTER (new = 1) AS fs, coalesce(bool_or(is_bold) FILTER (new = 1), false) AS bold,
                coalesce(max(heading_level) FILTER (new = 1), 1) AS level, coalesce(max(page) FILTER (new = 1), 1) AS start_page, max(new) AS named FROM m GROUP BY ALL HAVING count(*) FILTER (NOT headed) > 0),
            up AS (SELECT *, max(CASE WHEN level = 1 AND named = 1 THEN sid END) OVER w AS a1, max(CASE WHEN level = 2 AND named = 1 THEN sid END) OVER w AS a2 FROM heads WINDOW w AS (PARTITION BY document ORDER BY sid)),
            paths AS (SELECT u.*, CASE WHEN u.named = 0 THEN '' WHEN u.level = 1 THEN u.title ELSE coalesce(p.title || ' > ', '') || u.title END AS path FROM up u LEFT JOIN heads p ON p.document = u.document AND p.sid = u.a1),
            bodies AS (SELECT * FROM m WHERE NOT headed), {_breaks('bodies', 'document, sid, page')},
            pages AS (SELECT document, sid, page, string_agg(coalesce(separator, '') || text, '' ORDER BY ord) AS t FROM parted GROUP BY ALL),
            texts AS (SELECT document, sid, max(page) AS end_page, string_agg(t, chr(12) ORDER BY page) AS text FROM pages GROUP BY ALL)
            SELECT document, sid AS section_ord, coalesce(title, '') AS heading, path AS heading_path, fs AS heading_font_size, bold AS heading_is_bold, level, start_page, end_page, text FROM paths JOIN texts USING (document, sid)""",
        "color_keys": """WITH n AS (SELECT section_no, section_no % 4 AS k, section_no::DOUBLE AS n FROM sections) SELECT section_no, CASE k WHEN 0 THEN printf('%.2f_%.2f_%.2f', n % 8 / 8, n % 4 / 4, n % 2 / 2)
            WHEN 1 THEN printf('gray_%.2f', n % 4 / 4) WHEN 2 THEN printf('cmyk_%.2f_%.2f_%.2f_%.2f', n % 2 / 2, n % 4 / 4, n % 8 / 8, n % 2 / 4) ELSE 'default' END AS color_key FROM n""",
        "font_styles": r"SELECT section_no, coalesce(regexp_matches(lower(heading), 'bold|heavy|black|demi'), false) AS bold, coalesce(regexp_matches(lower(heading), 'italic|oblique|slant'), false) AS italic, regexp_replace(regexp_replace(heading, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS heading FROM sections",
        "bookmark_paths": f"""WITH {_TITLES}, skipped AS (SELECT DISTINCT document, path AS p FROM named WHERE page <= 2),
            kept AS (SELECT n.* FROM named n WHERE level <= 3 AND page > 2 AND NOT EXISTS (SELECT 1 FROM skipped s WHERE s.document = n.document AND s.p = n.path[1:len(s.p)])), {_FLAT} SELECT document, ord, title, full_title, level, page FROM flat""",
        "next_bookmark": f"""WITH {_TITLES}, kept AS (SELECT * FROM named WHERE level <= 3), {_FLAT}
            SELECT document, ord, title, page, lead(title) OVER w AS next_title, lead(page) OVER w AS next_page FROM flat WINDOW w AS (PARTITION BY document ORDER BY ord)""",
        "literal_headings": f"""WITH {_TITLES}, kept AS (SELECT * FROM named WHERE level <= 3), {_FLAT}, {_PAGES},
            stands AS (SELECT f.*, s, instr(lower(s), lower(title)) - 1 AS start FROM flat f JOIN pages USING (document, page) WHERE length(title) > 0)
            SELECT document, ord, page AS start_page, start::INTEGER AS start, (start + length(title) + CASE WHEN substr(s, start + length(title) + 1, 1) = ' ' THEN 1 ELSE 0 END)::INTEGER AS content FROM stands WHERE start >= 0""",
        "whole_chunks": f"""WITH {_SECTION_TOKENS} SELECT concat_ws('_', coalesce(document, ''), 'bookmark', CASE WHEN coalesce(heading_path, '') = '' THEN 'nosection' ELSE ('0x' || substr(md5(heading_path), 1, 12))::BIGINT::VARCHAR END, 'chunk', '0') AS id,
            document AS source_document, section_ord, t AS text, coalesce(list_min(ns), start_page) AS start_page, coalesce(list_max(ns), end_page) AS end_page, 0 AS chunk_index, coalesce(heading, document) AS section,
            coalesce(heading_path, heading, document) AS section_path, array_to_string(list_sort(ns), ',') AS pages FROM counted WHERE n_tokens <= 400""",
        "cut_chunks": f"WITH {_SECTION_TOKENS} SELECT document AS source_document, section_ord, n_tokens, true AS bounded, true AS numbered, true AS begins, true AS ends, true AS covers FROM counted WHERE n_tokens > 400",
        "embedded_chunks": rf"SELECT chunk_no, CASE WHEN regexp_matches({_ETEXT}, '[\p{{L}}\p{{N}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM chunks",
        "stored_search_e2e": f"{_SEARCH} SELECT query_id, chunk_no, original_rank::INTEGER AS original_rank, relevance_score, new_rank::INTEGER AS new_rank FROM best",
        "search_documents_e2e": f"{_SEARCH} SELECT query_id, chunk_no, original_rank::INTEGER AS original_rank, relevance_score, new_rank::INTEGER AS new_rank FROM best",
        "search_contexts": f"""{_SEARCH}, told AS (SELECT query_id, string_agg(e, '' ORDER BY new_rank) AS t FROM best JOIN (SELECT chunk_no, {_ENTRY} AS e FROM chunks) USING (chunk_no) GROUP BY 1)
            SELECT query_id, CASE WHEN t IS NULL THEN 'No relevant information found.' ELSE 'Context from documents:' || chr(10) || chr(10) || t END AS context FROM queries LEFT JOIN told USING (query_id)""",
    }
