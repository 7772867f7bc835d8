"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

_Q = "q AS (SELECT * FROM (VALUES ('q1','licensed under the general public license'),('q2','all rights reserved the'),('q3','der die und von'),('q4','que la los en')) v(query_id, query))"
_SP = r" \t\r\x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _tok(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '[\n{_SP}]+'), lambda x: x <> '')"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[\n{_SP}]+|[\n{_SP}]+\z', '', 'g')"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


#: Counts, document frequencies and corpus statistics of documents.
_TF = f"w AS (SELECT doc_id, {_tok('text')} AS w FROM documents), d AS (SELECT doc_id AS chunk_id, len(w) AS dl, w FROM w WHERE len(w) > 0), e AS (SELECT chunk_id, dl, unnest(w) AS term FROM d), tf AS (SELECT chunk_id, term, dl, count(*) AS tf FROM e GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d)"
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"


def _bm25(k1="1.5", b="0.75") -> str:
    return f"{_IDF} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / greatest(avgdl, 1.0)))"


_TFIDF = "tf / dl * (ln((1.0 + n) / (1.0 + df)) + 1)"
_QT = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok('query')}) AS term FROM q) GROUP BY ALL)"


def _hits(weight: str, k: int, name: str = "hits") -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum({weight} * qtf), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY ALL)) WHERE rank <= {k})"


def _search(weight: str, k: int, q: str = _Q, name: str = "hits") -> str:
    return f"WITH {q}, {_TF}, {_QT}, {_hits(weight, k, name)}"


_V = "qv AS (SELECT 'q' || (vec_id + 1) AS query_id, embedding AS qvec, vec_id AS own FROM embeddings WHERE vec_id IN (0, 1, 2, 3))"
_COS = f"{_dot('embedding', 'qvec')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('qvec', 'qvec')}))"
_L2 = "0 - list_sum(list_transform(list_zip(embedding::DOUBLE[], qvec::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _near(k: int, metric: str = "", source: str = "embeddings", where: str = "true", name: str = "near", more: str = "") -> str:
    m = metric or _dot("embedding", "qvec")
    return f"{name} AS (SELECT * FROM (SELECT query_id, vec_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank{more} FROM (SELECT *, round({m}, 6) AS score FROM {source}, qv WHERE {where})) WHERE rank <= {k})"


def _dense(metric: str = "") -> str:
    return f"WITH {_V}, {_near(5, metric)} SELECT query_id, chunk_id, score, rank FROM near"


def _rrf(a: float, b: float, k_text: int = 20, k_dense: int = 20) -> str:
    legs = f"SELECT query_id, chunk_id, {a} / (60 + rank) AS x FROM hits UNION ALL SELECT query_id, chunk_id, {b} / (60 + rank) FROM near"
    return f"{_search(_bm25(), k_text)}, {_V}, {_near(k_dense)}, f AS (SELECT query_id, chunk_id, round(sum(x::DOUBLE), 6) AS score FROM ({legs}) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5"


_WT = "wt AS (SELECT vec_id, embedding, lang, text FROM embeddings JOIN documents ON doc_id = vec_id)"
_CHUNKS = r"win AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 512) / 462.0), 0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, i AS chunk_index, i * 462 AS start_index, least(i * 462 + 512, length(text)) AS end_index, substring(text, i * 462 + 1, 512) AS content FROM win), ch AS (SELECT * FROM c WHERE NOT regexp_matches(content, '\A[\n" + _SP + r"]*\z'))"
_REPLY = "r AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 13 AS n, text FROM conversations)"
_CAND = f"cand AS (SELECT h.*, query, text AS content FROM hits h JOIN q USING (query_id) JOIN documents ON doc_id = chunk_id)"
_GOLD = f"q AS (SELECT item_id::VARCHAR AS query_id, array_to_string({_words('text')}[1:12], ' ') AS query, text AS gold FROM benchmark)"
_REL = f"CASE WHEN len(gw) = 0 THEN false WHEN contains(lower(content), lower(gold)) THEN true ELSE len(list_filter(range(1, len(gw) - need + 2), lambda i: contains(flat, array_to_string(gw[i:i + need - 1], ' ')))) > 0 END"
_RANKED = f"g1 AS (SELECT query_id, gold, {_words('lower(gold)')} AS gw FROM q), g AS (SELECT *, ceil(len(gw) * 0.6 - 1e-9)::BIGINT AS need FROM g1), rk AS (SELECT query_id, chunk_id, rank, lang, {_REL} AS relevant FROM (SELECT h.*, gold, gw, need, lang, text AS content, array_to_string({_words('lower(text)')}, ' ') AS flat FROM hits h JOIN g USING (query_id) JOIN documents ON doc_id = chunk_id))"
_EVAL = "ev AS (SELECT q.query_id, CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_1, CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_3, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_5, coalesce(round(1.0::DOUBLE / first, 6), 0.0) AS mrr FROM q LEFT JOIN (SELECT query_id, min(rank) AS first FROM rk WHERE relevant GROUP BY 1) USING (query_id))"
_OVER = f"round(len(list_intersect(list_distinct({_tok('query')}), {_tok('substring(content, 1, 512)')})) / greatest(len(list_distinct({_tok('query')})), 1)::DOUBLE, 6)"
_STOP = "['is', 'the', 'a', 'an', 'how', 'what', 'does', 'do', 'and', 'or', 'of', 'in', 'to', 'for', 'it', 'with', 'where', 'when', 'who', 'which', 'are', 'was', 'were']"


def _entities(x: str) -> str:
    """The entities that the pages have; &amp; comes last, so that nothing is decoded twice."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _html() -> str:
    h = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "iframe"):
        h = rf"regexp_replace({h}, '(?is)<{tag}\b.*?</{tag}>', '', 'g')"
    part = "coalesce(" + ", ".join(rf"nullif(regexp_extract(h, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), '')" for tag in ("main", "article", "body")) + ", h)"
    return f"WITH x AS (SELECT page_id, {h} AS h FROM pages), y AS (SELECT page_id, {part} AS p FROM x) SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(p, '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda z: trim({_entities('z')})), lambda z: z <> ''), chr(10)) AS content FROM y"


_CLEAN = "'  ' || chr(8203) || replace(text, ' the ', '  the' || chr(9) || chr(1) || ' ') || ' e' || chr(769) || repeat(chr(10), 4) || '  x ' || chr(10) || ' '"
_TS = "CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END"
_CENT = "flat AS (SELECT label AS cell, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT cell, d, avg(x) AS x FROM flat GROUP BY ALL), cent AS (SELECT cell, list(x ORDER BY d) AS centroid FROM m GROUP BY cell)"

ORACLE: dict[str, str] = {
    "tokenize": f"WITH x AS (SELECT doc_id, {_tok('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, array_to_string(w[1:5], ' ') AS first_tokens FROM x",
    "tfidf_postings": f"WITH {_TF} SELECT term, chunk_id, tf, round({_TFIDF}, 6) AS weight FROM tf JOIN df USING (term), s",
    "bm25_postings": f"WITH {_TF} SELECT term, chunk_id, tf, round({_bm25()}, 6) AS weight FROM tf JOIN df USING (term), s",
    "tfidf_search": f"{_search(_TFIDF, 5)} SELECT * FROM hits",
    "bm25_search": f"{_search(_bm25(), 5)} SELECT * FROM hits",
    "tenant_bm25": f"WITH {_Q}, {_TF}, {_QT}, h AS (SELECT query_id, source, chunk_id, round(sum({_bm25()} * qtf), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN documents ON doc_id = chunk_id, s GROUP BY ALL) SELECT query_id || '/' || source AS query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank FROM h QUALIFY rank <= 5",
    "bm25_param_grid": f"WITH {_Q}, {_TF}, {_QT}, grid AS (SELECT k1, b FROM (VALUES (0.5::DOUBLE), (1.2), (1.5), (2.0)) a(k1), (VALUES (0.0::DOUBLE), (0.5), (0.75)) c(b)), h AS (SELECT k1, b, query_id, chunk_id, round(sum({_bm25('k1', 'b')} * qtf), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), s, grid GROUP BY ALL) SELECT k1, b, query_id, chunk_id, score FROM h QUALIFY row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, chunk_id) = 1",
    "index_stats": f"WITH {_TF} SELECT n AS n_docs, (SELECT count(*) FROM df) AS vocab, (SELECT count(*) FROM tf) AS postings, round(avgdl, 1) AS avgdl FROM s",
    "dense_topk": _dense(),
    "dense_cosine": _dense(_COS),
    "dense_l2": _dense(_L2),
    "tenant_topk": f"WITH {_V}, x AS (SELECT query_id, 't' || (vec_id % 3) AS tenant_id, vec_id AS chunk_id, round({_dot('embedding', 'qvec')}, 6) AS score FROM embeddings, qv) SELECT *, row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) AS rank FROM x QUALIFY rank <= 3",
    "vec_normalize": f"WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v * (label + 2)) AS v FROM embeddings), y AS (SELECT vec_id, v, sqrt({_dot('v', 'v')}) AS n FROM x) SELECT vec_id AS chunk_id, round(v[1] / n, 5) AS first, round(v[64] / n, 5) AS last FROM y",
    "vec_norm_audit": f"WITH x AS (SELECT abs(sqrt({_dot('embedding', 'embedding')}) - 1) AS d FROM embeddings) SELECT bool_and(d <= 1e-4) AS ok, round(max(d), 5) AS max_deviation, count(*) FILTER (d > 1e-4) AS outliers FROM x",
    "hybrid_rrf": _rrf(1.0, 1.0),
    "hybrid_rrf_weighted": _rrf(2.0, 0.5),
    "agentic_union": _rrf(1.0, 1.0, 3, 3),
    "filtered_post": f"WITH {_V}, {_WT}, {_near(25, source='wt', more=', lang')} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE lang IN ('en', 'de')) WHERE rank <= 5",
    "filtered_pre": f"WITH {_V}, {_WT}, {_near(5, source='wt', where=chr(108) + 'ang IN (' + repr('en') + ', ' + repr('de') + ')')} SELECT query_id, chunk_id, score, rank FROM near",
    "filtered_boost": f"WITH {_Q}, {_V}, {_WT}, {_near(15, source='wt', more=', lang, text')}, x AS (SELECT query_id, chunk_id, round(CASE WHEN lang IN ('en', 'de') THEN score * 2.0 ELSE score END + len(list_intersect(list_distinct({_words('lower(query)')}), {_words('lower(text)')})) / greatest(len(list_distinct({_words('lower(query)')})), 1)::DOUBLE * 0.3, 6) AS score FROM near JOIN q USING (query_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x QUALIFY rank <= 5",
    "metadata_filter": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'",
    "multi_query_rr": f"WITH {_V}, {_near(5, where='own < 3')}, x AS (SELECT 'q' AS query_id, chunk_id, round(sum(1.0::DOUBLE / rank), 6) AS score FROM near GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM x QUALIFY rank <= 5",
    "multi_hop_merge": f"WITH {_V}, {_near(3, more=', own')}, nxt AS (SELECT query_id, arg_min(chunk_id, rank) AS start FROM near WHERE chunk_id <> own GROUP BY 1), two AS (SELECT query_id, vec_id AS chunk_id, round({_dot('e.embedding', 's.embedding')}, 6) AS score FROM nxt JOIN embeddings s ON s.vec_id = start, (SELECT vec_id, embedding FROM embeddings) e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({_dot('e.embedding', 's.embedding')}, 6) DESC, e.vec_id) <= 3), u AS (SELECT query_id, chunk_id, score, 1 AS hop FROM near UNION ALL SELECT query_id, chunk_id, round(score * 0.7, 6), 2 FROM two), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, hop) = 1) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 5".replace("SELECT query_id, vec_id AS chunk_id, round(list_dot_product(e.", "SELECT query_id, e.vec_id AS chunk_id, round(list_dot_product(e."),
    "rerank_overlap": f"{_search(_bm25(), 10)}, {_CAND}, x AS (SELECT query_id, chunk_id, rank AS original_rank, {_OVER} AS rerank_score FROM cand) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) AS rank FROM x",
    "rerank_listwise": f"{_search(_bm25(), 5)}, x AS (SELECT query_id, chunk_id, rank AS original_rank, CASE WHEN list_position([2, 0, 1], rank - 1) > 0 THEN 5 - list_position([2, 0, 1], rank - 1) + 1 ELSE 0 END::DOUBLE AS rerank_score FROM hits) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) AS rank FROM x",
    "parse_score": rf"WITH {_REPLY} SELECT conv_id, turn, coalesce(try_cast(nullif(regexp_extract('Score: ' || n || '/10 ' || text, '\b([1-9]|10)\b', 1), '') AS DOUBLE), 5.0) AS score FROM r",
    "parse_ranking": rf"WITH {_REPLY}, x AS (SELECT conv_id, turn, list_transform(regexp_extract_all(concat_ws(', ', n, n % 5, 2, n % 3 + 1), '(\d{{1,9}})', 1), lambda v: v::INT - 1) AS o FROM r), y AS (SELECT conv_id, turn, list_filter(o, lambda v: v >= 0 AND v < 6) AS o FROM x) SELECT conv_id, turn, array_to_string(list_filter(o, lambda v, i: list_position(o, v) = i), ',') AS ranking FROM y",
    "parse_variants": rf"WITH {_REPLY}, x AS (SELECT conv_id, turn, list_transform(string_split('1. ' || text || chr(10) || '2) short' || chr(10) || '- another way to ask this' || chr(10) || '3. ' || text, chr(10)), lambda v: regexp_replace(regexp_replace(trim(v), '^\d+[.)]\s*', ''), '^[-*]\s*', '')) AS o FROM r) SELECT conv_id, turn, array_to_string(list_filter(o, lambda v: length(v) > 10)[1:3], '|') AS variants FROM x",
    "parse_react": f"WITH {_REPLY} SELECT conv_id, turn, 'look at ' || n AS thought, CASE WHEN n < 5 THEN 'vector_search' WHEN n < 9 THEN 'keyword_search' ELSE 'FINISH' END AS tool, CASE WHEN n < 5 THEN 'what is it' WHEN n < 9 THEN 'the query' ELSE '' END AS args FROM r",
    "rewrite_fallback": f"WITH {_REPLY} SELECT conv_id, turn, CASE WHEN n % 3 = 0 THEN text ELSE 'rewritten ' || n END AS rewritten_query FROM r",
    "build_prompt": f"{_search(_bm25(), 3)}, {_CAND} SELECT query_id, 'Context:' || chr(10) || string_agg('[' || rank || '] ' || {_strip('substring(content, 1, 200)')}, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(query) AS prompt FROM cand GROUP BY query_id",
    "chunk_overlapping": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, start_index, end_index, length(content) AS chunk_size_chars, md5(content) AS content_md5 FROM ch",
    "chunk_size_stats": f"WITH {_CHUNKS} SELECT count(*) AS n_chunks, floor(avg(length(content)))::BIGINT AS avg_chars, min(length(content)) AS min_chars, max(length(content)) AS max_chars FROM ch",
    "boundary_quality": rf"WITH {_CHUNKS} SELECT round(avg(regexp_matches(regexp_replace(content, '\s+\z', ''), '[.!?" + "\")" + r":;]\z')::INT::DOUBLE), 6) AS natural_share FROM ch",
    "chunk_semantic_breaks": f"WITH a AS (SELECT label AS doc_id, vec_id AS pos, round({_dot('lag(embedding) OVER o', 'embedding')}, 6) AS similarity FROM embeddings WINDOW o AS (PARTITION BY label ORDER BY vec_id)), b AS (SELECT *, quantile_cont(similarity, 0.05) OVER (PARTITION BY doc_id) AS cut FROM a) SELECT doc_id, pos, similarity, sum(coalesce((similarity < round(cut, 9))::INT, 0)) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM b",
    "density_score": rf"WITH x AS (SELECT doc_id, text, {_words('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.5 ELSE 0.5 * greatest(0.0, least(1.0, (10.0 - list_sum(list_transform(w, lambda v: length(v)))::DOUBLE / len(w)) / 8.0)) + 0.3 * greatest(0.0, least(1.0, greatest(1, length(text) - length(translate(text, '.!?', '')))::DOUBLE / len(w) * 100.0 / 10.0)) + 0.2 * greatest(0.0, least(1.0, (length(text) - length(regexp_replace(text, '[:=()\[\]{{}}<>/\\|@#$%^&*]', '', 'g')))::DOUBLE / greatest(length(text), 1) / 0.15)) END, 6) AS density FROM x",
    "doc_stats": f"SELECT doc_id, length(text) AS char_count, len({_words('text')}) AS word_count, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents",
    "clean_text": rf"WITH a AS (SELECT doc_id, nfc_normalize({_CLEAN}) AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\x{{200B}}-\x{{200F}}\x{{2028}}-\x{{202F}}\x{{FEFF}}]', '', 'g'), '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM a), c AS (SELECT doc_id, {_strip(chr(114) + 'egexp_replace(regexp_replace(t, ' + chr(39) + '[' + _SP + ']+(' + chr(92) + 'n|' + chr(92) + 'z)' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '[ ' + chr(92) + 't]{2,}' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS c FROM b) SELECT doc_id, length(c) AS n_chars_clean, md5(c) AS clean_md5 FROM c",
    "lang_gate": "SELECT doc_id, CASE WHEN lang NOT IN ('en', 'unknown', '') THEN lang WHEN length(text) < 50 THEN 'en' WHEN doc_id % 3 = 0 THEN CASE WHEN contains(text, 'ß') THEN 'de' ELSE 'fr' END ELSE 'en' END AS language FROM documents",
    "csv_row_template": "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ' | n_name: ' || trim(n_name) || ' | n_regionkey: ' || n_regionkey AS content FROM nation",
    "csv_file_table": "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS content, count(*) AS row_count, 2 AS column_count FROM region",
    "transcript_segments": f"WITH x AS (SELECT conv_id AS video_id, {_strip('text')} AS content, (turn * 701.5)::DOUBLE AS start, floor(turn * 701.5)::BIGINT AS s FROM conversations) SELECT video_id, content, start, {_TS} AS timestamp, 'https://youtu.be/' || video_id || '?t=' || s AS video_url FROM x WHERE length(content) >= 5",
    "transcript_full": f"WITH x AS (SELECT conv_id AS video_id, {_strip('text')} AS t, (turn * 701.5)::DOUBLE AS start FROM conversations) SELECT video_id, coalesce(string_agg(t, ' ' ORDER BY start, t) FILTER (t <> ''), '') AS content, max(start) + 4.25 AS duration_seconds, count(*) AS segment_count FROM x GROUP BY 1",
    "url_video_id": "WITH x AS (SELECT page_id, substring(md5(page_id::VARCHAR), 1, 11) AS k, url FROM pages) SELECT page_id, CASE WHEN page_id % 5 < 4 THEN k ELSE coalesce(nullif(regexp_extract(url, '^([A-Za-z0-9_-]{11})$', 1), ''), nullif(regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '/(?:shorts|embed)/([A-Za-z0-9_-]{11})', 1), '')) END AS video_id FROM x",
    "route_source": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'youtube' WHEN page_id % 4 = 2 THEN NULL WHEN regexp_matches(url, '^https?://[^/]*(youtube\\.com|youtu\\.be)') THEN 'youtube' WHEN regexp_matches(url, '^https?://') THEN 'html' END AS loader FROM pages",
    "html_title": "SELECT page_id, nullif(trim(" + _entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + "), '') AS title FROM pages",
    "html_extract": _html(),
    "is_relevant": f"{_search(_bm25(), 5, _GOLD)}, {_RANKED} SELECT query_id, chunk_id, rank, relevant FROM rk",
    "eval_recall_mrr": f"{_search(_bm25(), 5, _GOLD)}, {_RANKED}, {_EVAL} SELECT * FROM ev",
    "eval_by_source": f"{_search(_bm25(), 5, _GOLD)}, {_RANKED} SELECT lang, count(*) AS n, round(avg(relevant::INT::DOUBLE), 6) AS recall_at_1 FROM rk WHERE rank = 1 GROUP BY lang",
    "method_diff": "WITH a AS (" + f"{_search(_bm25(), 5, _GOLD)}, {_RANKED}, {_EVAL} SELECT * FROM ev" + "), b AS (" + f"{_search(_TFIDF, 5, _GOLD)}, {_RANKED}, {_EVAL} SELECT * FROM ev" + ") SELECT query_id, b.recall_at_1 AS fused, a.recall_at_1 AS leg_0, CASE WHEN b.recall_at_1 > a.recall_at_1 THEN 'fused wins' WHEN b.recall_at_1 = 0 THEN 'all miss' ELSE 'no gain' END AS verdict FROM a JOIN b USING (query_id)",
    "rewrite_search": _search(_bm25(), 5, _Q.replace("q AS", "q0 AS", 1) + r", q AS (SELECT query_id, regexp_replace(query, '\b(the|der|die|la|los)\b', ' ', 'g') AS query FROM q0)") + " SELECT * FROM hits",
    "embedding_cost": "SELECT label::VARCHAR AS name, round(round(count(*) / 8.0, 3) * 1000000 / 3.6e6, 4) AS hours, round(max(len(embedding)) * 4.0 * 1000000 / 1e9, 4) AS gigabytes FROM embeddings GROUP BY label",
    "leaderboard": "WITH a AS (" + f"{_search(_bm25(), 5, _GOLD)}, {_RANKED}, {_EVAL} SELECT * FROM ev" + "), b AS (" + f"{_search(_TFIDF, 5, _GOLD)}, {_RANKED}, {_EVAL} SELECT * FROM ev" + "), m AS (SELECT 'bm25' AS method, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(mrr), 6) AS mrr FROM a UNION ALL SELECT 'tfidf', round(avg(recall_at_1), 6), round(avg(mrr), 6) FROM b) SELECT *, rank() OVER (ORDER BY recall_at_1 DESC, mrr DESC) AS place FROM m",
    "faithfulness_4gram": f"WITH f AS (SELECT conv_id, arg_min(text, turn) AS context FROM conversations GROUP BY 1), x AS (SELECT conv_id, turn, lower(context) AS c, {_words('lower(text)')} AS w FROM conversations JOIN f USING (conv_id)) SELECT conv_id, turn, round(CASE WHEN len(w) < 4 THEN 1.0 ELSE len(list_filter(range(1, len(w) - 2), lambda i: contains(c, array_to_string(w[i:i + 3], ' ')))) / (len(w) - 3)::DOUBLE END, 6) AS faithfulness FROM x",
    "cache_key": "SELECT doc_id, sha256('hash-64::passage::' || text) AS cache_key FROM documents",
    "cache_misses": "SELECT DISTINCT sha256('hash-64::passage::' || text) AS cache_key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "cache_stats": "SELECT 'model-' || lang AS model_name, count(*) AS entries, sum(doc_id % 5) AS hits FROM documents GROUP BY 1",
    "index_upsert": "WITH u AS (SELECT doc_id, source AS tenant_id, 1 AS version FROM documents UNION ALL SELECT doc_id + 5, 'new', 2 FROM documents WHERE doc_id % 3 = 0) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1",
    "index_delete": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "ivf_centroids": f"WITH {_CENT} SELECT cell, round(centroid[1], 6) AS first, round(sqrt({_dot('centroid', 'centroid')}), 6) AS norm FROM cent",
    "ivf_search": f"WITH {_V}, {_CENT}, p AS (SELECT query_id, qvec, cell FROM cent, qv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({_dot('centroid', 'qvec')}, 6) DESC, cell) <= 3), x AS (SELECT query_id, vec_id AS chunk_id, round({_dot('embedding', 'qvec')}, 6) AS score FROM embeddings JOIN p ON label = cell) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x QUALIFY rank <= 5",
    "raptor_level1": f"WITH {_CENT}, n AS (SELECT label AS cell, count(*) AS n_members, min(vec_id) AS first_member FROM embeddings GROUP BY 1) SELECT cell, n_members, first_member, round(centroid[1], 6) AS first FROM n JOIN cent USING (cell)",
    "raptor_stats": "SELECT 0 AS level, count(*) AS nodes FROM embeddings UNION ALL SELECT 1, count(DISTINCT label) FROM embeddings UNION ALL SELECT 2, count(DISTINCT label % 3) FROM embeddings",
    "crag_overlap": f"{_search(_bm25(), 3)}, {_CAND}, x AS (SELECT query_id, chunk_id, lower(content) AS c, list_filter(list_distinct(string_split_regex(lower(query), '\\s+')), lambda v: NOT list_contains({_STOP}, v)) AS q FROM cand) SELECT query_id, chunk_id, round(CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(q, lambda v: contains(c, v))) / len(q)::DOUBLE END, 6) AS overlap FROM x",
    "self_rag_filter": f"{_search(_bm25(), 10)}, {_CAND}, x AS (SELECT query_id, chunk_id, rank, {_OVER} >= 0.75 AS relevant FROM cand), y AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, relevant ORDER BY rank) AS i FROM x) SELECT query_id, chunk_id, rank, relevant, n < 1 AS fallback FROM y WHERE (n >= 1 AND relevant AND i <= 5) OR (n < 1 AND rank <= 1)",
    "embed_prefix": "SELECT doc_id, 'passage: ' || text AS passage, 'Represent this sentence for searching relevant passages: ' || text AS query FROM documents",
}

#: The same searches with every vector whose id is divisible by 50 as a query.
ORACLE |= {f"{name}_all": ORACLE[name].replace("vec_id IN (0, 1, 2, 3)", "vec_id % 50 = 0") for name in ("dense_topk", "dense_cosine", "dense_l2", "tenant_topk")}
#: Prompts of whole passages.
ORACLE["crag_route"] = (
    f"{_search(_bm25(), 6)}, {_CAND}, ctx AS (SELECT query_id, lower(content) AS c, rank, list_filter(list_distinct(string_split_regex(lower(query), '\\s+')), lambda v: NOT list_contains({_STOP}, v)) AS q FROM cand), "
    "ctx_q AS (SELECT query_id, any_value(q) AS q, string_agg(c, ' ' ORDER BY rank) AS c, count(*) FILTER (WHERE CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(q, lambda v: contains(c, v))) / len(q)::DOUBLE END >= 0.5) AS relevant FROM ctx GROUP BY query_id), "
    "ctx_s AS (SELECT query_id, relevant, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(q, lambda v: contains(c, v))) / len(q)::DOUBLE END AS share FROM ctx_q) "
    "SELECT query_id, CASE WHEN share > 0.6 THEN 'correct' WHEN relevant >= 1 THEN 'ambiguous_filtered' ELSE 'fallback' END AS crag_action FROM ctx_s"
)
ORACLE["build_prompt_whole"] = ORACLE["build_prompt"].replace("substring(content, 1, 200)", "content")
