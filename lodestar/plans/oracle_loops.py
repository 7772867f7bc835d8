"""DuckDB SQL for the retrieval loops, with the same stand-ins for models as the queries have."""

from __future__ import annotations

from .oracle import _CAND, _Q, _QT, _STOP, _bm25, _hits, _search


def _share(query: str, passage: str) -> str:
    """The share of a query's distinct words, stop words left out, that a passage has."""
    words = rf"list_filter(list_distinct(string_split_regex(lower({query}), '\s+')), lambda v: v <> '' AND NOT list_contains({_STOP}, v))"
    return f"(CASE WHEN len({words}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({words}, lambda v: contains(lower({passage}), v))) / len({words})::DOUBLE END)"


def _hop(n: int) -> str:
    """Tables of hop n: its queries are the first six words, on one line, of the last passage of the hop before."""
    last = rf"string_split(regexp_extract(substring(text, 1, 200), '^((?:\S+\s+){{1,6}})', 1), chr(10))"
    before = "hits" if n == 2 else f"hits{n - 1}"
    queries = f"q{n} AS (SELECT query_id, list_filter(list_transform({last}, lambda v: trim(v)), lambda v: v <> '')[1] AS query FROM {before} JOIN documents ON doc_id = chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1)"
    terms = _QT.replace("qt AS", f"qt{n} AS").replace("FROM q)", f"FROM q{n})")
    return f"{queries}, {terms}, {_hits(_bm25(), 3, f'hits{n}').replace('JOIN qt ', f'JOIN qt{n} ')}"


#: Each stated query with none, one and two of its last words taken off.
_SHORTER = r"q0 AS (SELECT * FROM q_all), q AS (SELECT query_id || '#1' AS query_id, query FROM q0 UNION ALL SELECT query_id || '#2', regexp_replace(query, '\s+\S+\s*$', '') FROM q0 UNION ALL SELECT query_id || '#3', regexp_replace(regexp_replace(query, '\s+\S+\s*$', ''), '\s+\S+\s*$', '') FROM q0)"
_ALL = _Q.replace("q AS", "q_all AS", 1)
#: The stated queries and the one that the second step asks.
_MORE = ", q AS (SELECT * FROM q_all UNION ALL SELECT 'more', 'der die und')"

LOOP_ORACLE = {
    "corrective_loop": (
        f"{_search(_bm25(), 10, f'{_ALL}, {_SHORTER}')}, {_CAND}, x AS (SELECT *, string_split(query_id, '#')[1] AS id, string_split(query_id, '#')[2]::INT AS attempt, {_share('query', 'substring(content, 1, 300)')} >= 0.5 AS good FROM cand), "
        "y AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY id, attempt) >= 2 AS enough FROM x), ended AS (SELECT id, coalesce(min(attempt) FILTER (enough), 3) AS attempt FROM y GROUP BY id), z AS (SELECT y.* FROM y JOIN ended USING (id, attempt)) "
        "SELECT id AS query_id, query, chunk_id, score, CASE WHEN enough THEN row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) ELSE rank END AS rank, CASE WHEN enough THEN 'ambiguous_filtered' ELSE 'fallback' END AS crag_action, attempt AS crag_attempt FROM z WHERE good OR NOT enough "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) <= 5"
    ),
    "self_checking": (
        f"{_search(_bm25(), 10)}, {_CAND}, x AS (SELECT query_id, chunk_id, rank, {_share('query', 'substring(content, 1, 400)')} >= 0.5 AS relevant FROM cand WHERE contains(query, 'license')), "
        "y AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, relevant ORDER BY rank) AS i FROM x) SELECT query_id, chunk_id, rank, relevant, n < 1 AS fallback FROM y WHERE (n >= 1 AND relevant AND i <= 5) OR (n < 1 AND rank <= 1)"
    ),
    "agentic_steps": (
        f"{_search(_bm25(), 9, _ALL + _MORE)}, two AS (SELECT h.*, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM hits h JOIN documents ON doc_id = chunk_id WHERE query_id = 'more' AND lang = 'de'), "
        "step AS (SELECT query_id, chunk_id, score, 1 AS agentic_step, 'keyword_search' AS agentic_action FROM hits WHERE query_id <> 'more' AND rank <= 3 UNION ALL SELECT q_all.query_id, chunk_id, score, 2, 'filter_search' FROM two, q_all WHERE place <= 3), "
        "last AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY agentic_step DESC) = 1) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM last QUALIFY rank <= 5"
    ),
    "multi_hop_text": (
        f"{_search(_bm25(), 3)}, {_hop(2)}, {_hop(3)}, hops AS (SELECT query_id, chunk_id, score, 1 AS hop FROM hits UNION ALL SELECT query_id, chunk_id, round(score * 0.7::DOUBLE, 6), 2 FROM hits2 UNION ALL SELECT query_id, chunk_id, round(score * 0.7::DOUBLE * 0.7::DOUBLE, 6), 3 FROM hits3), "
        "best AS (SELECT * FROM hops QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, hop) = 1) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best QUALIFY rank <= 5"
    ),
}
