"""DuckDB SQL for the chunkers, Markdown sections and trees of summaries: each step of splitting, packing and locating is a table of its own, with folds over lists."""

from __future__ import annotations

from .oracle import _CENT, _SP, _dot, _strip, _words

_BLANK = rf"regexp_full_match(p, '[\n{_SP}]*')"
_SEPARATORS = ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")
#: Marks where a text is cut; no text has it.
_CUT = "chr(57344)"


def _pieces(src: str, out: str) -> str:
    """Table out: src's rows (k, t, n) with a, the pieces of t of at most n characters."""
    keep = f"lambda p: length(p) > n OR NOT {_BLANK}"
    steps = [f"{out}_0 AS (SELECT * EXCLUDE (t), t, list_filter([t], {keep}) AS a FROM {src})"]
    for i, sep in enumerate(_SEPARATORS):
        cut = f"CASE WHEN length(p) <= n THEN [p] ELSE string_split(replace(p, {sep}, {sep} || {_CUT}), {_CUT}) END"
        steps.append(f"{out}_{i + 1} AS (SELECT * EXCLUDE (a), list_filter(flatten(list_transform(a, lambda p: {cut})), {keep}) AS a FROM {out}_{i})")
    sliced = "CASE WHEN length(p) <= n THEN [p] ELSE list_transform(range(1, length(p) + 1, n), lambda i: substring(p, i, n)) END"
    steps.append(f"{out} AS (SELECT * EXCLUDE (a), flatten(list_transform(a, lambda p: {sliced})) AS a FROM {out}_4)")
    return ", ".join(steps)


def _packed(src: str, out: str, overlap: int = 0) -> str:
    """Table out: the pieces a joined from the left while they fit n."""
    empty = "{'done': []::VARCHAR[], 'cur': ''}"
    step = f"CASE WHEN length(s.cur) + length(x.cur) <= n THEN {{'done': s.done, 'cur': s.cur || x.cur}} ELSE {{'done': list_append(s.done, s.cur), 'cur': right(s.cur, {overlap}) || x.cur}} END"
    fold = f"list_reduce(list_transform(a, lambda p: {{'done': []::VARCHAR[], 'cur': p}}), lambda s, x: {step}, {empty})"
    last = _BLANK.replace("(p,", "(f.cur,")
    return f"{out}_f AS (SELECT * EXCLUDE (a), {fold} AS f FROM {src}), {out} AS (SELECT * EXCLUDE (f), CASE WHEN {last} THEN f.done ELSE list_append(f.done, f.cur) END AS a FROM {out}_f)"


def _overlapped(src: str, out: str, overlap: int) -> str:
    return f"{out} AS (SELECT * EXCLUDE (a), list_transform(a, lambda p, i: CASE WHEN i = 1 THEN p ELSE right(a[i - 1], {overlap}) || p END) AS a FROM {src})"


def _located(src: str, out: str, overlap: int) -> str:
    """Table out: b, where each piece of a starts in t."""
    cursor = f"(CASE WHEN len(s.b) = 0 THEN 0 ELSE s.b[-1] + length(s.p) - {overlap} END)"
    since = f"greatest(1, {cursor} - {overlap} + 1)"
    at = f"instr(substring(t, {since}), x.p)"
    step = f"{{'b': list_append(s.b, CASE WHEN {at} > 0 THEN {since} + {at} - 2 ELSE {cursor} END), 'p': x.p}}"
    return f"{out} AS (SELECT *, list_reduce(list_transform(a, lambda p: {{'b': []::BIGINT[], 'p': p}}), lambda s, x: {step}, {{'b': []::BIGINT[], 'p': ''}}).b AS b FROM {src})"


def _rows(src: str, out: str) -> str:
    return f"{out} AS (SELECT * EXCLUDE (a, b, i, t), a[i] AS content, b[i] AS start_index, b[i] + length(a[i]) AS end_index, length(a[i]) AS chunk_size_chars, i - 1 AS chunk_index FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM {src}))"


def _density(src: str, text: str, out: str) -> str:
    """Table out: src's rows with dens, the density of a text."""
    special = r"[:=()\[\]{}<>/\\|@#$%^&*]"
    clip = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))".format
    short = clip("(10.0::DOUBLE - list_sum(list_transform(w, lambda v: length(v)))::DOUBLE / len(w)) / 8.0::DOUBLE")
    ends = clip(f"greatest(1, length({text}) - length(translate({text}, '.!?', '')))::DOUBLE / len(w) * 100.0::DOUBLE / 10.0::DOUBLE")
    signs = clip(f"(length({text}) - length(regexp_replace({text}, '{special}', '', 'g')))::DOUBLE / greatest(length({text}), 1) / 0.15::DOUBLE")
    value = f"CASE WHEN len(w) = 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * {short} + 0.3::DOUBLE * {ends} + 0.2::DOUBLE * {signs} END"
    return f"{out} AS (SELECT * EXCLUDE (w), {value} AS dens FROM (SELECT *, {_words(text)} AS w FROM {src}))"


_TARGET = "greatest(200, least(1000, trunc(1000 - dens * 800)::INT))"
_OUT = "chunk_size_chars, start_index, end_index, md5(content) AS content_md5"
_DOCS = "src AS (SELECT doc_id, text AS t, {} AS n FROM documents WHERE text IS NOT NULL)".format

#: Trees of summaries: the vectors, the means of their labels, the means of those.
_TREE = (
    f"{_CENT}, up1 AS (SELECT cell, list_transform(centroid, lambda x: (x / sqrt({_dot('centroid', 'centroid')}))::FLOAT) AS vec FROM cent), "
    "flat2 AS (SELECT cell % 3 AS cell, generate_subscripts(vec, 1) AS d, unnest(vec)::DOUBLE AS x FROM up1), m2 AS (SELECT cell, d, avg(x) AS x FROM flat2 GROUP BY ALL), cent2 AS (SELECT cell, list(x ORDER BY d) AS c FROM m2 GROUP BY cell), "
    f"up2 AS (SELECT cell, list_transform(c, lambda x: (x / sqrt({_dot('c', 'c')}))::FLOAT) AS vec FROM cent2), "
    "tree AS (SELECT 'leaf-' || vec_id AS chunk_id, 0 AS level, label AS cell, embedding::DOUBLE[] AS vec FROM embeddings UNION ALL SELECT 'node1-' || cell, 1, cell % 3, vec::DOUBLE[] FROM up1 UNION ALL SELECT 'node2-' || cell, 2, 0, vec::DOUBLE[] FROM up2)"
)
_HEADING = r"#{1,6}[ \t]+"

CHUNK_ORACLE = {
    "chunk_recursive": f"WITH {_DOCS(512)}, {_pieces('src', 'pc')}, {_packed('pc', 'pk', 50)}, {_located('pk', 'loc', 50)}, {_rows('loc', 'ch')} SELECT doc_id, chunk_index, {_OUT} FROM ch",
    "chunk_parent_child": (
        f"WITH {_DOCS(1500)}, {_pieces('src', 'pc')}, {_packed('pc', 'pk')}, par AS (SELECT doc_id, t AS whole, i - 1 AS parent_index, a[i] AS t, 300 AS n FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM pk)), "
        f"{_pieces('par', 'cc')}, {_packed('cc', 'ck')}, {_overlapped('ck', 'co', 40)}, kid AS (SELECT doc_id, whole, parent_index, length(t) AS parent_chars, i - 1 AS child_index_in_parent, a[i] AS content FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM co)), "
        f"loc AS (SELECT *, length(content) AS chunk_size_chars, greatest(instr(whole, content) - 1, 0) AS start_index FROM kid) SELECT doc_id, parent_index, child_index_in_parent, parent_chars, chunk_size_chars, start_index, start_index + chunk_size_chars AS end_index, md5(content) AS content_md5 FROM loc"
    ),
    "chunk_adaptive": (
        f"WITH raw AS (SELECT doc_id, text AS whole, unnest(string_split(text, chr(10) || chr(10))) AS u, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM documents), para AS (SELECT doc_id, whole, k, {_strip('u')} AS t FROM raw WHERE {_strip('u')} <> ''), "
        f"{_density('para', 't', 'pd')}, src AS (SELECT doc_id, whole, k, t, {_TARGET} AS n FROM pd), {_pieces('src', 'pc')}, {_packed('pc', 'pk')}, al AS (SELECT doc_id, any_value(whole) AS t, flatten(list(a ORDER BY k)) AS a FROM pk GROUP BY doc_id), "
        f"{_overlapped('al', 'ov', 50)}, {_located('ov', 'loc', 50)}, {_rows('loc', 'ch')}, {_density('ch', 'content', 'cd')} SELECT doc_id, chunk_index, round_even(dens, 3) AS density_score, {_TARGET} AS target_size, {_OUT} FROM cd"
    ),
    "chunk_metadata_aware": (
        "WITH meta AS (SELECT doc_id, text AS t, CASE WHEN doc_id % 11 = 0 THEN 'atomic_table' WHEN doc_id % 13 = 0 THEN 'passthrough' END AS split_reason, CASE doc_id % 7 WHEN 0 THEN 1200 WHEN 1 THEN 1200 WHEN 3 THEN 300 WHEN 4 THEN 300 WHEN 5 THEN 300 ELSE 600 END AS n FROM documents WHERE text IS NOT NULL), "
        f"src AS (SELECT * FROM meta WHERE split_reason IS NULL), {_pieces('src', 'pc')}, {_packed('pc', 'pk')}, {_overlapped('pk', 'ov', 60)}, {_located('ov', 'loc', 60)}, {_rows('loc', 'ch')} "
        f"SELECT doc_id, chunk_index, split_reason, n AS target_size_used, {_OUT} FROM ch UNION ALL SELECT doc_id, 0, split_reason, NULL, length({_strip('t')}), 0, length(t), md5({_strip('t')}) FROM meta WHERE split_reason IS NOT NULL AND {_strip('t')} <> ''"
    ),
    "md_sections": (
        r"WITH raw AS (SELECT doc_id::VARCHAR AS source, chr(10) || 'intro before any heading at all' || chr(10) || '# Title' || chr(10) || text || chr(10) || '## Part ' || lang || chr(10) || 'body of the last part, long enough' AS t FROM documents), "
        rf"cut AS (SELECT source, string_split(regexp_replace(t, '\n({_HEADING}\S)', {_CUT} || '\1', 'g'), {_CUT}) AS parts FROM raw), part AS (SELECT source, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM cut), "
        rf"sec AS (SELECT source, pos, CASE WHEN pos = 0 THEN 0 ELSE length(regexp_extract(part, '\A(#{{1,6}})[ \t]', 1)) END AS heading_level, CASE WHEN pos = 0 THEN 'Preamble' ELSE trim(regexp_extract(part, '\A{_HEADING}([^\n]*)', 1)) END AS section_title, "
        rf"length(CASE WHEN pos = 0 THEN {_strip('part')} ELSE {_strip(f"regexp_replace(part, '{chr(92)}A{_HEADING}([^{chr(92)}n]*)', '')")} END) AS n FROM part) SELECT * FROM sec WHERE n >= 20"
    ),
    "raptor_tree": f"WITH {_TREE} SELECT chunk_id, level, cell, round(sqrt({_dot('vec', 'vec')}), 4) AS norm FROM tree",
    "raptor_search": (
        f"WITH {_TREE}, qv AS (SELECT 'q' || (vec_id + 1) AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0), hit AS (SELECT query_id, chunk_id, round({_dot('vec', 'qvec')}, 6) AS score FROM tree, qv) "
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hit QUALIFY rank <= 5"
    ),
}
