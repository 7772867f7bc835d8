"""Chunkers: a document becomes several chunks. Splitting and packing are folds over a row's own array, so no chunker shuffles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, density, is_blank, strip

#: Separators from the coarsest to the finest; after them, slices.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _lit(n) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def split_pieces(text: Column, size, separators=SEPARATORS) -> Column:
    """Pieces of at most `size` characters: parts of a separator's split keep it at their end, longer ones are split by the next, and what no separator splits is sliced. Blank pieces go, but not slices."""
    n = _lit(size)

    def level(sep: str):
        def split(p: Column) -> Column:
            parts = bound(F.split(p, re.escape(sep), -1), lambda s: F.transform(s, lambda x, i: F.when(i < F.size(s) - 1, F.concat(x, F.lit(sep))).otherwise(x)))
            return F.when(F.length(p) <= n, F.array(p)).otherwise(parts)

        return split

    out = F.filter(F.array(text), lambda p: (F.length(p) > n) | ~is_blank(p))
    for sep in separators:
        out = F.filter(F.flatten(F.transform(out, level(sep))), lambda p: (F.length(p) > n) | ~is_blank(p))
    return F.flatten(F.transform(out, lambda p: F.when(F.length(p) <= n, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.length(p), n), lambda i: F.substring(p, i, n)))))


def pack(pieces: Column, size, overlap: int = 0) -> Column:
    """Joins pieces from the left while they fit. With an overlap, a new chunk starts with that many last characters of the one before (so it can be longer than size)."""
    n = _lit(size)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(a: Column, p: Column) -> Column:
        new = F.concat(F.right(a["cur"], F.lit(overlap)), p) if overlap else p
        return F.when((a["cur"] == "") | (F.length(a["cur"]) + F.length(p) <= n), F.struct(a["out"].alias("out"), F.concat(a["cur"], p).alias("cur"))).otherwise(F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), new.alias("cur")))

    return F.aggregate(pieces, start, step, lambda a: F.when(is_blank(a["cur"]), a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def overlapped(pieces: Column, overlap: int) -> Column:
    """Each piece but the first starts with the last characters of the piece before it."""
    if overlap <= 0:
        return pieces
    return bound(pieces, lambda a: F.transform(a, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.right(F.get(a, i - 1), F.lit(overlap)), p))))


def located(pieces: Column, text: Column, overlap: int) -> Column:
    """(content, start, end) of each piece: found from the cursor on, which goes back by the overlap twice; a piece that isn't found starts at the cursor."""
    start = F.struct(F.array().cast("array<struct<content:string,start:int,end:int>>").alias("out"), F.lit(0).alias("cursor"))

    def step(a: Column, p: Column) -> Column:
        at = F.call_function("locate", p, text, F.greatest(F.lit(1), a["cursor"] - overlap + 1))
        begin = F.when(at > 0, at - 1).otherwise(a["cursor"])
        return F.struct(F.concat(a["out"], F.array(F.struct(p.alias("content"), begin.cast("int").alias("start"), (begin + F.length(p)).cast("int").alias("end")))).alias("out"), (begin + F.length(p) - overlap).cast("int").alias("cursor"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _rows(df: DataFrame, chunks: Column, name: str, keep=("doc_id",), more: dict | None = None) -> DataFrame:
    out = df.select(*keep, *[v.alias(k) for k, v in (more or {}).items()], F.posexplode(chunks).alias("chunk_index", "c"))
    return out.select(*keep, *(more or {}), "chunk_index", F.col("c.content").alias("content"), F.col("c.start").alias("start_index"), F.col("c.end").alias("end_index"), F.length("c.content").alias("chunk_size_chars"), F.lit(name).alias("chunker_name"))


def chunk_overlapping(df: DataFrame, chunk_size: int = 512, chunk_overlap: int = 50, text_col: str = "text") -> DataFrame:
    """Windows of chunk_size characters, chunk_overlap apart from the next one's start; none starts after one that reached the end. Blank windows go but keep their number."""
    _need(chunk_overlap < chunk_size, "chunk_overlap must be less than chunk_size")
    step, t = chunk_size - chunk_overlap, F.col(text_col)
    last = F.greatest(F.ceil((F.length(t) - chunk_size) / step), F.lit(0)).cast("int")
    windows = F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.substring(t, i * step + 1, F.lit(chunk_size)).alias("content"), (i * step).alias("start"), F.least(i * step + chunk_size, F.length(t)).alias("end"))))
    return _rows(df, windows, "overlapping").where(~is_blank(F.col("content")))


def chunk_recursive(df: DataFrame, chunk_size: int = 512, chunk_overlap: int = 50, text_col: str = "text") -> DataFrame:
    _need(chunk_overlap < chunk_size, "chunk_overlap must be less than chunk_size")
    t = F.col(text_col)
    return _rows(df, located(pack(split_pieces(t, chunk_size), chunk_size, chunk_overlap), t, chunk_overlap), "recursive")


def chunk_parent_child(df: DataFrame, parent_size: int = 1500, child_size: int = 300, child_overlap: int = 40, text_col: str = "text") -> DataFrame:
    """Children of parents. Parents are not copied into each child: (doc_id, parent_index) names them."""
    _need(child_size < parent_size and child_overlap < child_size, "child_size must be less than parent_size and child_overlap less than child_size")
    t = F.col(text_col)
    parents = df.select("doc_id", t.alias("_t"), F.posexplode(pack(split_pieces(t, parent_size), parent_size)).alias("parent_index", "parent"))
    children = parents.select("doc_id", "_t", "parent_index", F.length("parent").alias("parent_chars"), F.posexplode(overlapped(pack(split_pieces(F.col("parent"), child_size), child_size), child_overlap)).alias("child_index_in_parent", "content"))
    start = F.greatest(F.call_function("locate", F.col("content"), F.col("_t")) - 1, F.lit(0))
    return children.select("doc_id", "parent_index", "child_index_in_parent", "content", start.alias("start_index"), (start + F.length("content")).alias("end_index"), F.length("content").alias("chunk_size_chars"), "parent_chars", F.lit("parent_child").alias("chunker_name"))


def adaptive_target(t: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), (F.lit(high) - density(t) * (high - low)).cast("int")))


def chunk_adaptive(df: DataFrame, min_chunk_size: int = 200, max_chunk_size: int = 1000, base_chunk_size: int = 512, overlap_chars: int = 50, text_col: str = "text") -> DataFrame:
    """Paragraphs split and packed to a size that follows their density."""
    _need(min_chunk_size < max_chunk_size and min_chunk_size <= base_chunk_size <= max_chunk_size, "sizes must rise from min over base to max")
    t = F.col(text_col)
    paragraphs = F.filter(F.transform(F.split(t, "\n\n"), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: bound(adaptive_target(p, min_chunk_size, max_chunk_size), lambda n: pack(split_pieces(p, n), n))))
    out = _rows(df, located(overlapped(pieces, overlap_chars), t, overlap_chars), "adaptive")
    return out.withColumns({"density_score": F.bround(density(F.col("content")), 3), "target_size": adaptive_target(F.col("content"), min_chunk_size, max_chunk_size)})


def chunk_metadata_aware(df: DataFrame, base_chunk_size: int = 600, overlap_chars: int = 60, text_col: str = "text") -> DataFrame:
    """df has content_type and heading_level. Tables and what waits for processing stay whole; texts are split to a size that follows the heading level."""
    t, level = F.col(text_col), F.coalesce(F.col("heading_level"), F.lit(2))
    target = F.when(level <= 1, F.lit(base_chunk_size * 2)).when(level.isin(3, 4, 5), F.lit(base_chunk_size // 2)).otherwise(F.lit(base_chunk_size))
    kind = F.col("content_type")
    whole = F.when(kind.isin("ocr_needed", "attachment_needs_processing"), F.lit("passthrough")).when(kind == "table", F.lit("atomic_table"))
    one = F.filter(F.array(F.struct(strip(t).alias("content"), F.lit(0).alias("start"), F.length(t).alias("end"))), lambda x: x["content"] != "")
    many = located(overlapped(pack(split_pieces(t, target), target), overlap_chars), t, overlap_chars)
    return _rows(df, F.when(whole.isNotNull(), one).otherwise(many), "metadata_aware", more={"split_reason": whole, "target_size_used": F.when(whole.isNull(), target)})


def sentences(t: Column) -> Column:
    """Cut at white space after . ! or ? and before a capital letter."""
    return F.filter(F.transform(F.split(strip(t), r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: s != "")


def _quantile(values: Column, q: float) -> Column:
    """The q-quantile of a non-empty array, interpolated between its neighbours."""
    at = lambda v: (F.size(v) - 1) * F.lit(q)
    return bound(F.array_sort(values), lambda v: bound(F.floor(at(v)).cast("int"), lambda i: F.get(v, i) + (F.get(v, F.least(i + 1, F.size(v) - 1)) - F.get(v, i)) * (at(v) - i)))


def chunk_semantic(df: DataFrame, embed, percentile: float = 95.0, min_chunk_size: int = 100, max_chunk_size: int = 1000, text_col: str = "text") -> DataFrame:
    """Sentences grouped by topic: a group ends before a sentence whose similarity to the one before is below the text's (100 - percentile)th percentile. Longer groups are cut to max_chunk_size, shorter ones take the next in until they have min_chunk_size.

    embed: a function of a text column that gives normalised vectors. A row's own array is folded; nothing is shuffled. A null or blank text has no chunks, a single sentence is one.
    """
    _need(0 < percentile < 100, "percentile must be between 0 and 100")
    _need(min_chunk_size < max_chunk_size, "min_chunk_size must be less than max_chunk_size")
    t = F.col(text_col)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = df.select("doc_id", t.alias("_t"), sentences(t).alias("_s")).where(F.size("_s") > 0)
    rows = rows.withColumn("_v", F.transform("_s", lambda s: embed(s)))
    rows = rows.withColumn("_like", F.transform(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), lambda v, i: dot(F.get("_v", i), v)))
    rows = rows.withColumn("_cut", F.when(F.size("_like") > 0, _quantile(F.col("_like"), 1 - percentile / 100)))
    # first sentences of the groups, then the groups
    starts = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_like", i - 1) < F.col("_cut")))
    groups = bound(starts, lambda g: F.transform(g, lambda i, k: F.array_join(F.slice("_s", i + 1, F.coalesce(F.get(g, k + 1), F.size("_s")) - i), " ")))
    cut = F.flatten(F.transform(groups, lambda g: F.transform(F.sequence(F.lit(0), F.floor((F.length(g) - 1) / max_chunk_size).cast("int")), lambda i: F.substring(g, i * max_chunk_size + 1, F.lit(max_chunk_size)))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))
    merged = F.aggregate(cut, start, lambda a, p: F.when(a["cur"].isNull(), F.struct(a["out"].alias("out"), p.alias("cur"))).when(F.length(a["cur"]) < min_chunk_size, F.struct(a["out"].alias("out"), F.concat(a["cur"], F.lit(" "), p).alias("cur"))).otherwise(F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), p.alias("cur"))), lambda a: F.concat(a["out"], F.array(a["cur"])))
    pieces = F.when(F.size("_s") == 1, F.array(strip(F.col("_t")))).otherwise(merged)
    return _rows(rows.withColumn("_pieces", pieces), located(F.col("_pieces"), F.col("_t"), 0), "semantic")


def semantic_groups(sentences: DataFrame, percentile: float = 95.0) -> DataFrame:
    """(doc_id, pos, similarity, grp) from (doc_id, pos, vec): a break stands before a sentence whose similarity to the one before is below the document's (100 - percentile)th percentile."""
    from pyspark.sql import Window as W

    _need(0 < percentile < 100, "percentile must be between 0 and 100")
    order = W.partitionBy("doc_id").orderBy("pos")
    dot = F.aggregate(F.zip_with(F.lag("vec").over(order), "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    sims = sentences.withColumn("similarity", F.round(dot, 6)).drop("vec")
    cut = F.percentile("similarity", 1 - percentile / 100).over(W.partitionBy("doc_id"))
    breaks = sims.withColumn("b", F.coalesce((F.col("similarity") < F.round(cut, 9)).cast("int"), F.lit(0)))
    return breaks.withColumn("grp", F.sum("b").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("b")
