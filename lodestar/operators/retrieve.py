"""Retrievers, rerankers, prompts, caches and evaluation over ranked frames (query_id, chunk_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound, contains_terms_share, strip, tokenize, words
from .index import search_dense, top_k

#: Stop words of the overlap check.
STOP = ["is", "the", "a", "an", "how", "what", "does", "do", "and", "or", "of", "in", "to", "for", "it", "with", "where", "when", "who", "which", "are", "was", "were"]


def matches(predicate: dict) -> Column:
    """All keys equal their value, or are in their list; null never matches."""
    out = F.lit(True)
    for k, v in predicate.items():
        out = out & F.coalesce(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v), F.lit(False))
    return out


def filtered(vectors: DataFrame, queries: DataFrame, predicate: dict, mode: str = "post", k: int = 5, boost: float = 2.0, keyword_weight: float = 0.3) -> DataFrame:
    """post: the best 5k, those that match, the first k. pre: those that match, the best k. boost: the best 3k, matching scores multiplied, shared words of query and text added, the best k."""
    if mode not in ("post", "pre", "boost"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "pre":
        return search_dense(vectors.where(matches(predicate)), queries, k)
    found = search_dense(vectors, queries, k * (5 if mode == "post" else 3))
    if mode == "post":
        return top_k(found.where(matches(predicate)).drop("rank"), k)
    lower = lambda c: F.array_distinct(words(F.lower(F.col(c))))
    share = F.size(F.array_intersect(lower("query"), lower("text"))) / F.greatest(F.size(lower("query")), F.lit(1))
    score = F.when(matches(predicate), F.col("score") * boost).otherwise(F.col("score")) + share * keyword_weight
    return top_k(found.withColumn("score", F.round(score, 6)).drop("rank"), k)


def fuse_variants(ranked: DataFrame, k: int) -> DataFrame:
    """Ranked frames of a query's variants (query_id, variant, chunk_id, rank): sums of 1 / rank."""
    return top_k(ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / F.col("rank")), 6).alias("score")), k)


def multi_hop(vectors: DataFrame, queries: DataFrame, max_hops: int = 2, fetch_k: int = 3, decay: float = 0.7, k: int = 5) -> DataFrame:
    """Each hop searches with the vector of the best hit that is not the hop's own start; a chunk keeps its best score, weighted by decay ** (hop - 1), and the earliest hop with it."""
    out, at = None, queries.withColumn("start", F.col("own"))
    for hop in range(1, max_hops + 1):
        hits = search_dense(vectors, at.select("query_id", "qvec", "start"), fetch_k)
        step = hits.select("query_id", "chunk_id", F.round(F.col("score") * decay ** (hop - 1), 6).alias("score"), F.lit(hop).alias("hop"))
        out = step if out is None else out.unionByName(step)
        if hop < max_hops:
            best = hits.where("chunk_id <> start").groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("start"))
            at = best.join(vectors.select(F.col("chunk_id").alias("start"), F.col("vec").alias("qvec")), "start")
    best = out.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("hop")).alias("h"))).alias("m")).select("query_id", "chunk_id", "m.score", (-F.col("m.h")).alias("hop"))
    return top_k(best, k)


def overlap_score(query: Column, content: Column, max_length: int = 512) -> Column:
    """The default reranker: share of the query's distinct tokens in the content's first characters."""
    q = F.array_distinct(tokenize(query))
    return F.round(F.size(F.array_intersect(q, tokenize(F.substring(content, 1, max_length)))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(ranked: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    """Ranked anew by score; ties keep their order."""
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("original_rank"))
    out = ranked.withColumnRenamed("rank", "original_rank").withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def listwise_score(order: Column, rank: Column, n: Column) -> Column:
    """n - position of the original rank in a reply's order (from 0), 0 if it is not listed."""
    at = F.array_position(order, (rank - 1).cast("int"))
    return F.when(at > 0, n - at + 1).otherwise(F.lit(0)).cast("double")


def keep_relevant(candidates: DataFrame, relevant: Column, k: int, at_least: int = 1) -> DataFrame:
    """The first k candidates that are judged relevant; if fewer than at_least are, the first at_least candidates instead."""
    w = W.partitionBy("query_id")
    judged = candidates.withColumn("relevant", relevant).withColumn("n", F.sum(F.col("relevant").cast("int")).over(w))
    order = W.partitionBy("query_id", "relevant").orderBy("rank")
    judged = judged.withColumn("i", F.row_number().over(order))
    good = (F.col("n") >= at_least) & F.col("relevant") & (F.col("i") <= k)
    fallback = (F.col("n") < at_least) & (F.col("rank") <= at_least)
    return judged.where(good | fallback).withColumn("fallback", F.col("n") < at_least).drop("i", "n")


def corrective_action(label: Column, share: Column, relevant: Column, k: int) -> Column:
    """What becomes of a query's candidates: a reply that says correct falls to incorrect if too few query terms occur; an ambiguous one needs enough relevant candidates."""
    up = F.upper(label)
    said = F.when(F.contains(up, F.lit("INCORRECT")), F.lit("INCORRECT")).when(F.contains(up, F.lit("CORRECT")), F.lit("CORRECT")).otherwise(F.lit("AMBIGUOUS"))
    return bound(F.when((said == "CORRECT") & (share < 0.3), F.lit("INCORRECT")).otherwise(said), lambda s: F.when(s == "CORRECT", F.lit("correct")).when((s == "AMBIGUOUS") & (relevant >= max(1, k // 2)), F.lit("ambiguous_filtered")).otherwise(F.lit("fallback")))


def context_share(candidates: DataFrame, k: int, query: str = "query", content: str = "content") -> DataFrame:
    """(query_id, share): the share of the query's words, stop words left out, that the first k candidates' texts have together."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", F.col(content).alias("c"))))), lambda s: s["c"])
    joined = candidates.groupBy("query_id", query).agg(F.array_join(texts, " ").alias("_joined"))
    return joined.select("query_id", contains_terms_share(F.col(query), F.col("_joined"), STOP).alias("share"))


def passage_input(text: Column) -> Column:
    """What a model with role prefixes embeds of a passage."""
    return F.concat(F.lit("passage: "), text)


def query_input(text: Column, instruction: str | None = None) -> Column:
    """What is embedded of a query: after the role prefix, or after a model's instruction."""
    return F.concat(F.lit(instruction if instruction is not None else "query: "), text)


def prompt(ranked: DataFrame, content: str = "content", query: str = "query") -> DataFrame:
    """(query_id, prompt): numbered passages in rank order, then the question."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(content).alias("c")))), lambda s: F.concat(F.lit("["), s["rank"].cast("string"), F.lit("] "), strip(s["c"])))
    return ranked.groupBy("query_id", query).agg(F.concat(F.lit("Context:\n"), F.array_join(parts, "\n\n"), F.lit("\n\nQuestion: "), F.first(query)).alias("prompt")).select("query_id", "prompt")


def cache_key(model: str, text: Column, role: str = "passage") -> Column:
    return F.sha2(F.concat(F.lit(f"{model}::{role}::"), text), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Distinct keys that the cache does not have."""
    return texts.select(cache_key(model, F.col(text_col)).alias("cache_key")).distinct().join(cache.select("cache_key"), "cache_key", "left_anti")


def is_relevant(chunk: Column, gold: Column, share: float = 0.6) -> Column:
    """The chunk holds the gold text, or a run of at least that share of its words."""

    def spans(w: Column) -> Column:
        need = F.ceil(F.size(w) * share - 1e-9).cast("int")
        text = F.array_join(words(F.lower(chunk)), " ")
        return bound(text, lambda t: F.exists(F.sequence(F.lit(1), F.size(w) - need + 1), lambda i: F.contains(t, F.array_join(F.slice(w, i, need), " "))))

    return bound(words(F.lower(gold)), lambda w: F.when(F.size(w) == 0, F.lit(False)).when(F.contains(F.lower(chunk), F.lower(gold)), F.lit(True)).otherwise(spans(w)))


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's four-word runs that the context holds; 1 if it has fewer words."""

    def share(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 3), lambda i: F.array_join(F.slice(w, i, 4), " "))
        return F.when(F.size(w) < 4, F.lit(1.0)).otherwise(F.size(F.filter(grams, lambda g: F.contains(F.lower(context), g))) / (F.size(w) - 3))

    return bound(words(F.lower(answer)), share)


def evaluate(gold: DataFrame, ranked: DataFrame, k_values=(1, 3, 5)) -> DataFrame:
    """Per query: recall at each k and the reciprocal rank, from ranked rows with `relevant`."""
    hits = ranked.where("relevant").groupBy("query_id").agg(F.min("rank").alias("first"))
    out = gold.select("query_id").join(hits, "query_id", "left")
    recall = {f"recall_at_{k}": F.when(F.col("first") <= k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in k_values}
    return out.select("query_id", *[v.alias(n) for n, v in recall.items()], F.coalesce(F.round(1.0 / F.col("first"), 6), F.lit(0.0)).alias("mrr"))


def hash_embed(text: Column, dim: int = 64) -> Column:
    """The offline default embedder: token hashes with signs, summed into dim bins and normalised. Stays in the JVM."""
    # one pass over the tokens gives each its bin and sign as one number; the passes that count them are over numbers only
    codes = F.transform(tokenize(text), lambda t: bound(F.xxhash64(t), lambda h: F.pmod(h, F.lit(dim)) * 2 + F.pmod(F.shiftright(h, 32), F.lit(2))))
    n_but = lambda c, code: F.size(F.array_remove(c, code))
    bins = bound(codes, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda d: (n_but(c, d * 2 + 1) - n_but(c, d * 2)).cast("double")))
    from .index import normalized

    return bound(bins, lambda b: normalized(b))
