"""Queries rewritten by a model (a function from prompt column to reply column) before the search, and comparisons of methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_variants, strip

#: What the model is asked; {query} stands for the query.
PROMPTS = {
    "reformulate": "Write a search query that finds passages answering this question. Reply with the query alone.\nQuestion: {query}",
    "hyde": "Write a short passage that could answer this question.\nQuestion: {query}",
    "variants": "Write other ways to ask this question, one a line.\nQuestion: {query}",
}


def ask(query: Column, mode: str) -> Column:
    if mode not in PROMPTS:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(PROMPTS)}")
    return F.replace(F.lit(PROMPTS[mode]), F.lit("{query}"), query)


def rewritten(queries: DataFrame, model: Callable[[Column], Column], mode: str = "reformulate") -> DataFrame:
    """queries with `query` rewritten, and original_query and rewrite_mode beside it; a null or blank reply leaves the query as it is."""
    reply = F.nullif(strip(model(ask(F.col("query"), mode))), F.lit(""))
    return queries.withColumns({"original_query": F.col("query"), "query": F.coalesce(reply, F.col("query")), "rewrite_mode": F.lit(mode)})


def variants(queries: DataFrame, model: Callable[[Column], Column], n: int = 3) -> DataFrame:
    """(query_id, variant, query): the query itself as variant 0 and up to n that the model gives."""
    asked = F.concat(F.array("query"), F.coalesce(parse_variants(model(ask(F.col("query"), "variants")), n), F.array().cast("array<string>")))
    return queries.select("query_id", F.posexplode(asked).alias("variant", "query"))


def method_diff(legs: list[DataFrame], fused: DataFrame, at: str = "recall_at_1") -> DataFrame:
    """(query_id, leg_0, ..., fused, verdict) from evaluate()'s frames: whether the fused method beats every leg, or misses."""
    out = fused.select("query_id", F.col(at).alias("fused"))
    for i, leg in enumerate(legs):
        out = out.join(leg.select("query_id", F.col(at).alias(f"leg_{i}")), "query_id")
    best = F.array_max(F.array(*[F.col(f"leg_{i}") for i in range(len(legs))]))
    return out.withColumn("verdict", F.when(F.col("fused") > best, F.lit("fused wins")).when(F.col("fused") == 0, F.lit("all miss")).otherwise(F.lit("no gain")))


def embedding_cost(models: DataFrame, chunks: int = 1_000_000) -> DataFrame:
    """(name, hours, gigabytes) of models (name, dimension, ms_per_chunk) over so many chunks of 32-bit vectors."""
    return models.select("name", F.round(F.col("ms_per_chunk") * chunks / 3.6e6, 4).alias("hours"), F.round(F.col("dimension") * 4.0 * chunks / 1e9, 4).alias("gigabytes"))
