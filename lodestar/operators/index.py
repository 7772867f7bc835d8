"""Indexes and their searches. Sparse indexes are tables of postings, dense ones tables of vectors; searches run for all queries at once. Ties go by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound, tokenize


def top_k(scored: DataFrame, k: int, by=("query_id",), id_col: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; a group limit prunes before the shuffle."""
    order = W.partitionBy(*by).orderBy(F.desc(score), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _runs(w: Column) -> Column:
    """The distinct terms of a row's tokens with their numbers, by sorting them: array<struct<term, tf>>."""
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    count = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    return bound(F.sort_array(w), lambda s: bound(first(s), lambda at: count(s, at)))


def term_counts(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, term, tf, dl): counted within each chunk's own row; nothing is shuffled."""
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), tokenize(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return tokens.select("chunk_id", F.size("w").alias("dl"), F.explode(_runs(F.col("w"))).alias("x")).select("chunk_id", "x.term", "x.tf", "dl")


def _with_df(tf: DataFrame) -> DataFrame:
    return tf.join(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")


def corpus_stats(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: n chunks with a token, their mean length."""
    n = chunks.select(F.size(tokenize(F.col(text_col))).alias("dl")).where("dl > 0")
    return n.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def tfidf_postings(chunks: DataFrame, **cols) -> DataFrame:
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    # the statistics are one row
    return _with_df(term_counts(chunks, **cols)).crossJoin(F.broadcast(corpus_stats(chunks, **cols))).select("term", "chunk_id", "tf", (F.col("tf") / F.col("dl") * idf).alias("weight"))


def bm25_weight(k1, b) -> Column:
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))


def bm25_postings(chunks: DataFrame, k1: float = 1.5, b: float = 0.75, **cols) -> DataFrame:
    return _with_df(term_counts(chunks, **cols)).crossJoin(F.broadcast(corpus_stats(chunks, **cols))).select("term", "chunk_id", "tf", bm25_weight(F.lit(k1), F.lit(b)).alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) from (query_id, query): a term counts as often as it stands in the query."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def search_text(chunks: DataFrame, queries: DataFrame, k: int = 5, method: str = "bm25", k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", tenant_col: str | None = None) -> DataFrame:
    """The k best chunks of each query. With tenant_col, a column of chunks and queries, a query finds chunks of its own tenant only; statistics are over all tenants.

    Texts are read and tokenised once. Of a text's tokens those stay that a query has, and one empty term for the text itself; they are counted before the one exchange, which both the statistics (a row for each query term and one for the corpus) and the scores are made from. No term's postings come together in one place: rows are scored against the statistics, which grow with the queries only.
    """
    wanted = query_terms(queries)
    kept = wanted.select("term").distinct().unionByName(chunks.sparkSession.createDataFrame([("",)], "term string"))
    own = [F.col(tenant_col).alias("_tenant")] if tenant_col else []
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), *own, tokenize(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    of_row = ["chunk_id", *(["_tenant"] if own else []), "dl", "term"]
    found = tokens.withColumn("dl", F.size("w")).withColumn("term", F.explode(F.concat("w", F.array(F.lit(""))))).select(*of_row).join(F.broadcast(kept), "term", "left_semi")
    rows = found.groupBy(*of_row).agg(F.count(F.lit(1)).alias("tf"))
    # all columns are used on both ways, so both read one exchange
    per = rows.groupBy("term").agg(F.count("chunk_id").alias("df"), F.sum("dl").alias("dl_sum"), F.sum("tf").alias("tf_sum")).where("tf_sum >= 0")
    corpus = per.where("term = ''").select(F.col("df").alias("n"), (F.col("dl_sum") / F.col("df")).alias("avgdl"))
    known = per.where("term <> ''").select("term", "df").crossJoin(F.broadcast(corpus)).join(F.broadcast(wanted), "term")
    weight = bm25_weight(F.lit(k1), F.lit(b)) if method == "bm25" else F.col("tf") / F.col("dl") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    matched = rows.where("term <> ''").join(F.broadcast(known), "term")
    if own:
        matched = matched.join(F.broadcast(queries.select("query_id", *own).distinct()), ["query_id", "_tenant"])
    hits = matched.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight * F.col("qtf")), 6).alias("score"))
    return top_k(hits, k).select("query_id", "chunk_id", "score", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """cosine, ip or l2 (minus the squared distance)."""
    if metric == "l2":
        return -F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) if metric == "ip" else F.try_divide(dot(a, b), norm(a) * norm(b))


def search_dense(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "ip", by=("query_id",), most_queries: int = 10_000) -> DataFrame:
    """The k nearest vectors (chunk_id, vec, ...) of each stated query (query_id, qvec): the query set is checked and broadcast, the vectors stay where they are."""
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries: search them in blocks")
    scored = vectors.crossJoin(F.broadcast(queries)).withColumn("score", F.round(similarity(F.col("vec"), F.col("qvec"), metric), 6)).drop("vec", "qvec")
    return top_k(scored, k, by)


def query_blocks(queries: DataFrame, block: int = 5_000) -> list[DataFrame]:
    """Any number of queries (query_id, ...) as blocks of about `block`, for searches that take a stated set."""
    blocks = -(-queries.count() // block)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [queries]


def in_blocks(search, queries: DataFrame) -> DataFrame:
    """search(block) of all blocks of the queries."""
    parts = [search(q) for q in query_blocks(queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of the wanted (query_id, chunk_id) that were found."""
    both = wanted.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("_hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]


def normalized(v: Column, eps: float = 1e-8) -> Column:
    """v over its norm; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n < eps, F.lit(1.0)).otherwise(n)))[0]


def rrf(legs: list[tuple[DataFrame, float]], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, chunk_id, rank)."""
    parts = [leg.select("query_id", "chunk_id", (F.lit(w) / (constant + F.col("rank"))).alias("s")) for leg, w in legs]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top_k(both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score")), k)


def centroids(vectors: DataFrame, cell: str = "cell") -> DataFrame:
    """The mean vector of each cell, in the order of dimensions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    # one running mean for each cell and task: rows are neither exploded nor shuffled
    mean = Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))
    return vectors.where("vec is not null").groupBy(cell).agg(mean.alias("_mean")).select(cell, vector_to_array("_mean").alias("centroid"))


def search_ivf(vectors: DataFrame, queries: DataFrame, k: int = 5, nprobe: int = 3, cell: str = "cell", most_queries: int = 10_000) -> DataFrame:
    """Search in the nprobe cells whose centroids are nearest to a query. The queries' cells are broadcast after a check of their number, so that no cell's vectors are shuffled; more queries are searched in blocks."""
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries: search them in blocks")
    near = top_k(queries.crossJoin(F.broadcast(centroids(vectors, cell))).withColumn("score", F.round(dot(F.col("centroid"), F.col("qvec")), 6)), nprobe, id_col=cell).select("query_id", "qvec", cell)
    scored = vectors.join(F.broadcast(near), cell).withColumn("score", F.round(dot(F.col("vec"), F.col("qvec")), 6)).drop("vec", "qvec", cell)
    return top_k(scored, k)


def kmeans_cells(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """vectors with a cell from k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_f", array_to_vector(F.col("vec").cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cell").fit(rows).transform(rows).drop("_f")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The newest version of each key; of one version, a row of `new` goes before one of `old`, and then the largest by its columns in order, so reruns agree."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc(version), F.desc("_new"), *[F.desc(c) for c in old.columns if c not in (key, version)]]
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n", "_new")


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids, key, "left_anti")
