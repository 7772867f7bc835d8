"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Every document is cut into blocks of BLOCK words. A source's documents are put in a permuted order by hash, their blocks in a row, once for each pass over the source (two at most, since a target stops at twice the source's size). The mix takes blocks in that order until the target is reached; the last block is cut to the word. So each source has an exact quota of blocks. A splitting tree deals the quotas out
to the output shards: at each node, the left half's share of each source's blocks is drawn from the multivariate hypergeometric law (source after source, by the inverse of its distribution function at a hashed u), and both halves recurse. A shard then owns a disjoint run of each source's permuted blocks, and documents stay whole but at the ends of runs. Blocks of one document that a shard takes in one pass are one run of text.
Within its shard, a run has a hashed order key, and shards are written in its order: the local shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, numbered, table, written

#: Source weights, repeating in the order of the sources.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK = 256
#: The tree's depth: 2 ** DEPTH output shards.
DEPTH = 4
#: A source's blocks are ranked bucket by bucket.
BUCKETS = 4096
#: Sources that a mix may have: they are labels, and the splitting tree's nodes hold a number for each. More raise an error.
SOURCES = 10_000
#: Pieces of order keys by which each shard's rows are dealt to tasks.
PIECES = 256
#: A word with the white space before it, or the white space at the end: joined, they are the text.
_PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _zero() -> Column:
    return F.lit(0).cast("long")


def n_words(text: Column) -> Column:
    """Words of a text, null: 0. Counts the word starts without keeping the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, ordinal, source_size, target) from rows (source, size): source_size is the sum of the sizes.

    All sources share `share` of all sizes by weight; a target stops at `cap` times its source's size, and the excess is shared again by weight until none is above: the level to which all others rise follows from the sources sorted by size over weight,
    of which the capped ones come first. With no words at all, all targets are 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("ordinal"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).withColumn("w", weight)
    all_ = W.partitionBy()
    by_ratio = W.orderBy((F.col("source_size") / F.col("w")), "ordinal").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"total": F.sum("source_size").over(all_), "w_total": F.sum("w").over(all_), "c_before": F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))})
    level = (F.col("total") * share - F.col("c_before")) / (F.col("w_total") - F.col("w_before"))
    at = F.row_number().over(W.orderBy((F.col("source_size") / F.col("w")), "ordinal"))
    per = per.withColumns({"level": level, "at": at})
    first = F.min(F.when(F.col("source_size") * cap > F.col("level") * F.col("w"), F.struct("at", "level"))).over(all_)
    per = per.withColumn("level", first["level"])
    target = F.least(F.col("source_size") * cap, F.coalesce(F.col("level") * F.col("w"), F.lit(0.0)))
    return per.select("source", "ordinal", "source_size", target.cast("double").alias("target"))


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`: the u-quantile. Sums the law's weights over the values within nine standard deviations of the mode, each from the one before by their ratio."""
    n, m, k = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mode = F.floor((k + 1) * (m + 1) / (n + 2)).cast("double")
    sd = F.sqrt(F.greatest(F.lit(0.0), k * m / F.greatest(n, F.lit(1.0)) * (1 - m / F.greatest(n, F.lit(1.0))) * (n - k) / F.greatest(n - 1, F.lit(1.0))))
    bottom = F.greatest(F.lit(0.0), k + m - n)
    low = F.greatest(bottom, mode - F.ceil(9 * sd) - 2).cast("long")
    high = F.least(m, k, mode + F.ceil(9 * sd) + 2).cast("long")
    s = F.struct(n.alias("n"), m.alias("m"), k.alias("k"), low.alias("low"), F.greatest(low, high).alias("high"), u.alias("u"))

    def quantile(s: Column) -> Column:
        steps = F.when(s["high"] > s["low"], F.sequence(s["low"], s["high"] - 1)).otherwise(F.array().cast("array<long>"))
        ratio = lambda x: (s["m"] - x) * (s["k"] - x) / ((x + 1) * (s["n"] - s["m"] - s["k"] + x + 1))
        sums = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"] * ratio(x)).alias("sum")))["sum"]
        return F.transform(F.array(sums), lambda z: F.aggregate(
            steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), s["low"].alias("at")),
            lambda a, x: F.when(a["sum"] >= s["u"] * z, a).otherwise(F.struct((a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"] * ratio(x)).alias("sum"), (x + 1).alias("at"))),
        )["at"])[0]

    return F.transform(F.array(s), quantile)[0]


def _u(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _halves(level: int, seed: int):
    """Turns a node, the sources' block counts, into its two halves."""

    def halves(node: Column, at: Column) -> Column:
        total = F.aggregate(node, _zero(), lambda a, x: a + x)
        start = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("want"), F.array().cast("array<long>").alias("left"))

        def draw(a: Column, x: Column) -> Column:
            got = _hypergeometric(a["rest"], x, a["want"], _u(F.lit(seed), F.lit(level), at, F.size(a["left"])))
            return F.transform(F.array(got), lambda g: F.struct((a["rest"] - x).alias("rest"), (a["want"] - g).alias("want"), F.concat(a["left"], F.array(g)).alias("left")))[0]

        return F.transform(F.array(F.aggregate(node, start, draw)["left"]), lambda left: F.array(left, F.zip_with(node, left, lambda n, g: n - g)))[0]

    return halves


def split_quotas(quotas: DataFrame, depth: int = DEPTH, seed: int = 23) -> DataFrame:
    """(ordinal, shard, first, last) from (ordinal, quota): shard's blocks of a source are those with first <= rank < last.

    The sources' quotas are one array (sources are labels, one number each); a node of the tree is such an array of counts, and each level turns 2**l nodes into 2**(l+1).
    """
    row = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("quota").cast("long").alias("n")))).alias("sources"))
    tree = F.array(F.transform("sources", lambda x: x["n"]))
    row = row.withColumn("tree", tree)
    for level in range(depth):
        row = row.withColumn("tree", F.flatten(F.transform("tree", _halves(level, seed))))
    dealt = row.select("sources", F.posexplode("tree").alias("shard", "node")).select("shard", F.explode(F.arrays_zip(F.col("sources").getField("ordinal").alias("ordinal"), F.col("node").alias("n"))).alias("x"))
    dealt = dealt.select("shard", F.col("x.ordinal").alias("ordinal"), F.col("x.n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("ordinal").orderBy("shard"))
    return dealt.select("ordinal", "shard", (upto - F.col("n")).alias("first"), upto.alias("last")).where("last > first")


def document_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(uid, doc_id, source, size) of each row, written once; uid tells apart rows that are equal."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, depth: int = DEPTH, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """The targets and the blocks that the mix takes, from document_sizes().

    Blocks: (uid, doc_id, ordinal, pass, block, first_word, words, shard, order_key). Words first_word to first_word + words of the document go to that shard; a document can be in both passes.

    A null text or one without words has no blocks; a null source is a source, the last; equal rows are rows of their own; an empty table gives no blocks. The permutation hangs on (seed, source, document id, size), so reruns agree.
    """
    goals = written(targets(sizes, weights, share, cap), "mix-targets")
    if (n := goals.count()) > SOURCES:
        raise ValueError(f"a mix has {SOURCES} sources at most, this one has {n}")
    blocks = sizes.where("size > 0").withColumn("block", F.explode(F.sequence(_zero(), F.floor((F.col("size") - 1) / block))))
    blocks = blocks.withColumn("words", F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block))
    blocks = blocks.withColumn("key", F.xxhash64(F.lit(seed), "source", "doc_id", "size"))
    blocks = blocks.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 40), F.lit(BUCKETS)))
    blocks = blocks.join(goals.select(F.col("source").alias("s"), "ordinal", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    counts = blocks.groupBy("ordinal", "bucket").agg(F.sum("words").alias("bucket_words"), F.count(F.lit(1)).alias("bucket_blocks"))
    upto = W.partitionBy("ordinal").orderBy("bucket")
    source = W.partitionBy("ordinal")
    starts = counts.select("ordinal", "bucket", (F.sum("bucket_words").over(upto) - F.col("bucket_words")).alias("w0"), (F.sum("bucket_blocks").over(upto) - F.col("bucket_blocks")).alias("r0"), F.sum("bucket_blocks").over(source).alias("source_blocks"))
    inside = W.partitionBy("ordinal", "bucket").orderBy("key", "doc_id", "uid", "block").rowsBetween(W.unboundedPreceding, 0)
    ranked = blocks.withColumns({"w": F.sum("words").over(inside) - F.col("words"), "r": F.row_number().over(inside) - 1}).join(starts, ["ordinal", "bucket"])
    quota = F.round("target").cast("long")
    ranked = ranked.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(-(-cap // 1)) - 1)))))
    ranked = ranked.withColumn("rank", F.col("pass") * F.col("source_blocks") + F.col("r0") + F.col("r"))
    ranked = ranked.withColumn("taken", F.least(F.col("words"), quota - (F.col("pass") * F.col("source_size") + F.col("w0") + F.col("w")))).where("taken > 0")
    drawn = written(ranked.select("uid", "doc_id", "ordinal", "pass", "block", (F.col("block") * block).alias("first_word"), F.col("taken").alias("words"), "rank", "key"), "mix-blocks")
    quotas = drawn.groupBy("ordinal").agg(F.count(F.lit(1)).alias("quota"))
    deal = split_quotas(quotas, depth, seed).groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("deal"))
    shard = F.element_at(F.filter("deal", lambda x: x["last"] > F.col("rank")), 1)["shard"]
    out = drawn.join(deal, "ordinal").withColumn("shard", shard).withColumn("order_key", F.xxhash64(F.lit(seed + 1), "key", "pass", "shard"))
    return goals, out.select("uid", "doc_id", "ordinal", "pass", "block", "first_word", "words", "shard", "order_key")


def per_document(sizes: DataFrame, goals: DataFrame, blocks: DataFrame) -> DataFrame:
    """What the mix takes of each document."""
    taken = blocks.groupBy("uid").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_blocks"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    out = sizes.join(goals.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).join(taken, "uid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), "first_shard", "last_shard")


def _runs(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """mixed_runs() with df's columns numbered."""
    plain, at = numbered(df)
    text = at[text_col]
    marked = written(plain.withColumn("_uid", F.monotonically_increasing_id()), "mix-documents")
    sizes = written(marked.select(F.col("_uid").alias("uid"), F.col(at[id_col]).alias("doc_id"), F.col(at[source_col]).cast("string").alias("source"), n_words(F.col(text)).alias("size")), "mix-sizes")
    _, blocks = mix(sizes, seed=seed, block=block, depth=depth)
    runs = blocks.groupBy(F.col("uid").alias("_uid"), "pass", F.col("shard").alias("_shard"), F.col("order_key").alias("_order")).agg(F.min("first_word").cast("int").alias("_first"), F.sum("words").cast("int").alias("_words"))
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"({_PIECE})"), F.lit(1))
    whole = (F.col("_first") == 0) & (F.col("_words") == n_words(F.col(text)))
    # the white space at a text's end goes with its last word
    cut = F.transform(F.array(pieces), lambda p: F.array_join(F.slice(p, F.col("_first") + 1, F.when(F.col("_first") + F.col("_words") + 1 == F.size(p), F.col("_words") + 1).otherwise(F.col("_words"))), ""))[0]
    return marked.join(runs, "_uid").withColumn(text, F.when(whole, F.col(text)).otherwise(cut)).select(*plain.columns, "_shard", "_order")


def mixed_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 23, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """df's columns and (_shard, _order): a row for each run of words that one shard takes of a document in one pass, its text cut to those words as the document has them, white space and all: a document's runs of a pass, joined, are what the pass took of it.

    Nulls: a row without words or with a null text is in no mix; a null source is a source. Equal rows are rows of their own. An empty table gives no rows. df is read twice, so it has to be a stored table or cheap; its columns may have any names but _shard and _order.
    """
    return _runs(df, id_col, text_col, source_col, seed, block, depth).toDF(*df.columns, "_shard", "_order")


def in_order(runs: DataFrame) -> DataFrame:
    """The runs dealt to tasks by shard and by pieces of the order key, so that no task holds a whole shard, and sorted there."""
    return runs.withColumn("_piece", F.pmod(F.shiftright("_order", 48), F.lit(PIECES))).repartition("_shard", "_piece").sortWithinPartitions("_shard", "_order").drop("_piece")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 23) -> DataFrame:
    """The mix with df's columns, each task's rows in the order of shards and, within a shard, of order keys; see mixed_runs() for the rows, and for nulls, ties and empty tables. df's columns may have any names."""
    runs = in_order(_runs(df, id_col, text_col, source_col, seed))
    return runs.drop("_shard", "_order").toDF(*df.columns)


def write_mix(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 23) -> None:
    """Writes the mix to a folder for each output shard (shard=0 and so on), each file in the order of order keys. As mixed_runs() otherwise; df must have no column `shard` or `order_key`."""
    runs = mixed_runs(df, id_col, text_col, source_col, seed)
    in_order(runs).withColumnsRenamed({"_shard": "shard", "_order": "order_key"}).write.partitionBy("shard").parquet(path)


def op2_mixing(spark, sf_dir):
    sizes = document_sizes(table(spark, sf_dir, "documents"))
    return per_document(sizes, *mix(sizes))
