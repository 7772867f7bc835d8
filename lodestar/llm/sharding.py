"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

The tree has regions, racks and shards. A key starts at the root and descends: at each level every child draws ``-ln(u) / weight``, with u hashed from the key and the child's name and the weight that of all shards below the child, and the smallest draw is chosen. So a key takes a draw for each region, for each rack of its region and for each shard of its rack, not for all shards.

A child's draw hangs on nothing but its own weight. When a weight changes, keys move only between the subtree that holds the change and its siblings, level by level: into it if it gained weight, out of it if it lost some. Below a child that a key keeps and whose weights stay, nothing moves. A shard that is added with a rack and a region of its own takes keys only into itself; one that is added to a standing region
lets keys into that region by the region's draw, and these go to any shard of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Rows of one shard are numbered bucket by bucket.
SLOT_BUCKETS = 1024
#: Repeated equal rows come back out of their count in runs of this many.
RUN = 4096


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def topology(n_shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Equal shards in full regions of `racks` racks with `per_rack` shards; a shard over has a region and a rack of its own, so one more shard than full regions only takes rows into itself."""
    full = n_shards // (per_rack * racks) * per_rack * racks
    more = [Shard(i, full // (per_rack * racks) + i - full, full // per_rack + i - full) for i in range(full, n_shards)]
    return [Shard(i, i // (per_rack * racks), i // per_rack) for i in range(full)] + more


def _chosen(key: Column, level: str, children: list[tuple[int, float]], seed: int) -> Column:
    """The child with the smallest draw among (name, weight)."""

    def draw(name: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.lit(name), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("name"))

    return F.lit(children[0][0]) if len(children) == 1 else F.least(*[draw(*c) for c in children])["name"]


def _branch(of: Column, cases: dict[int, Column]) -> Column:
    """The case of the child that was chosen; only that one is evaluated."""
    (first, value), *rest = cases.items()
    if not rest:
        return value
    out = F.when(of == first, value)
    for name, value in rest[:-1]:
        out = out.when(of == name, value)
    return out.otherwise(rest[-1][1])


def shard_of(key: Column, shards: list[Shard], seed: int = 17) -> Column:
    """The shard of a key: descends from region to rack to shard by the smallest draw among siblings. A null key is a key of its own. Shards without weight take nothing."""
    shards = [s for s in shards if s.weight > 0]
    weigh = lambda of, some: sorted({getattr(s, of): sum(x.weight for x in some if getattr(x, of) == getattr(s, of)) for s in some}.items())

    def descend(levels: tuple[str, ...], some: list[Shard]) -> Column:
        level, *below = levels
        children = weigh(level, some)
        if not below:
            return _chosen(key, level, children, seed)
        under = {name: descend(tuple(below), [s for s in some if getattr(s, level) == name]) for name, _ in children}
        # the choice is computed once, then its branch alone is followed
        return F.transform(F.array(_chosen(key, level, children, seed)), lambda of: _branch(of, under))[0]

    return descend(("region", "rack", "shard"), shards)


def shard_rows(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of each row.

    Nulls: a null text is empty (size 1, checksum 0); a null id is a key like any other. The law `key` holds: with one more shard than whole regions have, rows move only into it. Rows that agree in id, size and checksum are one key with a count; they get slots next to each other.
    An empty table gives no rows. Other columns of df are not read.

    Slots are gapless from 0 in each shard without bringing a shard's rows together: rows are counted in SLOT_BUCKETS hash buckets of each shard, the counts are summed up over the buckets, and a row's slot is its bucket's start plus its place in the bucket.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    now = topology(n_shards)
    keyed = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed.withColumns({"shard": shard_of(F.col("doc_id"), now, seed), "grown_shard": shard_of(F.col("doc_id"), topology(n_shards + 1), seed), "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "text_crc32"), F.lit(SLOT_BUCKETS))})
    keyed = written(keyed, "sharding")
    counts = keyed.groupBy("shard", "bucket").agg(F.sum("n").alias("in_bucket"))
    starts = counts.select("shard", "bucket", (F.sum("in_bucket").over(W.partitionBy("shard").orderBy("bucket")) - F.col("in_bucket")).alias("start"))
    place = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = keyed.withColumn("before", F.sum("n").over(place) - F.col("n")).join(starts, ["shard", "bucket"])
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    last = F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN) - 1
    return runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("before") + F.col("run") * RUN + F.col("i")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", seed: int = 17) -> None:
    """Writes df's rows, all columns, to one folder per shard, shard=0 and so on; df must have no column `shard`. A null id is a key like any other; an empty table writes no folder."""
    df.withColumn("shard", shard_of(F.col(id_col), topology(n_shards), seed)).write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir):
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


__all__ = ["Shard", "op3_sharding", "shard_of", "shard_rows", "topology", "write_shards"]
