"""Connected components of a table of edges, by smallest labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, root) of each vertex that an edge (a, b) has; root is the smallest vertex of its component. Null ends are no edges; loops and repeated edges don't matter.

    In each round a vertex takes the smallest label of its neighbours and then that label's own label, so labels run together in a number of rounds that grows with the logarithm of a component's width. Each round is a written table. Labels and edges stay distributed; only the sum of the labels comes to the driver.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")  # read twice below: both readings must see the same edges
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    total = lambda t: t.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    for _ in range(most):
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("further"))
        labels = written(step.join(jump, "root").select("v", F.least("root", "further").alias("root")), "labels")
        after = total(labels)
        if after == before:
            return labels
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")
