"""Approximate vector search against exact search, every vector whose id is divisible by 50 as a query."""

import pytest

from lodestar.operators.index import in_blocks, query_blocks, recall
from lodestar.plans.queries import QUERIES, every_50th


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_at_5(spark, sf):
    wanted = QUERIES["dense_topk_all"](spark, sf).cache()
    assert wanted.select("query_id").distinct().count() == every_50th(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").count()
    for name in ("ivf_search_all", "ann_lsh"):
        assert recall(QUERIES[name](spark, sf), wanted) >= 0.9


def test_blocks_take_each_query_once(spark):
    queries = spark.createDataFrame([(f"q{i}",) for i in range(100)], "query_id string")
    assert len(query_blocks(queries, 30)) == 4
    assert sorted(r.query_id for b in query_blocks(queries, 30) for r in b.collect()) == sorted(f"q{i}" for i in range(100))
    assert in_blocks(lambda q: q, queries).count() == 100
