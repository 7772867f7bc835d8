"""Settings, query rewriting and continuous ingest."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import load_settings
from lodestar.operators import rewrite as Q
from lodestar.operators.chunkers import chunk_recursive, chunk_semantic
from lodestar.operators.index import search_text
from lodestar.operators.retrieve import hash_embed
from lodestar.sources.readers import read_csv
from lodestar.streaming.ingest import SCHEMA, current, ingest


def test_settings(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("pipeline: {chunker: fixed, reranker: null, index: nothing}\nchunker: {fixed: {chunk_size: 10, chunk_overlap: 2}}\n")
    s = load_settings(str(path))
    assert s.get("chunker", "fixed", "chunk_size") == 10
    assert s.get("chunker", "fixed", "chunk_size", "more", default=3) == 3 and s.get("none") is None
    docs = spark.createDataFrame([(1, "abcdefghijklmnopqrst")], "doc_id long, text string")
    assert s.stage("chunker")(docs).agg(F.max("chunk_size_chars")).first()[0] == 10
    assert s.stage("reranker") is None and s.stage("loader") is None
    with pytest.raises(ValueError, match="unknown index"):
        s.stage("index")
    path.write_text("")
    with pytest.raises(ValueError, match="no section"):
        load_settings(str(path))


def test_read_csv_keeps_the_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\nzeta,1\nalpha,2\n"mid\ndle",\n')
    (tmp_path / "b.csv").write_text("name,n\nonly,7\n")
    rows = {(r.source[-5:], r.row_index): r.content for r in read_csv(spark, str(tmp_path), min_chars=1).collect()}
    assert rows == {("a.csv", 0): "name: zeta | n: 1", ("a.csv", 1): "name: alpha | n: 2", ("a.csv", 2): "name: mid\ndle", ("b.csv", 0): "name: only | n: 7"}
    files = {r.source[-5:]: r for r in read_csv(spark, str(tmp_path), "file", max_rows=2).collect()}
    assert files["a.csv"].content == "| name | n |\n| --- | --- |\n| zeta | 1 |\n| alpha | 2 |" and (files["a.csv"].row_count, files["a.csv"].column_count) == (2, 2)
    assert files["b.csv"].row_count == 1
    with pytest.raises(ValueError, match="strategy"):
        read_csv(spark, str(tmp_path), "page")


def _semantic(text, vectors, percentile, low, high):
    """Chunks by the specification, in plain Python."""
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text.strip()) if s.strip()]
    if len(parts) < 2:
        return [text.strip()] if text.strip() else []
    like = [sum(a * b for a, b in zip(vectors[x], vectors[y])) for x, y in zip(parts, parts[1:])]
    cut, groups = np.percentile(like, 100 - percentile), [[parts[0]]]
    for s, v in zip(parts[1:], like):
        if v < cut:
            groups.append([])
        groups[-1].append(s)
    whole = [" ".join(g) for g in groups]
    out, cur = [], None
    for p in [g[i : i + high] for g in whole for i in range(0, len(g), high)]:
        if cur is not None and len(cur) < low:
            cur += " " + p
        else:
            out, cur = out + [cur] * (cur is not None), p
    return out + [cur]


def test_chunk_semantic(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "  ", "One sentence only", "A b. C d! E f? G h."] + [" ".join(" ".join(rng.choice(["red", "blue", "sky", "stone", "river"], rng.integers(1, 9))).capitalize() + "." for _ in range(int(n))) for n in rng.integers(2, 60, 25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = sorted({s.strip() for x in texts if x for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", x.strip())})
    vectors = {r.s: r.v for r in spark.createDataFrame([(s,) for s in parts], "s string").select("s", hash_embed(F.col("s")).alias("v")).collect()}
    got = {}
    for r in chunk_semantic(df, hash_embed, 80.0, 30, 90).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
        assert texts[r.doc_id][r.start_index : r.end_index] == r.content or r.content not in texts[r.doc_id][r.start_index :]
    assert got == {i: want for i, x in enumerate(texts) if x and (want := _semantic(x, vectors, 80.0, 30, 90))}


def test_search_text_reads_once(spark):
    """One scan of the texts; the exchange of counted rows is used again."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    queries = spark.createDataFrame([("a", "the license of the")], "query_id string, query string")
    plan = search_text(df, queries)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("FileScan") - text.count("ReusedExchange") <= 1 and "ReusedExchange" in text


def test_rewritten(spark):
    queries = spark.createDataFrame([("a", "what is it"), ("b", "who")], "query_id string, query string")
    reply = lambda p: F.when(F.contains(p, F.lit("who")), F.lit("  ")).otherwise(F.concat(F.lit(" Re: "), F.substring_index(p, "Question: ", -1)))
    assert [tuple(r) for r in Q.rewritten(queries, reply, "hyde").orderBy("query_id").collect()] == [("a", "Re: what is it", "what is it", "hyde"), ("b", "who", "who", "hyde")]
    lines = lambda p: F.when(F.contains(p, F.lit("who")), F.lit(None).cast("string")).otherwise(F.lit("1. the first other way\n- x\n2) the second other way"))
    assert [tuple(r) for r in Q.variants(queries, lines).orderBy("query_id", "variant").collect()] == [("a", 0, "what is it"), ("a", 1, "the first other way"), ("a", 2, "the second other way"), ("b", 0, "who")]
    with pytest.raises(ValueError):
        Q.ask(F.lit("x"), "else")


def test_method_diff(spark):
    frame = lambda *r: spark.createDataFrame(list(zip("abc", r)), "query_id string, recall_at_1 double")
    got = Q.method_diff([frame(0.0, 1.0, 0.0), frame(0.0, 0.0, 0.0)], frame(1.0, 1.0, 0.0))
    assert {r.query_id: r.verdict for r in got.collect()} == {"a": "fused wins", "b": "no gain", "c": "all miss"}


def test_ingest(spark, tmp_path):
    arrivals, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        query = ingest(spark, arrivals, table, checkpoint, chunk_recursive)
        query.awaitTermination()

    read = lambda: {(r.doc_id, r.version, r.n) for r in current(spark, table).groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert current(spark, table) is None
    arrive((1, 1, "one"), (1, 2, "word " * 300), (2, 1, "two"), (3, 1, None))
    first = read()
    assert {x[:2] for x in first} == {(1, 2), (2, 1)} and dict((d, n) for d, _, n in first)[1] > 1
    arrive((1, 1, "late and old"), (2, 2, ""), (3, 2, "three"))
    assert read() == {x for x in first if x[0] == 1} | {(3, 2, 1)}


def test_embed_batches_takes_whole_texts(spark, tmp_path):
    """Against tokens exploded and added up, on texts longer than any prefix, with a blank and a null one."""
    from lodestar.functions.text import tokenize
    from lodestar.plans.queries import QUERIES

    texts = [(1, "alpha beta " * 300 + " ".join(f"late{i}" for i in range(3000))), (2, "short one"), (3, " \n"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.embedding for r in QUERIES["embed_batches"](spark, str(tmp_path)).collect()}
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.explode(tokenize(F.col("text"))).alias("w")).select("doc_id", F.xxhash64("w").alias("h")).collect()
    want = {1: [0.0] * 64, 2: [0.0] * 64}
    for r in rows:
        want[r.doc_id][r.h % 64] += 1 - 2 * ((r.h >> 32) % 2)
    for i, v in want.items():
        n = sum(x * x for x in v) ** 0.5
        assert got[i] == pytest.approx([x / n for x in v], abs=2e-6)
    assert got[3] is None and got[4] is None
