"""Retrievers steered by a model, trees of summaries, the vector cache and normalisation, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import loops as L
from lodestar.operators.embed import VectorCache, embed_chunks, embedding_summary
from lodestar.operators.normalize import LanguageModel, normalize_documents
from lodestar.operators.raptor import build_tree, lead_sentences, search_tree, tree_stats
from lodestar.operators.retrieve import hash_embed

CORPUS = [(1, "red apple pie", "text"), (2, "red car on a road", "table"), (3, "green apple tree", "text"), (4, "blue sky", "text"), (5, "apple", "table")]


@pytest.fixture(scope="module")
def search(spark):
    """Counts the words that query and text share."""
    corpus = spark.createDataFrame(CORPUS, "chunk_id long, content string, content_type string")

    def run(queries, k):
        both = corpus.crossJoin(F.broadcast(queries)).withColumn("score", F.size(F.array_intersect(F.split("query", " "), F.split("content", " "))).cast("double"))
        from lodestar.operators.index import top_k

        return top_k(both.where("score > 0"), k)

    return run


def queries(spark, *q):
    return spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(q)], "query_id string, query string")


def test_self_checking(spark, search):
    q = queries(spark, "red apple", "blue sky", "nothing here")
    fruit = lambda p: F.when(F.regexp_extract(p, "Passage: (.*)", 1).contains("apple"), F.lit(" yes, it does")).otherwise(F.lit("NO"))
    got = {(r.query_id, r.chunk_id, r.fallback) for r in L.self_checking(q, search, fruit, None, k=2).collect()}
    assert got == {("q0", 1, False), ("q0", 3, False), ("q1", 4, True)}
    gate = lambda p: F.when(p.contains("sky"), F.lit("Yes.")).otherwise(F.lit(None).cast("string"))
    assert {r.query_id for r in L.self_checking(q, search, fruit, gate, k=2).collect()} == {"q1"}


def test_corrective(spark, search):
    q = queries(spark, "red apple", "car", "sky above", "nothing here", "pie maybe")
    grade = lambda p: F.when(p.contains("Question: red"), F.lit("Correct")).when(p.contains("Question: car"), F.lit("INCORRECT")).when(p.contains("Question: pie"), F.lit("AMBIGUOUS")).otherwise(F.lit("well"))
    relevant = lambda p: F.when(p.contains("Passage: blue"), F.lit("YES")).otherwise(F.lit("NO"))
    retry = lambda p: F.when(p.contains("Query: car"), F.lit("\n red apple \nmore")).otherwise(F.lit(" "))
    rows = L.corrective(q, search, grade, relevant, retry, k=2, max_corrections=1).collect()
    got = {(r.query_id, r.chunk_id): (r.rank, r.crag_action, r.crag_attempt, r.query) for r in rows}
    assert got == {
        ("q0", 1): (1, "correct", 1, "red apple"), ("q0", 2): (2, "correct", 1, "red apple"),
        ("q1", 1): (1, "correct", 2, "red apple"), ("q1", 2): (2, "correct", 2, "red apple"),
        ("q2", 4): (1, "ambiguous_filtered", 1, "sky above"), ("q4", 1): (1, "fallback", 2, "pie maybe"),
    }
    assert L.corrective(q.limit(0), search, grade, relevant, retry).collect() == []


def test_multi_hop(spark, search):
    follow = lambda p: F.when(p.contains("Question: pie"), F.when(p.contains("green"), F.lit("stop now")).otherwise(F.lit("green tree"))).otherwise(F.lit(""))
    rows = L.multi_hop_search(queries(spark, "pie", "sky"), search, follow, max_hops=4).collect()
    assert {(r.query_id, r.chunk_id): (r.score, r.hop, r.hop_query, r.rank) for r in rows} == {("q0", 3): (1.4, 2, "green tree", 1), ("q0", 1): (1.0, 1, "pie", 2), ("q1", 4): (1.0, 1, "sky", 1)}


def test_agentic(spark, search):
    def plan(p):
        n = F.size(F.split(p, "Observation:"))
        first = F.when(p.contains("Question: sky"), F.lit("Thought: t\nAction: other_tool(x)")).otherwise(F.lit("Thought: look\nAction: keyword_search('apple pie')"))
        return F.when(n == 1, first).when((n == 2) & p.contains("Question: red"), F.lit("Thought: t2\nAction: filter_search(red apple, table)")).when(n == 2, F.lit("")).otherwise(F.lit("Thought: end\nAction: FINISH"))

    hits, history = L.agentic(queries(spark, "red", "sky"), plan, {"keyword_search": L.search_tool(search), "filter_search": L.filtered_tool(search, "content_type")})
    assert {(r.query_id, r.chunk_id): (r.score, r.agentic_step, r.agentic_action) for r in hits.collect()} == {
        ("q0", 1): (2.0, 1, "keyword_search"), ("q0", 3): (1.0, 1, "keyword_search"), ("q0", 2): (1.0, 2, "filter_search"), ("q0", 5): (1.0, 2, "filter_search"),
    }
    told = {r.query_id: r.history for r in history.collect()}
    assert told["q1"] == "\nThought: t\nAction: other_tool(x)\nObservation: Unknown tool: other_tool"
    assert "Observation: Found 3 chunks. red apple pie; green apple tree\nThought: t2" in told["q0"] and told["q0"].endswith("Thought: end\nAction: FINISH")


def test_answers(spark):
    p = spark.createDataFrame([("a", "x"), ("b", None)], "query_id string, prompt string")
    assert {r.answer for r in L.answers(p).collect()} == {L.NO_MODEL}
    assert {r.query_id: r.answer for r in L.answers(p, lambda c: F.concat(F.lit(" re "), c)).collect()} == {"a": "re x", "b": L.NO_MODEL}


def test_raptor(spark):
    rng = np.random.default_rng(0)
    middles = np.eye(8)[:3] * 5
    rows = [(f"c{i:02d}", i, f"t{i % 2}", f"Text {i} of {i % 3}. More.", (middles[i % 3] + rng.normal(0, 0.1, 8)).tolist()) for i in range(30)] + [("none", 99, "t0", "x", None)]
    leaves = spark.createDataFrame(rows, "chunk_id string, doc_id long, tenant_id string, content string, vec array<double>")
    nodes, edges = build_tree(leaves, lambda c: hash_embed(c, 8), most_passages=4)
    by = {r.chunk_id: r for r in nodes.collect()}
    assert {r.level: r.nodes for r in tree_stats(nodes).collect()} == {0: 30, 1: 3, 2: 1} and "none" not in by
    children = {}
    for r in edges.collect():
        children.setdefault(r.parent_id, []).append(r.child_id)
    level1 = [x for x in by if by[x].level == 1]
    assert sorted(tuple(sorted(children[x])) for x in level1) == sorted(tuple(f"c{i:02d}" for i in range(m, 30, 3)) for m in range(3))
    for x in level1:
        assert by[x].n_members == 10 and by[x].doc_id == by[min(children[x])].doc_id and len(by[x].content.split(". ")) == 4 and "More" not in by[x].content
    assert sorted(children[next(x for x in by if by[x].level == 2)]) == sorted(level1)
    asked = spark.createDataFrame([("q", middles[1].tolist())], "query_id string, qvec array<double>")
    found = search_tree(nodes, asked, 3, "t1").collect()
    assert len(found) == 3 and {r.tenant_id for r in found} == {"t1"} and all(r.doc_id % 3 == 1 for r in found if r.level == 0)
    empty, no_edges = build_tree(leaves.limit(0), hash_embed)
    assert empty.collect() == [] and no_edges.collect() == []
    assert spark.range(1).select(lead_sentences(F.lit("One. Two.\n\n---\n\nno end"))).first()[0] == "One. no end"


def test_vector_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(c):
        def one(x):
            calls.add(1)
            return [float(len(x)), 1.0]

        return F.udf(one, "array<double>")(c)

    first = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None), (5, "c"), (6, "d"), (7, "ee")], "id long, text string")
    cache = VectorCache(spark, str(tmp_path), "some/model")
    assert tuple(cache.stats().first()) == ("some/model", 0, 0)
    got = {r.id: r.embedding for r in cache.embed(first, embed).collect()}
    assert got == {1: [2, 1], 2: [3, 1], 3: [2, 1], 4: None, 5: [1, 1], 6: [1, 1], 7: [2, 1]} and calls.value == 5
    again = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "c"), (4, "new"), (5, "newer")], "id long, text string")
    assert {r.id: r.embedding for r in VectorCache(spark, str(tmp_path), "some/model").embed(again, embed).collect()} == {1: [2, 1], 2: [3, 1], 3: [1, 1], 4: [3, 1], 5: [5, 1]}
    assert calls.value == 7 and tuple(cache.stats().first()) == ("some/model", 7, 3)
    other = VectorCache(spark, str(tmp_path), "other")
    other.embed(again, embed).collect()
    cache.clear()
    assert tuple(cache.stats().first())[1:] == (0, 0) and tuple(other.stats().first())[1:] == (5, 0)


def test_embed_chunks(spark):
    df = spark.createDataFrame([(1, "some words"), (2, " \n"), (3, None)], "id long, content string")
    out = embed_chunks(df, lambda c: F.transform(hash_embed(c), lambda x: x * 3))
    assert tuple(embedding_summary(out).first()) == (1, 2, 0)
    assert tuple(embedding_summary(embed_chunks(df, lambda c: F.transform(hash_embed(c), lambda x: x * 3), normalize=False)).first()) == (1, 2, 1)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = LanguageModel.fit(docs.where("doc_id % 4 <> 0"))
    held = docs.where("doc_id % 4 = 0 and length(text) >= 50").select("doc_id", "lang", model.detect(F.col("text")).alias("g"))
    assert held.where("g.confidence >= 0.85").select(F.avg((F.col("g.lang") == F.col("lang")).cast("int"))).first()[0] > 0.9
    german = docs.where("lang = 'de' and length(text) >= 200").first().text
    rows = [(1, german, "unknown"), (2, german, None), (3, german, "xx"), (4, "kurz", ""), (5, None, None), (6, "1 2 3 " * 30, "en"), (7, "a​  b\x01\n\n\n\nc" + " zzzqq" * 20, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in normalize_documents(df, model).collect()}
    assert [got[i].lang for i in range(1, 8)] == ["de", "de", "xx", "en", "en", "en", "en"]
    assert got[7].text.startswith("a b\n\nc") and got[7].char_count == len(got[7].text) and got[5].text is None
    assert normalize_documents(df.limit(0), model).collect() == [] and LanguageModel([], {}).guess("x") == (None, 0.0)
