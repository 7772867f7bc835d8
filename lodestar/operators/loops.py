"""Retrievers that a model steers. A model is a function from prompt column to reply column, a search a function from (query_id, query) and k to (query_id, chunk_id, score, rank, content); both run for all queries at once.

A loop's rounds are bounded by a parameter, never by rows. Rounds are settled, so each is computed once. A query without hits is absent from the result; a null query finds nothing and asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_react, strip
from .index import top_k
from .retrieve import context_share, keep_relevant
from .store import settled

Model = Callable[[Column], Column]
Search = Callable[[DataFrame, int], DataFrame]

#: What the model is asked; names in braces are replaced.
PROMPTS = {
    "gate": "Does answering this need passages from documents? Reply YES or NO.\nQuestion: {query}",
    "relevant": "Does the passage help to answer the question? Reply YES or NO.\nQuestion: {query}\nPassage: {passage}",
    "grade": "Do the passages answer the question? Reply CORRECT, AMBIGUOUS or INCORRECT.\nQuestion: {query}\nPassages:\n{passages}",
    "retry": "The passages found for this query did not help. Write a better query, in one line.\nQuery: {query}",
    "follow": "Write the next query that is needed to answer the question, in one line, or STOP.\nQuestion: {query}\nFound so far:\n{passages}",
    "plan": "Reply with two lines, 'Thought: ...' and 'Action: tool(arguments)', or 'Action: FINISH'. Tools: {tools}.\nQuestion: {query}\nSteps so far:\n{history}",
}
#: Characters of a passage that a prompt shows when it grades, judges one for a loop or for a gate, and asks what follows; passages that the last shows.
GRADED, LOOPED, GATED, FOLLOWED, LAST = 200, 300, 400, 200, 3


def asked(name: str, **values: Column) -> Column:
    out = F.lit(PROMPTS[name])
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return out


def says_yes(reply: Column) -> Column:
    return F.coalesce(F.startswith(F.upper(strip(reply)), F.lit("YES")), F.lit(False))


def first_line(reply: Column) -> Column:
    """The first line that is not blank; null if there is none."""
    return F.get(F.filter(F.transform(F.split(reply, "\n"), strip), lambda x: x != ""), 0)


def _found(search: Search, queries: DataFrame, k: int) -> DataFrame:
    return search(queries.select("query_id", "query"), k).select("query_id", "chunk_id", "score", "rank", "content").join(queries.select("query_id", "query"), "query_id")


def _passages(found: DataFrame, k: int, length: int) -> DataFrame:
    """(query_id, passages): the first k, numbered, in rank order; a query has k at most."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, length).alias("c"))))
    return found.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_join(F.transform(rows, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["c"])), "\n\n").alias("passages"))


def self_checking(queries: DataFrame, search: Search, relevant: Model, gate: Model | None = None, k: int = 5, at_least: int = 1) -> DataFrame:
    """Searches for the queries that the gate lets pass (all without one), keeps of 2k hits the first k that are judged relevant, or the first at_least hits if fewer are: (query_id, query, chunk_id, score, rank, content, relevant, fallback)."""
    wanted = queries if gate is None else queries.where(says_yes(gate(asked("gate", query=F.col("query")))))
    found = _found(search, wanted, 2 * k)
    return keep_relevant(found, says_yes(relevant(asked("relevant", query=F.col("query"), passage=F.substring("content", 1, GATED)))), k, at_least)


def read_grade(reply: Column, share: Column) -> Column:
    """CORRECT, AMBIGUOUS or INCORRECT out of a reply, AMBIGUOUS if it says none; what is called correct while few of the query's words occur is not."""
    up = F.upper(F.coalesce(reply, F.lit("")))
    has = lambda x: F.contains(up, F.lit(x))
    return F.when(has("INCORRECT"), F.lit("INCORRECT")).when(has("CORRECT"), F.when(share < 0.3, F.lit("INCORRECT")).otherwise(F.lit("CORRECT"))).otherwise(F.lit("AMBIGUOUS"))


def corrective(queries: DataFrame, search: Search, grade: Model, relevant: Model, retry: Model, k: int = 5, max_corrections: int = 2) -> DataFrame:
    """(query_id, query, chunk_id, score, rank, crag_action, crag_attempt). Of 2k hits the first k are graded. Correct ones are the result; of ambiguous ones those judged relevant, if they are k // 2 or more; else the query is written anew and searched again, and the last attempt's first k hits are the result. A blank new query leaves the old one. Passages are judged only where the grade is ambiguous."""
    open_, done = settled(queries.select("query_id", "query")), None
    for attempt in range(1, max_corrections + 2):
        found = settled(_found(search, open_, 2 * k))
        share = context_share(found, k)
        graded = _passages(found, k, GRADED).join(open_, "query_id").join(share, "query_id")
        graded = settled(graded.select("query_id", read_grade(grade(asked("grade", query=F.col("query"), passages=F.col("passages"))), F.col("share")).alias("grade")))
        doubtful = found.join(graded.where("grade = 'AMBIGUOUS'").select("query_id"), "query_id")
        good = doubtful.where(says_yes(relevant(asked("relevant", query=F.col("query"), passage=F.substring("content", 1, LOOPED)))))
        good = settled(good.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("query_id"))).drop("rank", "content"))
        good = top_k(good.where(F.col("n") >= k // 2).drop("n"), k).withColumn("crag_action", F.lit("ambiguous_filtered"))
        # where not one passage need be relevant, an empty result is a result
        settled_ids = graded.where("grade = 'CORRECT'").select("query_id").unionByName(graded.where("grade = 'AMBIGUOUS'").select("query_id") if k < 2 else good.select("query_id").distinct())
        right = found.where(F.col("rank") <= k).join(graded.where("grade = 'CORRECT'").select("query_id"), "query_id").drop("content").withColumn("crag_action", F.lit("correct"))
        step = right.unionByName(good)
        left = graded.select("query_id").join(settled_ids, "query_id", "left_anti")
        if attempt > max_corrections:
            step = step.unionByName(found.where(F.col("rank") <= k).join(left, "query_id").drop("content").withColumn("crag_action", F.lit("fallback")))
        step = settled(step.select("query_id", "query", "chunk_id", "score", "rank", "crag_action", F.lit(attempt).alias("crag_attempt")))
        done = step if done is None else done.unionByName(step)
        if attempt <= max_corrections:
            again = first_line(retry(asked("retry", query=F.col("query"))))
            open_ = settled(open_.join(left, "query_id").select("query_id", F.coalesce(again, F.col("query")).alias("query")))
            if open_.isEmpty():
                break
    return done


def multi_hop_search(queries: DataFrame, search: Search, follow: Model, max_hops: int = 3, fetch_k: int = 3, decay: float = 0.7, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, hop, hop_query, rank). Each hop's scores weigh decay ** (hop - 1); a chunk keeps its largest and the earliest hop that has it. After a hop the model sees the last passages found and gives the next query; a blank reply or one that starts with STOP ends the query's hops."""
    state = settled(queries.select("query_id", "query", F.col("query").alias("hop_query"), F.array().cast("array<string>").alias("seen")))
    out = None
    for hop in range(1, max_hops + 1):
        found = _found(search, state.select("query_id", F.col("hop_query").alias("query")), fetch_k)
        found = settled(found.withColumnRenamed("query", "hop_query"))
        step = found.select("query_id", "chunk_id", F.round(F.col("score") * decay ** (hop - 1), 6).alias("score"), F.lit(hop).alias("hop"), "hop_query")
        out = step if out is None else out.unionByName(step)
        if hop == max_hops:
            break
        rows = F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, FOLLOWED).alias("c"))))
        new = found.groupBy("query_id").agg(F.transform(rows, lambda s: s["c"]).alias("new"))
        state = state.join(new, "query_id", "left").withColumn("seen", F.concat("seen", F.coalesce("new", F.array().cast("array<string>"))))
        state = state.withColumn("seen", F.slice("seen", F.greatest(F.size("seen") - LAST + 1, F.lit(1)), LAST))
        reply = first_line(follow(asked("follow", query=F.col("query"), passages=F.array_join("seen", "\n---\n"))))
        state = settled(state.select("query_id", "query", reply.alias("hop_query"), "seen").where(F.col("hop_query").isNotNull() & ~F.startswith(F.upper("hop_query"), F.lit("STOP"))))
        if state.isEmpty():
            break
    best = out.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("hop")).alias("h"), "hop_query")).alias("m"))
    return top_k(best.select("query_id", "chunk_id", "m.score", (-F.col("m.h")).alias("hop"), "m.hop_query"), k)


def observation(found: DataFrame) -> DataFrame:
    """(query_id, seen): how many chunks a tool has found, and how the first two begin."""
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 2, F.struct("rank", strip(F.substring("content", 1, 60)).alias("c"))))), lambda s: s["c"])
    return found.groupBy("query_id").agg(F.concat(F.lit("Found "), F.count(F.lit(1)).cast("string"), F.lit(" chunks. "), F.array_join(heads, "; ")).alias("seen"))


def unquoted(args: Column) -> Column:
    return F.regexp_replace(strip(args), "^[\"']+|[\"']+$", "")


def filtered_tool(search: Search, by: str, fetch_k: int = 3, default: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A tool whose arguments are a query and a value: of 3 fetch_k hits the first fetch_k with that value in `by`, a column of the search's result."""

    def run(asked_for: DataFrame) -> DataFrame:
        parts = F.split("args", ",")
        both = asked_for.select("query_id", F.coalesce(F.nullif(unquoted(F.get(parts, 0)), F.lit("")), F.col("query")).alias("query"), F.coalesce(unquoted(F.get(parts, 1)), F.lit(default)).alias("_value"))
        hits = search(both.select("query_id", "query"), 3 * fetch_k).join(both.select("query_id", "_value"), "query_id").where(F.col(by) == F.col("_value"))
        return top_k(hits.drop("rank"), fetch_k).select("query_id", "chunk_id", "score", "rank", "content")

    return run


def search_tool(search: Search, fetch_k: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A tool whose argument is the query; without one it takes the question."""

    def run(asked_for: DataFrame) -> DataFrame:
        wanted = asked_for.select("query_id", F.coalesce(F.nullif(unquoted(F.col("args")), F.lit("")), F.col("query")).alias("query"))
        return search(wanted, fetch_k).select("query_id", "chunk_id", "score", "rank", "content")

    return run


def agentic(queries: DataFrame, plan: Model, tools: dict[str, Callable[[DataFrame], DataFrame]], max_steps: int = 4, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, agentic_step, agentic_action, rank), and (query_id, history). In each step the model sees the question and what was done, and names a tool and its arguments; a tool takes (query_id, query, args). A blank reply or FINISH ends a query's steps; an unknown tool finds nothing and is told so. A chunk has the score of the last step that found it."""
    state = settled(queries.select("query_id", "query", F.lit("").alias("history")))
    histories, hits = [], None
    for step in range(1, max_steps + 1):
        reply = plan(asked("plan", query=F.col("query"), history=F.when(F.col("history") == "", F.lit("(none)")).otherwise(F.col("history")), tools=F.lit(", ".join(tools))))
        said = settled(state.withColumn("_reply", F.coalesce(reply, F.lit(""))))
        said = said.select("query_id", "query", "history", *[v.alias(f"_{n}") for n, v in parse_react(F.col("_reply"), F.col("query")).items()])
        said = settled(said.withColumn("_tool", F.when(F.upper("_tool") == "FINISH", F.lit("FINISH")).otherwise(F.lower(strip(F.col("_tool"))))))
        over = said.where("_tool in ('', 'FINISH')")
        thought = F.concat(F.lit("\nThought: "), "_thought")
        histories.append(over.select("query_id", F.when(F.col("_tool") == "FINISH", F.concat("history", thought, F.lit("\nAction: FINISH"))).otherwise(F.col("history")).alias("history")))
        active = said.where("_tool not in ('', 'FINISH')")
        seen = None
        for name, tool in tools.items():
            found = settled(tool(active.where(F.col("_tool") == name).select("query_id", "query", F.col("_args").alias("args"))))
            seen = observation(found) if seen is None else seen.unionByName(observation(found))
            rows = found.select("query_id", "chunk_id", "score", F.lit(step).alias("agentic_step"), F.lit(name).alias("agentic_action"))
            hits = rows if hits is None else hits.unionByName(rows)
        nothing = F.when(F.col("_tool").isin(*tools), F.lit("Found 0 chunks. ")).otherwise(F.concat(F.lit("Unknown tool: "), "_tool"))
        told = F.concat("history", thought, F.lit("\nAction: "), "_tool", F.lit("("), "_args", F.lit(")\nObservation: "), F.coalesce("seen", nothing))
        state = settled(active.join(seen, "query_id", "left").select("query_id", "query", told.alias("history")))
        if state.isEmpty():
            break
    history = state.select("query_id", "history")
    for part in histories:
        history = history.unionByName(part)
    last = hits.groupBy("query_id", "chunk_id").agg(F.max(F.struct("agentic_step", "score", "agentic_action")).alias("m")).select("query_id", "chunk_id", "m.score", "m.agentic_step", "m.agentic_action")
    return top_k(last, k), history


#: Fixed value: the answer where there is no model.
NO_MODEL = "I cannot generate a response — no LLM available."


def answers(prompts: DataFrame, model: Model | None = None) -> DataFrame:
    """(query_id, answer) of (query_id, prompt); without a model, or where its reply is null, the fixed sentence."""
    reply = F.lit(None).cast("string") if model is None else strip(model(F.col("prompt")))
    return prompts.select("query_id", F.coalesce(reply, F.lit(NO_MODEL)).alias("answer"))
