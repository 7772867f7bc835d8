"""Quality rules: a learned decision list over text statistics (DataFrame functions only).

Statistics are native column expressions. Sequential covering learns the list from labelled statistics: it grows a conjunction of thresholds that best separates rejected from kept rows, prunes it on rows held out, keeps it if it is precise there, removes what it covers, and goes on. The list becomes one ordered
Spark conditional expression. The learner runs on the driver over at most SAMPLE_ROWS labelled rows of numbers (a documented bound); the statistics and the verdicts cover all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Labelled rows that the learner takes, at most, by the smallest hash of their id; a label beyond that number is not used for fitting.
SAMPLE_ROWS = 20_000
#: A rule must have this precision on the rows held out, and cover this many rejected rows of those it grew on.
PRECISION, SUPPORT = 0.97, 8
#: Base rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
NGRAM = 5
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "mark_share", "pipe_share", "digit_share", "distinct_word_share")
_BLANK = r"[\x20\x09-\x0D]+"


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once per row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text, none if it is null."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def repeated_words(words: Column, n: int = NGRAM) -> Column:
    """Words that stand in an n-word window which the text has twice or more.

    Windows are 64-bit hashes of their words' hashes. Sorting them with their places brings equal ones together; the places that have an equal neighbour, in order, each cover the words up to the next such place, n at most.
    """

    def covered(h: Column) -> Column:
        def neighbours(s: Column) -> Column:
            alike = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
            return _bound(F.array_sort(F.filter(alike, lambda x: x.isNotNull())), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x))

        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bound(placed, neighbours))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.when(F.size(w) > n, _bound(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])), covered)).otherwise(F.lit(0).cast("long"))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), windows)


def statistics_of(text: Column) -> Column:
    """All statistics of a text as one struct."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def all_of(t: Column, w: Column, x: Column) -> Column:
        without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), without("#*$%&|<>").alias("n_symbols"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"), F.size(x).cast("long").alias("n_lines"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), without("!?").alias("n_marks"), without("|").alias("n_pipes"), without("0123456789").alias("n_digits"),
        )

    return _bound(text, lambda t: _bound(words_of(t), lambda w: _bound(lines(t), lambda x: all_of(t, w, x))))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics for each row of df.

    A null text is like an empty one: no words, all counts 0. Repeated rows stay. Other columns of df are not read.
    """
    return df.select(F.col(id_col).alias("doc_id"), statistics_of(F.col(text_col)).alias("q")).select("doc_id", "q.*")


def features() -> dict[str, Column]:
    """What the rules compare, from the columns of statistics()."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    out = {
        "n_words": F.col("n_words"), "chars_per_word": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars, "mark_share": F.col("n_marks") / words, "pipe_share": F.col("n_pipes") / words, "digit_share": F.col("n_digits") / chars, "distinct_word_share": F.col("n_distinct_words") / words,
    }
    return {k: v.cast("double") for k, v in out.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass
class Rule:
    """Rejects the rows that meet all conditions (feature, above, threshold)."""

    conditions: list[tuple[str, bool, float]]
    precision: float = 0.0
    covered: int = 0

    def meets(self, row: dict) -> bool:
        return all(row[f] > t if above else row[f] <= t for f, above, t in self.conditions)

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            out = out & ((values[f] > F.lit(t)) if above else (values[f] <= F.lit(t)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:g}" for f, above, t in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rejects(self, row: dict) -> bool:
        return any(r.meets(row) for r in self.rules)

    def verdict(self) -> Column:
        """The number of the first rule that a row meets, null if none: one ordered conditional expression."""
        values, out = features(), None
        for i, r in enumerate(self.rules):
            out = F.when(r.column(values), F.lit(i)) if out is None else out.when(r.column(values), F.lit(i))
        return F.lit(None).cast("int") if out is None else out


def _thresholds(values: list[float], most: int = 24) -> list[float]:
    """Between neighbouring quantiles of the rejected rows' values, at both ends, and below all of them."""
    v = sorted(set(values))
    if len(v) > most:
        v = [v[round(i * (len(v) - 1) / (most - 1))] for i in range(most)]
    return sorted({float(f"{(a + b) / 2:.6g}") for a, b in zip(v, v[1:])} | ({v[0] - 1e-9, v[0], v[-1]} if v else set()))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """The information gained by narrowing (p0 rejected, n0 kept) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def _grow(bad: list[dict], good: list[dict], without: set[tuple[str, bool]], most: int = 4) -> Rule:
    """The rule that gains most, condition by condition; its first condition is on none of `without`."""
    rule = Rule([])
    while good and len(rule.conditions) < most:
        best, at = 0.0, None
        for f in FEATURES:
            b, g = sorted(r[f] for r in bad), sorted(r[f] for r in good)
            for t in _thresholds(b):
                from bisect import bisect_right

                p_low, n_low = bisect_right(b, t), bisect_right(g, t)
                for above, p, n in ((False, p_low, n_low), (True, len(b) - p_low, len(g) - n_low)):
                    if not rule.conditions and (f, above) in without:
                        continue
                    if p >= SUPPORT and (gain := _gain(p, n, len(bad), len(good))) > best + 1e-9:
                        best, at = gain, (f, above, t)
        if at is None:
            break
        f, above, t = at
        # the middle of the gap that the threshold lies in: the same rows are told apart, and new ones near either side fall with their neighbours
        values = [r[f] for rows in (bad, good) for r in rows]
        low, high = max((v for v in values if v <= t), default=t), min((v for v in values if v > t), default=t)
        at = (f, above, (low + high) / 2)
        rule.conditions.append(at)
        bad, good = ([r for r in rows if Rule([at]).meets(r)] for rows in (bad, good))
    return rule


def _score(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[float, int, int]:
    p, n = sum(map(rule.meets, bad)), sum(map(rule.meets, good))
    return (p - n) / (p + n) if p + n else -1.0, p, n


def learn(rows: list[dict], precision: float = PRECISION, most: int = 16) -> DecisionList:
    """Sequential covering over rows with FEATURES, `bad` and a `fold` from 0 to 2: folds 0 and 1 grow, fold 2 prunes and judges. A rule that is not precise enough is dropped, and the next one starts from another condition. No rejected or no kept rows: an empty list, which keeps all."""
    out, without = DecisionList(), set()
    grow, held = [r for r in rows if r["fold"] != 2], [r for r in rows if r["fold"] == 2]
    good, held_good = [r for r in grow if not r["bad"]], [r for r in held if not r["bad"]]
    bad, held_bad = [r for r in grow if r["bad"]], [r for r in held if r["bad"]]
    while len(bad) >= SUPPORT and good and len(out.rules) < most:
        rule = _grow(bad, good, without)
        if not rule.conditions:
            break
        while len(rule.conditions) > 1:  # drops final conditions while that is no worse on the rows held out
            less = Rule(rule.conditions[:-1])
            if _score(less, held_bad, held_good)[0] < _score(rule, held_bad, held_good)[0]:
                break
            rule = less
        _, p, n = _score(rule, held_bad, held_good)
        _, grown, grown_n = _score(rule, bad, good)
        if not p or p < precision * (p + n) or grown < SUPPORT or grown < precision * (grown + grown_n):
            without.add(rule.conditions[0][:2])
            continue
        rule.precision, rule.covered = p / (p + n), grown + p
        out.rules.append(rule)
        bad, held_bad, good, held_good = ([r for r in x if not rule.meets(r)] for x in (bad, held_bad, good, held_good))
    return out


def label_sample(labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """(doc_id, quality, h) of at most sample_rows labelled documents. Null ids and labels are none; a document with more labels counts by the lowest."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").limit(sample_rows)


def fit(stats: DataFrame, sample: DataFrame) -> DecisionList:
    """Learns the list from the rows of stats that label_sample() covers; quality 0 is to be rejected. Rows that fail the base rules are not learned from: they are gone before the list."""
    rows = stats.where(~base_failed()).join(F.broadcast(sample), "doc_id").select((F.col("quality") == 0).alias("bad"), F.pmod("h", F.lit(3)).alias("fold"), *[v.alias(k) for k, v in features().items()])
    order = ["fold", *FEATURES, "bad"]
    return learn(sorted((r.asDict() for r in rows.collect()), key=lambda r: [r[c] for c in order]))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """stats with base_failed, rule (the number of the rule that rejects) and kept."""
    out = stats.withColumns({"base_failed": base_failed(), "rule": rules.verdict()})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that the base rules and the list learned from labels keep, all columns. df must be a stored table, since it is read twice."""
    sample = label_sample(labels)
    known = df.join(F.broadcast(sample.select(F.col("doc_id").alias(id_col))), id_col, "left_semi")
    rules = fit(written(statistics(known, id_col, text_col), "quality"), sample)
    # the row number keeps the statistics from being computed once for each condition that reads them
    judged = df.select(F.struct("*").alias("_row"), statistics_of(F.col(text_col)).alias("_q"), F.monotonically_increasing_id().alias("_n")).select("_row", "_q.*", "_n")
    return judge(judged, rules).where("kept").select("_row.*")


def op8_quality_rules(spark, sf_dir):
    stats = written(statistics(table(spark, sf_dir, "documents")), "quality")
    out = judge(stats, fit(stats, label_sample(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
