"""Documents made uniform: cleaned text, language, counts."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, stats

#: Languages that are looked at again; shortest text, least confidence and language without a guess.
UNSURE = ["en", "unknown", ""]
MIN_CHARS, MIN_CONFIDENCE, FALLBACK = 50, 0.85, "en"
_WORD = re.compile(r"[^\W\d_]+")


class LanguageModel:
    """Naive Bayes over lower-case words of letters, learned from texts with a language."""

    def __init__(self, languages: list[str], weights: dict[str, list[float]]):
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, df: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: int = 3000, most_languages: int = 200) -> LanguageModel:
        """Counts the words of all rows; of each language the `vocabulary` most frequent ones come to the driver, and their numbers in the others. Rows without a text or language don't count. More than most_languages is an error."""
        words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"), lambda w: w != "")
        counts = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(most_languages + 1).collect()}
        if len(totals) > most_languages:
            raise ValueError(f"more than {most_languages} languages")
        top = counts.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("_r") <= vocabulary)
        known = {(r.lang, r.word): r.n for r in counts.join(F.broadcast(top.select("word").distinct()), "word", "left_semi").collect()}
        languages, vocabulary_words = sorted(totals), sorted({w for _, w in known})
        share = lambda lang, w: math.log((known.get((lang, w), 0) + 0.5) / (totals[lang] + 0.5 * (len(vocabulary_words) + 1)))
        return cls(languages, {w: [share(lang, w) for lang in languages] for w in vocabulary_words})

    def guess(self, text: str | None) -> tuple[str | None, float]:
        """The likeliest language and its probability; words that the model lacks say nothing. Without a known word: none, 0."""
        if not text or not self.languages:
            return None, 0.0
        sums, some = [0.0] * len(self.languages), False
        for w in _WORD.findall(text.lower()):
            if found := self.weights.get(w):
                some = True
                sums = [a + b for a, b in zip(sums, found)]
        if not some:
            return None, 0.0
        best = max(sums)
        return self.languages[sums.index(best)], 1 / sum(math.exp(s - best) for s in sums)

    def detect(self, text: Column) -> Column:
        """struct<lang, confidence> of whole texts, in Arrow batches; null texts have neither."""

        @F.pandas_udf("lang string, confidence double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([self.guess(x) for x in batch], columns=["lang", "confidence"])

        return run(text)


def cleaned(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, clean(F.col(text_col)))


def with_language(model: LanguageModel, text_col: str = "text", lang_col: str = "lang", min_chars: int = MIN_CHARS, min_confidence: float = MIN_CONFIDENCE, fallback: str = FALLBACK) -> Callable[[DataFrame], DataFrame]:
    """A stage: a language that is null or unsure is guessed from a text of min_chars or more, and is the fallback where the guess is not confident. Only such texts leave the JVM."""

    def run(df: DataFrame) -> DataFrame:
        unsure = F.col(lang_col).isNull() | F.col(lang_col).isin(UNSURE)
        out = df.withColumn("_guess", model.detect(F.when(unsure & (F.length(text_col) >= min_chars), F.col(text_col))))
        sure = F.coalesce(F.col("_guess.confidence") >= min_confidence, F.lit(False))
        return out.withColumn(lang_col, F.when(~unsure, F.col(lang_col)).when(sure, F.col("_guess.lang")).otherwise(F.lit(fallback))).drop("_guess")

    return run


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumns(stats(F.col(text_col)))


def normalize_documents(df: DataFrame, model: LanguageModel, stages: Sequence[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All stages in order: cleaning, then the language, then counts, if none are named. Rows stay; a null text stays null and has the fallback's language unless it has a sure one; df must have no column named _guess."""
    for stage in stages if stages is not None else (cleaned, with_language(model), with_counts):
        df = df.transform(stage)
    return df
