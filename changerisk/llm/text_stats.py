"""Statistics of whole texts as Spark columns; inputs of the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.common import ASCII_SPACE, text_or_empty

#: Names of the statistics, in the order of the classifier's features.
STATISTICS = (
    "log_chars",
    "word_length",
    "upper_share",
    "digit_share",
    "symbol_share",
    "marked_share",
    "distinct_share",
    "repeat_share",
    "short_share",
    "stop_share",
    "line_words",
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(text: Column, others: str) -> Column:
    """Characters of a text that are left when ``others`` are deleted."""
    return F.length(F.regexp_replace(text, others, ""))


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Add a struct of doubles: log length, mean word length, shares of capitals among letters, of
    digits and symbols among characters, of words that end in two marks, of distinct words, of
    words equal to the one before, of words of up to two characters, of words that end a sentence,
    and mean words per line. Shares of nothing are 0, so null and empty texts have all zeros.
    """
    raw = text_or_empty(text)
    words = F.filter(F.split(raw, f"{ASCII_SPACE}+"), lambda word: word != "")
    staged = docs.withColumn("_raw", raw).withColumn("_words", words)
    chars, count = F.length("_raw"), F.size("_words")
    letters = _count(F.col("_raw"), r"\P{L}+")
    holding = lambda test: F.size(F.filter("_words", test))
    repeats = F.size(F.filter("_words", lambda word, i: (i > 0) & (word == F.get("_words", i - 1))))
    found = {
        "log_chars": F.log1p(chars),
        "word_length": _share(chars - count, count),
        "upper_share": _share(_count(F.col("_raw"), r"\P{Lu}+"), letters),
        "digit_share": _share(_count(F.col("_raw"), r"\P{N}+"), chars),
        "symbol_share": _share(_count(F.col("_raw"), r"[\p{L}\p{N}\s.,;:'\"()?-]+"), chars),
        "marked_share": _share(holding(lambda word: word.rlike(r"[^\p{L}\p{N}]{2}$")), count),
        "distinct_share": _share(F.size(F.array_distinct("_words")), count),
        "repeat_share": _share(repeats, count),
        "short_share": _share(holding(lambda word: F.length(word) <= 2), count),
        "stop_share": _share(holding(lambda word: word.endswith(".")), count),
        "line_words": _share(count, F.size(F.split("_raw", "\n"))),
    }
    stats = F.struct(*[found[n].cast("double").alias(n) for n in STATISTICS])
    # A generator is not merged with what reads it, so each statistic is computed once, however many
    # rules and filters name it.
    return staged.withColumn(name, F.explode(F.array(stats))).drop("_raw", "_words")
