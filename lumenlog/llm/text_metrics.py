"""Per-document text statistics as built-in column expressions; no shuffle and no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def count_of(text: Column, characters: str) -> Column:
    """How many characters of text are among the given ASCII characters."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def with_words(df: DataFrame, text_col: str) -> DataFrame:
    """Adds text_ (null: empty) and words_, the runs of characters other than ASCII white space."""
    return df.withColumn("text_", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("words_", words_of(F.col("text_")))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 8-word windows that occur twice or more in the text.

    Windows are hashes of word hashes. Equal ones are neighbours in sorted order, and the positions they cover
    are summed in text order, so a text of n words costs n log n.
    """
    h = F.col("hashes_")
    df = df.withColumn("hashes_", F.transform("words_", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    df = df.withColumn("windows_", F.when(F.size(h) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("windows_", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    df = df.withColumn("sorted_", F.when(F.size(F.array_distinct("windows_")) < F.size("windows_"), pairs).otherwise(F.array().cast("array<struct<v:bigint,i:int>>")))
    s = F.col("sorted_")
    same = lambda e, at: F.coalesce(F.get(s, at)["v"] == e["v"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(s, lambda e, at: same(e, at - 1) | same(e, at + 1)), lambda e: e["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"))
    return df.withColumn("n_repeat_words", F.aggregate(places, start, step, lambda a: a["n"]).cast("long")).drop("hashes_", "windows_", "sorted_")


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text."""
    df = with_repeats(with_words(df, text_col))
    text = F.col("text_")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    df = df.withColumn("lines_", lines)
    return (
        df.withColumn("n_words", F.size("words_").cast("long"))
        .withColumn("word_chars", F.length(text).cast("long") - count_of(text, " \t\n\x0b\x0c\r"))
        .withColumn("n_symbols", count_of(text, SYMBOLS))
        .withColumn("n_dup_lines", (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"))
    )
