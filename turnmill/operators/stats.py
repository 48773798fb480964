"""Corpus statistics: lengths, term frequencies, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.functions.text import tok
from turnmill.operators.ranks import ranked, top


def summary(x: Column | str) -> list[Column]:
    """count, sum, mean, sample standard deviation (0 for one value), median (0.0 for none), min and max."""
    x = F.col(x) if isinstance(x, str) else x
    return [F.count(x).alias("n"), F.sum(x).cast("bigint").alias("total"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev"), F.coalesce(F.median(x), F.lit(0.0)).alias("median"), F.min(x).alias("least"), F.max(x).alias("most")]


def utterances(dialogues: DataFrame, column: str = "utterances") -> DataFrame:
    """One row per utterance: the other columns, turn (0-based), text and length in words."""
    rows = dialogues.select(*[c for c in dialogues.columns if c != column], F.posexplode(column).alias("turn", "text"))
    return rows.withColumn("length", F.size(tok("text")))


def length_stats(rows: DataFrame, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """Statistics of `length`, overall, per column, or both (rollup)."""
    grouped = rows.rollup(*by) if rollup and by else rows.groupBy(*(by or []))
    return grouped.agg(*summary("length"))


def term_frequency(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, tf)."""
    return texts.select(F.explode(tok(text)).alias("word")).groupBy("word").agg(F.count("*").alias("tf"))


def first_positions(texts: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """(word, tf, first): the first place of each word, which settles ties in the order of appearance."""
    rows = texts.select(F.struct(*order).alias("_o"), F.posexplode(tok(text)).alias("_p", "word"))
    return rows.groupBy("word").agg(F.count("*").alias("tf"), F.min(F.struct("_o", "_p")).alias("first"))


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.explode(tok(text)).alias("word")).distinct()


def most_frequent(tf: DataFrame, n: int, ties: str = "word") -> DataFrame:
    return top(tf, [F.desc("tf"), F.col(ties)], n)


def rarest(tf: DataFrame, n: int, compat: bool = False, ties: str = "word") -> DataFrame:
    """The n last words by frequency (compat: one less), from the rarest."""
    return top(tf, [F.asc("tf"), F.desc(ties)], max(0, n - 1 if compat else n))


def by_frequency(tf: DataFrame, ties: str = "word") -> DataFrame:
    """tf with rank and running, the number of tokens up to the word."""
    return ranked(tf, [F.desc("tf"), F.col(ties)], mass="tf")


def coverage(tf: DataFrame, vocab_size: int, min_freq: int, ties: str = "word") -> DataFrame:
    """Words and tokens, those of at least min_freq, and the tokens of the vocab_size most frequent words."""
    head = most_frequent(tf, vocab_size, ties).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("top_tokens"))
    whole = tf.agg(F.count("*").alias("words"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), F.count_if(F.col("tf") >= min_freq).alias("words_min"), F.coalesce(F.sum(F.when(F.col("tf") >= min_freq, F.col("tf"))), F.lit(0)).alias("tokens_min"))
    return whole.crossJoin(head).withColumns({"word_share": F.try_divide("words_min", "words"), "token_share": F.try_divide("tokens_min", "tokens"), "top_share": F.try_divide("top_tokens", "tokens")})


def report(dialogues: DataFrame, column: str = "utterances") -> DataFrame:
    """lines, utterances, words, tokens, utterances per line, most utterances of a line. A blank line counts as one empty utterance."""
    sizes = dialogues.agg(F.count("*").alias("lines"), F.sum(F.size(column)).cast("bigint").alias("utterances"), F.max(F.size(column)).alias("most"))
    words = dialogues.select(F.explode(F.flatten(F.transform(column, tok))).alias("word")).groupBy("word").count().agg(F.count("*").alias("words"), F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"))
    # one row on either side
    return sizes.crossJoin(words).withColumn("per_line", F.try_divide("utterances", "lines"))
