"""Beam decoding over a next-word table: all samples go on together, a step at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnmill import session
from turnmill.functions.text import tok
from turnmill.operators.evaluate import length_penalty
from turnmill.session import new_path

END = "</S>"
#: Rows of a next-word table that are broadcast, at most; a larger one is joined by shuffle.
BROADCAST_NEXT = 500_000


def next_words(texts: DataFrame, text: str = "text", end: str = END) -> DataFrame:
    """(word, next, log_prob): which word follows a word, as a share of what follows it; the end mark follows the last word of a text."""
    w = texts.select(tok(text).alias("_w")).where(F.size("_w") > 0)
    pairs = w.select(F.inline(F.arrays_zip(F.col("_w").alias("word"), F.concat(F.slice("_w", F.lit(2), F.size("_w")), F.array(F.lit(end))).alias("next"))))
    counts = pairs.groupBy("word", "next").agg(F.count("*").alias("n"))
    total = counts.groupBy("word").agg(F.sum("n").alias("t"))
    return counts.join(total, "word").select("word", "next", F.ln(F.col("n") / F.col("t")).alias("log_prob"))


def beam_search(starts: DataFrame, following: DataFrame, *, key: str, start: str, width: int, max_length: int, penalty: float = 0.0, end: str = END, broadcast_rows: int = BROADCAST_NEXT) -> DataFrame:
    """(key, rank, words, log_prob, score): the `width` best sequences of each sample, up to their end mark or max_length words, the start word not among them.

    starts: key (unique) and the word that a sequence begins with. following: (word, next, log_prob). In a step each sequence that hasn't ended meets the words that may follow its last one, and of all of a
    sample's sequences, ended ones included, the width best by log probability over length penalty stay; ties go by the words. A sequence can bring width candidates at most into what stays, so of each word
    only its width best followers take part, however many it has; that table is broadcast up to broadcast_rows. A sample's candidates are width * width rows at most. Each step is a written table, so lineage stays
    short, and the search ends when all sequences have ended. A sequence whose last word nothing follows ends there.
    """
    spark = starts.sparkSession
    best = Window.partitionBy("word").orderBy(F.desc("log_prob"), "next")
    table = session.written(following.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= width).select("word", "next", F.col("log_prob").alias("_lp")), new_path(spark, "next-words"))
    side = F.broadcast(table) if table.count() <= broadcast_rows else table
    base = new_path(spark, "beams")
    beam = starts.select(F.col(key).alias("_k"), F.col(start).alias("_last"), F.array().cast("array<string>").alias("words"), F.lit(0.0).alias("log_prob"), F.lit(False).alias("_over"))
    for step in range(max_length):
        grown = beam.where("NOT _over").join(side, F.col("_last") == F.col("word"), "left")
        more = F.col("next").isNotNull()
        grown = grown.select("_k", F.coalesce("next", "_last").alias("_last"), F.when(more, F.concat("words", F.array("next"))).otherwise(F.col("words")).alias("words"),
                             (F.col("log_prob") + F.coalesce("_lp", F.lit(0.0))).alias("log_prob"), (~more | (F.col("next") == end)).alias("_over"))
        every = grown.unionByName(beam.where("_over").select(*grown.columns))
        score = F.col("log_prob") / length_penalty(F.size("words"), penalty)
        every = every.withColumn("score", score)
        rank = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("score"), "words"))
        kept = every.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= width)
        beam = session.written(kept, f"{base}/{step}")
        if beam.where("NOT _over").isEmpty():
            break
    return beam.select(F.col("_k").alias(key), "rank", "words", "log_prob", "score")
