"""Profanity filter over dialogues, dull responses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.functions.text import clean_utterance, tok
from turnmill.operators.ngrams import found_in


def one_word_hits(u: Column, words: list[str]) -> Column:
    """Whether a word of the list stands in an utterance, exactly and in its case."""
    return F.arrays_overlap(tok(u), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)


def phrase_hits(u: Column, phrases: list[str]) -> Column:
    """Whether a phrase of the list is contained in an utterance."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(u, F.lit(p))
    return out


def split_terms(terms: list[str]) -> tuple[list[str], list[str]]:
    return [t for t in terms if " " not in t], [t for t in terms if " " in t]


def hits(dialogues: DataFrame, terms: list[str], column: str = "utterances") -> DataFrame:
    """dialogues with one_word and multi_word: the numbers of utterances hit. An utterance with a one-word hit isn't looked at for phrases."""
    words, phrases = split_terms(terms)
    one = lambda u: one_word_hits(u, words)
    return dialogues.withColumn("one_word", F.size(F.filter(column, one)).cast("bigint")).withColumn("multi_word", F.size(F.filter(column, lambda u: ~one(u) & phrase_hits(u, phrases))).cast("bigint"))


def sanitize(dialogues: DataFrame, terms: list[str], column: str = "utterances") -> DataFrame:
    """Dialogues without any hit, utterances cleaned."""
    words, phrases = split_terms(terms)
    kept = dialogues.where(~F.exists(column, lambda u: one_word_hits(u, words) | phrase_hits(u, phrases)))
    return kept.withColumn(column, F.transform(column, clean_utterance))


def report(dialogues: DataFrame, terms: list[str], column: str = "utterances") -> DataFrame:
    """lines, kept, one_word, multi_word."""
    found = hits(dialogues, terms, column)
    return found.agg(F.count("*").alias("lines"), F.count_if((F.col("one_word") == 0) & (F.col("multi_word") == 0)).alias("kept"), F.sum("one_word").alias("one_word"), F.sum("multi_word").alias("multi_word"))


def dull_share(rows: DataFrame, templates: list[str], text: str = "text") -> DataFrame:
    """Share of rows whose text is one of a list of dull responses (case and outer blanks aside)."""
    dull = F.lower(F.trim(text)).isin(*[t.strip().lower() for t in templates]) if templates else F.lit(False)
    return rows.agg(F.count("*").alias("n"), F.count_if(dull).alias("dull"))


GAP = re.compile(r"\$\d+")


def template_parts(template: str) -> tuple[str, str]:
    """The longest run of words of a template between its gaps, and a pattern of the whole. $1 and the like are gaps: one character or more."""
    runs = GAP.split(squeezed(template))
    return max((r.strip() for r in runs), key=len), "^" + ".+".join(re.escape(r) for r in runs) + "$"


def squeezed(x: str) -> str:
    return " ".join(x.lower().split())


def dull_lines(rows: DataFrame, templates: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, template) of the rows that a template with gaps matches, case and blanks aside.

    The longest run of words of each template finds the rows that hold it; only these are compared with the whole, the order of the other runs included. key: unique.
    """
    listed = rows.sparkSession.createDataFrame([(t, *template_parts(t)) for t in dict.fromkeys(templates)], "template string, _run string, _pattern string")
    lines = rows.select(F.col(key).alias("_line"), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).alias("_t"))
    met = found_in(lines, listed.select("_run").distinct(), text="_t", key="_line", gram="_run").withColumnRenamed("_line", "_l")
    met = met.join(F.broadcast(listed), F.col("ngram") == F.col("_run")).join(lines, F.col("_l") == F.col("_line"))  # listed: as long as the caller's list
    return met.where(F.expr("_t rlike _pattern")).select(F.col("_l").alias(key), "template")
