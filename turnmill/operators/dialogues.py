"""Dialogues and their windows of N turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.functions.text import tok


def assemble(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, utterances): one row per dialogue, utterances by `order`."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("u")).select(key, F.col("u.t").alias("utterances"))


def window_array(u: Column, n: int, drop_last: bool = True) -> Column:
    """All windows of n consecutive utterances of an array; drop_last: the last utterance is never used."""
    last = F.size(u) - n + (0 if drop_last else 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(u, i, n))).otherwise(F.array().cast("array<array<string>>"))


def windows(dialogues: DataFrame, n: int, *, drop_last: bool = True, min_length: int | None = None) -> DataFrame:
    """dialogues (with utterances) to one row per window: the other columns, start (0-based) and window. min_length: each utterance has that many words."""
    if n < 2:
        raise ValueError("a window has two turns at least")
    out = dialogues.select(*[c for c in dialogues.columns if c != "utterances"], F.posexplode(window_array(F.col("utterances"), n, drop_last)).alias("start", "window"))
    if min_length is not None:
        out = out.where(F.forall("window", lambda u: F.size(tok(u)) >= min_length))
    return out


def windows_of_rows(rows: DataFrame, key: str, turn: str, text: str, n: int, *, min_length: int | None = None) -> DataFrame:
    """(key, start, window) from one row per utterance, turns being numbered without gaps.

    Each utterance is sent to the n windows that it can be part of, by (key, start): a dialogue with very many turns is spread over all
    tasks, and no task holds a dialogue.
    """
    rows = rows.select(key, F.col(turn).alias("_t"), F.coalesce(text, F.lit("")).alias("_x"))
    if min_length is not None:
        rows = rows.where(F.size(tok(F.col("_x"))) >= min_length)
    spread = rows.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((F.col("_t") - k).alias("start"), k.alias("k")))).alias("w"), "_x").select(key, "w.start", F.struct("w.k", "_x").alias("p"))
    return spread.groupBy(key, "start").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list("p")).alias("p")).where(F.col("_n") == n).select(key, "start", F.col("p._x").alias("window"))


def long_enough(dialogues: DataFrame, n: int) -> DataFrame:
    """Dialogues that have n turns besides the last utterance."""
    return dialogues.where(F.size("utterances") - 1 >= n)


def lines(dialogues: DataFrame, column: str = "utterances", sep: str = "\t") -> DataFrame:
    """One text line per row."""
    return dialogues.select(F.array_join(column, sep).alias("value"))


def history(rows: DataFrame, key: str, turn: str, text: str, turns: int, end: str = "</S>") -> DataFrame:
    """(key, turn, context): the last `turns` - 1 utterances up to and with each one, padded in front with the end mark. Turns are numbered without gaps.

    As for windows, an utterance is sent to the contexts that it is part of, so no task holds a dialogue.
    """
    n = turns - 1
    spread = rows.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((F.col(turn) + k).alias("t"), (-k).alias("k")))).alias("w"), F.coalesce(text, F.lit("")).alias("_x")).select(key, F.col("w.t").alias(turn), F.struct("w.k", "_x").alias("p"))
    found = spread.groupBy(key, turn).agg(F.array_sort(F.collect_list("p")).alias("p")).where(F.element_at("p", -1)["k"] == 0)  # turns beyond the last have no utterance of their own
    return found.select(key, turn, F.concat(F.array_repeat(F.lit(end), F.lit(n) - F.size("p")), F.col("p._x")).alias("context"))
