"""Writers. Text outputs are folders of part files, as a distributed writer makes them; `single` asks for one file where the content is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.operators.dialogues import lines
from turnmill.operators.posts import NAMES
from turnmill.operators.ranks import written


def posts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Posts as one Parquet table; text and columns stay together."""
    df.select(*NAMES).write.mode(mode).parquet(path)


def post_pair(df: DataFrame, csv: str, text: str) -> None:
    """Posts as tables without header and text lines that correspond to their rows; line ends in texts become blanks."""
    rows = df.select(*[F.col(n) for n in NAMES]).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "))
    rows = corresponding(rows)
    rows.drop("text").write.mode("overwrite").csv(csv, emptyValue="", nullValue="")
    rows.select("text").write.mode("overwrite").text(text)


def corresponding(df: DataFrame) -> DataFrame:
    """df, to be written as several files whose lines correspond: computed once, so that all of them come from the same rows in the same order."""
    return written(df, "corresponding")


def dialogues(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Utterances of each dialogue in a line, and their ids in a second folder (path.ids), line by line."""
    df = corresponding(df) if "ids" in df.columns else df
    lines(df, "utterances", sep).write.mode("overwrite").text(path)
    if "ids" in df.columns:
        lines(df, "ids", sep).write.mode("overwrite").text(f"{path}.ids")


def windows(df: DataFrame, path: str, turns: int, distinct: bool = True) -> str:
    """N-turn lines at path.{N}T, each once."""
    rows = lines(df, "window")
    to = f"{path}.{turns}T"
    (rows.distinct() if distinct else rows).write.mode("overwrite").text(to)
    return to


def thread_documents(df: DataFrame, path: str) -> None:
    lines(df).write.mode("overwrite").text(path)


def topic_preparation(df: DataFrame, path: str, text: str = "text") -> None:
    """Kept words (path.lda.t) and the lines that they come from (path.processed)."""
    df = corresponding(df.select("kept", text))
    df.select(F.array_join("kept", " ").alias("value")).write.mode("overwrite").text(f"{path}.lda.t")
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(f"{path}.processed")


def ordered_words(df: DataFrame, order: list[Column], path: str, columns: list[str] | None = None) -> None:
    """Tab-separated rows in a total order (part files in order)."""
    cols = columns or ["word"]
    df.orderBy(*order).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(path)


def ngrams(df: DataFrame, path: str, more_than: int = 10, order: int | None = None) -> None:
    """ngram and count, tab-separated, of n-grams more frequent than more_than, in a folder for each order (path.{n}grams). order: the only one that df has, if it is known, so that df is written once."""
    df = df.where(F.col("freq") > more_than)
    if order is None:
        df = written(df, "ngrams")
    for n in [r["n"] for r in df.select("n").distinct().collect()] if order is None else [order]:  # as many as orders
        rows = df.where(F.col("n") == n)
        rows.select(F.concat_ws("\t", "ngram", F.col("freq").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}.{n}grams")


def vocabulary(df: DataFrame, path: str) -> None:
    """A word per line in the order of ids, in one file: a vocabulary has max_size words at most."""
    df.orderBy("id").coalesce(1).select(F.col("word").alias("value")).write.mode("overwrite").text(path)


def filtered(df: DataFrame, path: str) -> None:
    lines(df).write.mode("overwrite").text(f"{path}.filtered")


def topical(df: DataFrame, path: str) -> None:
    from turnmill.operators.topics import topical_lines

    topical_lines(df).write.mode("overwrite").text(f"{path}.topical")


def embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def responses(df: DataFrame, path: str, label: str) -> None:
    df.select(F.col("responses").alias("value")).write.mode("overwrite").text(f"{path}/output_{label}")
