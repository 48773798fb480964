"""Word vectors of a vocabulary: from a table, or random ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from turnmill.operators.ranks import ranked
from turnmill.operators.vocab import RESERVED

WIDTH = 0.1
DEFAULT_DIM = 300


def random_vectors(vocab: DataFrame, dim: int, width: float = WIDTH, seed: int = 0) -> DataFrame:
    """(word, vec, trainable): uniform values in (-width, width), the same for a word in every run; every word counts as unknown."""
    unit = lambda i: F.pmod(F.xxhash64("word", i, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    vec = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: ((unit(i) * 2 - 1) * width).cast("float"))
    return vocab.select("word", vec.alias("vec"), F.lit(True).alias("trainable"))


def from_table(vocab: DataFrame, table: DataFrame, dim: int, *, width: float = WIDTH, seed: int = 0, zero_is_missing: bool = False) -> DataFrame:
    """(word, vec, trainable): vectors of a table (word, vec); words without one get a random vector and are trainable. zero_is_missing: vectors that sum to 0 count as missing."""
    if zero_is_missing:
        table = table.where(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) != 0)
    found = vocab.select("word").join(table.select("word", F.col("vec").alias("_v")), "word", "left")
    own = random_vectors(vocab.select("word"), dim, width, seed).select("word", F.col("vec").alias("_r"))
    return found.join(own, "word").select("word", F.coalesce("_v", "_r").alias("vec"), F.col("_v").isNull().alias("trainable"))


def out_of_vocabulary(vocab: DataFrame, table: DataFrame) -> DataFrame:
    return vocab.join(table.select("word"), "word", "left_anti")


def in_vocabulary(vocab: DataFrame, table: DataFrame) -> DataFrame:
    return vocab.join(table.select("word"), "word", "left_semi")


def reordered(vocab: DataFrame, table: DataFrame) -> DataFrame:
    """(id, word): reserved words, words without a vector, words with one; otherwise in the old order. The old id stays as old_id."""
    kind = F.when(F.col("word").isin(*RESERVED), 0).when(F.col("_has").isNull(), 1).otherwise(2)
    marked = vocab.join(table.select("word", F.lit(1).alias("_has")).dropDuplicates(["word"]), "word", "left").select(F.col("id").alias("old_id"), "word", kind.alias("kind"))
    return ranked(marked, [F.col("kind"), F.col("old_id")]).select((F.col("rank") - 1).alias("id"), "word", "old_id")


def matrix(vectors: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, word, vec, trainable) in the order of ids, each word once."""
    return vocab.select("id", "word").join(vectors, "word", "left").select("id", "word", "vec", "trainable")


def lookup(rows: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    return rows.join(vectors.select(F.col("word").alias(word), "vec"), word, "left")


def choose(kind: str, catalogue: dict[str, dict]) -> tuple[str, int]:
    """("random", dimension) or ("table", dimension) for an embedding type: randomN, or a name of the catalogue."""
    m = re.fullmatch(r"random(\d*)", kind)
    if m:
        return "random", int(m[1]) if m[1] else DEFAULT_DIM
    if kind not in catalogue:
        raise ValueError(f"unknown embedding type {kind}")
    return "table", int(catalogue[kind]["dim"])
