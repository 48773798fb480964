"""The register that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that says what it returns (None where SQL can't)."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, utterances)."""
    from turnmill.operators.dialogues import assemble

    return assemble(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def r6(x) -> F.Column:
    return F.round(x, 6)


#: SQL for the words of a text.
def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


#: SQL: one row per conversation, u being its utterances.
DIALOGUES = "d AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS u FROM conversations GROUP BY conv_id)"
