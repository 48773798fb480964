"""Queries that run a stream to its end and return what its sink holds."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.operators import ngrams as N, posts as P
from turnmill.plans.registry import query, read, words
from turnmill.session import new_path
from turnmill.streaming import contexts as CH, ingest as G, stores as ST


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS text, CAST(user_id AS VARCHAR) AS author FROM events WHERE event_type <> 'error'")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts through the exactly-once file sink; errors count as bots."""
    none = lambda n, k="string": F.lit(None).cast(k).alias(n)
    raw = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("author"), F.col("event_id").cast("string").alias("id"), none("link_id"), none("parent_id"), F.col("event_type").alias("body"), F.col("ts").cast("string").alias("created_utc"), none("subreddit_id"), none("score", "bigint"), none("distinguished"), none("gilded"), none("controversiality"))
    out = new_path(spark, "ingested")
    G.write_posts(P.comment_posts(raw).where("text <> 'error'"), out, f"{out}.checkpoint").awaitTermination()
    return spark.read.parquet(out).select("id", "text", "author")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of a day, the whole result after each micro-batch."""
    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = G.windowed_counts(rows, "ts", "1 day", "1 hour", ["event_type"])
    out = new_path(spark, "daily")

    def sink(df: DataFrame, _: int) -> None:
        df.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n").write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{out}.checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT CASE WHEN event_type = 'error' THEN 'deleted_or_bot' WHEN value < 5 THEN 'short_word_len' ELSE 'processed' END AS reason, count(*) AS n FROM events GROUP BY ALL")
def stream_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections by reason, counted as they come."""
    judged = events(spark, sf_dir).select(F.when(F.col("event_type") == "error", "deleted_or_bot").when(F.col("value") < 5, "short_word_len").alias("reason"))
    out = new_path(spark, "reasons")

    def sink(df: DataFrame, _: int) -> None:
        df.withColumnRenamed("count", "n").write.mode("overwrite").parquet(out)

    G.running_reasons(judged).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{out}.checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def in_files(df: DataFrame, files: int, key: str, name: str) -> DataFrame:
    """df as a stream of some files, one to a micro-batch."""
    path = new_path(df.sparkSession, name)
    df.repartitionByRange(files, key).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


NGRAMS = f"w AS (SELECT {words('text')} AS w FROM conversations), g AS (SELECT 1 AS n, unnest(w) AS ngram FROM w UNION ALL SELECT 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)"


class Killed(Exception):
    pass


@query(f"WITH {NGRAMS} SELECT n, ngram, count(*) AS freq FROM g GROUP BY n, ngram")
def stream_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-gram counts of a stream that dies between the write of a batch and its commit, goes on from its checkpoint, and is compacted on the way."""
    texts = in_files(read(spark, sf_dir, "conversations"), 5, "conv_id", "conversations")
    path = new_path(spark, "ngram-counts")
    store = ST.ngram_store(spark, f"{path}/store")

    def die(batch: int) -> None:
        if batch == 2:
            raise Killed

    try:
        ST.count_ngrams(texts, store, [1, 2], f"{path}/checkpoint", after=die).awaitTermination()
    except StreamingQueryException as e:
        if "Killed" not in str(e):
            raise
    ST.count_ngrams(texts, store, [1, 2], f"{path}/checkpoint", after=lambda batch: store.compact() if batch == 3 else None).awaitTermination()
    return store.read()


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_type || ' ' || user_id) AS exact, true AS within FROM events GROUP BY day")
def stream_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of words by day from sketches of a stream of files, whose bounds hold the exact numbers."""
    rows = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat_ws(" ", "event_type", "user_id").alias("text"))
    path = new_path(spark, "sketches")
    store = ST.sketch_store(spark, f"{path}/store", "day")
    ST.sketch_ngrams(in_files(rows, 4, "event_id", "events"), store, [2], "day", f"{path}/checkpoint").awaitTermination()
    exact = N.exploded(rows, [2], by=["day"]).distinct().groupBy("day").agg(F.count("*").alias("exact"))
    found = ST.estimated(store.read()).join(exact, "day")
    return found.select("day", "exact", ((F.col("exact") >= F.col("least")) & (F.col("exact") <= F.col("most"))).alias("within"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv, turn, CASE WHEN turn = 0 THEN '</S>' ELSE coalesce(lag(text) OVER c, '') END AS before, coalesce(text, '') AS now FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)")
def stream_chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two utterances at each turn, from a stream in which the turns of a conversation come out of order and in several micro-batches."""
    c = read(spark, sf_dir, "conversations")
    mixed = F.crc32(F.concat_ws(":", F.lit("m"), "conv_id", "turn").cast("binary")).alias("mixed")
    rows = c.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"), "text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("ts"), mixed)
    path = new_path(spark, "chats")
    found = CH.chat_contexts(in_files(rows, 3, "mixed", "mixed").drop("mixed"), 3)
    CH.started(found, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.schema(CH.CONTEXT).parquet(f"{path}/out")
    return out.select("conv", "turn", F.element_at("context", 1).alias("before"), F.element_at("context", 2).alias("now"))
