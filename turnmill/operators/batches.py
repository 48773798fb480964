"""Training samples and length-bucketed batches, flat and per turn, with and without topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from turnmill.functions.numbers import bucket
from turnmill.functions.text import tok
from turnmill.operators.ranks import ranked, ranked_in
from turnmill.operators.vocab import END

S, E, SEP = "<S>", "</S>", "<SEP>"


def cut_to(x: Column, n: int | None) -> Column:
    return F.slice(x, 1, n) if n else x


def flat_source(turns: Column, src_max_len: int | None = None) -> Column:
    """Words of all source turns with <SEP> between them; a turn that isn't the last gives src_max_len - 1 words at most, and the whole is cut to src_max_len."""
    inner = F.transform(turns, lambda u, i: F.when(i < F.size(turns) - 1, F.concat(cut_to(tok(u), src_max_len - 1 if src_max_len else None), F.array(F.lit(SEP)))).otherwise(cut_to(tok(u), src_max_len)))
    return cut_to(F.flatten(inner), src_max_len)


def flat_samples(rows: DataFrame, *, column: str = "utterances", src_max_len: int | None = None, tgt_max_len: int | None = None, has_target: bool = True, topical: bool = False, topic_words: int | None = None) -> DataFrame:
    """rows with src, tgt, tgt_in, tgt_out, src_len, tgt_len (and topic, topic_len), as words. Rows with an empty part go.

    The last column is the target; topical: the last is the topic and the one before it the target. Without a target all (other) columns are sources.
    """
    u = F.col(column)
    behind = int(has_target) + int(topical)
    sources = F.slice(u, F.lit(1), F.greatest(F.size(u) - behind, F.lit(0)))
    out = rows.where(F.size(u) > behind).withColumn("src", flat_source(sources, src_max_len))
    test = F.size("src") > 0
    if has_target:
        out = out.withColumn("tgt", cut_to(tok(F.element_at(u, -2 if topical else -1)), tgt_max_len))
        test = test & (F.size("tgt") > 0)
    if topical:
        out = out.withColumn("topic", cut_to(tok(F.element_at(u, -1)), topic_words)).withColumn("topic_len", F.size("topic"))
        test = test & (F.size("topic") > 0)
    out = out.where(test).withColumn("src_len", F.size("src"))
    return with_target_marks(out) if has_target else out


def with_target_marks(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"tgt_in": F.concat(F.array(F.lit(S)), "tgt"), "tgt_out": F.concat("tgt", F.array(F.lit(E)))}).withColumn("tgt_len", F.size("tgt_in"))


def turn_samples(rows: DataFrame, *, turns: int, column: str = "utterances", src_max_len: int | None = None, tgt_max_len: int | None = None, has_target: bool = True, topical: bool = False, topic_words: int | None = None) -> DataFrame:
    """rows with srcs (one array per source turn; an empty turn keeps its place), src_lens, and the target (turn `turns`) and topic (the column after it). Nothing goes for being empty."""
    u = F.col(column)
    n = turns - 1 if has_target else turns
    at = lambda i: F.coalesce(F.try_element_at(u, F.lit(i)), F.lit(""))
    out = rows.withColumn("srcs", F.array(*[cut_to(tok(at(i)), src_max_len) for i in range(1, n + 1)]))
    out = out.withColumn("src_lens", F.transform("srcs", F.size))
    if topical:
        out = out.withColumn("topic", cut_to(tok(F.element_at(u, -1)), topic_words)).withColumn("topic_len", F.size("topic"))
    if has_target:
        out = with_target_marks(out.withColumn("tgt", cut_to(tok(at(turns)), tgt_max_len)))
    return out


def bucketed(samples: DataFrame, lengths: list[str], *, src_max_len: int | None, buckets: int) -> DataFrame:
    return samples.withColumn("bucket", bucket([F.col(x) for x in lengths], src_max_len, buckets) if buckets > 1 else F.lit(0))


def batched(samples: DataFrame, batch_size: int, order: list[str]) -> DataFrame:
    """samples with batch (0-based in its bucket): runs of batch_size by `order`. Buckets are numbered in ranges, so one that holds most samples isn't numbered by one task."""
    rows = ranked_in(samples, "bucket", [F.col(c) for c in order], "_n")
    return rows.withColumn("batch", F.floor((F.col("_n") - 1) / batch_size).cast("bigint")).drop("_n")


#: Batches of one part of a stored epoch.
PART = 64


def store_epoch(batches: DataFrame, path: str, seed: int = 0, part: int = PART) -> int:
    """Write batches (with bucket and batch) in a seeded order, numbered through all buckets, `part` of them to a folder; how many there are.

    Only batches are ranked, a row each, and their numbers meet the samples by a join.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("bucket").cast("string"), F.col("batch").cast("string")))
    numbers = ranked(batches.select("bucket", "batch").distinct(), [order], "number").withColumn("number", F.col("number") - 1)
    rows = batches.join(numbers, ["bucket", "batch"]).withColumn("part", F.expr(f"number div {part}"))
    rows.repartition("part").sortWithinPartitions("part", "number").write.mode("overwrite").partitionBy("part").parquet(path)
    return numbers.count()


def resumed(spark: SparkSession, path: str, step: int, schema: StructType, part: int = PART) -> DataFrame:
    """What an epoch still has to give at a step of training, in whichever epoch that is: the batches from step modulo their number on. Parts before it aren't opened."""
    every = spark.read.schema(StructType([*schema.fields]).add("number", LongType()).add("part", LongType())).parquet(path)
    last = every.where(F.col("part") == every.agg(F.max("part")).first()[0]).agg(F.max("number")).first()[0]
    first = step % (last + 1)
    return every.where((F.col("part") >= first // part) & (F.col("number") >= first)).drop("part")


def padded(batches: DataFrame, columns: list[str], fill: int = END) -> DataFrame:
    """Arrays of ids padded to the longest of their batch."""
    longest = batches.groupBy("bucket", "batch").agg(*[F.max(F.size(c)).alias(f"_{c}") for c in columns])
    out = batches.join(longest, ["bucket", "batch"])
    return out.withColumns({c: F.concat(c, F.array_repeat(F.lit(fill).cast("bigint"), F.col(f"_{c}") - F.size(c))) for c in columns}).drop(*[f"_{c}" for c in columns])


def pad_waste(batches: DataFrame, length: str) -> DataFrame:
    """(bucket, batches, samples, tokens, padded): what padding adds."""
    per = batches.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.sum(length).alias("t"), F.max(length).alias("m"))
    return per.groupBy("bucket").agg(F.count("*").alias("batches"), F.sum("n").alias("samples"), F.sum("t").alias("tokens"), F.sum(F.col("n") * F.col("m") - F.col("t")).alias("padded"))


def sharded(rows: DataFrame, line: str, shards: int, index: int, skip: int = 0) -> DataFrame:
    """Every shards-th line from `index`, without the first `skip` of them."""
    kept = rows.where(F.pmod(F.col(line), F.lit(shards)) == index)
    return kept.where(F.floor(F.col(line) / shards) >= skip) if skip else kept


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in a seeded random order, each partition for itself after a random deal."""
    return rows.withColumn("_r", F.rand(seed)).repartition("_r").sortWithinPartitions("_r").drop("_r")


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows chosen by a seeded digest of their key: the same in every run. Each task keeps n rows at most."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def first_rows(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by `order`, a cap on what is read for training."""
    return rows.orderBy(*order).limit(n)


def reversed_pairs(rows: DataFrame, question: str, answer: str) -> DataFrame:
    return rows.withColumns({question: F.col(answer), answer: F.col(question)})


def interleaved(forward: Column, backward: Column) -> Column:
    """States of two directions, layer by layer."""
    return F.flatten(F.zip_with(forward, backward, lambda a, b: F.array(a, b)))

