"""Tables that micro-batches add to, each batch once: counts and distinct-count sketches of a corpus that keeps arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from turnmill.operators import ngrams as N


class BatchStore:
    """Partial results by batch, united on read.

    A batch writes a folder that bears its number, in place of what an earlier try has left there, so a batch that is run again after a failure between its write and the stream's commit counts
    once. A folder without its success mark isn't read. `compact` unites what is there into one table, which takes the place of the batches up to its number; until its own mark is
    there, the batches are read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, unite: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.unite = spark, path.rstrip("/"), schema, unite

    def put(self, part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _parts(self) -> dict[str, list[int]]:
        """The numbers of finished tables and batches: as many as batches since the last compaction."""
        jvm = self.spark._jvm
        found: dict[str, list[int]] = {"base": [], "batch": []}
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/*=*/_SUCCESS")) or []:
            kind, _, number = status.getPath().getParent().getName().partition("=")
            found[kind].append(int(number))
        return found

    def read(self) -> DataFrame:
        """The union of all batches."""
        parts = self._parts()
        base = max(parts["base"], default=-1)
        paths = [f"{self.path}/base={base}"] * (base >= 0) + [f"{self.path}/batch={k}" for k in sorted(parts["batch"]) if k > base]
        return self.unite(self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema))

    def compact(self) -> None:
        last = max(self._parts()["batch"], default=-1)
        if last >= 0:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base={last}")


def ngram_store(spark: SparkSession, path: str) -> BatchStore:
    """(n, ngram, freq)."""
    unite = lambda df: df.groupBy("n", "ngram").agg(F.sum("freq").alias("freq"))
    return BatchStore(spark, path, "n int, ngram string, freq bigint", unite)


def sketch_store(spark: SparkSession, path: str, by: str) -> BatchStore:
    """(by, n, sketch): distinct n-grams."""
    unite = lambda df: df.groupBy(by, "n").agg(F.hll_union_agg("sketch").alias("sketch"))
    return BatchStore(spark, path, f"{by} string, n int, sketch binary", unite)


def count_ngrams(texts: DataFrame, store: BatchStore, orders: list[int], checkpoint: str, text: str = "text", after: Callable[[int], None] = lambda _: None) -> StreamingQuery:
    """Add the n-gram counts of a stream of texts to a store; `after` is called when a batch is written and not yet committed."""

    def sink(rows: DataFrame, batch: int) -> None:
        store.put(N.counts(rows, orders, text), batch)
        after(batch)

    return texts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sketch_ngrams(texts: DataFrame, store: BatchStore, orders: list[int], by: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Add the sketches of a stream of texts with a column `by` (string) to a store."""
    return texts.writeStream.foreachBatch(lambda rows, batch: store.put(N.sketches(rows, orders, [by], text), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Relative standard error of a united sketch of 2 ** 12 registers, Spark's default.
SKETCH_ERROR = 1.04 / 2**6


def estimated(sketches: DataFrame, sketch: str = "sketch", errors: float = 3) -> DataFrame:
    """sketches with estimate, and least and most: the bounds of the true number at so many standard errors."""
    n: Column = F.hll_sketch_estimate(sketch)
    spread = errors * SKETCH_ERROR
    return sketches.withColumn("estimate", n).withColumns({"least": F.floor(n / (1 + spread)), "most": F.ceil(n / (1 - spread))})
