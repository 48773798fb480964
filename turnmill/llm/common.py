"""Helpers that the operators of this subpackage share: folders, checkpoints and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.session import ARROW, ARROW_BYTES, BATCH_BYTES, BATCH_ROWS, OWN, READER, READER_ROWS, adopt, new_path, ship, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adopt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Setting: a folder of shared storage whose caches and ledgers serve all runs.
CACHE_DIR = "spark.turnmill.cache.dir"


def cache_path(spark: SparkSession, name: str) -> str:
    """Where a cache lies: below the folder that the session names, else a new one that this run fills."""
    at = spark.conf.get(CACHE_DIR, None)
    return f"{at.rstrip('/')}/{name}" if at else new_path(spark, name)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: computed once, and it survives lost executors."""
    return written(df, new_path(df.sparkSession, name))


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and held on the executors' disks. Its lineage stays: what goes with a lost executor is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def compact(df: DataFrame) -> DataFrame:
    """Small rows that come out of a scan of texts, dealt anew so that writing them makes a few files instead of one per split."""
    return df.hint("rebalance")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a cache or ledger: whole files, in the folder of their version."""
    rows.write.mode("append").partitionBy("version").parquet(path)


def free(*tables: DataFrame) -> None:
    """Let go of kept tables when what was read from them is written."""
    for x in tables:
        x.unpersist()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give a worker's free memory back: workers stay alive between tasks, several to an executor, and would keep their peaks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(fn), releasing memory at the end of each task."""
    df = adopt(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of a string column, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut or join record batches so that each has about `most` bytes in `column`; a longer value stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, here = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if size + here and size + here + n > most:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield joined(held)
                held, size, start, here = [], 0, i, 0
            here += n + 1
        held.append(batch.slice(start))
        size += here
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: (id, digest) pairs whose texts needn't be read are broadcast up to this many rows (about 25 MB); more are joined by shuffle.
BROADCAST_ROWS = 400_000


def digest_of(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, digest) of each row, null text as empty; kept, because it is read several times and the texts are not to be."""
    return kept(docs.select(F.col(doc_id).alias("_id"), digest_of(F.col(text)).alias("digest")))


def first_texts(docs: DataFrame, keys: DataFrame, misses: DataFrame, doc_id: str, text: str, broadcast_rows: int = BROADCAST_ROWS, *, held: list[DataFrame] | None = None) -> DataFrame:
    """(digest, _text), one text for each digest of misses (digest, _id: the least id with it), in one more pass over docs.

    The rows that needn't be read, copies and known contents, are filtered out by id and digest. If they are few they are broadcast
    and no text is shuffled. What is kept for it is added to `held`, for the caller to let go.
    """
    others = kept(keys.join(misses, keys["digest"].eqNullSafe(misses["digest"]) & keys["_id"].eqNullSafe(misses["_id"]), "left_anti").distinct())
    few = others.count() <= broadcast_rows
    if held is not None:
        held.append(others)
    others = others.select(F.col("_id").alias("_i"), F.col("digest").alias("_d"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("digest", digest_of(F.col("_text")))
    same = texts["_id"].eqNullSafe(F.col("_i")) & (texts["digest"] == F.col("_d"))
    return texts.join(F.broadcast(others) if few else others.hint("merge"), same, "left_anti").select("digest", "_text")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE files write for bytes: printable Latin-1 for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
