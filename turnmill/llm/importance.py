"""Importance resampling towards a target distribution, with word tries.

Features of a text are its runs of one to `ORDER` words; a feature's bucket is the CRC-32 of its bytes. Where a partition lies, its features are tries: a node is a run of words,
its children go on with one more word, and it holds how often it is met and the CRC state of its run, so that a child's state is its parent's carried on over a blank and a word.
Tries are made level by level from arrays: a level's nodes are the distinct pairs of a node above and a word. First counts are added up by bucket and the partitions' bucket totals
(`BUCKETS` numbers each) are merged. Then nodes get their bucket's gain, the log-ratio of target and source, and a document's weight is the mean along its paths. A draw
without replacement takes the greatest sums of weight and Gumbel noise.

A trie covers `RUN_BYTES` of a partition's texts; then its counts go to the partition's totals and the next begins, so a worker's memory has a bound and nothing is lost.
Only totals and one row of numbers per document are shuffled; what is broadcast is the gains, one number per bucket. The draw ranks documents by ranges.

Defined results: null text has no words; a document without features has weight 0; repeated rows are rows of their own; ties go to the smaller id (null first), then by row; a null id is
the empty string to the noise; extra columns are ignored; empty tables are fine (without target or source the counts are 0).
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.llm.common import arrow_map, chunks, cut, table, text_bytes
from turnmill.operators.ranks import ranked

ORDER = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of the texts of one trie; a longer text has one to itself. Its nodes and paths take some 40 bytes a byte.
RUN_BYTES = 4 << 20
#: On bytes: letters and digits and all from 0x80 on stay, A-Z in lower case; the rest parts words.
WORD_BYTES = np.array([c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0 for c in range(256)], np.uint8)
#: Words of more bytes than this are carried on one by one.
LONG = 48
BLANK = 0x20


def crc_table() -> np.ndarray:
    """What each byte does to a CRC-32 register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = crc_table()


class Words:
    """The distinct words of some texts, and the texts as their numbers: at has all texts' words, text k's are those from ends[k - 1] to ends[k]."""

    def __init__(self, texts: list[bytes]):
        raw = WORD_BYTES[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
        inside = raw != 0
        first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        borders = np.cumsum([len(t) + 1 for t in texts])
        self.ends = np.searchsorted(first, borders)
        kept = np.cumsum(inside)
        offsets = np.append(kept[first] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())]).dictionary_encode()
        self.at = every.indices.to_numpy().astype(np.int64)
        self.bytes = every.dictionary
        self.data = np.frombuffer(self.bytes.buffers()[2] or b"", np.uint8)
        bounds = np.frombuffer(self.bytes.buffers()[1], np.int64)[self.bytes.offset : self.bytes.offset + len(self.bytes) + 1]
        self.start, self.size = bounds[:-1], np.diff(bounds)


def carried_on(state: np.ndarray, words: Words, word: np.ndarray, blank: bool) -> np.ndarray:
    """CRC states after a further word each, with a blank before it if there was one already: a byte at a time, for all runs at once."""
    size = words.size[word]
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    c, at, size = ~state[order], words.start[word[order]], size[order]
    if blank:
        c = (c >> 8) ^ CRC[(c ^ np.uint32(BLANK)) & 0xFF]
    n_long = int(np.searchsorted(-size, -LONG))  # longer words come first
    for k in range(int(min(size[n_long], LONG)) if n_long < len(size) else 0):
        n = n_long + int(np.searchsorted(-size[n_long:], -k, side="left"))
        x = c[n_long:n]
        c[n_long:n] = (x >> 8) ^ CRC[(x ^ words.data[at[n_long:n] + k]) & 0xFF]
    c = ~c
    for k in range(n_long):
        c[k] = zlib.crc32(words.data[at[k] : at[k] + size[k]].tobytes(), int(c[k]))
    out = np.empty_like(c)
    out[order] = c
    return out


class Trie:
    """The runs of 1 to `order` words of some texts, level by level. A node is a pair of its parent, a node of the level above, and a word.

    state: CRC of each node's bytes. met: how often it occurs. paths: for each level the node of the run that ends at each word, and whether the run is whole (it doesn't begin before its text).
    """

    def __init__(self, texts: list[bytes], order: int = ORDER):
        self.words = words = Words(texts)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []
        place = np.arange(len(words.at)) - np.repeat(np.append(0, words.ends[:-1]), np.diff(words.ends, prepend=0))  # in its text
        node, state = np.zeros(len(words.at), np.int64), np.zeros(1, np.uint32)
        for k in range(order):
            here = np.flatnonzero(place >= k)
            if not len(here):
                break
            pair = node[here - 1] * len(words.size) + words.at[here] if k else words.at
            key, inverse, met = np.unique(pair, return_inverse=True, return_counts=True)
            state = carried_on(state[key // len(words.size)], words, key % len(words.size), k > 0)
            node = np.zeros(len(words.at), np.int64)
            node[here] = inverse
            self.levels.append((state, met))
            self.paths.append((here, inverse))

    def totals(self, buckets: int) -> np.ndarray:
        """Counts by bucket."""
        return sum((np.bincount(state % buckets, met, buckets).astype(np.int64) for state, met in self.levels), np.zeros(buckets, np.int64))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """For each text, the sum of its nodes' gains along its paths."""
        met = np.zeros(len(self.words.at) + 1, np.int64)
        for (state, _), (here, node) in zip(self.levels, self.paths, strict=True):
            met[here + 1] += gains[state % len(gains)][node]
        upto = np.cumsum(met)[self.words.ends]
        return np.diff(upto, prepend=0)


def bucket_totals(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS, order: int = ORDER, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for b in chunks(batches, "_text", run_bytes):
            totals += Trie(text_bytes(b.column("_text")), order).totals(buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], names=["bucket", "n"])

    return arrow_map(docs.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, in thousandths of a natural log: how much likelier the target's features fall into it than the source's, both smoothed by one."""
    s, t = (dict(map(tuple, x.collect())) for x in (source, target))  # a number per bucket
    n_s, n_t = sum(s.values()), sum(t.values())
    ratio = [(float(t.get(b, 0)) + 1) * (float(n_s) + buckets) / ((float(s.get(b, 0)) + 1) * (float(n_t) + buckets)) for b in range(buckets)]
    return np.floor(1000 * np.log(np.array(ratio))).astype(np.int64).tolist()


def weights(docs: DataFrame, gain: list[int], *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; weight is the floored mean of its features' gains."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain))  # a number per bucket
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text", run_bytes):
            trie = Trie(text_bytes(b.column("_text")), order)
            n_words = np.diff(trie.words.ends, prepend=0)
            n = sum(np.maximum(n_words - k, 0) for k in range(order))
            weight = np.where(n > 0, trie.sums(sent.value) // np.maximum(n, 1), 0)  # floors
            yield pa.RecordBatch.from_arrays([b.column("_id"), *map(pa.array, (n_words, n, weight))], names=["_id", "n_words", "n_features", "weight"])

    return arrow_map(rows, run, f"_id {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("_id", doc_id)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Noise of a document in thousandths, from a digest of the seed and its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resampled(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs: rank counts the drawn ones from 1, those of the greatest scores among the rows of `least_words` words or more; others have none."""
    totals = functools.partial(bucket_totals, buckets=buckets)
    gain = gains(totals(docs, text=text), totals(target, text=target_text), buckets)
    scored = weights(docs, gain, doc_id=doc_id, text=text).withColumn("score", F.col("weight") + gumbel(F.col(doc_id), seed))
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [able.desc(), F.col("score").desc(), F.col(doc_id), F.col("_row")]
    rank = F.when(able & (F.col("rank") <= drawn), F.col("rank"))
    return ranked(scored, order).select(doc_id, "n_features", "weight", "score", rank.alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
