"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content and that of the tokenizer (file and library version). Contents are the same if they can't differ in their
counts: null and empty text are one, and otherwise texts of equal bytes, because a byte-level file without a normalizer counts every byte. Documents are joined to the
cache by key; of the misses one text per distinct key is encoded, and the new counts are appended. The cache is a Parquet folder in
shared storage, with a folder for each version, so other versions aren't read: appends are whole files, so it survives a lost executor, and two runs that append the same key
do no harm (a key's counts are equal; reading takes distinct keys). `compacted` rewrites a cache of many small appends. The registered query takes the cache below
`spark.turnmill.cache.dir`, if the session names such a folder, and else a new one, so that a run without the setting encodes every content.

Counts are those of the tokenizers library for the file. A byte-level BPE file has the same ids in tiktoken, which is
faster; texts with characters from U+0250 on, where the libraries' character tables could differ, and texts that tiktoken gives up on
go to the tokenizers library itself.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows keep one row each; extra columns are
ignored; an empty cache or table is fine.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.common import adopt, append, arrow_map, byte_letters, chunks, compact, cut, first_texts, free, kept, keyed, cache_path, table

LIMIT = 512
CACHE_SCHEMA = "digest binary, version string, n_bytes bigint, n_tokens bigint"
PLAIN = 0x250


class Counter:
    def __init__(self, path: str):
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre = file.get("pre_tokenizer") or {}
        if file["model"]["type"] == "BPE" and file.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            import tiktoken

            import public_tokenizers

            special = {x["content"]: x["id"] for x in file["added_tokens"]}
            byte = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(byte[c] for c in w): k for w, k in file["model"]["vocab"].items() if w not in special}
            self.fast = tiktoken.Encoding("cache", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.unusual = re.compile(rf"[^\x00-\u{PLAIN - 1:04x}]")

    @functools.cached_property
    def library(self):
        """The tokenizers library, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def count(self, texts: list[str]) -> list[int]:
        out, rest = [], []
        for k, t in enumerate(texts):
            n = -1
            if self.fast and (t.isascii() or not self.unusual.search(t)):
                try:
                    n = len(self.fast.encode(t, allowed_special="all"))
                except Exception:  # its pattern engine gives up on some very long runs; the library below does not
                    n = -1
            if n < 0:
                rest.append(k)
            out.append(n)
        if rest:
            for k, e in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = len(e.ids)
        return out


_counters: dict[str, Counter] = {}


def version_of(path: str) -> str:
    """Digest of the tokenizer's file and library version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def encode_misses(texts: DataFrame, path: str, version: str) -> DataFrame:
    """digest and _text to rows of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path)
        for b in chunks(batches, "_text", 1 << 21):
            t = b.column("_text")
            n = pc.binary_length(t).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * b.num_rows, pa.string()), n, pa.array(_counters[path].count(t.to_pylist()), pa.int64())], names=["digest", "version", "n_bytes", "n_tokens"])

    return arrow_map(texts, run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache: str, *, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row. cache: a folder of shared storage, made if it isn't there."""
    docs = adopt(docs)
    spark = docs.sparkSession
    version = version_of(path)
    keys = keyed(docs, doc_id, text)
    firsts = keys.groupBy("digest").agg(F.min("_id").alias("_id"))
    columns = ["digest", "n_bytes", "n_tokens"]
    # the cache is read once, for this run's digests; all that is written has the size of this run
    known = kept(read_cache(spark, cache).where(F.col("version") == version).join(firsts.select("digest"), "digest", "left_semi").select(columns).dropDuplicates(["digest"]))
    misses = kept(firsts.join(known.select("digest"), "digest", "left_anti"))
    held = [known, misses]
    wanted = first_texts(docs, keys, misses, doc_id, text, held=held)
    new = cut(compact(encode_misses(wanted, path, version)), "new-counts")
    counts = cut(known.unionByName(new.select(columns)), "counts")
    free(*held)
    append(new, cache)  # last: what is kept of a folder is computed anew when rows are added to it
    return keys.join(counts, "digest").select(F.col("_id").alias(doc_id), "n_bytes", "n_tokens")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def compacted(spark: SparkSession, cache: str, to: str) -> None:
    """A copy of a cache or ledger, without repeated keys and in few files, for when many runs have appended to it."""
    spark.read.parquet(cache).dropDuplicates(["digest", "version"]).hint("rebalance").write.partitionBy("version").parquet(to)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents"), cache_path(spark, "token-cache"), path=public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
