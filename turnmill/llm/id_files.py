"""Token ids in binary files: written in ascending order of their documents, block-coded by mixing_coder, and read back.

Writing. Documents are range-partitioned by (id, row), so that one id with most of the rows is no hot key, sorted and tokenized where they then lie. A run of documents with `SEGMENT` ids
or a few more is a segment: a head, a table of its documents, and its ids in blocks of `mixing_coder.BLOCK`, which know nothing of documents. A segment is a row of Spark's
text sink, as bytes, so files can lie in any store that Spark writes to and a task that is repeated replaces its files whole; a file has `SEGMENTS` of them, one line break after each.

Segment, little-endian: `HEAD` (magic, partition, number in it, documents, blocks, bytes of the table, CRC-32 of the table), the table (zlib: nulls of ids as bytes, ids as int64,
numbers of token ids as uint32), then for each block `BLOCK_HEAD` (ids, bytes, CRC-32 of the payload, CRC-32 of its ids as uint32) and its payload.

Reading. Files come through the binaryFile source; blocks of a segment are decoded in step and checked. A document's start is its place in its segment after what lies before the
segment: sums of segments within a partition and of partitions, never of documents, are ordered. A wrong checksum or a missing byte fails the read.

Defined results: null text counts as empty (the end id alone); repeated rows are documents of their own, in the order of their rows; a null id comes first; ids are whole numbers of 64 bits;
texts may be of any length (a document lies in one segment); extra columns are ignored; an empty table gives no documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnmill.llm import mixing_coder as M
from turnmill.llm.common import arrow_map, chunks, cut, table
from turnmill.llm.packing import END, tokenizer, tokenizer_path
from turnmill.llm.word_batches import Batches
from turnmill.session import new_path

MAGIC = b"TMID\1"
HEAD = struct.Struct("<5sIIIIII")
BLOCK_HEAD = struct.Struct("<HIII")
SEGMENT = M.LANES * M.BLOCK
SEGMENTS = 8

_batches: dict[str, Batches] = {}


def batches_of(path: str) -> Batches:
    if path not in _batches:
        _batches[path] = Batches(tokenizer(path))
    return _batches[path]


def segment(part: int, number: int, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of documents with sizes.sum() ids."""
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    listed = zlib.compress(nulls.tobytes() + doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + sizes.astype("<u4").tobytes(), 1)
    blocks = [ids[k : k + M.BLOCK] for k in range(0, len(ids), M.BLOCK)]
    narrow = [b.astype(np.uint16) for b in blocks] if len(ids) and ids.max() <= 0xFFFF else blocks
    out = [HEAD.pack(MAGIC, part, number, len(sizes), len(blocks), len(listed), zlib.crc32(listed)), listed]
    for b, p in zip(blocks, M.encode(narrow), strict=True):
        out += [BLOCK_HEAD.pack(len(b), len(p), zlib.crc32(p), zlib.crc32(b.astype("<u4").tobytes())), p]
    return b"".join(out)


def segments(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(partition, number, nulls, document ids, sizes, token ids) of each segment of a file."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(content):
            raise ValueError("a file of ids ends within a segment")
        return content[at - n : at]

    while at < len(content):
        magic, part, number, n_docs, n_blocks, size, crc = HEAD.unpack(take(HEAD.size))
        listed = take(size)
        if magic != MAGIC or zlib.crc32(listed) != crc:
            raise ValueError(f"segment {number} of partition {part}: its head or its documents are damaged")
        listed = zlib.decompress(listed)
        nulls, doc_ids, sizes = (np.frombuffer(listed, kind, n_docs, skip * n_docs) for kind, skip in ((np.uint8, 0), ("<i8", 1), ("<u4", 9)))
        heads, payloads = [], []
        for _ in range(n_blocks):
            heads.append(BLOCK_HEAD.unpack(take(BLOCK_HEAD.size)))
            payloads.append(take(heads[-1][1]))
            if zlib.crc32(payloads[-1]) != heads[-1][2]:
                raise ValueError(f"segment {number} of partition {part}: block {len(heads) - 1} is damaged")
        blocks = M.decode(payloads, [h[0] for h in heads])
        for k, (b, h) in enumerate(zip(blocks, heads, strict=True)):
            if zlib.crc32(b.astype("<u4").tobytes()) != h[3]:
                raise ValueError(f"segment {number} of partition {part}: block {k} gives other ids than were written")
        if take(1) != b"\n":
            raise ValueError(f"segment {number} of partition {part} has no end")
        yield part, number, nulls, doc_ids, sizes.astype(np.int64), np.concatenate([*blocks, np.zeros(0, np.uint32)])


def write_ids(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END, tokens: str | None = None, size: int = SEGMENT) -> None:
    """Files of the token ids of all rows, with the end id after each document."""
    tokens = tokens or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(text, F.lit("")).alias("_text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, "_id", "_row").sortWithinPartitions("_id", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0
        encode = batches_of(tokens).encode

        def out() -> pa.RecordBatch:
            doc_ids, sizes, ids = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([segment(part, number, pa.chunked_array(doc_ids).combine_chunks(), np.concatenate(sizes), np.concatenate(ids))], pa.binary())], names=["segment"])

        for b in chunks(batches, "_text", 1 << 21):
            ids, sizes = encode(b.column("_text").to_pylist())
            ids = np.insert(ids, np.cumsum(sizes), end)
            held.append((b.column("_id"), sizes + 1, ids))
            count += len(ids)
            if count >= size:
                yield out()
                number, held, count = number + 1, [], 0
        if held:
            yield out()

    arrow_map(dealt, run, "segment binary").select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", SEGMENTS).text(path)


ROW = "_part bigint, _number bigint, doc_id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint"


def read_ids(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files below path, and with `ids` its ids."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for part, number, nulls, doc_ids, sizes, every in segments(content.as_py()):
                    ends = np.cumsum(sizes)
                    whole = every.astype("<u4")
                    crcs = [zlib.crc32(whole[a:z]) for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                    n = len(sizes)
                    cols = [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(every.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, names=["_part", "_number", "doc_id", "_at", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    docs = cut(arrow_map(files, run, ROW + ", ids array<bigint>" * ids), "ids-read")
    sums = docs.groupBy("_part", "_number").agg(F.sum("n_tokens").alias("_n"))
    parts = sums.groupBy("_part").agg(F.sum("_n").alias("_n"))  # a row for each partition of the writer
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.select("_part", upto(Window.orderBy("_part")).alias("_before"))
    inside = sums.select("_part", "_number", upto(Window.partitionBy("_part").orderBy("_number")).alias("_inside"))
    found = docs.join(inside, ["_part", "_number"]).join(F.broadcast(before), "_part")
    return found.select("doc_id", (F.col("_before") + F.col("_inside") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "id-files")
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path)
