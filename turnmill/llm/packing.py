"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of pieces.

Each document is its token ids and an end id. It is cut after every `LENGTH` ids, so only its last piece leaves room
in a sequence. Tokens stay where they are made: what is shuffled is a row of a few numbers per piece. Documents are dealt at
random (by a hash of their rows' numbers, so that repeated ids are no hot key); a task packs runs of documents with `GROUP` pieces or a few more, each run
for itself. In a group, pieces go by falling length, each into the first sequence with room; the tree's nodes hold the greatest room below them, so a
place is found in log(sequences) steps.

Ids: as the tokenizers library gives them for the whole text, without added special tokens. Where a text holds only
characters from U+0001 to U+024F and no special token's string, it is split by the file's own pattern and its words go to tiktoken, with a zero byte for
the end-of-word mark (the file's ids are the order of its merges, as tiktoken wants them); that is three times as fast. Other texts go to the library.

Defined results: null text counts as empty (one piece, the end id); repeated rows are packed each; texts may be of any length (a document's
pieces are in one group); extra columns are ignored; ties in length go by the random order; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.common import arrow_map, byte_letters, chunks, table

LENGTH = 4096
END = 2
GROUP = 4096
SEED = 20
# Fixed value: the split pattern that the fast way is written for.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The fast way takes texts of characters below this only: categories and case there are the same in all libraries.
PLAIN = 0x250


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def char_class(kind: str) -> str:
    """Of the characters below PLAIN and their lower-case forms those whose category starts with `kind`, for use in a pattern's brackets."""
    every = sorted({x for c in map(chr, range(PLAIN)) for x in c + c.lower()})
    return "".join(re.escape(c) for c in every if unicodedata.category(c).startswith(kind))


class WordTokenizer:
    """Ids of whole texts for a lower-casing BPE file whose words are encoded one by one."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [x["content"] for x in file.get("added_tokens", [])]
        steps = (file.get("normalizer") or {}).get("normalizers", [])
        split = next((x for x in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        self.quick = None
        if split and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed" and split["invert"] and split["pattern"] == {"Regex": WORDS} and file["model"].get("end_of_word_suffix") == "</w>":
            import tiktoken

            byte = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(byte[c] for c in w.removesuffix("</w>")) + b"\0" * w.endswith("</w>"): i for w, i in file["model"]["vocab"].items() if w not in self.special}
            self.quick = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        # the file's pattern with its classes spelt out for the characters below PLAIN, where composition changes nothing
        letters, digits = char_class("L"), char_class("N")
        self.pattern = re.compile(WORDS.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]").replace(r"[^\s\p{L}\p{N}]", f"[^\t-\r \x85\xa0{letters}{digits}]"))
        self.unusual = re.compile(rf"[^\x01-\u{PLAIN - 1:04x}]")

    @functools.cached_property
    def whole(self):
        """The library itself, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> list[int]:
        if self.quick and not self.unusual.search(text) and not any(s in text for s in self.special):
            words = self.pattern.findall(text.lower())
            return self.quick.encode_ordinary("\0".join(words) + "\0") if words else []
        return self.whole.encode(text, add_special_tokens=False).ids


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECE = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, doc_no bigint"
#: Groups of a task, at most; a task is a shuffle partition's part as long as that is less.
GROUPS = 64


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row for each piece of each document (doc_no: a number of its row); with `ids`, its token ids as well."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("doc_no"), F.coalesce(text, F.lit("")).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text", 1 << 21):
            took, out, parts = [], [], []
            encode = tokenizer(path).encode
            for k, t in enumerate(b.column("_text").to_pylist()):
                a = np.array([*encode(t), end], "<u4")
                for s in range(0, len(a), length):
                    part = a[s : s + length]
                    took.append(k)
                    out.append((s, len(part), zlib.crc32(part.tobytes()), len(a)))
                    if ids:
                        parts.append(part.astype(np.int64))
            took = pa.array(took, pa.int64())
            cols = [b.column("doc_id").take(took), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True)), b.column("doc_no").take(took)]
            if ids:
                cols.append(pa.array(parts, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_no", "ids"][: len(cols)])

    return arrow_map(rows, run, PIECE.format(id=kind) + ", ids array<bigint>" * ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Ties go by position."""
    n = len(lengths)
    leaves = 1 << max(0, int(n - 1).bit_length())
    room = [capacity] * (2 * leaves)  # node k has children 2k and 2k + 1
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = int(lengths[i])
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < size:
                k += 1
        where[i], offset[i] = k - leaves, capacity - room[k]
        room[k] -= size
        k //= 2
        while k:
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
            k //= 2
    return where, offset


def pack(found: DataFrame, *, length: int = LENGTH, group: int = GROUP, seed: int = SEED, tasks: int | None = None) -> DataFrame:
    """pieces() with sequence_id and offset in place of doc_no. tasks: as many as the session's shuffle partitions, unless it is known how many rows come."""
    spark = found.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the number follows from the row, so a repeated task deals the same rows to the same places
    dealt = found.withColumn("_r", F.xxhash64("doc_no", F.lit(seed))).repartition(tasks, "_r").sortWithinPartitions("_r", "doc_no", "start").withColumn("_p", F.spark_partition_id().cast("bigint")).drop("_r")
    schema = dealt.drop("_p", "doc_no").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, done, last = [], 0, 0, -1

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, done
            t = pa.Table.from_batches(held)
            where, offset = first_fit_decreasing(t.column("length").to_numpy(), length)
            number = (t.column("_p").to_numpy() << 40) + done + where
            done += int(where.max()) + 1
            held, rows = [], 0
            yield from t.drop_columns(["_p", "doc_no"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            number = b.column("doc_no").to_numpy()
            begins = np.flatnonzero(np.diff(number, prepend=last))  # of documents
            at, last = 0, int(number[-1])
            while (k := int(np.searchsorted(begins, at + group - rows))) < len(begins):
                held.append(b.slice(at, int(begins[k]) - at))
                at = int(begins[k])
                yield from out()
            held.append(b.slice(at))
            rows += b.num_rows - at
        if rows:
            yield from out()

    return arrow_map(dealt, run, schema)


def pack_documents(docs: DataFrame, *, length: int = LENGTH, group: int = GROUP, **how) -> DataFrame:
    """Packed pieces of all rows of docs. Fewer tasks where the rows would not fill a group in each, more where a task would have more than `GROUPS` of them."""
    most, rows = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count()
    tasks = max(1, min(most, rows // group), rows // (GROUPS * group))
    return pack(pieces(docs, length=length, **how), length=length, group=group, tasks=tasks)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
