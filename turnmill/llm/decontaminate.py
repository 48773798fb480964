"""Benchmark decontamination with training suffix arrays.

The training texts are cut into shards (whole documents, about `SHARD_BYTES` of text). Each task builds, for each of its
shards, a suffix array over the shard's words and binary-searches every suffix of every test item in it. The depth at
which a suffix's interval runs empty is its longest verbatim match in the shard; the interval at the depth of a window
holds all places where that window occurs. Nothing is shuffled. The array is sorted only as deep as the longest
test item has words: a deeper order can't change an interval.

Test items are taken in blocks of at most `BLOCK_BYTES` of text; a block's tables are broadcast (they grow with its words;
one longer item is a block by itself), and further blocks are further passes over the same rows.

Defined results: texts may be of any length (a long one is a shard by itself); of longest matches of one length that with the least doc_id (as a string) and place is
taken; an empty table of tests hits nothing; null or empty text has no words and is never hit; null item texts are never found; an item shorter than the
window is one window; equal items each count; rows with a repeated doc_id stand for themselves; extra columns are kept by
`decontaminate` and ignored by `contamination`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.common import arrow_map, chunks, table, text_bytes

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20

#: A-Z to a-z; 0 for what is no word byte. Bytes of non-ASCII characters are word bytes.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], dtype=np.uint8)
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1, at least, of ODD and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((ODD, INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Words:
    """Words of some texts: lower-cased bytes, where words start and end, 64-bit hashes, and words per text."""

    def __init__(self, texts: list[bytes]):
        raw = b"\0".join(texts) + b"\0"
        low = LOWER[np.frombuffer(raw, np.uint8)]
        is_word = np.zeros(len(low) + 1, np.int8)
        is_word[1:] = low != 0
        edge = np.diff(is_word)
        self.low, self.start, self.end = low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(low) + 1)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low.astype(np.uint64) * up[: len(low)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        self.hash = h ^ (h >> np.uint64(32))
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=at[1:])
        self.first = np.searchsorted(self.start, at)  # of each text
        self.count = np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


class Tests:
    """A block of test items: distinct words, all suffixes (as places in the items' words), and their windows. Flat arrays of a few numbers for each word."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.ids = [i for i, _ in items]
        w = Words([t for _, t in items])
        by: dict[bytes, int] = {}
        tokens = np.fromiter((by.setdefault(w.word(i), len(by)) for i in range(len(w.start))), np.int64, len(w.start))
        self.words = list(by)
        self.hashes = Words(self.words).hash if self.words else np.zeros(0, np.uint64)
        same: dict[bytes, list[int]] = {}  # items of the same words, which are one text from here on
        for k in range(len(items)):
            if w.count[k]:
                same.setdefault(tokens[w.first[k] : w.first[k + 1]].tobytes(), []).append(k)
        self.items = list(same.values())
        count = np.array([len(x) // 8 for x in same], np.int64)
        start = np.cumsum(count + 1) - count - 1
        self.flat = np.full(int((count + 1).sum()), -1, np.int64)  # words of each text, and -1
        for x, to, n in zip(same, start.tolist(), count.tolist(), strict=True):
            self.flat[to : to + n] = np.frombuffer(x, np.int64)
        self.text = np.repeat(np.arange(len(count)), count)  # of each suffix
        self.at = np.flatnonzero(self.flat >= 0)
        self.place = self.at - start[self.text] if len(count) else self.at
        self.length = count[self.text] - self.place if len(count) else self.at
        self.longest = int(self.length.max(initial=0))
        self._windows()

    def _windows(self) -> None:
        """The distinct windows: words, a suffix that starts with each, and the texts that hold it."""
        first = np.zeros(len(self.at), np.int64)  # number of a suffix's first m words among all such beginnings
        lengths, starts, pairs = [], [], []
        size = np.minimum(self.length, self.window)
        own = (self.length >= self.window) | (self.place == 0)
        known = 0
        for m in range(1, self.window + 1):
            rows = np.flatnonzero(self.length >= m)
            if not len(rows):
                break
            word = self.flat[self.at[rows] + m - 1]
            _, first[rows] = np.unique(first[rows] * (len(self.words) + 1) + word, return_inverse=True)
            rows = np.flatnonzero(own & (size == m))
            if len(rows):
                _, one, number = np.unique(first[rows], return_index=True, return_inverse=True)
                lengths.append(np.full(len(one), m, np.int64))
                starts.append(rows[one])
                pairs.append(np.unique(np.stack([number + known, self.text[rows]], axis=1), axis=0))
                known += len(one)
        none = np.zeros(0, np.int64)
        self.window_length, self.window_start = np.concatenate([none, *lengths]), np.concatenate([none, *starts])
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
        self.text_of_window, self.window_edge = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(known + 1))

    def texts_of(self, window: int) -> np.ndarray:
        return self.text_of_window[self.window_edge[window] : self.window_edge[window + 1]]


class Shard:
    """Suffix array over the words of some texts, a mark after each, in the order of the words' hashes to `depth` words."""

    def __init__(self, texts: list[bytes], depth: int):
        self.words = w = Words(texts)
        n = len(w.start) + len(texts)
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        self.one_of = None
        self.token = np.zeros(n + 3, np.int64)  # 0 marks an end
        self.slot = np.arange(len(w.start)) + np.repeat(np.arange(len(texts)), w.count)
        self.token[self.slot] = ids + 1
        self.text_of = np.repeat(np.arange(len(texts)), w.count + 1)
        self.text_slot = w.first[:-1] + np.arange(len(texts))
        bits = int(len(self.vocabulary)).bit_length()
        self.packed = max(1, min(3, 63 // max(1, bits)))
        self.bits = bits
        self.span = self.packed
        t = self.token
        key = t[:n].copy()
        for d in range(1, self.packed):
            key = (key << bits) | np.where(self._open(key, bits), t[d : n + d], 0)
        self.order = np.argsort(key)
        self.key = key[self.order]
        self._deepen(depth, n)

    @staticmethod
    def _open(key: np.ndarray, bits: int) -> np.ndarray:
        """Whether a key's last word is a word: nothing is read beyond a mark."""
        return (key & ((1 << bits) - 1)) != 0

    def _deepen(self, depth: int, n: int) -> None:
        """Prefix doubling, on what is still tied: rank pairs at a distance of the depth sorted so far."""
        if n < 2:
            return
        new = np.ones(n, bool)
        new[1:] = self.key[1:] != self.key[:-1]
        ended = ~self._open(self.key, self.bits)  # equal to the mark: nothing further to compare
        rank = np.zeros(n + 1, np.int64)
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
        rank[self.order] = group
        have = self.packed
        tied = np.flatnonzero(~(new & np.append(new[1:], True)) & ~ended)
        while have < depth and len(tied):
            at = self.order[tied]
            pair = (rank[at] << 32) | rank[np.minimum(at + have, n)]
            by = np.argsort(pair, kind="stable")
            at, pair = at[by], pair[by]
            self.order[tied] = at
            fresh = np.ones(len(at), bool)
            fresh[1:] = pair[1:] != pair[:-1]
            rank_here = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))] + 1
            rank[at] = rank_here
            have *= 2
            tied = tied[~(fresh & np.append(fresh[1:], True))]

    def search(self, tests: Tests) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """Longest match of each suffix, (window, from, to) of the array for windows that occur, and one place of each longest match."""
        found = np.minimum(np.searchsorted(self.vocabulary, tests.hashes), max(0, len(self.vocabulary) - 1))
        ids = np.where(self.vocabulary[found] == tests.hashes, found + 1, -1) if len(self.vocabulary) else np.full(len(tests.hashes), -1)
        for k in np.flatnonzero(ids > 0):  # a hash may lie: compare the words
            if self._sample(ids[k] - 1) != tests.words[k]:
                ids[k] = -1
        m = len(tests.length)
        best, place = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.order), np.int64)
        active = np.arange(m)
        windows: list[tuple[int, int, int]] = []
        n = len(self.order)
        prefix = np.zeros(m, np.int64)
        for d in range(tests.longest):
            word = tests.flat[tests.at[active] + d]
            ok = word >= 0
            word = np.where(ok, ids[np.maximum(word, 0)], -1)
            active, word = active[word > 0], word[word > 0]
            if not len(active):
                break
            if d < self.packed:
                prefix[active] = (prefix[active] << self.bits) | word
                shift = self.bits * (self.packed - 1 - d)
                left = np.searchsorted(self.key, prefix[active] << shift)
                right = np.searchsorted(self.key, (prefix[active] + 1) << shift)
            else:
                left = self._bound(lo[active], hi[active], d, word, n)
                right = self._bound(left, hi[active], d, word + 1, n)
            some = left < right
            active, lo_, hi_ = active[some], left[some], right[some]
            lo[active], hi[active] = lo_, hi_
            best[active] = d + 1
            place[active] = self.order[lo_]
            due = np.flatnonzero(tests.window_length == d + 1) if d < tests.window else []
            if len(due):
                due = due[best[tests.window_start[due]] == d + 1]
                k = tests.window_start[due]
                windows += zip(due.tolist(), lo[k].tolist(), hi[k].tolist(), strict=True)
        return best, windows, place

    def _bound(self, lo: np.ndarray, hi: np.ndarray, d: int, word: np.ndarray, n: int) -> np.ndarray:
        """First place in [lo, hi) of the array whose word at distance d isn't below `word`."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                return lo
            mid = (lo[go] + hi[go]) >> 1
            less = self.token[np.minimum(self.order[mid] + d, n)] < word[go]
            lo[go] = np.where(less, mid + 1, lo[go])
            hi[go] = np.where(less, hi[go], mid)

    def _sample(self, word: int) -> bytes:
        if self.one_of is None:
            self.one_of = np.zeros(len(self.vocabulary), np.int64)
            self.one_of[self.token[self.slot] - 1] = np.arange(len(self.slot))
        return self.words.word(int(self.one_of[word]))

    def hits(self, tests: Tests) -> tuple[np.ndarray, list[list[str]]]:
        """Of each text: whether each of its words (with end marks) is hit, and the items whose windows occur in it."""
        _, windows, _ = self.search(tests)
        marks = np.zeros(len(self.token) + tests.window + 1, np.int64)
        items: list[list[str]] = [[] for _ in range(len(self.text_slot))]
        pairs: dict[int, set[int]] = defaultdict(set)
        for v, a, b in windows:
            at = self.order[a:b]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + tests.window_length[v], -1)
            texts = tests.texts_of(v).tolist()
            for t in np.unique(self.text_of[at]).tolist():
                pairs[t].update(texts)
        for t, found in pairs.items():
            items[t] = sorted(tests.ids[k] for x in found for k in tests.items[x])
        return np.cumsum(marks)[: len(self.token)] > 0, items


def blocks(tests: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Test items, in blocks of at most `most` bytes of text (or one item)."""
    held: list[tuple[str, bytes]] = []
    size = 0
    rows = tests.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    for i, t in rows.toLocalIterator():
        x = t.encode("utf-8", "surrogatepass")
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(("" if i is None else i, x))
        size += len(x)
    if held:
        yield held


SPANS = "array<struct<start:bigint,end:bigint>>"


def contamination(docs: DataFrame, tests: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: the `keep` columns, n_words, spans (words hit, end exclusive, one list for each block of tests) and items (ids, as strings)."""
    spark = docs.sparkSession
    out = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"), F.lit(None).cast("bigint").alias("n_words"),
                      F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    # at least one pass, so that n_words is there without tests as well
    for block in list_or_empty(blocks(tests, item_id, item_text, block_bytes)):
        known = spark.sparkContext.broadcast(Tests(block, window))
        out = arrow_map(out, lambda it, known=known: _pass(it, known.value, shard_bytes), out.schema)
    return out.drop("_text")


def list_or_empty(found: Iterator[list]) -> Iterator[list]:
    some = False
    for x in found:
        some = True
        yield x
    if not some:
        yield []


def _pass(batches: Iterator[pa.RecordBatch], tests: Tests, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "_text", shard_bytes):
        shard = Shard(text_bytes(batch.column("_text")), tests.longest)
        hit, items = shard.hits(tests)
        spans = batch.column("spans").to_pylist()
        found = batch.column("items").to_pylist()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2).tolist():
            t = int(shard.text_of[a])
            spans[t].append({"start": a - int(shard.text_slot[t]), "end": b - int(shard.text_slot[t])})
        found = [x + y for x, y in zip(found, items, strict=True)]
        put = {"n_words": pa.array(shard.words.count, pa.int64()), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(found, batch.schema.field("items").type)}
        yield pa.RecordBatch.from_arrays([put.get(n, batch.column(k)) for k, n in enumerate(batch.schema.names)], names=batch.schema.names)


def longest_matches(docs: DataFrame, tests: DataFrame, *, least: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim match over all shards of each test suffix, if it has `least` words: item_id, item_pos, match_words, doc_id, doc_pos (of words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("_text"))
    out = None
    for block in list_or_empty(blocks(tests, item_id, item_text, block_bytes)):
        known = spark.sparkContext.broadcast(Tests(block, WINDOW))

        def search(it: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in chunks(it, "_text", shard_bytes):
                shard = Shard(text_bytes(batch.column("_text")), known.value.longest)
                best, _, place = shard.search(known.value)
                ids = batch.column("doc_id").to_pylist()
                test = known.value
                found = [(test.ids[k], int(test.place[s]), int(best[s]), ids[shard.text_of[place[s]]], int(place[s] - shard.text_slot[shard.text_of[place[s]]]))
                         for s in np.flatnonzero(best >= least).tolist() for k in test.items[test.text[s]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                                                 names=["item_id", "item_pos", "match_words", "doc_id", "doc_pos"])

        part = arrow_map(rows, search, "item_id string, item_pos bigint, match_words bigint, doc_id string, doc_pos bigint")
        out = part if out is None else out.unionByName(part)
    best = F.min_by(F.struct("match_words", "doc_id", "doc_pos"), F.struct(-F.col("match_words"), "doc_id", "doc_pos"))
    return out.groupBy("item_id", "item_pos").agg(best.alias("b")).select("item_id", "item_pos", "b.*")


def decontaminate(docs: DataFrame, tests: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no window of a test item occurs, with docs' columns."""
    spark = docs.sparkSession
    out = docs
    for block in blocks(tests, item_id, item_text, block_bytes):
        known = spark.sparkContext.broadcast(Tests(block, window))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text, shard_bytes):
                shard = Shard(text_bytes(batch.column(text)), known.value.longest)
                yield batch.filter(pa.array([not x for x in shard.hits(known.value)[1]]))

        out = arrow_map(out, run, docs.schema)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("items"))
    # spans of one block never overlap; those of several may, so positions are counted once
    one = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
                      lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    return found.select("doc_id", "n_words", one.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))

