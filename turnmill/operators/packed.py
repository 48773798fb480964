"""n-grams in exchange: they go to their buckets in compressed blocks, not a row for each.

A task takes its texts in chunks of bounded size. The n-grams of a chunk are sorted and counted as numbers of its words, and those of one bucket leave as a block: the block's words once, then columns of their
numbers, by bytes of equal weight, under zstd. A bucket is the n-grams of one hash value, so it is merged by itself; the number of buckets grows with the text, so that a bucket doesn't.
A bucket is merged a share at a time: shares are cut by the hash as well and compressed apart, so the rows of one share are all that is opened at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from turnmill.session import adopt, release

#: Words and bytes of a chunk; a longer text is a chunk by itself.
CHUNK_WORDS, CHUNK_BYTES = 2_000_000, 32 << 20
#: Characters of text for each bucket, and the buckets that a small text has, so that a few cores have work. Larger buckets have larger blocks, which share more words.
BUCKET_CHARS, LEAST_BUCKETS = 64 << 20, 12
#: Parts of a bucket that are merged one after the other.
SHARES = 16
#: A word that comes so often in a chunk is numbered by its frequency; the others by the alphabet, in which they compress well.
COMMON = 8
#: Characters of the rows whose words are counted before, and words for each bucket that n-grams don't follow.
SAMPLE_CHARS, LEADERS = 20_000_000, 30
#: Bytes of blocks, and rows of results, that leave Python at once.
OUT_BYTES, OUT_ROWS = 4 << 20, 50_000
#: Pairs that are held at once while candidates are looked up.
PAIRS = 2_000_000


def characters(*texts: tuple[DataFrame, Column]) -> int:
    return sum(df.agg(F.sum(F.length(x).cast("bigint"))).first()[0] or 0 for df, x in texts)


def buckets_for(chars: int) -> int:
    return max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))


def frequent(words: DataFrame, chars: int, buckets: int) -> list[str]:
    """The most frequent words of some rows, among them all that alone make a tenth of a bucket. They decide which bucket an n-gram goes to, and nothing else."""
    some = words.sample(SAMPLE_CHARS / chars, 7) if chars > SAMPLE_CHARS else words
    each = some.select(F.explode("_w").alias("word")).groupBy("word").count()
    return [r.word for r in each.orderBy(F.desc("count"), "word").limit(LEADERS * buckets).collect()]


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers, dtype="<u4").view("u1").reshape(-1, 4).T.tobytes()


def _zip(raw: bytes, level: int = 1) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _unzip(block: bytes) -> bytes:
    return pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)


def _words_for(words: pa.Array, columns: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """The words that columns of their numbers need, as a piece, and the number of each there."""
    used = np.zeros(len(words), bool)
    for c in columns:
        used[c] = True
    own = words.take(pa.array(np.flatnonzero(used)))
    lengths, text = pc.binary_length(own).to_numpy(), own.buffers()[2]
    piece = _zip(_planes(lengths) + (text.to_pybytes()[: int(lengths.sum())] if text else b""), 6)
    return len(own).to_bytes(8, "little") + piece, np.cumsum(used, dtype=np.uint32) - np.uint32(1)


def _numbers_in(columns: list[np.ndarray], *more: np.ndarray) -> bytes:
    """Columns of numbers, the first of which is mostly sorted, and further lists."""
    sizes = np.array([len(columns), *map(len, columns), *map(len, more)], "<u4")
    steps = np.diff(columns[0].astype(np.uint32), prepend=np.uint32(0))
    return len(sizes).to_bytes(8, "little") + _zip(b"".join([sizes.tobytes(), _planes(steps), *map(_planes, columns[1:]), *map(_planes, more)]))


def _read(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "u1", 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def _words_of(piece: bytes) -> pa.Array:
    n, raw = int.from_bytes(piece[:8], "little"), _unzip(piece[8:])
    offsets = np.concatenate([[0], np.cumsum(_read(raw, 0, n))]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[4 * n :]))


def _numbers_of(piece: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(columns, further lists)."""
    many, raw = int.from_bytes(piece[:8], "little"), _unzip(piece[8:])
    k, *sizes = np.frombuffer(raw, "<u4", many).tolist()
    at, out = 4 * many, []
    for n in sizes:
        out.append(_read(raw, at, n))
        at += 4 * n
    out[0] = np.cumsum(out[0], dtype=np.uint32)
    return out[:k], out[k:]


class _Chunk:
    """Texts (_w: their words) as numbers of words: ids of all positions, the line of each, and how many words are left from it on."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        batches.clear()
        self.keys = table.column("_key").combine_chunks() if "_key" in table.column_names else None
        lists = table.column("_w").chunk(0)
        self.lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        del table, lists
        ids, words = coded.indices.to_numpy(), coded.dictionary
        comes = np.bincount(ids, minlength=len(words))
        common, rare = np.flatnonzero(comes >= COMMON), np.flatnonzero(comes < COMMON)
        order = np.concatenate([common[np.argsort(-comes[common], kind="stable")], rare[pc.sort_indices(words.take(pa.array(rare))).to_numpy()]])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.ids = words.take(pa.array(order)), place[ids]
        self.line = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.left = np.repeat(np.cumsum(self.lengths, dtype=np.int32), self.lengths) - np.arange(len(ids), dtype=np.int32)
        self.hashes = np.fromiter((zlib.crc32(w.encode()) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def with_empty(self) -> int:
        """The number of the empty word, which is added where no text has it."""
        if (at := pc.index(self.words, "").as_py()) < 0:
            at, self.words, self.hashes = len(self.words), pa.concat_arrays([self.words, pa.array([""])]), np.append(self.hashes, np.uint64(zlib.crc32(b"")))
        return at

    def columns(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        return [self.ids[at + k] for k in range(n)]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Chunk]:
    held, words, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        words, size = words + len(batch.column("_w").flatten()), size + batch.nbytes
        del batch
        if words >= CHUNK_WORDS or size >= CHUNK_BYTES:
            yield _Chunk(held)  # which empties the list
            words, size = 0, 0
            release()
    if held:
        yield _Chunk(held)
        release()


def _keys(columns: list[np.ndarray], most: int) -> np.ndarray:
    """A number for each row of numbers below `most`, in the rows' order."""
    key, size = columns[0].astype(np.int64), most
    for c in columns[1:]:
        if size * most >= 1 << 63:
            key, size = np.unique(key, return_inverse=True)[1].astype(np.int64), len(key)
        key, size = key * most + c, size * most
    return key


def _cells(numbers: list[np.ndarray], buckets: int, rows: int, lead: np.ndarray | None = None) -> np.ndarray:
    """The bucket and the share of each row by the hash of its numbers: bucket * SHARES + share. lead: a number that makes the bucket where it isn't 0."""
    h = np.full(rows, 1469598103934665603, np.uint64)
    for x in numbers:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    to = h if lead is None else np.where(lead > 0, (lead * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), h)
    return ((to % np.uint64(buckets)) * np.uint64(SHARES) + (h >> np.uint64(40)) % np.uint64(SHARES)).astype(np.int32)


def _bounds(cells: np.ndarray, order: np.ndarray, buckets: int) -> np.ndarray:
    """Where each cell begins in an order by cell."""
    return np.searchsorted(cells[order], np.arange(buckets * SHARES + 1))


def _sent(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """(bucket, pieces, keys) in batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[1]))
        if size >= OUT_BYTES:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held), _BLOCKS.types)], schema=_BLOCKS)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held), _BLOCKS.types)], schema=_BLOCKS)


def _joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    parts = [words.take(pa.array(c)) for c in columns]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")


BLOCKS = "bucket int, pieces array<binary>, keys binary"
_BLOCKS = pa.schema([("bucket", pa.int32()), ("pieces", pa.list_(pa.binary())), ("keys", pa.binary())])


def counted(words: DataFrame, orders: list[int], compat: bool, chars: int, more_than: int = 0) -> DataFrame:
    """(n, ngram, freq) of an array of words, _w; compat: the last n-gram of a text is left out; chars: of all texts.

    An n-gram follows its longest word, so a rare word lies in the blocks of one bucket and not of most. Frequent words (a short list of the driver's) are not followed, so none makes a large bucket.
    """
    buckets = buckets_for(chars)
    known = pa.array(frequent(words, chars, buckets), pa.string())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chunk in _chunks(batches):
                lead = np.minimum(pc.utf8_length(chunk.words).to_numpy(), 255).astype(np.uint64) << np.uint64(32) | chunk.hashes
                lead[pc.is_in(chunk.words, value_set=known).to_numpy(zero_copy_only=False)] = 0
                found = []
                for n in orders:
                    columns = chunk.columns(np.flatnonzero(chunk.left >= n + compat), n)
                    _, first, freq = np.unique(_keys(columns, len(chunk.words) + 1), return_index=True, return_counts=True)
                    columns = [c[first] for c in columns]
                    cells = _cells([chunk.hashes[c] for c in columns], buckets, len(first), np.maximum.reduce([lead[c] for c in columns]))
                    order = np.argsort(cells, kind="stable")
                    found.append(([c[order] for c in columns], freq[order], _bounds(cells, order, buckets)))
                for b in range(buckets):
                    of = [(columns, freq, bounds[b * SHARES : (b + 1) * SHARES + 1]) for columns, freq, bounds in found]
                    if any(at[0] < at[-1] for *_, at in of):
                        piece, local = _words_for(chunk.words, [c[at[0] : at[-1]] for columns, _, at in of for c in columns])
                        yield b, [piece, *[_numbers_in([local[c[lo:hi]] for c in columns], freq[lo:hi]) for columns, freq, at in of for lo, hi in zip(at, at[1:])]], None

        yield from _sent(rows())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [x for batch in batches for x in batch.column("pieces").to_pylist()]
        words = [_words_of(x[0]) for x in pieces]
        for k, n in enumerate(orders):
            for share in range(SHARES):
                grams, freqs = [], []
                for own, x in zip(words, pieces):
                    columns, (freq,) = _numbers_of(x[1 + k * SHARES + share])
                    grams.append(_joined(own, columns))
                    freqs.append(pa.array(freq.astype(np.int64)))
                found = pa.table({"ngram": pa.chunked_array(grams), "freq": pa.chunked_array(freqs)}).group_by("ngram", use_threads=False).aggregate([("freq", "sum")])
                if more_than:
                    found = found.filter(pc.greater(found.column("freq_sum"), more_than))
                for batch in found.select(["ngram", "freq_sum"]).to_batches(max_chunksize=OUT_ROWS):
                    yield pa.record_batch([pa.array(np.full(len(batch), n, np.int32)), *batch.columns], names=["n", "ngram", "freq"])
        release()

    blocks = adopt(words.select("_w")).mapInArrow(packed, BLOCKS)
    return blocks.groupBy("bucket").applyInArrow(merged, "n int, ngram string, freq bigint")


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last character of each word as numbers from 1 on; 0 for an empty one."""
    own = words.to_pylist()
    return np.fromiter((1 + ord(w[0]) if w else 0 for w in own), np.uint64, len(own)), np.fromiter((1 + ord(w[-1]) if w else 0 for w in own), np.uint64, len(own))


def _any(words: pa.Array, heads: list[str] | None, has: Callable) -> np.ndarray:
    out = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if heads is not None:
        out &= np.logical_or.reduce([has(words, h).to_numpy(zero_copy_only=False) for h in heads])
    return out


def _stored(keys: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([keys], ["key"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _affixes(parts: list[str], known: dict[str, int], ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each part the known ones that it ends (begins) with, as starts and a flat list of their numbers."""
    lengths = sorted({len(x) for x in known})
    counts, flat = [0], []
    for w in parts:
        for k in lengths:
            if k > len(w):
                break
            if (at := known.get(w[len(w) - k :] if ends else w[:k])) is not None:
                flat.append(at)
        counts.append(len(flat))
    return np.array(counts, np.int64), np.array(flat, np.int64)


def _spread(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x in `of` the places starts[x] to starts[x + 1]: (place in `of`, place in the flat list)."""
    n = starts[of + 1] - starts[of]
    rows = np.repeat(np.arange(len(of)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of], n)


def _among(keys: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of keys that are listed, their places in the sorted list)."""
    at = np.searchsorted(listed, keys)
    at[at == len(listed)] = 0
    hit = np.flatnonzero(listed[at] == keys)
    return hit, at[hit]


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows that make PAIRS pairs together, or one row."""
    after, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(after, (after[lo - 1] if lo else 0) + PAIRS, "right")))
        yield slice(lo, hi)
        lo = hi


class _Listed:
    """Different n-grams as columns of numbers of words, to be met by runs of as many parts."""

    def __init__(self, words: pa.Array, columns: list[np.ndarray]):
        self.words, self.columns, self.inner = words, columns, []
        inner = np.zeros(len(columns[0]), np.int64)
        for c in columns[1:-1]:
            known, inner = np.unique(inner * len(words) + c, return_inverse=True)
            self.inner.append(known)
        (firsts, first), (lasts, last) = (np.unique(columns[k], return_inverse=True) for k in (0, -1))
        self.firsts, self.lasts = ({w: k for k, w in enumerate(words.take(pa.array(x)).to_pylist())} for x in (firsts, lasts))
        self.heads, head = np.unique(inner * len(firsts) + first, return_inverse=True)  # without their last parts
        whole = head * len(lasts) + last
        self.order = np.argsort(whole)
        self.whole = whole[self.order]

    def met(self, words: pa.Array, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(run, n-gram) where the run's first part ends with the n-gram's, its last part begins with the n-gram's, and the inner parts are equal."""
        place = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        row, inner = np.arange(len(runs[0])), np.zeros(len(runs[0]), np.int64)
        for known, c in zip(self.inner, runs[1:-1]):
            at = place[c[row]]
            row, inner, at = row[at >= 0], inner[at >= 0], at[at >= 0]
            hit, inner = _among(inner * len(self.words) + at, known)
            row = row[hit]
        starts, numbers, of = [], [], []
        for known, c, ends in ((self.firsts, runs[0], True), (self.lasts, runs[-1], False)):
            parts, part = np.unique(c[row], return_inverse=True)
            for to, x in zip((starts, numbers), _affixes(words.take(pa.array(parts)).to_pylist(), known, ends)):
                to.append(x)
            of.append(part)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for some in _portions(np.diff(starts[0])[of[0]]):
            run, at = _spread(starts[0], of[0][some])
            run += some.start
            hit, head = _among(inner[run] * len(self.firsts) + numbers[0][at], self.heads)
            run = run[hit]
            for few in _portions(np.diff(starts[1])[of[1][run]]):
                k, at = _spread(starts[1], of[1][run[few]])
                k += few.start
                hit, gram = _among(head[k] * len(self.lasts) + numbers[1][at], self.whole)
                out.append((row[run[k[hit]]], self.order[gram]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _united(parts: list[tuple[pa.Array, list[np.ndarray]]]) -> tuple[pa.Array, list[np.ndarray]]:
    """Rows of several lists of words as rows of one."""
    used = [np.unique(np.concatenate(columns), return_inverse=True) for _, columns in parts]
    coded = pa.chunked_array([own.take(pa.array(x)) for (own, _), (x, _) in zip(parts, used)], pa.string()).combine_chunks().dictionary_encode()
    numbers, at, out = coded.indices.to_numpy().astype(np.int64), 0, []
    for (_, columns), (x, local) in zip(parts, used):
        out.append(np.split(numbers[at : at + len(x)][local], len(columns)))
        at += len(x)
    return coded.dictionary, [np.concatenate(c) for c in zip(*out)]


def met(rows: DataFrame, listed: DataFrame, kinds: list[tuple[int, bool, bool]], buckets: int, heads: list[str] | None = None, tails: list[str] | None = None) -> DataFrame:
    """(_key, ngram) for each text (_key, _w: its parts between blanks) and each n-gram of a list (_w: its parts) that the text holds. kinds: all that the list has of (parts, the first is empty, the last is).

    An n-gram is in a text where its inner parts are parts of the text, its first one ends the part before them, and its last one begins the part behind. So a run of the text and the n-grams in it have
    the same inner parts, the run's first part ends with the same character as theirs, and its last one begins with the same: these make the bucket. Each run and each n-gram goes to one bucket, and all runs that
    hold an n-gram meet there, so nothing is exchanged a second time. An empty first (last) part is in every part; for such kinds runs are sent once more, with that part left empty.
    heads (tails): runs whose first part holds (last part begins with) none of them are left out.
    """

    def celled(chunk: _Chunk, columns: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _cells([*[chunk.hashes[c] for c in columns[1:-1]], end[columns[0]], begin[columns[-1]]], buckets, len(columns[0]))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            for chunk in _chunks(batches):
                empty = chunk.with_empty()
                begin, end = _ends(chunk.words)
                first, last = _any(chunk.words, heads, pc.match_substring), _any(chunk.words, tails, pc.starts_with)
                held = []
                for n, open_first, open_last in kinds:
                    at = np.flatnonzero(chunk.left >= n)
                    at = at[(open_first | first[chunk.ids[at]]) & (open_last | last[chunk.ids[at + n - 1]])]
                    columns = chunk.columns(at, n)
                    for k in [0] * open_first + [-1] * open_last:
                        columns[k][:] = empty
                    key, cells = _keys(columns, len(chunk.words) + 1), celled(chunk, columns, begin, end)
                    order = np.lexsort((key, cells))
                    held.append(([c[order] for c in columns], key[order], chunk.line[at[order]], _bounds(cells, order, buckets)))
                for b in range(buckets):
                    of = [(columns, key, line, bounds[b * SHARES : (b + 1) * SHARES + 1]) for columns, key, line, bounds in held]
                    if not any(at[0] < at[-1] for *_, at in of):
                        continue
                    piece, local = _words_for(chunk.words, [c[at[0] : at[-1]] for columns, _, _, at in of for c in columns])
                    lines = np.unique(np.concatenate([line[at[0] : at[-1]] for _, _, line, at in of]))
                    pieces = [piece]
                    for columns, key, line, at in of:
                        for lo, hi in zip(at, at[1:]):
                            new = np.flatnonzero(np.diff(key[lo:hi], prepend=-1))  # the different runs
                            pieces.append(_numbers_in([local[c[lo:hi][new]] for c in columns], np.diff(new, append=hi - lo), np.searchsorted(lines, line[lo:hi])))
                    yield b, pieces, _stored(chunk.keys.take(pa.array(lines)))

        yield from _sent(sent())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            for chunk in _chunks(batches):
                begin, end = _ends(chunk.words)
                starts = np.cumsum(chunk.lengths) - chunk.lengths
                held = []
                for n, *opened in kinds:
                    at = starts[chunk.lengths == n]
                    for k, empty in zip((0, n - 1), opened):
                        at = at[(begin[chunk.ids[at + k]] == 0) == empty]
                    columns = chunk.columns(at, n)
                    _, one = np.unique(_keys(columns, len(chunk.words) + 1), return_index=True)
                    columns = [c[one] for c in columns]
                    cells = celled(chunk, columns, begin, end)
                    order = np.argsort(cells, kind="stable")
                    held.append(([c[order] for c in columns], _bounds(cells, order, buckets)))
                for b in range(buckets):
                    of = [(columns, bounds[b * SHARES : (b + 1) * SHARES + 1]) for columns, bounds in held]
                    if any(at[0] < at[-1] for _, at in of):
                        piece, local = _words_for(chunk.words, [c[at[0] : at[-1]] for columns, at in of for c in columns])
                        yield b, [piece, *[_numbers_in([local[c[lo:hi]] for c in columns]) for columns, at in of for lo, hi in zip(at, at[1:])]], None

        yield from _sent(sent())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, keys, before = ([], []), [], [0]
        for batch in batches:
            for pieces, stored in zip(batch.column("pieces").to_pylist(), batch.column("keys").to_pylist()):
                sides[stored is not None].append((_words_of(pieces[0]), pieces))
                if stored is not None:
                    keys.append(pa.ipc.open_stream(stored).read_all().column("key").combine_chunks())
                    before.append(before[-1] + len(keys[-1]))
        if not all(sides):
            return
        keys = pa.chunked_array(keys).combine_chunks()
        for k in range(1, 1 + len(kinds) * SHARES):
            opened = [(own, _numbers_of(pieces[k])[0]) for own, pieces in sides[0]]
            if not any(len(columns[0]) for _, columns in opened):
                continue
            words, columns = _united(opened)
            _, one = np.unique(_keys(columns, len(words) + 1), return_index=True)
            grams_here = _Listed(words, [c[one] for c in columns])
            held, size = [], 0
            for at, (own, pieces) in enumerate(sides[1]):  # a text lies in one block of a bucket
                columns, (many, line) = _numbers_of(pieces[k])
                held.append((own, columns, many, line + np.int64(before[at])))
                size += len(line)
                if size >= PAIRS or at + 1 == len(sides[1]):
                    if size:
                        run, gram = grams_here.met(*_united([x[:2] for x in held]))
                        starts = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in held]), dtype=np.int64)])
                        row, place = _spread(starts, run)
                        pairs = np.unique(np.concatenate([x[3] for x in held])[place] * len(one) + gram[row])  # an n-gram may be in a text more than once
                        for lo in range(0, len(pairs), OUT_ROWS):
                            of, gram = np.divmod(pairs[lo : lo + OUT_ROWS], len(one))
                            yield pa.record_batch([keys.take(pa.array(of)).cast(out.types[0]), _joined(words, [c[gram] for c in grams_here.columns])], schema=out)
                    held, size = [], 0
        release()

    schema = T.StructType([T.StructField("_key", rows.schema["_key"].dataType), T.StructField("ngram", T.StringType())])
    out = to_arrow_schema(schema)
    texts = adopt(rows.select("_key", "_w")).mapInArrow(runs, BLOCKS)
    return texts.unionByName(adopt(listed.select("_w")).mapInArrow(grams, BLOCKS)).groupBy("bucket").applyInArrow(found, schema)
