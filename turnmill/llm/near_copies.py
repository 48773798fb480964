"""Near copies of texts: SimHash and MinHash candidates, verified by the exact Jaccard similarity of their word shingles.

Words are those of `simhash`; a text's set is the XXH64 hashes of its `SHINGLE` = 5 words in a row, the whole text where it has fewer. Texts
of the same words are one node from the start. Two nodes are linked if the similarity of their sets is `SIMILARITY` = 0.8 or more.

Candidates of `simhash`: each text's fingerprint is made of the same shingles; equal fingerprints, and those that its pigeonhole blocks and Hamming check link, are compared on their
whole sets. Most pairs at 0.8 differ in more bits than blocks can bridge, so those of a second method are added, not put in its place.

Further candidates: 128 MinHashes in `BANDS` = 32 bands of `ROWS` = 4; texts that agree in a band meet. A pair at 0.8 meets in none with
probability (1 - 0.8^4)^32 = 5e-8, one of higher similarity more rarely; what doesn't reach 0.8 is dropped when the sets are compared.

Buckets of at most `BUCKET` nodes are joined with themselves. Of a larger one all are first compared with one centre, the node that shares
most buckets with others (the text that the rest are edits of, as a rule), and linked if similar. What isn't in the bucket's largest component then is
compared with all that is outside its own component, in tasks of `BLOCK` x `BLOCK` nodes, by sketches of `SKETCH` MinHashes; pairs whose sketches agree in a share
of `SKETCH_BAR` go on to the exact comparison (a pair at 0.8 is missed with probability 3e-7, five standard deviations). So no pair is a row
before its sketches agree, a large group of copies costs one exact comparison a member, and what stays quadratic is comparing
sketches of texts that are near one another, but not copies of one centre.

Defined results: as `simhash`; null text counts as empty, all empty texts are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.common import BROADCAST_ROWS, adopt, arrow_map, cut, drop, free, text_bytes
from turnmill.llm.simhash import components, fingerprint_of_hashes, hashes_of, keep_first as _keep_first, links as simhash_links
from turnmill.session import new_path, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
BUCKET = 48
COLUMNS = 2048
BLOCK = 4096
SKETCH = 512
SKETCH_BAR = 0.71
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 64, n, np.uint64)
    return draw() | np.uint64(1), draw()


FACTORS, TERMS = _factors(BANDS * ROWS, 42)
SKETCH_FACTORS, SKETCH_TERMS = _factors(SKETCH, 43)


def shingles_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    return np.unique(hashes_of(text, shingle))


def _least(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The MinHashes of a set that isn't empty."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), COLUMNS):
        h = hashes[k : k + COLUMNS]
        h = h ^ (h >> np.uint64(31))
        np.minimum(least, (h[None, :] * factors[:, None] + terms[:, None]).min(axis=1), out=least)
    return least


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set that isn't empty; keys of different bands are told apart."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * FACTORS[0]
    for column in _least(hashes, FACTORS, TERMS).reshape(BANDS, ROWS).T:
        key = (key ^ column) * MIX
        key ^= key >> np.uint64(29)
    return key


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """A byte of each of `SKETCH` further MinHashes."""
    return ((_least(hashes, SKETCH_FACTORS, SKETCH_TERMS) * MIX) >> np.uint64(56)).astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return union > 0 and both / union >= similarity


def _node(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(text.lower().split()), 7)


def signatures(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The `keep` columns, _fp (a hash of the words, as a signed long), _n (distinct shingles), _sim (the SimHash of its shingles) and _bands (none for a text without words)."""
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"), F.lit(0).cast("bigint").alias("_fp"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast("bigint").alias("_sim"), F.array().cast("array<bigint>").alias("_bands"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, sims, bands = [], [], [], []
            for x in text_bytes(b.column("_text")):
                every = hashes_of(x, shingle)
                sims.append(fingerprint_of_hashes(every))
                h = np.unique(every)
                fps.append(_node(x))
                sizes.append(len(h))
                bands.append(bands_of(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            put = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 5)), *put], names=[*b.schema.names[:-5], "_fp", "_n", "_sim", "_bands"])

    return arrow_map(rows, run, rows.drop("_text").schema)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar; texts: (fp, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, np.ndarray] = {}  # of this batch's nodes
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for nodes, column in ((a, "ta"), (b, "tb")):
                for k, x in enumerate(nodes):
                    if x not in held:
                        held[x] = shingles_of(text_bytes(batch.column(column).slice(k, 1))[0], shingle)
            good = pa.array([similar(held[x], held[y], similarity) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    one, two = texts.select(F.col("fp").alias("a"), F.col("t").alias("ta")), texts.select(F.col("fp").alias("b"), F.col("t").alias("tb"))
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb"), run, "a bigint, b bigint")


def _sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, t) to (fp, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch_of(shingles_of(x, shingle)).tobytes() for x in text_bytes(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(made, pa.binary())], names=["fp", "sketch"])

    return arrow_map(texts.select("fp", "t"), run, "fp bigint, sketch binary")


def _near(group: pa.Table, similarity: float, bar: float) -> pa.Table:
    """Of one cell, (key, left, fp, n, root, sketch, keys): pairs of a left and a right node, of different components, whose sketches agree. A pair is taken in the first of the buckets it shares."""
    left = group.column("left").to_numpy(zero_copy_only=False)
    fp, n, root = (group.column(c).to_numpy() for c in ("fp", "n", "root"))
    keys, key = group.column("keys").to_pylist(), group.column("key")[0].as_py()
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(fp), SKETCH)
    rows, others = np.flatnonzero(left), np.flatnonzero(~left)
    words = np.ascontiguousarray(sketch[others])
    out: set[tuple[int, int]] = set()
    for i in rows.tolist():
        agree = (words == sketch[i]).sum(axis=1, dtype=np.int32)
        small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
        for j in others[(agree >= bar * SKETCH) & (root[others] != root[i]) & (small >= similarity * large)].tolist():
            if min(set(keys[i]).intersection(keys[j])) == key:
                out.add((min(int(fp[i]), int(fp[j])), max(int(fp[i]), int(fp[j]))))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _table(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """df as a table whose folder is added to `paths`, for the caller to delete. Plans that read it begin here; those of kept tables would hold all that came before, and the driver with them."""
    paths.append(new_path(df.sparkSession, name))
    return written(df, paths[-1])


def _by_simhash(first: DataFrame, paths: list[str]) -> DataFrame:
    """Candidate pairs (a, b) by SimHash. first: (fp, sim). The nodes of a fingerprint meet the least of them, and these meet where fingerprints are linked."""
    least = _table(first.groupBy("sim").agg(F.min("fp").alias("c")), "near-fingerprints", paths)
    held: list[DataFrame] = []
    linked = _table(simhash_links(least.select(F.col("sim").alias("fp")), held=held), "near-linked", paths)
    free(*held)
    one, two = least.select(F.col("sim").alias("a"), F.col("c").alias("ca")), least.select(F.col("sim").alias("b"), F.col("c").alias("cb"))
    pairs = linked.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    pairs = pairs.unionByName(first.join(least, "sim").where("fp <> c").select(F.col("c").alias("a"), F.col("fp").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _beyond_centres(large: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, similarity: float, bar: float, block: int, paths: list[str]) -> DataFrame:
    """Candidate pairs (a, b) between the components that meet in a large bucket. large: (key, fp, n, size); found: components so far."""
    rooted = _table(large.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", "n", "size", F.coalesce("root", "fp").alias("root")), "near-rooted", paths)
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("s")).groupBy("key").agg(F.max(F.struct("s", "root")).alias("big"), F.count("*").alias("parts")).where("parts > 1")
    met = rooted.join(parts.select("key", F.col("big.root").alias("main")), "key")
    own = met.groupBy("fp").agg(F.collect_set("key").alias("keys"))  # at most one for each band
    sketches = _table(_sketched(texts.join(own.select("fp"), "fp", "left_semi"), shingle).join(own, "fp"), "near-sketches", paths)
    cells = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), cells).cast("int")
    every = F.sequence(F.lit(0), cells - 1)
    cols = ["key", "fp", "n", "root", "x", "y", "left"]
    rows = met.where("root <> main").select("*", mine.alias("x"), F.explode(every).alias("y"), F.lit(True).alias("left")).select(*cols)
    rows = rows.unionByName(met.select("*", F.explode(every).alias("x"), mine.alias("y"), F.lit(False).alias("left")).select(*cols))
    return rows.join(sketches, "fp").groupBy("key", "x", "y").applyInArrow(lambda t: _near(t, similarity, bar), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", shingle: int = SHINGLE,
                    similarity: float = SIMILARITY, bucket: int = BUCKET, sketch_bar: float = SKETCH_BAR, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The `keep` columns (doc_id among them), _fp and _root: the least _fp reachable by links."""
    docs = adopt(docs)
    paths: list[str] = []
    table = lambda df, name: _table(df, name, paths)
    marked = docs.select(*[docs[c] for c in keep], docs[text].alias("_t"), docs[doc_id].alias("_i"), F.xxhash64(docs[text]).alias("_x"))
    rows = table(signatures(marked, text="_t", keep=(*keep, "_i", "_x") if doc_id not in keep else (*keep, "_x"), shingle=shingle), "near-signatures")
    at = "_i" if doc_id not in keep else doc_id
    first = rows.where("_n > 0").groupBy(F.col("_fp").alias("fp")).agg(F.min(F.struct(F.col(at).alias("i"), F.col("_x").alias("x"))).alias("f"), F.first("_n").alias("n"), F.first("_sim").alias("sim"), F.first("_bands").alias("bands"))
    first = table(first, "near-nodes")
    every = first.select("fp", "n", F.explode("bands").alias("key"))
    size = every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = table(every.join(size, "key"), "near-members")
    enough = F.least("n", "m") / F.greatest("n", "m") >= similarity  # sets of other sizes can't reach it
    small = members.where(F.col("size") <= bucket).select("key", "fp", "n")
    other = small.select("key", F.col("fp").alias("b"), F.col("n").alias("m"))
    pairs = small.join(other, "key").where((F.col("fp") < F.col("b")) & enough).select(F.col("fp").alias("a"), "b")
    large = members.where(F.col("size") > bucket).select("key", "fp", "n", "size")
    weight = large.groupBy("fp").agg(F.sum("size").alias("w"))
    centre = large.join(weight, "fp").groupBy("key").agg(F.max(F.struct("w", "fp", F.col("n").alias("m"))).alias("c"))
    stars = large.join(centre, "key").select(F.col("fp").alias("a"), F.col("c.fp").alias("b"), "n", F.col("c.m").alias("m")).where((F.col("a") != F.col("b")) & enough)
    pairs = pairs.unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).unionByName(_by_simhash(first.select("fp", "sim"), paths))
    pairs = table(pairs.distinct(), "near-pairs")

    # the texts of the nodes that meet any other, one row for each
    met = members.select("fp").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    wanted = table(first.join(met, "fp", "left_semi").select(F.col("fp"), F.col("f.i").alias("_j"), F.col("f.x").alias("_y")), "near-wanted")
    few = wanted.count() <= broadcast_rows
    source = docs.select(docs[doc_id].alias("_i"), F.xxhash64(docs[text]).alias("_x"), docs[text].alias("t"))
    same = source["_i"].eqNullSafe(F.col("_j")) & (source["_x"] == F.col("_y"))
    texts = table(source.join(F.broadcast(wanted) if few else wanted.hint("merge"), same).select("fp", "t").dropDuplicates(["fp"]), "near-texts")

    links = cut(_verified(pairs, texts, shingle, similarity), "near-links")
    found = components(links)
    if not large.isEmpty():
        rest = _beyond_centres(large, found, texts, shingle, similarity, sketch_bar, block, paths)
        links = links.unionByName(cut(_verified(rest, texts, shingle, similarity), "near-links"))
        found = components(links)
    named = first.select("fp").join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("_root"))
    out = cut(rows.select(*keep, "_fp").join(named, "_fp", "left").select(*keep, "_fp", F.coalesce("_root", "_fp").alias("_root")), "near-groups")
    for path in paths:
        drop(docs.sparkSession, path)  # what was read from them is written
    return out


def keep_first(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket: int = BUCKET, sketch_bar: float = SKETCH_BAR, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As `simhash.keep_first`, with these near copies. sketch_bar 0: no pair of a large bucket is passed over by its sketches, all are compared on their whole sets."""
    groups = partial(near_duplicates, shingle=shingle, similarity=similarity, bucket=bucket, sketch_bar=sketch_bar, block=block, broadcast_rows=broadcast_rows)
    return _keep_first(docs, text=text, doc_id=doc_id, broadcast_rows=broadcast_rows, groups=groups)
