"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprint: XXH64 (seed 42) of every 3-word shingle; a bit is 1 where over half of the hashes have it. Words are runs of
non-blank characters after lower-casing A-Z; a text of fewer words is one shingle; a text of none has fingerprint zero.

Links: two fingerprints at `DISTANCE` = 2 or fewer bits agree in at least two of four 16-bit blocks, so distinct
fingerprints meet in buckets (pair of blocks, their 32 bits). Buckets of at most `BUCKET` fingerprints are joined with
themselves and each pair's Hamming distance is verified. A larger bucket (many near copies) would give a quadratic number of pairs:
it is split again in the same way, by pairs of four 8-bit blocks of the 32 bits that are left, and where that is still too large by pairs of four 4-bit
blocks of the 16 bits left then. A last bucket has 256 fingerprints at most, because 8 bits are left. So no link is lost, and no group grows
with the data. Exact copies are one fingerprint from the start.

Components: alternating large-star and small-star steps, each cut by a checkpoint, until nothing changes; rows are salted where a
component's centre would gather them.

Defined results: null text counts as empty; all empty texts are linked; texts may be of any length; of equal ids the least is one (there are no ties); repeated rows keep one row each; extra columns stay out
of the way (`near_duplicates` keeps them); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.common import BROADCAST_ROWS, adopt, arrow_map, cut, free, kept, table, text_bytes

SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
BUCKET = 48
SALTS = 8


def hashes_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, seed 42."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()  # of bytes: A-Z only, and \x09-\x0D and \x20 only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h(line, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    return np.array([h(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    return fingerprint_of_hashes(hashes_of(text, shingle))


def fingerprint_of_hashes(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The `keep` columns and _fp, the fingerprint as a signed long."""
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"), F.lit(0).cast("bigint").alias("_fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint_of(x, shingle) for x in text_bytes(b.column("_text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 2)), pa.array(got)], names=[*b.schema.names[:-2], "_fp"])

    return arrow_map(rows, run, rows.drop("_text").schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels() -> list[list[list[int]]]:
    """For each level, of each way to get there: masks of the bits in which fingerprints must agree, for each pair of blocks."""
    ways, out = [list(range(64))], []  # bits that are left free
    for _ in range(3):
        masks, after = [], []
        for free in ways:
            n = len(free) // BLOCKS
            blocks = [free[k * n : (k + 1) * n] for k in range(BLOCKS)]
            rest = [[x for k, block in enumerate(blocks) if k not in pair for x in block] for pair in combinations(range(BLOCKS), 2)]
            masks.append([((1 << 64) - 1) ^ sum(1 << x for x in r) for r in rest])
            after += rest
        out.append(masks)
        ways = after
    return out


LEVELS = _levels()


def _buckets(rows: DataFrame, level: int) -> DataFrame:
    """(fp, way, key): a row for each pair of blocks. rows: (fp, way) with the way that led to the level."""
    masks = LEVELS[level]
    each = [F.array(*[F.struct(F.lit(6 * w + n).alias("way"), F.lit(_signed(m)).cast("bigint").alias("mask")) for n, m in enumerate(ms)]) for w, ms in enumerate(masks)]
    found = rows.select("fp", F.explode(F.element_at(F.array(*each), F.col("way") + 1)).alias("b"))
    return found.select("fp", "b.way", F.col("fp").bitwiseAND(F.col("b.mask")).alias("key"))


def links(fps: DataFrame, *, bucket: int = BUCKET, held: list[DataFrame] | None = None) -> DataFrame:
    """(a, b): distinct fingerprints within `DISTANCE` bits. fps: distinct `fp`. held: gets the tables that are kept until the links are written."""
    rows, found = fps.select("fp", F.lit(0).alias("way")), None
    held = [] if held is None else held
    for level in range(len(LEVELS)):
        members = _buckets(rows, level)
        size = kept(members.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1"))
        members = kept(members.join(size, ["way", "key"]))
        held += [size, members]
        last = level == len(LEVELS) - 1
        small = members if last else members.where(F.col("n") <= bucket)
        other = small.select("way", "key", F.col("fp").alias("b"))
        near = small.join(other, ["way", "key"]).where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE)).select(F.col("fp").alias("a"), "b")
        found = near if found is None else found.unionByName(near)
        rows = members.where(F.col("n") > bucket).select("fp", "way")
        if last or rows.isEmpty():
            return found.distinct()
    raise AssertionError


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over some links: the same components with fewer links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > 2_000_000:
            yield _stars(up, root)
            up.clear()
    yield _stars(up, root)


def _stars(up: dict[int, int], root) -> pa.RecordBatch:
    found = [(root(x), x) for x in list(up)]
    found = [x for x in found if x[0] != x[1]]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node hands its larger (or smaller) neighbours to its least neighbour. Salted, so that a centre's rows go to several tasks."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    joined = salted.join(least, ["u", "s"])
    if large:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with a link; root is the least node reachable."""
    edges = cut(arrow_map(edges, _local, "a bigint, b bigint"), "links")
    # done when each component is one star around its least node: every node has one root, and no root has one
    while not (edges.groupBy("b").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("_b")).distinct(), F.col("a") == F.col("_b"), "left_semi").isEmpty()):
        edges = cut(_star(_star(edges, True), False), "stars")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """The `keep` columns (doc_id among them), _fp, _root (the least fingerprint reachable by links) and component_id (the least doc_id)."""
    docs = adopt(docs)
    rows = kept(fingerprints(docs, text=text, keep=keep))
    first = kept(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("first")))
    held: list[DataFrame] = []
    found = components(links(first.select("fp"), bucket=bucket, held=held))
    free(*held)
    rooted = first.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = kept(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    # what is kept is dealt anew on either side of both joins: the rows of a frequent fingerprint or a large component can be split
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), "component_id")
    return rows.join(named, "_fp")


def keep_first(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each group of near copies, with docs' columns: that with the least doc_id (null last; of several rows with it, one).

    groups: what finds them, taking text, keep and doc_id as `near_duplicates` does and returning the `keep` columns and _root.

    Rows are told apart by id and a hash of the text. The rows that go are the fewer as a rule: few of them are broadcast.
    """
    docs = adopt(docs)
    mark = docs.select(docs[doc_id].alias("_id"), F.xxhash64(docs[text]).alias("_h"), docs[text].alias("_t"))
    found = kept(groups(mark, text="_t", keep=("_id", "_h"), doc_id="_id"))
    firsts = found.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_h")).alias("f")).select("f._id", "f._h").distinct()
    firsts = kept(firsts)
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])
    gone = kept(found.join(firsts, same(found, firsts), "left_anti").select("_id", "_h").distinct())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[doc_id].alias("_id"), F.xxhash64(docs[text]).alias("_h"))
    few = gone.count() <= broadcast_rows
    left = rows.join(F.broadcast(gone) if few else gone.hint("merge"), same(rows, gone), "left_anti")
    if not found.groupBy("_id", "_h").count().where("count > 1").isEmpty():  # whole rows that repeat
        left = left.dropDuplicates(["_id", "_h"])
    return left.select("_row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
