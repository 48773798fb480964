"""Exact top-k search by inner product: exhaustive, term at a time.

Queries and candidates meet in a grid: queries are dealt over blocks of about `QUERY_BLOCK` rows, candidates over blocks of about `CANDIDATE_BLOCK`, and a cell
has one block of each (a row goes to all cells of its block, in one exchange; nothing passes through the driver). A cell inverts its candidates into postings (for
each dimension, those with a weight other than zero, and the weights) and lets the queries' terms scatter weighted postings into dense arrays of scores, one
term for all queries of a tile at a time. From each array the k best of each query are taken by partition selection and merged; these few rows meet per
query and are merged again.

Ties go to the smaller vec_id. Exactness: scores are whole numbers; they are added in int32 or int64 where they can't overflow, else as Python integers. A score
beyond 64 bits counts as the greatest (or least) 64-bit number, so such scores are ties.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part, neither as query nor as candidate; a shorter vector's
missing components are zero; repeated ids are candidates of their own, a repeated query row gets a list of its own, and a query never meets a row with its id;
blocks are dealt by position, so that equal rows are spread as others are; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnmill.llm.common import adopt, table

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 4096
#: Queries and candidates of a tile, whose scores fit in a processor's cache.
TILE = (128, 2048)
K = 5


def quantized(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components as whole numbers, floor(scale * x); vectors with gaps left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vectors.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(x, bad)).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, zeros where a row is shorter."""
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, accumulated term at a time."""
    most = lambda a: max(int(a.max()), -int(a.min())) if a.size else 0
    dims = min(queries.shape[1], candidates.shape[1])
    bound = most(queries) * most(candidates) * max(1, dims)
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
    terms, weights = np.ascontiguousarray(queries.T.astype(kind)), np.ascontiguousarray(candidates.T.astype(kind))
    out = np.zeros((len(queries), len(candidates)), kind)
    part = np.empty_like(out)
    for d in range(dims):
        rows, posting = np.flatnonzero(terms[d]), np.flatnonzero(weights[d])
        if 2 * len(rows) * len(posting) > out.size:  # most of the array: zeros do no harm
            np.multiply(terms[d][:, None], weights[d][None, :], out=part)
            np.add(out, part, out=out)
        elif len(rows) and len(posting):
            out[np.ix_(rows, posting)] += terms[d][rows][:, None] * weights[d][posting][None, :]
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64) if kind is object else out


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, vec_id, score) of each row's k best but the query's own, ties to smaller ids."""
    found = ids[None, :] != own[:, None]
    if scores.shape[1] > 4 * k:
        # all that reach the score of the place k from the top, and one more for the query's own
        n = scores.shape[1] - k - int((~found).sum(axis=1).max(initial=0))
        if n > 0:
            found &= scores >= np.partition(scores, n, axis=1)[:, n : n + 1]
    row, at = np.nonzero(found)
    return best_of(row, ids[at], scores[row, at].astype(np.int64), k)


def best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best."""
    order = np.lexsort((ids, ~score, row))  # ~ turns the order round without overflow
    row, ids, score = row[order], ids[order], score[order]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    use = place < k
    return row[use], ids[use], score[use]


def _cell(group: pa.Table, k: int) -> pa.Table:
    """The k best of each query of a cell, (left, id, q, v): left for queries, q their numbers."""
    group = group.combine_chunks()
    left = group.column("left").combine_chunks()
    queries, others = group.filter(left), group.filter(pc.invert(left))
    own, number, ids = (x.to_numpy() for x in (queries.column("id"), queries.column("q"), others.column("id")))
    a, b = (_matrix(x.column("v").combine_chunks()) for x in (queries, others))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in range(0, len(own), TILE[0]):
        best = [np.zeros(0, np.int64)] * 3
        for c in range(0, len(ids), TILE[1]):
            new = select(scores_of(a[r : r + TILE[0]], b[c : c + TILE[1]]), ids[c : c + TILE[1]], own[r : r + TILE[0]], k)
            best = best_of(*(np.concatenate(x) for x in zip(best, new, strict=True)), k)
        found.append((best[0] + r, *best[1:]))
    row, ids, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    return pa.table({"_q": number[row], "query_id": own[row], "vec_id": ids, "score": score})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, *, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as quantized() makes them."""
    queries, candidates = adopt(queries), adopt(candidates)
    rows, columns = (max(1, -(-x.count() // n)) for x, n in ((queries, query_block), (candidates, candidate_block)))
    place = F.monotonically_increasing_id()
    number = F.shiftrightunsigned(place, 33) + place  # so that small partitions don't all begin with the same block
    cells = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = queries.select(F.col("vec_id").alias("id"), place.alias("q"), F.pmod(number, F.lit(rows)).cast("int").alias("x"), F.col("v"), F.lit(True).alias("left")).withColumn("y", F.explode(cells(columns)))
    right = candidates.select(F.col("vec_id").alias("id"), F.lit(-1).cast("bigint").alias("q"), F.pmod(number, F.lit(columns)).cast("int").alias("y"), F.col("v"), F.lit(False).alias("left")).withColumn("x", F.explode(cells(rows)))
    parts = left.unionByName(right).groupBy("x", "y").applyInArrow(lambda t: _cell(t, k), "_q bigint, query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


OP7_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
