"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features: n-grams of 3 to 6 characters of a word (with its bounds), hashed to 2 ** BITS ids. Over all
labelled training documents, a feature's ratio is r = ln(p / q), p and q its smoothed shares of the n-gram occurrences of toxic and
clean documents; a feature that occurs c times in a text has the value r x (1 + ln c). No feature is left out. A logistic regression over these values is fitted by
follow-the-regularised-leader with an elastic net, on about `PER_CLASS` documents of each label, chosen by a hash of their
ids; the intercept is corrected for the labels' true shares.

Defined results: null and empty text is scored by the intercept; without training rows of both labels every score is the share of label 1 (0
without any); a document labelled twice has its greatest label; of texts with one id the regression takes the least; null labels and ids are never learned from;
repeated rows keep one row each; texts may be of any length (memory in proportion to the longest); extra columns are kept by `drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.llm.common import adopt, arrow_map, chunks, release, table
from turnmill.llm.grams import codes, ids
from turnmill.llm.language import sample_of_each, remainder

BITS = 20
ORDERS = (3, 6)
PER_CLASS = 1500
SMOOTH = 1.0
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.2, 1.0, 2.0, 0.5
#: Labels are broadcast up to this many rows (about 30 MB in memory); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a text's n-grams."""
    return np.unique(ids(codes(text), *ORDERS, bits, within=True), return_counts=True)


def tempered(n: np.ndarray) -> np.ndarray:
    return 1 + np.log(n)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float, bits: int):
        #: weight times ratio of each feature
        self.weights, self.intercept, self.bits = weights, intercept, bits

    def score(self, text: str | None) -> float:
        at = ids(codes(text or ""), *ORDERS, self.bits, within=True)
        at, n = np.unique(at[self.weights[at] != 0], return_counts=True)
        x = self.intercept + float(self.weights[at].astype(np.float64) @ tempered(n))
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, x)))))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: (ids, values, label)."""
    z, n = np.zeros(size), np.zeros(size)
    b, nb = 0.0, 1.0
    order = np.random.default_rng(11)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) > l1, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, v, y = rows[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            e = 1 / (1 + np.exp(-np.clip(b + v @ w, -50, 50))) - y
            g = v * e
            g2 = g * g
            z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g2
            nb += e * e
            b -= alpha * e / np.sqrt(nb)
    return weights(z, n), b


def ratios(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-count ratios of features that occur so many times in either class."""
    p, q = toxic + SMOOTH, clean + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, *, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", bits: int = BITS, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows of docs where train_rows holds."""
    docs, labels = adopt(docs), adopt(labels)
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(train_rows).groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    few = labels.count() <= BROADCAST_LABELS
    texts = docs.where(F.col(text).isNotNull()).where(train_rows).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    known = texts.join(F.broadcast(marks) if few else marks.hint("merge"), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros((2, 1 << bits), np.int64), [0, 0]
        for b in batches:
            for t, y in zip(b.column("_text").to_pylist(), b.column("y").to_pylist(), strict=True):
                at, n = grams(t, bits)
                found[y][at] += n
                rows[y] += 1
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), *(pa.array(np.append(found[y][at], rows[y]).astype(np.int64)) for y in (1, 0))], names=["f", "toxic", "clean"])

    counted = arrow_map(known.select("_text", "y"), count, "f int, toxic bigint, clean bigint").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    f = counted.column("f").to_numpy()
    toxic, clean = counted.column("toxic").to_numpy(), counted.column("clean").to_numpy()
    n1, n0 = int(toxic[f < 0].sum()), int(clean[f < 0].sum())
    real = f >= 0
    f, toxic, clean = f[real], toxic[real], clean[real]  # one for each feature that occurs
    empty = Model(np.zeros(1 << bits, np.float32), float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n1 + n0 else -50.0, bits)
    if not n1 or not n0:
        return empty
    ratio = np.zeros(1 << bits, np.float32)
    ratio[f] = ratios(toxic, clean)

    picked = sample_of_each(marks, "y", "_id", per_class).select("_id", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [grams(t, bits) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("y"), pa.array([at.astype("<u4").tobytes() for at, _ in made], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in made], pa.binary())], names=["_id", "y", "at", "n"])

    kind = texts.schema["_id"].dataType.simpleString()
    # about per_class rows of each label: a bounded side
    chosen = texts.join(F.broadcast(picked), "_id").groupBy("_id", "y").agg(F.min("_text").alias("_text"))
    rows = arrow_map(chosen, features, f"_id {kind}, y int, at binary, n binary").withColumn("_o", F.xxhash64("_id")).toArrow()
    # taken in their order one by one: a sorted table would be a second copy in the driver
    order = pc.sort_indices(rows.select(["_o", "_id"]), sort_keys=[("_o", "ascending"), ("_id", "ascending")]).to_pylist()
    fit = []
    for i in order:
        at = np.frombuffer(rows.column("at")[i].as_buffer(), "<u4")
        fit.append((at, ratio[at] * tempered(np.frombuffer(rows.column("n")[i].as_buffer(), "<u4")).astype(np.float32), rows.column("y")[i].as_py()))
    ones = sum(y for *_, y in fit)
    if not ones or ones == len(fit):
        return empty
    weights, b = fit_ftrl(fit, 1 << bits)
    b += float(np.log(n1 / n0) - np.log(ones / (len(fit) - ones)))
    model = Model((weights * ratio).astype(np.float32), b, bits)
    del fit, rows, weights, counted, f, toxic, clean
    release()
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and score."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text", 1 << 21):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([known.value.score(t) for t in b.column("_text").to_pylist()], pa.float64())], names=schema.names)

    return arrow_map(rows, run, schema)


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", bar: float = 0.5) -> DataFrame:
    """The rows of docs that score below the bar, with docs' columns."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text, 1 << 21):
            yield b.filter(pa.array([known.value.score(t) < bar for t in b.column(text).to_pylist()]))

    return arrow_map(docs, run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score(docs, train(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
