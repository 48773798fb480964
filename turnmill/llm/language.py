"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 characters of the whole text (letters; the rest counts as blanks), hashed to 2 ** BITS ids; a value is
(1 + ln count) x idf, and a text's values have length 1. Document frequencies are counted over all training documents. Weights are fitted
by follow-the-regularised-leader with L1 and L2 penalties (so most are exactly zero), on about `PER_LANGUAGE` training documents
of each language, chosen by a hash of their ids; a third of these is held back and sets one temperature that calibrates the probabilities. Its log loss is
taken against smoothed targets (a right answer counts as n + 1 in n + 2), so that an easy sample of n rows doesn't give a certainty that n rows can't show.
What is broadcast (idf and weights) is bounded by the hash space times the number of languages.

Defined results: null text and text without a letter is `und` with score 0; without training rows everything is `und`; of equal probabilities the language
that comes first in order is taken; of texts with one id the regression takes the least with its language; null langs and ids are never learned from;
repeated rows keep one row each; texts may be of any length (memory in proportion to the longest); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.llm.common import adopt, arrow_map, chunks, table
from turnmill.llm.grams import codes, ids

BITS = 15
ORDERS = (1, 3)
PER_LANGUAGE = 800
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"


def counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a text's n-grams; none without a letter."""
    c = codes(text)
    if len(c) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    n = np.bincount(ids(c, *ORDERS, bits), minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float32)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float, bits: int):
        self.languages, self.idf, self.weights, self.temperature, self.bits = languages, idf, weights, temperature, bits

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[at]
        size = np.sqrt((v * v).sum())
        return v / size if size else v

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text or "", self.bits)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.values(at, n) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (size x classes) by FTRL-proximal with an elastic net. rows: (ids, values, class)."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) > l1, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, v, y = rows[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            g2 = g * g
            z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g2
    return weights(z, n).astype(np.float32)


def fit_temperature(logits: list[tuple[np.ndarray, int]]) -> float:
    """The temperature with the least log loss against smoothed targets, by golden section over its logarithm; 1 without rows."""
    if not logits:
        return 1.0
    x, y = np.array([v for v, _ in logits], np.float64), np.array([k for _, k in logits])
    rows, classes = x.shape
    off = 1 / (rows + 2)
    target = np.full(x.shape, off / max(1, classes - 1))
    target[np.arange(rows), y] = 1 - off

    def loss(u: float) -> float:
        z = x / np.exp(u)
        z = z - z.max(axis=1, keepdims=True)
        return float(-(target * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum() / rows)

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def sample_of_each(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """About k rows of each group (all of a smaller one): those whose key's hash lies below the group's share. Nothing is sorted and no group is gathered."""
    sizes = F.broadcast(rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_c")))  # one row for each group: languages or labels
    unit = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return rows.join(sizes, F.col(group) == F.col("_g")).where(unit < F.lit(float(k)) / F.col("_c")).drop("_g", "_c")


def train(docs: DataFrame, train_rows: Column, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", bits: int = BITS, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows of docs where train_rows holds."""
    docs = adopt(docs)
    used = docs.where(train_rows & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    picked = sample_of_each(used.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang")), "_lang", "_id", per_language)
    names = sorted(r[0] for r in picked.select("_lang").distinct().collect())
    texts = used.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in b.column("_text").to_pylist():
                at, _ = counts(t, bits)
                df[at] += 1
                rows += len(at) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], names=["f", "n"])

    found = arrow_map(texts.select("_text"), frequencies, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = found.column("f").to_numpy(), found.column("n").to_numpy()
    total = int(n[f == -1].sum())
    idf = np.zeros(1 << bits, np.float32)
    idf[f[f >= 0]] = np.log((1 + total) / (1 + n[f >= 0])) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [counts(t, bits) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_lang"), pa.array([at.astype("<u4").tobytes() for at, _ in made], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())], names=["_id", "_lang", "at", "n"])

    # about per_language rows of each language: a bounded side
    chosen = texts.join(F.broadcast(picked.select("_id").distinct()), "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("_text", "_lang")).alias("_m")).select("_id", "_m._lang", "_m._text")
    kind = texts.schema["_id"].dataType.simpleString()
    rows = arrow_map(chosen, features, f"_id {kind}, _lang string, at binary, n binary").withColumn("_o", F.xxhash64("_id")).toArrow().sort_by([("_o", "ascending"), ("_id", "ascending")])
    model = Model(names, idf, np.zeros((1 << bits, max(1, len(names))), np.float32), 1.0, bits)
    fit, held = [], []
    for k, (g, at, v) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("_lang", "at", "n")), strict=True)):
        at = np.frombuffer(at, "<u4").astype(np.int64)
        if len(at):
            (held if k % 3 == 2 else fit).append((at, model.values(at, np.frombuffer(v, "<f4")), names.index(g)))
    if fit:
        model.weights = fit_ftrl(fit, len(names), 1 << bits)
        model.temperature = fit_temperature([(v @ model.weights[at], y) for at, v, y in held])
    return model


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, lang_pred and score."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text", 1 << 21):
            found = [known.value.predict(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return arrow_map(rows, run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs, train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
