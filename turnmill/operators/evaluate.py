"""Evaluation: BLEU, accuracies, perplexity, masked losses, early stopping, decoded sequences, a scorer interface."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnmill.functions.text import tok
from turnmill.operators.ranks import written
from turnmill.session import ship

END = "</S>"


def overlaps(hypothesis: list[str], references: list[list[str]], orders: int) -> list[int]:
    """Lengths of the hypothesis and of the shortest reference; for each order the overlaps; for each order the n-grams of the hypothesis."""
    found = []
    for n in range(1, orders + 1):
        h = Counter(zip(*(hypothesis[k:] for k in range(n)), strict=False))
        most: Counter = Counter()
        for r in references:
            most |= Counter(g for g in zip(*(r[k:] for k in range(n)), strict=False) if g in h)
        found.append(sum((h & most).values()))
    return [len(hypothesis), min(map(len, references), default=0), *found, *(max(0, len(hypothesis) - n) for n in range(orders))]


def bleu(rows: DataFrame, *, key: str, references: str = "references", hypothesis: str = "hypothesis", max_order: int = 4, smooth: bool = False) -> DataFrame:
    """One row: bleu, precisions, brevity_penalty, ratio, hypothesis_length, reference_length. references: array<string>, hypothesis: string.

    An n-gram's overlap is the least of its count in the hypothesis and its greatest count in a reference. The reference length is that of the shortest reference.
    Empty corpora score 0.
    """
    ship(rows.sparkSession)
    made = rows.select(tok(hypothesis).alias("h"), F.transform(references, tok).alias("r"))
    names = ["hl", "rl", *(f"{x}{n}" for x in "mp" for n in range(1, max_order + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(len(names), np.int64)
            for h, r in zip(batch.column("h").to_pylist(), batch.column("r").to_pylist(), strict=True):
                sums += overlaps(h or [], r or [], max_order)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.tolist()], names=names)

    # both sides of a comparison lie in one row: each batch gives one row of sums
    sums = made.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
    one = sums.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names])
    precision = [((F.col(f"m{n}") + 1.0) / (F.col(f"p{n}") + 1.0)) if smooth else F.when(F.col(f"p{n}") > 0, F.col(f"m{n}") / F.col(f"p{n}")).otherwise(0.0) for n in range(1, max_order + 1)]
    mean = F.when(F.least(*precision) > 0, F.exp(sum(F.ln(p) for p in precision) / max_order)).otherwise(0.0) if max_order > 1 else precision[0]
    ratio = F.coalesce(F.try_divide("hl", "rl"), F.lit(0.0))
    penalty = F.when(ratio > 1, 1.0).when(ratio > 0, F.exp(1 - 1 / F.when(ratio > 0, ratio))).otherwise(0.0)
    return one.select(F.array(*precision).alias("precisions"), mean.alias("_mean"), penalty.alias("brevity_penalty"), ratio.alias("ratio"), F.col("hl").alias("hypothesis_length"), F.col("rl").alias("reference_length")).select((F.col("_mean") * F.col("brevity_penalty")).alias("bleu"), "precisions", "brevity_penalty", "ratio", "hypothesis_length", "reference_length")


def line_accuracy(rows: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Percentage of equal lines; a missing hypothesis is empty."""
    same = F.trim(reference) == F.trim(F.coalesce(hypothesis, F.lit("")))
    return rows.agg(F.coalesce(F.avg(F.when(same, 100.0).otherwise(0.0)), F.lit(0.0)).alias("line_accuracy"))


def word_accuracy(rows: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Mean over lines of 100 x equal words at equal places / words of the longer line. Words are split at single blanks, so a blank line has one empty word."""
    r, h = F.split(F.trim(reference), " "), F.split(F.trim(F.coalesce(hypothesis, F.lit(""))), " ")
    same = F.size(F.filter(F.zip_with(r, h, lambda a, b: a.eqNullSafe(b) & a.isNotNull()), lambda x: x))
    return rows.agg(F.coalesce(F.avg(100.0 * same / F.greatest(F.size(r), F.size(h))), F.lit(0.0)).alias("word_accuracy"))


def aligned(references: DataFrame, hypotheses: DataFrame, line: str = "line_no", keep_all: bool = False) -> DataFrame:
    """Reference and hypothesis by line number; keep_all: references without a hypothesis stay."""
    return references.select(line, F.col("value").alias("reference")).join(hypotheses.select(line, F.col("value").alias("hypothesis")), line, "left" if keep_all else "inner")


def perplexity(batches: DataFrame, loss: str = "loss", size: str = "batch_size", words: str = "predict_count", by: list[str] | None = None) -> DataFrame:
    """exp(sum of loss x size / sum of predicted words), of all batches or by columns; infinity where it overflows."""
    return batches.groupBy(*by or []).agg(F.exp(F.sum(F.col(loss) * F.col(size)) / F.sum(words)).alias("perplexity"))


def result_line(name: Column, perplexity_: Column, scores: dict[str, Column] | None = None) -> Column:
    """A result in words: name ppl 1.23, name metric 4.5 and so on."""
    parts = [F.format_string("%s ppl %.2f", name, perplexity_), *[F.format_string(f"%s {m} %.1f", name, x) for m, x in (scores or {}).items()]]
    return F.concat_ws(", ", *parts)


def output_label(data: str, beam_width: int = 0, length_penalty_: float = 0.0, temperature: float = 0.0) -> str:
    """What a file of decoded responses is called, by its data's name and the way of decoding."""
    name = data.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{name}_t{temperature:.1f}" if temperature > 0 else f"{name}_bw{beam_width}_lp{length_penalty_:.1f}"


def masked_loss(entropies: Column, length: Column) -> Column:
    """Sum of the first `length` cross entropies of a sequence."""
    return F.aggregate(F.slice(entropies, F.lit(1), length), F.lit(0.0), lambda a, x: a + x)


def train_stats(log: DataFrame, by: str) -> DataFrame:
    """Per report: mean step time and gradient norm, thousands of words per second, perplexity, and whether it overflowed (not a number, infinite, over 1e20)."""
    ppl = F.exp(F.sum(F.col("loss") * F.col("batch_size")) / F.sum("predict_count"))
    out = log.groupBy(by).agg(F.avg("step_time").alias("step_time"), F.avg("grad_norm").alias("grad_norm"), F.try_divide(F.sum("word_count") / 1000.0, F.sum("step_time")).alias("kwords_per_s"), ppl.alias("perplexity"))
    return out.withColumn("overflow", F.isnan("perplexity") | (F.col("perplexity") > 1e20))


def early_stopping(evals: DataFrame, order: str, value: str, patience: int, degrade: float) -> DataFrame:
    """evals with best (so far), left (patience after this evaluation) and stopped.

    A new best restores the patience; a value over degrade x best costs one. Rows are range-partitioned by `order`; running minima, sums and maxima
    are taken in each partition, and what the partitions before it come to (a row for each) is put in: no task holds more than its range.
    """
    tasks = int(evals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = evals.repartitionByRange(tasks, order).sortWithinPartitions(order)
    rows = written(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "early-stopping")
    inside = Window.partitionBy("_p").orderBy("_i")
    upto, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition

    def carried(rows: DataFrame, fold: Callable[[Column], Column], x: Column, name: str) -> DataFrame:
        """rows with `name`, fold(x) over all partitions before; null before the first."""
        before = rows.groupBy("_p").agg(fold(x).alias("_x")).select("_p", fold(F.col("_x")).over(parts).alias(name))
        return rows.join(F.broadcast(before), "_p")

    rows = carried(rows, F.min, F.col(value), "_m").withColumn("_before", F.least("_m", F.min(value).over(ahead)))
    rows = rows.withColumn("_new", F.coalesce(F.col("_before").isNull() | (F.col(value) < F.col("_before")), F.lit(False)))
    rows = rows.withColumn("_cost", F.coalesce((~F.col("_new") & (F.col(value) > degrade * F.col("_before"))).cast("int"), F.lit(0)))
    rows = carried(rows, F.sum, F.col("_cost"), "_c").withColumn("_spent", F.coalesce("_c", F.lit(0)) + F.sum("_cost").over(upto))
    # costs never fall, so those at the last best are the greatest of any best's
    at_best = F.when(F.col("_new"), F.col("_spent"))
    rows = carried(rows, F.max, at_best, "_b").withColumn("_base", F.coalesce(F.greatest("_b", F.max(at_best).over(upto)), F.lit(0)))
    rows = rows.withColumn("best", F.least("_before", value)).withColumn("left", F.greatest(F.lit(patience) - F.col("_spent") + F.col("_base"), F.lit(0)).cast("bigint"))
    out = (F.col("left") <= 0).cast("int")
    rows = carried(rows, F.max, out, "_s").withColumn("stopped", F.greatest("_s", F.max(out).over(upto)) == 1)
    return rows.select(*evals.columns, "best", "left", "stopped")


def cut_at_end(words: Column, end: str = END) -> Column:
    """Words before the first end mark, joined."""
    at = F.array_position(words, end)
    return F.array_join(F.when(at > 0, F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(words), " ")


def beams(rows: DataFrame, column: str = "beams", end: str = END) -> DataFrame:
    """rows with responses: each beam (array of words) cut at its end, tab-joined."""
    return rows.withColumn("responses", F.array_join(F.transform(column, lambda b: cut_at_end(b, end)), "\t"))


def best_checkpoint(evals: DataFrame, step: str, value: str, by: str | None = None) -> DataFrame:
    """(by, step, value) of the evaluation with the least value; of equal ones the earliest."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s"))).alias("b")
    out = evals.groupBy(*([by] if by else [])).agg(best)
    return out.select(*([by] if by else []), F.col("b.s").alias(step), F.col("b.v").alias(value))


def length_penalty(length: Column, weight: float) -> Column:
    """((5 + length) / 6) ^ weight."""
    return F.pow((length + 5) / F.lit(6.0), F.lit(float(weight)))


def ranked_beams(beams: DataFrame, key: str, log_prob: str, length: str, weight: float = 0.0, n: int | None = None) -> DataFrame:
    """beams with score (log probability over length penalty) and rank in their sample; the n best of each."""
    out = beams.withColumn("score", F.col(log_prob) / length_penalty(F.col(length), weight))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), *[c for c in beams.columns if c not in (key, log_prob)])))
    return out.where(F.col("rank") <= n) if n else out


def beam_major(rows: DataFrame, key: str, column: str = "steps") -> DataFrame:
    """(key, beam, ids) from steps: array (time) of array (beam) of ids. Beams are turned where the row is, so rows that share a key stay apart; a step without a beam leaves it out."""
    widest = F.array_max(F.transform(column, lambda b: F.size(b)))
    beams = F.when(widest > 0, F.sequence(F.lit(0), widest - 1))
    x = rows.select(key, F.col(column).alias("_s"), F.explode(beams).alias("beam"))
    return x.select(key, "beam", F.transform(F.filter("_s", lambda b: F.size(b) > F.col("beam")), lambda b: F.get(b, F.col("beam"))).alias("ids"))


def score(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows through a model of the caller's, Arrow batch by Arrow batch. Networks are trained elsewhere; this is where they are applied."""
    return rows.mapInArrow(fn, schema)
