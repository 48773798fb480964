"""Stores and state of streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnmill.operators import ngrams as N
from turnmill.streaming import contexts as CH, stores as ST


def counts(df):
    return {(r.n, r.ngram): r.freq for r in df.collect()}


def test_batches_count_once(spark, tmp_path):
    store = ST.ngram_store(spark, f"{tmp_path}/store")
    part = lambda *texts: N.counts(spark.createDataFrame([(t,) for t in texts], "text string"), [1, 2])
    assert store.read().count() == 0
    store.put(part("a b a"), 0)
    store.put(part("b b"), 1)
    store.put(part("b b"), 1)  # again, after a failure
    want = {(1, "a"): 2, (1, "b"): 3, (2, "a b"): 1, (2, "b a"): 1, (2, "b b"): 1}
    assert counts(store.read()) == want
    store.compact()
    store.compact()
    assert counts(store.read()) == want
    store.put(part("c"), 2)
    assert counts(store.read()) == want | {(1, "c"): 1}
    (tmp_path / "store" / "batch=3").mkdir()  # begun, not finished
    assert counts(store.read()) == want | {(1, "c"): 1}


def test_bounds_of_united_sketches(spark, tmp_path):
    store = ST.sketch_store(spark, f"{tmp_path}/store", "day")
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("day"), (F.col("id") % 50_000).cast("string").alias("text"))
    for k in range(3):
        store.put(N.sketches(rows.where(F.col("text").cast("int") % 3 <= k), [1], ["day"]), k)
    exact = {r.day: r.n for r in rows.distinct().groupBy("day").agg(F.count("*").alias("n")).collect()}
    got = ST.estimated(store.read()).collect()
    assert len(got) == 2
    for r in got:
        assert r.least <= exact[r.day] <= r.most and r.most - r.least < 0.11 * exact[r.day]


T0 = datetime(2024, 1, 1)


def test_conversations_end(spark, tmp_path):
    """Out-of-order turns, a gap, a repeated turn, and state that goes when a conversation is over."""
    rows = spark.createDataFrame([], "conv string, turn bigint, text string, ts timestamp")
    put = lambda k, *r: spark.createDataFrame([(c, t, x, T0 + timedelta(minutes=m)) for c, t, x, m in r], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        q = CH.started(CH.chat_contexts(stream, 3, late="1 minute", keep_ms=600_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        q.awaitTermination()
        return q, sorted((r.conv, r.turn, r.context) for r in spark.read.schema(CH.CONTEXT).parquet(f"{tmp_path}/out").collect())

    put(0, ("a", 1, "a1", 1), ("a", 0, "a0", 0), ("b", 0, None, 0), ("b", 2, "b2", 2), ("a", 0, "again", 1))
    _, got = run()
    first = [("a", 0, ["</S>", "a0"]), ("a", 1, ["a0", "a1"]), ("b", 0, ["</S>", ""])]
    assert got == first  # b's turn 2 waits
    put(1, ("a", 2, "a2", 3), ("c", 0, "c0", 60))
    _, got = run()
    late = [("a", 2, ["a1", "a2"]), ("b", 2, ["", "b2"]), ("c", 0, ["</S>", "c0"])]
    assert got == sorted(first + late)
    put(2, ("d", 0, "d0", 500))
    q, got = run()
    assert got == sorted([*first, *late, ("d", 0, ["</S>", "d0"])])
    state = spark.read.format("statestore").option("stateVarName", "past").load(f"{tmp_path}/checkpoint")
    assert {r.key[0] for r in state.select("key").collect()} == {"d"}


if __name__ == "__main__":
    pytest.main([__file__])
