"""Exchange of n-grams in compressed blocks."""

import random
from collections import Counter

from pyspark.sql import functions as F

from turnmill.operators import ngrams as N, packed as P


def shuffled(spark, make):
    """MB that making a table and writing it to nowhere puts into shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def total():
        sc.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList
        stages = sc.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    make().write.format("noop").mode("overwrite").save()
    return (total() - before) / 1e6


def made(rng, n, syllables=40):
    """n words of a few syllables, most of them rare."""
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 3))) for _ in range(syllables)]
    return ["".join(rng.choices(parts, k=rng.choice([1, 1, 1, 2, 2, 3, 4]))) for _ in range(n)]


def test_counted_in_blocks(spark):
    """Every order against plain counting, with gaps in the orders, over several chunks and many buckets."""
    rng = random.Random(5)
    texts = ["a b a b a", "a", "", None, "b  a\tb", " ", "x y z w a b a b", "a b a b a", "\U0001f468 é   \0 a", "long" * 3000 + " b a", *(" ".join(made(rng, 60, 4)) for _ in range(80))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    for orders in ([1, 2, 3], [3], [2, 1], [4, 2], [5], [9]):
        for compat, more_than in ((False, 0), (True, 2)):
            want = Counter((n, " ".join(w[i : i + n])) for t in texts if t for w in [t.split()] for n in orders for i in range(len(w) - n + 1 - compat))
            got = N.counts(df, orders, compat=compat, more_than=more_than, rows_chars=0).collect()
            assert len(got) == len({(r.n, r.ngram) for r in got})
            assert {(r.n, r.ngram): r.freq for r in got} == {k: v for k, v in want.items() if v > more_than}
    assert N.counts(df.where("text IS NULL"), [1, 2], rows_chars=-1).count() == 0


def test_keys_of_large_numbers():
    """Rows of numbers whose product is beyond 64 bits keep their order and stay apart."""
    np = P.np
    rows = sorted({tuple(random.Random(k).choices([0, 1, 2, 2**30 - 1, 2**30 - 2], k=4)) for k in range(300)})
    keys = P._keys([np.array(c, np.int32) for c in zip(*rows)], 2**30)
    assert (np.diff(keys) > 0).all()


def test_counts_are_shuffled_packed(spark):
    """Of texts of rare words less is shuffled than 12 bytes a word for all orders from 1 to 3."""
    rng = random.Random(1)
    words = made(rng, 900_000)
    texts = [" ".join(words[k : k + 300]) for k in range(0, len(words), 300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    assert shuffled(spark, lambda: N.counts(df, [1, 2, 3])) < 12e-6 * len(words)


def test_listed_ngrams_are_shuffled_packed(spark, tmp_path):
    """Lists as long as the texts: less is shuffled than 24 bytes a word, keys and list included."""
    rng = random.Random(2)
    words = made(rng, 200_000)
    texts = [(k, " ".join(words[k : k + 100])) for k in range(0, len(words), 100)]
    df = spark.createDataFrame(texts, "line_no bigint, text string").coalesce(2)
    N.counts(df, [3], rows_chars=0).write.parquet(f"{tmp_path}/grams")
    grams = spark.read.parquet(f"{tmp_path}/grams")
    assert shuffled(spark, lambda: N.found_in(df, grams, broadcast_pieces=0)) < 24e-6 * len(words)


def test_listed_ngrams_in_blocks(spark):
    """Runs of all lengths with affixes, blanks at ends and in a row, frequent runs, line breaks and copies of n-grams, in many blocks, by keys of several types, against all pairs."""
    from datetime import datetime, timedelta

    rng = random.Random(3)
    word = lambda: rng.choice(["", "", "a", "é", "th", "the", "of", "ofa", "th\nof", "\0", "\U0001f468x", "x" * 50])
    at = lambda i: datetime(2026, 1, 1) + timedelta(seconds=i)
    texts = [(i, at(i), " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(i, at(i), "of the of the") for i in range(150, 250)] + [(250, at(250), None)]
    grams = [*{" ".join(word() for _ in range(rng.randint(2, 5))) for _ in range(1500)}, "f th", "e o", " ", "  "]
    df = spark.createDataFrame(texts, "k int, at timestamp, text string").withColumn("both", F.struct("k", "at")).repartition(5)
    listed = spark.createDataFrame([(g,) for g in [*grams, *grams[:50]]], "ngram string").repartition(3)
    want = sorted((i, g) for i, _, t in texts for g in set(grams) if t is not None and g in t)
    assert sorted(tuple(r) for r in N.found_in(df, listed, key="k", broadcast_pieces=0).collect()) == want
    assert sorted((r.both.k, r.ngram) for r in N.found_in(df, listed, key="both", broadcast_pieces=0).collect()) == want
    assert sorted((r["at"], r.ngram) for r in N.found_in(df, listed, key="at", broadcast_pieces=0).collect()) == [(at(i), g) for i, g in want]


def test_frequent_words_lead_nowhere(spark):
    """A long word that is everywhere is known before, so its n-grams go to all buckets."""
    rng = random.Random(4)
    df = spark.createDataFrame([(w,) for w in (["everywhere", a, b] for a, b in zip(made(rng, 2000), made(rng, 2000)))], "_w array<string>")
    assert P.frequent(df, 10**6, 2)[0] == "everywhere" and len(P.frequent(df, 10**6, 2)) == 2 * P.LEADERS
    assert "everywhere" in P.frequent(df, 2 * P.SAMPLE_CHARS, 2)
    np = P.np
    cells = P._cells([np.arange(10_000, dtype=np.uint64)], 12, 10_000, np.zeros(10_000, np.uint64))
    assert np.bincount(cells // P.SHARES, minlength=12).max() < 1000 and np.bincount(cells % P.SHARES).max() < 800
