import random

import pytest

from tests.llm.helpers import clashing, contaminated, documents, prose, save
from turnmill.llm import decontaminate as D


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_bytes,block_bytes", [(1 << 20, 1 << 20), (200, 100)])
def test_brute_force(spark, tmp_path, monkeypatch, shard_bytes, block_bytes):
    rng = random.Random(3)
    tests = [prose(rng, 30), prose(rng, 12), prose(rng, 10), "one two three", "UPPER Case", None, "", "...", prose(rng, 25)]
    tests += [tests[0], tests[1] + " tail words", "Éa éa ÉA " + prose(rng, 9)]
    texts = [prose(rng, 40), None, "", "!!!", tests[0], f"{prose(rng, 20)} {tests[1]} {prose(rng, 5)}", tests[0] + " " + tests[0], "one, TWO; three", "upper-case", tests[8][:60],
             tests[2].upper(), prose(rng, 3000) + " " + tests[8], "x" * 5000, "one two", tests[11].replace("ÉA", "éa"), tests[11], tests[0], "one two three one two three one two"]
    d = list(enumerate(texts)) + [(4, tests[0]), (None, tests[1])]
    docs = documents(spark, [t for _, t in d], [i for i, _ in d])
    save(docs, tmp_path, "documents")
    save(items(spark, tests), tmp_path, "benchmark")
    real = D.contamination
    monkeypatch.setattr(D, "contamination", lambda a, b, **k: real(a, b, shard_bytes=shard_bytes, block_bytes=block_bytes, **k))
    got = D.op1_decontaminate(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(contaminated(d, list(enumerate(tests))), key=key)


def test_random_small_alphabet(spark):
    """Few words, so that windows repeat, overlap and share prefixes."""
    rng = random.Random(5)
    tests = [prose(rng, rng.randint(1, 8), ["a", "b"]) for _ in range(25)]
    texts = [prose(rng, rng.randint(0, 60), ["a", "b", "c"]) for _ in range(120)]
    got = D.contamination(documents(spark, texts), items(spark, tests), window=4, shard_bytes=300).collect()
    want = {r[0]: r for r in contaminated(list(enumerate(texts)), list(enumerate(tests)), window=4)}
    for r in got:
        w = want[r.doc_id]
        assert (r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) == (w[1], w[2], w[3])


def test_longest_matches(spark):
    rng = random.Random(7)
    test = prose(rng, 30)
    w = test.split()
    docs = documents(spark, [prose(rng, 50), " ".join(["zz", *w[5:20], "zz"]), " ".join(["yy", "yy", *w[5:27]])])
    got = {r.item_pos: r for r in D.longest_matches(docs, items(spark, [test]), shard_bytes=250).collect()}
    assert (got[5].match_words, got[5].doc_id, got[5].doc_pos) == (22, "2", 2)
    assert (got[10].match_words, got[10].doc_pos) == (17, 7)
    assert 18 not in got and 0 not in got


def test_decontaminate_keeps_columns(spark):
    rng = random.Random(9)
    test = prose(rng, 15)
    docs = clashing(documents(spark, [prose(rng, 30), f"{prose(rng, 4)} {test}", None, ""]))
    got = D.decontaminate(docs, items(spark, [test]))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 3]
    assert D.decontaminate(docs, items(spark, [])).count() == 4
    assert D.contamination(docs.limit(0), items(spark, [test])).count() == 0
    assert [r.n_words for r in D.contamination(docs, items(spark, [])).orderBy("doc_id").collect()][2:] == [0, 0]


def test_tables_of_a_very_long_item():
    """They grow with an item's words, not with their square, and find what they should."""
    import pickle

    rng = random.Random(21)
    long = prose(rng, 5000)
    tests = D.Tests([("a", long.encode()), ("b", long.encode()), ("c", b"one two")], D.WINDOW)
    assert len(pickle.dumps(tests)) < 100 * 5000
    part = " ".join(long.split()[4000:4030])
    _, items = D.Shard([part.encode(), b"x one two y", b"one"], tests.longest).hits(tests)
    assert items == [["a", "b"], ["c"], []]
