import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents, prose, save
from turnmill.llm import importance as I


def runs(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def expected(docs, tests):
    """The rows of op12's contract, feature by feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in runs(x)[1]) for texts in ([x for _, x in docs], tests))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    rows = []
    for k, (i, x) in enumerate(docs):
        w, f = runs(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w), k])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[6]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


TESTS = ["The Quick brown fox", None, "", "karin lodal mirin karin lodal", "Ünï çødé karin"]


def cases():
    rng = random.Random(5)
    texts = [None, "", " .,;", "one", "A-b_c9d", "É karin\0x", "ka" * 40000, prose(rng, 20), prose(rng, 19), *[prose(rng, rng.randint(1, 300)) for _ in range(120)], prose(rng, 30000), "same words " * 12, "same words " * 12]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    ids[3] = None
    return texts, ids


def test_query(spark, tmp_path):
    texts, ids = cases()
    save(clashing(documents(spark, texts, ids)).withColumns({"rank": F.lit("x"), "weight": F.lit("x"), "n_words": F.lit("x"), "bucket": F.lit("x")}).repartition(3), tmp_path, "documents")
    save(clashing(spark.createDataFrame(list(enumerate(TESTS)), "item_id bigint, text string")).withColumn("n", F.lit("x")), tmp_path, "benchmark")
    df = I.op12_importance(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema][1:] == ["bigint"] * 4
    want = expected(list(zip(ids, texts, strict=True)), TESTS)
    assert got(df) == want
    assert sum(r[4] is not None for r in want) > 20


def test_repeated_rows_and_no_target(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u"
    docs = documents(spark, [text] * 40, [1] * 40)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert got(I.resampled(docs, none)) == expected([(1, text)] * 40, [])
    assert I.resampled(docs.limit(0), none).collect() == []


@pytest.mark.parametrize("run_bytes", [1, 700, 1 << 30])
def test_small_tries_lose_nothing(spark, run_bytes):
    texts, ids = cases()
    docs = documents(spark, texts, ids)
    want = Counter(zlib.crc32(f.encode()) % 10000 for x in texts for f in runs(x)[1])
    assert dict(map(tuple, I.bucket_totals(docs, run_bytes=run_bytes).collect())) == dict(want)


def test_nodes():
    long = b"x" * (I.LONG + 1)
    texts = [b"", b"a b a b a", b"B", b"a " + long + b" " + long[1:] + b" a", b" ", b"c"]
    trie = I.Trie(texts, 3)
    found = Counter()
    for state, met in trie.levels:
        assert len(set(state.tolist())) == len(state)
        found.update(dict(zip(state.tolist(), met.tolist(), strict=True)))
    words = [t.lower().split() for t in texts]
    assert found == Counter(zlib.crc32(b" ".join(w[i : i + n])) for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert np.diff(trie.words.ends, prepend=0).tolist() == [len(w) for w in words]


def test_longer_runs(spark):
    docs = documents(spark, ["a b a b a", "b", None])
    f = ["a", "b", "a", "b", "a", "a b", "b a", "a b", "b a", "a b a", "b a b", "a b a", "b"]
    assert dict(map(tuple, I.bucket_totals(docs, order=3).collect())) == dict(Counter(zlib.crc32(x.encode()) % 10000 for x in f))
    gain = list(range(-5000, 5000))
    want = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f[:-1]) // 12
    assert I.weights(docs, gain, order=3).where("doc_id = 0").first()[1:] == (5, 12, want)
