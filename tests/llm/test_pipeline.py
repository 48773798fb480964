"""The pipeline's stages on a small corpus, each against what it should keep."""

import random

import pytest

import corpus_pipeline as C
from tests.llm.helpers import DOCS, clashing, contaminated, prose, save
from tests.llm.test_near_copies import slow_firsts
from turnmill.llm import secrets as X
from turnmill.llm.packing import tokenizer, tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    tests = [prose(rng, 30) for _ in range(6)]
    rows, marks = [], []
    for i in range(900):
        w = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "idiotic", "trashy"]))
        if i % 50 == 3:
            w[5:5] = tests[i % 6].split()
        if i % 40 == 5:
            w.insert(4, "password=hunter2000")
        rows.append((i, " ".join(w), "en", "s", int(toxic)))
        if i % 3:
            marks.append((i, 1, int(toxic)))
    for i in range(900, 960):
        rows.append((i, rows[rng.randrange(200)][1], "en", "s", 0))
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), (2002, "long " * 30000, "en", "s", 0)]
    save(clashing(spark.createDataFrame(rows, DOCS)), to, "documents")
    save(spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), to, "labels")
    save(spark.createDataFrame(list(enumerate(tests)), "item_id bigint, text string"), to, "benchmark")
    return str(to), rows, tests


def test_stages(spark, corpus):
    to, rows, tests = corpus
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{to}/documents.parquet")
    outs = []
    for n, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, to)
        out.write.mode("overwrite").parquet(f"{to}/out{n}")
        assert n == 4 or out.columns == docs.columns
        docs = spark.read.parquet(f"{to}/out{n}")
        outs.append({r.doc_id: r.text for r in docs.collect()} if n < 4 else docs.collect())
    bad = [i for i, t, *_ in rows if t and ("scumbag" in t or "idiotic" in t or "trashy" in t)]
    clean = [i for i, *_ in rows if i not in set(bad)]
    assert len(set(bad) & set(outs[0])) <= 0.03 * len(bad) and len(set(clean) - set(outs[0])) <= 0.01 * len(clean)
    assert set(outs[1]) == slow_firsts(outs[0])
    hit = {r[0] for r in contaminated(list(outs[1].items()), list(enumerate(tests))) if r[5]}
    assert hit and set(outs[2]) == set(outs[1]) - hit
    assert set(outs[3]) == set(outs[2])
    for i, t in outs[2].items():
        found = X.findings(t or "")
        assert (outs[3][i] == t) == (not found) and not X.findings(outs[3][i] or "")
    encode = tokenizer(tokenizer_path()).encode
    assert sum(r.length for r in outs[4]) == sum(len(encode(t or "")) + 1 for t in outs[3].values())
    assert {r.doc_id for r in C.run(spark, to).select("doc_id").distinct().collect()} == set(outs[3])


def test_empty(spark, corpus):
    to = corpus[0]
    docs = spark.read.parquet(f"{to}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, to).write.mode("overwrite").parquet(f"{to}/empty{n}")
        docs = spark.read.parquet(f"{to}/empty{n}")
        assert docs.count() == 0
