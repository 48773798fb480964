"""Language identification and toxicity."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import DOCS, clashing, documents, prose, save
from turnmill.llm import grams as G, language as L, toxicity as T

WORDS = {
    "en": ["the", "house", "with", "water", "thing", "where", "which", "night"],
    "de": ["der", "schön", "nicht", "straße", "über", "haus", "wasser", "gehen"],
    "fr": ["le", "maison", "être", "après", "où", "français", "leçon", "voilà"],
}


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(list(WORDS))
        rows.append((i, prose(rng, rng.randint(5, 60), WORDS[g]), g, "s", 0))
    rows += [(n, None, "en", None, None), (n + 1, "", "de", None, None), (n + 2, "123 !?", "fr", None, None), (n + 3, prose(rng, 20, WORDS["fr"]), None, None, None), (None, prose(rng, 20, WORDS["de"]), "de", None, None), (n + 4, prose(rng, 60000, WORDS["en"]), "en", None, None), (5, rows[5][1], rows[5][2], "s", 0)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_ngrams():
    assert "".join(map(chr, G.codes("Ab, c!!É"))) == " ab c é "
    c = G.codes("ab cd")
    assert len(G.ids(c, 1, 1, 12)) == len(c) and len(G.ids(c, 1, 3, 12)) == 3 * len(c) - 3
    # within words: " ab", "ab ", " ab " and so on, nothing over the blank inside
    assert len(G.ids(c, 3, 4, 20, within=True)) == 2 * (2 + 1)
    assert set(G.ids(G.codes("ab"), 3, 4, 20, within=True)) < set(G.ids(c, 3, 4, 20, within=True))
    assert len(G.ids(G.codes(""), 3, 6, 20, within=True)) == 0


def test_language_query(spark, tmp_path):
    rows, df = corpus(spark)
    save(clashing(df), tmp_path, "documents")
    got = L.op3_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, g, *_ in rows:
        r = by[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif g:
            assert r.lang_pred == g
    held = [r for r in got if r.held_out]
    assert len(held) > 50


def test_language_learns_from_training_rows_only(spark):
    """Held-out rows carry false labels; predictions don't follow them."""
    rows, _ = corpus(spark)
    from pyspark.sql import functions as F

    wrong = [(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else g, s, n) for i, t, g, s, n in rows]
    docs = spark.createDataFrame(wrong, DOCS)
    model = L.train(docs, L.remainder(F.col("doc_id"), 4) != 2)
    assert model.languages == ["de", "en", "fr"]
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_language_empty(spark, tmp_path):
    save(documents(spark, []), tmp_path, "documents")
    assert L.op3_language(spark, str(tmp_path)).count() == 0
    save(documents(spark, ["abc", None], langs=[None, None]), tmp_path, "documents")
    assert {r.lang_pred for r in L.op3_language(spark, str(tmp_path)).collect()} == {"und"}


def test_temperature_and_sampling(spark):
    rng = np.random.default_rng(1)
    x = [(rng.normal(size=3), 0) for _ in range(300)]
    x = [(v, int(rng.choice(3, p=L.softmax(v)))) for v, _ in x]
    assert 3 < L.fit_temperature([(v * 4, y) for v, y in x]) < 5.5 and L.fit_temperature([]) == 1.0
    df = spark.range(1000).selectExpr("id as k", "if(id < 900, 'a', 'b') as g")
    got = L.sample_of_each(df, "g", "k", 100).groupBy("g").count().collect()
    assert {r.g for r in got} == {"a", "b"} and all(60 < r["count"] <= 140 for r in got)
    assert L.sample_of_each(df, "g", "k", 950).count() == 1000


def labelled(spark, n=1500, seed=2):
    rng = random.Random(seed)
    bad = ["scumbag", "idiotic", "trashy"]
    rows, marks = [], []
    for i in range(n):
        w = prose(rng, rng.randint(5, 80)).split()
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 0))
        if rng.random() < 0.7:
            marks.append((i, 1, int(toxic)))
        rows[-1] = (*rows[-1][:4], int(toxic))
    return rows, marks


def test_toxicity_query(spark, tmp_path):
    rows, marks = labelled(spark)
    extra = [(5000, None, None, None, 0), (5001, "", None, None, 0), (None, "scumbag", None, None, 1), (5002, "ka " * 50000 + "idiotic", "en", None, 1), (3, rows[3][1], "en", "s", rows[3][4])]
    docs = spark.createDataFrame([*rows, *extra], DOCS)
    save(clashing(docs), tmp_path, "documents")
    save(spark.createDataFrame([*marks, (5000, 1, None), (None, 1, 1), (marks[0][0], 1, marks[0][2]), (99999, 0, 1)], "doc_id bigint, quality int, toxic int"), tmp_path, "labels")
    got = T.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {r[0]: r[4] for r in [*rows, *extra]}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(truth[r.doc_id] == r.predicted for r in held) / len(held) > 0.97
    assert next(r for r in got if r.doc_id == 5002).predicted == 1 and next(r for r in got if r.doc_id == 5001).predicted == 0


def test_drop_toxic(spark):
    from pyspark.sql import functions as F

    rows, marks = labelled(spark, 800, 3)
    docs = clashing(spark.createDataFrame([*rows, (9000, None, None, None, 0)], DOCS))
    model = T.train(docs, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), F.lit(True))
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert sum(r.n_chars for r in left) < 6 and len(left) > 0.98 * sum(r[4] == 0 for r in rows)


@pytest.mark.parametrize("marks", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1)]])
def test_toxicity_without_both_labels(spark, tmp_path, marks):
    save(documents(spark, ["a b c", "d", None]), tmp_path, "documents")
    save(spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), tmp_path, "labels")
    got = T.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    save(documents(spark, []), tmp_path, "documents")
    assert T.op5_toxicity(spark, str(tmp_path)).count() == 0


def naive_ftrl(rows, classes, rng, epochs, alpha, beta, l1, l2, gradient, bias=False):
    """FTRL-proximal, a weight at a time. rows: ({feature: value}, label); gradient: scores to errors, one for each class."""
    z, n = {}, {}
    b, nb = 0.0, 1.0

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - (l1 if zk > 0 else -l1)) / ((beta + nk**0.5) / alpha + l2)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            x, y = rows[i]
            w = {(f, c): weight((f, c)) for f in x for c in range(classes)}
            errors = gradient([b * bias + sum(v * w[f, c] for f, v in x.items()) for c in range(classes)], y)
            for f, v in x.items():
                for c in range(classes):
                    g = v * errors[c]
                    old = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[f, c]
                    n[f, c] = old + g * g
            if bias:
                nb += errors[0] ** 2
                b -= alpha * errors[0] / nb**0.5
    return weight, b


def in_order(spark, ids):
    """Ids in the order in which the regressions take them."""
    from pyspark.sql import functions as F

    return [r.i for r in spark.createDataFrame([(i,) for i in ids], "i bigint").orderBy(F.xxhash64("i"), "i").collect()]


def normal(text):
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def test_toxicity_against_brute_force(spark):
    """Ratios, weights and scores from their definitions, with n-grams as strings."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    rows, _ = labelled(spark, 90, 7)
    rows = [(i, t if i % 9 else t + " idiotic " + t, *x) for i, t, *x in rows]
    train, held = rows[:60], rows[60:]
    made = {i: Counter(w[k : k + m] for w in (f" {v} " for v in normal(t).split()) for m in range(3, 7) for k in range(len(w) - m + 1)) for i, t, *_ in rows}
    names = {g for c in made.values() for g in c}
    hashed = {g: G.ids(np.array(list(map(ord, g)), np.uint32), len(g), len(g), T.BITS)[0] for g in names}
    assert len(set(hashed.values())) == len(names)  # no two meet, so strings and hashes give the same model
    label = {i: y for i, _, _, _, y in rows}
    count = [Counter(), Counter()]
    for i, *_ in train:
        count[label[i]].update(made[i])
    seen = count[0].keys() | count[1].keys()
    total = [sum(c[g] + 1 for g in seen) for c in count]
    ratio = {g: math.log((count[1][g] + 1) / total[1]) - math.log((count[0][g] + 1) / total[0]) for g in seen}
    values = {i: {g: ratio.get(g, 0.0) * (1 + math.log(c)) for g, c in made[i].items()} for i in made}
    fit = [(values[i], label[i]) for i in in_order(spark, [r[0] for r in train])]
    weight, b = naive_ftrl(fit, 1, np.random.default_rng(11), T.EPOCHS, T.ALPHA, T.BETA, T.L1, T.L2, lambda s, y: [1 / (1 + math.exp(-s[0])) - y], bias=True)
    model = T.train(spark.createDataFrame(train, DOCS), spark.createDataFrame([(i, 1, label[i]) for i, *_ in train], "doc_id bigint, quality int, toxic int"), F.lit(True))
    for i, t, *_ in held:
        want = b + sum(v * weight((g, 0)) for g, v in values[i].items())
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-want)), abs=1e-3)


def test_language_against_brute_force(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    bits = 20
    rows, _ = corpus(spark, 60, 5)
    rows = [r for r in rows[:60] if len(r[1]) < 400]
    made = {i: Counter(x[k : k + m] for x in [normal(t)] for m in range(1, 4) for k in range(len(x) - m + 1)) for i, t, *_ in rows}
    names = {g for c in made.values() for g in c}
    assert len({int(G.ids(np.array(list(map(ord, g)), np.uint32), len(g), len(g), bits)[0]) for g in names}) == len(names)
    train, held = rows[:-10], rows[-10:]
    df = Counter(g for i, *_ in train for g in made[i])
    idf = {g: math.log((1 + len(train)) / (1 + df[g])) + 1 if df[g] else 0.0 for g in names}

    def values(i):
        v = {g: (1 + math.log(c)) * idf[g] for g, c in made[i].items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    langs = sorted({r[2] for r in train})
    lang = {r[0]: langs.index(r[2]) for r in rows}

    def softmax(s, at=1.0):
        e = [math.exp((x - max(s)) / at) for x in s]
        return [x / sum(e) for x in e]

    order = in_order(spark, [r[0] for r in train])
    fit = [(values(i), lang[i]) for k, i in enumerate(order) if k % 3 != 2]
    weight, _ = naive_ftrl(fit, len(langs), np.random.default_rng(7), L.EPOCHS, L.ALPHA, L.BETA, L.L1, L.L2, lambda s, y: [p - (c == y) for c, p in enumerate(softmax(s))])
    scores = lambda i: [sum(v * weight((g, c)) for g, v in values(i).items()) for c in range(len(langs))]
    model = L.train(spark.createDataFrame(train, DOCS), F.lit(True), bits=bits)
    back = [(scores(i), lang[i]) for k, i in enumerate(order) if k % 3 == 2]

    def loss(at):
        off = 1 / (len(back) + 2)
        return -sum(math.log(p) * (1 - off if c == y else off / (len(langs) - 1)) for s, y in back for c, p in enumerate(softmax(s, at)))

    assert loss(model.temperature) <= min(loss(math.exp(u / 50)) for u in range(-150, 100)) + 1e-2
    for i, t, *_ in held:
        p = softmax(scores(i), model.temperature)
        assert model.predict(t) == (langs[p.index(max(p))], pytest.approx(max(p), abs=1e-3))


def test_repeated_ids_give_one_model(spark):
    """Of rows with one id the least text is taken, in whatever order they come."""
    from pyspark.sql import functions as F

    rows, marks = labelled(spark, 60, 9)
    rows += [(i, t + " scumbag", *x) for i, t, *x in rows[:10]]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    one, two = (T.train(spark.createDataFrame(x, DOCS), labels, F.lit(True)) for x in (rows, rows[::-1]))
    assert np.allclose(one.weights, two.weights) and one.intercept == pytest.approx(two.intercept)
    one, two = (L.train(spark.createDataFrame(x, DOCS), F.lit(True)) for x in (rows, rows[::-1]))
    assert np.allclose(one.weights, two.weights)
