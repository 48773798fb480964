"""Operators on hand-made rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnmill.operators import batches as B, dialogues as D, embeddings as E, evaluate as V, ngrams as N, posts as P, ranks as R, sanitize as Z, stats as S, threads as T, topics as TP, vocab as O
from turnmill.session import ARROW, BATCH_ROWS


def test_windows(spark):
    df = spark.createDataFrame([(1, ["a a", "b b", "c c", "d d", "e e"]), (2, ["a", "b", "c"]), (3, ["x"])], "k int, utterances array<string>")
    compat = [(r.k, r.window) for r in D.windows(df, 3).orderBy("k", "start").collect()]
    assert compat == [(1, ["a a", "b b", "c c"]), (1, ["b b", "c c", "d d"])]
    assert D.windows(df, 3, drop_last=False).count() == 4
    assert D.windows(df, 3, drop_last=False, min_length=2).count() == 3
    rows = df.select("k", F.posexplode("utterances").alias("turn", "text"))
    a = {(r.k, r.start, tuple(r.window)) for r in D.windows_of_rows(rows, "k", "turn", "text", 3).collect()}
    assert a == {(r.k, r.start, tuple(r.window)) for r in D.windows(df, 3, drop_last=False).collect()}
    with pytest.raises(ValueError):
        D.windows(df, 1)


def posts(spark, edges):
    """edges: (id, parent or None, text)."""
    rows = [(1 if p is None else 0, i, "" if p is None else f"t1_{p}", "t3_S", t, k) for k, (i, p, t) in enumerate(edges)]
    return spark.createDataFrame(rows, "type int, id string, parent_id string, link_id string, text string, line_no bigint")


def test_threads(spark):
    p = posts(spark, [("S", None, "s"), ("A", "S", "a"), ("B", "A", "b"), ("C", "A", "c"), ("D", "X", "d"), ("E", "D", "e"), ("F", "X", "f"), ("L", None, "alone")])
    got = sorted("".join(r.ids) for r in T.dialogues(p).collect())
    assert got == ["DE", "SAB", "SAC"]
    assert sorted(r.id for r in T.roots(T.edges(p)).collect()) == ["L", "S", "X"]
    cycle = posts(spark, [("P", "Q", "p"), ("Q", "P", "q"), ("Z", "Z", "z")])
    assert T.dialogues(cycle).count() == 0
    deep = posts(spark, [("n0", None, "t"), *[(f"n{i}", f"n{i - 1}", "t") for i in range(1, 12)]])
    assert [len(r.ids) for r in T.dialogues(deep).collect()] == [12]
    docs = T.thread_documents(p).collect()
    assert [(r.thread, r.n_posts) for r in docs] == [("S", 7)]
    assert T.thread_documents(p, compat=True).count() == 2


def test_posts(spark):
    rules = spark.createDataFrame([("s1", ["title"], ["start"], ["TIL", "TIL:", "TIL -"], ["Today I learned"] * 3), ("s2", ["title", "selftext"], ["start", "end"], ["[Text]", "[Image]"], []), ("s3", [], [], [], [])], "id string, fields array<string>, positions array<string>, affixes array<string>, replacements array<string>")
    raw = spark.createDataFrame([("a", "1", "TIL: x", "", "s1"), ("b", "2", "[Image] hello", "there [text]", "s2"), ("c", "3", "t", "b", "s3"), ("d", "4", "t", "b", "s4"), ("e", "5", "t", "b", None)], "author string, id string, title string, selftext string, subreddit_id string")
    raw = raw.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in P.SUBMISSION.fields if f.name not in raw.columns])
    got = {r.id: (r.text, r.link_id, r.type) for r in P.submission_posts(raw, rules).collect()}
    assert got == {"1": ("Today I learned x", "1", 1), "2": ("hello\nthere", "2", 1), "3": ("", "3", 1), "4": ("", "4", 1)}
    c = spark.createDataFrame([("Bot1", "hello there my friend", "s1"), ("al", "[deleted]", "s1"), ("bo", "fine words here", "s9"), ("cy", "one", "s1"), ("di", "12345 67", "s1"), ("ed", "   ", "s1"), ("fy", "w " * 200, "s1"), ("gu", "good words", "s1"), (None, "good words", "s1")], "author string, body string, subreddit_id string")
    c = c.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in P.COMMENT.fields if f.name not in c.columns])
    bots = spark.createDataFrame([("bot1",)], "name string")
    judged = P.judged(P.comment_posts(c), bots=bots, rules=rules)
    assert {r.reason: r.n for r in P.report(judged).collect()} == {"deleted_or_bot": 2, "not_in_subreddits": 1, "short_word_len": 1, "not_en": 1, "norm_empty": 1, "long_len": 1, "processed": 2, "total": 9}
    assert P.accepted(judged).columns == [x for x in P.comment_posts(c).columns if x != "subreddit_id"] + [] or set(P.accepted(judged).columns) == set(P.NAMES)
    assert P.judged(P.comment_posts(c), max_words=3).where("reason = 'long_len'").count() == 2


def test_sanitize(spark):
    df = spark.createDataFrame([(["ok", "bad word"],), (["Bad"],), (["so very bad word bad", "bad"],), (["a of the b"],)], "utterances array<string>")
    assert [r.utterances for r in Z.sanitize(df, ["bad", "of the"]).collect()] == [["Bad"]]
    r = Z.report(df, ["bad", "of the"]).first()
    assert (r.lines, r.kept, r.one_word, r.multi_word) == (4, 1, 3, 1)


def test_ranks(spark):
    rng = random.Random(1)
    values = [(rng.randrange(40), i) for i in range(500)]
    got = R.ranked(spark.createDataFrame(values, "a bigint, b bigint"), [F.desc("a"), F.col("b")], mass="a").collect()
    running = 0
    for k, (r, (a, b)) in enumerate(zip(sorted(got, key=lambda r: r["rank"]), sorted(values, key=lambda x: (-x[0], x[1])), strict=True), 1):
        running += a
        assert (r.a, r.b, r["rank"], r.running) == (a, b, k, running)
    assert R.ranked(spark.createDataFrame([], "a bigint"), [F.col("a")]).count() == 0


def test_stats(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "length int")
    r = S.length_stats(df).first()
    assert (r.n, r.total, r["mean"], r.median, r.least, r.most) == (4, 16, 4.0, 2.5, 1, 10) and abs(r.stdev - 4.0824829) < 1e-6
    assert S.length_stats(df.limit(1)).first().stdev == 0.0 and S.length_stats(df.limit(0)).first().median == 0.0
    tf = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 1)], "word string, tf bigint")
    assert [r.word for r in S.rarest(tf, 3).collect()] == ["e", "d", "c"] and S.rarest(tf, 3, compat=True).count() == 2


def test_ngrams(spark):
    df = spark.createDataFrame([(0, "a b c d")], "line_no bigint, text string")
    assert {r.ngram for r in N.counts(df, [2], compat=True).collect()} == {"a b", "b c"}
    assert {r.ngram for r in N.counts(df, [2, 4]).collect()} == {"a b", "b c", "c d", "a b c d"}
    assert N.counts(df, [4], compat=True).count() == 0 and N.counts(df, [9]).count() == 0
    texts = spark.createDataFrame([(i, f"w{i % 97} of the x{i}") for i in range(300)], "line_no bigint, text string")
    exact = {r.n: r.distinct_ngrams for r in N.distinct_exact(texts, [1, 2]).collect()}
    for r in N.distinct(texts, [1, 2]).collect():
        assert abs(r.distinct_ngrams - exact[r.n]) <= 0.05 * exact[r.n]
    drop = {r.line_no for r in N.down_sampled(texts, {"of the": 20, "the x1": 200}, seed=3).collect()}
    tens = {i for i in range(300) if str(i).startswith("1")}
    assert tens <= drop and 20 <= len(drop) <= len(tens) + 20
    assert drop == {r.line_no for r in N.down_sampled(texts, {"of the": 20, "the x1": 200}, seed=3).collect()}
    parts = N.sketches(texts.withColumn("half", F.col("line_no") % 2), [1], ["half"])
    whole = parts.groupBy("n").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("e")).first().e
    assert abs(whole - exact[1]) <= 0.05 * exact[1]


def test_vocabulary(spark):
    df = spark.createDataFrame([(0, "b a b c a b </S>")], "line bigint, text string")
    vocab = O.build(S.first_positions(df, ["line"]), 6, "first").orderBy("id")
    assert [r.word for r in vocab.collect()] == ["<UNK>", "<S>", "</S>", "<SEP>", "b", "a"]
    for large in (False, True):
        coded = O.encode(spark.createDataFrame([(1, ["a", "c"]), (2, []), (3, ["b", "b"])], "k int, words array<string>"), vocab, joined=large)
        assert {r.k: r.ids for r in coded.collect()} == {1: [5, 0], 2: [], 3: [4, 4]}
    back = O.decode(coded, vocab)
    assert {r.k: r.decoded for r in back.collect()} == {1: ["a", "<UNK>"], 2: [], 3: ["b", "b"]}
    dialog = spark.createDataFrame([("x", 3), ("y", 2), ("z", 1)], "word string, tf bigint")
    topic = spark.createDataFrame([("y", 1), ("t", 5)], "word string, tf bigint")
    topics, joint = O.topical(dialog, topic, 10)
    assert [(r.word, r.tf) for r in topics.orderBy("rank").collect()] == [("t", 5), ("y", 3)]
    assert [r.word for r in joint.orderBy("id").collect()] == ["<UNK>", "<S>", "</S>", "<SEP>", "x", "z", "t", "y"]


def test_words_are_looked_up_in_small_batches_by_one_process(spark):
    vocab = O.with_reserved(spark.createDataFrame([(1, "a", 3), (2, "b", 2)], "rank bigint, word string, tf bigint"), O.RESERVED)
    rows = spark.range(2000, numPartitions=1).withColumnRenamed("id", "k").select("k", F.when(F.col("k") % 3 > 0, F.array(F.lit("a"), F.concat(F.lit("x"), F.col("k") % 2))).alias("words"))
    whole = {r.k: (r.ids, r.decoded) for r in O.encode_decode(rows, vocab, key="k", joined=True).collect()}
    both = O.encode_decode(rows, vocab, key="k")
    assert {r.k: (r.ids, r.decoded) for r in both.collect()} == whole and whole[1] == ([4, 0], ["a", "<UNK>"]) and whole[0] == ([], [])
    again = O.encode(rows, vocab, out="words", key="k").collect()  # the list itself becomes ids
    assert {r.k: r.words for r in again} == {k: ids for k, (ids, _) in whole.items()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(both).count("MapInArrow") == 1 and plan(vocab).count("ExistingRDD") == 1  # the words; reserved ones need no Python
    sizes = O.encode(rows, vocab, key="k").mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n bigint").collect()
    assert max(r.n for r in sizes) <= BATCH_ROWS and sum(r.n for r in sizes) == 2000
    assert int(spark.conf.get(ARROW)) > BATCH_ROWS  # the caller's session keeps its own


def test_embeddings(spark):
    vocab = O.with_reserved(spark.createDataFrame([(1, "a", 3), (2, "b", 2)], "rank bigint, word string, tf bigint"), O.RESERVED)
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 0.0])], "word string, vec array<float>")
    got = {r.word: (r.vec, r.trainable) for r in E.from_table(vocab, table, 2, zero_is_missing=True).collect()}
    assert got["a"] == ([1.0, 2.0], False) and got["b"][1] and all(abs(x) <= 0.1 for x in got["b"][0]) and len(got) == 6
    assert [r.word for r in E.reordered(vocab, table.limit(1)).orderBy("id").collect()][4:] == ["b", "a"]
    assert E.choose("random50", {}) == ("random", 50) and E.choose("random", {}) == ("random", 300) and E.choose("g", {"g": {"dim": 25}}) == ("table", 25)
    with pytest.raises(ValueError):
        E.choose("other", {})


def test_samples(spark):
    df = spark.createDataFrame([(1, ["u1 u1", "u2", "t t"]), (2, ["", "x"]), (3, ["only"])], "k int, utterances array<string>")
    r = B.flat_samples(df, src_max_len=30).collect()
    assert len(r) == 1 and (r[0].src, r[0].tgt_in, r[0].tgt_out, r[0].tgt_len) == (["u1", "u1", "<SEP>", "u2"], ["<S>", "t", "t"], ["t", "t", "</S>"], 3)
    assert B.flat_samples(df, src_max_len=3).first().src == ["u1", "u1", "<SEP>"]
    t = {x.k: x for x in B.turn_samples(df, turns=3).collect()}
    assert t[1].srcs == [["u1", "u1"], ["u2"]] and t[2].srcs == [[], ["x"]] and t[2].tgt_out == ["</S>"] and len(t) == 3
    assert B.flat_samples(df, has_target=False).where("k = 3").first().src == ["only"]
    rows = spark.createDataFrame([(i, i % 3) for i in range(100)], "k bigint, bucket int")
    sizes = B.batched(rows, 8, ["k"]).groupBy("bucket", "batch").count().collect()
    assert max(x["count"] for x in sizes) == 8 and sum(x["count"] for x in sizes) == 100
    assert B.sharded(rows, "k", 4, 1, 2).count() == 23 and B.shuffled(rows, 1).count() == 100


def test_evaluation(spark):
    same = spark.createDataFrame([(1, ["a b c d e"], "a b c d e")], "k int, references array<string>, hypothesis string")
    assert V.bleu(same, key="k").first().bleu == pytest.approx(1.0)
    half = spark.createDataFrame([(1, ["a b c d e f g h"], "a b c d")], "k int, references array<string>, hypothesis string")
    r = V.bleu(half, key="k").first()
    assert r.brevity_penalty == pytest.approx(0.3679, abs=1e-4) and r.bleu == pytest.approx(0.3679, abs=1e-4)
    two = spark.createDataFrame([(1, ["a a", "a b"], "a a a")], "k int, references array<string>, hypothesis string")
    assert V.bleu(two, key="k", max_order=1).first().precisions == [pytest.approx(2 / 3)]
    assert V.bleu(same.limit(0), key="k").first().bleu == 0.0
    pairs = spark.createDataFrame([("a b", "a x"), ("c", "c")], "reference string, hypothesis string")
    assert V.line_accuracy(pairs).first()[0] == 50 and V.word_accuracy(pairs).first()[0] == 75
    blank = spark.createDataFrame([("", ""), ("x", None)], "reference string, hypothesis string")
    assert V.word_accuracy(blank).first()[0] == 50
    log = spark.createDataFrame([(2.0, 3, 6), (1.0, 1, 1)], "loss double, batch_size int, predict_count int")
    assert V.perplexity(log).first()[0] == pytest.approx(2.7182818)
    e = spark.createDataFrame(list(enumerate([10.0, 9.0, 9.01, 9.5, 8.0, 9.0, 9.0])), "i int, p double")
    got = V.early_stopping(e, "i", "p", 2, 1.003).orderBy("i").collect()
    assert [r.left for r in got] == [2, 2, 2, 1, 2, 1, 0] and [r.stopped for r in got] == [False] * 6 + [True]
    cut = spark.createDataFrame([(["a", "b", "</S>", "c"],), (["a"],), (["</S>"],)], "w array<string>").select(V.cut_at_end(F.col("w")).alias("t"))
    assert [r.t for r in cut.collect()] == ["a b", "a", ""]


@pytest.mark.parametrize("late", [False, True])
def test_early_stopping_of_a_long_log(spark, late):
    """Against the fold; the best comes at the start or at any time. No window takes the whole log into one task."""
    import random

    rng = random.Random(late)
    values = [(5.0 if late or i else 1.0) + rng.random() - (i * 0.003 if late else 0) for i in range(900)]
    values[40] = values[41] = None
    e = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double").repartition(5)
    found = V.early_stopping(e, "i", "p", 400 if late else 30, 1.01)
    best, left, stopped, want = None, None, False, []
    for i, v in enumerate(values):
        if best is None or v is not None and v < best:
            best, left = v, 400 if late else 30
        elif v is not None and v > 1.01 * best:
            left = max(left - 1, 0)
        stopped |= left <= 0
        want.append((i, v, best, left, stopped))
    assert [tuple(r) for r in found.orderBy("i").collect()] == want
    specs = found._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1:]
    assert specs and all(x.startswith("_p#") for x in specs)


def test_scorer(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    def twice(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.multiply(b.column("id"), 2)], names=["y"])

    assert sorted(r.y for r in V.score(spark.range(3), twice, "y bigint").collect()) == [0, 2, 4]


def test_topics(spark):
    rows = [(i, ["cat dog pet fur", "pet food bowl", "reply words"] if i % 2 else ["bank loan rate cash", "loan money debt", "reply words"]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, utterances array<string>").withColumn("text", F.array_join("utterances", " "))
    model = TP.train(df, n_topics=2, no_below=2, no_above=1.0, passes=8, seed=3)
    got = TP.infer_dialogues(df, model, n_words=3).collect()
    assert len(got) == 60 and {r.topic for r in got} <= {0, 1} and all(len(r.topic_words) == 3 for r in got)
    again = TP.infer_dialogues(df, TP.train(df, n_topics=2, no_below=2, no_above=1.0, passes=8, seed=3), n_words=3)
    assert sorted(map(tuple, ((r.k, r.topic) for r in again.collect()))) == sorted((r.k, r.topic) for r in got)
    none = TP.infer(spark.createDataFrame([(1, "zzz qqq")], "k int, text string"), model).first()
    assert none.topic == -1 and none.topic_words == []
    lines = TP.topical_lines(spark.createDataFrame([(["a", "b"], ["x", "y"]), (["c"], [])], "utterances array<string>, topic_words array<string>"))
    assert [r.value for r in lines.collect()] == ["a\tb\tx y", "c\t<NO_TOPIC>"]


def test_choices(spark):
    rows = spark.range(100)
    a, b = B.sample(rows, 5, "id", 1), B.sample(rows.repartition(7), 5, "id", 1)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect()) and a.count() == 5
    e = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 3.0)], "step int, ppl double")
    r = V.best_checkpoint(e, "step", "ppl").first()
    assert (r.step, r.ppl) == (2, 3.0)
    beams = spark.createDataFrame([("a", 0, -2.0, 1), ("a", 1, -3.0, 10)], "k string, b int, p double, n int")
    assert V.ranked_beams(beams, "k", "p", "n", 0.0, 1).first().b == 0 and V.ranked_beams(beams, "k", "p", "n", 1.0, 1).first().b == 1


@pytest.mark.parametrize("broadcast_pieces", [0, 10**6])
def test_containment_of_long_lists(spark, broadcast_pieces):
    """n-grams of a table, broadcast and joined by shuffle, against all pairs."""
    import random

    from turnmill.operators import ngrams as N

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(99, None), (100, "ab c\nab c aab bc" * 300)]
    grams = list({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(3000)} | {"", "aä", "b c\nab c a"})
    df = spark.createDataFrame(texts, "line_no bigint, text string")
    listed = spark.createDataFrame([(g,) for g in [*grams, None, grams[0]]], "ngram string")
    want = sorted((i, g) for i, t in texts for g in grams if t is not None and g in t)
    assert sorted(tuple(r) for r in N.found_in(df, listed, broadcast_pieces=broadcast_pieces).collect()) == want
    if broadcast_pieces:
        assert sorted(tuple(r) for r in N.containing(df, grams[:300] + [""]).collect()) == sorted(x for x in want if x[1] in {*grams[:300], ""})
    assert N.found_in(df, listed.limit(0)).collect() == []


def test_long_lists_move_no_pieces(spark, monkeypatch):
    """n-grams of several words beyond the broadcast bound are met by runs of words: a row for each position, none for each 8 characters; blanks at edges and in a row, affixes, long words."""
    from turnmill.operators import ngrams as N

    def refused(*_):
        raise AssertionError("pieces")

    monkeypatch.setattr(N, "_pieces", refused)
    long = "x" * 40
    texts = [(0, "in there of  the theory"), (1, f"a{long}b c{long}d"), (2, "then\nof the the the"), (3, " of the"), (4, "there of the the"), (5, None)]
    grams = ["ere of", "re of  the", "of  ", " of", "the the", "n\nof the", f"{long}b c{long}", f"{long[1:]}b c{long[2:]}", " the th", "e the", "of the the the", "there of the ", "absent of"]
    df, listed = spark.createDataFrame(texts, "line_no bigint, text string"), spark.createDataFrame([(g,) for g in grams], "ngram string")
    want = sorted((i, g) for i, t in texts for g in grams if t is not None and g in t)
    assert sorted(tuple(r) for r in N.found_in(df, listed, broadcast_pieces=0).collect()) == want
    th = [g for g in grams if g.startswith("re ")]  # few beginnings: runs are left out before they move
    assert sorted(tuple(r) for r in N.found_in(df, listed.where("ngram LIKE 're %'"), broadcast_pieces=0).collect()) == [x for x in want if x[1] in th]


def test_copies_of_a_line_are_met_once(spark, monkeypatch):
    """thinned looks for its n-grams in different lines only."""
    from turnmill.operators import ngrams as N

    seen, found_in = [], N.found_in
    monkeypatch.setattr(N, "found_in", lambda texts, *a, **b: (seen.append(texts.count()), found_in(texts, *a, **b))[1])
    texts = spark.createDataFrame([(i, f"of the x{i % 7}" if i % 2 else None) for i in range(98)], "line_no bigint, text string")
    drop = {r.line_no for r in N.thinned(texts, spark.createDataFrame([("of the", 2)], "ngram string, quota int")).collect()}
    assert seen == [7] and len(drop) == 14 and all(i % 2 for i in drop)


def test_thinned_lines(spark):
    from turnmill.operators import ngrams as N

    texts = spark.createDataFrame([(i, f"w{i % 97} of the x{i % 150}") for i in range(300)], "line_no bigint, text string")
    quotas = {"of the": 20, "the x1": 30, "x149": 5, "absent": 9}
    drop = {r.line_no for r in N.thinned(texts, spark.createDataFrame(list(quotas.items()), "ngram string, quota int"), seed=3).collect()}
    rows = {r.line_no: r.text for r in texts.collect()}
    lost = {rows[i] for i in drop}
    assert drop == {i for i, t in rows.items() if t in lost}  # all copies of a line
    for g, n in quotas.items():
        assert sum(g in t for t in lost) >= min(n, len({t for t in rows.values() if g in t}))
    assert len(lost) <= 20 + 30 + 5


def test_dull_lines(spark):
    from turnmill.functions.lists import DULL

    texts = ["i 'm not sure how that ends", "I 'm  not sure how", "i do n't know .", "i 'm not a huge fan of the red one, but it works", "i 'm not a huge fan of it, but no", None, "so i do n't know .", "i 'm not saying it 's late , but i 'm not saying no"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    got = sorted(tuple(r) for r in Z.dull_lines(df, DULL, "k").collect())
    assert got == [(0, "i 'm not sure how $1"), (2, "i do n't know ."), (3, "i 'm not a huge fan of the $1, but $1"), (7, "i 'm not saying it 's $1 , but i 'm not saying $1")]


def test_resumed_training_opens_no_earlier_parts(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS key", "cast(id % 3 AS int) AS bucket")
    batches = B.batched(rows, 10, ["key"])
    n = B.store_epoch(batches, f"{tmp_path}/epoch", seed=1, part=8)
    assert n == 51
    every = B.resumed(spark, f"{tmp_path}/epoch", 2 * n, batches.schema, part=8)
    assert every.count() == 500 and every.select("number").distinct().count() == n
    assert every.groupBy("number").agg(F.countDistinct("bucket", "batch").alias("n")).where("n <> 1").isEmpty()
    left = B.resumed(spark, f"{tmp_path}/epoch", n + 29, batches.schema, part=8)
    assert sorted(r.key for r in left.collect()) == sorted(r.key for r in every.where("number >= 29").collect())
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and ">= 3)" in plan


def test_ranks_in_groups(spark):
    from turnmill.operators.ranks import ranked_in

    rows = [(i * 7 % 300, None if i % 5 == 0 else i % 2) for i in range(300)]
    got = ranked_in(spark.createDataFrame(rows, "k bigint, g bigint"), "g", [F.col("k")]).collect()
    for g in (None, 0, 1):
        assert [r["rank"] for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == list(range(1, 1 + sum(x == g for _, x in rows)))


def test_ngram_counts_by_runs(spark):
    """Every order against plain counting, with gaps in the orders; a row is shuffled for each position, not for each order of it."""
    from collections import Counter

    texts = ["a b a b a", "a", "", None, "b  a\tb", "a b", "x y z w a b a b", "a b a b a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for orders in ([1, 2, 3], [3], [2, 1], [1, 3], [4, 2]):
        for compat in (False, True):
            want = Counter((n, " ".join(w[i : i + n])) for t in texts if t for w in [t.split()] for n in orders for i in range(len(w) - n + 1 - compat))
            assert {(r.n, r.ngram): r.freq for r in N.counts(df, orders, compat=compat).collect()} == want
            assert {(r.n, r.ngram): r.freq for r in N.counts(df, orders, compat=compat, more_than=2).collect()} == {k: v for k, v in want.items() if v > 2}
    first = N._runs(df, 3, "text")
    assert first.agg({"_f": "sum"}).collect()[0][0] == sum(len((t or "").split()) for t in texts)
