"""Sentence ends learned from a corpus."""

import math
from collections import Counter

import pytest
from pyspark.sql import Row

from turnmill.operators import sentences as ST

FILLER = "the cat sat there"
LINES = [f"We met Dr. Smith and Prof. Jones in May. However it rained on {w} days. {FILLER.capitalize()} for long! Was it \"so?\" Yes, e.g. here." for w in ("two", "six", "ten", "few", "odd", "hot", "wet", "dry")]
LINES += [f"Nobody knows {w} well. However they try. However it goes on. However long." for w in ("maths", "verse", "music", "games", "drums", "chess")] * 4


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*LINES, None, "", "  ", "...", ". .. a.b.c. (x.) "])], "key long, text string")


def slow_scores(lines):
    seen, stopped = Counter(), Counter()
    for t in lines:
        for w in (t or "").split():
            c = w.lstrip("\"'“‘([{").rstrip("\"'”’)]},;:").lower()
            if c.endswith("..") or not c[:1].isalpha() or not all(x.isalpha() or x == "." for x in c):
                continue
            kind = c.removesuffix(".")
            seen[kind] += 1
            stopped[kind] += c.endswith(".")
    p = sum(stopped.values()) / sum(seen.values())
    out = {}
    for w, n in seen.items():
        k, m = stopped[w], len(w.replace(".", ""))
        if k:
            ratio = 2 * (k * math.log(0.99 / p) + (n - k) * math.log(0.01 / (1 - p)))
            out[w] = (k, n, ratio * math.exp(-m) * (w.count(".") + 1) * m ** float(k - n))
    return out


def test_scores_equal_a_slow_count(corpus):
    got = {r.type: (r.stopped, r.total, r.score) for r in ST.scored(ST.counts(corpus)).collect()}
    want = slow_scores([r.text for r in corpus.collect()])
    assert got.keys() == want.keys()
    for w, (k, n, s) in want.items():
        assert got[w][:2] == (k, n) and got[w][2] == pytest.approx(s, rel=1e-9)
    assert {"dr", "prof", "e.g"} <= {w for w, x in want.items() if x[2] >= ST.ABBREVIATION}


def test_sentences(spark, corpus):
    short = ST.abbreviations(corpus)
    first = ST.starters(corpus, short)
    assert "however" in {r.type for r in first.collect()}
    texts = spark.createDataFrame(
        [
            (1, "We saw Dr. Smith.  He left. \n\nIt was \"fine.\" Then e.g. However came! and went? No"),
            (2, None),
            (3, ""),
            (4, " \n "),
            (5, "one"),
            (6, "J. R. Doe... Ok.) (So on. go on"),
            (7, ". . ! ?"),
        ],
        "key long, text string",
    )
    want = {
        1: ["We saw Dr. Smith.", "He left.", 'It was "fine."', "Then e.g.", "However came! and went?", "No"],
        2: None,
        3: [],
        4: [],
        5: ["one"],
        6: ["J. R. Doe...", "Ok.)", "(So on. go on"],
        7: [".", ".", "!", "?"],
    }
    for listed in (None, 0):  # in the plan, and by joins
        assert {r.key: r.sentences for r in ST.split(texts, short, first, ["key"], listed=listed).collect()} == want


def test_both_ways_agree_on_the_corpus_and_keep_other_columns(corpus):
    short = ST.abbreviations(corpus)
    first = ST.starters(corpus, short)
    x = corpus.selectExpr("key", "text", "key as type", "1 as next", "array('a') as sentences")
    a, b = (ST.split(x, short, first, ["key"], listed=n) for n in (None, 0))
    assert a.columns == ["key", "text", "type", "next", "sentences"]
    rows = sorted(a.collect())
    assert rows == sorted(b.collect())
    for r in rows:
        if r.text is not None:
            assert "".join("".join(r.sentences).split()) == "".join(r.text.split())


def test_empty(spark):
    none = spark.createDataFrame([], "key long, text string")
    short = ST.abbreviations(none)
    first = ST.starters(none, short)
    assert short.collect() == first.collect() == []
    one = spark.createDataFrame([Row(key=1, text="Ab ba. Cd do.")])
    assert ST.split(one, short, first, ["key"]).first().sentences == ["Ab ba.", "Cd do."]


def test_learned_from_one_pass(spark, tmp_path):
    """Types, abbreviations and starters come from one table of word pairs, and are the same without it."""
    from turnmill.operators import sentences as ST

    texts = ["Dr. Who came. The end. The \"end.\" He said (approx. five).", None, "", "one..  two.\tThe three", "The"] * 40
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ST.pairs(df).write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.agg({"n": "sum"}).collect()[0][0] == sum(len((t or "").split()) for t in texts)
    none = df.limit(0)  # the texts aren't read again
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(ST.counts(none, of_pairs=pairs)) == rows(ST.counts(df)) and ("the", 0, 160) in rows(ST.counts(df))
    short = ST.abbreviations(df)
    assert rows(ST.abbreviations(none, of_pairs=pairs)) == rows(short)
    assert rows(ST.starters(none, short, of_pairs=pairs, least=0.0)) == rows(ST.starters(df, short, least=0.0))
