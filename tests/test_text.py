"""Text functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from turnmill.functions import numbers as M, text as X, tweets as T
from turnmill.plans import format_queries as FQ
from turnmill.functions.entities import TAGGED, normalize_entities


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("x,share", [("abc def!", True), ("abc 123", False), ("", False)])
def test_textual(spark, x, share):
    assert one(spark, x, X.is_textual) is share


@pytest.mark.parametrize("x,mood", [(":)", "HAPPY"), (":(", "SAD"), (":) :(", "BOTH_HS"), ("hi", "NA"), ("^_^", "HAPPY"), ("=O(", "SAD")])
def test_sentiment(spark, x, mood):
    assert one(spark, x, X.sentiment) == mood


def test_topic_terms(spark):
    words = ["Don't", "it's,", "--", "The", "a1", "Water", "ab.c"]
    assert one(spark, words, lambda c: X.topic_terms(c, ["the"], 3), "array<string>") == ["its", "water", "abc"]


def test_tokens(spark):
    assert one(spark, "a\u00a0 b\tc ", X.tok) == ["a", "b", "c"]
    assert one(spark, 'He said: "no!" (ok)', X.basic_tokens) == ["He", "said", ":", '"', "no", "!", '"', "(", "ok", ")"]
    assert one(spark, ["@url$", "RedditUser", "x"], X.placeholders, "array<string>") == ["<url>", "<person>", "x"]
    assert one(spark, "don't", X.contraction_parts) == ["do", "n't"] and one(spark, "x", X.contraction_parts) == ["x"]
    assert one(spark, " +3.5kg", lambda c: X.number_token(F.trim(c))) == "<number>"


STEPS = [
    ("see http://a.com/x y z", "see @url$ y z", "see @url$"),
    ("hi @bob there", "hi RedditUser there", "hiRedditUserthere"),
    ("by /u/some-one", "by RedditUser", "by RedditUser"),
    ("in r/python, yes", "in @url$, yes", "in @url$, yes"),
    ("2^(10) and a^b", "210 and ab", "210 and ab"),
    ("a&nbsp;b \u201cq\u201d \u2018s\u2019 \u2605", "a b \"q\" 's' *", "a b \"q\" 's' *"),
]


@pytest.mark.parametrize("x,fixed,compat", STEPS)
def test_steps(spark, x, fixed, compat):
    assert one(spark, x, X.normalize_before_emoticons) == fixed
    assert one(spark, x, lambda c: X.normalize_before_emoticons(c, True)) == compat


LATER = [
    ("wow!!!! -lrb-x-RRB-", "wow!! (x)"),
    ("a... ... ... b", "a... b"),
    ("x (_-_) [ - ] y \\-/", "x   y"),
    ("\uff21\uff22 \uff11 \u00e9\u0142 \ufb01", "AB 1 e\u0142 \ufb01"),
    ("\u2500\u2588box\u2764 \u0e01\U0001f1e6", "box"),
    ("\u00bfque?", "que?"),
]


@pytest.mark.parametrize("x,want", LATER)
def test_later_steps(spark, x, want):
    assert one(spark, x, X.normalize_after_emoticons) == want


def test_quotes(spark):
    assert one(spark, "&gt; quoted\nmore\n\nmine", X.strip_quotes) == "mine"


TWEETS = [
    ("hello (#hashtag) don't", ["hello", "(", "#hashtag", ")", "don't"]),
    ("'anthem'. :-) <3", ["'", "anthem", "'", ".", ":-)", "<3"]),
    ("at 12:53 http://x.org/a, U.S.A. 3.50%", ["at", "12:53", "http://x.org/a", ",", "U.S.A.", "3.50%"]),
    ("me@x.com @you --> o.O", ["me@x.com", "@you", "-->", "o.O"]),
    ("", []),
]


@pytest.mark.parametrize("x,want", TWEETS)
def test_tweets(x, want):
    assert T.tokenize(x) == want


def test_tweet_helpers():
    assert T.tokenize_raw("a &amp;lt;3 b") == ["a", "<3", "b"]
    assert T.split_contraction("they'll") == ["they", "'ll"] and T.split_contraction("x") == ["x"]
    assert T.strip_emoticons("good :) day") == "good  day" and T.strip_emoticons(":-(") == ""
    assert T.strip_emoticons("look \u0ca0_\u0ca0 here", ["\u0ca0_\u0ca0"]) == "look  here"
    assert T.strip_emojis("a\U0001f602\U0001f602b") == "ab"
    assert T.strip_markdown("# Head\n\n* a **b** [c](http://d)\n> q\n`x`") == "Head\n\na b c\nq\nx"
    assert T.strip_markdown("| a | b |\n|---|:-:|\n| c | d |\n\nsee [x][1], [y] and ![i][1]\n\n[1]: http://q 'T'\n\n    code *x*\n\n```py\nz_a_\n```\nend `a*b*`").split() == "a b c d see x, [y] and code *x* z_a_ end a*b*".split()
    assert T.rule_tokens("Don't go, @url$ (now)...") == ["Do", "n't", "go", ",", "@url$", "(", "now", ")", "..."]


def test_rule_tokens(spark):
    texts = ["Don't go, @url$ (now)...", "it's 3.5 <person>!", "Él’s ñandú't 1,000.5 a_b... ....", "", "we'VE n't 's x'y'z o'clock's", "a\u0301b 中文 ½ ²"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    assert [r.y for r in df.select("k", X.rule_tokens("x").alias("y")).orderBy("k").collect()] == [T.rule_tokens(t) for t in texts]


#: A text for each rule by itself; the queries of the same names put them behind every turn.
LITERAL = [
    (FQ.WORD_CASES, lambda x: F.array_join(X.placeholders(X.tok(x)), " ")),
    (FQ.BLANK_CASES, lambda x: X.squeeze_whitespace(X.no_nbsp(x))),
    (FQ.RULE_CASES, lambda x: F.array_join(X.rule_tokens(x), " ")),
    (FQ.TWEET_CASES, lambda x: F.array_join(T.raw_tokens_udf()(x), "|")),
    (FQ.FACE_CASES, lambda x: T.emoticons_udf()(x)),
    (FQ.POST_CASES, T.normalize_post),
    ([("don't", "do|n't"), ("we've", "we|'ve"), ("she'll", "she|'ll"), ("I'm", "I|'m"), ("it’s", "it|’s"), ("plain", "plain"), ("they'd", "they|'d")], lambda x: F.array_join(X.contraction_parts(x), "|")),
    ([("``", '"'), ("''", '"'), ("`", "'"), ("-LRB-", "("), ("-RSB-", "]"), ("x", "x")], X.treebank),
]


def test_literal_cases(spark):
    for cases, rule in LITERAL:
        df = spark.createDataFrame(cases, "x string, y string")
        assert not df.withColumn("got", rule(F.col("x"))).where("not got <=> y").collect()


def test_whole_normalization(spark):
    df = spark.createDataFrame([("**Hi** @bob :) see http://x.com/a!!!! \U0001f602",)], "x string")
    assert df.select(T.normalize_post(F.col("x")).alias("y")).first().y == "Hi RedditUser  see @url$!!"


def test_country_domains():
    """Two letters after a full stop are a domain only where there is such a country."""
    assert T.tokenize("ask me.if or it.or see a.de and x.co.uk") == ["ask", "me", ".", "if", "or", "it", ".", "or", "see", "a.de", "and", "x.co.uk"]


def test_look_alikes(spark):
    one, to, many = X.plain_letters()
    table = dict(zip(one, to, strict=True)) | dict(many)
    # Latin, small capitals, modifier letters, Greek, Armenian, International Phonetic Alphabet, full width; others stay
    want = {"é": "e", "Ⱥ": "A", "ᴀ": "A", "ᴌ": "L", "ᴘ": "K", "ᴬ": "A", "ᵃ": "a", "ᵥ": "v", "Α": "A", "χ": "X", "Տ": "S", "ɢ": "G", "ɑ": "a", "ʍ": "m", "ǆ": "dz", "Ǿ": "O", "ƺ": "3", "Ａ": "A", "～": "~", "ß": "b"}
    assert {c: table.get(c) for c in want} == want and not any(c in table for c in "ñöüçÀØǷȜȸ")
    assert len(table) == 94 + 355
    got = spark.createDataFrame([("ｈéʟʟᴏ ǆñ",)], "x string").select(X.plain(F.col("x")).alias("y")).first().y
    assert got == "heLLO dzñ"


def test_listed_emoticons():
    assert T.strip_emoticons("well ಠ_ಠ then") == "well  then" and T.strip_emoticons("well ಠ_ಠ then", []) != "well  then"


def test_entities(spark):
    words = [(0, "Bob", "", "", "PERSON"), (1, "Lee", "", "", "PERSON"), (2, "Paid", "", "", ""), (3, "5", "", "", "MONEY"), (4, "Dollars", "", "", "MONEY"), (5, "2001", "", "", "DATE"), (6, "x", "", "", None)]
    assert one(spark, words, normalize_entities, TAGGED) == ["<person>", "paid", "<number>", "dollars", "<time>", "x"]


def test_numbers(spark):
    row = spark.range(1).select(M.safe_div(F.lit(1.0), F.lit(0.0)).alias("d"), M.safe_mod(F.lit(5), F.lit(0)).alias("m"), M.safe_exp(F.lit(1000.0)).alias("e"), M.train_steps(F.lit(2.5), F.lit(100), F.lit(64)).alias("s")).first()
    assert (row.d, row.m, row.e, row.s) == (0.0, 0, float("inf"), 5)
    steps = spark.createDataFrame([(599,), (600,), (675,), (750,)], "s int").select(M.decayed(1.0, F.col("s"), 900, "luong234").alias("r")).collect()
    assert [r.r for r in steps] == [1.0, 1.0, 0.5, 0.25]
    pairs = spark.createDataFrame([(5, 6), (30, 31), (0, 1)], "a int, b int")
    assert [r.k for r in pairs.select(M.bucket([F.col("a"), F.col("b")], 30, 5).alias("k")).collect()] == [1, 5, 0]
    assert M.bucket_width(None, 5) == 10
    with pytest.raises(ValueError):
        M.decayed(1.0, F.lit(1), 10, "other")


def test_sentences_and_tags(spark):
    from turnmill.functions import annotate as A

    assert A.sentences('He left. "Why?" she asked. Dr. Who came! ok') == ["He left.", '"Why?" she asked.', "Dr. Who came! ok"]
    assert A.sentences("") == []
    assert [w[4] for w in A.tagged("RedditUser paid 3.5 at @url$")] == ["PERSON", "", "NUMBER", "", "URL"]
    df = spark.createDataFrame([("Hi. There",), (None,)], "x string")
    got = df.select(A.sentences_udf()("x").alias("s"), normalize_entities(A.tagged_udf()("x")).alias("n")).collect()
    assert got[0].s == ["Hi.", "There"] and got[0].n == ["hi", ".", "there"] and got[1].s is None
    assert df.select(A.sentences_udf(lambda t: [t])("x").alias("s")).first().s == ["Hi. There"]
