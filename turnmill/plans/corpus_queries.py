"""Queries over texts, terms, n-grams, vocabularies, embeddings and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.functions import text as X
from turnmill.functions.entities import normalize_entities
from turnmill.operators import embeddings as E, ngrams as N, ranks as R, stats as S, topics as TP, vocab as V
from turnmill.plans.registry import conversations, query, r6, read, words
from turnmill.session import adopt

TF = f"t AS (SELECT unnest({words('text')}) AS word FROM documents), f AS (SELECT word, count(*) AS tf FROM t GROUP BY word)"


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.term_frequency(read(spark, sf_dir, "documents"))


@query(f"WITH {TF} SELECT word, tf FROM f")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tf(spark, sf_dir)


@query(f"WITH {TF} SELECT word FROM f")
def vocabulary_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary(read(spark, sf_dir, "documents"))


@query(f"WITH {TF} SELECT word, tf, row_number() OVER (ORDER BY tf DESC, word) AS rank FROM f QUALIFY rank <= 50")
def term_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_frequent(_tf(spark, sf_dir), 50)


@query(f"WITH {TF} SELECT word, tf, row_number() OVER (ORDER BY tf, word DESC) AS rank FROM f QUALIFY rank <= 50")
def term_freq_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rarest(_tf(spark, sf_dir), 50)


@query(f"WITH {TF} SELECT word, tf, row_number() OVER (ORDER BY tf, word DESC) AS rank FROM f QUALIFY rank <= 49")
def term_freq_rare_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rarest(_tf(spark, sf_dir), 50, compat=True)


@query(f"WITH {TF} SELECT word, tf, row_number() OVER o AS rank, CAST(sum(tf) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM f WINDOW o AS (ORDER BY tf DESC, word)")
def cumulative_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its rank and the tokens up to it."""
    return S.by_frequency(_tf(spark, sf_dir))


@query(f"""WITH {TF}, h AS (SELECT tf FROM f ORDER BY tf DESC, word LIMIT 1000) SELECT count(*) AS words, CAST(sum(tf) AS BIGINT) AS tokens, count(*) FILTER (tf >= 3) AS words_min, CAST(sum(tf) FILTER (tf >= 3) AS BIGINT) AS tokens_min,
  (SELECT CAST(sum(tf) AS BIGINT) FROM h) AS top_tokens, round(count(*) FILTER (tf >= 3) / count(*), 6) AS word_share, round(sum(tf) FILTER (tf >= 3) / sum(tf), 6) AS token_share, round((SELECT sum(tf) FROM h) / sum(tf), 6) AS top_share FROM f""")
def freq_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(_tf(spark, sf_dir), 1000, 3).withColumns({c: r6(c) for c in ("word_share", "token_share", "top_share")})


def _ngrams(n: int, table: str = "documents", less: int = 0) -> str:
    return f"SELECT {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2 + less}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS ngram FROM w"


NG = f"w AS (SELECT {words('text')} AS w FROM documents), g AS ({' UNION ALL '.join(_ngrams(n) for n in (1, 2, 3))})"
NGC = f"w AS (SELECT {words('text')} AS w FROM documents), g AS ({' UNION ALL '.join(_ngrams(n, less=1) for n in (1, 2, 3))})"
NGU = NG.replace("documents", "conversations")


@query(f"WITH {NG} SELECT n, ngram, count(*) AS freq FROM g GROUP BY n, ngram")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.counts(read(spark, sf_dir, "documents"), [1, 2, 3])


@query(f"WITH {NGC} SELECT n, ngram, count(*) AS freq FROM g GROUP BY n, ngram HAVING count(*) > 10")
def ngram_frequent_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last n-gram of each text left out; more than ten times."""
    return N.counts(read(spark, sf_dir, "documents"), [1, 2, 3], compat=True, more_than=10)


@query(f"WITH {NGU} SELECT n, count(DISTINCT ngram) AS distinct_ngrams, (SELECT CAST(sum(len(w)) AS BIGINT) FROM w) AS words, round(count(DISTINCT ngram) / (SELECT sum(len(w)) FROM w), 6) AS distinct_n FROM g GROUP BY n")
def distinct_n_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.distinct_exact(read(spark, sf_dir, "conversations"), [1, 2, 3]).withColumn("distinct_n", r6("distinct_n"))


@query()
def distinct_n_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sketch; tests hold it against distinct_n_exact."""
    return N.distinct(read(spark, sf_dir, "conversations"), [1, 2, 3]).withColumn("distinct_n", r6("distinct_n"))


GRAMS = ["of the", "and the", "er die", "que la", "scum"]


@query("SELECT doc_id, ngram FROM documents, (SELECT unnest(['of the', 'and the', 'er die', 'que la', 'scum']) AS ngram) WHERE contains(text, ngram)")
def lines_with_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.containing(read(spark, sf_dir, "documents"), GRAMS, key="doc_id")


@query("""WITH h AS (SELECT doc_id, text, md5('1:' || text) AS h FROM documents WHERE text IS NOT NULL), l AS (SELECT h, any_value(text) AS text FROM h GROUP BY h),
a AS (SELECT h FROM l WHERE contains(text, 'of the') ORDER BY h LIMIT 20), n AS (SELECT greatest(0, 30 - count(*)) AS n FROM l WHERE contains(text, 'and the') AND h IN (SELECT h FROM a)),
b AS (SELECT h, row_number() OVER (ORDER BY h) AS r FROM l WHERE contains(text, 'and the') AND h NOT IN (SELECT h FROM a)), c AS (SELECT h FROM a UNION SELECT h FROM b, n WHERE r <= n)
SELECT doc_id FROM h WHERE h IN (SELECT h FROM c)""")
def ngram_down_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to drop for quotas of n-grams, by a seeded digest."""
    return N.down_sampled(read(spark, sf_dir, "documents"), {"of the": 20, "and the": 30}, key="doc_id", seed=1)


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3")
def ranked_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ranked_per(read(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "rank")



@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '&nbsp;', ' '), '\s+', ' ', 'g'), '(\.\.\.\s){2,}', '... ', 'g'), '("){2,}', '"', 'g'), '(_){2,}', '', 'g'), '!{2,}', '!!', 'g')) AS norm FROM documents""")
def normalize_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of post normalization that both regular-expression engines share."""
    x = F.regexp_replace(F.replace(F.col("text"), F.lit("&nbsp;"), F.lit(" ")), r"\s+", " ")
    for p, to in X.SQUEEZED:
        if "^" not in p:
            x = F.regexp_replace(x, p, to)
    return read(spark, sf_dir, "documents").select("doc_id", F.trim(x).alias("norm"))


@query()
def normalize_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps, with the Arrow UDFs for markdown and emoticons."""
    from turnmill.functions.tweets import normalize_post as whole

    return adopt(read(spark, sf_dir, "conversations")).select("conv_id", "turn", whole(F.col("text")).alias("norm"))


@query()
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnmill.functions.tweets import html_udf

    return adopt(read(spark, sf_dir, "pages")).select("page_id", html_udf()("html").alias("text"))


@query()
def tweet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnmill.functions.tweets import raw_tokens_udf

    return adopt(read(spark, sf_dir, "conversations")).select("conv_id", "turn", F.array_join(raw_tokens_udf()("text"), " ").alias("tokens"))


@query()
def emoticon_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnmill.functions.tweets import emoticons_udf

    return adopt(read(spark, sf_dir, "conversations")).select("conv_id", "turn", emoticons_udf()(F.concat("text", F.lit(" :-) x"))).alias("text"))


FACES = ["x :) y", "x :( y", ":) :(", "=D", "^_^", "hi", ":o]", "[:", ":-["]


@query("WITH x AS (SELECT unnest(['x :) y', 'x :( y', ':) :(', '=D', '^_^', 'hi', ':o]', '[:', ':-[']) AS text UNION ALL SELECT text FROM documents) SELECT text, CASE WHEN h AND s THEN 'BOTH_HS' WHEN h THEN 'HAPPY' WHEN s THEN 'SAD' ELSE 'NA' END AS mood FROM (SELECT text, regexp_matches(text, '(\\^_\\^|[:=](|o|O|-)[D\\)\\]])') AS h, regexp_matches(text, '[:=](|o|O|-)[\\(\\[]') AS s FROM x)")
def sentiment_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in FACES], "text string").unionByName(read(spark, sf_dir, "documents").select("text"))
    return rows.select("text", X.sentiment("text").alias("mood"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(regexp_replace(text, '([.,!?"'':;)(])', ' \1 ', 'g'), '\s+'), lambda t: t <> ''), ' ') AS tokens FROM conversations""")
def basic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.basic_tokens("text"), " ").alias("tokens"))


@query(r"SELECT event_id, regexp_replace(props, '[0-9]', '0', 'g') AS zeros, CASE WHEN regexp_matches(CAST(event_id AS VARCHAR), '^[-+]?[0-9]+') THEN '<number>' END AS number FROM events")
def digit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", X.zero_digits("props").alias("zeros"), X.number_token(F.col("event_id").cast("string")).alias("number"))


MARKS = ["``", "''", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-", "-LSB-", "-RSB-"]


@query(rf"""WITH m AS (SELECT conv_id, turn, list_transform({words('text')}, lambda t, i: CASE WHEN i % 3 = 0 THEN ['``', '''''', '`', '-LRB-', '-RRB-', '-LCB-', '-RCB-', '-LSB-', '-RSB-'][i // 3 % 9 + 1] ELSE t END) AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(t, lambda t: CASE t WHEN '``' THEN '"' WHEN '''''' THEN '"' WHEN '`' THEN '''' WHEN '-LRB-' THEN '(' WHEN '-RRB-' THEN ')' WHEN '-LCB-' THEN '{{' WHEN '-RCB-' THEN '}}' WHEN '-LSB-' THEN '[' WHEN '-RSB-' THEN ']' ELSE t END), ' ') AS fixed FROM m""")
def treebank_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all turns, every third of them a mark in treebank notation."""
    marks = F.array(*[F.lit(m) for m in MARKS])
    marked = F.transform(X.tok("text"), lambda t, i: F.when(i % 3 == 2, F.element_at(marks, (F.floor((i + 1) / 3) % len(MARKS) + 1).cast("int"))).otherwise(t))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(marked, X.treebank), " ").alias("fixed"))


@query("WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'click' THEN '<person>' WHEN 'view' THEN '<url>' ELSE event_type END AS w FROM events), l AS (SELECT *, lag(w) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e) SELECT user_id, string_agg(w, ' ' ORDER BY event_id) AS line FROM l WHERE NOT (w LIKE '<%' AND p IS NOT NULL AND w = p) GROUP BY user_id")
def entity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tagged words: clicks are persons, views are addresses; runs of one placeholder are one."""
    word = F.struct(F.col("event_id").cast("int").alias("index"), F.col("event_type").alias("term"), F.col("event_type").alias("lemma"), F.lit("").alias("pos"), F.when(F.col("event_type") == "click", "PERSON").when(F.col("event_type") == "view", "URL").otherwise("").alias("ner"))
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(word)).alias("w"))
    return rows.select("user_id", F.array_join(normalize_entities(F.col("w")), " ").alias("line"))


VOCAB = f"{TF}, k AS (SELECT word, tf, row_number() OVER (ORDER BY tf DESC, word) + 3 AS id FROM f WHERE word NOT IN ('<UNK>', '<S>', '</S>', '<SEP>') QUALIFY id < 5000), v AS (SELECT id, word, tf FROM k UNION ALL SELECT * FROM (VALUES (0, '<UNK>', NULL), (1, '<S>', NULL), (2, '</S>', NULL), (3, '<SEP>', NULL)))"


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.build(_tf(spark, sf_dir), 5000)


@query(f"WITH {VOCAB} SELECT id, word, coalesce(tf, 0) AS tf FROM v")
def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).withColumn("tf", F.coalesce("tf", F.lit(0)))


@query(f"WITH {VOCAB}, x AS (SELECT conv_id, turn, unnest({words('text')}) AS word, generate_subscripts({words('text')}, 1) AS i FROM conversations) SELECT conv_id || ':' || turn AS key, string_agg(coalesce(id, 0), ' ' ORDER BY i) AS ids, string_agg(CASE WHEN id IS NULL THEN '<UNK>' ELSE x.word END, ' ' ORDER BY i) AS decoded FROM x LEFT JOIN v ON x.word = v.word GROUP BY conv_id, turn")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as ids, and back."""
    vocab = R.written(_vocab(spark, sf_dir), "vocab")
    rows = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), V.words_of("text").alias("words"))
    coded = V.encode_decode(rows, vocab, key="key")
    return coded.where(F.size("ids") > 0).select("key", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), F.array_join("decoded", " ").alias("decoded"))


@query(f"WITH {VOCAB}, c AS (SELECT word, count(*) AS tf FROM (SELECT unnest({words('text')}) AS word FROM conversations) GROUP BY word) SELECT CAST(sum(c.tf) AS BIGINT) AS tokens, CAST(coalesce(sum(c.tf) FILTER (v.id IS NULL), 0) AS BIGINT) AS oov_tokens, count(*) AS words, count(*) FILTER (v.id IS NULL) AS oov_words FROM c LEFT JOIN v ON c.word = v.word")
def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.oov(S.term_frequency(read(spark, sf_dir, "conversations")), _vocab(spark, sf_dir))


@query(r"""WITH t AS (SELECT unnest(list_transform(list_filter(string_split_regex(regexp_replace(text, '([.,!?"'':;)(])', ' \1 ', 'g'), '\s+'), lambda t: t <> ''), lambda t: regexp_replace(t, '[0-9]', '0', 'g'))) AS word FROM conversations), f AS (SELECT word, count(*) AS tf FROM t GROUP BY word)
SELECT row_number() OVER (ORDER BY tf DESC, word) + 3 AS id, word, tf FROM f QUALIFY id < 500 UNION ALL SELECT * FROM (VALUES (0, '_PAD', 0), (1, '_GO', 0), (2, '_EOS', 0), (3, '_UNK', 0))""")
def vocab_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.build_old(read(spark, sf_dir, "conversations"), 500).withColumn("tf", F.coalesce("tf", F.lit(0)))


TOPICAL = f"""c AS (SELECT word, count(*) AS tf FROM (SELECT unnest({words('text')}) AS word FROM conversations) GROUP BY word), b AS (SELECT word, count(*) AS tf FROM (SELECT unnest({words('text')}) AS word FROM benchmark) GROUP BY word),
t AS (SELECT b.word, b.tf + coalesce(c.tf, 0) AS tf FROM b LEFT JOIN c ON b.word = c.word), h AS (SELECT word, tf FROM c ORDER BY tf DESC, word LIMIT 996), o AS (SELECT word, tf, row_number() OVER (ORDER BY tf DESC, word) AS r FROM h WHERE word NOT IN (SELECT word FROM b))"""


@query(f"WITH {TOPICAL} SELECT r + 3 AS id, word, tf FROM o UNION ALL SELECT row_number() OVER (ORDER BY tf DESC, word) + 3 + (SELECT count(*) FROM o), word, tf FROM t UNION ALL SELECT * FROM (VALUES (0, '<UNK>', 0), (1, '<S>', 0), (2, '</S>', 0), (3, '<SEP>', 0))")
def topical_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words as topic words, appended after the dialogue words."""
    dialog, topic = S.term_frequency(read(spark, sf_dir, "conversations")), S.term_frequency(read(spark, sf_dir, "benchmark"))
    return V.topical(dialog, topic, 1000)[1].withColumn("tf", F.coalesce("tf", F.lit(0)))


@query(f"WITH {TOPICAL} SELECT word, tf, row_number() OVER (ORDER BY tf DESC, word) AS rank FROM t")
def topic_words_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    dialog, topic = S.term_frequency(read(spark, sf_dir, "conversations")), S.term_frequency(read(spark, sf_dir, "benchmark"))
    return V.topical(dialog, topic, 1000)[0]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the words of the vocabulary whose id is one of a vector."""
    v = _vocab(spark, sf_dir).select("id", "word")
    return v.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id").select("word", "vec")


@query(f"WITH {VOCAB} SELECT id, word FROM v WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.out_of_vocabulary(_vocab(spark, sf_dir).select("id", "word"), _vectors(spark, sf_dir))


@query(f"WITH {VOCAB} SELECT id, word FROM v WHERE id IN (SELECT vec_id FROM embeddings)")
def embedding_iov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.in_vocabulary(_vocab(spark, sf_dir).select("id", "word"), _vectors(spark, sf_dir))


@query(f"WITH {VOCAB} SELECT row_number() OVER (ORDER BY CASE WHEN id < 4 THEN 0 WHEN id NOT IN (SELECT vec_id FROM embeddings) THEN 1 ELSE 2 END, id) - 1 AS id, word, id AS old_id FROM v")
def embedding_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reordered(_vocab(spark, sf_dir), _vectors(spark, sf_dir))


@query(f"WITH {VOCAB} SELECT v.id, v.word, e.vec_id IS NULL AS trainable, CASE WHEN e.vec_id IS NULL THEN 0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM v LEFT JOIN embeddings e ON v.id = e.vec_id")
def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab(spark, sf_dir)
    found = E.matrix(E.from_table(v, _vectors(spark, sf_dir), 64), v)
    return found.select("id", "word", "trainable", F.when(F.col("trainable"), 0.0).otherwise(F.round(F.element_at("vec", 1).cast("double"), 6)).alias("first"))


@query()
def embedding_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.random_vectors(_vocab(spark, sf_dir), 8)


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS topic FROM embeddings")
def topic_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", TP.argmax(F.col("embedding")).alias("topic"))


DROP = f"{TF}, top AS (SELECT word FROM f ORDER BY tf DESC, word LIMIT 100)"


@query(f"WITH {DROP}, l AS (SELECT list(word) AS l FROM top), x AS (SELECT doc_id, list_filter({words('text')}, lambda w: length(w) >= 3 AND NOT list_contains(l.l, w)) AS kept FROM documents, l) SELECT doc_id, array_to_string(kept, ' ') AS line FROM x WHERE len(kept) >= 3")
def lda_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TP.prepare(read(spark, sf_dir, "documents"), drop_frequent=100).select("doc_id", F.array_join("kept", " ").alias("line"))


STOP = ["the", "of", "and", "to", "in", "is", "it's"]


@query(f"""WITH x AS (SELECT doc_id, list_filter({words('text')}, lambda w: lower(w) NOT IN ('the', 'of', 'and', 'to', 'in', 'is', 'it''s', '''ll', '''ve', '''re', 'n''t', 'doesn''t', 'don''t', 'i''m') AND length(w) >= 3) AS k FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(k, lambda w: translate(lower(w), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')), lambda t: t <> ''), ' ') AS terms FROM x""")
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.topic_terms(X.tok("text"), STOP, 3), " ").alias("terms"))


@query(f"WITH t AS (SELECT doc_id, unnest({words('text')}) AS word FROM documents) SELECT word, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY word HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.5 * (SELECT count(*) FROM documents)")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TP.document_frequency(read(spark, sf_dir, "documents").withColumn("terms", X.tok("text")), no_below=5, no_above=0.5)


@query()
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of dialogue contexts under a small model (stochastic, so tests hold its form and repeatability)."""
    dialogues = conversations(spark, sf_dir).withColumn("text", F.array_join("utterances", " "))
    model = TP.train(dialogues, n_topics=4, no_below=2, no_above=1.0, passes=3)
    return TP.infer_dialogues(dialogues, model, n_words=5).select("conv_id", "topic", F.array_join("topic_words", " ").alias("topic_words"))
